"""One place for the session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app: str = "plumbline",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and UTC timestamps.

    On a cluster leave ``master`` and ``shuffle_partitions`` to spark-submit. Size the shuffle
    so that one partition is 100-200 MB; adaptive execution merges the small ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        # Noting the Python line of every column costs half the time to build a wide expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # A hot join key is split even when the split costs one more exchange downstream.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
