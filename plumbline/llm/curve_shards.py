"""Operator 12: shards along a Hilbert curve over several metadata columns.

Each dimension is quantised by rank: a value's cell is its share of the rows before it, in ``2 ** bits``
steps, NULL first. So every dimension, number or text, is spread evenly, whatever its distribution. Rows
are sorted by the Hilbert index of their cells (Skilling, "Programming the Hilbert curve", 2004), numbered over
all ranges of the sort, and cut into runs of equal rows or equal bytes. Neighbours on the curve are alike in all
dimensions, so a file holds a small box of them, and a filter on any dimension skips most files.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import scratch


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each column of ``cells`` (a row per dimension, values below ``2 ** bits``)."""
    x = cells.astype(np.int64).copy()
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            place = place << 1 | row >> b & 1
    return place


def _in_ranges(df: DataFrame, order: Sequence[Column], purpose: str) -> DataFrame:
    """``df`` sorted over ranges, written, with ``range`` and ``at``, a row's number in its range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    low = (1 << 33) - 1
    return scratch(placed.withColumns({"range": F.shiftright("at", 33).cast("int"), "at": F.col("at").bitwiseAND(F.lit(low))}), purpose)


def _with_offsets(ranged: DataFrame, amount: str) -> DataFrame:
    """``before``: the sum of ``amount`` in all earlier ranges. The joined list has a row per range."""
    totals = ranged.groupBy("range").agg(F.sum(amount).alias("total"))
    along = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", F.coalesce(F.sum("total").over(along), F.lit(0)).alias("before"))
    return ranged.join(F.broadcast(offsets), "range")


def cell_of(df: DataFrame, dimension: str, bits: int) -> Column:
    """The cell of each row's value: floor(2^bits x rows with a smaller value / rows), NULL first.

    Distinct values are counted and summed up in ranges; the driver gets the first value of each cell, at most ``2 ** bits``.
    """
    counts = df.groupBy(F.col(dimension).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = _with_offsets(_in_ranges(counts, [F.col("v").asc_nulls_first()], "values"), "n")
    inside = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    rows = df.count()
    numbered = ranged.select("v", F.expr("n").alias("n"), smaller.alias("smaller")).filter("v IS NOT NULL")
    cell = F.floor(F.col("smaller") * F.lit(1 << bits) / F.lit(max(rows, 1))).cast("int")
    firsts = numbered.groupBy(cell.alias("cell")).agg(F.min("v").alias("v")).orderBy("cell").collect()
    if not firsts:
        return F.lit(0)
    kind = df.schema[dimension].dataType
    values = F.array(*[F.lit(r.v).cast(kind) for r in firsts])
    numbers = F.array(*[F.lit(r.cell) for r in firsts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(firsts).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(values, at + step - 1) <= F.col(dimension), at + step).otherwise(at))
    return F.coalesce(F.get(numbers, found - 1), F.lit(0))


def hilbert_shards(df: DataFrame, dimensions: Sequence[str], shards: int = 16, law: str = "rows", size_col: str | None = None,
                   ties: Sequence[str] = (), bits: int = 8) -> DataFrame:
    """The rows of ``df`` with ``curve``, ``shard`` (0 to ``shards`` - 1) and ``slot`` (their number in the shard, from 0).

    ``law="rows"`` cuts runs whose numbers of rows differ by one at most; ``law="bytes"`` cuts the sum of ``size_col``
    (not NULL, not negative), so a shard is off by one row's size at most. Rows of one place on the curve are ordered by
    ``ties`` (NULL last) and then as they were read; a hot value is cut like any other run.

    NULL in a dimension is a value of its own, the least. Repeated rows each get a slot. Columns of ``df`` named
    ``curve``, ``shard`` or ``slot`` are replaced; any other names may clash with nothing. An empty table gives an empty one.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is 'rows' or 'bytes'")
    if law == "bytes" and size_col is None:
        raise ValueError("law 'bytes' needs size_col")
    if len(dimensions) * bits > 62:
        raise ValueError("dimensions x bits must stay below 63")

    @F.pandas_udf("long")
    def curve(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells]), bits))

    names = [f"t{i}" for i in range(len(ties))]
    keyed = df.select(
        F.struct(*[F.col(c) for c in df.columns if c not in ("curve", "shard", "slot")]).alias("row"),
        curve(*[cell_of(df, d, bits).cast("int") for d in dimensions]).alias("curve"),
        (F.col(size_col).cast("long") if law == "bytes" else F.lit(1).cast("long")).alias("amount"),
        *[F.col(c).alias(n) for c, n in zip(ties, names)], F.monotonically_increasing_id().alias("read"))
    order = [F.col("curve"), *[F.col(n).asc_nulls_last() for n in names], F.col("read")]
    ranged = _in_ranges(keyed, order, "curve").drop(*names, "read")
    total = ranged.agg(F.coalesce(F.sum("amount"), F.lit(0))).first()[0]
    placed = _with_offsets(ranged, "amount")
    if law == "rows":
        earlier = F.col("before") + F.col("at")
    else:
        inside = Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        earlier = F.col("before") + F.coalesce(F.sum("amount").over(inside), F.lit(0))
    # Whole numbers: earlier x shards may be beyond 64 bits.
    shard = F.expr(f"least(cast(cast(earlier as decimal(38, 0)) * {shards} div {max(int(total), 1)} as int), {shards - 1})")
    cut = placed.withColumn("earlier", earlier).withColumn("shard", shard)
    # A row per range and shard: where in the shard the range's rows begin.
    parts = cut.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    along = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select("range", "shard", (F.coalesce(F.sum("n").over(along), F.lit(0)) - F.col("first")).alias("begin"))
    # At most a row per range and one more per shard.
    return cut.join(F.broadcast(begins), ["range", "shard"]).select(
        "row.*", "curve", "shard", (F.col("begin") + F.col("at")).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write a folder per shard, whose files are runs of its slots. Many files a shard let many tasks write it."""
    shards = sharded.select("shard").distinct().count()
    ordered = sharded.repartitionByRange(max(1, shards * files_per_shard), "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def shard_manifest(spark: SparkSession, path: str, dimensions: Sequence[str]) -> DataFrame:
    """Of each file its rows and the least and greatest value of each dimension (``<name>_min``, ``<name>_max``)."""
    rows = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    bounds = [f(d).alias(f"{d}_{n}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy(F.col("_file").alias("file"), "shard").agg(F.count(F.lit(1)).alias("n_rows"), *bounds)


def files_holding(manifest: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """The files of a manifest that can hold rows with every dimension within its (least, greatest) bounds."""
    for d, (low, high) in bounds.items():
        manifest = manifest.filter((F.col(f"{d}_max") >= F.lit(low)) & (F.col(f"{d}_min") <= F.lit(high)))
    return manifest.select("file")
