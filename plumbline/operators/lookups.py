"""Values looked up for rows, from a mapping of any length or a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import literal_map
from plumbline.operators.referential import unique_dimension
from plumbline.sources.tables import written

#: A longer mapping is joined instead of written into each row's expression. Rows, columns and
#: types are the same either way; only the plan differs.
INLINE_ENTRIES = 200


def with_lookup(df: DataFrame, key: Column, mapping: Mapping | DataFrame, output: str, found: str) -> DataFrame:
    """Add the value listed for ``key`` as ``output`` and whether the key is listed as ``found``.

    A table has the key in its first column and the value in its second; two values for one key
    stop the job. NULL keys are never listed; a listed NULL value counts as found.
    """
    if not isinstance(mapping, DataFrame):
        entries = {k: v for k, v in mapping.items() if k is not None}
        if not entries:
            return df.withColumns({output: F.lit(None).cast("string"), found: F.lit(False)})
        table = literal_map(entries)
        if len(entries) <= INLINE_ENTRIES:
            listed = F.coalesce(F.map_contains_key(table, key), F.lit(False))
            return df.withColumns({output: F.try_element_at(table, key), found: listed})
        mapping = df.sparkSession.range(1).select(F.explode(table).alias("key", "value"))
    names = mapping.columns
    pairs = mapping.select(F.col(names[0]).alias("_key"), F.col(names[1]).alias("_value"))
    pairs = written(unique_dimension(pairs, "_key"), "lookup").withColumn("_listed", F.lit(True))
    joined = df.join(pairs, key == F.col("_key"), "left")
    return joined.select(*[df[c] for c in df.columns], F.col("_value").alias(output),
                         F.coalesce("_listed", F.lit(False)).alias(found))
