"""Connected components of a list of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import scratch


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; component is its least node.

    Alternates the large-star and small-star steps: each moves links towards the least node
    seen, folds on the map side, and is written to shared storage, so no lineage builds up and
    a node with very many links is never gathered. Ends when a round changes no link; that takes
    a number of rounds which grows with the logarithm of the longest chain.
    """
    edges = scratch(_ordered(links.select("a", "b")), "links")
    before = _summary(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"),
                                                             F.col("m").alias("b"))
        large = scratch(_ordered(large), "large-star")
        # Small star: links point from the larger node a to the smaller node b.
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(lowest, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = scratch(_ordered(moved), "small-star")
        after = _summary(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return leaves.unionByName(roots)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"),
                                         F.greatest("a", "b").alias("b")).distinct()


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
