"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``a, b`` (long) to ``node, component``, the smallest node reachable.

    Every node of a link gets a row; links to itself and nulls are left out.
    Each round attaches larger neighbours to the smallest one seen, so a hub is
    one row for each neighbour, and mins combine on the map side. The edges of a
    round are a written table. Rounds grow with the logarithm of the diameter.
    """
    edges = stored(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = _state(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component"))
    )


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mark).first())


def _large_star(edges: DataFrame) -> DataFrame:
    # The larger neighbours of a node go to the smallest node around it.
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return up.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    # The smaller neighbours of a node, and the node, go to the smallest of them.
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(low, "a").where(F.col("b") != F.col("low"))
    return (
        moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
        .unionAll(low.select("a", F.col("low").alias("b")))
        .distinct()
    )
