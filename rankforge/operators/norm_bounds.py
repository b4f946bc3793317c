"""The best items of every user without scoring the whole catalog.

A score is at most the product of the norms of its two vectors. Items lie in
blocks by falling norm, and a block whose largest norm times the user's is below
the user's N-th score so far cannot hold a better item, nor can any block behind.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.vector import dot
from rankforge.operators.ranking import DEFAULT_LIMIT, number_rows
from rankforge.session import stored

BLOCK_ITEMS = 256
# The largest norms of all blocks are one array in the plan.
MOST_BLOCKS = 1024
# What rounding can make of a product of norms.
_SLACK = 1 + 1e-9


def item_blocks(items: DataFrame, rank: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``block, movieId, of_item, norm``, stored; blocks are numbered by falling norm.

    ``items`` are ``id, features``. Blocks hold ``block_items`` items, or more if
    there would be over ``MOST_BLOCKS`` blocks.
    """
    f = F.col("features")
    normed = items.select(
        F.col("id").alias("movieId"), f.alias("of_item"), F.sqrt(dot("features", "features", rank)).alias("norm")
    )
    block_items = max(block_items, math.ceil(items.count() / MOST_BLOCKS))
    ranked = number_rows(normed, [F.desc("norm"), F.asc("movieId")])
    block = F.expr(f"(rank - 1) div {block_items}").cast("int")
    return stored(ranked.select(block.alias("block"), "movieId", "of_item", "norm"), "item-blocks")


def top_items(
    users: DataFrame,
    blocks: DataFrame,
    rank: int,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """``userId, movieId, prediction, blocks_read`` of the ``limit`` best items of every user.

    ``users`` are ``id, features``, ``blocks`` those of ``item_blocks``. Exact:
    the same rows as scoring all pairs and taking the highest, ties by item.
    Blocks are read in rounds of one, one, two, four and so on, and only by users
    whose bound is open; each round raises the N-th scores. The join of a round
    has users and items on both sides of a block, which AQE splits where a block
    is hot, and rows below the N-th score leave before the ranking. A negative
    N-th score, or fewer items than ``limit``, keeps all blocks open.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    f = F.col("features")
    people = stored(
        users.select(
            F.col("id").alias("userId"), f.alias("of_user"), F.sqrt(dot("features", "features", rank)).alias("length")
        ),
        "users",
    )
    norms = [
        row["norm"]
        for row in blocks.groupBy("block").agg(F.max("norm").alias("norm")).orderBy("block").collect()
    ]  # MOST_BLOCKS at most
    ranking = Window.partitionBy("userId").orderBy(F.desc("prediction"), F.asc("movieId"))
    schema = "userId int, movieId int, prediction double"
    best = users.sparkSession.createDataFrame([], schema)
    reads = people.select("userId", "of_user", "length", F.lit(0).alias("read"), F.lit(None).cast("double").alias("nth"))
    low, high = 0, 1
    while low < len(norms):
        # As norms fall, the open blocks of a round are its first ones.
        round_norms = F.array(*[F.lit(float(n)) for n in norms[low:high]])
        is_open = lambda n: F.col("nth").isNull() | (n * F.col("length") * F.lit(_SLACK) >= F.col("nth"))
        opened = F.size(F.filter(round_norms, is_open))
        asking = reads.withColumn("open", opened)
        scored = (
            asking.where("open > 0")
            .withColumn("block", F.explode(F.sequence(F.lit(low), F.lit(low - 1) + F.col("open"))))
            .join(blocks.select("block", "movieId", "of_item"), "block")
            .select("userId", "movieId", dot("of_user", "of_item", rank).alias("prediction"), "nth")
            .where(F.col("nth").isNull() | (F.col("prediction") >= F.col("nth")))
            .select("userId", "movieId", "prediction")
        )
        merged = best.unionByName(scored)
        best = stored(
            merged.withColumn("place", F.row_number().over(ranking)).where(F.col("place") <= limit).drop("place"),
            "best",
        )
        found = best.groupBy("userId").agg(
            F.when(F.count(F.lit(1)) == limit, F.min("prediction")).alias("nth")
        )
        reads = stored(
            asking.select("userId", "of_user", "length", (F.col("read") + F.col("open")).alias("read"))
            .join(found, "userId", "left"),
            "reads",
        )
        low, high = high, 2 * high
    return best.join(reads.select("userId", F.col("read").alias("blocks_read")), "userId").select(
        "userId", "movieId", "prediction", "blocks_read"
    )
