"""Score user-item pairs with latent factors, and add titles.

Factor tables are ``id int, features array<float>``, as an ALS model has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions.vector import dot


def score_pairs(
    pairs: DataFrame, user_factors: DataFrame, item_factors: DataFrame, rank: int | None = None
) -> DataFrame:
    """``userId, movieId, prediction``; pairs with an unknown id drop.

    For many users. No side is hinted: AQE broadcasts a factor table when its
    measured size allows it, and splits the pairs of a hot item or user when it
    does not. The item comes first because titles, when they follow, join on the
    item too: AQE splits no join whose partitioning the next join relies on.
    """
    users = user_factors.select(F.col("id").alias("userId"), F.col("features").alias("of_user"))
    items = item_factors.select(F.col("id").alias("movieId"), F.col("features").alias("of_item"))
    return (
        pairs.join(items, "movieId")
        .join(users, "userId")
        .select("userId", "movieId", dot("of_user", "of_item", rank).alias("prediction"))
    )


def score_titled_pairs(
    pairs: DataFrame,
    user_factors: DataFrame,
    item_factors: DataFrame,
    items: DataFrame,
    rank: int | None = None,
) -> DataFrame:
    """``score_pairs`` with ``title``; pairs of an item without one drop.

    Titles meet the factors first, two tables of the size of the catalog, so the
    pairs are shuffled once for both and not once for each.
    """
    titles = items.select("movieId", "title")
    of_items = item_factors.select(F.col("id").alias("movieId"), F.col("features").alias("of_item"))
    users = user_factors.select(F.col("id").alias("userId"), F.col("features").alias("of_user"))
    return (
        pairs.join(of_items.join(titles, "movieId"), "movieId")
        .join(users, "userId")
        .select(
            "userId",
            "movieId",
            dot("of_user", "of_item", rank).alias("prediction"),
            "title",
        )
    )


def score_user(
    candidates: DataFrame,
    user_factors: DataFrame,
    item_factors: DataFrame,
    user_id: int,
    rank: int | None = None,
) -> DataFrame:
    """``score_pairs`` for candidates that all belong to one user.

    The user's factors are one row, looked up by a scalar subquery. Joining on
    the user instead would send every candidate to the same partition. An
    unknown user has no factors and gets no rows.
    """
    mine = user_factors.where(F.col("id") == F.lit(user_id)).select("features").scalar()
    items = item_factors.select(F.col("id").alias("movieId"), F.col("features").alias("of_item"))
    return (
        candidates.join(items, "movieId")
        .select("userId", "movieId", "of_item", mine.alias("of_user"))
        .where(F.col("of_user").isNotNull())
        .select("userId", "movieId", dot("of_user", "of_item", rank).alias("prediction"))
    )


def join_items(scored: DataFrame, items: DataFrame) -> DataFrame:
    """Add ``title``; scored items without one drop."""
    return scored.join(items.select("movieId", "title"), "movieId", "inner")
