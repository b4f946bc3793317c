"""Which items to score for a user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_candidates(pairs: DataFrame) -> DataFrame:
    """``userId, movieId`` without duplicates, so each pair is scored once."""
    return pairs.select("userId", "movieId").distinct()


def rated_by_others(ratings: DataFrame, user_id: int) -> DataFrame:
    """The user paired with every item that any other user rated.

    Needs ``userId`` and ``movieId`` only. Duplicates go by item alone, before
    the constant user is put back.
    """
    others = ratings.where(F.col("userId") != F.lit(user_id)).select("movieId").distinct()
    return _for_user(others, user_id)


def unseen(items: DataFrame, ratings: DataFrame, user_id: int) -> DataFrame:
    """The user paired with every known item they have not rated."""
    seen = ratings.where(F.col("userId") == F.lit(user_id)).select("movieId").distinct()
    rest = items.select("movieId").distinct().join(seen, "movieId", "left_anti")
    return _for_user(rest, user_id)


def rating_witnesses(ratings: DataFrame) -> DataFrame:
    """At most two rows ``userId, movieId`` per item that stand for all of them.

    Whether anyone but one given user rated an item is decided by the smallest
    and the largest user id among its ratings. ``rated_by_others`` therefore
    answers the same on this table as on the ratings, for every user, while the
    table grows with the items and not with the ratings.
    """
    return rater_bounds(ratings).select(
        F.explode(F.array_distinct(F.array("low", "high"))).alias("userId"), "movieId"
    )


def rater_bounds(ratings: DataFrame) -> DataFrame:
    """``movieId, low, high``: the smallest and the largest user id that rated an item.

    Somebody other than a user rated the item if ``low`` or ``high`` is not them.
    """
    return ratings.groupBy("movieId").agg(
        F.min("userId").alias("low"), F.max("userId").alias("high")
    )


def _for_user(items: DataFrame, user_id: int) -> DataFrame:
    return items.select(F.lit(user_id).cast("int").alias("userId"), "movieId")
