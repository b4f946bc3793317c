"""Whether a result is the top-N of its candidates, told without sorting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def certify_top(scored: DataFrame, result: DataFrame, limit: int) -> DataFrame:
    """The candidates ``scored`` of one user with ``in_result`` and ``certified``.

    Both tables are ``userId, movieId, prediction, title``; ``result`` has at most
    ``limit`` rows. Each candidate counts the result rows that beat it: by a
    larger score (NaN is the largest), or at the same score by a smaller item or
    title. A candidate outside is certified if ``limit`` rows beat it, one inside
    if fewer do. A result with a row that is no candidate certifies nothing. No
    sort, no join: the result is one array of ``limit`` elements.
    """
    columns = ("userId", "movieId", "prediction", "title")
    best = result.agg(F.collect_list(F.struct(*columns)).alias("best")).scalar()

    def beats(row: Column) -> Column:
        same_score = row["prediction"].eqNullSafe(F.col("prediction"))
        smaller = (row["movieId"] < F.col("movieId")) | (
            (row["movieId"] == F.col("movieId")) & (row["title"] < F.col("title"))
        )
        return (row["prediction"] > F.col("prediction")) | (same_score & smaller)

    compared = scored.withColumn("best", best).select(
        *columns,
        F.size("best").alias("n_best"),
        F.size(F.filter("best", lambda row: beats(row))).alias("beaten_by"),
        F.exists(
            "best",
            lambda row: row["userId"].eqNullSafe(F.col("userId"))
            & row["movieId"].eqNullSafe(F.col("movieId"))
            & row["title"].eqNullSafe(F.col("title"))
            & row["prediction"].eqNullSafe(F.col("prediction")),
        ).alias("in_result"),
    )
    matched = compared.agg(F.sum(F.col("in_result").cast("int"))).scalar()
    inside = F.col("beaten_by") < limit
    outside = (F.col("beaten_by") == F.col("n_best")) & (F.col("n_best") == limit)
    certified = (F.col("matched") == F.col("n_best")) & F.when(F.col("in_result"), inside).otherwise(outside)
    return compared.withColumn("matched", matched).select(
        *columns, "in_result", certified.alias("certified")
    )
