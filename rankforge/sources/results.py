"""Readers of what the sinks wrote, in both of their formats.

Rows come back as stored; ``rank_counts`` and ``rank_recommendations`` put
them in rank order again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The part file prefix and the text form of a recommendation.
PART_FILES = "part*"
RECOMMENDATION_PATTERN = r"^\(Rating\((-?[0-9]+),(-?[0-9]+),([^,)]+)\),(.*)\)$"

COUNTS_SCHEMA = "username string, n bigint"
RECOMMENDATIONS_SCHEMA = "userId int, movieId int, prediction double, title string"


def read_counts(
    spark: SparkSession, path: str, fmt: str = "parquet", all_runs: bool = False
) -> DataFrame:
    """Counts written by ``write_counts``.

    With ``all_runs`` the path is the one above the runs, and ``run_id`` is a
    column of the result.
    """
    rows, run = _read(spark, path, fmt, COUNTS_SCHEMA, all_runs)
    if fmt == "text":
        fields = F.split(F.translate("value", "()", ""), ",")
        rows = rows.where(F.size(fields) >= 2).select(
            fields[0].alias("username"), fields[1].cast("bigint").alias("n"), *run
        )
    return rows


def read_recommendations(
    spark: SparkSession, path: str, fmt: str = "parquet", all_runs: bool = False
) -> DataFrame:
    """Recommendations written by ``write_recommendations``."""
    rows, run = _read(spark, path, fmt, RECOMMENDATIONS_SCHEMA, all_runs)
    if fmt == "text":
        rows = rows.where(F.col("value").rlike(RECOMMENDATION_PATTERN)).select(
            _field(1).cast("int").alias("userId"),
            _field(2).cast("int").alias("movieId"),
            _field(3).cast("double").alias("prediction"),
            _field(4).alias("title"),
            *run,
        )
    return rows


def _field(group: int) -> Column:
    return F.regexp_extract("value", RECOMMENDATION_PATTERN, group)


def _read(
    spark: SparkSession, path: str, fmt: str, schema: str, all_runs: bool
) -> tuple[DataFrame, list[str]]:
    if fmt not in ("parquet", "text"):
        raise ValueError(f"fmt must be parquet or text, not {fmt!r}")
    schema = "value string" if fmt == "text" else schema
    # Declared as a string, so that an id made of digits stays one.
    run = ["run_id"] if all_runs else []
    if all_runs:
        schema += ", run_id string"
    reader = spark.read.schema(schema).option("pathGlobFilter", PART_FILES)
    return reader.format(fmt).load(path), run
