"""Readers of the job inputs. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

RATINGS_FILE = "ratings.csv"
ITEMS_FILE = "movies.csv"
RATINGS_SCHEMA = "userId int, movieId int, rating double, timestamp bigint"
ITEMS_SCHEMA = "movieId int, title string, genres string"
# Holds lines with more or fewer fields than the schema.
IRREGULAR = "irregular_line"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row ``value string`` per line of a file, directory or glob."""
    return spark.read.text(path)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Ratings file to ``userId int, movieId int, rating double``.

    A malformed or absent number fails the query that reads it.
    """
    rows = _csv(spark, path, RATINGS_SCHEMA)
    return rows.select(*[_required(c, path) for c in ("userId", "movieId", "rating")])


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items file to ``movieId int, title string``; titles may be quoted or empty.

    A row of one field, or without a number, fails the query that reads it.
    """
    schema = f"{ITEMS_SCHEMA}, {IRREGULAR} string"
    reader = _reader(spark, schema).option("mode", "PERMISSIVE").option("columnPruning", False)
    rows = reader.option("columnNameOfCorruptRecord", IRREGULAR).csv(path)
    # An absent title reads like an empty one, so the line itself has to tell;
    # with pruned columns it would not be there.
    alone = ~F.coalesce(F.contains(IRREGULAR, F.lit(",")), F.lit(True))
    title = F.when(alone, F.raise_error(F.lit(f"no title in a row of {path}")).cast("string"))
    return rows.select(
        _required("movieId", path),
        title.otherwise(F.coalesce("title", F.lit(""))).alias("title"),
    )


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _reader(spark, schema).option("mode", "FAILFAST").csv(path)


def _reader(spark: SparkSession, schema: str) -> DataFrameReader:
    # A quote inside a quoted field is doubled. Lines end records, so large
    # files stay splittable. Of ratings only the selected columns are parsed.
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("escape", '"')
        .option("enforceSchema", True)
    )


def _required(name: str, path: str) -> Column:
    # The CSV reader turns an absent field into NULL, also when failing fast.
    missing = F.raise_error(F.lit(f"no {name} in a row of {path}"))
    return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(missing).alias(name)
