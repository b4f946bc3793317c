"""Job inputs derived from the given tables, for the queries and the tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions.evaluation import once

BAD_DATE = "31/Foo/2024"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def render_access_log(
    events: DataFrame, bad_dates: bool = False, bad_date: str = BAD_DATE
) -> DataFrame:
    """One log line ``value`` per event.

    Clicks, purchases and views name their user, views after a decoy. Sign-ups
    carry a name one character too long. Errors name nobody; with ``bad_dates``
    they name their user under ``bad_date``, which does not exist.
    """
    user = F.col("user_id").cast("string")
    name = F.lpad(user, 8, "0")
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    kind = F.col("event_type")

    def mention(who: Column) -> Column:
        return F.concat(F.lit(" username='"), who, F.lit("'"))

    rest = (
        F.when(kind.isin("click", "purchase"), mention(name))
        .when(kind == "view", F.concat(mention(F.lit("decoy000")), mention(name)))
        .when(kind == "signup", mention(F.lpad(user, 9, "0")))
        .otherwise(mention(name) if bad_dates else F.lit(""))
    )
    if bad_dates:
        stamp = F.when(kind == "error", F.lit(f"{bad_date}:00:00:00")).otherwise(stamp)
    line = F.concat(F.lit("["), stamp, F.lit("] "), kind, rest)
    # As from a scan: operators that look at a line do not render it again.
    return events.select(once(line).alias("value"))


def derive_ratings(orders: DataFrame, lineitem: DataFrame, by_item: bool = False) -> DataFrame:
    """One rating per customer and part, from the largest quantity ordered.

    ``by_item`` deals them out by ranges of items and users, not by hashes: the
    ratings of an item lie together, those of a frequent one in several partitions.
    """
    rated = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("int").alias("userId"),
        F.col("l_partkey").cast("int").alias("movieId"),
        (F.ceil(F.col("l_quantity") / 5) / 2).alias("stars"),
    )
    if by_item:
        rated = rated.repartitionByRange("movieId", "userId")
    return rated.groupBy("userId", "movieId").agg(F.max("stars").alias("rating"))


def derive_items(part: DataFrame) -> DataFrame:
    """Titles hold a comma, so the CSV form has to quote them."""
    return part.select(
        F.col("p_partkey").cast("int").alias("movieId"),
        F.concat("p_name", F.lit(", "), "p_brand").alias("title"),
        F.col("p_type").alias("genres"),
    )


def fixed_factors(embeddings: DataFrame) -> DataFrame:
    """Factors that do not depend on a training, for users and items alike."""
    return embeddings.select(
        F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("features")
    )


def factor_pairs(lineitem: DataFrame) -> DataFrame:
    """Pairs to score with the fixed factors; most part keys have no vector."""
    return lineitem.select(
        F.col("l_suppkey").cast("int").alias("userId"),
        F.col("l_partkey").cast("int").alias("movieId"),
    )


def write_ratings_csv(ratings: DataFrame, path: str) -> str:
    """Ratings with the fourth column their file has, and a header."""
    rows = ratings.select("userId", "movieId", "rating", F.lit(0).cast("bigint").alias("timestamp"))
    return _write_csv(rows, path)


def write_items_csv(items: DataFrame, path: str) -> str:
    return _write_csv(items.select("movieId", "title", "genres"), path)


def _write_csv(rows: DataFrame, path: str) -> str:
    rows.write.option("header", True).option("escape", '"').csv(path)
    return path
