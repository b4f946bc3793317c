"""Order results, with ties broken so that a result has one order only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.session import stored

DEFAULT_LIMIT = 10

# Beyond so many rows a result is ranked in ranges and not by one heap.
HEAP_ROWS = 100_000
ROWS_PER_RANGE = 1_000_000


def rank_counts(counts: DataFrame) -> DataFrame:
    """Largest count first, then by user."""
    return counts.orderBy(*_counts_order())


def top_counts(counts: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The ``limit`` largest counts, in order: a heap per partition, no global sort.

    A limit beyond ``HEAP_ROWS`` gives as many rows in many ordered partitions.
    """
    if limit > HEAP_ROWS:
        return in_ordered_files(number_rows(counts, _counts_order(), limit))
    return counts.orderBy(*_counts_order()).limit(limit)


def number_rows(
    rows: DataFrame, order: Sequence[Column], limit: int | None = None, per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add ``rank``, 1 for the first row in ``order``; with a ``limit`` later rows drop.

    No task holds more than a range of about ``per_range`` rows: the rows are
    dealt out by ranges of the order, sorted within, written with their place,
    and counted per range. Counts of the ranges before give the rank, and ranges
    behind the ``limit`` are not read again. Rows of equal order get ranks as
    they come: name all columns that matter.
    """
    spark = rows.sparkSession
    ranges = max(1, math.ceil(rows.count() / per_range))
    # The id holds the number of the task above bit 33 and the place of the row below.
    placed = stored(
        rows.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id()),
        "ranges",
    )
    part = F.shiftright("__id", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(  # a row per range
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    if limit is not None:
        offsets = offsets.where(F.col("__before") < limit)
        last = offsets.agg(F.max("__part")).first()[0]
        placed = placed.where(F.col("__id") < F.lit(((-1 if last is None else last) + 1) << 33))
    place = F.col("__id").bitwiseAND((1 << 33) - 1)
    numbered = (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .select(*rows.columns, (F.col("__before") + place + 1).alias("rank"))
    )
    return numbered if limit is None else numbered.where(F.col("rank") <= limit)


def in_ordered_files(ranked: DataFrame, per_file: int = ROWS_PER_RANGE) -> DataFrame:
    """Rows of ``number_rows`` so that they leave in files of ``per_file``, in rank order."""
    files = max(1, math.ceil(ranked.count() / per_file))
    return ranked.repartitionByRange(files, "rank").sortWithinPartitions("rank").drop("rank")


def rank_recommendations(scored: DataFrame, score: str = "prediction") -> DataFrame:
    """Highest score first, NaN above all numbers, then by item and title."""
    return scored.orderBy(*_score_order(scored.columns, score))


def top_recommendations(
    scored: DataFrame, limit: int = DEFAULT_LIMIT, score: str = "prediction"
) -> DataFrame:
    """The ``limit`` highest scores; many of them as ``top_counts`` gives them."""
    order = _score_order(scored.columns, score)
    if limit > HEAP_ROWS:
        return in_ordered_files(number_rows(scored, order, limit))
    return scored.orderBy(*order).limit(limit)


def _counts_order() -> list[Column]:
    return [F.desc("n"), F.asc("username")]


def _score_order(columns: Sequence[str], score: str) -> list[Column]:
    ties = [F.asc(c) for c in ("movieId", "title") if c in columns]
    return [F.desc(score), *ties]
