"""Job: the most active users of an access log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from rankforge.operators.access_log import count_by_user, parse_access_log
from rankforge.operators.ranking import DEFAULT_LIMIT, rank_counts, top_counts
from rankforge.sinks import run_path, write_counts
from rankforge.sources import read_counts, read_lines


def top_users(
    lines: DataFrame,
    date_from: date | str | None = None,
    date_to: date | str | None = None,
    limit: int = DEFAULT_LIMIT,
    on_bad_date: str = "fail",
) -> DataFrame:
    """``username, n`` of the ``limit`` users with most entries in the bounds."""
    entries = parse_access_log(lines, date_from, date_to, on_bad_date)
    return top_counts(count_by_user(entries), limit)


def run_top_users(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    run_id: str | None = None,
    limit: int = DEFAULT_LIMIT,
    date_from: date | str | None = None,
    date_to: date | str | None = None,
    on_bad_date: str = "fail",
    fmt: str = "parquet",
) -> DataFrame:
    """Read logs, write the result, and return what was written, in rank order."""
    run_path(output_dir, run_id)  # reject a bad path before the work starts
    result = top_users(read_lines(spark, input_dir), date_from, date_to, limit, on_bad_date)
    return rank_counts(read_counts(spark, write_counts(result, output_dir, run_id, fmt), fmt))
