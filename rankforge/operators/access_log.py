"""Access log: match lines within dates, count users."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions.evaluation import once
from rankforge.functions.log_line import clamped_date, entry_date, may_be_entry, users


def parse_access_log(
    lines: DataFrame,
    date_from: date | str | None = None,
    date_to: date | str | None = None,
    on_bad_date: str = "fail",
) -> DataFrame:
    """Lines ``value`` to ``username string, log_date date``; other lines drop.

    The bounds are inclusive and each is optional. Only with a bound do entries
    without a valid date matter: they fail the query, or are dropped with
    ``on_bad_date="drop"``. Without one their ``log_date`` is NULL, and dates
    are not parsed unless something downstream uses them. ``"clamp"`` reads the
    31st of February as its last day, wants month names in their exact case, and
    fails on what is no date then.
    """
    if on_bad_date not in ("fail", "drop", "clamp"):
        raise ValueError(f"on_bad_date must be fail, drop or clamp, not {on_bad_date!r}")
    date_of = clamped_date if on_bad_date == "clamp" else entry_date
    low, high = _as_date(date_from), _as_date(date_to)
    line, log_date = F.col("value"), F.col("log_date")
    # Exploding the array of matches finds and extracts in one evaluation of
    # the pattern; a filter followed by an extraction would need two.
    username = F.explode(users(line)).alias("username")
    lines = lines.where(may_be_entry(line))

    if low is None and high is None:
        return lines.select(username, date_of(line).alias("log_date"))

    # The date costs less than the pattern, so lines out of bounds go first.
    in_bounds = reduce(
        and_,
        ([log_date >= F.lit(low)] if low else []) + ([log_date <= F.lit(high)] if high else []),
    )
    dated = lines.select("value", once(date_of(line)).alias("log_date"))
    if on_bad_date == "drop":
        return dated.where(in_bounds).select(username, "log_date")

    # Only after the match is a line without a date known to be an entry. The
    # error names the user, which keeps the check above the match.
    bad_date = F.raise_error(F.concat(F.lit("no valid date in an entry of user "), "username"))
    return (
        dated.where(in_bounds | log_date.isNull())
        .select(username, "log_date")
        .where(F.when(log_date.isNotNull(), F.lit(True)).otherwise(bad_date.cast("boolean")))
    )


def count_by_user(entries: DataFrame) -> DataFrame:
    """``username, n``: entries per user, added up on the map side first."""
    return entries.groupBy("username").agg(F.count(F.lit(1)).alias("n"))


def active_user_total(entries: DataFrame) -> DataFrame:
    """One row ``n_users``: how many users have an entry."""
    return entries.agg(F.countDistinct("username").alias("n_users"))


def _as_date(value: date | str | None) -> date | None:
    if value is None or value == "":
        return None
    if isinstance(value, date):
        return value
    parsed = date.fromisoformat(value)
    if parsed.isoformat() != value:
        raise ValueError(f"not a yyyy-MM-dd date: {value!r}")
    return parsed
