"""Columns that pick the user and the date out of an access log line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line format and the date format the logs are written in.
ENTRY_PATTERN = r"^\[([0-9]{2}/[A-Za-z]{3}/[0-9]{4}).+username='([A-Za-z0-9]{8})'"
ENTRY_START = "["
USER_MARK = "username='"
DATE_FORMAT = "dd/MMM/yyyy"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
USER_GROUP = 2


def may_be_entry(line: Column) -> Column:
    """True for every line that matches, and for few that do not.

    Both tests work on the UTF-8 bytes; the regular expression has to decode
    the line first.
    """
    return line.startswith(ENTRY_START) & line.contains(USER_MARK)


def users(line: Column) -> Column:
    """Array with the user of a matching line, empty for any other line.

    The pattern is anchored, so it matches a line at most once. Its greedy gap
    makes the last valid user name on the line win.
    """
    return F.regexp_extract_all(line, F.lit(ENTRY_PATTERN), F.lit(USER_GROUP))


def entry_date(line: Column) -> Column:
    """Date of a matching line, NULL where the calendar has no such date.

    In a matching line the date text always sits at characters 2 to 12, so no
    regular expression is needed for it.
    """
    return F.try_to_date(F.substring(line, 2, 11), DATE_FORMAT)


def clamped_date(line: Column) -> Column:
    """``entry_date``, but a day up to 31 that its month lacks is the month's last.

    Month names count in their exact case only.
    """
    day = F.substring(line, 2, 2).try_cast("int")
    year = F.substring(line, 9, 4).try_cast("int")
    # A name sits at every third place; three letters elsewhere are none.
    at = F.position(F.substring(line, 5, 3), F.lit(MONTHS))
    month = F.when(at % 3 == 1, ((at + 2) / 3).cast("int"))
    first = F.when(year >= 1, F.make_date(year, month, F.lit(1)))
    last = F.dayofmonth(F.last_day(first))
    return F.when(day.between(1, 31), F.date_add(first, F.least(day, last) - 1))
