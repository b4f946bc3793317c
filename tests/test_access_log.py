import random
import re
from collections import Counter
from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.errors import AnalysisException, SparkRuntimeException

from rankforge.operators.access_log import (
    active_user_total,
    count_by_user,
    parse_access_log,
)
from rankforge.plans.top_users import top_users

DAY = date(2015, 7, 13)

EDGE_LINES = [
    ("[13/Jul/2015:10:00:00] username='aaaaaaaa' x", [("aaaaaaaa", DAY)]),
    ("[13/Jul/2015:10] username='aaaaaaaa' then username='bbbbbbbb'", [("bbbbbbbb", DAY)]),
    ("[13/Jul/2015:10] username='aaaaaaaa' then username='bbbbbbbbb'", [("aaaaaaaa", DAY)]),
    ("[13/Jul/2015:10] username='aaaaaaaa' then username='bbbbbbb'", [("aaaaaaaa", DAY)]),
    ("[13/Jul/2015:10] username='aaaaaaaa' then username='bbbb-bbb'", [("aaaaaaaa", DAY)]),
    ("[13/Jul/2015username='aaaaaaaa'", []),
    ("[13/Jul/2015 username='aaaaaaaa'", [("aaaaaaaa", DAY)]),
    ("x [13/Jul/2015: username='aaaaaaaa'", []),
    (" [13/Jul/2015: username='aaaaaaaa'", []),
    ("[3/Jul/2015: username='aaaaaaaa'", []),
    ("[13/07/2015: username='aaaaaaaa'", []),
    ("[13/Jul/2015: username='aaaaaaaaa'", []),
    ("[13/Jul/2015: username='äaaaaaaa'", []),
    ("[13/Jul/2015: ünï username='Az09Az09'", [("Az09Az09", DAY)]),
    ("[13/Jul/2015: username=\"aaaaaaaa\"", []),
    ("[13/Foo/2015: username='cccccccc'", [("cccccccc", None)]),
    ("[31/Feb/2015: username='cccccccc'", [("cccccccc", None)]),
    ("[13/jul/2015: username='cccccccc'", [("cccccccc", DAY)]),
    ("", []),
    ("[", []),
]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_parse_edge_lines(spark, lines, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = rows(parse_access_log(lines(*[line for line, _ in EDGE_LINES])))
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert got == [row for _, expected in EDGE_LINES for row in expected]


def test_parse_against_brute_force(lines):
    """Lines put together from fragments at random, matched by Python's ``re``."""
    rng = random.Random(7)
    starts = ["[13/Jul/2015", "[01/Jan/2016", " [13/Jul/2015", "[1/Jul/2015", "13/Jul/2015", ""]
    parts = [":10]", " ", "username='", "'", "abcdefgh", "ABCD1234", "short", "toolong99", "é", "x"]
    parts += ["username='abcdefgh'", "username='ABCD1234'", "username='toolong99'"]
    made = [
        rng.choice(starts) + "".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4000)
    ]
    month = {"Jan": 1, "Jul": 7}
    expected = []
    for line in made:
        found = re.match(r"\[(\d\d)/([A-Za-z]{3})/(\d{4}).+username='([A-Za-z0-9]{8})'", line)
        if found:
            day, name, year, user = found.groups()
            expected.append((user, date(int(year), month[name], int(day))))
    assert len(expected) > 250
    assert Counter(rows(parse_access_log(lines(*made)))) == Counter(expected)


def entry(day, user="aaaaaaaa"):
    return f"[{day:%d/%b/%Y}:10:00:00] GET username='{user}'"


@pytest.mark.parametrize(
    "low, high",
    [
        (None, None),
        ("", ""),
        ("2015-07-12", None),
        (None, "2015-07-22"),
        ("2015-07-12", "2015-07-22"),
        (date(2015, 7, 12), date(2015, 7, 22)),
        ("2015-07-15", "2015-07-15"),
        ("2015-07-22", "2015-07-12"),
        ("1800-01-01", "2015-07-12"),
        ("2015-07-20", "9999-12-31"),
    ],
)
@pytest.mark.parametrize("on_bad_date", ["fail", "drop"])
def test_bounds_are_inclusive_and_optional(lines, low, high, on_bad_date):
    days = [date(2015, 7, 8) + timedelta(days=i) for i in range(20)]
    got = rows(parse_access_log(lines(*map(entry, days)), low, high, on_bad_date))
    expected = [
        ("aaaaaaaa", d)
        for d in days
        if (not low or str(d) >= str(low)) and (not high or str(d) <= str(high))
    ]
    assert got == expected


BAD = ["[13/Foo/2015: username='cccccccc'", "[31/Feb/2015: username='cccccccc'"]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("bounds", [("2015-07-01", None), (None, "2015-07-31"), ("2015-07-01", "2015-07-31"), ("2015-07-31", "2015-07-01")])
def test_bad_date_matters_only_with_a_bound(spark, lines, bounds, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for bad in BAD:
            log = lines(bad, entry(DAY))
            assert dict(rows(top_users(log))) == {"cccccccc": 1, "aaaaaaaa": 1}
            with pytest.raises(SparkRuntimeException, match="no valid date in an entry of user cccccccc"):
                top_users(log, *bounds).collect()
            kept = dict(rows(top_users(log, *bounds, on_bad_date="drop")))
            assert kept == ({} if None not in bounds and bounds[0] > bounds[1] else {"aaaaaaaa": 1})
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_clamped_dates(spark, lines, ansi):
    texts = {
        "31/Feb/2015": date(2015, 2, 28), "29/Feb/2016": date(2016, 2, 29), "31/Apr/2015": date(2015, 4, 30),
        "31/Dec/2015": date(2015, 12, 31), "01/Jan/2015": date(2015, 1, 1), "13/jul/2015": None,
        "32/Jul/2015": None, "00/Jul/2015": None, "13/anF/2015": None, "13/Foo/2015": None, "13/Jul/0000": None,
    }
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        log = lines(*[f"[{text}: username='cccccccc'" for text in texts])
        assert [r[1] for r in rows(parse_access_log(log, on_bad_date="clamp"))] == list(texts.values())
        for text, day in texts.items():
            one = parse_access_log(lines(f"[{text}: username='cccccccc'", "[", "[x"), "2015-01-01", "2016-12-31", "clamp")
            if day:
                assert rows(one) == [("cccccccc", day)]
            else:
                with pytest.raises(SparkRuntimeException, match="no valid date"):
                    one.collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_bad_date_of_a_line_that_is_no_entry_is_ignored(lines):
    log = lines("[13/Foo/2015: username='short'", "[99/Jul/2015: nobody", "[", "[13", entry(DAY))
    assert rows(top_users(log, "2015-07-01", "2015-07-31")) == [("aaaaaaaa", 1)]


@pytest.mark.parametrize("value", ["2015-7-1", "20150701", "2015-W28-1", "yesterday", "2015-02-30"])
def test_bounds_must_be_iso_dates(lines, value):
    with pytest.raises(ValueError):
        top_users(lines(), date_from=value)


def test_unknown_bad_date_policy(lines):
    with pytest.raises(ValueError, match="on_bad_date"):
        top_users(lines(), on_bad_date="ignore")


def test_counts_and_total(lines):
    log = lines(entry(DAY, "aaaaaaaa"), entry(DAY, "bbbbbbbb"), entry(DAY, "aaaaaaaa"), "noise")
    entries = parse_access_log(log)
    assert dict(rows(count_by_user(entries))) == {"aaaaaaaa": 2, "bbbbbbbb": 1}
    assert count_by_user(entries).dtypes == [("username", "string"), ("n", "bigint")]
    assert rows(active_user_total(entries)) == [(2,)]
    assert rows(active_user_total(parse_access_log(lines("noise")))) == [(0,)]


def test_top_users_order_ties_and_limit(lines):
    hits = {f"user{i:04d}": n for i, n in enumerate([3, 5, 3, 1, 5, 2, 2, 2, 2, 2, 2, 9])}
    log = [entry(DAY, user) for user, n in hits.items() for _ in range(n)]
    random.Random(1).shuffle(log)
    ranked = sorted(hits.items(), key=lambda kv: (-kv[1], kv[0]))
    assert rows(top_users(lines(*log))) == ranked[:10]
    for limit in (0, 1, 3, 12, 100):
        assert rows(top_users(lines(*log), limit=limit)) == ranked[:limit]
    with pytest.raises(AnalysisException):
        top_users(lines(*log), limit=-1).collect()


def test_hot_user_holding_most_lines(spark):
    """One user has a third of all lines; the others have one or two each."""
    from pyspark.sql import functions as F

    name = F.when(F.col("id") % 3 == 0, F.lit("hothothh")).otherwise(
        F.lpad((F.col("id") % 4000).cast("string"), 8, "0")
    )
    log = spark.range(0, 12000, 1, 16).select(
        F.concat(F.lit("[13/Jul/2015:10] username='"), name, F.lit("'")).alias("value")
    )
    expected = Counter("hothothh" if i % 3 == 0 else f"{i % 4000:08d}" for i in range(12000))
    assert dict(rows(count_by_user(parse_access_log(log)))) == expected
    assert rows(top_users(log, limit=1)) == [("hothothh", 4000)]
