"""What the physical plans must keep: few shuffles, one pattern, pushed filters."""

import re

import __spark_entry__ as contract
import pytest
from pyspark.sql import functions as F

from rankforge.operators.access_log import parse_access_log
from rankforge.plans.top_users import top_users
from rankforge.session import shared_dir
from rankforge.sources import read_lines, read_ratings


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plan):
    return len(re.findall(r"\bExchange hashpartitioning|\bExchange rangepartitioning", plan))


@pytest.fixture(scope="module")
def log(spark):
    path = shared_dir(spark, "log")
    spark.range(100).select(
        F.format_string("[13/Jul/2015:10] username='%08d'", "id").alias("value")
    ).write.text(path)
    return read_lines(spark, path)


def test_top_users_shuffles_counts_once_and_keeps_a_heap(log):
    plan = physical(top_users(log, "2015-07-12", "2015-07-22", 3))
    assert shuffles(plan) == 1
    assert "partial_count" in plan
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("on_bad_date", ["fail", "drop"])
def test_dates_are_parsed_once_and_tested_before_the_pattern(log, on_bad_date):
    plan = physical(parse_access_log(log, "2015-07-12", "2015-07-22", on_bad_date))
    steps = [
        "Generate explode(regexp_extract_all(",
        ">= 2015-07-12)",
        "Generate explode(array(",
        "StartsWith(",
        "FileScan",
    ]
    assert [plan.index(s) for s in steps] == sorted(plan.index(s) for s in steps)
    assert plan.count("regexp_extract_all(") == 1
    assert plan.count("gettimestamp(") == 1


def test_dates_are_not_parsed_without_a_bound(log):
    assert "gettimestamp" not in physical(top_users(log))


def test_ratings_scan_reads_the_columns_it_needs(spark, sf_dir):
    path = contract._ratings_file(spark, sf_dir)
    plan = physical(read_ratings(spark, path).select("movieId"))
    assert "ReadSchema: struct<movieId:int>" in plan
