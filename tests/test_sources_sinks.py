import os
from datetime import date

import pytest
from conftest import rows
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from rankforge.operators.ranking import rank_counts, rank_recommendations
from rankforge.plans.top_users import run_top_users
from rankforge.session import shared_dir
from rankforge.sinks import run_path, write_counts, write_recommendations
from rankforge.sources import (
    read_counts,
    read_items,
    read_lines,
    read_ratings,
    read_recommendations,
)

COUNTS = [("aaaaaaaa", 7), ("bbbbbbbb", 7), ("cccccccc", 2)]
RECOMMENDATIONS = [
    (1, 5, 0.75, "Usual, The (1995)"),
    (1, 11, 1.0e-4, 'President, The "American" (1995)'),
    (1, 3, 1.0e-4, "(500) Days) of Summer"),
    (1, -4, -2.5e-12, ""),
    (1, 9, float("inf"), "),),"),
]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def counts_df(spark, data=COUNTS):
    return spark.createDataFrame(data, "username string, n bigint").coalesce(1)


def recommendations_df(spark, data=RECOMMENDATIONS):
    return spark.createDataFrame(
        data, "userId int, movieId int, prediction double, title string"
    ).coalesce(1)


# Sources

# Which of the two it is depends on whether the reader or a column fails.
READ_ERRORS = (PySparkException, Py4JJavaError)


def test_lines_of_file_directory_and_glob(spark, tmp_path):
    write(tmp_path / "access1.log", "a\nb\n")
    write(tmp_path / "access2.log", "c\r\nd")
    write(tmp_path / "other.txt", "e\n")
    assert rows(read_lines(spark, str(tmp_path / "access1.log"))) == [("a",), ("b",)]
    assert sorted(rows(read_lines(spark, str(tmp_path)))) == [(c,) for c in "abcde"]
    assert sorted(rows(read_lines(spark, f"{tmp_path}/access*.log"))) == [(c,) for c in "abcd"]


def test_ratings_schema_header_and_ignored_column(spark, tmp_path):
    path = write(tmp_path / "ratings.csv", "userId,movieId,rating,timestamp\n1,16,4.0,1217897793\n2,24,1.5,junk\n")
    ratings = read_ratings(spark, path)
    assert ratings.dtypes == [("userId", "int"), ("movieId", "int"), ("rating", "double")]
    assert rows(ratings) == [(1, 16, 4.0), (2, 24, 1.5)]


def test_ratings_of_three_columns(spark, tmp_path):
    path = write(tmp_path / "ratings.csv", "userId,movieId,rating\n1,16,4.0\n")
    assert rows(read_ratings(spark, path)) == [(1, 16, 4.0)]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("line", ["x,16,4.0,1", "1,1.5,4.0,1", "1,16,good,1", "1,,4.0,1", "1,16,,1", "1,16", "99999999999,1,4.0,1"])
def test_bad_number_fails(spark, tmp_path, line, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        path = write(tmp_path / "ratings.csv", f"userId,movieId,rating,timestamp\n1,2,3.0,4\n{line}\n")
        with pytest.raises(READ_ERRORS):
            read_ratings(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_header_of_every_file_in_a_directory(spark, tmp_path):
    folder = tmp_path / "ratings.csv"
    folder.mkdir()
    for i in (1, 2):
        write(folder / f"part-{i}.csv", f"userId,movieId,rating,timestamp\n{i},16,4.0,1\n")
    assert sorted(rows(read_ratings(spark, str(folder)))) == [(1, 16, 4.0), (2, 16, 4.0)]


def test_item_titles(spark, tmp_path):
    path = write(
        tmp_path / "movies.csv",
        "movieId,title,genres\n"
        "1,Toy Story (1995),Adventure|Animation\n"
        '11,"American President, The (1995)",Comedy|Drama\n'
        '12,"Dracula: Dead and ""Loving"" It, the",Comedy\n'
        "13,movieId of a title,Drama\n"
        "14,,Drama\n"
        "15,Misérables,Drama\n",
    )
    items = read_items(spark, path)
    assert items.dtypes == [("movieId", "int"), ("title", "string")]
    assert rows(items) == [
        (1, "Toy Story (1995)"),
        (11, "American President, The (1995)"),
        (12, 'Dracula: Dead and "Loving" It, the'),
        (13, "movieId of a title"),
        (14, ""),
        (15, "Misérables"),
    ]


def test_item_of_one_field_fails(spark, tmp_path):
    path = str(tmp_path / "one_field.csv")
    with open(path, "w") as f:
        f.write("movieId,title,genres\n4,\n7,t\n8,a,b,c\n")
    assert [tuple(r) for r in read_items(spark, path).collect()] == [(4, ""), (7, "t"), (8, "a")]
    with open(path, "a") as f:
        f.write("14\n")
    with pytest.raises(Exception, match="no title"):
        read_items(spark, path).collect()


def test_item_without_a_number_fails(spark, tmp_path):
    path = write(tmp_path / "movies.csv", "movieId,title,genres\nx,Toy Story,Drama\n")
    with pytest.raises(READ_ERRORS):
        read_items(spark, path).collect()


# Sinks and reading back


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_counts_round_trip(spark, fmt):
    path = write_counts(counts_df(spark), shared_dir(spark, "t"), fmt=fmt)
    back = read_counts(spark, path, fmt)
    assert back.dtypes == [("username", "string"), ("n", "bigint")]
    assert rows(rank_counts(back)) == COUNTS


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_recommendations_round_trip_keeps_every_score(spark, fmt):
    path = write_recommendations(recommendations_df(spark), shared_dir(spark, "t"), fmt=fmt)
    back = read_recommendations(spark, path, fmt)
    assert back.dtypes == [
        ("userId", "int"), ("movieId", "int"), ("prediction", "double"), ("title", "string")
    ]
    expected = sorted(RECOMMENDATIONS, key=lambda r: (-r[2], r[1]))
    assert rows(rank_recommendations(back)) == expected


def test_text_form(spark):
    path = write_counts(counts_df(spark), shared_dir(spark, "t"), fmt="text")
    assert rows(spark.read.text(path)) == [("(aaaaaaaa,7)",), ("(bbbbbbbb,7)",), ("(cccccccc,2)",)]
    path = write_recommendations(recommendations_df(spark, [(1, 2, 0.5, "A, b")]), shared_dir(spark, "t"), fmt="text")
    assert rows(spark.read.text(path)) == [("(Rating(1,2,0.5),A, b)",)]


def test_lines_that_are_no_result_are_skipped(spark, tmp_path):
    write(tmp_path / "part-0", "(aaaaaaaa,7)\n\nnothing\n")
    write(tmp_path / "other", "(zzzzzzzz,9)\n")
    assert rows(read_counts(spark, str(tmp_path), "text")) == [("aaaaaaaa", 7)]
    folder = tmp_path / "r"
    folder.mkdir()
    write(folder / "part-0", "(Rating(1,2,0.5),A)\n(Rating(1,2),A)\n")
    assert rows(read_recommendations(spark, str(folder), "text")) == [(1, 2, 0.5, "A")]


def test_null_title_survives_the_text_form(spark):
    df = recommendations_df(spark, [(1, 2, 0.5, None)])
    path = write_recommendations(df, shared_dir(spark, "t"), fmt="text")
    assert rows(read_recommendations(spark, path, "text")) == [(1, 2, 0.5, "")]


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_a_write_replaces_the_path(spark, fmt):
    path = shared_dir(spark, "t")
    write_counts(counts_df(spark), path, fmt=fmt)
    written = write_counts(counts_df(spark, [("dddddddd", 1)]), path, fmt=fmt)
    assert rows(read_counts(spark, written, fmt)) == [("dddddddd", 1)]
    write_counts(counts_df(spark).limit(0), path, fmt=fmt)
    assert rows(read_counts(spark, path, fmt)) == []


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_runs_are_kept_apart(spark, fmt):
    path = shared_dir(spark, "t")
    write_counts(counts_df(spark), path, "7", fmt)
    other = write_counts(counts_df(spark, [("dddddddd", 1)]), path, "0008", fmt)
    assert rows(read_counts(spark, other, fmt)) == [("dddddddd", 1)]
    both = read_counts(spark, path, fmt, all_runs=True)
    assert both.dtypes[-1] == ("run_id", "string")
    assert sorted(rows(both)) == sorted([(*c, "7") for c in COUNTS] + [("dddddddd", 1, "0008")])
    write_counts(counts_df(spark).limit(0), path, "7", fmt)
    assert rows(read_counts(spark, path, fmt, all_runs=True)) == [("dddddddd", 1, "0008")]


def test_run_path():
    assert run_path("/out") == "/out/run_id=default"
    assert run_path("/out/", "a.b-c_1") == "/out/run_id=a.b-c_1"
    for bad in ("", "a/b", "..=/"):
        with pytest.raises(ValueError):
            run_path("/out", bad)
    for missing in ("", None):
        with pytest.raises(ValueError):
            run_path(missing)


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        write_counts(counts_df(spark), shared_dir(spark, "t"), fmt="orc")
    with pytest.raises(ValueError):
        read_counts(spark, "/nowhere", "orc")


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_top_users_job(spark, tmp_path, fmt):
    """Logs in, ranked result out, in one ordered file."""
    log = [(12, "edgefrom"), (22, "edgeto00"), (11, "tooearly"), (23, "toolate0")]
    log += [(15, "mostbusy")] * 3 + [(16, "second00")] * 2
    for i in range(2):
        half = [f"[{d:02d}/Jul/2015:10:00:00] username='{u}'\n" for d, u in log[i::2]]
        write(tmp_path / f"access{i}.log", "".join(half))
    output = shared_dir(spark, "t")
    result = run_top_users(
        spark, f"{tmp_path}/access*.log", output, "run-1", 3, "2015-07-12", "2015-07-22", fmt=fmt
    )
    expected = [("mostbusy", 3), ("second00", 2), ("edgefrom", 1)]
    assert rows(result) == expected
    parts = [f for f in os.listdir(f"{output}/run_id=run-1") if f.startswith("part")]
    assert len(parts) == 1
    assert rows(read_counts(spark, f"{output}/run_id=run-1", fmt)) == expected


def test_typed_bounds_in_the_job(spark, tmp_path):
    write(tmp_path / "access.log", "[13/Jul/2015:10:00:00] username='aaaaaaaa'\n")
    result = run_top_users(
        spark, str(tmp_path / "access.log"), shared_dir(spark, "t"), date_to=date(2015, 7, 12)
    )
    assert rows(result) == []


def test_a_run_without_an_id_leaves_the_others(spark):
    path = shared_dir(spark, "t")
    write_counts(counts_df(spark), path, "r1")
    write_counts(counts_df(spark, [("dddddddd", 1)]), path)
    assert {r[2] for r in rows(read_counts(spark, path, all_runs=True))} == {"r1", "default"}


@pytest.mark.parametrize("values", ["1, 2, 0.5, 'a\\nb'", "null, 2, 0.5, 'a'", "1, 2, null, 'a'"])
def test_text_rows_that_cannot_be_read_back_raise(spark, values):
    df = spark.sql(f"SELECT * FROM VALUES ({values}) AS t(userId, movieId, prediction, title)")
    with pytest.raises(Exception, match="one line of text"):
        write_recommendations(df, shared_dir(spark, "t"), fmt="text")
