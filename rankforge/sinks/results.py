"""Writers of counts and recommendations: typed Parquet, or lines of text.

A write replaces what its path held. A top-N result arrives in one partition
and leaves as one file in rank order; a full table keeps its partitions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RUN = "default"


def run_path(path: str, run_id: str | None = None) -> str:
    """Where a run writes: its own folder below the path.

    The folder is named like a partition, so reading ``path`` gives all runs
    with a ``run_id`` column. A run without an id has the folder of
    ``DEFAULT_RUN``: no run's folder lies inside another's.
    """
    if not path:
        raise ValueError("no output path given")
    run_id = DEFAULT_RUN if run_id is None else run_id
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run_id):
        raise ValueError(f"run id may hold letters, digits, '.', '_' and '-': {run_id!r}")
    return f"{path.rstrip('/')}/run_id={run_id}"


def write_counts(
    counts: DataFrame, path: str, run_id: str | None = None, fmt: str = "parquet"
) -> str:
    """Write ``username, n``; as text each row is ``(username,n)``."""
    line = F.format_string("(%s,%d)", "username", "n")
    return _write(counts.select("username", "n"), line, path, run_id, fmt)


def write_recommendations(
    rows: DataFrame, path: str, run_id: str | None = None, fmt: str = "parquet"
) -> str:
    """Write recommendations; text rows are ``(Rating(user,item,score),title)``.

    As text, a null id or score and a title with a line break raise: no row of
    theirs could be read back.
    """
    unfit = F.raise_error(F.lit("a recommendation does not fit one line of text")).cast("string")
    numbers = F.concat(
        F.col("userId").cast("string"), F.lit(","), F.col("movieId").cast("string"),
        F.lit(","), F.col("prediction").cast("string"),
    )
    title = F.coalesce("title", F.lit(""))
    line = F.when(
        numbers.isNotNull() & ~title.rlike(r"[\n\r]"),
        F.concat(F.lit("(Rating("), numbers, F.lit("),"), title, F.lit(")")),
    ).otherwise(unfit)
    typed = rows.select(
        F.col("userId").cast("int"),
        F.col("movieId").cast("int"),
        F.col("prediction").cast("double"),
        "title",
    )
    return _write(typed, line, path, run_id, fmt)


def _write(rows: DataFrame, line: Column, path: str, run_id: str | None, fmt: str) -> str:
    target = run_path(path, run_id)
    if fmt == "parquet":
        rows.write.mode("overwrite").parquet(target)
    elif fmt == "text":
        rows.select(line.alias("value")).write.mode("overwrite").text(target)
    else:
        raise ValueError(f"fmt must be parquet or text, not {fmt!r}")
    return target
