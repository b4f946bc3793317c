"""Run a job from the command line, e.g. ``spark-submit --py-files ... job.py top-users``.

    python -m rankforge top-users --input-dir logs/ --output-dir out/ --date-from 2015-07-12
    python -m rankforge train --input-dir ml/ --model model/
    python -m rankforge recommend --input-dir ml/ --output-dir out/ --model model/ --user-id 7
    python -m rankforge train --input-dir ml/ --model model/ --with-titles
    python -m rankforge serve --output-dir out/ --model model/ --user-id 7

The rows written are printed, separated by tabs.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from rankforge.operators.ranking import DEFAULT_LIMIT
from rankforge.plans.recommend import (
    CANDIDATES,
    DEFAULT_BLOCKS,
    DEFAULT_USER,
    load_recommender,
    run_recommend,
    run_serve,
    train_recommender,
)
from rankforge.plans.top_users import run_top_users
from rankforge.session import build_session, owned_folders, stored
from rankforge.sources import read_items, read_ratings
from rankforge.sources.inputs import ITEMS_FILE, RATINGS_FILE


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rankforge", description="Run an analytics job.")
    jobs = top.add_subparsers(dest="job", required=True)

    users = jobs.add_parser("top-users", help="most active users of an access log")
    users.add_argument("--date-from", help="first day, yyyy-MM-dd")
    users.add_argument("--date-to", help="last day, yyyy-MM-dd")
    users.add_argument("--on-bad-date", choices=("fail", "drop"), default="fail")

    train = jobs.add_parser("train", help="train and store a recommender")
    train.add_argument("--model", required=True, help="where to store it")
    train.add_argument("--num-blocks", type=int, help="training tasks per side")

    items = jobs.add_parser("recommend", help="best items for a user")
    items.add_argument("--user-id", type=int, default=DEFAULT_USER)
    items.add_argument("--candidates", choices=CANDIDATES, default=CANDIDATES[0])
    items.add_argument("--model", help="a stored recommender; trained when not given")

    train.add_argument("--with-titles", action="store_true", help="store tables for serve")

    served = jobs.add_parser("serve", help="best items for a user, from stored tables alone")
    served.add_argument("--user-id", type=int, default=DEFAULT_USER)
    served.add_argument("--candidates", choices=CANDIDATES, default=CANDIDATES[0])
    served.add_argument("--model", required=True, help="a recommender trained with titles")

    for job in (users, train, items):
        job.add_argument("--input-dir", required=True)
    for job in (users, items, served):
        job.add_argument("--output-dir", required=True)
        job.add_argument("--run-id", help="keeps the output apart from other runs")
        job.add_argument("--limit", type=int, default=DEFAULT_LIMIT)
        job.add_argument("--format", choices=("parquet", "text"), default="parquet")
    return top


def run(spark: SparkSession, argv: Sequence[str] | None = None) -> DataFrame | None:
    """Run the job the arguments name; training gives no rows."""
    args = parser().parse_args(argv)
    if args.job == "train":
        folder = args.input_dir.rstrip("/")
        titles = read_items(spark, f"{folder}/{ITEMS_FILE}") if args.with_titles else None
        with owned_folders(spark):
            ratings = stored(read_ratings(spark, f"{folder}/{RATINGS_FILE}"), "ratings")
            train_recommender(ratings, args.model, args.num_blocks or DEFAULT_BLOCKS, items=titles)
        return None
    if args.job == "serve":
        return run_serve(
            spark,
            args.model,
            args.output_dir,
            args.run_id,
            args.user_id,
            args.limit,
            args.candidates,
            args.format,
        )
    if args.job == "top-users":
        return run_top_users(
            spark,
            args.input_dir,
            args.output_dir,
            args.run_id,
            args.limit,
            args.date_from,
            args.date_to,
            args.on_bad_date,
            args.format,
        )
    return run_recommend(
        spark,
        args.input_dir,
        args.output_dir,
        args.run_id,
        args.user_id,
        args.limit,
        args.candidates,
        load_recommender(spark, args.model) if args.model else None,
        args.format,
    )


def main() -> None:
    parser().parse_args()  # report wrong arguments before Spark starts
    spark = build_session()
    result = run(spark)
    if result is not None:
        for row in result.toLocalIterator():
            print(*row, sep="\t")
    spark.stop()


if __name__ == "__main__":
    main()
