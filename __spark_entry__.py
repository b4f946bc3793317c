"""

Each query derives its input from the given tables (``rankforge.fixtures``) and
runs the library's operators over all of it. The oracles read the tables
directly, so they share no parser, reader or model with the queries.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankforge import fixtures as fx  # noqa: E402
from rankforge.operators.access_log import (  # noqa: E402
    active_user_total,
    count_by_user,
    parse_access_log,
)
from rankforge.operators.candidates import (  # noqa: E402
    distinct_candidates,
    rated_by_others,
    rating_witnesses,
    unseen,
)
from rankforge.operators.certificate import certify_top  # noqa: E402
from rankforge.operators.half_step import agreement, reference_training  # noqa: E402
from rankforge.operators.histories import store_histories  # noqa: E402
from rankforge.operators.norm_bounds import item_blocks, top_items  # noqa: E402
from rankforge.operators.objective import implicit_objective  # noqa: E402
from rankforge.operators.optimality import user_optimality  # noqa: E402
from rankforge.operators.rating_blocks import deal  # noqa: E402
from rankforge.operators.ranking import (  # noqa: E402
    DEFAULT_LIMIT,
    number_rows,
    top_recommendations,
)
from rankforge.operators.scoring import (  # noqa: E402
    join_items,
    score_pairs,
    score_titled_pairs,
    score_user,
)
from rankforge.operators.serving import serve_user, serving_table  # noqa: E402
from rankforge.plans.recommend import (  # noqa: E402
    ALPHA,
    ITERATIONS,
    LAMBDA,
    RANK,
    Recommender,
    fit_model,
    load_recommender,
    publish_recommender,
    recommend,
    run_recommend,
    score_candidates,
    train_recommender,
)
from rankforge.plans.top_users import run_top_users, top_users  # noqa: E402
from rankforge.session import shared_dir, stored  # noqa: E402
from rankforge.sinks import write_counts, write_recommendations  # noqa: E402
from rankforge.sources import (  # noqa: E402
    read_counts,
    read_items,
    read_lines,
    read_ratings,
    read_recommendations,
)

try:
    import corpus_pipeline
    import rankforge.llm.queries as llm
except ModuleNotFoundError as missing:
    # Both parts can be left out; anything else that is missing is an error.
    if not (missing.name or "").startswith(("corpus_pipeline", "rankforge.llm")):
        raise
    llm = corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"
DATE_FROM, DATE_TO = "2024-01-10", "2024-01-20"
USER = 12  # rates items, and has a fixed factor vector
OTHER_USER = 7  # rates items too
UNKNOWN_USER = -1  # rates nothing
LIMIT = 5
EMBEDDING_SIZE = 64
LATE_DATE = "31/Feb/2024"  # read as the 29th
RUN_A, RUN_B = "0007", "run-b"
MANY = 100  # ranked in ranges
# What two trainings may differ by: vectors by their length, objectives by their value.
FACTOR_GAP, OBJECTIVE_GAP = 1e-4, 1e-6


def entry(spark: SparkSession) -> DataFrame:
    """Most active users between two dates."""
    return _top_users(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = core_queries()
    if llm:
        found |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return found


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "access_log_scan": _access_log_scan,
        "access_log_lines": lambda s, d: read_lines(s, _log_dir(s, d)),
        "access_log_parse": _entries,
        "access_log_date_from": lambda s, d: _entries(s, d, date_from=DATE_FROM),
        "access_log_date_to": lambda s, d: _entries(s, d, date_to=DATE_TO),
        "access_log_date_between": lambda s, d: _entries(s, d, DATE_FROM, DATE_TO),
        "access_log_bad_dates_unbounded": lambda s, d: count_by_user(
            parse_access_log(_lines(s, d, bad_dates=True))
        ),
        "access_log_bad_dates_dropped": lambda s, d: parse_access_log(
            _lines(s, d, bad_dates=True), DATE_FROM, DATE_TO, on_bad_date="drop"
        ),
        "access_log_clamped_dates": lambda s, d: parse_access_log(
            _lines(s, d, bad_dates=True, bad_date=LATE_DATE), DATE_FROM, on_bad_date="clamp"
        ),
        "user_activity_counts": lambda s, d: count_by_user(_entries(s, d)),
        "active_user_total": lambda s, d: active_user_total(_entries(s, d)),
        "top_users": _top_users,
        "top_users_default_limit": lambda s, d: top_users(_lines(s, d)),
        "top_users_job": _top_users_job,
        "ratings_scan": lambda s, d: read_ratings(s, _ratings_file(s, d)),
        "items_scan": lambda s, d: read_items(s, _items_file(s, d)),
        "candidates_rated_by_others": lambda s, d: rated_by_others(_ratings(s, d), USER),
        "candidates_from_witnesses": lambda s, d: rated_by_others(
            rating_witnesses(_ratings(s, d)), USER
        ),
        "candidates_single_rater": lambda s, d: rated_by_others(_single_raters(s, d), USER),
        "candidates_single_rater_witnesses": lambda s, d: rated_by_others(
            rating_witnesses(_single_raters(s, d)), USER
        ),
        "candidates_unseen": lambda s, d: unseen(_items(s, d), _ratings(s, d), USER),
        "distinct_candidates": _distinct_candidates,
        "score_pairs": _score_pairs,
        "score_pairs_rank10": _score_pairs_rank10,
        "recommend_join_items": _recommend_join_items,
        "recommend_top_n": _recommend_top_n,
        "recommend_fixed_model": lambda s, d: _recommend_fixed_model(s, d, "rated_by_others"),
        "recommend_fixed_model_unseen": lambda s, d: _recommend_fixed_model(s, d, "unseen"),
        "serve_fixed_model": lambda s, d: _serve_fixed_model(s, d, unseen=False),
        "serve_fixed_model_unseen": lambda s, d: _serve_fixed_model(s, d, unseen=True),
        "user_history": lambda s, d: _histories(s, d).of(USER),
        "top_n_all_users": _top_n_all_users,
        "ranked_counts_in_ranges": _ranked_counts_in_ranges,
        "objective_fixed_factors": _objective_fixed_factors,
        "readback_ranked_counts": lambda s, d: _readback_ranked_counts(s, d, "parquet"),
        "readback_ranked_counts_text": lambda s, d: _readback_ranked_counts(s, d, "text"),
        "readback_recommendations": lambda s, d: _readback_recommendations(s, d, "parquet"),
        "readback_recommendations_text": lambda s, d: _readback_recommendations(s, d, "text"),
        "sink_overwrite": _sink_overwrite,
        "sink_run_isolation": _sink_run_isolation,
        "als_factor_coverage": _als_factor_coverage,
        "als_scored_items": _als_scored_items,
        "als_recommend": lambda s, d: _certified(_als_recommend(s, d)),
        "als_recommend_unseen": lambda s, d: _certified(_als_recommend_unseen(s, d)),
        "als_user_optimality": _als_user_optimality,
        "als_training_certificate": _als_training_certificate,
        "als_model_reuse": lambda s, d: _certified(_als_model_reuse(s, d)),
        "als_model_reuse_scores": _als_model_reuse_scores,
        "als_serve_scores": _als_serve_scores,
        "recommend_job": lambda s, d: _certified(_recommend_job(s, d)),
    }


# Inputs


def _lines(
    spark: SparkSession, sf_dir: str, bad_dates: bool = False, bad_date: str = fx.BAD_DATE
) -> DataFrame:
    return fx.render_access_log(fx.table(spark, sf_dir, "events"), bad_dates, bad_date)


def _entries(
    spark: SparkSession, sf_dir: str, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    return parse_access_log(_lines(spark, sf_dir), date_from, date_to)


def _log_dir(spark: SparkSession, sf_dir: str) -> str:
    path = shared_dir(spark, "access-log")
    _lines(spark, sf_dir).write.text(path)
    return path


def _ratings(spark: SparkSession, sf_dir: str, by_item: bool = False) -> DataFrame:
    return fx.derive_ratings(
        fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "lineitem"), by_item
    )


def _ratings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Training and candidates both read the ratings, and a lost executor makes
    # training read them again, so the join behind them runs once. In order of
    # the items they take less room, here and in the shuffles that follow.
    path = shared_dir(spark, "ratings")
    _ratings(spark, sf_dir, by_item=True).sortWithinPartitions("movieId", "userId").write.parquet(path)
    return spark.read.parquet(path)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.derive_items(fx.table(spark, sf_dir, "part"))


def _ratings_file(spark: SparkSession, sf_dir: str, folder: str | None = None) -> str:
    folder = folder or shared_dir(spark, "ratings")
    return fx.write_ratings_csv(_ratings(spark, sf_dir), f"{folder}/ratings.csv")


def _items_file(spark: SparkSession, sf_dir: str, folder: str | None = None) -> str:
    folder = folder or shared_dir(spark, "items")
    return fx.write_items_csv(_items(spark, sf_dir), f"{folder}/movies.csv")


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fixed_factors(fx.table(spark, sf_dir, "embeddings"))


# Access log


def _access_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lines(spark, _log_dir(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


def _top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_users(_lines(spark, sf_dir), DATE_FROM, DATE_TO, LIMIT)


def _top_users_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_top_users(
        spark,
        _log_dir(spark, sf_dir),
        shared_dir(spark, "top-users"),
        run_id=RUN_A,
        limit=LIMIT,
        date_from=DATE_FROM,
        date_to=DATE_TO,
    )


# Candidates and scores


def _single_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every item has one rater here, so the items of a user alone do matter.
    return fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("int").alias("userId"),
        F.col("o_orderkey").cast("int").alias("movieId"),
    )


def _score_pairs_rank10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = distinct_candidates(fx.factor_pairs(fx.table(spark, sf_dir, "lineitem")))
    factors = _factors(spark, sf_dir).select("id", F.slice("features", 1, 10).alias("features"))
    return _rounded(score_pairs(pairs, factors, factors, 10))


def _distinct_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders")
    lineitem = fx.table(spark, sf_dir, "lineitem")
    return distinct_candidates(
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").cast("int").alias("userId"),
            F.col("l_partkey").cast("int").alias("movieId"),
        )
    )


def _recommend_join_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = distinct_candidates(fx.factor_pairs(fx.table(spark, sf_dir, "lineitem")))
    factors = _factors(spark, sf_dir)
    scored = score_titled_pairs(pairs, factors, factors, _items(spark, sf_dir))
    return scored.select("userId", "movieId", F.round("prediction", 6).alias("score"), "title")


def _score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = distinct_candidates(fx.factor_pairs(fx.table(spark, sf_dir, "lineitem")))
    factors = _factors(spark, sf_dir)
    return _rounded(score_pairs(pairs, factors, factors))


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.select("userId", "movieId", F.round("prediction", 6).alias("score"))


def _recommend_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = _factors(spark, sf_dir)
    pairs = factors.select(F.lit(USER).cast("int").alias("userId"), F.col("id").alias("movieId"))
    scored = _rounded(score_user(pairs, factors, factors, USER))
    titled = join_items(scored, _items(spark, sf_dir))
    return top_recommendations(titled, score="score")


def _recommend_fixed_model(spark: SparkSession, sf_dir: str, candidates: str) -> DataFrame:
    # The whole recommendation, with factors that SQL knows as well.
    factors = _factors(spark, sf_dir)
    model = SimpleNamespace(userFactors=factors, itemFactors=factors, rank=EMBEDDING_SIZE)
    result = recommend(
        model, _ratings(spark, sf_dir), _items(spark, sf_dir), USER, candidates=candidates
    )
    return result.withColumn("prediction", F.round("prediction", 6))


def _histories(spark: SparkSession, sf_dir: str):
    # Small files, so that the tables have many of them.
    return store_histories(_ratings_table(spark, sf_dir), shared_dir(spark, "histories"), 5_000)


def _serve_fixed_model(spark: SparkSession, sf_dir: str, unseen: bool) -> DataFrame:
    factors = _factors(spark, sf_dir)
    table = stored(
        serving_table(_ratings(spark, sf_dir), _items(spark, sf_dir), factors), "serving"
    )
    histories = _histories(spark, sf_dir) if unseen else None
    result = top_recommendations(serve_user(table, factors, USER, EMBEDDING_SIZE, histories))
    return result.withColumn("prediction", F.round("prediction", 6))


def _rank10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factors(spark, sf_dir).select("id", F.slice("features", 1, RANK).alias("features"))


def _top_n_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = _rank10(spark, sf_dir)
    best = top_items(factors, item_blocks(factors, RANK, block_items=32), RANK, LIMIT)
    return best.select("userId", "movieId", F.round("prediction", 6).alias("score"))


def _objective_fixed_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    factors = _rank10(spark, sf_dir)
    found = implicit_objective(_ratings_table(spark, sf_dir), factors, factors, RANK, LAMBDA, ALPHA)
    return found.select(*(F.round(c, 4).alias(c) for c in found.columns))


def _ranked_counts_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_by_user(_entries(spark, sf_dir))
    return number_rows(counts, [F.desc("n"), F.asc("username")], MANY, per_range=30)


# Sinks


def _readback_ranked_counts(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    path = write_counts(_top_users(spark, sf_dir), shared_dir(spark, "counts"), fmt=fmt)
    return read_counts(spark, path, fmt)


def _readback_recommendations(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    result = _recommend_top_n(spark, sf_dir).withColumnRenamed("score", "prediction")
    path = write_recommendations(result, shared_dir(spark, "recommendations"), fmt=fmt)
    return read_recommendations(spark, path, fmt).withColumnRenamed("prediction", "score")


def _sink_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "counts")
    write_counts(_top_users(spark, sf_dir), path)
    return read_counts(spark, write_counts(count_by_user(_entries(spark, sf_dir)), path))


def _sink_run_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "counts")
    write_counts(_top_users(spark, sf_dir), path, RUN_A)
    write_counts(count_by_user(_entries(spark, sf_dir)), path, RUN_B)
    write_counts(_top_users(spark, sf_dir), path)  # without an id, it leaves the others alone
    return read_counts(spark, path, all_runs=True)


# Trained model


def _als_factor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train_recommender(_ratings_table(spark, sf_dir)).model

    def factors(kind: str, table: DataFrame) -> DataFrame:
        return table.select(
            F.lit(kind).alias("kind"), "id", F.size("features").alias("n_features")
        )

    return factors("user", model.userFactors).unionAll(factors("item", model.itemFactors))


def _als_scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    trained = train_recommender(_ratings_table(spark, sf_dir))
    items = _items(spark, sf_dir)
    return score_candidates(trained.model, trained.raters, items, USER).select(
        "userId", "movieId", "title", F.col("prediction").isNotNull().alias("scored")
    )


@dataclass(frozen=True)
class Recommended:
    """A result and all that it was picked from, for each user asked for."""

    by_user: list[tuple[DataFrame, DataFrame]]  # candidates with scores, result
    limit: int

    @property
    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionAll, [result for _, result in self.by_user])


def _certified(found: Recommended) -> DataFrame:
    """All candidates, and whether the result is right about each."""
    return reduce(
        DataFrame.unionAll,
        [
            certify_top(scored, result, found.limit).select("userId", "movieId", "title", "certified")
            for scored, result in found.by_user
        ],
    )


def _recommended(
    trained: Recommender,
    ratings: DataFrame,
    items: DataFrame,
    users: tuple[int, ...] = (USER,),
    candidates: str = "rated_by_others",
) -> Recommended:
    arguments = (ratings, items)
    return Recommended(
        [
            (
                score_candidates(trained.model, *arguments, user, candidates),
                recommend(trained.model, *arguments, user, candidates=candidates),
            )
            for user in users
        ],
        DEFAULT_LIMIT,
    )


def _als_recommend(spark: SparkSession, sf_dir: str) -> Recommended:
    ratings = _ratings_table(spark, sf_dir)
    return _recommended(train_recommender(ratings), ratings, _items(spark, sf_dir))


def _als_recommend_unseen(spark: SparkSession, sf_dir: str) -> Recommended:
    ratings = _ratings_table(spark, sf_dir)
    items = _items(spark, sf_dir)
    return _recommended(train_recommender(ratings), ratings, items, candidates="unseen")


def _als_model_reuse(spark: SparkSession, sf_dir: str) -> Recommended:
    path = shared_dir(spark, "recommender")
    train_recommender(_ratings_table(spark, sf_dir), path)
    again = load_recommender(spark, path)
    users = (USER, OTHER_USER, UNKNOWN_USER)
    return _recommended(again, again.raters, _items(spark, sf_dir), users)


def _als_user_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = _ratings_table(spark, sf_dir)
    model = train_recommender(ratings).model
    return user_optimality(ratings, model.userFactors, model.itemFactors, RANK, LAMBDA, ALPHA)


def _als_training_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the model equal a second training of as many iterations from the same start?

    And does the objective of that one fall with each iteration, to the model's.
    """
    ratings = _ratings_table(spark, sf_dir)
    model = train_recommender(ratings).model
    parameters = (RANK, LAMBDA, ALPHA)
    blocks = tuple(deal(ratings, side).stored() for side in ("userId", "movieId"))
    # Vectors go where the ratings are: the way with fewer of them.
    fewer = min(blocks, key=lambda dealt: dealt.sent)

    def objective(users: DataFrame, items: DataFrame) -> float:
        return implicit_objective(fewer, users, items, *parameters).first()["objective"]

    # The start hangs on the ids alone: a rating of each gives the same.
    start = fit_model(reduce(DataFrame.unionAll, (dealt.one_of_each() for dealt in blocks)), iterations=0)
    values = [objective(start.userFactors, start.itemFactors)]
    for users, items in reference_training(blocks, start.userFactors, RANK, ITERATIONS, LAMBDA, ALPHA):
        values.append(objective(users, items))
    reached = objective(model.userFactors, model.itemFactors)
    falls = [(i + 1, b < a) for i, (a, b) in enumerate(pairwise(values))]
    falls.append((0, abs(reached - values[-1]) <= OBJECTIVE_GAP * values[-1]))
    by_kind = [
        spark.createDataFrame(falls, "id int, agrees boolean").select(F.lit("objective").alias("kind"), "*"),
        agreement(model.userFactors, users, FACTOR_GAP).select(F.lit("user").alias("kind"), "*"),
        agreement(model.itemFactors, items, FACTOR_GAP).select(F.lit("item").alias("kind"), "*"),
    ]
    return stored(reduce(DataFrame.unionAll, by_kind), "certificate")


def _compared(
    one: DataFrame, two: DataFrame, key: tuple[str, ...] = ("userId", "movieId", "title")
) -> DataFrame:
    """Candidates of either side, and whether both have them with the same score."""
    one = one.withColumnRenamed("prediction", "one")
    two = two.withColumnRenamed("prediction", "two")
    same = F.coalesce(F.col("one") == F.col("two"), F.lit(False))
    return one.join(two, list(key), "full").select(*key, same.alias("same_score"))


def _als_model_reuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by the factors that training left with the executors, and by the stored ones."""
    path = shared_dir(spark, "recommender")
    ratings = _ratings_table(spark, sf_dir)
    fitted = fit_model(ratings)
    publish_recommender(fitted, ratings, path)
    again = load_recommender(spark, path)
    items = _items(spark, sf_dir)
    users = (USER, OTHER_USER, UNKNOWN_USER)
    return reduce(
        DataFrame.unionAll,
        [
            _compared(
                score_candidates(fitted, ratings, items, user),
                score_candidates(again.model, again.raters, items, user),
            )
            for user in users
        ],
    )


def _als_serve_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and scores from the serving tables, and from ratings, items and model."""
    ratings, items = _ratings_table(spark, sf_dir), _items(spark, sf_dir)
    trained = train_recommender(ratings, items=items)
    model = trained.model
    return reduce(
        DataFrame.unionAll,
        [
            _compared(
                serve_user(trained.serving, model.userFactors, USER, RANK, histories),
                score_candidates(model, ratings, items, USER, candidates),
            ).select(F.lit(candidates).alias("candidates"), "*")
            for candidates, histories in (("rated_by_others", None), ("unseen", trained.histories))
        ],
    )


def _recommend_job(spark: SparkSession, sf_dir: str) -> Recommended:
    folder = shared_dir(spark, "recommend-job")
    ratings = read_ratings(spark, _ratings_file(spark, sf_dir, f"{folder}/input"))
    items = read_items(spark, _items_file(spark, sf_dir, f"{folder}/input"))
    trained = train_recommender(stored(ratings, "ratings"))
    result = run_recommend(
        spark,
        f"{folder}/input",
        f"{folder}/output",
        run_id=RUN_A,
        user_id=USER,
        limit=LIMIT,
        recommender=trained,
    )
    scored = score_candidates(trained.model, trained.raters, items, USER)
    return Recommended([(scored, result)], LIMIT)


# Oracles

_UNAME = "lpad(CAST(user_id AS VARCHAR), 8, '0')"
_VALID = "event_type IN ('click', 'purchase', 'view')"
_DATE = "CAST(ts AS DATE)"
_BETWEEN = f"{_DATE} BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}'"
_PARSED = f"SELECT {_UNAME} AS username, {_DATE} AS log_date FROM events WHERE {_VALID}"
_COUNTS = f"SELECT {_UNAME} AS username, count(*) AS n FROM events WHERE {_VALID}"
_TOP = f"{_COUNTS} AND {_BETWEEN} GROUP BY 1 ORDER BY n DESC, username LIMIT {LIMIT}"

_RATINGS = """
    SELECT CAST(o_custkey AS INTEGER) AS userId, CAST(l_partkey AS INTEGER) AS movieId,
           max(ceil(l_quantity / 5) / 2) AS rating
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2
"""
_ITEMS = """
    SELECT CAST(p_partkey AS INTEGER) AS movieId, p_name || ', ' || p_brand AS title FROM part
"""
_FACTORS = """
    f AS (SELECT CAST(vec_id AS INTEGER) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    users AS (SELECT id AS userId, v AS u FROM f),
    rated AS (SELECT id AS movieId, v AS i FROM f)
"""
_SCORED_PAIRS = f"""
    WITH {_FACTORS},
    pairs AS (SELECT DISTINCT CAST(l_suppkey AS INTEGER) AS userId,
                     CAST(l_partkey AS INTEGER) AS movieId FROM lineitem),
    scored AS (SELECT userId, movieId, round(list_dot_product(u, i), 6) AS score
               FROM pairs JOIN users USING (userId) JOIN rated USING (movieId))
"""
_TOP_RECOMMENDATIONS = f"""
    WITH {_FACTORS}, items AS ({_ITEMS}),
    scored AS (SELECT userId, movieId, round(list_dot_product(u, i), 6) AS score
               FROM users JOIN rated ON userId = {USER})
    SELECT userId, movieId, score, title FROM scored JOIN items USING (movieId)
    ORDER BY score DESC, movieId, title LIMIT 10
"""
_RATED_BY_OTHERS = f"""
    SELECT DISTINCT CAST({USER} AS INTEGER) AS userId, CAST(l_partkey AS INTEGER) AS movieId
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey <> {USER}
"""
_SINGLE_RATERS = f"""
    SELECT DISTINCT CAST({USER} AS INTEGER) AS userId, CAST(o_orderkey AS INTEGER) AS movieId
    FROM orders WHERE o_custkey <> {USER}
"""
_OTHERS_OF_OTHER_USER = _RATED_BY_OTHERS.replace(f"CAST({USER} AS", f"CAST({OTHER_USER} AS").replace(
    f"<> {USER}", f"<> {OTHER_USER}"
)
_UNSEEN = f"""
    SELECT CAST({USER} AS INTEGER) AS userId, CAST(p_partkey AS INTEGER) AS movieId
    FROM part WHERE p_partkey NOT IN (
        SELECT l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        WHERE o_custkey = {USER})
"""


_KNOWN_ITEMS = "SELECT l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
# Only rated items have factors, and so scores.
_UNSEEN_SCORED = f"{_UNSEEN} AND p_partkey IN ({_KNOWN_ITEMS})"


def _all_candidates(candidates: str, *columns: str) -> str:
    listed = ", ".join(["userId", "movieId", "title", *columns])
    return f"SELECT {listed} FROM ({candidates}) JOIN ({_ITEMS}) USING (movieId)"


def _fixed_model_oracle(candidates: str) -> str:
    return f"""
        WITH {_FACTORS}, items AS ({_ITEMS}), candidates AS ({candidates}),
        scored AS (SELECT userId, movieId, title, list_dot_product(u, i) AS exact
                   FROM candidates JOIN users USING (userId) JOIN rated USING (movieId)
                   JOIN items USING (movieId))
        SELECT userId, movieId, round(exact, 6) AS prediction, title FROM scored
        ORDER BY exact DESC, movieId, title LIMIT 10
    """


def oracle_sql() -> dict[str, str]:
    return core_oracle_sql() | (llm.oracle_sql() if llm else {})


def core_oracle_sql() -> dict[str, str]:
    return {
        "access_log_scan": "SELECT count(*) AS n FROM events",
        "access_log_lines": f"""
            SELECT strftime(ts, '[%d/%b/%Y:%H:%M:%S] ') || event_type || CASE event_type
                WHEN 'view' THEN ' username=''decoy000'' username=''' || {_UNAME} || ''''
                WHEN 'signup' THEN ' username=''' || lpad(CAST(user_id AS VARCHAR), 9, '0') || ''''
                WHEN 'error' THEN '' ELSE ' username=''' || {_UNAME} || '''' END AS value
            FROM events
        """,
        "access_log_parse": _PARSED,
        "access_log_date_from": f"{_PARSED} AND {_DATE} >= DATE '{DATE_FROM}'",
        "access_log_date_to": f"{_PARSED} AND {_DATE} <= DATE '{DATE_TO}'",
        "access_log_date_between": f"{_PARSED} AND {_BETWEEN}",
        "access_log_bad_dates_unbounded": f"""
            SELECT {_UNAME} AS username, count(*) AS n FROM events
            WHERE event_type <> 'signup' GROUP BY 1
        """,
        "access_log_bad_dates_dropped": f"{_PARSED} AND {_BETWEEN}",
        "access_log_clamped_dates": f"""
            {_PARSED} AND {_DATE} >= DATE '{DATE_FROM}' UNION ALL
            SELECT {_UNAME}, DATE '2024-02-29' FROM events WHERE event_type = 'error'
        """,
        "user_activity_counts": f"{_COUNTS} GROUP BY 1",
        "active_user_total": f"""
            SELECT count(DISTINCT {_UNAME}) AS n_users FROM events WHERE {_VALID}
        """,
        "top_users": _TOP,
        "top_users_default_limit": f"{_COUNTS} GROUP BY 1 ORDER BY n DESC, username LIMIT 10",
        "top_users_job": _TOP,
        "ratings_scan": _RATINGS,
        "items_scan": _ITEMS,
        "candidates_rated_by_others": _RATED_BY_OTHERS,
        "candidates_from_witnesses": _RATED_BY_OTHERS,
        "candidates_single_rater": _SINGLE_RATERS,
        "candidates_single_rater_witnesses": _SINGLE_RATERS,
        "candidates_unseen": _UNSEEN,
        "distinct_candidates": """
            SELECT DISTINCT CAST(o_custkey AS INTEGER) AS userId,
                   CAST(l_partkey AS INTEGER) AS movieId
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        """,
        "score_pairs": f"{_SCORED_PAIRS} SELECT userId, movieId, score FROM scored",
        "score_pairs_rank10": _SCORED_PAIRS.replace(
            "list_dot_product(u, i)", "list_dot_product(u[1:10], i[1:10])"
        ) + " SELECT userId, movieId, score FROM scored",
        "recommend_join_items": f"""
            {_SCORED_PAIRS}, items AS ({_ITEMS})
            SELECT userId, movieId, score, title FROM scored JOIN items USING (movieId)
        """,
        "recommend_top_n": _TOP_RECOMMENDATIONS,
        "recommend_fixed_model": _fixed_model_oracle(_RATED_BY_OTHERS),
        "recommend_fixed_model_unseen": _fixed_model_oracle(_UNSEEN),
        "readback_ranked_counts": _TOP,
        "readback_ranked_counts_text": _TOP,
        "readback_recommendations": _TOP_RECOMMENDATIONS,
        "readback_recommendations_text": _TOP_RECOMMENDATIONS,
        "sink_overwrite": f"{_COUNTS} GROUP BY 1",
        "sink_run_isolation": f"""
            SELECT username, n, '{RUN_A}' AS run_id FROM ({_TOP})
            UNION ALL
            SELECT username, n, '{RUN_B}' AS run_id FROM ({_COUNTS} GROUP BY 1)
            UNION ALL
            SELECT username, n, 'default' AS run_id FROM ({_TOP})
        """,
        "als_factor_coverage": """
            SELECT DISTINCT 'user' AS kind, CAST(o_custkey AS INTEGER) AS id, 10 AS n_features
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey
            UNION ALL
            SELECT DISTINCT 'item' AS kind, CAST(l_partkey AS INTEGER) AS id, 10 AS n_features
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        """,
        "als_recommend": _all_candidates(_RATED_BY_OTHERS, "TRUE AS certified"),
        "als_recommend_unseen": _all_candidates(_UNSEEN_SCORED, "TRUE AS certified"),
        "als_model_reuse": _all_candidates(
            f"{_RATED_BY_OTHERS} UNION ALL {_OTHERS_OF_OTHER_USER}", "TRUE AS certified"
        ),
        "recommend_job": _all_candidates(_RATED_BY_OTHERS, "TRUE AS certified"),
        "als_serve_scores": " UNION ALL ".join(
            _all_candidates(candidates, "TRUE AS same_score", f"'{name}' AS candidates")
            for name, candidates in (("rated_by_others", _RATED_BY_OTHERS), ("unseen", _UNSEEN_SCORED))
        ),
        "als_training_certificate": f"""
            SELECT DISTINCT 'user' AS kind, CAST(o_custkey AS INTEGER) AS id, TRUE AS agrees
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey
            UNION ALL
            SELECT DISTINCT 'item', CAST(l_partkey AS INTEGER), TRUE
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey
            UNION ALL
            SELECT 'objective', CAST(unnest(range({ITERATIONS} + 1)) AS INTEGER), TRUE
        """,
        "serve_fixed_model": _fixed_model_oracle(_RATED_BY_OTHERS),
        "serve_fixed_model_unseen": _fixed_model_oracle(_UNSEEN_SCORED),
        "user_history": f"""
            SELECT DISTINCT CAST(l_partkey AS INTEGER) AS movieId
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = {USER}
        """,
        "top_n_all_users": f"""
            WITH {_FACTORS},
            scored AS (SELECT userId, movieId, list_dot_product(u[1:10], i[1:10]) AS exact
                       FROM users, rated),
            placed AS (SELECT *, row_number() OVER (
                           PARTITION BY userId ORDER BY exact DESC, movieId) AS place FROM scored)
            SELECT userId, movieId, round(exact, 6) AS score FROM placed WHERE place <= {LIMIT}
        """,
        "ranked_counts_in_ranges": f"""
            SELECT username, n, row_number() OVER (ORDER BY n DESC, username) AS rank
            FROM ({_COUNTS} GROUP BY 1) ORDER BY rank LIMIT {MANY}
        """,
        "objective_fixed_factors": f"""
            WITH {_FACTORS}, ratings AS ({_RATINGS}),
            known AS (SELECT list_dot_product(u[1:10], i[1:10]) AS p, rating AS r,
                             list_dot_product(u[1:10], u[1:10]) + list_dot_product(i[1:10], i[1:10]) AS s
                      FROM ratings JOIN users USING (userId) JOIN rated USING (movieId)),
            per_rating AS (SELECT sum((1 + {ALPHA} * r) * (1 - p) ** 2 - p ** 2) AS rated,
                                  {LAMBDA} * sum(s) AS penalty FROM known),
            pairs AS (SELECT sum(list_dot_product(u[1:10], i[1:10]) ** 2) AS all_pairs FROM users, rated)
            SELECT round(all_pairs + rated + penalty, 4) AS objective, round(all_pairs, 4) AS all_pairs,
                   round(rated, 4) AS rated, round(penalty, 4) AS penalty
            FROM per_rating, pairs
        """,
        "als_user_optimality": """
            SELECT DISTINCT CAST(o_custkey AS INTEGER) AS userId, TRUE AS converged
            FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        """,
        "als_model_reuse_scores": f"""
            WITH items AS ({_ITEMS}),
            candidates AS ({_RATED_BY_OTHERS} UNION ALL {_OTHERS_OF_OTHER_USER})
            SELECT userId, movieId, title, TRUE AS same_score
            FROM candidates JOIN items USING (movieId)
        """,
        "als_scored_items": f"""
            WITH items AS ({_ITEMS}), candidates AS ({_RATED_BY_OTHERS})
            SELECT userId, movieId, title, TRUE AS scored
            FROM candidates JOIN items USING (movieId)
        """,
    }
