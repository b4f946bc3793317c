import random
import re

import numpy as np
import pytest
from conftest import rows

from rankforge.functions.vector import dot
from rankforge.operators.candidates import (
    distinct_candidates,
    rated_by_others,
    rating_witnesses,
    unseen,
)
from rankforge.operators.ranking import rank_recommendations, top_recommendations
from rankforge.operators.scoring import join_items, score_pairs, score_user
from rankforge.plans import recommend as plan
from rankforge.plans.recommend import (
    load_recommender,
    recommend,
    run_recommend,
    score_candidates,
    train_recommender,
)
from rankforge.session import shared_dir
from rankforge.sources import read_recommendations


def ratings_df(spark, data):
    return spark.createDataFrame(data, "userId int, movieId int, rating double")


def items_df(spark, data):
    return spark.createDataFrame(data, "movieId int, title string")


def factors_df(spark, data):
    return spark.createDataFrame(data, "id int, features array<float>")


def random_ratings(users=60, items=40, share=0.25, seed=3):
    rng = random.Random(seed)
    return [
        (u, i, rng.randrange(1, 11) / 2)
        for u in range(1, users + 1)
        for i in range(1, items + 1)
        if rng.random() < share or i == u % items + 1
    ]


@pytest.fixture(scope="module")
def trained(spark):
    data = random_ratings()
    titles = [(i, f"Title {i}, The") for i in range(1, 61) if i != 7]  # 41 to 60: never rated
    path = shared_dir(spark, "model")
    ratings = ratings_df(spark, data)
    return data, titles, ratings, items_df(spark, titles), train_recommender(ratings, path), path


# Candidates


def test_candidates_with_repeats_and_an_item_of_one_user(spark):
    data = [(1, 10, 4.0), (1, 10, 3.0), (2, 10, 1.0), (1, 11, 5.0), (3, 12, 2.0), (2, 12, 2.0)]
    ratings = ratings_df(spark, data)
    got = rated_by_others(ratings, 1)
    assert got.dtypes == [("userId", "int"), ("movieId", "int")]
    assert sorted(rows(got)) == [(1, 10), (1, 12)]
    assert sorted(rows(rated_by_others(ratings, 99))) == [(99, 10), (99, 11), (99, 12)]
    items = items_df(spark, [(10, "a"), (11, "b"), (12, "c"), (13, "d"), (13, "d again")])
    assert sorted(rows(unseen(items, ratings, 1))) == [(1, 12), (1, 13)]
    assert sorted(rows(distinct_candidates(ratings))) == [(1, 10), (1, 11), (2, 10), (2, 12), (3, 12)]


def test_witnesses_answer_like_the_ratings(spark):
    rng = random.Random(5)
    # User 0 gives a third of the ratings, several items have one user only.
    data = [(0 if n % 3 == 0 else rng.randrange(12), rng.randrange(25), 1.0) for n in range(90)]
    data += [(u, 100 + u, 1.0) for u in range(12)]
    ratings = ratings_df(spark, data)
    witnesses = rating_witnesses(ratings)
    stored = rows(witnesses)
    assert all(sum(1 for _, i in stored if i == item) <= 2 for _, item, _ in data)
    for user in [*range(12), 99]:
        expected = sorted({(user, i) for u, i, _ in data if u != user})
        assert sorted(rows(rated_by_others(ratings, user))) == expected
        assert sorted(rows(rated_by_others(witnesses, user))) == expected


# Scores


def test_pairs_with_unknown_ids_drop(spark):
    users = factors_df(spark, [(1, [1.0, 2.0]), (2, [0.5, 0.0])])
    items = factors_df(spark, [(5, [3.0, 4.0]), (6, [-1.0, 1.0])])
    pairs = spark.createDataFrame(
        [(1, 5), (2, 6), (1, 9), (9, 5), (9, 9)], "userId int, movieId int"
    )
    for rank in (None, 2):
        got = score_pairs(pairs, users, items, rank)
        assert got.dtypes == [("userId", "int"), ("movieId", "int"), ("prediction", "double")]
        assert sorted(rows(got)) == [(1, 5, 11.0), (2, 6, -0.5)]
        mine = pairs.where("userId = 1")
        assert rows(score_user(mine, users, items, 1, rank)) == [(1, 5, 11.0)]
        assert rows(score_user(pairs.where("userId = 9"), users, items, 9, rank)) == []


@pytest.mark.parametrize("size", [1, 10, 16, 17, 64])
def test_dot_is_written_out_only_when_short(spark, size):
    rng = random.Random(size)
    a, b = ([rng.uniform(-1, 1) for _ in range(size)] for _ in range(2))
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    with_size, without = df.select(dot(df.a, df.b, size)), df.select(dot(df.a, df.b))
    expected = float(np.array(a, np.float32).astype(float) @ np.array(b, np.float32).astype(float))
    assert rows(with_size)[0][0] == pytest.approx(expected, abs=1e-12)
    assert rows(without) == rows(with_size)
    assert ("aggregate(" in with_size._jdf.queryExecution().toString()) == (size > 16)


def test_scores_against_brute_force_with_a_hot_user_and_item(spark):
    """A third of the pairs has one user, a third one item; AQE splits every join."""
    rng = np.random.default_rng(11)
    n, rank = 6000, 6
    user_vectors = rng.normal(size=(n, rank)).astype(np.float32)
    item_vectors = rng.normal(size=(n, rank)).astype(np.float32)
    data = [(0, i) for i in range(n)] + [(u, 0) for u in range(n)]
    data += [(int(u), int(i)) for u, i in rng.integers(0, n, size=(n, 2))]
    wanted = set(data)
    pairs = spark.createDataFrame(data, "userId int, movieId int").repartition(16)

    def table(vectors):
        return factors_df(spark, [(i, [float(x) for x in v]) for i, v in enumerate(vectors)])

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        scored = score_pairs(distinct_candidates(pairs), table(user_vectors), table(item_vectors), rank)
        items = items_df(spark, [(i, f"Title {i}") for i in range(n)])
        titled = join_items(scored, items).select("userId", "movieId", "prediction", "title")
        got = {}
        for u, i, p, title in rows(titled):
            assert title == f"Title {i}" and (u, i) not in got
            got[u, i] = p
        executed = titled._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert len(re.findall(r"SortMergeJoin\(skew=true\)", executed.split("== Initial Plan ==")[0])) == 3
    assert got.keys() == wanted
    for (u, i), p in got.items():
        expected = float(user_vectors[u].astype(float) @ item_vectors[i].astype(float))
        assert p == pytest.approx(expected, abs=1e-9)


def test_join_items_and_order_of_ties(spark):
    scored = spark.createDataFrame(
        [(1, 5, 0.5), (1, 4, 0.5), (1, 6, float("nan")), (1, 7, 0.9), (1, 8, 2.0)],
        "userId int, movieId int, prediction double",
    )
    items = items_df(spark, [(4, "d"), (5, "e2"), (5, "e1"), (6, "f"), (7, "g"), (9, "z")])
    titled = join_items(scored, items).select("movieId", "title", "prediction")
    expected = [(6, "f"), (7, "g"), (4, "d"), (5, "e1"), (5, "e2")]
    assert [r[:2] for r in rows(rank_recommendations(titled))] == expected
    for limit in (0, 1, 3, 50):
        assert [r[:2] for r in rows(top_recommendations(titled, limit))] == expected[:limit]


# Model


def vectors(df):
    return {i: np.array(f, dtype=np.float64) for i, f in rows(df)}


def test_user_factors_solve_the_implicit_least_squares_problem(trained):
    """The last half step of training, solved again user by user.

    With confidence 1 + alpha r and preference 1, the factors x of a user with
    n ratings solve (Y'Y + sum alpha r y y' + lambda n I) x = sum (1 + alpha r) y.
    """
    data, _, _, _, recommender, _ = trained
    users, items = vectors(recommender.model.userFactors), vectors(recommender.model.itemFactors)
    assert users.keys() == {u for u, _, _ in data}
    assert items.keys() == {i for _, i, _ in data}
    gram = sum(np.outer(y, y) for y in items.values())
    for user, x in users.items():
        mine = [(items[i], 1.0 * r) for u, i, r in data if u == user]
        left = gram + 0.01 * len(mine) * np.eye(10) + sum(c * np.outer(y, y) for y, c in mine)
        right = sum((1 + c) * y for y, c in mine)
        assert np.allclose(x, np.linalg.solve(left, right), atol=2e-3)


@pytest.mark.parametrize("change, converged", [({}, True), ({"regularization": 0.1}, False), ({"alpha": 2.0}, False)])
def test_optimality_knows_the_parameters(trained, change, converged):
    from rankforge.operators.optimality import user_optimality

    data, _, ratings, _, recommender, _ = trained
    settings = {"rank": 10, "regularization": 0.01, "alpha": 1.0} | change
    model = recommender.model
    got = dict(rows(user_optimality(ratings, model.userFactors, model.itemFactors, **settings)))
    assert got.keys() == {u for u, _, _ in data}
    assert set(got.values()) == {converged}


def test_model_parameters():
    assert (plan.RANK, plan.ITERATIONS, plan.LAMBDA, plan.ALPHA) == (10, 5, 0.01, 1.0)


def brute_force(trained, user, candidates, limit):
    data, titles, _, _, recommender, _ = trained
    users, items = vectors(recommender.model.userFactors), vectors(recommender.model.itemFactors)
    if user not in users:
        return []
    if candidates == "unseen":
        seen = {i for u, i, _ in data if u == user}
        wanted = {i for i, _ in titles if i not in seen}
    else:
        wanted = {i for u, i, _ in data if u != user}
    titles = dict(titles)
    scored = [(user, i, float(users[user] @ items[i]), titles[i]) for i in wanted if i in items and i in titles]
    return sorted(scored, key=lambda r: (-r[2], r[1]))[:limit]


@pytest.mark.parametrize("candidates", ["rated_by_others", "unseen"])
@pytest.mark.parametrize("user, limit", [(1, 3), (5, 10), (60, 1000), (999999, 10), (0, 10)])
def test_recommend_against_brute_force(trained, user, limit, candidates):
    _, _, ratings, items, recommender, _ = trained
    got = rows(recommend(recommender.model, ratings, items, user, limit, candidates))
    expected = brute_force(trained, user, candidates, limit)
    assert [(u, i, t) for u, i, _, t in got] == [(u, i, t) for u, i, _, t in expected]
    assert [p for _, _, p, _ in got] == pytest.approx([p for _, _, p, _ in expected], abs=1e-9)
    if candidates == "rated_by_others":
        assert rows(recommend(recommender.model, recommender.raters, items, user, limit)) == got


def test_scores_equal_those_of_the_model(trained):
    _, _, ratings, items, recommender, _ = trained
    scored = {i: p for _, i, p, _ in rows(score_candidates(recommender.model, ratings, items, 5))}
    theirs = recommender.model.transform(rated_by_others(ratings, 5))
    for _, item, prediction in rows(theirs):
        if item != 7:  # has no title
            assert scored[item] == pytest.approx(prediction, abs=1e-5)


def test_one_model_serves_many_users_after_loading(spark, trained):
    _, _, _, items, recommender, path = trained
    again = load_recommender(spark, path + "/")
    assert again.model.rank == 10
    for user in (1, 2, 3):
        assert rows(recommend(again.model, again.raters, items, user)) == rows(
            recommend(recommender.model, recommender.raters, items, user)
        )


def test_same_seed_same_result(trained):
    _, _, ratings, items, recommender, _ = trained
    twin = train_recommender(ratings)
    first, second = (rows(recommend(m.model, m.raters, items, 5, 5)) for m in (recommender, twin))
    assert [r[1] for r in first] == [r[1] for r in second]
    assert [r[2] for r in first] == pytest.approx([r[2] for r in second], abs=1e-5)


def test_number_of_blocks(trained):
    _, _, ratings, _, _, _ = trained
    model = train_recommender(ratings, num_blocks=3).model
    assert model.userFactors.count() == 60


def test_unknown_candidates(trained):
    _, _, ratings, items, recommender, _ = trained
    with pytest.raises(ValueError, match="candidates"):
        recommend(recommender.model, ratings, items, candidates="all")


@pytest.mark.parametrize("fmt", ["parquet", "text"])
def test_recommend_job(spark, trained, tmp_path, fmt):
    data, titles, _, _, recommender, _ = trained
    ratings_csv = ["userId,movieId,rating,timestamp"] + [f"{u},{i},{r},0" for u, i, r in data]
    items_csv = ["movieId,title,genres"] + [f'{i},"{t}",Drama' for i, t in titles]
    (tmp_path / "ratings.csv").write_text("\n".join(ratings_csv))
    (tmp_path / "movies.csv").write_text("\n".join(items_csv))
    output = shared_dir(spark, "t")

    result = run_recommend(spark, f"{tmp_path}/", output, "run-1", user_id=1, limit=3, fmt=fmt)
    got = rows(result)
    assert len(got) == 3
    assert [r[2] for r in got] == sorted((r[2] for r in got), reverse=True)
    assert all(title == f"Title {item}, The" for _, item, _, title in got)
    assert sorted(rows(read_recommendations(spark, f"{output}/run_id=run-1", fmt))) == sorted(got)

    for candidates in ("rated_by_others", "unseen"):
        served = run_recommend(
            spark, str(tmp_path), output, "run-2", 5, 4, candidates, recommender, fmt
        )
        expected = brute_force(trained, 5, candidates, 4)
        assert [r[1] for r in rows(served)] == [r[1] for r in expected]
    assert rows(run_recommend(spark, str(tmp_path), output, "run-3", 999999, recommender=recommender, fmt=fmt)) == []


@pytest.mark.parametrize("size", [None, 10, 16, 17, 64])
def test_dot_has_one_behaviour_for_all_sizes(spark, size):
    from rankforge.functions.vector import dot
    from pyspark.sql import functions as F

    n = size or 20

    def run(a, b):
        df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
        return df.select(dot(F.col("a"), F.col("b"), size)).first()[0]

    assert run([1.0] * n, [2.0] * n) == 2.0 * n
    assert run(None, [2.0] * n) is None
    for other in (n - 1, n + 1):
        with pytest.raises(Exception, match="different lengths"):
            run([1.0] * n, [1.0] * other)
    if size:
        with pytest.raises(Exception, match="different lengths"):
            run([1.0] * (n + 4), [1.0] * (n + 4))


def test_blocks_do_not_depend_on_the_machine():
    from rankforge.plans import recommend as plan

    import inspect

    assert inspect.signature(plan.train_recommender).parameters["num_blocks"].default == 16
