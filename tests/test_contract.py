"""Every registered query at the smallest scale: against its oracle, or its invariants."""

import __spark_entry__ as contract
import pytest
from check_oracles import connect, duckdb_result, spark_result
from conftest import rows

QUERIES = contract.core_queries()
ORACLES = contract.core_oracle_sql()
# What SQL cannot know: the rows a trained model recommends. The queries of these
# names give every candidate with a certificate, which SQL can check.
RECOMMENDED = {
    "als_recommend": contract._als_recommend,
    "als_recommend_unseen": contract._als_recommend_unseen,
    "als_model_reuse": contract._als_model_reuse,
    "recommend_job": contract._recommend_job,
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


def no_python_and_no_cross_join(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    operators = ("Python", "Pandas", "CartesianProduct", "NestedLoop", "ExistingRDD")
    return not [o for o in operators if o in plan]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    assert no_python_and_no_cross_join(df)
    schema, got = spark_result(df)
    want_schema, want = duckdb_result(duck, ORACLES[name])
    assert schema == want_schema
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(RECOMMENDED))
def test_query_invariants(spark, sf_dir, name):
    df = RECOMMENDED[name](spark, sf_dir).rows
    assert no_python_and_no_cross_join(df)
    assert sorted(df.columns) == ["movieId", "prediction", "title", "userId"]
    got = rows(df.select("userId", "movieId", "prediction", "title"))
    by_user = {}
    for row in got:
        by_user.setdefault(row[0], []).append(row)
    users = {contract.USER, contract.OTHER_USER} if name == "als_model_reuse" else {contract.USER}
    limit = contract.LIMIT if name == "recommend_job" else 10
    assert by_user.keys() == users
    for mine in by_user.values():
        assert len(mine) == limit == len({item for _, item, _, _ in mine})
        assert [p for _, _, p, _ in mine] == sorted((p for _, _, p, _ in mine), reverse=True)
        assert all(", Brand#" in title for _, _, _, title in mine)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.dtypes == [("username", "string"), ("n", "bigint")]
    assert len(rows(df)) == contract.LIMIT
