import zlib

from pyspark.sql import functions as F

from rankforge.llm import queries
from rankforge.llm.reshard import moving_cost, read_shards, reshard, rewrite_affected, solve_flow
from tests_llm import ODD, docs  # noqa: F401


def brute_least(supplies, capacities):
    return sum(max(0, s - c) for s, c in zip(supplies, capacities)) + sum(supplies[len(capacities):])


def test_flow_moves_the_fewest_bytes():
    for supplies, capacities in (([10, 50, 3], [20, 20, 23]), ([5, 5, 5, 9], [12, 12]), ([7], [3, 3, 3]), ([], [0])):
        flow = solve_flow(supplies, capacities, moving_cost(len(supplies), len(capacities)))
        assert sum(t.size for t in flow if t.source != t.target) == brute_least(supplies, capacities)
        for i, s in enumerate(supplies):
            assert sum(t.size for t in flow if t.source == i) == s
        for j, c in enumerate(capacities):
            assert sum(t.size for t in flow if t.target == j) <= c


def test_query_places_every_row_once(spark, sf_dir):
    got = queries.op1_reshard(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    by = {}
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(16))
    totals = [sum(r["size"] for r in v) for v in by.values()]
    assert max(totals) - min(totals) <= max(len(t.encode()) for t in texts.values())
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))


def test_odd_rows_and_rewriting(spark, docs):
    df = docs(ODD * 3).withColumn("old", F.lit(1))
    path = reshard(df, "old", 3)
    back = read_shards(spark, path, df)
    assert sorted(map(str, map(tuple, back.select("row.*").collect()))) == sorted(map(str, map(tuple, df.collect())))
    sizes = {r[0]: r[1] for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("row.text"), F.lit(0)) + 1)).collect()}
    capacities = [sizes.get(0, 0), sizes.get(1, 0) + sizes.get(2, 0), 0]
    out, affected = rewrite_affected(spark, path, capacities, df)
    assert 0 not in affected and read_shards(spark, out, df).count() == back.where("shard <> 0").count()


def test_no_rows(spark, docs):
    df = docs([]).withColumn("old", F.lit(0))
    assert read_shards(spark, reshard(df, "old", 4), df).collect() == []
