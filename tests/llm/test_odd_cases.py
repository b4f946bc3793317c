"""Hot identical rows, nulls apart from empties, unspaced scripts, clashing names, row-true samples."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm import ODD, docs, words  # noqa: F401

from rankforge.llm import decontaminate, embedding_dedup, minhash, quality_crf, reshard, toxicity, warc_fixity
from rankforge.llm.common import sampled_texts


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Resharding


def shard_bytes(held):
    size = F.coalesce(F.octet_length("row.text"), F.lit(0)) + 1
    return {r[0]: r[1] for r in held.groupBy("shard").agg(F.sum(size)).collect()}


@pytest.mark.parametrize("file_bytes", [reshard.FILE_BYTES, 4000])
def test_a_third_of_identical_rows_is_dealt_out(spark, docs, file_bytes):
    rows = [(i, words(i, 20)) for i in range(2000)] + [(7, words(7, 20))] * 1000 + [(None, None)] * 500
    df = docs(rows).withColumn("old", F.lit(3))
    path = reshard.reshard(df, "old", 8, file_bytes=file_bytes)
    held = reshard.read_shards(spark, path, df).cache()
    assert rows_of(held.select("row.*")) == rows_of(df)
    sizes = shard_bytes(held)
    assert sorted(sizes) == list(range(8))
    # Near equal: off by less than a block, one of 256.
    assert max(sizes.values()) - min(sizes.values()) <= sum(sizes.values()) / reshard.BLOCKS_PER_SHARD
    for shard in range(8):
        slots = [r[0] for r in held.where(F.col("shard") == shard).select("slot").collect()]
        assert sorted(slots) == list(range(len(slots)))
    files = [f for _, _, names in os.walk(path) for f in names if f.startswith("part")]
    least, most = (8, 8) if file_bytes == reshard.FILE_BYTES else (16, 200)
    assert least <= len(files) <= most
    held.unpersist()


def test_rows_that_differ_in_nulls_only_are_kept_apart(spark, docs):
    rows = [(1, "same", None, "a")] * 40 + [(1, "same", "a", None)] * 60
    df = docs(rows).withColumn("old", F.lit(0))
    held = reshard.read_shards(spark, reshard.reshard(df, "old", 4), df)
    assert rows_of(held.select("row.*")) == rows_of(df)


def test_rows_without_an_old_shard_move(spark, docs):
    old = F.when(F.col("doc_id") > 2, F.col("doc_id").cast("int") % 3).when(F.col("doc_id") == 2, -4)
    df = docs(ODD * 3 + [(i, words(i, 9)) for i in range(50)]).withColumn("old", old)
    held = reshard.read_shards(spark, reshard.reshard(df, "old", 5), df)
    assert rows_of(held.select("row.*")) == rows_of(df)
    assert held.where("row.old IS NULL OR row.old < 0").where("NOT moved").isEmpty()


def test_rewriting_with_a_clashing_column(spark, docs):
    df = docs(ODD * 2).withColumn("old", F.lit(0)).withColumn("__shard", F.lit("x"))
    path = reshard.reshard(df, "old", 2)
    total = sum(shard_bytes(reshard.read_shards(spark, path, df)).values())
    out, affected = reshard.rewrite_affected(spark, path, [total, 0], df)
    assert affected == [0, 1]
    assert rows_of(reshard.read_shards(spark, out, df).select("row.*")) == rows_of(df)


# Vectors without ids


def brute_links(rows, threshold=0.9):
    rows = [(i, np.array(v, float)) for i, v in rows]
    linked = {
        a: [b for b in range(len(rows)) if b != a and _cosine(rows[a][1], rows[b][1]) >= threshold]
        for a in range(len(rows))
    }
    out = []
    for a, (vec_id, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            todo += [b for b in linked[todo.pop()] if b not in seen and not seen.add(b)]
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        component = min(ids, default=None)
        out.append((vec_id, len(linked[a]), component, vec_id is not None and vec_id == component))
    return out


def _cosine(a, b):
    return a @ b / np.sqrt((a @ a) * (b @ b)) + 1e-12


def test_vectors_without_ids_are_nodes(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 16))
    rows = [(None, base[0]), (None, base[0]), (5, base[0] + 0.05 * base[1])]
    rows += [(None, base[2]), (None, base[2] * 3), (9, base[3]), (4, base[3]), (None, base[3] + 0.02 * base[4])]
    # One without an id is the only bridge between two with ids.
    c, s = np.cos(0.4), np.sin(0.4)
    x, y = np.eye(16)[0], np.eye(16)[1]
    rows += [(20, x), (None, c * x + s * y), (21, np.cos(0.8) * x + np.sin(0.8) * y)]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = embedding_dedup.similar_vectors(df)
    assert rows_of(got) == sorted(brute_links(rows), key=str)


# Archives


def test_null_records_and_archives_are_apart_from_empty_ones(spark):
    def table(rows):
        return spark.createDataFrame(rows, "archive string, record_id long, record string").withColumn(
            "record", F.col("record").cast("binary")
        )

    one = table([("a", 1, None), ("a", 2, ""), ("a", 3, "x"), (None, 1, "y"), ("", 2, "z"), (None, None, "n")])
    assert warc_fixity.audit(one, one).collect() == []
    two = table([("a", 1, ""), ("a", 2, None), ("a", 3, "x"), ("", 1, "y"), ("", 2, "z"), (None, None, "n")])
    got = {(r.archive, r.record_id, r.fault) for r in warc_fixity.audit(one, two).collect()}
    assert got == {
        ("a", 1, "altered"), ("a", 2, "altered"), (None, 1, "missing"), ("", 1, "extra"),
    }


# Passages


def test_passages_without_ascii_spaces_are_found(spark, docs):
    item = "今天天气很好我们一起去公园散步吧"
    english = "the quick brown fox jumps over one lazy dog today"
    thai = "สวัสดีครับวันนี้อากาศดีมาก"
    tests = spark.createDataFrame([(1, item), (2, english), (3, thai)], "item_id long, text string")
    texts = [
        (1, f"他说{item}然后离开了"),
        (2, "x " + english.replace(" ", " ") + " y"),
        (3, "“" + "” “".join(english.split()) + "”"),
        (4, f"ก{thai}ข"),
        (5, "他说今天下雨了我们留在家里看书吧好不好"),
        (6, "the quick—brown…fox"),
    ]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(docs(texts), tests).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 3)}
    kept = decontaminate.drop_contaminated(docs(texts), tests)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6]


def test_marks_stay_with_their_letters():
    plain, split = decontaminate.tokens(["café ole", "cafe ́ ole"])
    assert len(plain) == 2 and len(split) == 3


# Names and ties of keep_one


def test_columns_of_any_name_pass_keep_one(docs):
    df = docs(ODD + [(20, words(1, 50)), (20, words(2, 50)), (None, words(3, 50))])
    for name in ("__id", "__set_lo", "__set_n", "__keeper", "__changed", "__row", "column_3"):
        df = df.withColumn(name, F.lit("v"))
    got = minhash.keep_one(df)
    assert got.columns == df.columns
    assert {r.text for r in got.where("doc_id = 20 OR doc_id IS NULL").collect()} >= {words(i, 50) for i in (1, 2, 3)}
    assert {r.column_3 for r in got.collect()} == {"v"}


def test_ties_of_keep_one_do_not_depend_on_the_order(spark, docs):
    text = words(4, 50)
    rows = [(3, text, f"l{i}", None) for i in range(20)] + [(3, text, None, "l1"), (3, text, None, None)]
    first = [r.lang for r in minhash.keep_one(docs(rows)).collect()]
    again = [r.lang for r in minhash.keep_one(docs(rows[::-1]).repartition(7)).collect()]
    assert len(first) == 1 and first == again


# Samples


def test_samples_are_bound_by_rows(spark, docs):
    rows = [(1, f"{words(i, 5)} {i}") for i in range(3000)] + [(2, "same text")] * 3000 + [(3, "other")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = sampled_texts(docs(rows), labels, "toxic", 4).collect()
    assert len(got) == 4
    assert sorted((r.doc_id, r.toxic) for r in got) == [(1, 1), (1, 1), (2, 0), (3, 0)]
    examples, _ = toxicity._examples(docs(rows), labels, 4)
    assert examples.count() == 4
    quality = labels.withColumnRenamed("toxic", "quality")
    model = quality_crf.learn_quality(docs(rows), quality, sample_docs=4)
    assert model is not None


def test_samples_of_unique_ids_follow_a_hash_of_the_id(spark, docs):
    rows = [(i, f"t{i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = {r.doc_id for r in sampled_texts(docs(rows), labels, "toxic", 10).collect()}
    hashed = spark.range(40).select("id", F.xxhash64("id").alias("h")).collect()
    want = {r.id for k in (0, 1) for r in sorted((r for r in hashed if r.id % 2 == k), key=lambda r: r.h)[:5]}
    assert got == want
