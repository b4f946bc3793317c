import itertools
import time

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankforge.llm import bpe, decontaminate, language_id, quality_crf, queries, toxicity
from tests_llm import ODD, docs, words  # noqa: F401

RANKS = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORKER = bpe._Worker(bpe.Encoder(RANKS), public_tokenizers.PATTERN)


def labelled(df, name, modulus, left_out, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", name)
    return df.join(labels, "doc_id").where("held_out").collect()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab's \n\t\x1c\x85\u3000é你1²,.!A\U0001f600")), max_size=6))
def test_ids_are_those_of_the_library(texts):
    got = [np.frombuffer(i, "<u4").tolist() for i in WORKER.encode(texts)]
    assert got == [KNOWN.encode_ordinary(t) for t in texts]


def test_long_pieces():
    for text in ("a" * 3000, "xyzzy" * 900, "你好" * 700, words(3, 400).replace(" ", ""), " " * 999 + "x"):
        ids = np.frombuffer(WORKER.encode([text])[0], "<u4")
        assert ids.tolist() == KNOWN.encode_ordinary(text)
        assert WORKER.encoder.decode(ids.astype(int)).tobytes() == text.encode()


def test_shared_hashes_fall_back(monkeypatch):
    worker = bpe._Worker(bpe.Encoder(RANKS), public_tokenizers.PATTERN)
    monkeypatch.setattr(worker, "_hashes", lambda data, starts, stops: np.zeros(len(starts), np.uint64))
    texts = ["some words here", "other ones"]
    assert [np.frombuffer(i, "<u4").tolist() for i in worker.encode(texts)] == list(map(KNOWN.encode_ordinary, texts))


def test_bpe_rows(spark, docs):
    got = bpe.decode(bpe.encode(docs(ODD), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    want = [(i, len(KNOWN.encode_ordinary(t or "")), (t or "").encode()) for i, t in ODD]
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)
    at_once = bpe.round_trip(docs(ODD), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(str, at_once)) == sorted(map(str, got))
    for empty in (bpe.encode, bpe.round_trip):
        assert empty(docs([]), RANKS, public_tokenizers.PATTERN).collect() == []


def test_language(spark, sf_dir, docs):
    got = queries.op4_language_id(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    profiles = queries.profiles(spark, sf_dir)
    odd = {r.doc_id: r for r in language_id.identify(docs(ODD), profiles).collect()}
    assert all((odd[i].lang_pred, odd[i].score) == ("und", 0.0) for i in (1, 2, 3, 6))
    assert len(language_id.identify(docs(ODD), profiles).collect()) == len(ODD)
    kept = language_id.keep_identified(docs(ODD), profiles, 0.0)
    assert kept.columns == docs(ODD).columns and kept.where("doc_id IN (1, 2, 3, 6)").count() == 0
    none = language_id.learn_profiles(docs([]))
    assert {r.lang_pred for r in language_id.identify(docs(ODD), none).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_letters():
    of, packed = language_id.trigrams(["Ab c", "", "é"])
    got = language_id.bundle(3, of, packed, 64)
    vector = lambda c, roll: np.roll(language_id._letter_vector(ord(c), 64), roll).astype(int)
    gram = lambda g: vector(g[0], 2) * vector(g[1], 1) * vector(g[2], 0)
    assert (got[0] == gram(" ab") + gram("ab ") + gram(" c ")).all()
    assert not got[1].any() and (got[2] == gram(" é ")).all()


def test_marginals_equal_all_labelings():
    rng = np.random.default_rng(0)
    energy, pairs = rng.normal(size=7), rng.normal(size=(2, 2))
    of = np.array([0, 0, 0, 1, 2, 2, 2])
    good, counts = quality_crf.forward_backward(energy, of, pairs)
    want, want_counts = np.zeros(7), np.zeros((2, 2))
    for text in range(3):
        at = np.flatnonzero(of == text)
        weight, total = {}, 0.0
        for labels in itertools.product((0, 1), repeat=len(at)):
            s = sum(energy[i] for i, l in zip(at, labels) if l) + sum(pairs[p] for p in zip(labels, labels[1:]))
            weight[labels] = np.exp(s)
            total += np.exp(s)
        for labels, w in weight.items():
            for i, l in zip(at, labels):
                want[i] += w / total * l
            for p in zip(labels, labels[1:]):
                want_counts[p] += w / total
    assert np.allclose(good, want) and np.allclose(counts, want_counts)


def test_quality(spark, docs):
    sf_dir = "/root/testdata/sf0.01"
    rows = labelled(queries.op5_quality_crf(spark, sf_dir), "quality", 5, 0, spark, sf_dir)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    model = queries.line_model(spark, sf_dir)
    odd = {r.doc_id: r for r in quality_crf.score_quality(docs(ODD), model).collect()}
    assert all(odd[i].score == 0 and odd[i].lines == 0 for i in (1, 2, 3))
    assert quality_crf.keep_good(docs(ODD), model, 0.0).count() == len(ODD)
    nothing = quality_crf.learn_quality(docs([]), spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 6) for r in quality_crf.score_quality(docs([(1, "a b")]), nothing).collect()} == {0.5}


def test_toxicity(spark, sf_dir, docs):
    rows = labelled(queries.op8_toxicity(spark, sf_dir), "toxic", 3, 1, spark, sf_dir)
    assert all(not r.predicted for r in rows if not r.toxic)
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs(ODD), docs(ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len(toxicity.score_toxicity(docs(ODD), docs([]), labels.limit(0)).collect()) == len(ODD)
    assert toxicity.score_toxicity(docs([]), docs(ODD), labels).collect() == []


def test_toxic_words_are_learned(spark, docs):
    rows = [(i, words(i, 40) + (f" nasty{i % 3} vile" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs(rows), docs(rows), labels).collect()}
    assert all((got[i].score >= 0.7) == (i % 4 == 0) for i in range(300, 400))
    assert all(e % 4 == 0 for i in range(300, 400, 4) for e in got[i].evidence)


def test_all_telling_terms_are_taken(spark):
    insults = " ".join(f"{i}" for i in range(4500))
    rows = [(i, i % 2, f"{insults} {i}x" if i % 2 else f"{i}x") for i in range(80)]
    found = toxicity._telling_terms(spark.createDataFrame(rows, "doc_id long, toxic int, text string"))
    wanted = set(toxicity.terms([insults])[1].tolist())
    assert len(wanted) > 4096 and wanted == set(found.tolist())


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(500):
        term = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        weight = rng.random(len(term))
        vectors.append((term, weight / np.linalg.norm(weight)))
    index = toxicity.BlockMaxIndex(list(range(500)), [0] * 500, vectors, 60)
    dense = np.zeros((500, 60))
    for i, (t, w) in enumerate(vectors):
        dense[np.flatnonzero(index.ids == i)[0], t] = w
    for t, w in vectors[:100]:
        place, cosine = index.nearest(t, w, 25)
        exact = dense[:, t] @ w
        order = np.lexsort((np.arange(500), -np.round(exact, 12)))[:25]
        assert place.tolist() == order[exact[order] > 0].tolist()
        assert np.allclose(cosine, exact[place])


def brute_tiling(item, doc, size):
    """Longest unmarked match first, by trying every pair of places."""
    used_i, used_d, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(doc)):
                n = 0
                while (
                    p + n < len(item) and t + n < len(doc) and item[p + n] == doc[t + n]
                    and p + n not in used_i and t + n not in used_d
                ):
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < size:
            return covered
        covered += n
        used_i.update(range(p, p + n))
        used_d.update(range(t, t + n))


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        item = rng.integers(0, 6, 25).astype(np.uint64)
        doc = np.concatenate([rng.integers(0, 6, 20), item[12:], rng.integers(0, 9, 5), item[:12]]).astype(np.uint64)
        index = decontaminate.Index([1], [item])
        hashes = decontaminate.rolling(item, 3)
        order = np.argsort(hashes, kind="stable")
        index.seeds[3] = (hashes[order], np.zeros(len(order), int), order)
        tiles = dict(index.overlaps(doc))[0]
        assert sum(t[2] for t in tiles) == brute_tiling(item.tolist(), doc.tolist(), 3)


def seeded(item, size):
    index = decontaminate.Index([1], [item])
    hashes = decontaminate.rolling(item, size)
    order = np.argsort(hashes, kind="stable")
    index.seeds[size] = (hashes[order], np.zeros(len(order), int), order)
    return index


def test_tiles_by_length_are_those_of_pairs(monkeypatch):
    rng = np.random.default_rng(9)
    for case in range(150):
        stock, size = (1, 2, 3, 6)[case % 4], (1, 2, 4)[case % 3]
        item = rng.integers(0, stock, rng.integers(1, 30)).astype(np.uint64)
        doc = np.concatenate([rng.integers(0, stock + 1, rng.integers(0, 40)).astype(np.uint64), item[::2], item])
        index = seeded(item, min(size, len(item)))
        found = []
        for pairs in (1 << 16, 0):
            monkeypatch.setattr(decontaminate, "PAIRS", pairs)
            found.append(list(index.overlaps(doc)))
        assert found[0] == found[1]


def test_words_repeated_on_both_sides_are_no_square():
    item, doc = np.full(4000, 7, np.uint64), np.full(4000, 7, np.uint64)
    start = time.monotonic()
    assert list(seeded(item, 4).overlaps(doc)) == [(0, [(0, 0, 4000)])]
    # Runs of one word between others, and a text a hundred times as long.
    item[::50], doc = np.arange(80), np.full(400000, 7, np.uint64)
    doc[::35] = 100 + np.arange(len(doc[::35]))
    (found,) = seeded(item, 4).overlaps(doc)
    assert sum(n for _, _, n in found[1]) == (item == 7).sum()
    assert time.monotonic() - start < 3


def test_reordered_passages_are_found(spark, docs):
    first, second, third = (words(s, 15) for s in (11, 12, 13))
    tests = spark.createDataFrame(
        [(1, f"{first}. {second}. {third}."), (2, words(20, 40)), (3, None), (4, ""), (5, "Two words"), (6, "!!!")],
        "item_id long, text string",
    )
    rows = [
        (10, words(30, 500) + f" {third.upper()}, {first}! {second} " + words(31, 500)),
        (11, first + " " + words(32, 50)), (12, words(33, 100)), (13, "only two words, yes"), (14, None), (15, ""),
    ]
    got = decontaminate.find_overlaps(docs(rows), tests).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got) == [(10, 1, 1.0), (13, 5, 1.0)]
    cut = decontaminate.find_overlaps(docs(rows), tests, pass_bytes=150).collect()
    assert sorted(map(str, cut)) == sorted(map(str, got))
    clean = decontaminate.drop_contaminated(docs(rows), tests)
    assert clean.columns == docs(rows).columns
    assert sorted(r.doc_id for r in clean.collect()) == [11, 12, 14, 15]
    assert decontaminate.find_overlaps(docs(ODD), tests.limit(0)).collect() == []
    assert decontaminate.drop_contaminated(docs([]), tests).collect() == []
