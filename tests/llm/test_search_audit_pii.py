"""Lexical search, filter audit and personal data against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers  # noqa: F401  the queries need it
import pyarrow as pa
import pytest
from check_oracles import connect, duckdb_result, spark_result
from pyspark.sql import functions as F
from tests_llm import ODD, docs, words  # noqa: F401

from rankforge.llm import filter_audit, lexical_search, pii, queries
from rankforge.llm.windows import windows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_filter_audit"])
def test_query_equals_oracle(spark, sf_dir, duck, name):
    schema, got = spark_result(queries.queries()[name](spark, sf_dir))
    want_schema, want = duckdb_result(duck, queries.oracle_sql()[name])
    assert schema == want_schema
    assert got == want
    assert got


def test_windows_keep_runs_whole():
    apart = re.compile(rb" +")
    data = b"ab  cd " + b"x" * 50 + b" e f  "
    cut = list(windows(data, apart, 4))
    assert b" ".join(cut).split() == data.split()
    assert b"x" * 50 in cut and len(cut) > 2
    assert list(windows(b"", apart, 4)) == [b""]


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = [(d, Counter(TERM.findall((t or "").translate(lower)))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    total, occurrences = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall((text or "").translate(lower)))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c, n in held:
            m = 100 - 50 + 50 * n * total // occurrences
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
                for t in terms
                if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        best = sorted(scored, key=lambda s: s[:3])[:top]
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(best)]
    return out


def key(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r))


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string").withColumn("score", F.lit("x"))


def test_search_equals_brute_force(docs, items):
    rng = random.Random(5)
    some = [(i, words(i, rng.choice([3, 20, 200]), 60)) for i in range(400)]
    some += ODD + some[:40] + [(1000 + i, "Same WORDS here") for i in range(30)]
    asked = [(i, words(1000 + i, 12, 80)) for i in range(12)]
    asked += [(3, "w1 w2 w3"), (None, "same words"), (None, "w4"), (77, None), (78, "..."), (79, "Nowhere"), (80, "你好 ß one")]
    want = brute_search(some, asked, 7)
    assert {i for i, *_ in want} >= {0, 3, None, 80}
    for pass_bytes in (lexical_search.PASS_BYTES, 200):
        got = lexical_search.search(docs(some).repartition(3), items(asked), 7, pass_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert key(map(tuple, got.collect())) == key(want)


def test_search_of_empty_tables(docs, items):
    assert lexical_search.search(docs([]), items([(1, "one")])).collect() == []
    assert lexical_search.search(docs([(1, "one")]), items([])).collect() == []
    assert lexical_search.search(docs([(1, None), (2, "--")]), items([(1, "one")])).collect() == []


def test_accumulators_are_limited_and_exact():
    # One rare term that few documents hold, one that all hold.
    size, k = 4000, 5
    held = [[0, 1] if d % 400 == 7 else [1] for d in range(size)]
    counts = [[1 + d % 3] * len(h) for d, h in enumerate(held)]
    n = np.full(size, 100)
    docs_of = np.array([10, size])
    weights = np.array([lexical_search.weight(size, int(x)) for x in docs_of])
    ranking = lexical_search.Ranking([np.array([0, 1])], weights, size, 100 * size)
    index = lexical_search.InvertedFile.of(
        pa.array(held, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())), n, ranking
    )
    doc, score, made = index.accumulate(np.array([0, 1]), k, 0)
    assert made == 10
    m = 100
    full = [sum(weights[t] * (10**9 * c // (1000 * c + 20 * m)) for t, c in zip(h, cs)) for h, cs in zip(held, counts)]
    best = sorted(range(size), key=lambda d: (-full[d], d))[:k]
    assert set(best) <= set(doc.tolist())
    assert score.tolist() == [full[d] for d in doc]


def test_equal_bound_still_makes_accumulators():
    # The k-th partial score can be equalled: the smaller id must win.
    held = [[1], [0]]
    ranking = lexical_search.Ranking([np.array([0, 1])], np.array([5, 5]), 2, 2)
    index = lexical_search.InvertedFile.of(
        pa.array(held, pa.list_(pa.int32())), pa.array([[1], [1]], pa.list_(pa.int64())), np.array([1, 1]), ranking
    )
    doc, score, _ = index.accumulate(np.array([0, 1]), 1, 0)
    assert doc.tolist() == [0, 1] and len(set(score.tolist())) == 1


# Filter audit


def test_positional_popcount():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 100, 4097):
        found = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        want = [int(((found >> b) & 1).sum()) for b in range(32)]
        assert filter_audit.positional_popcount(found).tolist() == want


def test_survival_words():
    for fails in range(32):
        word = int(filter_audit.survival_words(np.array([fails]))[0])
        assert word == sum(1 << s for s in range(32) if not s & fails)


def brute_audit(docs, labels):
    def fails(doc_id, text):
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {
            "A": len(found) < 200,
            "B": 100 * len(set(found)) < 50 * len(found),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in docs),
        }

    marks = defaultdict(set)
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            marks[doc_id] |= {"good"} if quality == 1 else set()
            marks[doc_id] |= {"toxic"} if toxic == 1 else set()
    per = defaultdict(list)
    for doc_id, text, lang, *_ in docs:
        per[lang or ""].append((fails(doc_id, text or ""), marks.get(doc_id, set())))
    out = []
    for part, members in per.items():
        removed_in_all = Counter()
        lines = []
        for order in permutations("ABCDE"):
            for step, x in enumerate(order):
                before = [m for m in members if not any(m[0][y] for y in order[:step])]
                gone = [m for m in before if m[0][x]]
                removed_in_all[x] += len(gone)
                lines.append((
                    "".join(order), step + 1, len(before) - len(gone), len(gone),
                    sum(m[0][x] for m in members) - len(gone),
                    sum(m[0][x] and sum(m[0].values()) == 1 for m in members),
                    sum("good" in m[1] for m in gone), sum("toxic" in m[1] for m in gone), x,
                ))
        out += [(part, *line[:-1], removed_in_all[line[-1]]) for line in lines]
    return out


def test_audit_equals_brute_force(spark, docs):
    rng = random.Random(3)
    bases = [words(i, rng.choice([100, 250, 300]), rng.choice([50, 5000])) for i in range(30)]
    bases += [b.upper() for b in bases[:6]] + [b + " 5$" for b in bases[4:12]]
    rows = [(i, rng.choice(bases), rng.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(*r, "en") for r in ODD] + [(5, bases[0], "de"), (5, bases[0], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)]
    labels += [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = filter_audit.audit(docs(rows), marked)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(brute_audit(rows, labels))
    assert len(got) == 600 * 3
    for part in ("en", "de", ""):  # Shapley values share out what all filters remove
        mine = [r for r in got if r[0] == part]
        first = {r[1][0]: r[-1] for r in mine if r[2] == 1}
        kept = {r[3] for r in mine if r[2] == 5}
        n = sum((r[2] or "") == part for r in rows)
        assert len(kept) == 1 and sum(first.values()) == 120 * (n - kept.pop())


def test_audit_of_no_documents(spark, docs):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs([]), labels).collect() == []


def test_words_of_a_long_text():
    text = " ".join(f"w{i}" for i in range(400_000)) + "\n" + "w7 " * 1000
    assert filter_audit.word_counts(text.encode()) == (401_000, 400_000)


# Personal data


def brute_base(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def shards():
    rng = random.Random(11)
    bits = [
        "a", "a.b", "@", "@@", "x@y", "x@y.z", "ü", "你@b.c", ".", "..", "-", "+1", "+", " ", "(", ")", "4",
        "4111111111111111", "4111 1111 1111 1111", "10.0.0.1", "1.2.3", "256.1.1.1", "007.0001.2.3", "+1 (222) 333-4444",
        "12345678901234567890", "5555-5555-5555-4444", "\n", "_%+-", "49", "\xa0",
    ]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]


def test_base_spans_equal_brute_force():
    hits = Counter()
    for text in shards():
        got = [(s.kind, s.start, s.end) for s in pii.spans_of(text) if s.base]
        assert got == brute_base(text), text
        hits.update(k for k, *_ in got)
    assert min(hits[k] for k in ("email", "ip", "card", "phone")) > 30


def test_added_spans():
    def added(text):
        return [(s.kind, text[s.start : s.end]) for s in pii.spans_of(text) if not s.base]

    assert added("7536784127813050 4111111111111111 x") == [("card", "4111111111111111")]
    assert added("4111.1111.1111.1111.") == [("card", "4111.1111.1111.1111")]
    assert added("to DE89 3704 0044 0532 0130 00 now") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("to DE88370400440532013000 now") == []
    assert added("GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]
    assert added("my SSN is 123-45-6789") == [("ssn", "123-45-6789")]
    assert added("no 123-45-6789") == [] and added("ssn 666-45-6789") == []


def test_context_moves_the_score():
    def score(text):
        return pii.spans_of(text)[0].score

    plain, near, other = "zz 4111111111111111", "Card: 4111111111111111", "order 4111111111111111"
    assert score(near) > score(plain) > score(other)
    assert len(pii.spans_of(other)) == 1  # a base span stays
    assert pii.spans_of("Kontakt a@b.c")[0].score == pii.BY_PATTERN["email"]


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "1 ", "1.", "a@", "+1", "A1", "1-"):
        pii.spans_of(unit * 300_000)


def test_personal_data_of_odd_rows(docs):
    rows = ODD + [(20, "a@b.c"), (20, "a@b.c"), (None, "1.1.1.1")]
    got = pii.find_personal_data(docs(rows))
    assert got.columns == ["doc_id", "spans"]
    got = [(r[0], [(s.kind, s.start, s.end) for s in r[1]]) for r in got.collect()]
    want = [(d, brute_base(t or "")) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert pii.find_personal_data(docs([])).collect() == []
    kept = {tuple(r) for r in pii.redacted(docs(rows)).collect()}
    assert kept >= {(20, "<email>"), (None, "<ip>"), (1, ""), (4, "one")}


def test_personal_data_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.queries()["op13_personal_data"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        row, base = got[doc_id], brute_base(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [
            sum(k == kind for k, *_ in base) for kind in ("email", "ip", "card", "phone")
        ]
        assert set(listed.split(",")) - {""} <= set(row.spans.split(","))
