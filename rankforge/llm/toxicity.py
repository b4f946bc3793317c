"""Toxicity: nearest labelled examples by exact cosine over a block-max index.

The TF-IDF vectors are of the terms that tell the labels apart, not of all terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import sampled_texts, slices, stored, texts_of
from rankforge.llm.word_hashes import joined, letters_and_digits, mix, word_sums

# Labelled examples at most, half of them toxic where there are as many.
SAMPLE_DOCS = 4000
# Terms are words and the beginnings of words, of so many bytes.
PREFIXES = (3, 4, 5, 6, 7)
# A term is told apart from chance by its chi-square over the examples; of
# hundreds of thousands of unrelated terms none comes near it.
CHI_SQUARE = 28.0
NEIGHBOURS = 25
BLOCK = 64


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word and of every beginning of a word."""
    data, starts = joined([t.lower() for t in texts])
    start, end, each, total = word_sums(data, letters_and_digits())
    of = np.searchsorted(starts, start, side="right") - 1
    length = end - start
    upto = np.append(np.uint64(0), np.cumsum(each))
    first = np.cumsum(length) - length
    hashes, rows = [mix(total)], [of]
    for size in PREFIXES:
        longer = np.flatnonzero(length > size)
        at = first[longer]
        hashes.append(mix((upto[at + size] - upto[at]) ^ np.uint64(size)))
        rows.append(of[longer])
    return np.concatenate(rows), np.concatenate(hashes)


def _examples(docs: DataFrame, labels: DataFrame, sample_docs: int) -> tuple[DataFrame, float]:
    """``doc_id, toxic, text`` of the sample, each text once, and the share that is toxic."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    )
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    rows = sampled_texts(docs, known, "toxic", sample_docs)
    return stored(rows.dropDuplicates(["text"]), "examples"), share


def _telling_terms(examples: DataFrame) -> np.ndarray:
    """Hashes of all terms that tell toxic examples from others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, hashes = terms(texts_of(batch))
            toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
            once = ~pd.DataFrame({"of": of, "h": hashes}).duplicated().to_numpy()
            which, values = pd.factorize(hashes[once])
            with_term = np.bincount(which, minlength=len(values))
            with_toxic = np.bincount(which, weights=toxic[of[once]], minlength=len(values))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(values.view(np.int64)),
                    pa.array(with_term.astype(np.int64)),
                    pa.array(with_toxic.astype(np.int64)),
                ],
                ["term", "n", "toxic"],
            )

    totals = examples.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, t = float(totals[0]), float(totals[1] or 0)
    if not 0 < t < n:
        return np.zeros(0, np.uint64)
    counted = (
        examples.select("toxic", "text")
        .mapInArrow(count, "term long, n long, toxic long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("a"))
    )
    gap = F.col("a") * n - F.col("n") * t
    square = gap * gap * n / (F.col("n") * (n - F.col("n")) * t * (n - t))
    best = (
        counted.where(F.col("n") < n)
        .withColumn("chi", square)
        .where(F.col("chi") >= CHI_SQUARE)
        .select("term")
        .collect()
    )
    return np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Add to ``doc_id, text, ...`` the columns ``terms`` and ``counts``; the text goes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            n = batch.num_rows
            found = [([], [])] * n
            if len(known):
                of, hashes = terms(texts_of(batch))
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                cell, count = np.unique(of[hit] * len(known) + at[hit], return_counts=True)
                row, term = cell // len(known), cell % len(known)
                lo, hi = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right")
                found = [(term[a:b], count[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(f.name) for f in kept),
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.list_(pa.int32())),
                ],
                [*(f.name for f in kept), "terms", "counts"],
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{schema}, terms array<int>, counts array<int>")


def _frequencies(counted: DataFrame, size: int) -> DataFrame:
    """``term, n``: in how many texts each term is, added up by each task first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    partial = counted.select("terms").mapInArrow(add, "term long, n long")
    return partial.groupBy("term").agg(F.sum("n").alias("n"))


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples, in blocks that know the largest weight of each term.

    A query looks at blocks in order of their bound, the sum of its weights
    times those maxima, and stops when no bound reaches the weakest neighbour
    that it holds: the neighbours are exact.
    """

    def __init__(self, ids, labels, vectors: list[tuple[np.ndarray, np.ndarray]], size: int):
        # Examples with the same strongest term share blocks, which sharpens the bounds.
        order = sorted(
            range(len(ids)),
            key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), ids[i]),
        )
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], np.float64)
        vectors = [vectors[i] for i in order]
        count = -(-len(order) // BLOCK)
        self.largest = np.zeros((size, count))
        self.rows: list[dict[int, int]] = []
        self.weights: list[np.ndarray] = []
        for b in range(count):
            part = vectors[b * BLOCK : (b + 1) * BLOCK]
            rows = {t: r for r, t in enumerate(sorted({int(t) for v in part for t in v[0]}))}
            weights = np.zeros((len(rows), len(part)))
            for column, (term, weight) in enumerate(part):
                weights[[rows[int(t)] for t in term], column] = weight
            self.rows.append(rows)
            self.weights.append(weights)
            self.largest[list(rows), b] = weights.max(1)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest; ties go to the smaller place."""
        bound = weight @ self.largest[term]
        place, cosine = np.zeros(0, np.int64), np.zeros(0)
        listed = term.tolist()
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(place) == k and bound[b] < cosine[-1] - 1e-12:
                break
            rows = self.rows[b]
            have = [(rows[t], i) for i, t in enumerate(listed) if t in rows]
            at, of = zip(*have)
            score = weight[list(of)] @ self.weights[b][list(at)]
            inside = np.flatnonzero(score > 0)
            place = np.concatenate((place, b * BLOCK + inside))
            cosine = np.concatenate((cosine, score[inside]))
            best = np.lexsort((place, -np.round(cosine, 12)))[:k]
            place, cosine = place[best], cosine[best]
        return place, cosine


@dataclass
class Judge:
    """The index with inverse document frequencies and the map from votes to scores."""

    index: BlockMaxIndex | None
    idf: np.ndarray
    weights: tuple[float, float]  # of an example by label, so that the sample has the true share
    votes: np.ndarray
    scores: np.ndarray
    without: float  # score of a text with no term

    def vector(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = np.log1p(count) * self.idf[term]
        length = np.sqrt((weight * weight).sum())
        return term, weight / length if length else weight

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        label = self.index.labels[place]
        near = cosine * np.where(label > 0, self.weights[1], self.weights[0])
        return float((near * label).sum() / near.sum()) if near.sum() else 0.0

    def score(self, term: np.ndarray, count: np.ndarray) -> tuple[float, list[int]]:
        if not len(term) or self.index is None:
            return self.without, []
        place, cosine = self.index.nearest(*self.vector(term, count), NEIGHBOURS)
        if not len(place):
            return self.without, []
        score = float(np.interp(self.vote(place, cosine), self.votes, self.scores))
        return score, self.index.ids[place[:5]].tolist()


def rising(votes: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of the truth on the votes: pools of neighbours that would fall."""
    pools: list[list[float]] = []
    for v, y, w in sorted(zip(votes.tolist(), truth.tolist(), weight.tolist())):
        pools.append([v * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def score_toxicity(docs: DataFrame, train: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, score, evidence`` of every row of ``docs``.

    Learns from the rows of ``train`` (``doc_id, text``) that ``labels``
    (``doc_id, toxic``) marks: at most ``sample_docs`` of them, by a hash of the
    id, each text once. A document of several labels is toxic if their mean is
    at least half. Terms that tell the labels apart among the examples, those of
    a chi-square of ``CHI_SQUARE`` and more, make the TF-IDF vectors; other terms
    play no part, such as a word in fewer than some 28 toxic examples. Document frequencies are counted over all of ``docs``. The
    nearest examples vote with their cosines, and an isotonic fit of the
    examples' labels on the votes the other examples give them makes the score.
    ``evidence`` holds the ids of the five nearest examples, nearest first.

    A null or empty text, or one without any of the terms, has no neighbours: it
    gets the share of toxic examples among those without terms, and no evidence.
    Without labels of both kinds every score is that share. Rows stay, also
    repeated ones and such with null ids; other columns are not looked at.
    """
    spark = docs.sparkSession
    examples, share = _examples(train, labels, sample_docs)
    vocabulary = _telling_terms(examples)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = stored(term_counts(slim, vocabulary), "terms")
    frequency = _frequencies(counted, len(vocabulary)).collect()
    total = counted.count()
    judge = _judge(
        term_counts(examples, vocabulary).drop("text").collect(), dict(map(tuple, frequency)), total,
        len(vocabulary), share,
    )
    shared = spark.sparkContext.broadcast(judge)  # sample_docs vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Judge = shared.value
        for batch in batches:
            scores, evidence = [], []
            for term, count in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                score, ids = known.score(np.array(term, np.int64), np.array(count, float))
                scores.append(score)
                evidence.append(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))],
                ["doc_id", "score", "evidence"],
            )

    # The table is small and has few files; the search costs more than reading it.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return counted.repartition(parts).mapInArrow(run, "doc_id long, score double, evidence array<long>")


def _judge(rows, frequency: dict[int, int], total: int, size: int, share: float) -> Judge:
    rows = sorted(rows, key=lambda r: r["doc_id"])
    df = np.array([frequency.get(t, 0) for t in range(size)], float)
    idf = np.log((1 + total) / (1 + df)) + 1
    toxic = sum(r["toxic"] for r in rows)
    weights = (
        (1 - share) / max(1, len(rows) - toxic),
        share / max(1, toxic),
    )
    bare = [r["toxic"] for r in rows if not r["terms"]]
    mass = sum(weights[y] for y in bare)
    without = sum(weights[y] for y in bare if y) / mass if mass else share
    judge = Judge(None, idf, weights, np.zeros(1), np.full(1, without), without)
    full = [r for r in rows if r["terms"]]
    if not full:
        return judge
    vectors = [judge.vector(np.array(r["terms"], np.int64), np.array(r["counts"], float)) for r in full]
    judge.index = BlockMaxIndex([r["doc_id"] for r in full], [r["toxic"] for r in full], vectors, size)
    shared_id = Counter(r["doc_id"] for r in full)
    votes = []
    for r, v in zip(full, vectors):
        place, cosine = judge.index.nearest(*v, NEIGHBOURS + shared_id[r["doc_id"]])
        other = judge.index.ids[place] != r["doc_id"]  # no example votes for its own id
        votes.append(judge.vote(place[other][:NEIGHBOURS], cosine[other][:NEIGHBOURS]))
    truth = np.array([r["toxic"] for r in full], float)
    weight = np.where(truth > 0, weights[1], weights[0])
    judge.votes, judge.scores = rising(np.array(votes), truth, weight)
    return judge
