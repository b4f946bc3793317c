"""Ranked lexical search: term at a time, with a limit on new accumulators.

Documents are counted once against the terms of all queries; what they hold of
them is written as forward lists, whose batches become small inverted files. In
each, a query takes its terms rarest first and adds to one accumulator a
document. When the terms that are left cannot lift a new document to the k-th
partial score, no accumulators are made any more, and those that exist are
completed exactly.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import slices, stored
from rankforge.llm.windows import windows

TOP = 50
# Text of the items searched for at once; more items mean more passes.
PASS_BYTES = 8 << 20
# The best of all tasks meet in two steps, the first in so many groups an item.
GROUPS = 64

# Terms are ASCII letters and digits and all other characters beyond ASCII; A-Z count as a-z.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_APART = re.compile(rb"[^0-9A-Za-z\x80-\xff]+")


def term_counts(text: str) -> Counter[bytes]:
    """How often each term occurs; a long text is read in windows."""
    found: Counter[bytes] = Counter()
    for window in windows(text.encode("utf-8", "surrogatepass"), _APART):
        found.update(_TERM.findall(window.lower()))
    return found


def known_counts(text: str, known: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Number of terms, and the occurrences of the known ones; others are not held."""
    total, found = 0, Counter()
    for window in windows(text.encode("utf-8", "surrogatepass"), _APART):
        terms = _TERM.findall(window.lower())
        total += len(terms)
        found.update(known[t] for t in terms if t in known)
    return total, found


@dataclass
class Queries:
    """Terms of all items of a pass, and each item's own."""

    ids: list[int | None]
    terms: dict[bytes, int]
    of_item: list[list[int]]

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Queries:
        """Rows that share an id, also a null one, are one item."""
        texts: dict[int | None, list[str]] = {}
        for item, text in rows:
            texts.setdefault(item, []).append(text or "")
        ids = sorted(texts, key=lambda i: (i is None, i or 0))
        terms: dict[bytes, int] = {}
        of_item = [
            sorted({terms.setdefault(t, len(terms)) for text in texts[i] for t in term_counts(text)})
            for i in ids
        ]
        return Queries(ids, terms, of_item)


def forward_lists(docs: DataFrame, queries: Broadcast) -> DataFrame:
    """``doc_id, n, terms, counts`` of every text with a term: ``n`` counts all its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = queries.value.terms
        for batch in slices(batches):
            found = [known_counts(t.as_py() or "", known) for t in batch.column("text")]
            made = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([list(c) for _, c in found], pa.list_(pa.int32())),
                    pa.array([list(c.values()) for _, c in found], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )
            yield made.filter(pa.array([n > 0 for n, _ in found], pa.bool_()))

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def _frequencies(lists: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term, added up by each task first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    partial = lists.select("terms").mapInArrow(add, "term long, n long")
    df = np.zeros(size, np.int64)
    for term, n in partial.groupBy("term").agg(F.sum("n")).collect():  # terms of one pass
        df[term] = n
    return df


def weight(documents: int, holding: int) -> int:
    """Of a term that ``holding`` of ``documents`` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Ranking:
    """What scores depend on: each item's terms rarest first, their weights, and the totals."""

    order: list[np.ndarray]
    weights: np.ndarray
    documents: int
    occurrences: int

    @staticmethod
    def of(queries: Queries, df: np.ndarray, documents: int, occurrences: int) -> Ranking:
        weights = np.array([weight(documents, int(n)) for n in df], np.int64)
        order = [
            np.array(sorted((t for t in terms if df[t]), key=lambda t: (df[t], t)), np.int64)
            for terms in queries.of_item
        ]
        return Ranking(order, weights, documents, occurrences)

    def norms(self, n: np.ndarray) -> np.ndarray:
        """``m`` of documents of ``n`` terms; Python's integers do not overflow in between."""
        return np.array([50 + 50 * int(x) * self.documents // self.occurrences for x in n], np.int64)


@dataclass
class InvertedFile:
    """Postings of a batch of documents: documents and impacts of each term."""

    size: int
    start: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    largest: np.ndarray

    @staticmethod
    def of(terms: pa.ListArray, counts: pa.ListArray, n: np.ndarray, ranking: Ranking) -> InvertedFile:
        lengths = terms.value_lengths().to_numpy()
        doc = np.repeat(np.arange(len(lengths)), lengths)
        term = terms.flatten().to_numpy()
        tf = counts.flatten().to_numpy()
        m = ranking.norms(n)[doc]
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m) * ranking.weights[term]
        by_term = np.argsort(term, kind="stable")
        start = np.searchsorted(term[by_term], np.arange(len(ranking.weights) + 1))
        largest = np.zeros(len(ranking.weights), np.int64)
        np.maximum.at(largest, term, impact)
        return InvertedFile(len(lengths), start, doc[by_term], impact[by_term], largest)

    def accumulate(self, order: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents with accumulators, their exact scores, and how many were made.

        Every document that can be among the ``k`` best, or that beats ``floor``
        (the k-th best elsewhere, 0 if unknown), has an accumulator. One that can
        only equal the k-th partial score still gets one, as ties go by id.
        """
        score = np.zeros(self.size, np.int64)
        held = np.zeros(self.size, bool)
        left = np.append(np.cumsum(self.largest[order][::-1])[::-1], 0).tolist()
        creating = True
        for term, bound in zip(order.tolist(), left):
            a, b = self.start[term], self.start[term + 1]
            if a == b:
                continue
            if creating:
                kth = floor
                if bound >= floor and (made := score[held]).size >= k:
                    kth = max(kth, int(np.partition(made, made.size - k)[made.size - k]))
                creating = bound >= kth
            doc, impact = self.doc[a:b], self.impact[a:b]
            if creating:
                held[doc] = True
            else:
                survives = held[doc]
                doc, impact = doc[survives], impact[survives]
            score[doc] += impact
        made = np.flatnonzero(held)
        return made, score[made], len(made)


@dataclass
class Best:
    """The ``k`` best of an item so far: highest score, then smallest id, ids that are null last."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    no_id: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        some = (score > 0) & (score >= self.floor)
        score, no_id, ids = (
            np.concatenate(pair)
            for pair in ((self.score, score[some]), (self.no_id, no_id[some]), (self.id, ids[some]))
        )
        best = np.lexsort((ids, no_id, -score))[: self.k]
        self.score, self.no_id, self.id = score[best], no_id[best], ids[best]


def _best_of_tasks(lists: DataFrame, queries: Broadcast, ranking: Broadcast, k: int) -> DataFrame:
    """``item_id, doc_id, score``: the ``k`` best of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = queries.value, ranking.value
        best = [Best(k) for _ in known.ids]
        for batch in batches:
            index = InvertedFile.of(
                batch.column("terms"), batch.column("counts"), batch.column("n").to_numpy(), rank
            )
            doc_id = batch.column("doc_id")
            no_id = doc_id.is_null().to_numpy(zero_copy_only=False)
            ids = doc_id.fill_null(0).to_numpy()
            for mine, order in zip(best, rank.order):
                if len(order):
                    doc, score, _ = index.accumulate(order, k, mine.floor)
                    mine.add(score, no_id[doc], ids[doc])
        for item, mine in zip(known.ids, best):
            if len(mine.score):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(mine.score), pa.int64()),
                        pa.array(mine.id, mask=mine.no_id),
                        pa.array(mine.score),
                    ],
                    ["item_id", "doc_id", "score"],
                )

    return lists.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The ``top`` best documents for each item: ``item_id, rank, doc_id, score``.

    ``docs`` are ``doc_id, text``, ``items`` ``item_id, text``. Scores are as in
    ``weight`` and ``InvertedFile``, in whole numbers, over counts of all
    documents. Equal scores rank by ``doc_id``, a null one last.

    A null or empty text, or one without a term, is found by nothing and finds
    nothing; empty tables give no rows. Repeated rows of documents are ranked
    each by itself; rows of items that share an id, also a null one, are one
    item with the terms of all. Other columns are not looked at. Texts of any
    length are read in windows.

    The terms of the items are broadcast, ``pass_bytes`` of item text a pass or
    about so much, and every pass reads the documents once. Tasks hold an
    inverted file of one batch and ``top`` documents an item.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(size / pass_bytes))
    found = []
    for number in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        queries = Queries.of([tuple(r) for r in part.collect()])  # about pass_bytes
        shared = spark.sparkContext.broadcast(queries)
        lists = stored(forward_lists(slim, shared), "forward-lists")
        documents, occurrences = lists.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = _frequencies(lists, len(queries.terms))
        ranking = spark.sparkContext.broadcast(Ranking.of(queries, df, documents, occurrences or 1))
        # Written here, so that the next pass finds no index of this one in its tasks.
        found.append(stored(_best_of_tasks(lists, shared, ranking, top), "best-of-tasks"))
        shared.unpersist()
        ranking.unpersist()

    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    some = F.row_number().over(Window.partitionBy("item_id", "group").orderBy(*order))
    return (
        reduce(DataFrame.unionAll, found)
        .withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
        .withColumn("rank", some)
        .where(F.col("rank") <= top)
        .withColumn("rank", rank)
        .where(F.col("rank") <= top)
        .select("item_id", "rank", "doc_id", "score")
    )
