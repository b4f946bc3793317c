"""Benchmark decontamination: greedy string tiling from shared-token seeds."""

from __future__ import annotations

import heapq
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import filtered, slices, texts_of
from rankforge.llm.word_hashes import joined, letters_and_digits, mix, word_hashes

# Shortest tile, in words, and the share of a test item that tiles must cover.
TILE_WORDS = 4
COVERAGE = 0.7
# Bytes of test items that are broadcast at once; more take one more pass each.
PASS_BYTES = 32 << 20
# With more pairs of equal seeds between a text and an item than this, which only
# repeated words make, lengths are searched in place of pairs; the tiles are the same.
PAIRS = 1 << 16

# Letters of Thai to Burmese, Khmer, Kana, and Han.
_LETTERS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{_LETTERS}]")
_BEYOND = re.compile(f"[{_LETTERS}]|[^\\x00-\\x7f\\w]")

SCHEMA = (
    "doc_id long, item_id long, item_words long, covered long, coverage double, "
    "tiles array<struct<item_at: int, doc_at: int, words: int>>"
)


def tokens(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the lower-cased words of each text.

    Words are letters, digits and the marks on them, of any script; a letter of a
    script that is written without spaces is a word by itself.
    """
    data, starts = joined([_spaced(t.lower()) for t in texts])
    start, _, hashes = word_hashes(data, letters_and_digits())
    bounds = np.searchsorted(start, starts)
    return [hashes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _spaced(text: str) -> str:
    """The text with spaces for what is no part of a word, beyond ASCII, and around unspaced letters."""
    if text.isascii() or not _BEYOND.search(text):
        return text
    return _BEYOND.sub(_apart, text)


def _apart(found: re.Match[str]) -> str:
    char = found[0]
    if _UNSPACED.match(char):
        return f" {char} "
    return char if unicodedata.category(char)[0] == "M" else " "


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(size):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + words[i : n + i]
    return mix(acc)


def tiling(item: np.ndarray, doc: np.ndarray, hits: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(item_at, doc_at, words)`` from the seed hits ``[item_at, doc_at]``.

    The longest match goes first, of equal ones the first in the item, then in
    the text; what is marked is cut from the others, whose rests stay in the
    race while they are at least ``size`` long.
    """
    equal = np.ones(len(hits), bool)
    for i in range(size):  # the hash only proposes
        equal &= item[hits[:, 0] + i] == doc[hits[:, 1] + i]
    hits = hits[equal]
    diagonal = hits[:, 1] - hits[:, 0]
    order = np.lexsort((hits[:, 0], diagonal))
    hits, diagonal = hits[order], diagonal[order]
    # Neighbouring hits on a diagonal are one longer match.
    fresh = np.ones(len(hits), bool)
    fresh[1:] = (diagonal[1:] != diagonal[:-1]) | (hits[1:, 0] != hits[:-1, 0] + 1)
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(hits))) + size - 1
    queue = [(-n, p, t) for n, (p, t) in zip(length.tolist(), hits[first].tolist())]
    heapq.heapify(queue)
    in_item = np.zeros(len(item), bool)
    in_doc: set[int] = set()
    tiles = []
    while queue:
        n, p, t = heapq.heappop(queue)
        free = [not in_item[p + i] and t + i not in in_doc for i in range(-n)]
        if all(free):
            tiles.append((p, t, -n))
            in_item[p : p - n] = True
            in_doc.update(range(t, t - n))
            continue
        at = 0
        for i in range(-n + 1):
            if i == -n or not free[i]:
                if i - at >= size:
                    heapq.heappush(queue, (at - i, p + at, t + at))
                at = i + 1
    return sorted(tiles)


class Runs:
    """Hashes of the runs of any length in a list of words, and which of them are free."""

    _BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        n = len(words)
        power, back = (np.full(n + 1, np.uint64(b)) for b in (self._BASE, pow(self._BASE, -1, 1 << 64)))
        power[0] = back[0] = 1
        self.words, self.starts = words, starts
        self.back = np.multiply.accumulate(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words) * np.multiply.accumulate(power)[:-1], out=self.sums[1:])
        self.marked = np.zeros(n, bool)

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the free runs of this length that start with a seed."""
        marks = np.append(0, np.cumsum(self.marked))
        at = self.starts[self.starts + length <= len(self.words)]
        at = at[marks[at + length] == marks[at]]
        return at, (self.sums[at + length] - self.sums[at]) * self.back[at]


def tiling_by_length(
    item: np.ndarray, doc: np.ndarray, item_at: np.ndarray, doc_at: np.ndarray, size: int
) -> list[tuple[int, int, int]]:
    """The tiles of ``tiling`` from the places of seeds, ascending, without their pairs.

    The longest length that a free run of both has is found by halving, as a
    common run contains common runs of all smaller lengths; then all tiles of
    that length are marked.
    """
    ours, theirs = Runs(item, item_at), Runs(doc, doc_at)

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (p, of_p), (t, of_t) = ours.of(length), theirs.of(length)
        known = np.sort(of_p)
        in_item = known[np.minimum(np.searchsorted(known, of_t), len(known) - 1)] == of_t if len(p) else of_t != of_t
        return p, of_p, t[in_item], of_t[in_item]

    tiles = []
    longest = min(len(item), len(doc))
    while longest >= size:
        low, high = size - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[2]):
                low = middle
            else:
                high = middle - 1
        if low < size:
            break
        p, of_p, t, of_t = common(low)
        order = np.argsort(of_t, kind="stable")
        t, of_t = t[order], of_t[order]
        first = np.searchsorted(of_t, of_p, side="left")
        last = np.searchsorted(of_t, of_p, side="right")
        # What is marked stays so: of equal runs those looked at need no second look.
        upto: dict[int, int] = {}
        for at, lo, hi in zip(p.tolist(), first.tolist(), last.tolist()):
            if lo == hi or ours.marked[at : at + low].any():
                continue
            i = upto.get(lo, lo)
            while i < hi and theirs.marked[t[i] : t[i] + low].any():
                i += 1
            upto[lo] = i
            for j in range(i, hi):  # the hash only proposes
                to = int(t[j])
                if (item[at : at + low] == doc[to : to + low]).all() and not theirs.marked[to : to + low].any():
                    tiles.append((at, to, low))
                    ours.marked[at : at + low] = theirs.marked[to : to + low] = True
                    break
        longest = low - 1
    return sorted(tiles)


@dataclass
class Index:
    """Seeds of the test items: hash of a run of words to the items and places it is at."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @staticmethod
    def of(ids: list[int | None], texts: list[str], size: int) -> Index:
        index = Index(ids, tokens(texts))
        parts: dict[int, list] = {}
        for i, words in enumerate(index.words):
            # An item shorter than a tile is one seed as a whole.
            length = min(size, len(words))
            if length:
                hashes = rolling(words, length)
                parts.setdefault(length, []).append(
                    (hashes, np.full(len(hashes), i), np.arange(len(hashes)))
                )
        for length, found in parts.items():
            hashes, items, places = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(hashes, kind="stable")
            index.seeds[length] = (hashes[order], items[order], places[order])
        return index

    def overlaps(self, doc: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Items that share a seed with the text, and their tiles."""
        for length, (hashes, items, places) in self.seeds.items():
            grams = rolling(doc, length)
            lo = np.searchsorted(hashes, grams, side="left")
            hit = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == grams)
            if not len(hit):
                continue
            # Each seed once, with the places that it has in the text.
            grams, lo = grams[hit], lo[hit]
            order = np.argsort(grams, kind="stable")
            first = np.flatnonzero(np.diff(grams[order], prepend=~grams[order][:1]))
            places_in_doc, times = hit[order], np.diff(np.append(first, len(hit)))
            low = lo[order][first]
            count = np.searchsorted(hashes, grams[order][first], side="right") - low
            ends = np.cumsum(count)
            entry = np.repeat(low - (ends - count), count) + np.arange(ends[-1])
            seed = np.repeat(np.arange(len(first)), count)
            by_item = np.argsort(items[entry], kind="stable")
            entry, seed = entry[by_item], seed[by_item]
            bounds = np.flatnonzero(np.diff(items[entry], prepend=-1)).tolist() + [len(entry)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                i = int(items[entry[a]])
                of, at = seed[a:b], places[entry[a:b]]
                each = times[of]
                if each.sum() > PAIRS:
                    wanted = np.zeros(len(first), bool)
                    wanted[of] = True
                    in_doc = np.sort(places_in_doc[np.repeat(wanted, times)])
                    tiles = tiling_by_length(self.words[i], doc, np.sort(at), in_doc, length)
                else:
                    ends = np.cumsum(each)
                    in_doc = places_in_doc[np.repeat(first[of] - (ends - each), each) + np.arange(ends[-1])]
                    pairs = np.stack([np.repeat(at, each), in_doc], axis=1)
                    tiles = tiling(self.words[i], doc, pairs, length)
                if tiles:
                    yield i, tiles


def find_overlaps(
    docs: DataFrame,
    tests: DataFrame,
    coverage: float = COVERAGE,
    tile_words: int = TILE_WORDS,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Documents that hold test items: one row for each pair that reaches ``coverage``.

    ``docs`` are ``doc_id, text``, ``tests`` ``item_id, text``. Returns
    ``doc_id, item_id, item_words, covered, coverage, tiles``. Tiles are runs of
    at least ``tile_words`` equal words, longest first, and overlap in neither
    text; as they may come in any order, a passage whose sentences were moved is
    found too. An item of fewer words must occur as a whole.

    A null or empty text on either side, or one without a letter or digit, makes
    no pair; nor do empty tables. Null ids, repeated rows and ties give rows like
    any others, one for each pair of rows. Other columns are not looked at. Words
    repeated thousands of times on both sides are searched by length, not by pairs.

    The items are broadcast, at most ``pass_bytes`` of them at once, and every
    pass reads all documents; a text is compared with items by itself, so no
    passage that many documents share gathers them anywhere.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one_pass(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            for batch in slices(batches):
                out: list[tuple] = []
                ids = batch.column("doc_id").to_pylist()
                for doc_id, words in zip(ids, tokens(texts_of(batch))):
                    for i, tiles in index.overlaps(words):
                        total = len(index.words[i])
                        covered = sum(t[2] for t in tiles)
                        if covered >= coverage * total:
                            out.append((doc_id, index.ids[i], total, covered, covered / total, tiles))
                if out:
                    columns = list(zip(*out))
                    tile = pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())])
                    marked = [[dict(zip(("item_at", "doc_at", "words"), t)) for t in ts] for ts in columns[5]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(c, pa.int64()) for c in columns[:4]),
                            pa.array(columns[4], pa.float64()),
                            pa.array(marked, pa.list_(tile)),
                        ],
                        ["doc_id", "item_id", "item_words", "covered", "coverage", "tiles"],
                    )

        return slim.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionAll, map(one_pass, _indexes(tests, tile_words, pass_bytes)))


def _indexes(tests: DataFrame, tile_words: int, pass_bytes: int) -> Iterator[Broadcast]:
    """Broadcast indexes over all items, of at most about ``pass_bytes`` of text each."""
    items = tests.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(size / pass_bytes))
    for number in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        rows = sorted(part.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        index = Index.of([r[0] for r in rows], [r[1] or "" for r in rows], tile_words)
        yield tests.sparkSession.sparkContext.broadcast(index)


def drop_contaminated(
    docs: DataFrame,
    tests: DataFrame,
    coverage: float = COVERAGE,
    tile_words: int = TILE_WORDS,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no test item, as they are."""

    def clean(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def keep():
            index: Index = shared.value

            def decide(texts: list[str]) -> list[bool]:
                return [
                    all(
                        sum(t[2] for t in tiles) < coverage * len(index.words[i])
                        for i, tiles in index.overlaps(words)
                    )
                    for words in tokens(texts)
                ]

            return decide

        return filtered(rows, keep)

    return reduce(clean, _indexes(tests, tile_words, pass_bytes), docs)
