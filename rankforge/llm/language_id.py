"""Language ID by hyperdimensional profiles: permuted letters, bound, bundled, compared."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import filtered, slices, texts_of

DIMENSIONS = 1024
UNDETERMINED = "und"
# Sums of a language meet in so many groups before they are added up.
SUM_GROUPS = 64
# Rows of one product of counts and n-gram vectors.
_ROWS, _COLUMNS = 64, 8192
_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter(
        (unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000
    )


@lru_cache(maxsize=1 << 16)
def _letter_vector(code: int, dims: int) -> np.ndarray:
    return np.random.default_rng([code, dims]).integers(0, 2, dims, dtype=np.int8) * 2 - 1


def ngram_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """One vector for each trigram: its letters, shifted by their place, multiplied."""
    out = np.ones((len(codes), dims), np.int8)
    for place in range(3):
        letter = (codes >> np.int64(21 * (2 - place))) & np.int64(0x1FFFFF)
        which, values = pd.factorize(letter)
        vectors = np.stack([np.roll(_letter_vector(int(v), dims), 2 - place) for v in values])
        out *= vectors[which]
    return out.astype(np.float32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and packed code points of every trigram of letters and word ends.

    Lower-cased; everything that is no letter is a word end, and runs of those
    are one. Texts without a letter have none.
    """
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letters()[codes]
    codes[~letter] = _SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of ends
    keep[0] = True
    keep[1:] |= of[1:] != of[:-1]
    codes, of = codes[keep], of[keep]
    if len(codes) < 3:
        return of[:0], codes[:0]
    packed = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    whole = (of[:-2] == of[2:]) & (codes[1:-1] != _SPACE)
    return of[:-2][whole], packed[whole]


def bundle(rows: int, of: np.ndarray, packed: np.ndarray, dims: int) -> np.ndarray:
    """The sum of the n-gram vectors of each row."""
    out = np.zeros((rows, dims), np.float32)
    which, values = pd.factorize(packed)
    for at in range(0, len(values), _COLUMNS):
        inside = (which >= at) & (which < at + _COLUMNS)
        vectors = ngram_vectors(values[at : at + _COLUMNS], dims)
        width = len(vectors)
        of_in, which_in = of[inside], which[inside] - at
        for low in range(0, rows, _ROWS):
            lo, hi = np.searchsorted(of_in, (low, low + _ROWS))
            if lo == hi:
                continue
            cells = (of_in[lo:hi] - low) * width + which_in[lo:hi]
            count = min(_ROWS, rows - low)
            counts = np.bincount(cells, minlength=count * width).reshape(count, width)
            out[low : low + count] += counts.astype(np.float32) @ vectors
    return out


@dataclass(frozen=True)
class Profiles:
    """Language prototypes of unit length, in order of language."""

    languages: list[str]
    vectors: np.ndarray


def learn_profiles(docs: DataFrame, dims: int = DIMENSIONS, lang: str = "lang") -> Profiles:
    """Bundle all texts of each value of ``lang``; rows with a null there are left out.

    Every task adds up its own languages, and the sums are added in Spark; the
    driver gets one vector of ``dims`` numbers for each language. Languages whose
    texts have no letter are not learned; without any, nothing is.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            labels = batch.column("lang").to_pylist()
            number, names = pd.factorize(np.array(labels, dtype=object))
            of, packed = trigrams(texts_of(batch))
            order = np.argsort(number[of], kind="stable")
            part = bundle(len(names), number[of][order], packed[order], dims)
            for name, vector in zip(names, part):
                sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            ["lang", "vector"],
        )

    def total(table: pa.Table) -> pa.Table:
        vectors = np.array(table.column("vector").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "vector": [vectors.sum(0).tolist()]})

    schema = "lang string, vector array<double>"
    rows = (
        docs.where(F.col(lang).isNotNull())
        .select(F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        .mapInArrow(add, schema)
        .groupBy("lang", F.pmod(F.monotonically_increasing_id(), F.lit(SUM_GROUPS)).alias("part"))
        .applyInArrow(total, schema)
        .groupBy("lang")
        .applyInArrow(total, schema)
        .collect()
    )
    found = sorted((r["lang"], np.array(r["vector"])) for r in rows if np.any(r["vector"]))
    vectors = np.array([v / np.linalg.norm(v) for _, v in found])
    return Profiles([name for name, _ in found], vectors.astype(np.float32))


def predict(texts: list[str], known: Profiles) -> tuple[list[str], np.ndarray]:
    """Language and cosine of each text."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    of, packed = trigrams(texts)
    if len(of) and known.languages:
        sums = bundle(len(texts), of, packed, known.vectors.shape[1])
        length = np.linalg.norm(sums, axis=1)
        cosine = (sums @ known.vectors.T) / np.maximum(length, 1e-9)[:, None]
        best = cosine.argmax(1)
        for i in np.unique(of).tolist():
            names[i] = known.languages[best[i]]
            scores[i] = min(1.0, max(0.0, float(cosine[i, best[i]])))
    return names, scores


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score``: the prototype with the largest cosine, and that.

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text if no language was learned. Of equal cosines the first language
    in alphabetical order wins. A negative cosine counts as 0. Rows stay, also
    repeated ones; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # languages times dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = predict(texts_of(batch), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)],
                ["doc_id", "lang_pred", "score"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, least: float) -> DataFrame:
    """The rows of ``docs`` with a language whose score is at least ``least``, as they are.

    What ``identify`` calls ``und`` goes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def keep():
        def decide(texts: list[str]) -> np.ndarray:
            names, scores = predict(texts, shared.value)
            return (np.array(names, object) != UNDETERMINED) & (scores >= least)

        return decide

    return filtered(docs, keep)
