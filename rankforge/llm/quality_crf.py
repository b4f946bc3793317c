"""Quality classifier: a linear-chain CRF labels lines, their marginals make the score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import filtered, sampled_texts, slices, texts_of
from rankforge.llm.word_hashes import joined, word_hashes

# The fit takes the lines of so many labelled documents at most, those with the
# smallest hash of their id, and so many passes over them.
SAMPLE_DOCS = 2000
PASSES = 100
_RATE, _DECAY = 0.1, 1e-3
OWN = 13  # features of a line by itself
_SYMBOLS = b"#$%&*@^~<>{}[]=+\\_"


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, length and features of every line that is not blank.

    The features are those of the line, then of the line before and behind it
    in its text (zero at the ends), and a one.
    """
    data, starts = joined(texts)
    word_start, word_end, hashes = word_hashes(data)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 3 * OWN + 1))
    breaks = np.flatnonzero(data == 10)
    line_of_word = np.searchsorted(breaks, word_start)
    line, lines = pd.factorize(line_of_word)  # of words in order, so lines ascend
    first = np.append(0, np.flatnonzero(np.diff(line)) + 1)
    n = len(lines)
    words = np.bincount(line, minlength=n).astype(float)
    begin, end = word_start[first], word_end[np.append(first[1:], len(line)) - 1]
    of = np.searchsorted(starts, begin, side="right") - 1
    size = (end - begin).astype(float)

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask, dtype=np.int64))
        return (total[end] - total[begin]).astype(float)

    upper = per_line((data >= 65) & (data <= 90))
    lower = per_line((data >= 97) & (data <= 122))
    digits = per_line((data >= 48) & (data <= 57))
    bangs = per_line((data == 33) | (data == 63))
    bars = per_line(data == 124)
    symbols = per_line(np.isin(data, np.frombuffer(_SYMBOLS, np.uint8)))
    stops = per_line((data == 46) | (data == 44))

    def repeats(distance: int) -> np.ndarray:
        same = np.zeros(len(line), bool)
        same[distance:] = (hashes[distance:] == hashes[:-distance]) & (line[distance:] == line[:-distance])
        return np.bincount(line[same], minlength=n) / words

    seen = pd.Series(hashes ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).duplicated()
    again = np.bincount(line[seen.to_numpy()], minlength=n) / words
    place = np.arange(len(line)) - first[line]
    mark = np.add.reduceat(hashes * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), first)
    text_mark = of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    known_line = pd.Series(mark ^ text_mark).duplicated(keep=False).to_numpy().astype(float)
    own = np.stack(
        [
            upper / np.maximum(upper + lower, 1),
            digits / size,
            np.minimum(bangs / words, 2),
            np.minimum(bars / words, 2),
            np.minimum(symbols / words, 4),
            np.minimum(stops / words, 1),
            repeats(1),
            repeats(2),
            again,
            again * np.log1p(words) / 5,
            known_line,
            np.log1p(words) / 5,
            np.log1p(size / words) / 3,
        ],
        axis=1,
    )
    before, behind = np.zeros_like(own), np.zeros_like(own)
    same_text = of[1:] == of[:-1]
    before[1:][same_text] = own[:-1][same_text]
    behind[:-1][same_text] = own[1:][same_text]
    return of, size, np.concatenate([own, before, behind, np.ones((n, 1))], axis=1)


@dataclass(frozen=True)
class LineModel:
    """Weights of a good line, scores of label pairs, and how a document's share maps to a score."""

    weights: np.ndarray
    pairs: np.ndarray
    slope: float
    offset: float


def forward_backward(
    energy: np.ndarray, of: np.ndarray, pairs: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of a good line, and expected counts of label pairs.

    ``energy`` is the score of good over bad. All texts advance together, one
    line a step, longest texts first, so a step touches only texts that have it.
    """
    n = len(energy)
    first = np.append(0, np.flatnonzero(np.diff(of)) + 1)
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    unary = np.stack([np.zeros(n), energy], 1)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    steps = int(length[0]) if len(length) else 0
    # Texts that have at least so many lines.
    alive = np.searchsorted(-length, -np.arange(steps), side="left")
    for t in range(steps):
        at = first[: alive[t]] + t
        if not t:
            forward[at] = unary[at]
            continue
        into = forward[at - 1][:, :, None] + pairs[None]
        forward[at] = np.logaddexp(into[:, 0], into[:, 1]) + unary[at]
    for t in range(steps - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        out = pairs[None] + (unary[at + 1] + backward[at + 1])[:, None, :]
        backward[at] = np.logaddexp(out[:, :, 0], out[:, :, 1])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.flatnonzero(of[1:] == of[:-1])
    joint = (
        forward[inner][:, :, None] + pairs[None]
        + (unary[inner + 1] + backward[inner + 1])[:, None, :] - total[inner][:, None, None]
    )
    return good, np.exp(joint).sum(0)


def fit_lines(of: np.ndarray, x: np.ndarray, size: np.ndarray, label: np.ndarray) -> LineModel:
    """Maximum likelihood with every line labelled as its document.

    ``label`` is 0 or 1 for each line. Then a logistic fit of the documents'
    labels on their length-weighted marginals gives the score.
    """
    weights, pairs = np.zeros(x.shape[1]), np.zeros((2, 2))
    if not len(of):
        return LineModel(weights, pairs, 1.0, 0.0)
    inner = np.flatnonzero(of[1:] == of[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner], label[inner + 1]), 1.0)
    target = x.T @ label
    moment = [np.zeros_like(weights), np.zeros_like(pairs)]
    square = [np.zeros_like(weights), np.zeros_like(pairs)]
    for step in range(1, PASSES + 1):
        good, counts = forward_backward(x @ weights, of, pairs)
        slopes = [(target - x.T @ good) / len(of) - _DECAY * weights, (seen - counts) / len(of) - _DECAY * pairs]
        for k, (value, slope) in enumerate(zip((weights, pairs), slopes)):
            moment[k] = 0.9 * moment[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope * slope
            value += _RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    good, _ = forward_backward(x @ weights, of, pairs)
    share, first = document_share(of, size, good)
    truth = label[first].astype(float)
    # Two pseudo-documents of each label keep the slope finite on clean splits.
    s = np.concatenate([_logit(share), _logit(np.array([1.0, 0.0, 0.5, 0.5]))])
    y = np.concatenate([truth, [1.0, 0.0, 1.0, 0.0]])
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * s + offset)))
        w = p * (1 - p) + 1e-6
        hessian = np.array([[(w * s * s).sum(), (w * s).sum()], [(w * s).sum(), w.sum()]])
        slope, offset = np.array([slope, offset]) + 0.5 * np.linalg.solve(
            hessian + 1e-6 * np.eye(2), [((y - p) * s).sum(), (y - p).sum()]
        )
    return LineModel(weights, pairs, float(slope), float(offset))


def document_share(of: np.ndarray, size: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length-weighted mean of the marginals of each text, and its first line."""
    first = np.append(0, np.flatnonzero(np.diff(of)) + 1)
    return np.add.reduceat(size * good, first) / np.add.reduceat(size, first), first


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share) - np.log1p(-share)


def learn_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LineModel:
    """Fit on ``docs`` and ``labels`` (``doc_id, quality``).

    A document with several labels counts as good if their mean is at least
    half; null labels and ids are left out. At most ``sample_docs`` labelled
    documents are taken: half of them good and half bad where there are as
    many, by a hash of the id. The driver gets the line features of these, never
    texts. Without a labelled line every score is 0.5.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    )
    rows = sampled_texts(docs, known, "quality", sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of, size, x = line_features(texts_of(batch))
            label = np.array(batch.column("quality").to_pylist(), np.int64)
            ids = np.array(batch.column("doc_id").to_pylist(), np.int64)
            values = [
                x[of == i].astype("<f4").tobytes() for i in range(len(ids))
            ]
            sizes = [size[of == i].astype("<f8").tobytes() for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(label), pa.array(sizes, pa.binary()), pa.array(values, pa.binary())],
                ["doc_id", "quality", "sizes", "x"],
            )

    got = rows.mapInArrow(run, "doc_id long, quality long, sizes binary, x binary").collect()
    got = sorted((r for r in got if r["sizes"]), key=lambda r: (r["doc_id"], r["x"]))
    sizes = [np.frombuffer(r["sizes"], "<f8") for r in got]
    if not sizes:
        return fit_lines(np.zeros(0, np.int64), np.zeros((0, 3 * OWN + 1)), np.zeros(0), np.zeros(0, np.int64))
    counts = [len(s) for s in sizes]
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, 3 * OWN + 1) for r in got]).astype(float)
    of = np.repeat(np.arange(len(got)), counts)
    return fit_lines(of, x, np.concatenate(sizes), np.repeat([r["quality"] for r in got], counts))


def score_texts(texts: list[str], m: LineModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text, its number of lines, and how many of them are good."""
    n = len(texts)
    score, good = np.zeros(n), np.zeros(0)
    of, size, x = line_features(texts)
    if len(of):
        good, _ = forward_backward(x @ m.weights, of, m.pairs)
        share, first = document_share(of, size, good)
        score[of[first]] = 1 / (1 + np.exp(-(m.slope * _logit(share) + m.offset)))
    lines = np.bincount(of, minlength=n)
    return score, lines, np.bincount(of, weights=good >= 0.5, minlength=n).astype(np.int64)


def score_quality(docs: DataFrame, model: LineModel) -> DataFrame:
    """``doc_id, score, lines, good_lines``: the calibrated score, higher is better.

    ``good_lines`` counts lines with a marginal of a half or more. Blank lines do
    not count; a null text, or one without words, has no lines and score 0. Rows
    stay, also repeated ones; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = score_texts(texts_of(batch), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns)],
                ["doc_id", "score", "lines", "good_lines"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, lines long, good_lines long")


def keep_good(docs: DataFrame, model: LineModel, least: float) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda: lambda texts: score_texts(texts, shared.value)[0] >= least)
