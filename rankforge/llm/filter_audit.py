"""Filter interaction audit: survival words and carry-save positional popcounts.

A document becomes a 32-bit word: bit S is set if it survives all filters of the
subset S. How many words have bit S set is how many documents S leaves, and from
those 32 counts follows what every filter does in every order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import slices, stored
from rankforge.llm.windows import windows

# Five filters have 32 subsets, one for each bit of a word.
MOST_FILTERS = 5

# The text filters and what a document fails each by.
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
MARKS = b"#$%&*|"

_WHITE = re.compile(rb"[\x20\x09-\x0d]+")
_CAPITALS = bytes(range(65, 91))


def word_counts(data: bytes) -> tuple[int, int]:
    """Words and distinct words; in texts of several windows 64-bit hashes tell words apart."""
    total, seen = 0, []
    for window in windows(data, _WHITE):
        words = window.split()  # at ASCII white space
        total += len(words)
        seen.append(set(words))
        if len(seen) > 1 or len(window) < len(data):
            seen[-1] = np.fromiter(map(hash, seen[-1]), np.int64, len(seen[-1]))
    if len(seen) == 1:
        return total, len(seen[0])
    return total, len(np.unique(np.concatenate(seen)))


def text_failures(text: str) -> int:
    """Bits 0 to 3: too few words, too repetitive, too many capitals, holds marks."""
    data = text.encode("utf-8", "surrogatepass")
    words, distinct = word_counts(data)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (
        (words < LEAST_WORDS)
        | (100 * distinct < LEAST_DISTINCT_PERCENT * words) << 1
        | (100 * capitals > MOST_CAPITALS_PERCENT * len(text)) << 2
        | (len(data.translate(None, MARKS)) < len(data)) << 3
    )


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``doc_id, part, fails`` of every row: bits 0 to 3 of the text, bit 4 for a copy.

    A copy has the same text as a row with a smaller ``doc_id``, anywhere in
    ``docs``; 128-bit digests stand for the texts. A null text is an empty one, a
    null part the empty string. Rows without an id are no copies and make none;
    rows that share an id are no copies of each other.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fails, keys = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                fails.append(text_failures(text))
                keys.append(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(keys, pa.binary()), pa.array(fails, pa.int32())],
                ["doc_id", "part", "text_key", "fails"],
            )

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("string").alias("text"),
    )
    judged = stored(
        slim.mapInArrow(judge, "doc_id long, part string, text_key binary, fails int"), "failures"
    )
    firsts = (
        judged.groupBy("text_key")
        .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .where("first_id < last_id")
    )
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return judged.join(firsts.drop("last_id"), "text_key", "left").select(
        "doc_id", "part", F.col("fails").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("fails")
    )


def survival_words(fails: np.ndarray, filters: int = MOST_FILTERS) -> np.ndarray:
    """Word of each document, given which filters it fails by itself."""
    subsets = np.arange(1 << filters)
    survives = (subsets[:, None] & subsets[None, :]) == 0
    words = np.bitwise_or.reduce(survives.astype(np.uint32) << subsets.astype(np.uint32), axis=1)
    return words[fails]


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set, by carry-save adders.

    A full adder turns three words of one weight into a sum word of that weight
    and a carry word of twice the weight, for all 32 positions at once, until at
    most two words of each weight are left to be counted bit by bit.
    """
    counts, weight, level = np.zeros(32, np.int64), 1, words.astype(np.uint32)
    places = np.arange(32, dtype=np.uint32)
    while len(level):
        carries = []
        while len(level) >= 3:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate((half ^ c, level[3 * third :]))
        counts += weight * ((level[:, None] >> places) & 1).sum(0, dtype=np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return counts


def subset_survivors(flagged: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """``part, subset, kept`` and, for each boolean column of ``groups``, its share of ``kept``.

    ``flagged`` has ``part string``, ``fails int`` with a bit a filter, and the
    columns of ``groups``, where null counts as false. Tasks count what they
    read, so 32 rows a part and batch are shuffled, however large a part is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = survival_words(batch.column("fails").to_numpy())
            member = [np.ones(len(words), bool)] + [
                batch.column(g).fill_null(False).to_numpy(zero_copy_only=False) for g in groups
            ]
            of, parts = pd.factorize(batch.column("part").to_pandas())
            found = [
                [positional_popcount(words[(of == p) & m]) for m in member] for p in range(len(parts))
            ]
            if not found:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(parts.to_numpy(), 32), pa.string()),
                    pa.array(np.tile(np.arange(32), len(parts)), pa.int32()),
                    *(pa.array(np.concatenate([f[i] for f in found])) for i in range(len(member))),
                ],
                ["part", "subset", "kept", *groups],
            )

    measures = ["kept", *groups]
    schema = "part string, subset int, " + ", ".join(f"{m} long" for m in measures)
    slim = flagged.select("part", "fails", *groups)
    counted = slim.mapInArrow(count, schema)
    return counted.groupBy("part", "subset").agg(*(F.sum(m).alias(m) for m in measures))


def interactions(survivors: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """What each filter does in every order, one row per part, order and step.

    Takes ``subset_survivors`` with groups ``good`` and ``toxic``. ``filters``
    names the bits, smallest first, a letter each.
    """
    orders = ["".join(p) for p in permutations(filters)]
    every = (1 << len(filters)) - 1

    def mask(upto: Column) -> Column:
        """Subset of the filters at the first ``upto`` places of the order."""
        total = F.lit(0)
        for i, name in enumerate(filters):
            total = total + F.when(F.locate(name, F.col("filter_order")) <= upto, 1 << i).otherwise(0)
        return total

    counts = survivors.groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("of")
    )  # 32 structs a part
    steps = (
        counts.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " ")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
        .withColumn("before", mask(F.col("step") - 1))
        .withColumn("after", mask(F.col("step")))
    )

    def of(subset: Column | int, measure: str) -> Column:
        return F.get("of", subset if isinstance(subset, Column) else F.lit(subset))[measure]

    before, after = F.col("before"), F.col("after")
    own = after - before
    removed = of(before, "kept") - of(after, "kept")
    by_filter = Window.partitionBy("part", own)  # a row for each order
    return steps.select(
        "part",
        "filter_order",
        "step",
        of(after, "kept").alias("kept"),
        removed.alias("removed"),
        (of(0, "kept") - of(own, "kept") - removed).alias("redundant"),
        (of(F.lit(every) - own, "kept") - of(every, "kept")).alias("unique_fails"),
        (of(before, "good") - of(after, "good")).alias("good_lost"),
        (of(before, "toxic") - of(after, "toxic")).alias("toxic_lost"),
        F.sum(removed).over(by_filter).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The five text filters over ``docs`` in all 120 orders, for each value of ``part``.

    ``labels`` are ``doc_id, quality, toxic``; of several rows for one id the
    largest values count, and rows without an id play no part. Empty ``docs``
    give no rows. Very long texts are read in windows; other columns are not
    looked at. See ``failures`` for nulls, copies and ties.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    )
    flagged = failures(docs, part).join(known, "doc_id", "left")
    return interactions(subset_survivors(flagged, ("good", "toxic")))
