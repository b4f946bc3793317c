"""Helpers the operators share: bounded Arrow slices, id hashes, shared tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.session import shared_dir

SLICE_ROWS = 256
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to a new folder all executors share, and read back.

    Cuts the lineage: a lost executor costs no more than reading the files again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sampled_texts(docs: DataFrame, known: DataFrame, label: str, sample_docs: int) -> DataFrame:
    """``doc_id, text, <label>`` of labelled documents, at most ``sample_docs`` rows.

    ``known`` has one row ``doc_id, <label>`` (0 or 1) for each id. Half of the
    rows are of either label where there are as many, in the order of a hash of
    the id; an id with several texts counts a row for each text, and equal rows
    count once, so the bound holds for rows and not for ids.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )

    def best(rows: DataFrame, *order: str) -> DataFrame:
        first = F.xxhash64("doc_id")
        of = [rows.where(F.col(label) == k).orderBy(first, *order).limit(sample_docs // 2) for k in (0, 1)]
        return of[0].unionAll(of[1])

    ids = best(known.select("doc_id", label), "doc_id")
    versions = texts.select("doc_id", "text_hash").join(F.broadcast(ids), "doc_id").distinct()
    picked = best(versions, "doc_id", "text_hash").select("doc_id", "text_hash", label)
    rows = texts.join(F.broadcast(picked), ["doc_id", "text_hash"])
    return rows.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text", label)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text"
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds a MB of text at most.

    A longer text is a slice of its own, so memory follows the longest text and
    not the batch.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > SLICE_BYTES or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def filtered(docs: DataFrame, keep: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows of ``docs`` whose text a function keeps; all columns stay as they are.

    ``keep`` is called once a task and gives a function from texts to booleans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = keep()
        for batch in slices(batches):
            yield batch.filter(pa.array(np.asarray(decide(texts_of(batch)), bool)))

    return docs.mapInArrow(run, docs.schema)
