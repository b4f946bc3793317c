"""WARC fixity audit: Merkle trees over records and offset ranges of two replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankforge.llm.common import stored

FANOUT = 16


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """A response record as binary; a null url has no header, a null payload no bytes."""
    body = F.coalesce(payload.cast("string"), F.lit(""))
    uri = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\n"),
        uri,
        F.lit("Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    ).cast("binary")


def leaves(records: DataFrame) -> DataFrame:
    """``archive, record_id, length, copies, hash`` of ``archive, record_id, record``.

    SHA-256 of the record's bytes; a null record has the word ``null`` for it. Copies under one id, which a sound archive
    has none of, make one leaf whose hash depends on all their bytes in any
    order, and adds up on the map side.
    """
    hashed = records.select(
        "archive",
        "record_id",
        F.coalesce(F.octet_length("record"), F.lit(0)).cast("long").alias("length"),
        F.coalesce(F.sha2(F.col("record"), 256), F.lit("null")).alias("hash"),
    )
    part = F.coalesce(F.conv(F.substring("hash", 1, 12), 16, 10), F.lit("0")).cast("decimal(20,0)")
    several = F.concat_ws(
        ":", F.min("hash"), F.max("hash"), F.count("hash").cast("string"), F.sum(part).cast("string")
    )
    return hashed.groupBy("archive", "record_id").agg(
        F.sum("length").alias("length"),
        F.count(F.lit(1)).alias("copies"),
        F.when(F.count("hash") == 1, F.min("hash")).otherwise(F.sha2(several, 256)).alias("hash"),
    )


def catalog(of: DataFrame) -> DataFrame:
    """Leaves in id order: adds ``node`` (0 and up in its archive) and ``start``, the offset.

    An archive is one file, so its records fit one window.
    """
    before = Window.partitionBy("archive").orderBy(F.col("record_id").asc_nulls_first())
    ahead = before.rowsBetween(Window.unboundedPreceding, -1)
    return of.select(
        "*",
        (F.row_number().over(before) - 1).cast("long").alias("node"),
        F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("start"),
    )


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above: ``archive, node, hash`` over the children in order.

    A child is hashed with its place, so one that is missing changes the hash.
    """
    child = F.struct("node", F.concat_ws(":", F.col("node").cast("string"), "hash").alias("hash"))
    return (
        level.groupBy("archive", F.expr(f"node div {fanout}").alias("up"))
        .agg(F.sort_array(F.collect_list(child)).alias("children"))  # fanout of them at most
        .select(
            "archive",
            F.col("up").alias("node"),
            F.sha2(F.array_join("children.hash", "|"), 256).alias("hash"),
        )
    )


def _mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("archive", "node", F.col("hash").alias("found"))
    both = a.select("archive", "node", "hash").join(other, ["archive", "node"], "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("found")))


def audit(original: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records on which two replicas differ, found by descending from the roots.

    Both inputs are ``archive, record_id, record``; null ids and archives are
    values like others, apart from empty ones, and a null record equals a null
    record only. Returns ``archive, record_id, start, length`` (the range in the
    original), ``fault`` (``altered``, ``missing``, or ``extra``, with no range),
    ``expected`` and ``found``. Equal replicas, and two empty ones, give no rows.

    A record's place in the tree is its place in the original's catalog, so a
    record that is lost or added spoils its own branch only. The trees meet at
    the root of each archive; a level is read again only below the nodes that
    differ one level up.
    """
    def keyed(records: DataFrame) -> DataFrame:
        return records.select(
            # A letter ahead keeps a null archive, which joins, apart from an empty one.
            F.coalesce(F.concat(F.lit("a"), F.col("archive").cast("string")), F.lit("")).alias("archive"),
            "record_id",
            F.col("record").cast("binary").alias("record"),
        )

    index = stored(catalog(leaves(keyed(original))), "catalog")
    ids = index["record_id"]
    other = leaves(keyed(replica)).select(
        F.col("archive").alias("in_archive"), F.col("record_id").alias("of"), F.col("hash")
    )
    placed = stored(
        other.join(
            index.select("archive", "record_id", "node"),
            (F.col("in_archive") == F.col("archive")) & F.col("of").eqNullSafe(ids),
            "left",
        ).select(F.col("in_archive").alias("archive"), F.col("of").alias("record_id"), "node", "hash"),
        "replica",
    )
    known = placed.where(F.col("node").isNotNull())
    depth = 0
    nodes = (index.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        nodes = -(-nodes // fanout)
        depth += 1
    trees = [(index.select("archive", "node", "hash"), known.select("archive", "node", "hash"))]
    for _ in range(depth):
        trees.append(tuple(stored(parents(level, fanout), "tree") for level in trees[-1]))

    wrong = _mismatches(*trees[-1]).select("archive", "node")
    for level in reversed(trees[:-1]):
        above = stored(wrong.withColumnRenamed("node", "up"), "mismatches")
        below = [
            t.withColumn("up", F.expr(f"node div {fanout}")).join(above, ["archive", "up"], "left_semi")
            for t in level
        ]
        wrong = _mismatches(*below)
    if depth == 0:
        wrong = _mismatches(*trees[0])
    changed = wrong.join(index.drop("hash"), ["archive", "node"]).select(
        "archive", "record_id", "start", "length",
        F.when(F.col("found").isNull(), "missing").otherwise("altered").alias("fault"),
        F.col("hash").alias("expected"), "found",
    )
    extra = placed.where(F.col("node").isNull()).select(
        "archive", "record_id", F.lit(None).cast("long").alias("start"),
        F.lit(None).cast("long").alias("length"), F.lit("extra").alias("fault"),
        F.lit(None).cast("string").alias("expected"), F.col("hash").alias("found"),
    )
    archive = F.when(F.col("archive") != "", F.expr("substring(archive, 2)"))
    return changed.unionAll(extra).withColumn("archive", archive)


def damaged(records: DataFrame, mark: Column) -> DataFrame:
    """A replica with damage by ``mark``, for trials.

    ``0a`` changes the last byte, ``0b`` cuts the record in half, ``0c`` loses
    it, ``0d`` adds a record with the id ``-1 - id``.
    """
    record = (
        F.when(mark == "0a", F.concat(F.expr("substring(record, 1, octet_length(record) - 1)"), F.lit("x").cast("binary")))
        .when(mark == "0b", F.expr("substring(record, 1, octet_length(record) div 2)"))
        .otherwise(F.col("record"))
    )
    kept = records.where(~mark.eqNullSafe(F.lit("0c"))).withColumn("record", record)
    added = records.where(mark == "0d").withColumn("record_id", -1 - F.col("record_id"))
    return kept.unionAll(added)
