"""Embedding near-dedup: cross-polytope hashes after fast Hadamard rotations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import stored
from rankforge.llm.components import connected_components
from rankforge.llm.word_hashes import mix

THRESHOLD = 0.9
# Each table joins the closest cross-polytope vertices of so many rotations to a
# bucket. In 64 dimensions a pair at cosine 0.9 meets in no bucket with a chance
# of about 1 in 1,000, measured as in tests/llm, and a closer pair with less.
TABLES, ROTATIONS, PROBES = 30, 4, 3
# More dimensions have more vertices, so a table joins a pair less often: 0.197
# of the pairs at 0.9 in 64 dimensions, 0.117 in 256. The tables grow by this power.
GROWTH = 0.4
# Vectors of one side of a comparison task; larger buckets are cut into more.
BLOCK = 1024
# Cosines and components of blocks that are compared at once.
CELLS = 1 << 20


def tables_in(dims: int, tables: int) -> int:
    """The tables for vectors of so many components; ``tables`` of them up to 64."""
    padded = 1 << max(1, (dims - 1).bit_length())
    return math.ceil(tables * max(1.0, padded / 64) ** GROWTH)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


@lru_cache(maxsize=8)
def _signs(dims: int, count: int) -> np.ndarray:
    return np.random.default_rng(dims).integers(0, 2, (count, 3, dims)) * 2.0 - 1


def bucket_keys(vectors: np.ndarray, tables: int, rotations: int, probes: int) -> np.ndarray:
    """``[row, tables * probes]`` keys; the first probe of a table is its own bucket.

    A rotation is three rounds of random signs and Hadamard; its vertex is the
    largest coordinate with its sign. The further probes exchange one vertex
    for the runner-up where the loss is smallest.
    """
    n, dims = vectors.shape
    padded = 1 << max(1, (dims - 1).bit_length())
    x = np.zeros((n, padded))
    x[:, :dims] = vectors
    signs = _signs(padded, tables * rotations)
    keys = np.zeros((n, tables, probes), np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, loss = [], [], []
        for r in range(rotations):
            y = x
            for s in signs[t * rotations + r]:
                y = hadamard(y * s)
            size = np.abs(y)
            top = size.argmax(1)
            first = size[rows, top]
            best.append((top * 2 + (y[rows, top] < 0)).astype(np.uint64))
            size[rows, top] = -1
            top = size.argmax(1)
            second.append((top * 2 + (y[rows, top] < 0)).astype(np.uint64))
            loss.append(first - size[rows, top])
        order = np.argsort(np.stack(loss, 1), axis=1, kind="stable")
        for p in range(probes):
            acc = mix(np.full(n, (dims << 20) + t, np.uint64))
            for r in range(rotations):
                swap = (order[:, p - 1] == r) if p else np.zeros(n, bool)
                acc = mix(acc ^ np.where(swap, second[r], best[r]))
            keys[:, t, p] = acc
    return keys.reshape(n, -1).view(np.int64)


def _usable(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _unit(vectors: pa.Array, dims: np.ndarray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(dims), -1)
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(nodes: DataFrame, tables: int, rotations: int, probes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                dims = np.array([len(v) for v in batch.column("vec").to_pylist()])
                for d in np.unique(dims):
                    part = batch.filter(pa.array(dims == d))
                    x = _unit(part.column("vec"), dims[dims == d])
                    keys = list(bucket_keys(x, tables_in(int(d), tables), rotations, probes))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("rep"), part.column("copies"), part.column("vec"),
                            pa.array(keys, pa.list_(pa.int64())),
                        ],
                        ["rep", "copies", "vec", "keys"],
                    )

    return nodes.mapInArrow(run, "rep long, copies long, vec array<double>, keys array<long>")


def _compare(threshold: float, probes: int):
    """Links of the rows of a partition sorted by ``key, lo, hi``, many blocks at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([rest, rows]) if rest else rows).combine_chunks()
            last = int(_starts(rows)[-1])  # the last block may go on in the next batch
            if last:
                yield _links(rows.slice(0, last), threshold, probes)
            rest = rows.slice(last)
        if rest:
            yield _links(rest, threshold, probes)

    return run


def _starts(rows: pa.Table) -> np.ndarray:
    fresh = np.ones(rows.num_rows, bool)
    fresh[1:] = False
    for name in ("key", "lo", "hi"):
        column = rows.column(name).to_numpy()
        fresh[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(fresh)


def _links(rows: pa.Table, threshold: float, probes: int) -> pa.RecordBatch:
    """``rep, n, root`` of the rows with links in whole blocks; of those one row of each block."""
    rows = rows.combine_chunks()
    rep, copies, key = (rows.column(c).to_numpy() for c in ("rep", "copies", "key"))
    first = rows.column("chunk").to_numpy() == rows.column("lo").to_numpy()
    second = rows.column("chunk").to_numpy() == rows.column("hi").to_numpy()
    vec = rows.column("vec").chunk(0)
    dims = np.diff(vec.offsets.to_numpy())
    starts = _starts(rows)
    sizes = np.diff(np.append(starts, len(rep)))
    pairs = []
    # Blocks of one size are compared at once, in parts of so many products.
    for size, d in sorted(set(zip(sizes.tolist(), dims[starts].tolist()))):
        group = starts[(sizes == size) & (dims[starts] == d)]
        step = max(1, CELLS // (size * max(size, d)))
        for at in range(0, len(group), step):
            place = group[at : at + step, None] + np.arange(size)
            x = _unit(vec.take(pa.array(place.ravel())), place.ravel()).reshape(*place.shape, d)
            if step == 1 and not (first[place] & second[place]).any():
                a, b = np.flatnonzero(first[place[0]]), np.flatnonzero(second[place[0]])
                i, j = np.nonzero(x[0, a] @ x[0, b].T >= threshold)
                pairs.append((place[0, a[i]], place[0, b[j]]))
                continue
            linked = x @ x.transpose(0, 2, 1) >= threshold
            linked &= first[place][:, :, None] & second[place][:, None, :]
            # Within one chunk each pair is seen from both sides.
            both = first[place] & second[place]
            linked &= ~(both[:, :, None] & both[:, None, :]) | np.triu(np.ones((size, size), bool), 1)
            g, i, j = np.nonzero(linked)
            pairs.append((place[g, i], place[g, j]))
    i, j = (np.concatenate(side) for side in zip(*pairs))
    keys = rows.column("keys").chunk(0)
    offset = keys.offsets.to_numpy()
    flat = keys.values.to_numpy()
    links = np.zeros(len(rep), np.int64)
    width = np.diff(offset)
    for at in range(0, len(i), 8192):
        p, q = i[at : at + 8192], j[at : at + 8192]
        # A pair that meets in several buckets counts in the smallest of them.
        meet = np.zeros(len(p), np.int64)
        for w in np.unique(width[p]).tolist():
            part = np.flatnonzero(width[p] == w)
            one, other = (flat[offset[side[part], None] + np.arange(w)].reshape(len(part), -1, probes) for side in (p, q))
            shared = (one[:, :, :, None] == other[:, :, None, :]).any(3)
            meet[part] = np.where(shared, one, np.iinfo(np.int64).max).min((1, 2))
        counts = meet == key[p]
        p, q = p[counts], q[counts]
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
    root = np.arange(len(rep))
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    told = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
    return pa.RecordBatch.from_arrays(
        [pa.array(rep[told]), pa.array(links[told]), pa.array(rep[root[told]])], ["rep", "n", "root"]
    )


def similar_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    rotations: int = ROTATIONS,
    probes: int = PROBES,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each row of ``vectors``.

    Vectors ``vec_id, embedding`` are linked if they meet in a bucket and their
    cosine, computed in double from the whole vectors, is at least ``threshold``.
    ``tables`` are looked at in up to 64 dimensions, and more in more.
    ``n_links`` counts the other rows linked directly, equal vectors included;
    ``component_id`` is the smallest vec_id reachable, and that row is kept.

    A vector that is null, empty or all zero, or holds a null or non-finite
    component, links with nothing; vectors of different lengths do not link.
    A null vec_id is linked and counted, names no component, and is never kept; a
    component of nothing else has a null name. No rows give no rows. Other
    columns are not looked at.

    Equal vectors become one node with a count. Buckets of the same members are
    one. A bucket is compared in blocks, so a task holds a batch of rows or two
    blocks of vectors whatever the size of the bucket, and returns one row for
    each vector with links, never the pairs.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    ).withColumn("vec", F.when(_usable(F.col("vec")), F.col("vec")))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    # Numbered as they are written: a vector that only rows without an id have is a node too.
    nodes = stored(
        rows.where(F.col("vec").isNotNull())
        .groupBy("vec")
        .agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "nodes",
    )
    hashed = stored(_hashed(nodes.select("rep", "copies", "vec"), tables, rotations, probes), "hashed")
    buckets = hashed.select(F.explode(F.array_distinct("keys")).alias("key"), "rep")
    members_of = {
        "size": F.count(F.lit(1)),
        "least": F.min("rep"),
        "most": F.max("rep"),
        "one": F.bit_xor(F.xxhash64("rep")),
        "other": F.bit_xor(F.xxhash64("rep", F.lit(1))),
    }
    # Of buckets with the same members the smallest stays: it is the one that counts.
    crowded = (
        buckets.groupBy("key")
        .agg(*[c.alias(name) for name, c in members_of.items()])
        .where("size > 1")
        .groupBy(*members_of)
        .agg(F.min("key").alias("key"))
        .select("key", "size")
    )
    members = buckets.join(crowded, "key").join(hashed, "rep")
    chunks = F.ceil(F.col("size") / block).cast("int")
    chunk = F.pmod(F.xxhash64("rep"), chunks).cast("int")
    blocks = (
        members.withColumn("chunks", chunks)
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"),
            "chunk", "rep", "copies", "vec", "keys",
        )
    )
    found = stored(
        blocks.repartition("key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
        .mapInArrow(_compare(threshold, probes), "rep long, n long, root long"),
        "links",
    )
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = (
        nodes.join(counts, "rep", "left")
        .join(components, F.col("rep") == F.col("node"), "left")
        .select(
            "vec",
            "first_id",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    names = classes.groupBy("component").agg(F.min("first_id").alias("name"))
    classes = classes.join(names, "component").select("vec", "n", "name")
    component = F.coalesce("name", "vec_id")
    return rows.join(classes, "vec", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
