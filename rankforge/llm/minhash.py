"""MinHash near-dedup: one permutation, optimal densification, bands, stars."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankforge.llm.common import slices, stored, texts_of
from rankforge.llm.components import connected_components
from rankforge.llm.word_hashes import joined, mix, word_hashes

SHINGLE_WORDS = 5
THRESHOLD = 80  # percent
# A pair at 0.8 meets in none of the bands with a chance of 2 in 10,000, one at
# 0.3 meets in some with 12 in 100.
BANDS, ROWS = 16, 4
# Sets of one side of a comparison of what the stars leave, and shingles at once.
BLOCK, COLUMNS = 512, 4096
# A set's parity bits: as many as shingles, to the next power of two, in these bounds.
PARITY_BITS = 64, 1 << 16
_SIGNATURE = "doc_id long, n long, set_lo long, set_hi long, bands array<long>, parity binary"
# What tells a set from others, and the same beside the columns of a row.
SAME = ["set_lo", "set_hi", "n"]
TAGS = ["__set_lo", "__set_hi", "__set_n"]
_BLOCK_ROW = "key long, lo int, hi int, chunk int, rep long, component long"


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text.

    A text of fewer words has its whole sequence as one shingle, a text without
    words none.
    """
    data, starts = joined(texts)
    start, _, hashes = word_hashes(data)
    bounds = np.searchsorted(start, starts)
    k = min(words, max(len(hashes), 1))
    rolled = _combine([hashes[i : len(hashes) - k + 1 + i] for i in range(k)])
    sets = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= words:
            sets.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            sets.append(_combine([hashes[i : i + 1] for i in range(lo, hi)]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _combine(columns: list[np.ndarray]) -> np.ndarray:
    # The length starts the hash, so a short text meets no longer shingle.
    acc = np.full(len(columns[0]), len(columns), np.uint64)
    for column in columns:
        acc = mix(acc ^ column)
    return acc


@lru_cache(maxsize=2)
def _detours(bins: int, tries: int) -> np.ndarray:
    rng = np.random.default_rng(bins)
    return rng.integers(0, bins, (tries, bins))


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash in each of ``bins`` equal parts of the hash range.

    An empty bin takes the value of the first filled one in a random sequence
    of its own, the same for every text: two texts then agree in a bin with a
    chance of their similarity.
    """
    z = np.sort(mix(shingles))
    at = ((z >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(at.astype(np.int64), prepend=-1))
    out = np.zeros(bins, np.uint64)
    filled = np.zeros(bins, bool)
    out[at[first].astype(np.int64)] = z[first]
    filled[at[first].astype(np.int64)] = True
    todo = np.flatnonzero(~filled)
    tries = _detours(bins, 64)
    for t in range(64):
        if not len(todo):
            return out
        from_ = tries[t, todo]
        hit = filled[from_]
        out[todo[hit]] = out[from_[hit]]
        todo = todo[~hit]
    order = np.flatnonzero(filled)  # few are left: a random filled bin of their own
    if len(todo):
        pick = mix(todo.astype(np.uint64))
        # The filled bin with the smallest mixed distance, which is the same rule for all texts.
        for i, p in zip(todo.tolist(), pick):
            out[i] = out[order[np.argmin(mix(order.astype(np.uint64) ^ p))]]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        acc = mix(acc ^ sig[r::rows])
    return acc


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each of a power of two of parts: whether an odd number of hashes lie in it.

    What two sets share cancels, so bits that differ are at most as many as the
    shingles that one of the sets has alone.
    """
    fewest, most = PARITY_BITS
    bits = min(max(1 << (max(len(shingles), 1) - 1).bit_length(), fewest), most)
    part = (shingles & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(part, minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """The parity bits of the same set in fewer parts."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


def _can_link(differ, n, other_n, threshold: int):
    """Whether sets of these sizes with so many shingles apart can be similar enough."""
    return differ * (100 + threshold) <= (n + other_n) * (100 - threshold)


def _digest(shingles: np.ndarray) -> tuple[int, int, int]:
    """128 bits of the set, and its size."""
    lo, hi = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), "<i8")
    return int(lo), int(hi), len(shingles)


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n, set_lo, set_hi, bands, parity``: set size, 128 bits of the set, band keys, parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, lo, hi, keys, odd = [], [], [], [], []
            for s in shingle_sets(texts_of(batch), words):
                for column, value in zip((lo, hi, n), _digest(s)):
                    column.append(value)
                odd.append(parity(s))
                keys.append(
                    band_keys(signature(s, bands * rows), bands, rows).view(np.int64)
                    if len(s)
                    else np.zeros(0, np.int64)
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(lo, pa.int64()),
                    pa.array(hi, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(odd, pa.binary()),
                ],
                ["doc_id", "n", "set_lo", "set_hi", "bands", "parity"],
            )

    return _slim(docs).mapInArrow(run, _SIGNATURE)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def _tagged(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with ``TAGS``, which tell the set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tags = np.array([_digest(s) for s in shingle_sets(texts_of(batch), words)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(tags[:, i]) for i in range(3))], [*batch.schema.names, *TAGS]
            )

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(t, LongType()) for t in TAGS)]))


def _sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(texts_of(batch), words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"]
            )

    return texts.select("rep", "text").mapInArrow(run, "rep long, shingles array<long>")


def _texts(docs: DataFrame, sigs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``rep, text``: a text of each node ``wanted`` (``SAME, rep, doc_id``).

    An id that all its rows have one set for leads to the text. Where no such id
    is known, the sets of the rows with a null id or an id of several sets tell.
    """
    slim = _slim(docs)
    key = F.struct(*SAME)
    several = (
        sigs.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(key).alias("low"), F.max(key).alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("doc_id")
    )
    several = stored(several, "several")
    plain = stored(
        wanted.where(F.col("doc_id").isNotNull()).join(several, "doc_id", "left_anti").select("doc_id", "rep"), "plain"
    )
    # The texts are shuffled once, at every size alike: no ids are broadcast. Repeated
    # ids go where the join has put the rows, not in a shuffle of sets.
    found = slim.join(plain.hint("merge"), "doc_id").dropDuplicates(["doc_id"]).select("rep", "text")
    others = wanted.join(plain, "rep", "left_anti")
    if others.isEmpty():
        return found
    rows = slim.where(F.col("doc_id").isNull()).unionAll(slim.join(several, "doc_id", "left_semi"))
    # One text of each set a task, before a set of very many rows is dealt out.
    one = _tagged(rows, words).dropDuplicates(TAGS).select(*[F.col(t).alias(c) for t, c in zip(TAGS, SAME)], "text")
    return found.unionAll(one.join(others.select(*SAME, "rep"), SAME).select("rep", "text"))


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each row of ``docs``.

    Two documents are linked if the shingle sets share ``threshold`` percent of
    their union, confirmed on the full sets. Words end at ASCII white space;
    A-Z count as a-z. A component is what links reach; its id is the smallest
    doc_id in it, and that document is kept.

    A null, empty or white text has no shingles and is linked with nothing. Rows
    that repeat a doc_id are judged by their texts, each as a document of that id.
    A null doc_id is linked like any other, names no component if others can, and
    is never kept. No rows give no rows. Other columns are not looked at.

    Equal sets become one node first, so copies cost nothing further. In each
    bucket the member that shares most with others is the centre of a star and
    is compared with the rest: as many pairs as members. What a bucket holds
    beyond the component of its centre is then compared with the whole bucket,
    in blocks of sets, and gives a link for each two components it joins, never
    the pairs. Before sets are compared, parity bits rule out pairs that cannot
    be similar enough. So a pair is missed only if it meets in no band.
    """
    sigs, found = _clustered(docs, words, threshold, bands, rows)
    names = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = found.join(names, "component").select(*SAME, "component_id")
    # A set of a third of all rows is one row on this side; AQE splits the other.
    out = sigs.drop("bands", "parity").join(found, SAME, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def _clustered(
    docs: DataFrame, words: int, threshold: int, bands: int, rows: int
) -> tuple[DataFrame, DataFrame]:
    """The signatures of the rows, and ``SAME, doc_id, component`` of each distinct set.

    ``doc_id`` is the smallest of the set's rows, null if none has one. The
    numbers of the components are of this run only and say nothing of ids.
    """
    sigs = stored(signatures(docs, words, bands, rows), "signatures")
    # Numbered as they are written, so a number stays with its set.
    nodes = stored(
        sigs.where(F.col("n") > 0)
        .groupBy(*SAME)
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("bands").alias("bands"),
            F.first("parity").alias("parity"),
        )
        .withColumn("rep", F.monotonically_increasing_id()),
        "nodes",
    )
    members = _shared_buckets(nodes)
    wanted = nodes.join(members.select("rep").distinct(), "rep", "left_semi").select(*SAME, "rep", "doc_id")
    sketches = nodes.select("rep", F.col("n").alias("set_n"), "parity")
    links = _linked(_texts(docs, sigs, wanted, words), members, sketches, words, threshold)
    components = connected_components(links)
    found = nodes.join(components, nodes["rep"] == components["node"], "left")
    return sigs, stored(found.select(*SAME, "doc_id", F.coalesce("component", "rep").alias("component")), "clusters")


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """``key, rep, n, size`` of the buckets that more than one node is in."""
    buckets = nodes.select(F.explode("bands").alias("key"), "rep", "n")
    crowded = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return stored(buckets.join(crowded, "key"), "buckets")


def _linked(
    texts: DataFrame, members: DataFrame, sketches: DataFrame, words: int, threshold: int
) -> DataFrame:
    centres = stored(_centres(members), "centres")
    stars = (
        members.join(centres, "key")
        .where(F.col("rep") != F.col("centre"))
        .where(F.least("n", "centre_n") * 100 >= F.greatest("n", "centre_n") * threshold)
        .select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
        .distinct()
    )
    stars = stored(_plausible(stars, sketches, threshold), "stars")
    sets = stored(_sets(texts, words), "sets")
    links = stored(_confirmed(stars, sets, threshold), "links")
    rest = _rest(members, centres, connected_components(links))
    close = (
        rest.join(sketches, "rep").groupBy("key", "lo", "hi").applyInArrow(_close(threshold), _BLOCK_ROW)
    )
    return links.unionAll(
        stored(close, "blocks")
        .join(sets, "rep")
        .groupBy("key", "lo", "hi")
        .applyInArrow(_compare(threshold), "a long, b long")
    )


def _centres(members: DataFrame) -> DataFrame:
    """``key, centre, centre_n``: of each bucket the member with the fullest buckets.

    Copies of one text meet it more often than each other.
    """
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    best = F.max(F.struct("weight", -F.col("rep"), "n"))
    top = members.join(weights, "rep").groupBy("key").agg(best.alias("top"))
    return top.select("key", (-F.col("top")["col2"]).alias("centre"), F.col("top.n").alias("centre_n"))


def _rest(members: DataFrame, centres: DataFrame, components: DataFrame) -> DataFrame:
    """``key, lo, hi, chunk, rep, component``: blocks of the buckets with several components.

    A bucket's nodes outside the component of its centre make the first chunks,
    the others the chunks behind them. Two chunks meet unless both lie in that
    component. A bucket of two has met in its star.
    """
    def component_of(rows: DataFrame, node: str, name: str) -> DataFrame:
        return rows.join(components, F.col(node) == F.col("node"), "left").select(
            *rows.columns, F.coalesce("component", node).alias(name)
        )

    main = component_of(centres.select("key", "centre"), "centre", "main").select("key", "main")
    placed = component_of(members.where("size > 2"), "rep", "component").join(main, "key")
    apart = F.col("component") != F.col("main")
    counts = placed.groupBy("key").agg(F.count_if(apart).alias("outer")).where("outer > 0")
    outer = F.ceil(F.col("outer") / BLOCK).cast("int")
    inner = F.ceil((F.col("size") - F.col("outer")) / BLOCK).cast("int")
    spread = F.xxhash64("rep")
    chunk = F.when(apart, F.pmod(spread, outer)).otherwise(outer + F.pmod(spread, inner))
    meets = F.when(apart, F.sequence(F.lit(0), outer + inner - 1)).otherwise(F.sequence(F.lit(0), outer - 1))
    return (
        placed.join(counts, "key")
        .select("key", "rep", "component", chunk.cast("int").alias("chunk"), F.explode(meets).alias("other"))
        .select(
            "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"),
            "chunk", "rep", "component",
        )
    )


def _close(threshold: int):
    """The rows of a block that can be similar enough to one of another component, by parity bits."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, lo, hi = (k.as_py() for k in key)
        component, chunk, n = (table.column(c).to_numpy() for c in ("component", "chunk", "set_n"))
        sketches = table.column("parity").to_pylist()
        length = np.array([len(s) for s in sketches])
        close = np.zeros(len(n), bool)
        for size in np.unique(length).tolist():
            # Pairs meet in the parts of the smaller set.
            at = np.flatnonzero(length >= size)
            bits = np.stack([_folded(sketches[i], size) for i in at.tolist()])
            for k in np.flatnonzero(length[at] == size).tolist():
                i = at[k]
                other = (component[at] != component[i]) & (
                    np.minimum(n[at], n[i]) * 100 >= np.maximum(n[at], n[i]) * threshold
                )
                if lo != hi:
                    other &= chunk[at] != chunk[i]
                j = np.flatnonzero(other)
                differ = np.bitwise_count(bits[j] ^ bits[k]).sum(axis=1, dtype=np.int64)
                j = at[j[_can_link(differ, n[at[j]], n[i], threshold)]]
                close[j] = True
                close[i] |= len(j) > 0
        return table.select(["key", "lo", "hi", "chunk", "rep", "component"]).filter(pa.array(close))

    return run


def _compare(threshold: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, lo, hi = (k.as_py() for k in key)
        table = table.combine_chunks()
        rep = table.column("rep").to_numpy()
        component = table.column("component").to_numpy()
        chunk = table.column("chunk").to_numpy()
        sets = table.column("shingles").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        row = np.repeat(np.arange(len(rep)), size)
        code, values = pd.factorize(sets.flatten().to_numpy())
        common = np.bincount(code, minlength=len(values)) > 1  # others are in no intersection
        rank = np.cumsum(common) - 1
        row, code = row[common[code]], rank[code[common[code]]]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        a, b = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
        shared = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, int(common.sum()), COLUMNS):
            i, j = np.searchsorted(code, (at, at + COLUMNS))
            holds = np.zeros((len(rep), COLUMNS), np.float32)
            holds[row[i:j], code[i:j] - at] = 1
            shared += holds[a] @ holds[b].T
        union = size[a][:, None] + size[b][None] - shared
        linked = (shared * 100 >= union * threshold) & (component[a][:, None] != component[b][None])
        i, j = np.nonzero(linked)
        i, j = a[i], b[j]
        pair = np.stack([np.minimum(component[i], component[j]), np.maximum(component[i], component[j])], 1)
        _, first = np.unique(pair, axis=0, return_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        links = []
        for k in first.tolist():
            p, q = find(int(component[i[k]])), find(int(component[j[k]]))
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(rep[i[k]]), int(rep[j[k]])))
        return pa.table(
            {
                "a": pa.array([min(p) for p in links], pa.int64()),
                "b": pa.array([max(p) for p in links], pa.int64()),
            }
        )

    return run


def _plausible(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``a, b`` that parity bits do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = np.zeros(len(batch), np.int64)
            of_a, of_b = (batch.column(c).to_pylist() for c in ("parity_a", "parity_b"))
            for i, (x, y) in enumerate(zip(of_a, of_b)):
                size = min(len(x), len(y))
                differ[i] = np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            can = _can_link(differ, n_a, n_b, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(can))

    def of(side: str) -> DataFrame:
        columns = {"rep": side, "set_n": f"n_{side}", "parity": f"parity_{side}"}
        return sketches.select(*[F.col(c).alias(name) for c, name in columns.items()])

    return pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    first = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a"))
    second = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    # The smaller id is the usual centre, so the side with many pairs joins last.
    return (
        pairs.join(second, "b")
        .join(first, "a")
        .select("a", "b", "of_a", "of_b", shared.alias("shared"))
        .where(F.col("shared") * 100 >= union * threshold)
        .select("a", "b")
    )


def keep_one(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    threshold: int = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component stays.

    That is a row of the smallest doc_id, one with a null doc_id only if no other
    is there. Rows with a null or repeated doc_id are judged by their texts.
    Documents without shingles all stay, of rows that repeat a doc_id one. Of rows
    with one id and one set, the one whose columns hash lowest stays. Other
    columns may have any names.
    """
    # Under names of their own, no column clashes with those made on the way.
    names = docs.columns
    kept = _keep_one(
        docs.toDF(*(n if n in ("doc_id", "text") else f"column_{i}" for i, n in enumerate(names))),
        words, threshold, bands, rows,
    )
    return kept.toDF(*names)


def _keep_one(docs: DataFrame, words: int, threshold: int, bands: int, rows: int) -> DataFrame:
    sigs, found = _clustered(docs, words, threshold, bands, rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *SAME)).alias("first")
    keepers = stored(
        found.groupBy("component").agg(first).select(
            F.col("first.doc_id").alias("__keeper"),
            *[F.col(f"first.{c}").alias(f"__keeper_{c}") for c in SAME],
        ),
        "keepers",
    )
    ids = (
        sigs.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("__changed"))
        .agg(F.count(F.lit(1)).alias("__copies"), F.max("n").alias("__n"))
    )
    kept = keepers.where(F.col("__keeper").isNotNull()).select(F.col("__keeper").alias("__changed")).distinct()
    # Rows of other ids stay as they are and where they are.
    single = ids.where("__copies = 1 AND __n > 0").join(kept, "__changed", "left_anti")
    changed = stored(
        ids.where("__copies > 1").unionAll(single.select(*ids.columns)).select("__changed", "__copies"), "changed"
    )
    repeated = changed.where("__copies > 1").select("__changed")
    doc_id = docs["doc_id"].cast("long")
    same_id = doc_id == F.col("__changed")
    # As in _texts, one shuffle of the texts at every size.
    once = docs.where(doc_id.isNotNull()).join(changed.hint("merge"), same_id, "left_anti")
    unclear = []
    if not sigs.where(F.col("doc_id").isNull()).isEmpty():
        unclear.append(docs.where(doc_id.isNull()))
    if not repeated.isEmpty():
        unclear.append(docs.join(repeated.hint("merge"), same_id, "left_semi"))
    for part in unclear:
        part = stored(_tagged(part.withColumn("__id", F.col("doc_id").cast("long")), words), "unclear")
        blank, unnamed = F.col("__set_n") == 0, F.col("__id").isNull()
        # One row a task goes on, so a text of very many rows is not dealt out whole.
        columns = [F.col(c) for c in docs.columns]
        as_text = [c.cast("string") for c in columns]
        place = F.struct(F.xxhash64(*as_text), F.xxhash64(*[c.isNull() for c in columns]))
        one = (
            part.where(~(blank & unnamed))
            .groupBy("__id", *TAGS)
            .agg(F.min_by(F.struct(*columns), place).alias("__row"))
            .select("__id", *TAGS, "__row.*")
        )
        same = F.col("__id").eqNullSafe(F.col("__keeper"))
        for tag, column in zip(TAGS, SAME):
            same &= F.col(tag) == F.col(f"__keeper_{column}")
        for stay in (part.where(blank & unnamed), one.where(blank), one.where(~blank).join(keepers, same, "left_semi")):
            once = once.unionAll(stay.select(*docs.columns))
    return once
