"""Byte-level BPE: padded numpy matrices merge one pair in every row a round."""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import slices, texts_of

NONE = np.int32(np.iinfo(np.int32).max)
# Rows of the matrices; wider pieces have a heap of their own, as a round costs
# the width and there are as many rounds.
WIDEST = 256
MATRIX_CELLS = 1 << 20
# Units whose ids a worker remembers before it starts anew.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The lines ``base64 rank`` of a rank file; read by the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """``(left id, right id)`` to the rank of both together, hashed with open addressing."""

    def __init__(self, ranks: Mapping[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.mask = np.uint64((1 << max(4, (len(pairs) * 4 - 1).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(int(self.mask) + 1, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            # Of those that want a free slot the first gets it, the rest go on.
            free = self.keys[slot] == np.iinfo(np.uint64).max
            _, first = np.unique(slot[free], return_index=True)
            winner = np.flatnonzero(free)[first]
            self.keys[slot[winner]] = keys[winner]
            self.values[slot[winner]] = values[winner]
            rest = np.ones(len(keys), bool)
            rest[winner] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return (mixed ^ (mixed >> np.uint64(29))) >> np.uint64(13) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of many pairs; ``NONE`` without one. A negative id is padding."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(left.size, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[at].astype(np.uint64) << np.uint64(32) | right[at].astype(np.uint64)
        slot = self._slot(key)
        while len(at):
            seen = self.keys[slot]
            hit = seen == key
            out[at[hit]] = self.values[slot[hit]]
            on = ~hit & (seen != np.iinfo(np.uint64).max)
            at, key, slot = at[on], key[on], (slot[on] + np.uint64(1)) & self.mask
        return out.reshape(shape)


class Decoder:
    """Bytes of ids. Ids are ranks."""

    def __init__(self, ranks: Mapping[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        return gather(self.bytes, self.starts[ids], self.lengths[ids])


class Encoder(Decoder):
    """Ids of pieces, too."""

    def __init__(self, ranks: Mapping[bytes, int]):
        super().__init__(ranks)
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has: its own rank, or merged from its bytes."""
        whole = np.fromiter(
            map(self.ranks.get, pieces, itertools.repeat(-1)), np.int32, len(pieces)
        )
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = (whole >= 0).astype(np.int64)
        parts = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]  # rows, and ids in row order
        todo = np.flatnonzero((whole < 0) & (lengths > 0))
        bits = np.ceil(np.log2(np.maximum(lengths[todo], 2))).astype(np.int64)
        for bit in np.unique(bits):
            members = todo[bits == bit]
            if 1 << bit > WIDEST:
                for i in members.tolist():
                    ids = self._long(pieces[i])
                    counts[i] = len(ids)
                    parts.append((np.array([i]), ids))
                continue
            step = max(1, MATRIX_CELLS >> bit)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for rows, ids in self._merged([pieces[i] for i in part], 1 << bit):
                    filled = ids >= 0
                    counts[part[rows]] = filled.sum(1)
                    parts.append((part[rows], ids[filled]))
        # From the order in which rows got done to the order of the pieces.
        row = np.concatenate([r for r, _ in parts])
        flat = np.concatenate([i for _, i in parts])
        held = counts[row]
        begins = np.zeros(len(pieces), np.int64)
        begins[row] = np.cumsum(held) - held
        return gather(flat, begins, counts), counts

    def _merged(
        self, pieces: list[bytes], width: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows that are done after each round, with their ids and -1 behind them."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8)
        ids = self.of_byte[flat].reshape(len(pieces), width)
        ids[np.arange(width) >= lengths[:, None]] = -1
        ranks = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(pieces))
        while len(row):
            width = ids.shape[1] - 1
            if not width:
                yield row, ids
                return
            # argmin takes the leftmost of equal ranks.
            at = ranks.argmin(1)
            best = ranks[np.arange(len(row)), at]
            going = best != NONE
            if not going.all():
                yield row[~going], ids[~going]
                # Compaction: rows that are done leave.
                ids, ranks, row, at, best = ids[going], ranks[going], row[going], at[going], best[going]
            n, each = len(row), np.arange(len(row))
            ids[each, at] = best
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, width)
            ranks = ranks[np.delete(keep, 0, 1)].reshape(n, width - 1)
            right = np.flatnonzero(at < width - 1)
            ranks[right, at[right]] = self.pairs.rank(
                ids[right, at[right]], ids[right, at[right] + 1]
            )
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.rank(ids[left, at[left] - 1], ids[left, at[left]])

    def _long(self, piece: bytes) -> np.ndarray:
        # The same merges in the same order; a heap finds the next one.
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.rank(ids[:-1], ids[1:])
        # rank, left place, right place, and how often each had changed by then
        entries = [(int(ranks[i]), i, i + 1, 0, 0) for i in np.flatnonzero(ranks != NONE).tolist()]
        heapq.heapify(entries)
        ids = ids.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        stamp = [0] * n  # changes of the token at a place; negative once it is merged away
        tokens = self._tokens()
        while entries:
            rank, i, j, at_i, at_j = heapq.heappop(entries)
            if stamp[i] != at_i or stamp[j] != at_j or after[i] != j:
                continue
            ids[i] = rank
            stamp[i] += 1
            stamp[j] = -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                self._push(entries, tokens, ids, stamp, i, after[i])
            if before[i] >= 0:
                self._push(entries, tokens, ids, stamp, before[i], i)
        return np.array([t for t, s in zip(ids, stamp) if s >= 0], np.int32)

    def _push(self, entries, tokens, ids, stamp, i, j) -> None:
        rank = self.ranks.get(tokens(ids[i]) + tokens(ids[j]))
        if rank is not None:
            heapq.heappush(entries, (rank, i, j, stamp[i], stamp[j]))

    def _tokens(self):
        return lambda t: self.bytes[self.starts[t] : self.starts[t] + self.lengths[t]].tobytes()


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[start : start + length]`` of each, joined."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return values[:0]
    index = np.arange(int(ends[-1])) + np.repeat(starts - (ends - lengths), lengths)
    return values[index]


class _Worker:
    """Encodes whole texts and remembers the units it has met.

    A unit starts at a space whose previous character is no white space, where
    a match of the pattern always starts, and ends before the next one. Most
    units repeat; each is split by the pattern and merged once.
    """

    def __init__(self, encoder: Encoder, pattern: str):
        self.encoder = encoder
        self.find = regex.compile(pattern).findall
        rng = np.random.default_rng(7)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * 2 + 1
        self.base = int(rng.integers(1, 1 << 62)) * 2 + 1
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.encode() for t in texts]
        ends = np.cumsum([len(p) for p in parts])
        whole = b"".join(parts)
        data = np.frombuffer(whole, np.uint8)
        if not len(data):
            return [b""] * len(texts)
        if len(self.known) > REMEMBERED:
            self.forget()
        starts = self._units(data, ends)
        stops = np.append(starts[1:], len(data))
        codes, hashes = pd.factorize(self._hashes(data, starts, stops))
        index = np.fromiter(map(self.known.get, hashes.tolist(), itertools.repeat(-1)), np.int64, len(hashes))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            first = np.zeros(len(hashes), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            self._learn([whole[starts[i] : stops[i]] for i in first[missing].tolist()])
            index[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            self.known.update(zip(hashes[missing].tolist(), index[missing].tolist()))
        at = index[codes]
        counts = self.lengths[at]
        begins = np.cumsum(self.lengths) - self.lengths
        ids = gather(self.flat, begins[at], counts)
        if self.encoder.decode(ids).tobytes() != whole:  # two units share a hash
            self.forget()
            return [self._alone(p) for p in parts]
        # Ids up to the end of each text.
        upto = np.append(0, np.cumsum(counts))[np.searchsorted(starts, ends)]
        raw = ids.astype("<u4")
        return [r.tobytes() for r in np.split(raw, upto[:-1])]

    def _learn(self, units: list[bytes]) -> None:
        found = [self.find(u.decode()) for u in units]
        pieces = {p: i for i, p in enumerate(set().union(*found))}
        flat, counts = self.encoder.encode([p.encode() for p in pieces])
        begins = np.cumsum(counts) - counts
        at = np.fromiter((pieces[p] for f in found for p in f), np.int64)
        held = np.fromiter(map(len, found), np.int64, len(found))
        of_unit = np.append(0, np.cumsum(counts[at]))
        stop = np.cumsum(held)
        self.flat = np.concatenate((self.flat, gather(flat, begins[at], counts[at])))
        self.lengths = np.concatenate((self.lengths, of_unit[stop] - of_unit[stop - held]))

    def _alone(self, part: bytes) -> bytes:
        flat, _ = self.encoder.encode([p.encode() for p in self.find(part.decode())])
        return flat.astype("<u4").tobytes()

    def _units(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where units start; never after a character that could be white space."""
        back = np.zeros((3, len(data)), np.uint8)
        for k in range(3):
            back[k, k + 1 :] = data[: -k - 1]
        ascii_white = (back[0] <= 0x20) | (back[0] == 0x7F)
        # White space beyond ASCII is C2 and one byte, or E1, E2 or E3 and two.
        wide = (back[0] >= 0x80) & ((back[1] == 0xC2) | ((back[2] >= 0xE1) & (back[2] <= 0xE3)))
        cut = (data == 0x20) & ~ascii_white & ~wide
        cut[0] = True
        cut[ends[:-1][ends[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        length = stops - starts
        power = np.full(int(length.max()), self.base, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        place = np.arange(len(data)) - np.repeat(starts, length)
        return np.add.reduceat(self.value[data] * power[place], starts)


_CACHED: dict[tuple, object] = {}


def _cached(key: tuple, make):
    # A worker process serves many tasks, and few vocabularies.
    if key not in _CACHED:
        if len(_CACHED) > 8:
            _CACHED.clear()
        _CACHED[key] = make()
    return _CACHED[key]


def _mark(ranks: Mapping[bytes, int]) -> str:
    whole = hashlib.blake2b(digest_size=16)
    for token, rank in sorted(ranks.items()):
        whole.update(b"%d %s\n" % (rank, base64.b64encode(token)))
    return whole.hexdigest()


def _with_ids(batch: pa.RecordBatch, worker: _Worker) -> pa.RecordBatch:
    ids = worker.encode(texts_of(batch))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array(ids, pa.binary()),
        ],
        ["doc_id", "n_tokens", "ids"],
    )


def _with_bytes(batch: pa.RecordBatch, decoder: Decoder) -> pa.RecordBatch:
    ids = [np.frombuffer(i or b"", "<u4").astype(np.int64) for i in batch.column("ids").to_pylist()]
    decoded = [decoder.decode(i).tobytes() for i in ids]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), pa.array(decoded, pa.binary())],
        ["doc_id", "n_tokens", "ids", "decoded"],
    )


_IDS = "doc_id long, n_tokens long, ids binary"


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _workers(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str) -> Callable[[], _Worker]:
    shared, mark = docs.sparkSession.sparkContext.broadcast(dict(ranks)), _mark(ranks)
    return lambda: _cached((mark, pattern), lambda: _Worker(Encoder(shared.value), pattern))


def encode(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` in the whole text is encoded by itself; there are
    no special tokens. A null text counts as empty, and an empty text has no
    tokens. Rows stay, also repeated ones and such with a null doc_id. Other
    columns are not looked at. The ranks are broadcast; they are a fixed file.
    """
    worker = _workers(docs, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = worker()
        for batch in slices(batches):
            yield _with_ids(batch, mine)

    return _slim(docs).mapInArrow(run, _IDS)


def decode(tokens: DataFrame, ranks: Mapping[bytes, int]) -> DataFrame:
    """Add ``decoded`` (binary) to ``doc_id, n_tokens, ids``; null ids give no bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(Decoder(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            yield _with_bytes(batch, shared.value)

    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"{_IDS}, decoded binary")


def round_trip(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str) -> DataFrame:
    """``decode(encode(docs))`` in one task: half the processes hold the tables."""
    worker = _workers(docs, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = worker()
        for batch in slices(batches):
            yield _with_bytes(_with_ids(batch, mine), mine.encoder)

    return _slim(docs).mapInArrow(run, f"{_IDS}, decoded binary")
