"""64-bit hashes of the words of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Words end at these bytes; everything else belongs to a word.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SEED = 20240229


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * 2 + 1
    value[65:91] = value[97:123]  # A-Z count as a-z
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    return value, white, rng.integers(1, 1 << 63, 1, dtype=np.uint64) * 2 + 1


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    base = np.full(n, _tables()[2][0], np.uint64)
    base[0] = 1
    return np.multiply.accumulate(base)


def letters_and_digits() -> np.ndarray:
    """The bytes that are no ASCII letter or digit; bytes of other characters are kept."""
    apart = np.ones(256, bool)
    apart[48:58] = apart[65:91] = apart[97:123] = apart[128:] = False
    return apart


def word_hashes(
    data: np.ndarray, white: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word in bytes that hold whole texts.

    A hash sums a random number per byte times a power for its place, modulo
    2^64, and is then mixed. Texts must be set apart by a white byte.
    """
    start, end, _, total = word_sums(data, white)
    return start, end, mix(total)


def word_sums(
    data: np.ndarray, white: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, the terms of its hash byte by byte, and their sums.

    The terms of all words follow each other without the bytes between words.
    """
    value, ascii_white, _ = _tables()
    inside = ~(ascii_white if white is None else white)[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    length = end - start
    room = 1 << int(length.max() - 1).bit_length() if length.max() > 1 else 2
    # Place of each byte in its word, for the bytes inside words only.
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    terms = value[data[inside]] * _powers(max(64, room))[place]
    return start, end, terms, np.add.reduceat(terms, first)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.copy()
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, a line feed behind each, and where each starts."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), starts
