"""Vectorized words, word hashes and window hashes over Arrow string columns.

A *word* is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``. All work is
done with numpy over the column's byte buffer, so no Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial hashes (over bytes, over words) and their inverses modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1B54A32D192ED03
#: Text bytes handled at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_CODE = np.random.default_rng(20240817).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    x = np.full(size, b, dtype=np.uint64)
                    x[0] = 1
                    setattr(self, name, np.cumprod(x))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = Powers(BYTE_BASE), Powers(WORD_BASE)


@dataclass
class Words:
    """Words of a run of texts. ``first[i]:first[i + 1]`` are the words of text ``i``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = _byte_powers.upto(len(self.data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(BYTE_CODE[self.data] * up[: len(self.data)], out=sums[1:])
            return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def left(self) -> np.ndarray:
        """For each word, how many words of its text start here or later."""
        n = np.diff(self.first)
        return np.repeat(self.first[1:], n) - np.arange(self.first[-1])


class WindowHash:
    """Hashes of word windows from one prefix sum."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = _word_powers.upto(len(hashes) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
            np.cumsum(hashes * self.up[: len(hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """Row ranges ``(begin, end, bytes, offsets)`` of at most ``limit`` text bytes or of one row."""
    data, offsets = buffers(texts)
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Words of the texts that ``offsets`` cuts out of ``data``; no word crosses texts."""
    inside = ~space[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """``min(x[i:i + width])`` for every full window, in O(len * log(width))."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x
