"""Words of many texts at once, as arrays of 64-bit hashes.

A word is a maximal run without ASCII white space, with ASCII letters lower-cased or as
they stand. Its hash is a polynomial in its bytes modulo 2**64, read off one running sum
over the texts' buffer, and mixed; a word of 512 bytes or more, where such polynomials have
known collisions, is hashed on its own. No Python string is made per word, and a slice of
texts of about a quarter of a megabyte (or one longer text) is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE_BYTES = 1 << 18

_LONG = 512
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                for b in (_BASE, _INVERSE)
            )
        return self.up, self.down


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of texts; a null text counts as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    n = len(texts)
    at = np.frombuffer(ends, kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + _SLICE_BYTES, "right")) - 1)
        yield start, stop, raw[at[start] : at[stop]], at[start : stop + 1] - at[start]
        start = stop


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words in order, and the number of words of each text."""
    hashes, counts, _, _ = spans(raw, at, _LOWER)
    return hashes, counts


def spans(raw: np.ndarray, at: np.ndarray, fold: np.ndarray = _SAME) -> tuple[np.ndarray, ...]:
    """Hashes of words, words of each text, first and last byte of each word."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64), none, none
    inside = ~_BLANK[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = inside & edge[:n]
    starts[1:] |= inside[1:] & ~inside[:-1]
    ends = inside & edge[1:]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    up, down = _POWERS.get(n)
    sums = fold[raw].astype(np.uint64)
    sums += np.uint64(1)
    sums *= up[:n]
    np.cumsum(sums, out=sums)
    before = np.where(first > 0, sums[np.maximum(first, 1) - 1], np.uint64(0))
    hashes = mix((sums[last] - before) * down[first])
    for k in np.flatnonzero(last - first >= _LONG - 1):
        hashes[k] = xxhash.xxh3_64_intdigest(fold[raw[first[k] : last[k] + 1]].tobytes())
    return hashes, np.diff(np.searchsorted(first, at)), first, last
