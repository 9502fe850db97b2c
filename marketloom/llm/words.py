"""Vectorised word kernels over Arrow string batches.

A batch of texts is one contiguous UTF-8 buffer plus offsets.  Word
boundaries, word hashes and hashes of runs of words are found with a fixed
number of numpy passes over that buffer; no Python loop runs per word.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes, as every contract of
this subpackage defines them.  Word hashes are polynomials over random byte
values modulo 2**64, so two lanes (seeds) give 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass works on; bounds temporaries to about 50 MB.
CHUNK_BYTES = 1 << 19

_U = np.uint64


def _stream(seed: str, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values that depend on the seed alone."""
    raw = b"".join(hashlib.blake2b(f"{seed}/{i}".encode()).digest() for i in range((n + 7) // 8))
    return np.frombuffer(raw, dtype="<u8")[:n].copy()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (xor-shift, multiply) over uint64; returns a new array."""
    x = x ^ (x >> _U(31))
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


class _Lane:
    """Byte values and powers of one hash lane."""

    def __init__(self, seed: int, fold_case: bool) -> None:
        values = _stream(f"bytes{seed}", 256)
        if fold_case:
            values[65:91] = values[97:123]
        self.values = values
        base = int(_stream(f"base{seed}", 1)[0]) | 5
        self.base, self.inverse = _U(base), _U(pow(base, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << (n - 1).bit_length()
            for name, step in (("powers", self.base), ("inverses", self.inverse)):
                full = np.full(size, step, dtype=np.uint64)
                full[0] = 1
                setattr(self, name, np.multiply.accumulate(full))


@lru_cache(maxsize=8)
def _lane(seed: int, fold_case: bool) -> _Lane:
    return _Lane(seed, fold_case)


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Word boundaries of a run of documents.

    data: their bytes; bounds: document offsets into data (n + 1); starts and
    ends: word offsets into data; first: index of each document's first word
    (n + 1 entries).
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds = data, bounds
        inside = ~_IS_SPACE[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        filled = bounds[:-1] < bounds[1:]
        at, to = bounds[:-1][filled], bounds[1:][filled] - 1
        begins[at] = inside[at]
        stops[to] = inside[to]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """Index of each word's document."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self, seed: int = 0, fold_case: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        lane = _lane(seed, fold_case)
        lane.reach(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, dtype=np.uint64)
        sums[0] = 0
        np.multiply(lane.values[self.data], lane.powers[: len(self.data)], out=sums[1:])
        np.add.accumulate(sums, out=sums)
        out = (sums[self.ends] - sums[self.starts]) * lane.inverses[self.starts]
        return mix(out + (self.ends - self.starts).astype(np.uint64))


def runs(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of `width` consecutive values; empty if there are fewer.

    Runs may cross documents: the caller drops those by position.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    step = _U(int(_stream(f"runs{seed}", 1)[0]) | 5)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= step
        out += hashes[j : j + n]
    return mix(out)


def slices(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, document offsets) of runs of at most `limit`
    bytes; a longer text is a run by itself.  Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, dtype=np.uint8)
    if texts.null_count:
        sizes = np.diff(offsets) * ~np.asarray(texts.is_null())
        if sizes.sum() != offsets[-1] - offsets[0]:  # bytes under a null
            texts = texts.fill_null("")
            yield from slices(texts, limit)
            return
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
