"""Vectorised scans over the bytes of Arrow text columns.

A batch is cut into slices of a few MB, so memory follows the slice and the longest text,
never the batch. Words are found and hashed for a whole slice at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PUNCT = np.ones(256, bool)
_PUNCT[np.r_[48:58, 65:91, 97:123, 128:256]] = False
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_PRIME, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


class Slice:
    """Some texts of a batch: ``data`` holds their bytes, text i at ``offsets[i]:offsets[i+1]``."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.n = len(offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, fold: bool = False, punctuation: bool = False) -> Words:
        return Words(self, fold, punctuation)


class Words:
    """Words of a slice: starts, ends, 64-bit hashes, and ``bounds`` (text i has words bounds[i]:bounds[i+1]).

    fold lowers ASCII letters before hashing; punctuation makes ASCII punctuation separate words too.
    """

    def __init__(self, part: Slice, fold: bool, punctuation: bool):
        data, offsets = part.data, part.offsets
        inside = ~(_PUNCT if punctuation else _SPACE)[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        start[edges] = inside[edges]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        end[edges[1:] - 1] = inside[edges[1:] - 1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(part.n), self.counts)
        power, inverse = _power(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data] if fold else data] * power[:-1], out=total[1:])
        self.prefix = total
        self.hash = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        _, inverse = _power(len(self.prefix))
        return mix((self.prefix[ends] - self.prefix[starts]) * inverse[starts])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words inside a text."""
        last = np.maximum(self.bounds[1:] - k + 1, self.bounds[:-1])
        at = np.flatnonzero(np.arange(len(self.hash)) < np.repeat(last, self.counts))
        total = np.zeros(len(at), np.uint64)
        for i in range(k):
            total = total * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + i]
        return at, mix(total)


def slices(column: pa.Array) -> Iterator[Slice]:
    """The texts of a string column in order, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        j = min(j, len(column))
        yield Slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values per text; texts without any get 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def runs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (doc, key), by first occurrence: how often it stands there, and which occurrence each is (from 0)."""
    order = np.argsort(key ^ mix(doc.astype(np.uint64) + np.uint64(1)), kind="stable")
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(k)))
    often, which = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    often[order] = size[group]
    which[order] = np.arange(len(k)) - first[group]
    return often, which, order
