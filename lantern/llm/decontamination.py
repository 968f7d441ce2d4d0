"""Benchmark decontamination: CGK embedding and bit-sampling LSH, then exact edit distance.

The CGK embedding walks through a sequence: it reads a symbol, and a random bit of (step, symbol) says
whether to move on. An item or a window of n words becomes 3 n steps. Two sequences at a small edit distance get
embeddings at a small Hamming distance, as walks that fell apart at an edit meet again. Symbols are words (ASCII case
folded, punctuation separates), and every word of every text starts a window of the size of each item.

Sampling steps of the walk is an LSH for the Hamming distance, and so for edit distance. A repetition samples steps from
its own offset in the item on, so that edits before that do not matter; its first samples are close together and the rest
further and further apart. Short items are known by the first few samples and long ones by more (``Params.samples``),
as a short item allows one edit only, but has few words without it. The repetitions are as many as ``target_recall`` asks for.
Samples are read one by one, and a window is dropped as soon as its samples so far are those of no item, which gives
the same candidates as whole keys.

Candidates then have the Hamming distance of the whole embeddings of the item and its window taken, under several walks; one that is
far under all of them is dropped. The rest is verified by the edit distance between the item and the best substring near the
window. Of equal distances the first place is reported.

Items are taken in blocks of a bounded size, so the index that executors get never grows with the
benchmark; it keeps 12 bits for each key that goes on and 12 bytes for each that ends. Null and empty texts and items match nothing; equal items are all reported; a row of
``documents`` that is repeated is reported each time. Very long texts are searched whole. Without documents or items nothing is found,
and ``clean`` keeps all it gets. Extra columns, whatever their names, are kept by ``clean``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import in_arrow
from lantern.llm.textscan import mix, slices


@dataclass(frozen=True)
class Params:
    similarity: float = 0.8
    target_recall: float = 0.99
    #: (words, samples): an item of up to so many words is known by so many samples, a longer one by all
    by_length: tuple[tuple[int, int], ...] = ((4, 7), (9, 3), (14, 4), (24, 5))
    #: least and most steps between neighbouring samples
    gaps: tuple[tuple[int, int], ...] = ((1, 2), (1, 2), (1, 3), (2, 3), (2, 3), (2, 4))
    #: walks under which whole embeddings are compared, and the most of their steps that may differ under all of them
    walks: int = 4
    far: float = 0.92
    block_bytes: int = 16 << 20

    def samples(self, words: int) -> int:
        return next((m for n, m in self.by_length if words <= n), len(self.gaps) + 1)

    @property
    def repetitions(self) -> int:
        """A repetition meets if the words under its samples are unedited, which a walk passes at two steps a word."""
        covered = 1 + sum(a + b for a, b in self.gaps) / 4
        return math.ceil(math.log(1 - self.target_recall) / math.log(1 - self.similarity**covered))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for part in slices(pa.array(texts, pa.large_string())):
        words = part.words(fold=True, punctuation=True)
        out += [words.hash[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    return out


def _move(symbol: np.ndarray, repetition: int, step: int) -> np.ndarray:
    odd = np.uint64((2 * (repetition + 4096 * (step // 64)) + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (((symbol * odd) >> np.uint64(63 - step % 64)) & np.uint64(1)).astype(np.int64)


def _join(key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    key = (key + symbol) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(32))


class Keys:
    """A set of keys as a Bloom filter of packed bits: it may let a key through, never keep one back."""

    BITS, HASHES = 12, 4

    def __init__(self, keys: np.ndarray):
        found = np.unique(keys)
        self.size = np.uint64(max(64, self.BITS * len(found)))
        bits = np.zeros(int(self.size), bool)
        for n in range(self.HASHES):
            bits[self._place(found, n)] = True
        self.table = np.packbits(bits, bitorder="little")

    def _place(self, keys: np.ndarray, n: int) -> np.ndarray:
        low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
        return ((((high + np.uint64(n) * (low | np.uint64(1))) & np.uint64(0xFFFFFFFF)) * self.size) >> np.uint64(32)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may be in the set."""
        stay = np.arange(len(keys))
        for n in range(self.HASHES):
            place = self._place(keys[stay], n)
            stay = stay[(self.table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
        return stay


class Index:
    """For each repetition and sample: the keys of the items that go on, and those of the items that end there."""

    def __init__(self, ids: list, texts: list[str], params: Params):
        self.params = params
        found = [(i, h) for i, h in zip(ids, word_hashes(texts), strict=True) if len(h)]
        self.ids = [i for i, _ in found]
        self.size = np.array([len(h) for _, h in found], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.every = np.concatenate([*(h for _, h in found), np.zeros(0, np.uint64)])
        self.words = np.unique(self.every)
        self.last = np.array([params.samples(int(n)) for n in self.size], np.int8)
        rng = np.random.default_rng(7)
        self.repetitions = []
        offsets = rng.permutation(params.repetitions)
        for r in range(params.repetitions):
            steps = np.cumsum([0, *(rng.integers(a, b + 1) for a, b in params.gaps)])
            share = (offsets[r] + 0.5) / params.repetitions
            go, end = self._levels(r, steps, self._last(slice(None), len(steps)), share)
            first = np.zeros(len(self.words), bool)
            first[go[0].find(_join(np.zeros(len(self.words), np.uint64), self.words))] = True
            self.repetitions.append((steps, share, np.packbits(first), go[1:], end))

    def item(self, i: int) -> np.ndarray:
        return self.every[self.begin[i] : self.begin[i] + self.size[i]]

    def _last(self, items, most: int) -> np.ndarray:
        """The number of each item's last sample, from 0."""
        return np.minimum(self.last[items].astype(np.int64), most) - 1

    def _offsets(self, share: float, steps: np.ndarray, items: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where in each item the samples of a repetition begin."""
        return (share * np.maximum(self.size[items] - steps[last] // 2, 1)).astype(np.int64)

    def _levels(self, r: int, steps: np.ndarray, last: np.ndarray, share: float):
        live = np.arange(len(self.size))
        at, key, level = self._offsets(share, steps, live, last), np.zeros(len(live), np.uint64), -1
        go, end = [], [[(live[:0], key[:0])] for _ in steps]
        for step in range(steps[-1] + 1):
            over = at >= self.size[live]
            end[level].append((live[over], key[over]))
            live, at, key = live[~over], at[~over], key[~over]
            symbol = self.every[self.begin[live] + at]
            if step == steps[level + 1]:
                key, level = _join(key, symbol), level + 1
                go.append(Keys(key))
                done = last[live] == level
                end[level].append((live[done], key[done]))
                live, at, key, symbol = live[~done], at[~done], key[~done], symbol[~done]
            at = at + _move(symbol, r, step)
        out = []
        for parts in end:
            item, keys = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(keys, kind="stable")
            out.append((keys[order], item[order].astype(np.int32)))
        return go, out

    def candidates(self, words) -> np.ndarray:
        """Rows (text, item, first word of the window) for the words of a slice; no row twice."""
        none = np.zeros((0, 3), np.int64)
        if not len(words.hash) or not len(self.words):
            return none
        spot = np.searchsorted(self.words, words.hash)
        spot[spot == len(self.words)] = 0
        known = np.flatnonzero(self.words[spot] == words.hash)
        spot, stop = spot[known], words.bounds[1:][words.doc]
        found = [none]
        for r, (steps, share, first, go, end) in enumerate(self.repetitions):
            start = known[np.unpackbits(first, count=len(self.words)).view(bool)[spot]]
            at, key, level = start, np.zeros(len(start), np.uint64), 0
            for step in range(steps[-1] + 1):
                if not len(start):
                    break
                symbol = words.hash[at]
                if step == steps[level]:
                    key = _join(key, symbol)
                    if level:
                        stay = go[level - 1].find(key)
                        start, at, key, symbol = start[stay], at[stay], key[stay], symbol[stay]
                    keys, items = end[level]
                    if len(keys):
                        left, right = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                        times = right - left
                        which = np.repeat(left, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                        begin, item = np.repeat(start, times), items[which]
                        found.append(np.stack([words.doc[begin], item, begin - self._offsets(share, steps, item, self._last(item, len(steps)))], axis=1))
                    level += 1
                    if level == len(steps):
                        break
                at = at + _move(symbol, r, step)
                stay = at < stop[start]
                if not stay.all():
                    start, at, key = start[stay], at[stay], key[stay]
        return np.unique(np.concatenate(found), axis=0)

    def near(self, words, found: np.ndarray) -> np.ndarray:
        """The candidates whose window's embedding is at a small Hamming distance from that of the item, under some walk."""
        if not len(found):
            return found
        every, n = self.every, self.size[found[:, 1]]
        low, high = words.bounds[found[:, 0]], words.bounds[found[:, 0] + 1]
        start = np.clip(found[:, 2], low, high - 1)
        stop, first = np.minimum(start + n, high), self.begin[found[:, 1]]
        keep = np.zeros(len(found), bool)
        for walk in range(self.params.walks):
            a, b, same = first.copy(), start.copy(), np.zeros(len(found), np.int64)
            live = np.flatnonzero(~keep)
            for step in range(3 * int(n[live].max(initial=0))):
                live = live[(step < 3 * n[live]) & (a[live] < first[live] + n[live]) & (b[live] < stop[live])]
                if not len(live):
                    break
                x, y = every[a[live]], words.hash[b[live]]
                same[live] += x == y
                a[live] += _move(x, 1000 + walk, step)
                b[live] += _move(y, 1000 + walk, step)
            read = 2 * n  # a walk through n words ends after about so many steps; where both have ended, they agree
            keep |= read - same <= self.params.far * read
        return found[keep]

    def matches(self, words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, first word) of the best match of each text and item that verify."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, i, start in self.near(words, self.candidates(words)).tolist():
            item, low, high = self.item(i), int(words.bounds[doc]), int(words.bounds[doc + 1])
            if best.get((doc, i), (1,))[0] == 0:
                continue
            allowed = int((1 - self.params.similarity) * len(item) + 1e-9)
            a, b = max(low, start - allowed), min(high, start + len(item) + allowed)
            if low <= start and start + len(item) <= high and np.array_equal(words.hash[start : start + len(item)], item):
                distance = 0
            else:
                distance = substring_distance(item, words.hash[a:b], allowed)
            if distance is not None:
                best[doc, i] = min(best.get((doc, i), (distance, start - low)), (distance, max(start - low, 0)))
        for (doc, i), (distance, start) in best.items():
            yield doc, i, distance, start


def substring_distance(item: np.ndarray, text: np.ndarray, most: int) -> int | None:
    """Least edit distance between the item and any substring of the text, if at most ``most``."""
    shared = sum((Counter(item.tolist()) & Counter(text.tolist())).values())
    if len(item) - shared > most:
        return None
    ramp = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for symbol in item:
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (text != symbol))
        row = np.minimum.accumulate(step - ramp) + ramp
    return int(row.min()) if row.min() <= most else None


def _blocks(items: DataFrame, params: Params, item_id: str, text: str) -> Iterator[tuple[list, list[str]]]:
    """The items, in blocks of about ``block_bytes`` that are dealt by their hash."""
    items = items.select(F.col(item_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t").cast("long") + 64)).first()[0] or 0
    n = math.ceil(size / params.block_bytes)
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        yield [r.i for r in block], [r.t for r in block]


_FOUND = "array<struct<item:bigint,distance:bigint,similarity:double,first:bigint>>"


def _matches(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int, float, int]]:
    """(text, item_id, distance, similarity, first word) of a batch."""
    for part in slices(texts):
        for doc, i, distance, start in index.matches(part.words(fold=True, punctuation=True)):
            yield part.first + doc, index.ids[i], distance, 1 - distance / int(index.size[i]), start


def _carrier(index: Index):
    """Adds the matches of a block to those that a document carries along."""

    def run(batches):
        for batch in batches:
            held = [found or [] for found in batch.column(2).to_pylist()]
            for doc, *match in _matches(index, batch.column(1)):
                held[doc].append(dict(zip(("item", "distance", "similarity", "first"), match, strict=True)))
            kind = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int64()), ("similarity", pa.float64()), ("first", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, kind)], names=["doc_id", "text", "found"])

    return run


def _reporter(index: Index):
    """The matches of the last block, and those carried along, a row each."""

    def run(batches):
        for batch in batches:
            rows = list(_matches(index, batch.column(1)))
            if batch.num_columns > 2:
                rows += [(doc, *m.values()) for doc, found in enumerate(batch.column(2).to_pylist()) for m in found or []]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            values = [pa.array([r[n + 1] for r in rows], kind) for n, kind in enumerate(kinds)]
            arrays = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *values]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "distance", "similarity", "first_word"])

    return run


def leaks(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id, item_id, distance (words), similarity, first_word: the best place of each item that a document holds.

    The documents are read once: with more than one block of items, each but the last is a narrow step that adds its matches to a column.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, distance long, similarity double, first_word long"
    indexes = [Index(ids, texts, params) for ids, texts in _blocks(items, params, "item_id", "text") if ids]
    if not indexes:
        return spark.createDataFrame([], schema)
    rows = docs.select("doc_id", "text")
    if len(indexes) > 1:
        rows = rows.withColumn("found", F.lit(None).cast(_FOUND))
    for index in indexes[:-1]:
        rows = in_arrow(rows, _carrier(index), f"doc_id {kind}, text string, found {_FOUND}")
    return in_arrow(rows, _reporter(indexes[-1]), schema)


def _filter(index: Index, text: str):
    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for part in slices(batch.column(batch.schema.get_field_index(text))):
                for doc, *_ in index.matches(part.words(fold=True, punctuation=True)):
                    clean[part.first + doc] = False
            yield batch.filter(pa.array(clean))

    return run


def clean(docs: DataFrame, items: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """The documents that hold no item, with their own columns; no shuffle."""
    for ids, texts in _blocks(items, params, "item_id", "text"):
        docs = in_arrow(docs, _filter(Index(ids, texts, params), "text"), docs.schema)
    return docs
