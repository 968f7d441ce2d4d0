"""Substring dedup: passages of ``words`` words that an earlier document holds, too, are removed.

A window is so many consecutive words of a text, as they stand. Every word goes that some window covers which also starts in
a document with a smaller doc_id. Windows are judged on the input.

Count-min prefilter. A window is counted under the least hash of its pieces, which are half as long (a window of 50 words has 26 pieces of
25): texts that share a window share that least piece, too, so the count of the piece is never below that of the window, and there are some
13 times fewer counters than windows. Tasks count the pieces of their documents, once a document, in count-min rows, and send the cells
that are not zero. Cells are summed by segment, and two bits a cell go on: whether it is 2 or more, and whether it is ``crowd`` or more. A window whose
cells are all 2 or more is estimated repeated. The sketch grows with the bytes of the texts up to ``most_bytes``, which bounds what is broadcast; beyond
that it lets more windows through and loses none.

The second pass groups windows estimated repeated, exactly, by their piece and 64 bits of the window's own. Windows that follow
each other under one piece are one row. Tasks settle what they can among their own documents, so of a passage that a third of all
documents hold each task sends its first copy only. The rows are then dealt by piece and read in the order of piece and doc_id as a stream. A piece that
is a crowd's by the sketch, as that of near copies which differ around it, is dealt by window: all tasks have one sketch, so equal windows meet.

Null and empty texts, and texts of fewer words than a window, lose nothing. A document without doc_id is no smaller than others and has no smaller
one: it keeps all and removes nothing. Rows with one doc_id never remove words of each other; rows that are repeated whole are judged
alike. Very long texts are read whole. An empty table gives an empty one. Extra columns, whatever their names, are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import fresh, in_arrow
from lantern.llm.textscan import Words, mix, slices

#: Multiplier of the windows' hash, modulo 2 ** 64.
_STEP = 0xD6E8FEB86659FD93
_LARGEST = np.uint64((1 << 64) - 1)


@dataclass(frozen=True)
class Params:
    words: int = 50
    #: count-min rows, and cells of a row for each piece expected
    rows: int = 2
    cells: float = 2.5
    #: bound of the merged sketch, two bits a cell, which is broadcast
    most_bytes: int = 128 << 20
    #: windows that a task settles at once
    task_windows: int = 1 << 20
    #: cells of a segment of the sketch, as a power of 2
    segment: int = 20
    #: a piece that so many documents hold by the sketch is dealt out by its windows
    crowd: int = 1000

    @property
    def piece(self) -> int:
        return max(1, self.words // 2)

    @property
    def pieces(self) -> int:
        return self.words - self.piece + 1

    def width(self, text_bytes: int) -> int:
        """Cells of a row, as a power of 2, for texts of so many bytes: a word has 6 bytes, and one in (pieces + 1) / 2 starts a least piece."""
        expected = max(1.0, text_bytes / 6 * 2 / (self.pieces + 1))
        most = int(math.log2(self.most_bytes * 4 / self.rows))
        return max(16, min(most, math.ceil(math.log2(expected * self.cells))))


@dataclass
class Windows:
    """Windows of a slice: text, first word in the slice, least piece, and hash."""

    doc: np.ndarray
    start: np.ndarray
    piece: np.ndarray
    key: np.ndarray


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; those that run over the end are missing."""
    power = np.full(len(hashes) + 1, _STEP, np.uint64)
    power[0] = 1
    inverse = np.full(len(hashes) + 1, pow(_STEP, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[:-1], out=total[1:])
    n = len(hashes) - k + 1
    return mix((total[k:] - total[:n]) * inverse[:n])


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each place on."""
    span = 1
    while 2 * span <= n:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    return np.minimum(values[: len(values) - (n - span)], values[n - span :]) if n > span else values


def windows(words: Words, params: Params) -> Windows:
    """All windows inside the texts of a slice."""
    n = len(words.hash) - params.words + 1
    last = np.repeat(words.bounds[1:], words.counts)[: max(n, 0)] - params.words
    start = np.flatnonzero(np.arange(max(n, 0)) <= last)
    if not len(start):
        empty = np.zeros(0, np.uint64)
        return Windows(start, start, empty, empty)
    piece = _least(_grams(words.hash, params.piece), params.pieces)
    return Windows(words.doc[start], start, piece[start], _grams(words.hash, params.words)[start])


def _cells(piece: np.ndarray, row: int, width: int) -> np.ndarray:
    return mix(piece * np.uint64(2 * row + 3) + np.uint64(row)) >> np.uint64(64 - width)


def _partition_sketch(params: Params, width: int):
    """Rows (segment, once, more, times): cells, counted from the segment's first, that the task's documents hit once, and more often, and how often."""

    def sketch(pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = min(params.segment, width)
        for row in range(params.rows):
            cell, count = np.unique(_cells(pieces, row, width), return_counts=True)
            segment = (cell >> np.uint64(part)).astype(np.int64)
            place = (cell & np.uint64((1 << part) - 1)).astype(np.uint32)
            bounds = np.flatnonzero(np.diff(segment, prepend=-1))
            out: list[tuple] = []
            for a, b in zip(bounds, [*bounds[1:], len(cell)], strict=True):
                here, n = place[a:b], count[a:b]
                out.append((row << (width - part) | int(segment[a]), here[n == 1].tobytes(), here[n > 1].tobytes(), n[n > 1].astype(np.uint32).tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["segment", "once", "more", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for part in slices(batch.column(0)):
                found = windows(part.words(), params)
                new = np.ones(len(found.piece), bool)
                new[1:] = (found.piece[1:] != found.piece[:-1]) | (found.doc[1:] != found.doc[:-1])
                piece, doc = found.piece[new], found.doc[new]
                order = np.lexsort((piece, doc))
                piece, doc = piece[order], doc[order]
                once = np.ones(len(piece), bool)  # a document counts a piece once
                once[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
                held.append(piece[once])
                n += len(held[-1])
                if n >= params.task_windows:
                    yield from sketch(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield from sketch(np.concatenate(held))

    return run


def _merged(part: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, segment = np.zeros(1 << part, np.uint32), None
        for batch in batches:
            segment = batch.column(0)[:1]
            for once, more, times in zip(*batch.columns[1:], strict=True):
                cell = np.frombuffer(once.as_buffer(), np.uint32)
                count[cell] = np.minimum(count[cell] + 1, crowd)
                cell = np.frombuffer(more.as_buffer(), np.uint32)
                count[cell] = np.minimum(count[cell] + np.frombuffer(times.as_buffer(), np.uint32), crowd)
        planes = (pa.array([np.packbits(count >= n, bitorder="little").tobytes()], pa.binary()) for n in (2, crowd))
        yield pa.RecordBatch.from_arrays([segment, *planes], names=["segment", "often", "crowd"])

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}  # as types, not as text
    return run


def sketch(docs: DataFrame, params: Params) -> tuple[int, np.ndarray]:
    """Width of the rows, and the merged sketch of column ``text`` as two lines of bits, row after row: whether a cell counts 2 documents, and ``crowd``."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    width = params.width(size)
    part = min(params.segment, width)
    sent = in_arrow(docs.select("text"), _partition_sketch(params, width), "segment long, once binary, more binary, times binary")
    merged = sent.groupBy("segment").applyInArrow(_merged(part, params.crowd), "segment long, often binary, crowd binary")
    out = np.zeros((2, params.rows << (width - 3)), np.uint8)
    each = 1 << (part - 3)
    for r in merged.toLocalIterator():  # at most ``most_bytes`` in all
        for plane, bits in enumerate((r.often, r.crowd)):
            out[plane, r.segment * each : (r.segment + 1) * each] = np.frombuffer(bits, np.uint8)
    return width, out


def _estimated(piece: np.ndarray, bits: np.ndarray, width: int, rows: int) -> np.ndarray:
    """Places of the windows whose cells are all set in a line of the sketch."""
    at = np.arange(len(piece))
    for row in range(rows):
        cell = _cells(piece[at], row, width) + np.uint64(row << width)
        at = at[(bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    return at


def _first_of(piece: np.ndarray, key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least doc among the windows equal to each."""
    order = np.lexsort((doc, key, piece))
    p, k = piece[order], key[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
    out = np.empty(len(doc), doc.dtype)
    out[order] = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


#: Windows of a row: their marks are the bits of a long.
_ROW = 48
_BLOCKS = "deal long, piece long, doc long, version long, start int, gone long, keys binary"


def _blocks(shared, params: Params, width: int):
    """Windows estimated repeated, as rows of consecutive ones under one piece.

    ``gone`` marks those that an earlier document of the task holds. ``keys`` are the hashes of the others that are the first copy
    in the task, with their places in the row (a byte before each key); rows without keys are done, and are dealt out at random.
    """

    def settle(piece, key, doc, version, start, crowd) -> pa.RecordBatch:
        first = _first_of(piece, key, doc)
        gone = doc > first
        alone = crowd & ~gone  # a row of its own
        new = np.ones(len(piece), bool)
        new[1:] = alone[1:] | alone[:-1] | (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        place = np.arange(len(piece)) - head[np.cumsum(new) - 1]
        new |= place % _ROW == 0
        head, place = np.flatnonzero(new), place % _ROW
        marks = np.add.reduceat(np.where(gone, np.int64(1) << place, 0), head)
        packed = np.zeros(len(piece), np.dtype([("place", "u1"), ("key", "<u8")]))
        packed["place"], packed["key"] = place, key
        left = np.concatenate([[0], np.cumsum(~gone)])
        offsets = (packed.itemsize * left[np.append(head, len(piece))]).astype(np.int32)
        open_ = np.diff(offsets) > 0
        keys = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed[~gone].tobytes())])
        deal = np.where(open_, np.where(alone[head], mix(piece[head] ^ key[head]), piece[head]), mix(doc[head].astype(np.uint64) * np.uint64(_STEP) + start[head].astype(np.uint64)))
        columns = [deal.view(np.int64), piece[head].view(np.int64), doc[head], version[head], start[head].astype(np.int32), marks]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), keys], names=["deal", "piece", "doc", "version", "start", "gone", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            ids, versions = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(2)):
                words = part.words()
                found = windows(words, params)
                at = _estimated(found.piece, bits[0], width, params.rows)
                row, crowd = part.first + found.doc[at], np.zeros(len(at), bool)
                crowd[_estimated(found.piece[at], bits[1], width, params.rows)] = True
                held.append((found.piece[at], found.key[at], ids[row].astype(np.int64), versions[row].astype(np.int64), found.start[at] - words.bounds[found.doc[at]], crowd))
                n += len(at)
                if n >= params.task_windows:
                    yield from flush()
                    held, n = [], 0
        yield from flush()

    return run


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks what an earlier document holds, for rows in the order of deal, piece and doc; only the first documents of the current deal are held."""
    current, firsts = None, {}
    for batch in batches:
        deal, piece, doc, version, start, gone, keys = batch.columns
        deal, piece, doc, gone = deal.to_numpy(), piece.to_numpy(), doc.to_numpy(), gone.to_numpy().copy()
        raw = np.frombuffer(b"".join(keys.to_pylist()), np.dtype([("place", "u1"), ("key", "<u8")]))
        count = np.array([len(k) for k in keys.to_pylist()], np.int64) // 9
        owner = np.repeat(np.arange(batch.num_rows), count)
        if len(owner):
            first = _first_of(piece[owner], raw["key"], doc[owner])
            if current is not None:
                for i in np.flatnonzero(deal[owner] == current):
                    first[i] = min(first[i], firsts.get((int(piece[owner[i]]), int(raw["key"][i])), first[i]))
            late = doc[owner] > first
            np.bitwise_or.at(gone, owner[late], np.int64(1) << raw["place"][late].astype(np.int64))
            last = deal[owner[-1]]
            if last != current:
                current, firsts = last, {}
            mine = deal[owner] == last
            for p, k, d in zip(piece[owner][mine].tolist(), raw["key"][mine].tolist(), first[mine].tolist(), strict=True):
                firsts[p, k] = min(firsts.get((p, k), d), d)
        some = pa.array(gone != 0)
        yield pa.RecordBatch.from_arrays([pa.array(doc).filter(some), version.filter(some), start.filter(some), pa.array(gone).filter(some)], names=["doc", "version", "start", "gone"])


def repeated(docs: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """doc, version (64 bits of the text), start, gone: window start + i of the document is repeated if bit i of ``gone`` is set."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("version"), "text")
    width, bits = sketch(rows, params)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    blocks = in_arrow(rows, _blocks(shared, params, width), _BLOCKS)
    dealt = blocks.repartition("deal").sortWithinPartitions("deal", "piece", "doc")
    return in_arrow(dealt, _settled, "doc long, version long, start int, gone long")


def _kept(text: int, spans: int, params: Params):
    """Text without its repeated windows, words joined by one space, and the number of words before and taken away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, removed = [], [], []
            for value, found in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                words = (value or "").encode().split()
                out = np.zeros(len(words) + 1, np.int64)
                for span in found or ():
                    for i in range(span["gone"].bit_length()):
                        if span["gone"] >> i & 1:
                            out[span["start"] + i] += 1
                            out[span["start"] + i + params.words] -= 1
                gone = np.cumsum(out[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words
                texts.append(b" ".join(kept))
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
            columns = [*batch.columns[:spans], *batch.columns[spans + 1 :]]
            columns[text] = pa.array(texts, pa.binary()).cast(pa.string())
            names = [f"c{i}" for i in range(len(columns) + 2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=names)

    return run


def deduplicated(docs: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """The documents with the words that are left, joined by one space, as their text, and n_words and n_removed (with ``_`` where those are taken)."""
    doc, version, spans = fresh(docs, "_doc", "_version", "_spans")
    found = repeated(docs, params).groupBy("doc", "version").agg(F.collect_list(F.struct("start", "gone")).alias(spans))  # as long as the text at most
    found = found.withColumnsRenamed({"doc": doc, "version": version})
    rows = docs.withColumns({doc: F.col("doc_id").cast("long"), version: F.xxhash64("text")}).join(found, [doc, version], "left")
    rows = rows.select(*(F.col(f"`{c}`") for c in docs.columns), spans)
    size, removed = fresh(docs, "n_words", "n_removed")
    fields = [*((f.name, f.dataType.simpleString()) for f in docs.schema), (size, "bigint"), (removed, "bigint")]
    numbered = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    places = [f"c{i} {kind}" for i, (_, kind) in enumerate(fields)]
    at = next(i for i, c in enumerate(docs.columns) if c == "text")
    return in_arrow(numbered, _kept(at, len(docs.columns), params), ", ".join(places)).toDF(*(name for name, _ in fields))
