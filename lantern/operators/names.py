"""Tables of names against texts: links, segments and first mentions, in narrow steps without a join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.names import BETWEEN, Trie, apart, byte_places, firsts, joined
from lantern.functions.text import html_escaped
from lantern.llm.common import cut, in_arrow

_PLACE = "array<struct<start:int,end:int,rank:bigint,value:string>>"
_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rank", pa.int64()), ("value", pa.string())]))
_CUT = pa.list_(pa.struct([("text", pa.string()), ("value", pa.string())]))
#: Names of a block at most, about; letters of the names, and of all that goes with them.
BLOCK, LETTERS, VALUE_LETTERS = 400_000, 8_000_000, 32_000_000


def _kept(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema)


def blocks_of(names: DataFrame, block: int, letters: int = LETTERS, values: int = VALUE_LETTERS) -> Iterator[pa.Table]:
    """Rows (name, name_ord, value) in blocks of about ``block`` names and so many letters, so what goes to the tasks with each has a bound; counted first."""
    total = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0))
    count, size, more = names.agg(F.count(F.lit(1)), total("name"), total("value")).first()
    n = max(math.ceil(count / block), math.ceil(size / letters), math.ceil(more / values))
    for part in range(n):
        rows = names.filter(F.pmod(F.xxhash64("name"), F.lit(n)) == part).toArrow()  # about ``block`` names
        if rows.num_rows:
            yield rows


def _apart(rows: DataFrame) -> DataFrame:
    """The rows written down between two blocks, where there is a shared folder: no task holds the workers of more than one block then."""
    return cut(rows) if rows.sparkSession.conf.get("spark.checkpoint.dir", None) else rows


def pieces(rows: DataFrame, text: str, names: DataFrame, longest: bool = True, fold: bool = False, block: int = BLOCK) -> DataFrame:
    """The rows with ``pieces``: the text as an array of (text, value) in order, where ``value`` is that of a name, or null between names.

    ``names``: (name_ord, name, value), any number of rows. Names stand anywhere, do not overlap and are taken from the left; of those that
    begin together the longest counts (``longest``) or that of least name_ord. ``fold``: ASCII letters of either case are equal.
    Of names given twice that of least name_ord counts, then the least value; empty names and rows with a null do not. Null and empty texts have
    no pieces; a column ``pieces`` of the rows is replaced.
    Each block of names is one narrow step over the rows, which carry their places along, so nothing is joined. A task holds the names of a block
    and a few texts at a time, whatever the batches.
    """
    plain = names.select(F.col("name_ord").cast("bigint").alias("name_ord"), F.col("name").cast("string").alias("name"), F.col("value").cast("string").alias("value"))
    key = F.translate("name", ascii_uppercase, ascii_lowercase) if fold else F.col("name")
    first = plain.filter("length(name) > 0 and name_ord is not null and value is not null").groupBy(key.alias("key")).agg(F.min(F.struct("name_ord", "value")).alias("f"))
    first = first.select(F.col("key").alias("name"), "f.name_ord", "f.value")
    out, held = rows.drop("pieces"), None
    schema = _kept(out)
    for some in blocks_of(first, block):
        if held is not None:
            out = _apart(in_arrow(out, _with_places(held, text, longest, fold), f"{schema}, pieces {_PLACE}"))
        held = some
    held = first.limit(0).toArrow() if held is None else held
    return in_arrow(out, _with_places(held, text, longest, fold, last=True), f"{schema}, pieces array<struct<text:string,value:string>>")


def _with_places(some: pa.Table, text: str, longest: bool, fold: bool, last: bool = False):
    trie, ords = Trie(some["name"].to_pylist(), fold), some["name_ord"].to_numpy()
    values = some["value"].combine_chunks().cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for first, after, codes, begins in joined(texts):
                part = batch.slice(first, after - first)
                start, end, name = trie.found(codes)
                found = _Places(start, end, start - end if longest else ords[name], values.take(pa.array(name)))
                found = found.at(firsts(found.start, found.rank))
                if "pieces" in part.schema.names:
                    found = found.with_held(part.column(part.schema.get_field_index("pieces")), begins)
                yield _replaced(part, _cut(found, codes, begins) if last else _listed(found, begins))

    return run


class _Places(NamedTuple):
    """Places in texts that stand one after the other."""

    start: np.ndarray
    end: np.ndarray
    rank: np.ndarray
    value: pa.Array

    def at(self, some: np.ndarray) -> _Places:
        return _Places(self.start[some], self.end[some], self.rank[some], self.value.take(pa.array(some, pa.int64())))

    def with_held(self, held: pa.Array, begins: np.ndarray) -> _Places:
        """With those of other blocks; of places that begin together that of least rank."""
        flat = held.flatten()
        start, end, rank = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        here = np.repeat(begins, pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64))
        value = pa.concat_arrays([self.value, flat.field(3).cast(pa.string())])
        all_ = _Places(np.concatenate([self.start, start + here]), np.concatenate([self.end, end + here]), np.concatenate([self.rank, rank]), value)
        return all_.at(firsts(all_.start, all_.rank))


def _lists(ends: np.ndarray, columns: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """Lists of structs, given where each ends."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind)


def _listed(found: _Places, begins: np.ndarray) -> pa.Array:
    row = np.searchsorted(begins, found.start, "right") - 1
    ends = np.searchsorted(row, np.arange(len(begins)), "right")
    return _lists(ends, [pa.array(found.start - begins[row], pa.int32()), pa.array(found.end - begins[row], pa.int32()), pa.array(found.rank, pa.int64()), found.value], _PLACES)


def _cut(found: _Places, codes: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The pieces of the texts: the texts themselves, one after the other, cut where the places that stay and the texts begin and end."""
    kept = found.at(np.array(apart(found.start, found.end, found.rank), np.int64))
    texts_end = np.append(begins[1:], len(codes)) - 1
    cuts = np.unique(np.concatenate([begins, texts_end, kept.start, kept.end]))
    start = cuts[:-1]
    start = start[codes[start] != BETWEEN]  # what begins with the end of a text is no piece
    named = np.searchsorted(kept.start, start)
    value = np.where(named < len(kept.start), kept.start[np.minimum(named, len(kept.start) - 1)] == start, False) if len(kept.start) else np.zeros(len(start), bool)
    places = byte_places(codes)
    offsets = np.append(places[start], places[-1]).astype(np.int32)
    whole = codes[codes != BETWEEN].astype("<u4").tobytes().decode("utf-32-le").encode()
    text = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(whole))
    return _lists(np.searchsorted(start, texts_end), [text, kept.value.take(pa.array(named, pa.int64(), mask=~value))], _CUT)


def _replaced(batch: pa.RecordBatch, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != "pieces"]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), column], names=[*names, "pieces"])


def linked_by_table(rows: DataFrame, text: str, names: DataFrame, out: str = "linked", block: int = BLOCK) -> DataFrame:
    """The rows with the escaped text in ``out``, every name of (name, page) a link to its figure, in the case of the table.

    As ``text.linked``, for tables of names: longer names win, ASCII case does not count, links are never linked again.
    """
    shown = html_escaped(F.col("name"))
    anchor = F.concat(F.lit('<a href="/figure/'), F.col("page").cast("string"), F.lit('" class="fig-link">'), shown, F.lit("</a>"))
    table = names.filter("length(name) > 0 and page is not null").select(F.lit(0).alias("name_ord"), shown.alias("name"), anchor.alias("value"))
    cut = pieces(rows.withColumn(out, html_escaped(F.col(text))), out, table, fold=True, block=block)
    return cut.withColumn(out, F.when(F.col(out).isNotNull(), F.array_join(F.transform("pieces", lambda p: F.coalesce(p["value"], p["text"])), ""))).drop("pieces")


def segments_by_table(rows: DataFrame, text: str, names: DataFrame, out: str = "segments", block: int = BLOCK) -> DataFrame:
    """The rows with ``out``: the text as (text, is_name) in order, for names of (name_ord, name) in their exact case; the first given counts."""
    table = names.select("name_ord", "name", F.col("name").alias("value"))
    part = lambda p: F.struct(p["text"].alias("text"), p["value"].isNotNull().alias("is_name"))
    return pieces(rows, text, table, longest=False, block=block).withColumn(out, F.transform("pieces", part)).drop(*([] if out == "pieces" else ["pieces"]))


def first_mentioned(rows: DataFrame, text: Column, names: DataFrame, block: int = BLOCK) -> DataFrame:
    """[J3] The rows that hold a name of (name_ord, name, value), with ``figure_ord`` and ``figure_id`` (the value) of the least name_ord, then value."""
    first = names.filter("length(name) > 0").groupBy("name").agg(F.min(F.struct("name_ord", "value")).alias("f")).select("name", "f.name_ord", "f.value")
    rows = rows.drop("figure_ord", "figure_id")
    schema = _kept(rows)
    out = rows.withColumn("_text", text).withColumn("figure_ord", F.lit(None).cast("int")).withColumn("figure_id", F.lit(None).cast("string"))
    for k, some in enumerate(blocks_of(first, block)):
        out = in_arrow(_apart(out) if k else out, _with_first(some), f"{schema}, _text string, figure_ord int, figure_id string")
    return out.filter("figure_ord is not null").drop("_text")


def _with_first(some: pa.Table):
    # In order of their figures, so the least number of a name found is the first figure.
    some = some.sort_by([("name_ord", "ascending"), ("value", "ascending")])
    trie, figure_ord, figure_id = Trie(some["name"].to_pylist()), some["name_ord"].to_numpy(), some["value"].combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ords, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("_text", "figure_ord", "figure_id"))
            ords, ids = ords.to_pylist(), ids.to_pylist()
            for first, after, codes, begins in joined(texts):
                least = np.full(after - first, len(figure_ord), np.int64)
                start, _, name = trie.found(codes)
                np.minimum.at(least, np.searchsorted(begins, start, "right") - 1, name)
                for r in np.flatnonzero(least < len(figure_ord)).tolist():
                    found = int(figure_ord[least[r]]), figure_id[int(least[r])].as_py()
                    if ords[first + r] is None or found < (ords[first + r], ids[first + r]):
                        ords[first + r], ids[first + r] = found
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(ords, pa.int32()), pa.array(ids, pa.string())], names=batch.schema.names)

    return run
