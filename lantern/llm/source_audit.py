"""Source divergence audit: how far the words of a language's sources differ, and which words tell a source apart.

Terms are runs of letters: A-Z (lowered), a-z and everything beyond ASCII. A language keeps the terms that at least ``least_documents`` of its
documents hold. Each source of a language, and the language, give a kept term that stands there n times
p = 1 + floor(1,000,000,000 (n + 5) / (N + 5 V)), where V are the language's kept terms and N is the sum of n over them.

Deduplicated count columns. A term is, to every pair of sources, only its counts by source; most terms share these with others. So terms are
grouped by their vector of (source, count), sources where they do not stand left out. A pair of sources is evaluated once for each distinct vector, and
the difference is multiplied by the number of its terms. Where a term stands in neither source, the difference is the same for all of them, so a vector
is evaluated only for the pairs of which it holds a source: beyond that the difference counts once for each kept term. The ranks of a source's terms
are cut by vector first, and the vectors that are left become terms again.

Tasks count the terms of their documents in tables of a bounded size before anything is shuffled, so a source or term with most of the rows is no hot
key. A vector is as long as its language has sources at most. All arithmetic is exact: decimals for p, integers for sums.

Null text, lang and source are ''. Sources without a kept term, and languages without any, take part with n = 0; a pair's value is 0 where V is 0. Rows
repeated whole count each. Very long texts are read whole. Ties go by the item's UTF-8 bytes. An empty table gives no row. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.common import cut, in_arrow, small

# Fixed values of the measure: scale and smoothing.
SCALE, SMOOTH = 1_000_000_000, 5


@dataclass(frozen=True)
class Params:
    least_documents: int = 30
    top: int = 50
    #: entries of a task's table of counts, vectors of a block, and cells of a task's table of pairs
    entries: int = 1 << 19
    vectors: int = 4096
    cells: int = 1 << 22


#: ASCII letters lowered, the rest of ASCII as space, other bytes as they are.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counter(entries: int):
    """Rows (lang, source, term, n, n_docs) of the batches, from a table of ``entries`` terms and a document's, at most."""
    documents = 1 << 40  # a count holds the term's documents above its occurrences

    def table(found: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in found.items():
            terms, both = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            for i in range(0, len(terms), 1 << 16):
                term, n = pa.array(terms[i : i + (1 << 16)], pa.binary()).cast(pa.string()), both[i : i + (1 << 16)]
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(n)), pa.repeat(pa.scalar(source, pa.string()), len(n)), term, pa.array(n % documents), pa.array(n // documents)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "n_docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0
        for batch in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = found.setdefault((lang, source), {})
                size -= len(counts)
                for term, n in Counter(text.encode().translate(_LETTERS).split()).items():
                    counts[term] = counts.get(term, 0) + n + documents
                size += len(counts)
                if size >= entries:
                    yield from table(found)
                    found, size = {}, 0
        yield from table(found)

    return run


def _share(n: Column, total: Column, terms: Column) -> Column:
    """p of a term; exact up to some 10 ** 28 words."""
    wide = "decimal(38,0)"
    return F.when(terms > 0, (F.call_function("div", F.lit(SCALE).cast(wide) * (n + SMOOTH).cast("decimal(20,0)"), (total + SMOOTH * terms).cast("decimal(20,0)")) + 1).cast("long"))


def _pairs(cells: int):
    """Rows (lang, a, b, value): for the vectors of a block, how much more a pair's difference is than where a term stands in neither.

    Sources are numbers from 0. A row of vectors holds, for each of them, its number of terms (times), and the sources (held) and their p (share).
    """

    def rows(lang: str, total: np.ndarray, first: int = 0) -> pa.RecordBatch:
        a, b = np.nonzero(total)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + first, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b], pa.int64())], names=["lang", "a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, nothing, vectors in zip(*(batch.column(c).to_pylist() for c in ("lang", "nothing", "vectors")), strict=True):
                nothing = np.array(nothing, np.int64)
                times = np.array([v["times"] for v in vectors], np.int64)
                owner = np.repeat(np.arange(len(vectors)), [len(v["held"]) for v in vectors])
                place = np.array([i for v in vectors for i in v["held"]], np.int64)
                share = np.array([p for v in vectors for p in v["share"]], np.int64)
                order = np.argsort(place, kind="stable")
                owner, place, share = owner[order], place[order], share[order]
                bounds = np.searchsorted(place, np.arange(len(nothing) + 1))
                size = len(nothing)
                whole = size * size <= cells
                if whole and lang not in held:
                    if (len(held) + 1) * size * size > cells:
                        for k, total in held.items():
                            yield rows(k, total)
                        held = {}
                    held[lang] = np.zeros((size, size), np.int64)
                step = max(1, cells // max(len(vectors), 1))
                for a in range(size):
                    mine, p = owner[bounds[a] : bounds[a + 1]], share[bounds[a] : bounds[a + 1]]
                    if not len(mine):
                        continue
                    line, only = np.zeros(size, np.int64), np.zeros(size, np.int64)
                    for low in range(0, size, step):  # some sources at a time, so that a block's table is bounded
                        high = min(size, low + step)
                        table = np.tile(nothing[low:high], (len(vectors), 1))
                        stands = np.zeros(table.shape, bool)
                        x, y = bounds[low], bounds[high]
                        table[owner[x:y], place[x:y] - low] = share[x:y]
                        stands[owner[x:y], place[x:y] - low] = True
                        more = (np.abs(p[:, None] - table[mine]) - np.abs(nothing[a] - nothing[low:high])) * times[mine, None]
                        line[low:high] = more.sum(axis=0)
                        only[low:high] = (more * ~stands[mine]).sum(axis=0)
                    if whole:
                        held[lang][a] += line
                        held[lang][:, a] += only
                    else:
                        yield rows(lang, line[None], a)
                        back = rows(lang, only[None], a)
                        yield pa.RecordBatch.from_arrays([back.column(0), back.column(2), back.column(1), back.column(3)], names=back.schema.names)
        for k, total in held.items():
            yield rows(k, total)

    return run


def audit(docs: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """lang, source, part (``pair`` or ``term``), item, value, rank: for each source of a language its distance to every other, and its terms."""
    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = in_arrow(texts, _counter(params.entries), "lang string, source string, term string, n long, n_docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("no")  # a row a source
    sources = cut(texts.select("lang", "source").distinct().select("lang", "source", number))
    terms = counted.join(small(sources), ["lang", "source"])
    vector = F.array_sort(F.collect_list(F.struct("no", "n"))).alias("vector")  # an entry a source at most
    kept = terms.groupBy("lang", "term").agg(F.sum("n_docs").alias("_docs"), vector).filter(F.col("_docs") >= params.least_documents)
    kept = cut(kept.select("lang", "term", "vector"))
    distinct = cut(kept.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times")))

    words = distinct.select("lang", "times", F.explode("vector").alias("v")).groupBy("lang", F.col("v.no").alias("no")).agg(F.sum(F.col("v.n") * F.col("times")).alias("words"))
    vocabulary = distinct.groupBy("lang").agg(F.sum("times").alias("terms"))
    groups = sources.join(words, ["lang", "no"], "left").join(vocabulary, "lang", "left").fillna(0, ["words", "terms"])
    groups = cut(groups.withColumn("nothing", F.coalesce(_share(F.lit(0), F.col("words"), F.col("terms")), F.lit(0))))
    langs = groups.groupBy("lang").agg(F.sum("words").alias("all_words"), F.max("terms").alias("terms"), F.array_sort(F.collect_list(F.struct("no", "nothing"))).alias("_nothing"), F.count(F.lit(1)).alias("n_sources"))
    langs = langs.withColumn("nothing", F.transform("_nothing", lambda x: x["nothing"])).drop("_nothing")  # an entry a source

    entry = distinct.select("lang", "vector", "times", F.aggregate("vector", F.lit(0).cast("long"), lambda s, v: s + v["n"]).alias("n_lang"), F.explode("vector").alias("v"))
    entry = entry.select("lang", "vector", "times", "n_lang", F.col("v.no").alias("no"), F.col("v.n").alias("n")).join(small(groups.select("lang", "no", "words", "terms")), ["lang", "no"])
    entry = cut(entry.withColumn("p", _share(F.col("n"), F.col("words"), F.col("terms"))))
    return _pair_rows(entry, groups, langs, params).unionByName(_term_rows(entry, kept, sources, langs, params))


def _pair_rows(entry: DataFrame, groups: DataFrame, langs: DataFrame, params: Params) -> DataFrame:
    of = F.struct("times", "held", "share")
    vectors = entry.groupBy("lang", "vector", "times").agg(F.sort_array(F.collect_list(F.struct("no", "p"))).alias("e"))
    vectors = vectors.select("lang", "times", F.xxhash64("vector").alias("h"), F.transform("e", lambda x: x["no"]).alias("held"), F.transform("e", lambda x: x["p"]).alias("share"))
    blocks = vectors.join(F.broadcast(_sized(vectors, params)), "lang").groupBy("lang", F.pmod("h", F.col("n_blocks")).alias("block")).agg(F.collect_list(of).alias("vectors"))  # about ``vectors`` of them
    blocks = blocks.join(langs.select("lang", "nothing"), "lang").select("lang", "nothing", "vectors")
    more = in_arrow(blocks, _pairs(params.cells), "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    one = groups.select("lang", "source", F.col("no").alias("a"), F.col("nothing").alias("p"), "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("b"), F.col("nothing").alias("q"))
    both = one.join(other, "lang").filter("a != b").join(more, ["lang", "a", "b"], "left")  # all pairs are what is asked for
    value = F.col("terms") * F.abs(F.col("p") - F.col("q")) + F.coalesce("more", F.lit(0))
    return _ranked(both.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))


def _sized(vectors: DataFrame, params: Params) -> DataFrame:
    """Blocks of each language; a row a language."""
    return vectors.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / params.vectors).alias("n_blocks"))


def _ranked(rows: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank)


def _term_rows(entry: DataFrame, kept: DataFrame, sources: DataFrame, langs: DataFrame, params: Params) -> DataFrame:
    """Vectors that fewer than ``top`` others of a source are above hold its first terms; the rank is cut before rows are shuffled."""
    whole = entry.join(small(langs.select("lang", "all_words")), "lang").withColumn("q", _share(F.col("n_lang"), F.col("all_words"), F.col("terms")))
    above = whole.filter("p > q").select("lang", "no", "vector", (F.col("p") - F.col("q")).alias("value"))
    place = F.rank().over(Window.partitionBy("lang", "no").orderBy(F.desc("value")))
    first = above.withColumn("_place", place).filter(F.col("_place") <= params.top).drop("_place")
    named = first.join(kept, ["lang", "vector"]).join(small(sources), ["lang", "no"])
    rows = named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return _ranked(rows).filter(F.col("rank") <= params.top)
