"""Quality rules from tokeniser fertility.

A public vocabulary (BPE with byte fallback) measures each whole text: characters per token, the
share of byte-fallback tokens and the entropy of its tokens. Rejection bands per language come from all documents that
pass the base rules: characters per token around the language's median, entropy around the median of the language's texts of
like length, as it grows with the length, and the byte share up to a little above the median.

A figure of few tokens varies more, so no text is too short to be judged: its deviation is divided by
sqrt(1 + spread_tokens / tokens) first. Half the distance between the quartiles of these deviations, which is the MAD of a symmetric
figure, gives the width. A language of few documents leans on the width of all languages, by ``prior_rows`` documents.

Null or empty text: no words, so the base rule fails it. Null language: group ``und``. Repeated rows
are judged alike. A deviation that equals the band's edge is inside. Very long texts are measured whole. An empty table gives
no rows. Extra columns, whatever their names, are kept as they are by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import cut, fresh, in_arrow, small, stored
from lantern.llm.textscan import Slice, per_text, runs, slices

#: Symbols counted by the base rules: # * $ % & | < >
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model"
    min_words: int = 10
    max_repeat_percent: int = 20
    #: half-widths of the bands, in standard deviations (1.4826 x MAD) and as least shares of the median
    deviations: float = 4.0
    #: (for tables of texts all alike; the languages of the given tables have wider bands by their deviations)
    least_width: float = 0.04
    #: most byte-fallback tokens above the language's median share
    byte_share: float = 0.25
    #: tokens at which a text varies by as much again as texts do anyway
    spread_tokens: int = 100
    #: documents that the width of all languages counts for in that of one
    prior_rows: int = 20


FIGURES = (
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()),
    ("byte_share", pa.float64()), ("token_entropy", pa.float64()),
)
_SQL = {pa.int64(): "long", pa.float64(): "double"}


def _repeats(words) -> np.ndarray:
    """Words in windows found twice or more in the text."""
    at, key = words.grams(WINDOW)
    often, _, _ = runs(words.doc[at], key)
    edge = np.zeros(len(words.hash) + WINDOW + 1, np.int64)
    hit = at[often > 1]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return per_text(np.cumsum(edge)[: len(words.hash)] > 0, words.bounds)


def _repeated_lines(part: Slice, words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    breaks = np.flatnonzero(part.data == 10)
    starts = np.unique(np.concatenate([part.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(part.data)]
    if not len(starts):
        return np.zeros(part.n, np.int64)
    ends = np.append(starts[1:], len(part.data))
    ends = ends - (part.data[ends - 1] == 10)
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has], ends[has]
    doc = np.searchsorted(part.offsets, starts, "right") - 1
    _, which, _ = runs(doc, words.spans(starts, ends))
    return np.bincount(doc[which > 0], minlength=part.n)


def _tokens(part: Slice, words, encoder, is_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, byte-fallback tokens and token entropy of each text; each distinct word is encoded once a slice."""
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    raw = part.data.tobytes()
    forms = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[first], words.ends[first], strict=True)]
    ids = encoder.encode(forms, num_threads=1) if forms else []
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(length.sum()))
    begin = np.cumsum(length) - length
    fallback = per_text(is_byte[flat], np.append(begin, len(flat)))
    n, b = per_text(length[which], words.bounds), per_text(fallback[which], words.bounds)
    pair, times = np.unique(words.doc * max(len(ids), 1) + which, return_counts=True)
    doc, form = np.divmod(pair, max(len(ids), 1))
    size = length[form]
    at = np.repeat(begin[form], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    key = np.repeat(doc, size) * len(is_byte) + flat[at]
    order = np.argsort(key, kind="stable")
    key, times = key[order], np.repeat(times, size)[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.add.reduceat(times, new).astype(float) if len(key) else np.zeros(0)
    owner = key[new] // len(is_byte)
    plogs = np.bincount(owner, count * np.log2(count), part.n) if len(key) else np.zeros(part.n)
    entropy = np.where(n > 0, np.log2(np.maximum(n, 1)) - plogs / np.maximum(n, 1), 0.0)
    return n, b, np.maximum(entropy, 0.0)


def _measure(part: Slice, encoder, is_byte: np.ndarray) -> list[np.ndarray]:
    words = part.words()
    inside = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    chars = per_text(inside[words.ends] - inside[words.starts], words.bounds)
    symbols = per_text(_SYMBOL[part.data], part.offsets)
    n, fallback, entropy = _tokens(part, words, encoder, is_byte)
    some = np.maximum(n, 1)
    return [words.counts, chars, symbols, _repeated_lines(part, words), _repeats(words), n, np.where(n > 0, chars / some, 0.0), fallback / some, entropy]


def _measurer(rules: Rules, text: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_file=rules.vocabulary)
        is_byte = np.array([encoder.is_byte(i) for i in range(encoder.vocab_size())])
        for batch in batches:
            parts = [_measure(p, encoder, is_byte) for p in slices(batch.column(batch.schema.get_field_index(text)))]
            figures = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * len(FIGURES)
            arrays = [*batch.columns, *(pa.array(x).cast(kind) for x, (_, kind) in zip(figures, FIGURES, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names])

    return run


def measured(docs: DataFrame, rules: Rules, text: str = "text", names: list[str] | None = None) -> DataFrame:
    """``docs`` with the figures appended; one pass, no shuffle."""
    names = names or [name for name, _ in FIGURES]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{n}` {_SQL[kind]}" for n, (_, kind) in zip(names, FIGURES, strict=True)])
    return in_arrow(docs, _measurer(rules, text, names), schema)


def _group(language: Column) -> Column:
    return F.coalesce(language, F.lit("und"))


def _base_failed(f: dict[str, str], rules: Rules) -> Column:
    return (F.col(f["n_words"]) < rules.min_words) | (100 * F.col(f["n_repeat_words"]) > rules.max_repeat_percent * F.col(f["n_words"]))


def _length(tokens: Column) -> Column:
    """Texts of one class are at most twice as long as one another."""
    return F.floor(F.log2(F.greatest(tokens, F.lit(1))) + 1e-9)


def _wide(tokens: Column, rules: Rules) -> Column:
    """By how much a figure of so many tokens varies more than that of a long text."""
    return F.sqrt(1 + F.lit(float(rules.spread_tokens)) / F.greatest(tokens, F.lit(1)))


_SAME = {name: name for name, _ in FIGURES}


def bands(figures: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(by language: _language, _rate, _byte, _rate_width, _entropy_width; by language and class of lengths: _of, _length, _entropy).

    From column language and the figures. The percentiles are mergeable sketches, so a language with most rows is no hot key.
    """
    judged = figures.filter(~_base_failed(_SAME, rules) & (F.col("n_tokens") > 0)).withColumn("language", _group(F.col("language")))
    middle = lambda c: F.percentile_approx(c, 0.5, 5000)
    mids = cut(judged.groupBy(F.col("language").alias("_language")).agg(middle("chars_per_token").alias("_rate"), middle("byte_share").alias("_byte")))
    lengths = cut(judged.groupBy(F.col("language").alias("_of"), _length(F.col("n_tokens")).alias("_length")).agg(middle("token_entropy").alias("_entropy")))
    both = judged.join(small(mids), F.col("language") == F.col("_language")).join(small(lengths), (F.col("language") == F.col("_of")) & (_length(F.col("n_tokens")) == F.col("_length")))
    wide = _wide(F.col("n_tokens"), rules)
    both = both.select("_language", ((F.col("chars_per_token") - F.col("_rate")) / wide).alias("r"), ((F.col("token_entropy") - F.col("_entropy")) / wide).alias("e"))
    half = lambda c: (F.percentile_approx(c, [0.25, 0.75], 5000)[1] - F.percentile_approx(c, [0.25, 0.75], 5000)[0]) / 2
    own = both.groupBy("_language").agg(F.count(F.lit(1)).alias("rows"), half("r").alias("r"), half("e").alias("e"))
    every = F.broadcast(both.agg(half("r").alias("all_r"), half("e").alias("all_e")))  # one row
    k = F.lit(rules.prior_rows)
    width = lambda c: 1.4826 * rules.deviations * (F.col(c) * F.col("rows") + F.col(f"all_{c}") * k) / (F.col("rows") + k)
    widths = own.crossJoin(every).select("_language", width("r").alias("_rate_width"), width("e").alias("_entropy_width"))
    return cut(mids.join(widths, "_language")), lengths


def verdict(rows: DataFrame, limits: tuple[DataFrame, DataFrame], rules: Rules, language: str, f: dict[str, str], failed: str, kept: str) -> DataFrame:
    """``rows`` with the columns ``failed`` (base rules) and ``kept`` (base rules and bands)."""
    names = [c for table in limits for c in table.columns]
    renamed = dict(zip(names, fresh(rows, *names), strict=True))
    by_language, by_length = (small(t).select(F.struct("*").alias(n)) for t, n in zip(limits, fresh(rows, "_limits", "_lengths"), strict=True))
    own, like = by_language.columns[0], by_length.columns[0]
    key = _group(F.col(f"`{language}`"))
    x = rows.join(by_language, key == F.col(f"{own}._language"), "left").join(by_length, (key == F.col(f"{like}._of")) & (_length(F.col(f["n_tokens"])) == F.col(f"{like}._length")), "left")
    x = x.withColumns({renamed[c]: F.col(f"{own}.{c}") for c in limits[0].columns} | {renamed[c]: F.col(f"{like}.{c}") for c in limits[1].columns})
    at = {c: F.col(renamed[c]) for c in names}
    wide = _wide(F.col(f["n_tokens"]), rules)
    off = lambda figure, middle, width: F.abs(F.col(f[figure]) - at[middle]) / wide > F.greatest(at[width], rules.least_width * at[middle]) * (1 + 1e-9)
    odd = off("chars_per_token", "_rate", "_rate_width") | off("token_entropy", "_entropy", "_entropy_width") | (F.col(f["byte_share"]) > at["_byte"] + rules.byte_share)
    base = _base_failed(f, rules)
    return x.withColumn(failed, base).withColumn(kept, ~base & ~F.coalesce(odd, F.lit(False))).drop(own, like, *renamed.values())


def score(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """doc_id, the base figures, base_failed, kept, then the fertility figures: one row a document."""
    rows = cut(measured(docs.select("doc_id", F.col("lang").alias("language"), "text"), rules).drop("text"))
    judged = verdict(rows, bands(rows, rules), rules, "language", _SAME, "base_failed", "kept")
    names = [n for n, _ in FIGURES]
    return judged.select("doc_id", *names[:5], "base_failed", "kept", *names[5:])


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The documents that pass, with their own columns. They are measured once and written with their figures."""
    names = fresh(docs, *(f"_{n}" for n, _ in FIGURES), "_failed", "_kept")
    f = dict(zip((n for n, _ in FIGURES), names, strict=False))
    rows = stored(measured(docs, rules, names=names[: len(FIGURES)]))
    limits = bands(rows.select(F.col("lang").alias("language"), *(F.col(f[n]).alias(n) for n in f)), rules)
    judged = verdict(rows, limits, rules, "lang", f, names[-2], names[-1])
    return judged.filter(F.col(names[-1])).select(*(F.col(f"`{c}`") for c in docs.columns))
