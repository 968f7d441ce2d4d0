"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per page:

- the likelihood of the article text under byte-trigram models, tempered as trigrams overlap,
- the declared markup language, by how often each declaration goes with each language,
- the address suffix and the host, as a prior that is smoothed level by level: all pages, suffix, domain,
  host. A page's own text is left out of the counts of its host.

The counts are soft (sums of text posteriors) and come from grouped aggregation over all pages, so a host
with most pages is summed before it is shuffled. The trigram models are trained on at most ``fit_rows``
documents with a language and ``fit_bytes`` of their texts, those with the least hash.

Empty or null html: the other evidence decides. Null url: empty host, domain and suffix. No declaration:
a value of its own. Ties: the language that is first by name. Repeated rows give equal rows. Very long pages are read whole. Without any
labelled document the language is null. An empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import cut, in_arrow, sample, small
from lantern.llm.main_text import host, main_text
from lantern.llm.textscan import Slice, per_text, slices

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_HTML_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)


@dataclass(frozen=True)
class Params:
    fit_rows: int = 6000
    fit_chars: int = 20_000
    fit_bytes: int = 24 << 20
    buckets: int = 1 << 15
    #: share of the log-likelihood that counts, as neighbouring trigrams tell much the same
    temper: float = 0.15
    #: pages that a level's prior is worth on the next
    strength: float = 5.0


def trigrams(part: Slice, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram inside a text, and the bounds of the texts."""
    low = _LOWER[part.data]
    last = np.maximum(part.offsets[1:] - 2, part.offsets[:-1])
    at = np.flatnonzero(np.arange(len(low)) < np.repeat(last, np.diff(part.offsets)))
    code = (low[at] << np.uint64(16)) | (low[at + 1] << np.uint64(8)) | low[at + 2]
    place = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - buckets.bit_length() + 1)
    return place.astype(np.int64), np.searchsorted(at, part.offsets)


def train(docs: DataFrame, params: Params) -> tuple[list[str], np.ndarray]:
    """The languages, and log P(trigram | language) as [bucket, language]."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= params.fit_chars))
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "text", "lang").alias("h"))
    last = usable.groupBy("h").agg(F.lit(1).alias("one")).orderBy("h").limit(params.fit_rows).agg(F.max("h")).first()[0]
    rows = usable.filter(F.col("h") <= (last if last is not None else 0)).groupBy("h").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))  # fit_rows at most
    rows = sample(rows, "h", "text", params.fit_bytes)
    languages = sorted({r.lang for r in rows})
    counts = np.full((params.buckets, len(languages)), 0.1)
    for i, language in enumerate(languages):
        for part in slices(pa.array([r.text for r in rows if r.lang == language], pa.large_string())):
            counts[:, i] += np.bincount(trigrams(part, params.buckets)[0], minlength=params.buckets)
    return languages, np.log(counts / counts.sum(axis=0))


def log_likelihoods(part: Slice, model: np.ndarray) -> np.ndarray:
    place, bounds = trigrams(part, len(model))
    out = np.zeros((part.n, model.shape[1]))
    for i in range(model.shape[1]):
        total = np.concatenate([[0.0], np.cumsum(model[place, i])])
        out[:, i] = total[bounds[1:]] - total[bounds[:-1]]
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _evidence(model: np.ndarray, params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, declared = [], []
            for i in range(batch.num_rows):
                page = batch.column("html")[i].as_py() or ""
                found = _HTML_LANG.search(page)
                declared.append(found[1].lower() if found else "")
                texts.append(main_text(page))
            parts = [log_likelihoods(p, model) for p in slices(pa.array(texts, pa.large_string()))]
            weight = params.temper * np.concatenate(parts) if parts else np.zeros((0, model.shape[1]))
            weight -= weight.max(axis=1, keepdims=True) if len(weight) else 0
            post = _softmax(weight) if len(weight) else weight
            arrays = [batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(declared, pa.string())]
            arrays += [pa.array(list(x), pa.list_(pa.float64())) for x in (weight, post)]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "host", "declared", "weight", "post"])

    return run


def _sum(n: int, column: str = "post") -> Column:
    return F.array(*(F.sum(F.col(column)[i]) for i in range(n)))


def _smoothed(counts: Column, prior: Column, strength: float) -> Column:
    """(count + strength x prior) / (all + strength), by language."""
    every = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, p: (c + strength * p) / (every + strength))


def identify(pages: DataFrame, docs: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """page_id, url, lang, confidence, text_lang (by text alone), declared, host: one row a page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    languages, model = train(docs, params)
    n = len(languages)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host())
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("page_id", "url", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), none.alias("declared"), "host")
    seen = cut(in_arrow(rows, _evidence(model, params), f"page_id {kind}, url string, host string, declared string, weight array<double>, post array<double>"))
    labels = F.split("host", r"\.")
    hosts = cut(seen.groupBy("host").agg(_sum(n).alias("n_host")))
    hosts = hosts.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    domains = cut(hosts.groupBy("suffix", "domain").agg(_sum(n, "n_host").alias("n_domain")))
    suffixes = cut(domains.groupBy("suffix").agg(_sum(n, "n_domain").alias("n_suffix")))
    world = suffixes.agg(_sum(n, "n_suffix").alias("n_all"))
    flat = F.array(*(F.lit(1.0 / n) for _ in languages))
    one = F.broadcast(world.select(_smoothed(F.coalesce("n_all", F.transform(flat, lambda x: F.lit(0.0))), flat, 1.0).alias("p_all")))  # one row
    suffixes = cut(suffixes.crossJoin(one).select("suffix", _smoothed(F.col("n_suffix"), F.col("p_all"), params.strength).alias("p_suffix")))
    domains = cut(domains.join(small(suffixes), "suffix").select("domain", "suffix", _smoothed(F.col("n_domain"), F.col("p_suffix"), params.strength).alias("p_domain")))
    priors = small(cut(hosts.join(small(domains), ["suffix", "domain"]).select("host", "n_host", "p_domain")))
    said = seen.groupBy("declared").agg(_sum(n).alias("n_declared"))
    totals = F.broadcast(world.select("n_all"))  # one row
    values = F.count(F.lit(1))
    kinds = cut(said.crossJoin(totals))
    many = F.broadcast(kinds.agg(values.cast("double").alias("kinds")))  # one row
    said = kinds.crossJoin(many).select("declared", F.zip_with("n_declared", "n_all", lambda c, a: (c + 1.0) / (a + F.col("kinds"))).alias("p_declared"))
    joined = seen.join(priors, "host").join(small(cut(said)), "declared")
    rest = F.zip_with("n_host", "post", lambda c, p: F.greatest(c - p, F.lit(0.0)))
    total = F.zip_with(F.zip_with("weight", _smoothed(rest, F.col("p_domain"), params.strength), lambda w, p: w + F.log(p)), "p_declared", lambda w, p: w + F.log(p))
    names = F.array(*(F.lit(x) for x in languages))
    best = F.array_position("total", F.array_max("total")).cast("int")
    spread = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("total")))
    text_best = F.element_at(names, F.array_position("weight", F.array_max("weight")).cast("int"))
    return joined.withColumn("total", total).select("page_id", "url", F.element_at(names, best).alias("lang"), (1 / spread).alias("confidence"), text_best.alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), "host")
