"""The timeline pipeline from landed inputs: each stage is a function of tables, none writes over its input."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions import text as t
from lantern.functions import udfs
from lantern.operators import clustering, sentiment, signals, tables, timeline
from lantern.schemas import conform
from lantern.sources import landed


@dataclass(frozen=True)
class Inputs:
    """entries (landed feeds), pages (url, html), comments (event_id or null, …), figures as (id, [names])."""

    entries: DataFrame
    pages: DataFrame
    figures: list[tuple[str, list[str]]]
    domestic: tuple[str, ...] = ()


def _now(as_of: datetime) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp")


def ingest(inputs: Inputs, known: DataFrame | None, as_of: datetime) -> DataFrame:
    """Attributed entries, each address once, without those already known."""
    rows = timeline.attributed(landed.feed_articles(inputs.entries), inputs.figures).withColumn("fetched_at", _now(as_of))
    rows = tables.first_of_each(rows, "article_id", "source", "entry_ord")
    return rows if known is None else rows.join(known.select("article_id"), "article_id", "left_anti")


def to_fetch(articles: DataFrame, retry_failed: bool = False, limit: int | None = None) -> DataFrame:
    """[P8, T3, O3] Articles never tried, and failed ones if asked for, the first fetched first."""
    waiting = F.col("fetch_status").isNull()
    waiting = waiting | F.startswith("fetch_status", F.lit("error:")) if retry_failed else waiting
    return _first(articles.filter(waiting), limit, "fetched_at", "article_id")


def to_cluster(articles: DataFrame) -> DataFrame:
    """[P7, T3] Articles without an event."""
    return articles.filter("event_id is null")


def to_summarise(event_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """[T3, O3] New events, the first created first."""
    return _first(event_rows.filter(F.col("status") == "new"), limit, "created_at", "event_id")


def to_translate(articles: DataFrame, domestic: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """[P6, T3, O4] Bodies of foreign outlets without a translation, in the order of their ids; a failed one comes again."""
    outlet = F.regexp_replace("source", "^YouTube/", "")
    foreign = ~outlet.isin(*domestic) if domestic else F.lit(True)
    return _first(articles.filter(F.col("body").isNotNull() & F.col("body_original").isNull() & foreign), limit, "article_id")


def _first(rows: DataFrame, limit: int | None, *order: str) -> DataFrame:
    return rows if limit is None else tables.top(rows, limit, *(F.col(c).asc_nulls_first() for c in order))


def with_bodies(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Bodies of the pages; what went wrong is a value of fetch_status."""
    body = udfs.paragraphs("html")
    joined = articles.drop("body", "fetch_status").join(pages.select("url", "html"), "url", "left").withColumn("body", F.when(F.length("html") > 0, body))
    status = F.when(F.col("html").isNull(), "error:download").when(F.length("html") == 0, "error:empty").when(F.col("body").isNull(), "error:extract").otherwise("ok")
    return joined.withColumn("fetch_status", status).drop("html")


def with_translations(articles: DataFrame, domestic: tuple[str, ...], provider=udfs.same) -> DataFrame:
    """Foreign bodies in translation; the original is kept, and a failed translation is tried again next time."""
    outlet = F.regexp_replace("source", "^YouTube/", "")
    foreign = F.col("body").isNotNull() & ~outlet.isin(*domestic) if domestic else F.col("body").isNotNull()
    rows = articles.withColumn("body_lang", F.when(foreign, udfs.language("body")))
    other = foreign & (F.col("body_lang") != "id")
    rows = rows.withColumn("_new", F.when(other, udfs.translation(provider)(F.col("body"))))
    return rows.withColumn("body_original", F.when(F.col("_new").isNotNull(), F.col("body"))).withColumn("body", F.coalesce("_new", "body")).drop("_new")


def with_events(articles: DataFrame, names: list[str], as_of: datetime, params: clustering.Params = clustering.Params(), embed=udfs.hashed_embedding, stored: tuple[DataFrame, DataFrame] | None = None, dimension: int = 64) -> DataFrame:  # noqa: B008
    """Articles with the event that the clusterer gives them. ``stored``: events and articles of earlier runs; those still open take articles, too."""
    text = t.joined_text("title", "summary", "body")

    def measured(rows: DataFrame) -> DataFrame:
        return rows.withColumn("embedding", udfs.embedding(embed)(text)).withColumn("tokens", t.tokens(text, names))

    known = None if stored is None else clustering.open_events(stored[0], measured(stored[1]), dimension)
    found = clustering.cluster(measured(articles), params, as_of.timestamp(), known)
    return articles.drop("event_id").join(found, "article_id")


def events(articles: DataFrame, as_of: datetime) -> DataFrame:
    """One event for each group, anchored at the article that opened it."""
    heads = articles.filter(F.col("article_id") == F.col("event_id")).select("event_id", "figure_id", "title", F.coalesce("published_at", _now(as_of)).alias("event_date"))
    text = t.non_empty("body", F.col("title"))
    kinds = clustering.event_types(articles.select("event_id", text.alias("text")), clustering.EVENT_TYPES)
    return conform(heads.join(kinds, "event_id").withColumn("created_at", _now(as_of)), "events")


def summaries(articles: DataFrame, as_of: datetime, provider=udfs.first_sentences, model: str = "extractive") -> DataFrame:
    """Summaries with citations and corroboration. An event's articles are gathered, as its summary needs them all."""
    place = F.struct("published_at", "article_id", "source", "title", "summary", "body")
    docs = articles.groupBy("event_id").agg(F.array_sort(F.collect_list(place)).alias("docs"))
    texts = F.transform("docs", lambda a: F.coalesce(F.nullif(a["body"], F.lit("")), a["summary"], a["title"]))
    rows = docs.withColumn("summary_text", udfs.summary(provider)(texts)).withColumn("citations", t.citations("summary_text", F.transform("docs", lambda a: a["title"])))
    rows = rows.join(timeline.corroboration(articles), "event_id").withColumnRenamed("single_source", "single_source_flag")
    return conform(rows.withColumn("model", F.lit(model)).withColumn("generated_at", _now(as_of)), "event_summaries")


def queries(event_rows: DataFrame, figures: DataFrame, stopwords: list[str]) -> DataFrame:
    """What to search comments for, per event."""
    joined = event_rows.join(figures.select("figure_id", "name", "aliases"), "figure_id", "left")
    names = F.concat(F.array(F.coalesce("name", "figure_id")), F.coalesce("aliases", F.array().cast("array<string>")))
    return joined.select("event_id", t.search_query("title", F.coalesce("name", "figure_id"), names, stopwords).alias("query"))


def stances(comments: DataFrame, provider=udfs.lexicon_stance) -> DataFrame:
    return comments.withColumn("stance", udfs.stance(provider)(F.col("text")))


def moods(comments: DataFrame, as_of: datetime, channel: str) -> DataFrame:
    return conform(sentiment.distribution(comments).withColumn("channel", F.lit(channel)).withColumn("collected_at", _now(as_of)), "sentiment")


def coordination(comments: DataFrame, approved: DataFrame, as_of: datetime) -> DataFrame:
    """Signals over the comments of approved events."""
    rows = comments.join(approved.select("event_id"), "event_id", "left_semi")
    found = signals.signals(rows)
    out = signals.composite(rows, found).join(signals.suspicious_ids(found), "event_id", "left")
    return conform(out.withColumn("suspicious_ids", F.coalesce("suspicious_ids", F.array().cast("array<bigint>"))).withColumn("analyzed_at", _now(as_of)), "signals")


def numbered_sources(articles: DataFrame) -> DataFrame:
    """[W6] The number under which an article is cited in its event."""
    order = Window.partitionBy("event_id").orderBy(F.col("published_at").asc_nulls_first(), "article_id")
    return articles.withColumn("citation_no", F.row_number().over(order))


def current_status(log: DataFrame) -> DataFrame:
    """[T6] The last status of each event from an append-only log (event_id, at, status)."""
    return tables.latest(log, "event_id", "at", "status").select("event_id", "status")
