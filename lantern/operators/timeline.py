"""Reads over events, articles, summaries and sentiment: timelines, queues, counts and links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import contains_any
from lantern.operators.names import first_mentioned
from lantern.operators.tables import latest


def attributed(articles: DataFrame, figures: list[tuple[str, list[str]]]) -> DataFrame:
    """[J3, F2, T5] Articles with the first figure, in the given order, that they mention; others go.

    Terms are a configuration, so they are literals of one expression and no join is needed.
    """
    terms = [(figure, term) for figure, names in figures for term in names]
    text = F.concat_ws("\n", "title", "summary")
    return articles.withColumn("figure_id", contains_any(text, terms)).filter("figure_id is not null")


def attributed_by_table(articles: DataFrame, terms: DataFrame, block: int = 100_000) -> DataFrame:
    """[J3] As ``attributed`` for a table of terms (figure_ord, figure_id, term), in one narrow step for each block of about ``block`` terms."""
    names = terms.select(F.col("figure_ord").cast("int").alias("name_ord"), F.lower("term").alias("name"), F.col("figure_id").cast("string").alias("value"))
    names = names.filter("name_ord is not null and value is not null")
    return first_mentioned(articles, F.lower(F.concat_ws("\n", "title", "summary")), names, block).drop("figure_ord")


def corroboration(articles: DataFrame, event: str = "event_id", outlet: str = "source") -> DataFrame:
    """[A3 to A5] Distinct outlets of each event and whether there is only one."""
    pairs = articles.groupBy(event, outlet).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(event).agg(
        F.count(outlet).alias("n_outlets"), F.sum("n").alias("n_articles"), (F.count(outlet) < 2).alias("single_source"), F.array_sort(F.collect_list(outlet)).alias("outlets")
    )


def status_counts(figures: DataFrame, events: DataFrame, status: str) -> DataFrame:
    """[A1] Events of a status for each figure; figures without any have 0."""
    counts = events.groupBy("figure_id").agg(F.count_if(F.col("status") == status).alias("n_events"))
    return figures.join(counts, "figure_id", "left").fillna(0, ["n_events"])


def figure_counts(events: DataFrame) -> DataFrame:
    """[A2, O6] Events of each figure, the figure with the last event first; unknown dates lead."""
    counts = events.groupBy("figure_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("event_date").alias("last_at"))
    return counts.orderBy(F.col("last_at").desc_nulls_first(), "figure_id").drop("last_at")


def figure_meta(events: DataFrame, articles: DataFrame) -> DataFrame:
    """[Q11, J10] Per figure: rows of events joined to articles, distinct events, distinct outlets."""
    joined = events.select("event_id", "figure_id").join(articles.select("event_id", "source"), "event_id")
    by_event = joined.groupBy("figure_id", "event_id").agg(F.count(F.lit(1)).alias("n"))
    counts = by_event.groupBy("figure_id").agg(F.sum("n").alias("n_rows"), F.count("event_id").alias("n_events"))
    outlets = joined.groupBy("figure_id", "source").agg(F.lit(1).alias("one")).groupBy("figure_id").agg(F.count("source").alias("n_outlets"))
    return counts.join(outlets, "figure_id")


def events_fanout(events: DataFrame, articles: DataFrame, people: DataFrame) -> DataFrame:
    """[J9, Q12] Per event: rows of its articles, distinct outlets and a label of its figure; events without articles keep one row."""
    joined = events.join(articles, "event_id", "left").join(people, "figure_id", "left")
    pairs = joined.groupBy("event_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label"))
    return pairs.groupBy("event_id").agg(F.sum("n").alias("n_rows"), F.count("source").alias("n_outlets"), F.max("label").alias("label"))


def chosen(rows: DataFrame, mode: str, value: str | None = None) -> DataFrame:
    """[P15] All rows, or those of a type or a category."""
    columns = {"all": None, "type": "event_type", "category": "category"}
    if mode not in columns:
        raise ValueError(f"no such filter: {mode}")
    return rows if columns[mode] is None else rows.filter(F.col(columns[mode]) == value)


def toggled(current: tuple[str, str | None], picked: tuple[str, str | None]) -> tuple[str, str | None]:
    """[P15] The filter after one is picked: picking the one that holds lifts it."""
    return ("all", None) if current == picked else picked


def queue(events: DataFrame, summaries: DataFrame, articles: DataFrame, status: str = "summarized") -> DataFrame:
    """[J1, J11, A20] Events to review with their summary and their articles as a nested list by time."""
    lists = articles.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("published_at", "article_id", "source", "title", "url"))).alias("articles"))
    rows = events.filter(F.col("status") == status).join(summaries, "event_id").join(lists, "event_id", "left")
    return rows.withColumn("n_citations", F.coalesce(F.size("citations"), F.lit(0))).withColumn("single_source", F.col("single_source_flag").cast("boolean")).orderBy(F.col("event_date").desc_nulls_last(), "event_id")


def timeline(events: DataFrame, summaries: DataFrame, sentiment: DataFrame, figure: str | None = None) -> DataFrame:
    """[J1, J4, O2] Approved events with summary and latest sentiment, the last first."""
    rows = events.filter(F.col("status") == "approved")
    rows = rows.filter(F.col("figure_id") == figure) if figure is not None else rows
    last = latest(sentiment, "event_id", "collected_at", "sentiment_id").select("event_id", "channel", "score", "label", "sample_size")
    return rows.join(summaries, "event_id").join(last, "event_id", "left").orderBy(F.col("event_date").desc_nulls_last(), "event_id")


def related(events: DataFrame, summaries: DataFrame, figure: str, name: str, n: int = 5) -> DataFrame:
    """[P4, P9, O3] The last events of other figures whose summary mentions the name, whatever its case."""
    rows = events.filter((F.col("figure_id") != figure) & (F.col("status") == "approved")).join(summaries, "event_id")
    hit = F.lower("summary_text").contains(name.lower())
    return rows.filter(hit).orderBy(F.col("event_date").desc_nulls_last(), "event_id").limit(n)


def named(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """[J17] The figure's name, or its id if it has none."""
    return rows.join(figures.select("figure_id", "name"), "figure_id", "left").withColumn("name", F.coalesce("name", "figure_id"))


def _alike(least: float, group: str):
    """Pairs of a tile (vectors x, vectors y, same) with a product of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, a, b, found = [], [], [], []
            sides = [(batch.column(group)[i], batch.column("same")[i].as_py(), batch.column("x")[i].values, batch.column("y")[i].values) for i in range(batch.num_rows)]
            for key, same, x, y in sides:
                products = np.array(x.field("v").to_pylist(), float) @ np.array(y.field("v").to_pylist(), float).T
                ids = x.field("id").to_pylist(), y.field("id").to_pylist()
                for i, j in zip(*np.nonzero(products >= least), strict=True):
                    first, second = ids[0][i], ids[1][j]
                    if first < second or not same and first > second:
                        keys.append(key.as_py())
                        a.append(min(first, second))
                        b.append(max(first, second))
                        found.append(float(products[i, j]))
            kind = batch.schema.field("x").type.value_type.field("id").type
            arrays = [pa.array(keys, batch.schema.field(group).type), pa.array(a, kind), pa.array(b, kind), pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[group, "a", "b", "similarity"])

    return run


def similar_pairs(rows: DataFrame, least: float, group: str = "group_id", block: int = 512) -> DataFrame:
    """[J15] Pairs of one group with cosine ``least`` or more: a, b (a before b) and similarity.

    A group's vectors are dealt into blocks of about ``block``, and every two blocks are a tile, so a group with most rows is many
    tasks, and only pairs that are alike leave them.
    """
    some = rows.select(group, "id", F.col("vector").alias("v")).filter("id is not null and v is not null")
    blocks = some.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).alias("n"))
    dealt = some.join(blocks, group).withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")))
    dealt = dealt.groupBy(group, "k").agg(F.collect_list(F.struct("id", "v")).alias("side"))
    x, y = dealt.select(group, "k", F.col("side").alias("x")), dealt.select(group, F.col("k").alias("l"), F.col("side").alias("y"))
    tiles = x.join(y, group).filter("k <= l").select(group, (F.col("k") == F.col("l")).alias("same"), "x", "y")
    kinds = {f.name: f.dataType.simpleString() for f in some.schema}
    return tiles.mapInArrow(_alike(least, group), f"`{group}` {kinds[group]}, a {kinds['id']}, b {kinds['id']}, similarity double")


def follow_links(rows: DataFrame, least: float = 0.45) -> DataFrame:
    """[J15, W3] For each event its most similar earlier and later event of the figure.

    ``rows``: group_id, id, place (the list order, which settles equal dates), at, vector.
    """
    pairs = similar_pairs(rows, least)
    when = rows.select("id", "at", "place")
    ends = pairs.join(when.toDF("a", "at_a", "place_a"), "a").join(when.toDF("b", "at_b", "place_b"), "b")
    a_first = (F.col("at_a") < F.col("at_b")) | ((F.col("at_a") == F.col("at_b")) & (F.col("place_a") < F.col("place_b")))
    first, second = F.when(a_first, F.col("a")).otherwise(F.col("b")), F.when(a_first, F.col("b")).otherwise(F.col("a"))
    forth = ends.select(first.alias("id"), F.lit("next").alias("direction"), second.alias("other"), "similarity")
    back = ends.select(second.alias("id"), F.lit("previous").alias("direction"), first.alias("other"), "similarity")
    best = F.row_number().over(Window.partitionBy("id", "direction").orderBy(F.col("similarity").desc(), "other"))
    return forth.unionByName(back).withColumn("rank", best).filter("rank = 1").drop("rank").withColumn("similarity", F.bround("similarity", 2))


def by_month(rows: DataFrame, at: str | Column) -> DataFrame:
    """[A22] Rows counted by month, with the months' first and last times."""
    at = F.col(at) if isinstance(at, str) else at
    return rows.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
