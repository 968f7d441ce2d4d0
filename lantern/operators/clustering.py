"""[T1, J13, U10] Grouping articles to events: greedy, in time order, within a figure.

An article joins the most similar open event of its figure whose anchor is at most ``days`` away, that
shares at least ``least_shared`` tokens and reaches ``least_similarity``; of equal ones the latest. Else it
opens an event, anchored at its own time. An event's centre moves with each article. Events that were open before
take part with the centre and the tokens of their articles.

The order matters, so a figure's timeline is walked in one place, but it may be cut wherever two
consecutive times, of articles or of anchors, are more than ``days`` apart: no event reaches over such a gap. Each piece is
then walked by itself. Cuts are found on narrow rows; vectors and tokens are only dealt out by piece. A piece is read as a stream in time order, which Spark
sorts and spills; a task holds a batch of articles and the events that are open, however long the piece is. An event is forgotten once its anchor is further
back than ``days``, and a stored one is opened so long before its anchor. Events that share too few words are not looked at: the words of open events are an index.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.vectors import mean_vector


@dataclass(frozen=True)
class Params:
    days: float = 7.0
    least_similarity: float = 0.58
    least_shared: int = 3


def _unit(v: np.ndarray) -> np.ndarray:
    norm = float(np.sqrt(v @ v))
    return v / norm if norm > 0 else v


class Walk:
    """Open events of one figure; articles come in time order. Events are kept in the order in which ties look at them: stored ones, then opened ones."""

    def __init__(self, params: Params):
        self.params = params
        self.slots: dict[int, list] = {}  # place: key, anchor, centre, words, size
        self.having: dict[str, set[int]] = {}
        self.stored, self.opened = -(1 << 62), 0

    @property
    def events(self) -> list[list]:
        return [self.slots[place] for place in sorted(self.slots)]

    def open(self, key, when: float, centre: np.ndarray, words: set[str], size: int) -> None:
        """A stored event, in the order of dates."""
        self.stored += 1
        self._put(self.stored, [key, when, centre, words, size])

    def _put(self, place: int, event: list) -> None:
        self.slots[place] = event
        for word in event[3]:
            self.having.setdefault(word, set()).add(place)

    def _sharing(self, words: set[str]) -> list[int]:
        """Places of the events that share enough words, in order."""
        if self.params.least_shared <= 0:
            return sorted(self.slots)
        shared = Counter(place for word in words for place in self.having.get(word, ()))
        return sorted(place for place, n in shared.items() if n >= self.params.least_shared)

    def add(self, key, when: float, vector: np.ndarray, words: set[str]):
        p, found, best = self.params, None, self.params.least_similarity
        for place in self._sharing(words):
            if abs(when - self.slots[place][1]) <= p.days * 86400:
                similarity = float(vector @ self.slots[place][2])
                if similarity >= best:
                    found, best = place, similarity
        if found is None:
            self.opened += 1
            self._put(self.opened, [key, when, vector, words, 1])
            return key
        event = self.slots[found]
        event[2] = _unit((event[2] * event[4] + vector) / (event[4] + 1))
        for word in words - event[3]:
            self.having.setdefault(word, set()).add(found)
        event[3] = event[3] | words
        event[4] += 1
        return event[0]

    def forget(self, when: float) -> None:
        """Lets go of events that no article from ``when`` on can join."""
        since = when - self.params.days * 86400
        for place in [place for place, event in self.slots.items() if event[1] < since]:
            for word in self.slots.pop(place)[3]:
                self.having[word].discard(place)
                if not self.having[word]:
                    del self.having[word]


def _walk(params: Params):
    """Walks through rows in the order of figure, piece and time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, swept = Walk(params), None, 0.0
        for batch in batches:
            ids, events = [], []
            for figure, piece, key, when, size, vector, words in zip(*(batch.column(c).to_pylist() for c in ("figure_id", "piece", "id", "seconds", "size", "vector", "words")), strict=True):
                if (figure, piece) != current:
                    state, current, swept = Walk(params), (figure, piece), when
                if size:
                    state.open(key, when, np.asarray(vector, float), set(words), size)
                    continue
                if when - swept > params.days * 86400 / 64:  # those further back are told by their anchors in between
                    state.forget(when)
                    swept = when
                ids.append(key)
                events.append(state.add(key, when, np.asarray(vector, float), set(words)))
            kind = batch.schema.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(events, kind)], names=["article_id", "event_id"])

    return run


def open_events(events: DataFrame, articles: DataFrame, dimension: int, statuses: tuple[str, ...] = ("new", "summarized")) -> DataFrame:
    """[J12, T2, A12, A13] Events that still take articles (figure_id, event_id, event_date, centre, words, size), from those they have.

    ``articles``: event_id, embedding, tokens. Events without an article are left out.
    """
    some = articles.join(events.filter(F.col("status").isin(*statuses)).select("event_id"), "event_id", "left_semi")
    centres = mean_vector(some, "event_id", "embedding", dimension)
    words = some.select("event_id", F.explode("tokens").alias("word")).distinct().groupBy("event_id").agg(F.collect_list("word").alias("words"))
    sizes = some.groupBy("event_id").agg(F.count(F.lit(1)).alias("size"))
    rows = events.select("event_id", "figure_id", "event_date").join(centres, "event_id").join(sizes, "event_id").join(words, "event_id", "left")
    return rows.select("figure_id", "event_id", "event_date", F.col("centroid").alias("centre"), F.coalesce("words", F.array().cast("array<string>")).alias("words"), "size")


def cluster(articles: DataFrame, params: Params = Params(), as_of: float = 0.0, stored: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """article_id, event_id (that of the stored event joined, or the id of the article that opened it).

    ``articles``: figure_id, article_id, published_at (null counts as ``as_of``, epoch seconds), embedding, tokens.
    ``stored``: what ``open_events`` gives; event and article ids are of one kind. Of equally similar events the later one in the order of
    stored dates, then of opening, is joined.
    """
    kind = articles.schema["article_id"].dataType.simpleString()

    def seconds(at: str) -> Column:
        return F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1e6), F.lit(as_of))

    rows = articles.select(F.col("article_id").alias("id"), F.col("figure_id"), seconds("published_at").alias("seconds"), F.col("published_at").isNull().cast("int").alias("late"), F.lit(0).alias("size"), F.col("embedding").cast("array<double>").alias("vector"), F.col("tokens").alias("words"))
    if stored is not None:
        known = stored.select(F.col("event_id").cast(kind).alias("id"), "figure_id", seconds("event_date").alias("seconds"), F.lit(0).alias("late"), F.col("size").cast("int").alias("size"), F.col("centre").cast("array<double>").alias("vector"), "words")
        rows = rows.unionByName(known)
    order = Window.partitionBy("figure_id").orderBy("seconds", "late", "id", "size")
    gap = F.col("seconds") - F.lag("seconds").over(order)
    cut = F.when(gap.isNull() | (gap > params.days * 86400), 1).otherwise(0)
    narrow = rows.select("figure_id", "id", "seconds", "late", "size").withColumn("_cut", cut)
    narrow = narrow.withColumn("piece", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = narrow.select(F.col("figure_id").alias("_figure"), F.col("id").alias("_id"), (F.col("size") > 0).alias("_known"), "piece")
    same = F.col("figure_id").eqNullSafe(F.col("_figure")) & F.col("id").eqNullSafe(F.col("_id")) & ((F.col("size") > 0) == F.col("_known"))
    pieces = rows.join(pieces, same).drop("_figure", "_id", "_known")

    turn = F.when(F.col("size") > 0, F.col("seconds") - params.days * 86400 - 1).otherwise(F.col("seconds"))
    dealt = pieces.withColumn("turn", turn).repartition("figure_id", "piece").sortWithinPartitions("figure_id", "piece", "turn", F.col("size") == 0, "late", "id")
    return dealt.select("figure_id", "piece", "id", "seconds", "size", "vector", "words").mapInArrow(_walk(params), f"article_id {kind}, event_id {kind}")


def event_types(members: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """event_id, event_type: of the first rule that some text of the event meets, else ``other``.

    The rule is looked up in each text and the first is kept, so an event's texts are never put together.
    """
    low = F.lower("text")
    first = F.lit(len(rules))
    for i in range(len(rules) - 1, -1, -1):
        first = F.when(low.rlike(rules[i][0]), F.lit(i)).otherwise(first)
    names = F.array(*(F.lit(name) for _, name in rules), F.lit("other"))
    return members.groupBy("event_id").agg(F.min(first).alias("rule")).select("event_id", F.element_at(names, F.col("rule") + 1).alias("event_type"))


# The rules of event types, in their order of precedence.
EVENT_TYPES = [
    (r"\b(pidato|berpidato|orasi|pida(to|h))\b", "Pidato"),
    (r"\b(debat|berdebat|debat(us|er)?)\b", "Debat"),
    (r"\b(demonstrasi|demo|unjuk rasa|protes|demo(besaran)?)\b", "Demonstrasi"),
    (r"\b(kebijakan|kebijakan baru|peraturan|regulasi|beleid)\b", "Kebijakan"),
    (r"\b(kunjungan|berkunjung|melawat|lawatan)\b", "Kunjungan"),
    (r"\b(pertemuan|bertemu|rapat|sidang|audiensi)\b", "Pertemuan"),
    (r"\b(wawancara|interviu|interview)\b", "Wawancara"),
    (r"\b(konferensi pers|jumpa pers|press conference)\b", "Konferensi Pers"),
    (r"\b(pernyataan|pernyataan resmi|siaran pers)\b", "Pernyataan"),
    (r"\b(pelantikan|dilantik|pengukuhan|inaugurasi)\b", "Pelantikan"),
    (r"\b(keputusan|putusan|vonis|dakwa|tuntutan)\b", "Keputusan"),
    (r"\b(pemilu|pemilihan|pilkada|pileg|pilpres)\b", "Pemilu"),
    (r"\b(pencalonan|calon|mencalonkan|kandidat)\b", "Pencalonan"),
    (r"\b(pengunduran|mundur|resign|mengundurkan diri)\b", "Pengunduran Diri"),
]
