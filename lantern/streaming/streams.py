"""Streaming forms: ingest without repetition, windowed signals, sessions and online clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lantern.operators.clustering import Params, Walk
from lantern.operators.tables import latest


def distinct_articles(articles: DataFrame, key: str = "article_id", at: str = "fetched_at", late: str = "7 days") -> DataFrame:
    """[T5] Each key once, with state that goes with the watermark."""
    return articles.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def volume(comments: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Comments by window and kind; works on batches too."""
    rows = comments.withWatermark(at, late) if comments.isStreaming else comments
    return rows.groupBy(F.window(at, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start_at"), "event_type", "n", "total")


def sessions(comments: DataFrame, at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: comments at most ``gap`` apart."""
    rows = comments.withWatermark(at, late) if comments.isStreaming else comments
    return rows.groupBy("user_id", F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "n")


class _Clusterer(StatefulProcessor):
    """Open events of a figure, an entry each, and a timer for the end of each event's window."""

    def __init__(self, params: Params):
        self.params = params

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "event string", "anchor double, centre array<double>, words array<string>, size int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        walk = Walk(self.params)
        for (name,), (anchor, centre, words, size) in sorted(self.open.iterator(), key=lambda e: (e[1][0], e[0])):
            walk.open(name, anchor, np.array(centre, float), set(words), size)
        before = {name: size for name, *_, size in walk.events}
        found = pd.concat(rows).sort_values(["seconds", "article_id"])
        events = [walk.add(a, s, np.asarray(v, float), set(t)) for a, s, v, t in zip(found["article_id"], found["seconds"], found["embedding"], found["tokens"], strict=True)]
        for name, anchor, centre, words, size in walk.events:
            if before.get(name) != size:  # only events that got an article are written
                self.open.updateValue((name,), (float(anchor), list(map(float, centre)), sorted(words), int(size)))
            if name not in before:
                self.handle.registerTimer(int((anchor + self.params.days * 86400) * 1000) + 1)
        yield pd.DataFrame({"article_id": found["article_id"], "event_id": events})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since = timerValues.getCurrentWatermarkInMs() / 1000 - self.params.days * 86400
        for name in [name for name, (anchor, *_) in self.open.iterator() if anchor < since]:
            self.open.removeKey(name)
        yield pd.DataFrame({"article_id": pd.Series([], dtype=object), "event_id": pd.Series([], dtype=object)})

    def close(self) -> None:
        pass


def clustered(articles: DataFrame, params: Params = Params(), late: str = "1 day") -> DataFrame:  # noqa: B008
    """[T1, T2] The greedy clusterer over a stream: figures with their open events as state, which goes once the watermark has passed an event's window.

    ``articles``: figure_id, article_id, seconds, embedding, tokens; those without seconds are left out, as are those more than ``late`` behind or before 1970. Articles that
    arrive together are taken in the order of their times. A figure without new articles loses its events, too, by their timers.
    Keyed state of several columns needs the RocksDB store, which is set for the session.
    """
    articles.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = F.timestamp_micros((F.col("seconds") * 1_000_000).cast("long") + 1000)  # a first watermark is at 0, and what is not after it is late
    timed = articles.filter("seconds is not null").withColumn("at", at).withWatermark("at", late)
    return timed.groupBy("figure_id").transformWithStateInPandas(_Clusterer(params), "article_id string, event_id string", "append", "eventTime")


def keep_latest(batch: DataFrame, batch_id: int, path: str, key: str, *order: str) -> None:
    """[K1, K12] A foreachBatch sink: each batch's latest rows under its own number, so a batch that is run again replaces itself."""
    latest(batch, key, *order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _numbered(spark: SparkSession, path: str, prefix: str, whole: bool) -> dict[int, str]:
    """Folders prefix=number below a path, in any store that Spark reads; only those whose writer has committed, if ``whole``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(place)]
    found = {int(n.removeprefix(prefix)): f"{path}/{n}" for n in names if n.startswith(prefix)}
    return {n: p for n, p in found.items() if not whole or files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS"))}


def _parts(spark: SparkSession, path: str) -> tuple[int, str | None, dict[int, str]]:
    """The newest whole snapshot (its last batch and folder; -1 and none without one) and the batches after it."""
    snapshots = _numbered(spark, f"{path}/_snapshots", "upto=", True)
    upto = max(snapshots, default=-1)
    return upto, snapshots.get(upto), {n: p for n, p in _numbered(spark, path, "batch=", True).items() if n > upto}


def current(spark: SparkSession, path: str, key: str, *order: str) -> DataFrame:
    """[K3] The latest row of each key over all batches that ``keep_latest`` wrote: the upserted table, from the newest snapshot and the batches after it."""
    _, snapshot, tail = _parts(spark, path)
    return latest(spark.read.parquet(*([snapshot] if snapshot else []), *tail.values()), key, *order)


def compact(spark: SparkSession, path: str, key: str, *order: str, least: int = 10, drop: bool = True) -> int | None:
    """[K3, K12] Folds the batches since the last snapshot into a new one, if they are ``least`` or more; gives its last batch, or none.

    A snapshot counts once its writer has committed, so a run that breaks off leaves the old one in force, and readers see one or the other. What the
    snapshot before the last held is then deleted, as are the batches in it; a reader that began before the last compaction still finds its own.
    A batch that is run again after it is in a snapshot changes nothing.
    """
    upto, snapshot, tail = _parts(spark, path)
    if len(tail) < least:
        return None
    last = max(tail)
    latest(spark.read.parquet(*([snapshot] if snapshot else []), *tail.values()), key, *order).write.mode("overwrite").parquet(f"{path}/_snapshots/upto={last}")
    if drop:
        old = [p for n, p in _numbered(spark, f"{path}/_snapshots", "upto=", False).items() if n < upto] + [p for n, p in _numbered(spark, path, "batch=", False).items() if n <= upto]
        for p in old:
            place = spark._jvm.org.apache.hadoop.fs.Path(p)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return last
