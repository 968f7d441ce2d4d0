import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lantern.operators import clustering
from lantern.streaming import streams

BASE = datetime(2024, 1, 1)


def drained(frame, name, mode="append", path=None):
    stream = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(path)).start()
    stream.awaitTermination()
    return frame.sparkSession.table(name).collect()


def landed(spark, tmp_path, rows, schema):
    place = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(place)
    return spark.readStream.schema(spark.read.parquet(place).schema).parquet(place)


def test_articles_once(spark, tmp_path):
    rows = [("a", BASE), ("a", BASE + timedelta(hours=1)), ("b", BASE)]
    stream = landed(spark, tmp_path, rows, "article_id string, fetched_at timestamp")
    assert sorted(r.article_id for r in drained(streams.distinct_articles(stream), "once", path=tmp_path / "c")) == ["a", "b"]


def test_volume_equals_the_batch(spark, tmp_path):
    rows = [(BASE + timedelta(minutes=7 * i), "view" if i % 2 else "click", float(i)) for i in range(60)]
    schema = "ts timestamp, event_type string, value double"
    stream = landed(spark, tmp_path, rows, schema)
    got = drained(streams.volume(stream), "volume", "complete", tmp_path / "c")
    batch = streams.volume(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))


def test_stream_clusterer_equals_the_batch(spark, tmp_path):
    rows = [("f", f"a{i}", float(i * 3600), [1.0, 0.0] if i % 3 else [0.0, 1.0], ["x", "y", "z"]) for i in range(20)]
    schema = "figure_id string, article_id string, seconds double, embedding array<double>, tokens array<string>"
    got = drained(streams.clustered(landed(spark, tmp_path, rows, schema)), "clustered", path=tmp_path / "c")
    batch = spark.createDataFrame(rows, schema).withColumn("published_at", F.timestamp_micros((F.col("seconds") * 1e6).cast("long")))
    assert sorted(map(tuple, got)) == sorted(map(tuple, clustering.cluster(batch).collect()))


def test_stream_clusterer_forgets_after_the_window(spark, tmp_path):
    """Three files are three batches; idle figure g and the old events of f go by timer once the watermark has passed their windows."""
    day, schema = 86400.0, "figure_id string, article_id string, seconds double, embedding array<double>, tokens array<string>"
    vector = lambda i: [1.0, 0.0] if i % 2 else [0.0, 1.0]
    rows = [("f", f"a{i:02}", day * i / 2, vector(i), ["x", "y", "z"]) for i in range(20)] + [("g", "g1", day, vector(1), ["x", "y", "z"])]
    later = [("f", f"b{i}", day * (40 + i), vector(i), ["x", "y", "z"]) for i in range(2)]
    last = [("h", "h1", day * 80, vector(1), ["x", "y", "z"])]
    place = str(tmp_path / "in")
    for i, part in enumerate((rows, later, last, [("h", "h2", day * 81, vector(1), ["x", "y", "z"])])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(place)
        for f in (tmp_path / "in").glob("part-*.parquet"):
            if not f.name.startswith("part-kept"):
                f.rename(f.with_name(f"part-kept{i}.parquet"))
                os.utime(f.with_name(f"part-kept{i}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place)
    query = streams.clustered(stream).writeStream.outputMode("append").format("memory").queryName("forgets").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    held = [p.stateOperators[0].customMetrics.get("numMapStateVars", 0) and p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    batch = spark.createDataFrame([*rows, *later, *last, ("h", "h2", day * 81, vector(1), ["x", "y", "z"])], schema).withColumn("published_at", F.timestamp_micros((F.col("seconds") * 1e6).cast("long")))
    assert sorted(map(tuple, spark.table("forgets").collect())) == sorted(map(tuple, clustering.cluster(batch).collect()))
    assert held[-1] < max(held)


def test_replayed_batches_replace_themselves(spark, tmp_path):
    place, schema = str(tmp_path / "out"), "key int, at int, v string"
    one, two = (spark.createDataFrame(r, schema) for r in ([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], [(1, 3, "d")]))
    for batch, n in ((one, 0), (two, 1), (two, 1), (one, 0)):
        streams.keep_latest(batch, n, place, "key", "at")
    assert spark.read.parquet(place).count() == 3
    assert sorted(map(tuple, streams.current(spark, place, "key", "at").collect())) == [(1, 3, "d"), (2, 1, "c")]


def test_compaction_keeps_reads_short(spark, tmp_path):
    rng, place, schema, held, files = random.Random(4), str(tmp_path / "out"), "key int, at int, v string", {}, []
    for n in range(25):
        rows = [(rng.randrange(12), n, f"{n}/{i}") for i in range(5)]
        rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
        batch = spark.createDataFrame(rows, schema).coalesce(1)
        streams.keep_latest(batch, n, place, "key", "at")
        held |= {r[0]: r for r in rows}
        if n == 13:  # a compaction that broke off
            (tmp_path / "out" / "_snapshots" / "upto=99").mkdir(parents=True)
            (tmp_path / "out" / "_snapshots" / "upto=99" / "part-0.parquet").write_bytes(b"junk")
        assert streams.compact(spark, place, "key", "at", least=4) == (n if n % 4 == 3 else None)
        if n in (8, 17):
            streams.keep_latest(spark.createDataFrame([(1, -1, "old")], schema), n - 8, place, "key", "at")  # long compacted
        now = streams.current(spark, place, "key", "at")
        files.append(len({f.rsplit("/", 2)[-2] for f in now.inputFiles()}))
        assert sorted(map(tuple, now.collect())) == sorted(held.values())
    assert max(files) <= 5
