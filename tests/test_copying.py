"""Copies into a real database, and thread responses through SQL."""

import json
import sqlite3
import time

import pytest
from lantern.sources import landed, threads
from lantern.sources.copying import Target, _CopyWriter, copy_rows
from pyspark.sql import functions as F

COLUMNS = "id INTEGER{} NOT NULL, title TEXT NOT NULL, score REAL CHECK (score < 100)"


def target(tmp_path, columns=("id", "title", "score")):
    path = str(tmp_path / "copy.db")

    def connect():
        connection = sqlite3.connect(path, timeout=60, isolation_level=None)
        connection.execute("BEGIN IMMEDIATE")
        return connection

    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE IF NOT EXISTS events ({COLUMNS.format(' PRIMARY KEY')}) STRICT")
        db.execute(f"CREATE TABLE IF NOT EXISTS staging (run TEXT, attempt TEXT, {COLUMNS.format('')}) STRICT")
        db.execute("CREATE TABLE IF NOT EXISTS rejected (run TEXT, attempt TEXT, row_key TEXT, row_json TEXT, error TEXT)")
    return Target(connect, "events", "id", list(columns), "staging", "rejected"), lambda sql: sqlite3.connect(path).execute(sql).fetchall()


def test_rows_arrive_refused_ones_are_listed_and_known_ones_stay(spark, tmp_path):
    into, ask = target(tmp_path)
    with sqlite3.connect(tmp_path / "copy.db") as db:
        db.execute("INSERT INTO events VALUES (5, 'old', 1)")
    bad = F.col("id").isin(13, 500, 999)
    rows = spark.range(1000).select("id", F.when(~bad, F.concat(F.lit("o'"), "id")).alias("title"), F.when(F.col("id") == 77, 100.0).otherwise(F.col("id") % 50).alias("score"), F.lit("x").alias("other"))
    run = copy_rows(rows, into, batch=64)
    assert ask("SELECT count(*), min(title) FROM events") == [(996, "o'0")] and ask("SELECT title FROM events WHERE id = 5") == [("old",)]
    assert ask("SELECT count(*) FROM staging") == [(0,)]
    refused = ask(f"SELECT row_key, error, row_json FROM rejected WHERE run = '{run}' AND attempt <> 'ended' ORDER BY CAST(row_key AS INTEGER)")
    assert [r[0] for r in refused] == ["13", "77", "500", "999"] and all("IntegrityError" in r[1] for r in refused)
    assert json.loads(refused[0][2]) == {"id": 13, "title": None, "score": 13.0}
    copy_rows(rows, into)
    assert ask("SELECT count(*) FROM events") == [(996,)]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    into, ask = target(tmp_path)
    rows = spark.range(0, 400, 1, 4).select("id", F.concat(F.lit("t"), "id").alias("title"), F.expr("if(id = 399, raise_error('lost'), 1.0D)").alias("score"))
    with pytest.raises(Exception, match="lost"):
        copy_rows(rows, into, batch=10)
    left = "SELECT (SELECT count(*) FROM events), (SELECT count(*) FROM staging), (SELECT count(*) FROM rejected WHERE attempt <> 'ended')"
    for _ in range(100):  # other tasks may be on their way still, and clear up behind them
        if ask(left) == [(0, 0, 0)]:
            break
        time.sleep(0.2)
    time.sleep(1)
    assert ask(left) == [(0, 0, 0)]


def test_a_task_that_comes_late_clears_up_behind_itself(tmp_path):
    into, ask = target(tmp_path)
    writer = _CopyWriter(into, "r", 10)
    first = writer.write(iter([(1, "a", 1.0), (2, None, 1.0)]))
    writer.write(iter([(1, "a", 1.0), (2, None, 1.0)]))  # an attempt that does not count
    writer.commit([first])
    with pytest.raises(RuntimeError, match="ended"):
        writer.write(iter([(3, "late", 1.0), (4, None, 1.0)]))
    assert ask("SELECT id FROM events") == [(1,)] and ask("SELECT count(*) FROM staging") == [(0,)]
    assert ask("SELECT row_key FROM rejected WHERE attempt <> 'ended'") == [("2",)]


def test_missing_columns_are_null_and_empty_tables_copy(spark, tmp_path):
    into, ask = target(tmp_path)
    copy_rows(spark.range(3).withColumn("title", F.lit("t")), into)
    copy_rows(spark.range(0).withColumn("title", F.lit("t")), into)
    assert ask("SELECT id, title, score FROM events ORDER BY id") == [(0, "t", None), (1, "t", None), (2, "t", None)]
    with pytest.raises(ValueError, match="no plain name"):
        Target(into.connect, "events; DROP", "id", ["id"], "staging", "rejected")


def test_the_table_function_equals_the_frame(spark):
    comment = lambda **s: {"snippet": {"topLevelComment": {"snippet": s}}}
    items = [
        comment(textDisplay="<b>a</b>", likeCount=3, authorDisplayName="n", authorChannelId={"value": "u"}, publishedAt="2024-01-02T03:04:05Z"),
        comment(textDisplay="", textOriginal="plain", publishedAt="soon"), comment(textDisplay=""), {"snippet": None}, {}, comment(textOriginal="ü", publishedAt=""),
    ]
    bodies = [json.dumps({"items": items}), "no json", None, "", "[]", "{}", json.dumps({"items": items[:1] * 150})]
    responses = spark.createDataFrame([(f"v{i % 3}", b) for i, b in enumerate(bodies)], "video_id string, value string")
    threads.register(spark)
    got = spark.sql("SELECT * EXCEPT (published), try_to_timestamp(published) AS published_at FROM thread_comments(TABLE(SELECT * FROM {r}) PARTITION BY (video_id))", r=responses)
    want = landed.video_comments(responses)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 103
    two = spark.sql("SELECT * FROM thread_comments(TABLE(SELECT * FROM {r}) PARTITION BY (video_id), 2)", r=responses)
    assert two.count() == landed.video_comments(responses, cap=2).count() == 4
