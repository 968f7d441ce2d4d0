from datetime import datetime

from pyspark.sql import functions as F

from lantern import schemas
from lantern.operators import clustering
from lantern.plans import pipeline as p
from lantern.sources import landed

NOW = datetime(2024, 5, 10, 12)


def test_from_feeds_to_signals(spark):
    body = "<article>" + "".join(f"<p>Jane Doe berpidato tentang sekolah dan jalan raya di kota besar nomor {i}.</p>" for i in range(4)) + "</article>"
    entries = spark.createDataFrame(
        [("Kompas", 0, "Jane Doe bicara sekolah", "x", "http://a", datetime(2024, 5, 1), None), ("Tempo", 0, "Jane Doe bicara jalan", "x", "http://b", datetime(2024, 5, 2), None),
         ("Tempo", 1, "Jane Doe bicara jalan", "x", "http://b", datetime(2024, 5, 2), None), ("Tempo", 2, "Lain", "x", "http://c", None, None), ("Tempo", 3, "Jane", "x", "", None, None)], landed.ENTRY)
    pages = spark.createDataFrame([("http://a", body), ("http://b", body)], "url string, html string")
    inputs = p.Inputs(entries, pages, [("jane", ["Jane Doe"])], ("Kompas",))
    articles = p.with_translations(p.with_bodies(p.ingest(inputs, None, NOW), pages), inputs.domestic)
    assert sorted((r.url, r.fetch_status) for r in articles.collect()) == [("http://a", "ok"), ("http://b", "ok")]
    grouped = p.with_events(articles, ["jane", "doe"], NOW, clustering.Params()).cache()
    assert grouped.select("event_id").distinct().count() == 1
    event = p.events(grouped, NOW).collect()[0]
    assert (event.figure_id, event.event_type, event.status, event.event_date) == ("jane", "Pidato", "new", datetime(2024, 5, 1))
    summary = p.summaries(grouped, NOW).collect()[0]
    assert (summary.n_outlets, summary.single_source_flag, len(summary.citations)) == (2, False, 2)
    rows = [(i, event.event_id, f"u{i % 2}", "good and great and fine words here" if i else "bad lie from someone else entirely", datetime(2024, 5, 3)) for i in range(6)]
    comments = p.stances(spark.createDataFrame(rows, "comment_id long, event_id string, author_id string, text string, published_at timestamp"))
    mood = p.moods(comments, NOW, "video").collect()[0]
    assert (mood.label, mood.sample_size, mood.channel) == ("positive", 6, "video")
    found = p.coordination(comments, p.events(grouped, NOW), NOW).collect()[0]
    assert found.signals == "copypasta,extremity,volume" and found.suspicious_ids == [0, 1, 2, 3, 4, 5]
    assert p.ingest(inputs, grouped, NOW).count() == 0
    known = spark.createDataFrame([("jane", "Jane Doe", ["Jane"])], "figure_id string, name string, aliases array<string>")
    assert p.queries(p.events(grouped, NOW), known, []).collect()[0].query == "Jane Doe bicara sekolah"
    assert sorted(r.citation_no for r in p.numbered_sources(grouped).collect()) == [1, 2]


def test_status_log_and_schemas(spark):
    log = spark.createDataFrame([(1, NOW, "new"), (1, datetime(2024, 6, 1), "approved")], "event_id int, at timestamp, status string")
    assert [r.status for r in p.current_status(log).collect()] == ["approved"]
    for name in schemas.DDL:
        empty = schemas.conform(spark.range(0).select(F.lit(None).cast("string").alias("event_id")), name)
        assert [f.name for f in empty.schema] == [f.name for f in schemas.schema(name)]


def test_work_queues(spark):
    rows = spark.createDataFrame([("a", None, datetime(2024, 1, 2), "Kompas", "text", None), ("b", "error:empty", datetime(2024, 1, 1), "Tempo", "text", None), ("c", "ok", None, "YouTube/Kompas", None, None), ("d", "ok", None, "BBC", "text", "was"), ("e", "ok", None, "BBC", "text", None)], "article_id string, fetch_status string, fetched_at timestamp, source string, body string, body_original string")
    ids = lambda d: [r.article_id for r in d.collect()]
    assert ids(p.to_fetch(rows)) == ["a"] and ids(p.to_fetch(rows, retry_failed=True, limit=5)) == ["b", "a"] and ids(p.to_fetch(rows, True, 1)) == ["b"]
    assert ids(p.to_translate(rows, ("Kompas",), 5)) == ["b", "e"] and ids(p.to_translate(rows, ("Kompas",), 1)) == ["b"]
    events = spark.createDataFrame([(1, "new", datetime(2024, 1, 2)), (2, "new", datetime(2024, 1, 1)), (3, "approved", None)], "event_id int, status string, created_at timestamp")
    assert [r.event_id for r in p.to_summarise(events, 2).collect()] == [2, 1]
    assert p.to_cluster(rows.withColumn("event_id", F.when(F.col("article_id") > "c", "x"))).count() == 3


def test_a_later_run_adds_to_an_open_event(spark):
    kind = "article_id string, figure_id string, title string, summary string, body string, source string, published_at timestamp, event_id string"
    text = "Presiden berpidato tentang sekolah dan jalan raya besar"
    first = spark.createDataFrame([("a", "f", text, "", "", "x", datetime(2024, 5, 1), None)], kind)
    grouped = p.with_events(first, [], NOW)
    second = spark.createDataFrame([("b", "f", text, "", "", "y", datetime(2024, 5, 3), None)], kind)
    known = p.events(grouped, NOW)
    assert [r.event_id for r in p.with_events(second, [], NOW, stored=(known, grouped)).collect()] == ["a"]
    assert [r.event_id for r in p.with_events(second, [], NOW, stored=(known.withColumn("status", F.lit("approved")), grouped)).collect()] == ["b"]
