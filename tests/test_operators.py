import itertools
import json
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.functions.subsequence import alike
from lantern.functions.udfs import indel_ratio
from lantern.operators import clustering, incremental, sentiment, signals, tables, timeline
from lantern.plans import catalogue
from lantern.sources import landed

BASE = datetime(2024, 1, 1)
COMMENTS = "event_id int, comment_id int, author_id string, text string, stance string, published_at timestamp"


def comments(spark, rows):
    """(event, author, minute, stance, text)"""
    return spark.createDataFrame([(e, i, a, x, s, BASE + timedelta(minutes=m) if m is not None else None) for i, (e, a, m, s, x) in enumerate(rows)], COMMENTS)


def test_cross_event_needs_three_events_and_an_author(spark):
    rows = [(e, a, 0, "neutral", "") for a, n in (("two", 2), ("three", 3), ("", 5)) for e in range(n)]
    assert [r.author_id for r in signals.cross_event_authors(comments(spark, rows)).collect()] == ["three"]


def test_velocity_compares_first_comments_only(spark):
    rows = [(1, "edge", 0, "", ""), (2, "edge", 60, "", ""), (1, "late", 0, "", ""), (2, "late", 61, "", ""), (1, "late", 62, "", ""), (1, None, 0, "", ""), (2, None, 1, "", ""), (1, "unknown", None, "", "")]
    assert [r.author_id for r in signals.velocity_authors(comments(spark, rows)).collect()] == ["edge"]


def test_velocity_by_neighbours_equals_all_pairs(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(6), f"a{rng.randrange(40)}", rng.randrange(3000), "", "") for _ in range(400)]
    got = {r.author_id for r in signals.velocity_authors(comments(spark, rows)).collect()}
    first = {}
    for e, a, m, *_ in rows:
        first[a, e] = min(m, first.get((a, e), m))
    assert got == {a for (a, e), (b, f) in itertools.combinations(first, 2) if a == b and abs(first[a, e] - first[b, f]) <= 60}


def test_volume_is_over_a_fifth(spark):
    rows = [(1, f"a{i}", 0, "", "") for i in range(5)] + [(2, f"a{i}", 0, "", "") for i in range(4)]
    assert {r.event_id for r in signals.dominant_authors(comments(spark, rows)).collect()} == {2}


def test_majority_ties_and_null_stance(spark):
    rows = [(1, "a", 0, "positive", ""), (1, "a", 0, "negative", ""), (2, "a", 0, None, ""), (2, "a", 0, None, ""), (2, "a", 0, "neutral", ""), (2, "a", 0, "negative", "")]
    table = comments(spark, rows)
    assert {r.event_id: r.majority for r in signals.majority_stance(table).collect()} == {1: "positive", 2: None}
    assert {r.comment_id for r in signals.extreme_comments(table).collect()} == {1, 5}


def test_copypasta_equals_all_pairs(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(120):
        text = rng.choices(words, k=rng.randrange(2, 9)) if i % 3 else rows[rng.randrange(len(rows))][4].split() if rows else ["word1"]
        text = " ".join(w if rng.random() > 0.1 else w + "x" for w in text)
        rows.append((i % 4, rng.choice(["", "p", "q", "r", "s"]), 0, "", text))
    got = {r.comment_id for r in signals.copypasta(comments(spark, rows)).collect()}
    expected = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        x, y = (" ".join(r[4].lower().split()) for r in (a, b))
        if min(len(x), len(y)) >= 15 and a[1] != b[1] and indel_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))) >= 85:
            expected |= {i, j}
    assert got == expected and expected


def test_pairs_that_change_nothing_are_not_compared(monkeypatch):
    """fuzzy_copypasta: texts of one author were compared with each other, and texts of several authors, too."""
    compared = []
    monkeypatch.setattr(signals, "alike", lambda texts, i, j, least: compared.append(len(i)) or alike(texts, i, j, least))
    owners = ["by a", "by a", "several", "several", "by b", None, None]
    side = [{"sorted": f"words in order {k}", "fresh": True, "of": of} for k, of in enumerate(owners)]
    tile = pa.RecordBatch.from_pydict({"same": [True], "x": [side], "y": [side]})
    (out,) = signals._close(85)(iter([tile]))
    assert compared == [21 - 2] and out.num_rows == 19


def test_copies_among_one_author_and_several(spark):
    """Texts of one author are no copies of each other, whatever texts of others are like them."""
    base = "alpha beta gamma delta epsilon"
    rows = [(0, "p", 0, "", base), (0, "p", 0, "", base + "s"), (0, "q", 0, "", "other words of one author only"), (0, "q", 0, "", "other words of one author onlys")]
    assert signals.copypasta(comments(spark, rows)).count() == 0
    rows += [(0, "r", 0, "", base + "s"), (0, "s", 0, "", base + "t"), (0, "t", 0, "", base + "t")]
    assert {r.comment_id for r in signals.copypasta(comments(spark, rows)).collect()} == {0, 1, 4, 5, 6}


def test_close_texts_in_many_tiles(spark, monkeypatch):
    rng = random.Random(21)
    base = [" ".join(sorted(rng.choices([f"w{i}" for i in range(60)], k=rng.randrange(6, 14)))) for _ in range(60)]
    texts = sorted({*base, *(b[:-1] + "z" for b in base), *(b + " qqq" for b in base[::3])})
    rows = spark.createDataFrame([(x,) for x in texts], "sorted string")
    expected = {(a, b) for a, b in itertools.combinations(texts, 2) if indel_ratio(a, b) >= 85}
    for tile in (128, 8):
        monkeypatch.setattr(signals, "TILE", tile)
        got = [tuple(sorted(r)) for r in signals.close_texts(rows).collect()]
        assert len(got) == len(set(got)) and set(got) == expected and expected


def test_attribution_by_table_equals_the_literal_form(spark):
    rng = random.Random(22)
    docs = [(i, rng.choice(["", "Jane", "x"]), " ".join(rng.choices(["Doe", "john", "JOHNSON", "a", "lorem", "Ann"], k=6)) if i % 5 else None) for i in range(60)]
    figures = [("j", ["john", "Jo"]), ("d", ["jane", "doe john"]), ("n", ["ann a"])]
    rows = spark.createDataFrame(docs, "article_id int, title string, summary string")
    terms = spark.createDataFrame([(i, f, x) for i, (f, names) in enumerate(figures) for x in names], "figure_ord int, figure_id string, term string")
    expected = {(r.article_id, r.figure_id) for r in timeline.attributed(rows, figures).collect()}
    for block in (10_000, 2):
        assert {(r.article_id, r.figure_id) for r in timeline.attributed_by_table(rows, terms, block).collect()} == expected


def test_composite_weights_and_order(spark):
    rows = [(1, "a", 0, "", ""), (1, "b", 0, "", ""), (2, "c", 0, "", "")]
    kinds = [(1, 0, s) for s in ("volume", "velocity", "extremity", "copypasta", "cross_event")]
    found = spark.createDataFrame(kinds, "event_id int, comment_id int, signal string")
    got = {r.event_id: r for r in signals.composite(comments(spark, rows), found).collect()}
    assert (got[1].anomaly_score, got[1].anomaly_pct, got[1].signals) == (1.0, 50.0, "cross_event,copypasta,extremity,velocity,volume")
    assert (got[2].anomaly_score, got[2].n_suspicious, got[2].signals) == (0.0, 0, "")


def test_table_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(tables.upsert(base, new, "k")) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(tables.upsert(tables.upsert(base, new, "k"), new, "k")) == [(1, "a"), (2, "B"), (3, "C")]
    twice = new.unionByName(spark.createDataFrame([(3, "Z")], "k int, v string"))
    assert rows(tables.insert_if_absent(base, twice, "k", "v")) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(tables.update(base, spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), "k")) == [(1, "a"), (2, "x")]
    assert rows(tables.delete(base, new, "k")) == [(1, "a")]
    assert rows(tables.orphans(new, base, "k", "k")) == [(3, "C")]
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("n", T.IntegerType())])
    assert rows(tables.migrate(tables.migrate(base, schema, {"n": 7}), schema, {"n": 8})) == [(1, "a", 7), (2, "b", 7)]
    with pytest.raises(Exception, match="not allowed"):
        base.select(tables.checked(F.col("v"), ["a"], "status")).collect()


def test_gathering_caps_items_and_groups(spark):
    rows = spark.createDataFrame([(1, v, v, c) for v in range(3) for c in range(4)], "g int, item int, item_rank int, row_rank int")
    got = [(r.item, r.row_rank) for r in tables.capped_gather(rows, "g", "item", "item_rank", "row_rank", 3, 7).orderBy("item", "row_rank").collect()]
    assert got == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]


def plain_loop(rows, p):
    events, out = [], {}
    for key, when, vector, words in rows:
        best, found = p.least_similarity, None
        for event in events:
            if abs(when - event["t"]) <= p.days * 86400 and len(words & event["w"]) >= p.least_shared and vector @ event["c"] >= best:
                best, found = vector @ event["c"], event
        if found is None:
            events.append({"k": key, "t": when, "c": vector, "w": words, "n": 1})
            out[key] = key
        else:
            c = found["c"] * found["n"] + vector
            found["c"] = c / np.sqrt(c @ c)
            found["w"], found["n"] = found["w"] | words, found["n"] + 1
            out[key] = found["k"]
    return out


def test_clusterer_equals_a_plain_loop_whatever_the_partitions(spark):
    rng, p = np.random.default_rng(4), clustering.Params(least_similarity=0.5, least_shared=2)
    rows, expected = [], {}
    for figure in "ab":
        mine, now = [], 0.0
        for i in range(80):
            now += float(rng.choice([3600, 86400, 9 * 86400], p=[0.6, 0.35, 0.05]))
            v = rng.normal(size=4).astype(np.float32)
            v /= np.sqrt(v @ v)
            mine.append((f"{figure}{i:03}", now, v.astype(float), {f"w{x}" for x in rng.integers(0, 6, 4)}))
        expected |= plain_loop(mine, p)
        rows += [(figure, k, BASE + timedelta(seconds=t - 0), [float(x) for x in v], sorted(w)) for k, t, v, w in mine]
    frame = spark.createDataFrame(rows, "figure_id string, article_id string, published_at timestamp, embedding array<float>, tokens array<string>")
    for parts in (1, 5):
        assert {r.article_id: r.event_id for r in clustering.cluster(frame.repartition(parts), p).collect()} == expected


def test_a_second_batch_joins_the_stored_open_events(spark):
    rng, p = np.random.default_rng(9), clustering.Params(least_similarity=0.6, least_shared=2)
    unit = lambda v: v / np.sqrt(v @ v)
    rows, now = [], 0.0
    for i in range(60):
        now += float(rng.choice([7200, 2 * 86400, 9 * 86400], p=[0.7, 0.25, 0.05]))
        rows.append((f"a{i:03}", now, unit(rng.normal(size=3)), {f"w{x}" for x in rng.integers(0, 5, 4)}))
    late = [(f"b{i:03}", t - 3600.0 * 30, v, w) for i, (_, t, v, w) in enumerate(rows[30:50])]
    frame = lambda r: spark.createDataFrame([("f", k, BASE + timedelta(seconds=t), [float(x) for x in v], sorted(w)) for k, t, v, w in r], "figure_id string, article_id string, published_at timestamp, embedding array<double>, tokens array<string>")
    first = frame(rows)
    given = clustering.cluster(first, p)
    held = first.join(given, "article_id").cache()
    status = F.when(F.substring("event_id", 4, 1).isin("3", "7"), "approved").otherwise("new")
    events = held.filter("article_id = event_id").select("event_id", "figure_id", F.col("published_at").alias("event_date"), status.alias("status"))
    got = {r.article_id: r.event_id for r in clustering.cluster(frame(late), p, stored=clustering.open_events(events, held, 3)).collect()}

    # the same as one loop: events that are open start with the mean of their articles, then articles in time order
    member = {r.article_id: r.event_id for r in given.collect()}
    state = []
    for key, when, _, _ in rows:
        if member[key] == key and key[3] not in "37":
            mine = [(v, w) for k, _, v, w in rows if member[k] == key]
            mean = np.mean([v for v, _ in mine], axis=0)
            state.append({"k": key, "t": when, "c": unit(mean), "w": set().union(*(w for _, w in mine)), "n": len(mine)})
    expected = {}
    for key, when, v, w in sorted(late, key=lambda r: (r[1], r[0])):
        best, found = p.least_similarity, None
        for e in state:
            if abs(when - e["t"]) <= 7 * 86400 and len(w & e["w"]) >= 2 and v @ e["c"] >= best:
                best, found = v @ e["c"], e
        if found is None:
            state.append({"k": key, "t": when, "c": v, "w": w, "n": 1})
            expected[key] = key
        else:
            found["c"], found["w"], found["n"] = unit(found["c"] * found["n"] + v), found["w"] | w, found["n"] + 1
            expected[key] = found["k"]
    assert got == expected and any(e.startswith("a") for e in got.values())


def test_clusterer_guards(spark):
    walk = clustering.Walk(clustering.Params())
    v, near = np.array([1.0, 0.0]), np.array([0.58, np.sqrt(1 - 0.58**2)])
    words = {"aaa", "bbb", "ccc", "ddd"}
    walk.open("old", 0.0, v, words, 1)
    walk.open("tie", 0.0, v, words, 1)
    assert walk.add("x", 7 * 86400.0, near, {"aaa", "bbb", "ccc"}) == "tie"
    assert walk.add("y", 7 * 86400.0 + 1, v, words) == "y"
    assert walk.add("z", 0.0, v, {"aaa", "bbb"}) == "z"


def test_event_types(spark):
    rows = spark.createDataFrame([(1, "ada debat"), (1, "dan Pidato"), (2, "nihil")], "event_id int, text string")
    assert {r.event_id: r.event_type for r in clustering.event_types(rows, clustering.EVENT_TYPES).collect()} == {1: "Pidato", 2: "other"}


def test_timeline_takes_the_last_sentiment_or_none(spark):
    events = spark.createDataFrame([(1, "f", BASE, "approved"), (2, "f", None, "approved"), (3, "f", BASE, "new")], "event_id int, figure_id string, event_date timestamp, status string")
    summaries = spark.createDataFrame([(1, "text about Jane"), (2, "none"), (3, "x")], "event_id int, summary_text string")
    moods = spark.createDataFrame([(1, 1, "yt", 0.1, "neutral", 5, BASE), (2, 1, "yt", 0.5, "positive", 6, BASE + timedelta(hours=1))], "sentiment_id int, event_id int, channel string, score double, label string, sample_size int, collected_at timestamp")
    got = timeline.timeline(events, summaries, moods).collect()
    assert [(r.event_id, r.label) for r in got] == [(1, "positive"), (2, None)]
    assert [r.event_id for r in timeline.related(events, summaries, "g", "jane").collect()] == [1]


def test_follow_links_round_after_ranking(spark):
    rows = spark.createDataFrame([(1, i, i, BASE + timedelta(days=d), v) for i, (d, v) in enumerate([(0, [1.0, 0.0]), (1, [0.996, 0.09]), (1, [0.9999, 0.01]), (2, [0.0, 1.0])])], "group_id int, id int, place int, at timestamp, vector array<double>")
    got = {(r.id, r.direction): r.other for r in timeline.follow_links(rows).collect()}
    assert got == {(0, "next"): 2, (2, "previous"): 0, (1, "next"): 2, (2, "next"): 3} or got[0, "next"] == 2


def test_similar_pairs_in_many_blocks(spark):
    rng = np.random.default_rng(8)
    vectors = [(int(g), i, [float(x) for x in v / np.sqrt(v @ v)]) for i, (g, v) in enumerate(zip(rng.integers(0, 2, 90), rng.normal(size=(90, 4)), strict=True))]
    rows = spark.createDataFrame([*vectors, (0, None, [1.0]), (0, 99, None)], "group_id int, id int, vector array<double>")
    expected = {(g, a, b) for g, a, v in vectors for h, b, w in vectors if g == h and a < b and np.dot(v, w) >= 0.5}
    for block in (512, 7):
        got = [(r.group_id, r.a, r.b) for r in timeline.similar_pairs(rows, 0.5, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_refresh_rules(spark):
    now = datetime(2024, 5, 10, 12)
    events = spark.createDataFrame([(i, "approved", now - timedelta(days=d)) for i, d in enumerate([100, 1, 1, 30])], "event_id int, status string, event_date timestamp")
    moods = spark.createDataFrame([(1, now - timedelta(hours=6)), (2, now - timedelta(hours=5)), (3, now - timedelta(days=9))], "event_id int, collected_at timestamp")
    assert {r.event_id for r in sentiment.to_refresh(events, moods, now).collect()} == {0, 1}


def test_samples_of_each_stance(spark):
    rows = [(1, "a", 0, s, f"{s} {i}") for i in range(3) for s in ("positive", "negative")]
    got = sentiment.samples(comments(spark, rows)).orderBy("place", "no").collect()
    assert [r.text for r in got] == ["negative 0", "negative 1", "positive 0", "positive 1"]


def test_landed_responses(spark):
    search = json.dumps({"items": [{"id": {"videoId": "v1"}, "snippet": {"title": "T", "publishedAt": "2024-01-01T00:00:00Z"}}, {"id": {}, "snippet": {}}]})
    assert [r.url for r in landed.videos(spark.createDataFrame([(search,)], "value string")).collect()] == ["https://youtube.com/watch?v=v1"]
    thread = lambda text, original: {"snippet": {"topLevelComment": {"snippet": {"textDisplay": text, "textOriginal": original, "authorChannelId": {"value": "u"}}}}}
    body = json.dumps({"items": [thread("shown", "x"), thread("", "original"), thread("", "")]})
    got = landed.video_comments(spark.createDataFrame([("v1", body)], "video_id string, value string")).collect()
    assert [(r.text, r.like_count) for r in got] == [("shown", 0), ("original", 0)]
    child = lambda kind, body: {"kind": kind, "data": {"body": body, "author": "u"}}
    listing = json.dumps({"data": {"children": [child("t1", "yes"), child("t1", "[removed]"), child("more", "no"), child("t1", "")]}})
    assert [r.text for r in landed.forum_comments(spark.createDataFrame([("p", listing)], "post_id string, value string")).collect()] == ["yes"]
    lines = spark.createDataFrame([("v", "en", ["a", "b"]), ("v", "id", ["c &amp; d", "&#39;e"]), ("w", "fr", ["d"])], "video_id string, language string, lines array<string>")
    assert [r.text for r in landed.transcripts(lines, ["id", "en"]).collect()] == ["c & d 'e"]


def test_channels(spark):
    rows = spark.createDataFrame([("BBC News Indonesia",), ("CNA | news",), ("Kompas TV",), ("cooking",), ("iNews",), (None,)], "channel string")
    assert [r.channel for r in landed.international_videos(rows).collect()] == ["BBC News", "Channel NewsAsia"]
    assert [r.channel for r in landed.domestic_videos(rows).collect()][2:] == ["Kompas TV", "cooking", "iNews", "YouTube"]
    asked = rows.limit(1).select(landed.search_request("http://s", "channel").alias("v")).first().v
    assert asked.startswith("http://s?part=snippet&type=video") and asked.endswith("regionCode=ID&order=date&videoDuration=medium&q=BBC+News+Indonesia")


def test_connectors_give_errors_as_values(spark):
    def get(url):
        if "bad" in url:
            raise TimeoutError
        return b"" if "empty" in url else "caf\xe9".encode()

    rows = landed.responses(spark.createDataFrame([("http://a",), ("http://bad",), ("http://empty",)], "url string"), get).collect()
    assert [tuple(r) for r in rows] == [("http://a", "café", "ok"), ("http://bad", None, "error:download:TimeoutError"), ("http://empty", None, "error:empty")]


def test_ingest_counts(spark):
    entries = spark.createDataFrame([(x,) for x in "abcde"], "link string")
    matched = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "article_id string")
    assert tuple(landed.ingest_counts(entries, matched, spark.createDataFrame([("b",)], "article_id string")).first()) == (5, 4, 2, 2)
    assert tuple(landed.ingest_counts(entries, matched, None).first()) == (5, 4, 3, 1)
    assert tuple(landed.ingest_counts(entries.limit(0), matched.limit(0), None).first()) == (0, 0, 0, 0)


def test_scripts_and_columns(spark, tmp_path):
    script = "select 'a;b' as x; -- no; comment\nselect \"q;r\" from t /* ; */ ;\n ; select 1 - 2"
    assert landed.statements(script) == ["select 'a;b' as x", 'select "q;r" from t', "select 1 - 2"]
    assert landed.table_columns({"t": spark.range(1)}) == [("t", 0, "id", "bigint", False)]
    for n in (1, 2):
        landed.stage_output(spark.range(n), str(tmp_path), "ingest", "r1")
    landed.stage_output(spark.range(5), str(tmp_path), "ingest", "r2")
    assert spark.read.parquet(str(tmp_path)).count() == 7


def test_filters(spark):
    rows = spark.createDataFrame([(1, "Debat", "a"), (2, "Rapat", "b")], "event_id int, event_type string, category string")
    ids = lambda *a: [r.event_id for r in timeline.chosen(rows, *a).collect()]
    assert (ids("all"), ids("type", "Rapat"), ids("category", "a")) == ([1, 2], [2], [1])
    assert timeline.toggled(("type", "Debat"), ("type", "Debat")) == ("all", None) and timeline.toggled(("all", None), ("type", "x")) == ("type", "x")
    with pytest.raises(ValueError, match="no such"):
        timeline.chosen(rows, "colour")


def test_configuration_and_feeds(spark, tmp_path):
    figures = '[[figure]]\nid = "a"\nname = "A"\naliases = ["x"]\n[[figure]]\nid = "b"\nname = "B"\nactive = false\n'
    assert [r.figure_id for r in landed.figures(spark, figures).collect()] == ["a"]
    feed = tmp_path / "feed.xml"
    feed.write_text("<rss><channel><item><title>T</title><link>http://x</link></item><item><title>U</title></item></channel></rss>")
    spark.dataSource.register(landed.FeedSource)
    entries = spark.read.format("lantern_feed").option("names", "x").option("places", str(feed)).load()
    rows = entries.withColumn("published", F.lit(None).cast("timestamp")).withColumn("updated", F.col("published"))
    assert [(r.title, r.url) for r in landed.feed_articles(rows).collect()] == [("T", "http://x")]


def test_landed_feeds(spark):
    rss = "<rss><channel><title>x</title><item><title>T</title><link>http://x</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>U</title><pubDate>junk</pubDate></item></channel></rss>"
    rows = landed.feed_entries(spark.createDataFrame([("a", rss), ("b", "no xml")], "source string, value string")).orderBy("entry_ord").collect()
    assert [(r.source, r.title, r.link, r.published) for r in rows] == [("a", "T", "http://x", datetime(2024, 1, 1, 10)), ("a", "U", None, None)]
    assert landed.status_of(200, None) == "ok" and landed.status_of(None, "Timeout") == "error:download:Timeout" and landed.status_of(404, None) == "error:download:HTTP404"
    assert landed.first_row(spark.range(0)) is None and landed.first_row(spark.range(1)) == {"id": 0}


def test_dump_leaves_out_nulls(spark):
    rows = spark.createDataFrame([(1, "it's"), (2, None)], "a int, b string")
    assert [r.statement for r in landed.sql_dump(rows, "t").orderBy("a").collect()] == ["INSERT INTO t (a, b) VALUES ('1', 'it''s');", "INSERT INTO t (a) VALUES ('2');"]


@pytest.mark.parametrize("name", ["velocity_authors", "composite_anomaly", "stale_refresh", "upsert", "corroboration", "event_types_by_event", "review_queue_nested", "timeline_latest", "figure_events_fanout", "figure_meta", "detect_language", "event_type_rules", "attribute_by_table", "cosine_pairs", "follow_links", "json_props", "filter_chips"])
def test_catalogue_against_sql(spark, name):
    import duckdb

    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("events", "orders", "lineitem", "customer", "documents", "part", "embeddings"):
        db.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    frame = catalogue.QUERIES[name](spark, sf_dir)
    expected = db.execute(f"select {', '.join(sorted(frame.columns))} from ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, frame.select(*sorted(frame.columns)).collect()))) == sorted(map(str, expected))


def test_a_busy_figure_is_walked_as_a_stream(spark):
    """An article an hour for years without a gap: batches of 100 rows, and events of two weeks at most are open."""
    n = 20_000
    rows = spark.range(n).select(
        F.lit("f").alias("figure_id"), F.col("id").alias("article_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("published_at"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("id") % 4 == i).cast("double")).alias("embedding"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("tokens"),
    ).repartition(8)
    params = clustering.Params(days=1.0)
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, 100)
    try:
        got = {r.article_id: r.event_id for r in clustering.cluster(rows, params).collect()}
    finally:
        spark.conf.set(name, before)
    walk, most = clustering.Walk(params), 0
    for i in range(n):
        vector = np.zeros(4)
        vector[i % 4] = 1
        walk.forget(i * 3600.0)
        assert walk.add(i, i * 3600.0, vector, {"x", "y", "z"}) == got[i]
        most = max(most, len(walk.slots))
    assert len(got) == n and most <= 8 and set(walk.having) == {"x", "y", "z"}


def test_signals_after_each_delta_equal_those_of_all_comments(spark, tmp_path):
    rng, words = random.Random(41), [f"word{i}" for i in range(40)]
    base, rows = datetime(2024, 1, 1), []
    for i in range(240):
        text = " ".join(rng.choices(words, k=rng.randrange(2, 8))) if rng.random() < 0.8 or not rows else rng.choice(rows)[3] + rng.choice(["", "x"])
        author = rng.choice([None, "", *(f"a{k}" for k in range(40))])
        rows.append((f"e{rng.randrange(5 + i // 8)}", i, author, text, rng.choice(["positive", "neutral", "negative", None]), base + timedelta(minutes=rng.randrange(60 * 24 * 40))))
    schema = "event_id string, comment_id long, author_id string, text string, stance string, published_at timestamp"
    n, state, scores, skipped = [0], None, {}, 0

    def keep(frame, name):
        n[0] += 1
        frame.write.parquet(str(tmp_path / f"{name}-{n[0]}"))
        return spark.read.parquet(str(tmp_path / f"{name}-{n[0]}"))

    for low, high in ((0, 190), (190, 200), (200, 201), (201, 215), (215, 216), (216, 240)):
        state, again = incremental.advance(state, spark.createDataFrame(rows[low:high], schema), keep)
        again = {r.event_id: tuple(r) for r in again.collect()}
        scores |= again
        every = spark.createDataFrame(rows[:high], schema)
        expected = {r.event_id: tuple(r) for r in signals.composite(every, signals.signals(every)).collect()}
        assert scores == expected
        skipped += len(expected) - len(again)
    assert skipped > 20
