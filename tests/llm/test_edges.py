"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from lantern.llm import chat, decontamination, fertility, language_id, license_scan, main_text, mixing, near_dedup, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard string, _digest int, size string"
PLAIN = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix jugs of vodka near old quay " * 3
ROWS = [
    (1, PLAIN, "en", "a", 1, None, "x", 1, "y"),
    (1, PLAIN, "en", "a", 1, None, "x", 1, "y"),
    (2, None, None, None, None, None, None, None, None),
    (None, "", "de", "a", 0, True, "x", 1, "y"),
    (None, "one two", None, "b", 7, True, "x", 1, "y"),
    (3, "word " * 60_000, "en", "b", 5, True, "x", 1, "y"),
    (4, "x" * 200_000, "en", None, 5, True, "x", 1, "y"),
    (5, " \t\n ", "fr", "b", 4, False, "", 0, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(7, PLAIN[:104].strip()), (8, None), (9, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, none, labels):
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score(none, labels.limit(0)).count() == 0


def test_license(docs, none):
    assert license_scan.scan(docs).count() == 0
    assert license_scan.scan(none).count() == 0


def test_decontamination(docs, none, items):
    found = decontamination.leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in found] == [(1, 7, 0), (1, 7, 0)]
    clean = decontamination.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 2
    assert decontamination.clean(none, items).count() == 0
    assert decontamination.leaks(docs, items.limit(0)).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id == 3} == {60_000}
    assert sorted(r.taken for r in mixing.mix(docs).collect()) == sorted(r.taken for r in rows)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_near_dedup(docs, none):
    rows = near_dedup.classes(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.copies for r in rows if r.doc_id == 1} == {2}
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(len(r.text or "") for r in kept.collect()) == sorted([0, 4, 7, len(PLAIN), 200_000, 300_000])
    assert near_dedup.classes(none).count() == 0 and near_dedup.keep_one(none).count() == 0


def test_fertility(docs, none):
    rows = {(r.doc_id, r.n_words): r for r in fertility.score(docs).collect()}
    assert rows[2, 0].base_failed and not rows[2, 0].kept
    assert rows[3, 60_000].base_failed and rows[4, 1].base_failed
    kept = fertility.keep(docs)
    assert kept.columns == docs.columns
    assert fertility.score(none).count() == 0 and fertility.keep(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(ROWS) and {r.law for r in rows} == {"rows"}
    assert len({r.shard for r in rows}) == len(ROWS) and {r.slot for r in rows} == {0}
    out = sharding.sharded(docs)
    assert out.columns == [*docs.columns, "shard_", "slot"] and out.count() == len(ROWS)
    assert sharding.shard(none).count() == 0


def test_rows_repeated_often_and_few_columns(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("a few words").alias("text"))
    out = sharding.sharded(rows)
    assert out.columns == ["doc_id", "text", "shard", "slot"] and out.filter("doc_id = 7").count() == 4000
    assert out.select("shard", "slot").distinct().count() == 6000
    sized = rows.withColumn("source", F.lit("s")).withColumn("extra", F.create_map(F.lit("k"), F.col("doc_id")))
    assert mixing.mixed(sized).count() == 6000  # one source, which is its own target
    assert sorted(r["count"] for r in sharding.shard(rows).groupBy("shard").count().collect()) == [250] * 24


def test_rows_that_differ_in_extra_columns_only_are_kept_apart(spark):
    rows = spark.createDataFrame([(1, "a b", None, "x"), (1, "a b", "x", None), (1, "a b", "x", "x")], "doc_id int, text string, source string, more string")
    assert sorted(map(str, sharding.sharded(rows).drop("shard", "slot").collect())) == sorted(map(str, rows.collect()))


def test_ties(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron"
    docs = spark.createDataFrame([(i, words, "en", "s") for i in range(6)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    assert len({r.score for r in toxicity.score(docs, labels).collect()}) == 1
    items = spark.createDataFrame([(1, words), (2, words)], "item_id long, text string")
    found = decontamination.leaks(docs.limit(1).withColumn("text", F.concat("text", F.lit(" "), "text")), items).collect()
    assert [(r.item_id, r.distance, r.first_word) for r in sorted(found)] == [(1, 0, 0), (2, 0, 0)]
    assert {r.kept for r in fertility.score(docs).collect()} == {True}
    pages = spark.createDataFrame([(i, "http://h.org/", "<html></html>") for i in range(4)], "page_id long, url string, html string")
    assert len({(r.lang, r.confidence) for r in language_id.identify(pages, docs).collect()}) == 1


def test_pages(spark, docs):
    kind = "page_id long, url string, html string, text string, host int"
    pages = spark.createDataFrame([(1, None, None, "t", 1), (1, None, None, "t", 1), (None, "http://a.example.org/x", "", "t", 1), (3, "not a url", "<p>unclosed <b>bold &amp; " + "long " * 50_000, "t", 1)], kind)
    rows = main_text.extract(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text[:20] for r in rows} == {"", "unclosed bold & long"}
    assert main_text.extract(pages.limit(0)).count() == 0
    assert language_id.identify(pages, docs).count() == 4
    assert language_id.identify(pages, docs.limit(0)).filter(F.col("lang").isNotNull()).count() == 0
    assert language_id.identify(pages.limit(0), docs).count() == 0


def test_chat(spark):
    kind = "conv_id long, turn long, role string, text string, ids int"
    turns = spark.createDataFrame([(1, 0, "user", None, 1), (1, 0, "user", None, 1), (None, None, None, "a", 1), (2, 1, "assistant", "y " * 100_000, 1), (2, 1, "assistant", "", 1)], kind)
    rows = {r.conv_id: r for r in chat.digests(chat.formatted(turns)).collect()}
    assert {k: r.n_turns for k, r in rows.items()} == {1: 2, None: 1, 2: 2}
    assert rows[2].loss_chars == 200_000
    assert chat.digests(chat.formatted(turns.limit(0))).count() == 0
