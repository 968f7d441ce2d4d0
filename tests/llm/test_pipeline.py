"""Each stage of the corpus pipeline against its operator's own decisions."""

import corpus_pipeline
from pyspark.sql import functions as F

from lantern.llm import decontamination, fertility, mixing, near_dedup
from lantern.llm.queries import queries

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]

    def step(name, rows):
        out = stages[name](spark, rows, SMALL)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    ids = lambda rows: sorted(r.doc_id for r in rows.select("doc_id").collect())
    good = step("quality", docs)
    assert good.columns == columns and ids(good) == ids(fertility.score(docs).filter("kept"))
    single = step("near_duplicates", good)
    heads = near_dedup.classes(good)
    assert single.columns == columns and ids(single) == sorted({r.class_id for r in heads.collect()})
    clean = step("decontamination", single)
    leaks = {r.doc_id for r in decontamination.leaks(single, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert clean.columns == columns and ids(clean) == [i for i in ids(single) if i not in leaks]
    taken = step("mixing", clean)
    assert taken.columns == columns and taken.exceptAll(clean.crossJoin(spark.range(3)).drop("id")).count() == 0
    words = lambda rows: {r.source: r.n for r in rows.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    goal = {r.source: r.target for r in mixing.mix(clean).select("source", "target").distinct().collect()}
    largest = clean.agg(F.max(mixing.n_words(F.col("text")))).first()[0]
    got = words(taken)
    assert all(abs(got.get(s, 0) - goal[s]) <= largest for s in goal)
    last = step("sharding", taken)
    sizes = [r["count"] for r in last.groupBy("shard").count().collect()]
    assert ids(last) == ids(taken) and max(sizes) - min(sizes) <= 1 and last.columns == [*columns, "shard", "slot"]
    assert last.select("shard", "slot").distinct().count() == last.count()


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, _digest string"
    text = "seven wizards quietly mix jugs of vodka near the old quay while a brown fox watches them from afar"
    rows = [(1, text, "en", "a", 1, "x", "y"), (1, text, "en", "a", 1, "x", "y"), (2, None, None, None, None, None, None), (None, text + " today", None, None, 1, "x", "y"), (3, "", "en", "a", 0, "", ""), (4, "word " * 30_000, "en", "a", 1, "x", "y")]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    left = {"quality": 3, "near_duplicates": 3, "decontamination": 6, "mixing": None, "sharding": 6}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.columns == [*docs.columns, *(["shard_", "slot"] if name == "sharding" else [])]
        assert left[name] is None or out.count() == left[name], name
        assert stage(spark, none, SMALL).count() == 0


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.count() > 100 and rows.columns[-2:] == ["shard", "slot"]


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
