"""Tables of names against the regular expressions that say the same, and against plain loops."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from lantern.functions import text as t
from lantern.functions.names import Trie, apart, places
from lantern.operators import names, timeline

PAGES = {"Jane": "j", "Jane Doe": "d", "href": "h", "doe & co": "c", "ÉLAN": "e", "a": "a"}
TEXTS = ["Jane Doe & jane\nend", "JANE DOE & CO <href>", "", None, "ÉLAN élan", "aaa janejane doe", "&amp; nothing", "x" * 50_000 + "Jane", "Jane", "Jane"]


def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def test_places_are_those_of_plain_search():
    rng = random.Random(3)
    for _ in range(200):
        words = list({"".join(rng.choices("ab😀", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 8))})
        texts = [None if rng.random() < 0.1 else "".join(rng.choices("ab😀c", k=rng.randint(0, 30))) for _ in range(5)]
        want = {(i, m.start(), m.start() + len(w), n) for i, x in enumerate(texts) for n, w in enumerate(words) for m in re.finditer(f"(?={w})", x or "")}
        got = list(zip(*(part.tolist() for part in places(texts, Trie(words))), strict=True))
        assert len(got) == len(want) and set(got) == want


def test_places_that_stay_are_those_of_one_expression():
    rng = random.Random(4)
    for _ in range(200):
        words = list({"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 6))})
        text = "".join(rng.choices("abc", k=40))
        _, start, end, name = places([text], Trie(words))
        for rank, order in ((-(end - start), sorted(words, key=len, reverse=True)), (name, words)):
            want = [m.span() for m in re.finditer("|".join(order), text)]
            assert [(start[i], end[i]) for i in apart(start, end, rank)] == want


def test_links_equal_the_expression(spark):
    table = spark.createDataFrame([*PAGES.items(), ("", "x"), (None, "y"), ("Jane", "z"), ("Nobody", None)], "name string, page string")
    for block in (100, 2):
        got = names.linked_by_table(rows(spark).withColumn("want", t.linked("text", PAGES)), "text", table, block=block)
        assert got.columns == ["id", "text", "want", "linked"] and got.count() == len(TEXTS)
        assert got.filter("not (linked <=> want)").count() == 0


def test_segments_equal_the_expression(spark):
    given = ["Jane", "Jane Doe", "Doe", "ÉLAN", "a"]
    table = spark.createDataFrame([*enumerate(given), (9, "Jane"), (9, ""), (None, "x")], "name_ord int, name string")
    some = rows(spark).filter("text is not null")
    for block in (100, 2):
        got = names.segments_by_table(some.withColumn("want", t.segments("text", given)), "text", table, block=block)
        assert got.filter("to_json(struct(segments)) <> to_json(struct(want as segments))").count() == 0
        assert got.filter("array_join(transform(segments, s -> s.text), '') <> text").count() == 0


def test_no_names_and_no_texts(spark):
    none = spark.createDataFrame([], "name string, page string")
    got = {r.id: r.linked for r in names.linked_by_table(rows(spark), "text", none).collect()}
    assert got[0] == "Jane Doe &amp; jane<br>end" and got[2] == "" and got[3] is None
    table = spark.createDataFrame([("Jane", "j")], "name string, page string")
    assert names.linked_by_table(rows(spark).limit(0), "text", table).count() == 0


def test_first_mention_is_that_of_literals_whatever_the_blocks(spark):
    figures = [("one", ["janejane", "élan"]), ("two", ["jane"]), ("three", ["x", "a"])]
    table = spark.createDataFrame([(i, f, term) for i, (f, terms) in enumerate(figures) for term in [*terms, ""]] + [(0, None, "jane"), (None, "x", "jane")], "figure_ord int, figure_id string, term string")
    some = spark.createDataFrame([(i, "old", None if i % 2 else "t", x) for i, x in enumerate(TEXTS)], "article_id long, figure_id string, title string, summary string")
    want = {r.article_id: r.figure_id for r in timeline.attributed(some, figures).collect()}
    for block in (100, 1):
        got = timeline.attributed_by_table(some, table, block)
        assert {r.article_id: r.figure_id for r in got.collect()} == want and sorted(got.columns) == sorted(some.columns)


def test_a_hundred_thousand_names_in_one_walk():
    """Twice the text takes about twice the steps: the names are not gone through one by one."""
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, row)) for row in rng.integers(97, 123, (100_000, 9))]
    trie = Trie(words)
    text = "".join(map(chr, rng.integers(97, 123, 200_000))) + words[7]
    began = time.perf_counter()
    _, start, end, name = places([text], trie)
    assert time.perf_counter() - began < 20
    assert any(text[s:e] == words[7] for s, e in zip(start, end, strict=True)) and all(text[s:e] == words[n] for s, e, n in zip(start, end, name, strict=True))


def test_a_large_batch_leaves_the_step_in_small_ones():
    """linked_names at 1 GB: what a task holds at once was a batch of 10,000 whole texts with all places of their names."""
    texts = ["Jane Doe went home. " * 200, None, "", "é😀 Doe"] * 1000
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    table = pa.table({"name": ["Jane", "Doe", "Jane Doe"], "name_ord": [0, 1, 2], "value": ["j", "d", "<Jane Doe>"]})
    out = list(names._with_places(table, "text", longest=True, fold=False, last=True)(iter([batch])))
    assert len(out) > 10 and max(b.nbytes for b in out) < 4_000_000
    got = {r["id"]: r["pieces"] for b in out for r in b.to_pylist()}
    assert len(got) == len(texts) and all("".join(p["text"] for p in got[i]) == (texts[i] or "") for i in got)
    assert got[0][:2] == [{"text": "Jane Doe", "value": "<Jane Doe>"}, {"text": " went home. ", "value": None}] and got[1] == got[2] == []
    assert got[3] == [{"text": "é😀 ", "value": None}, {"text": "Doe", "value": "d"}]


def test_upper_levels_in_a_table_find_the_same(monkeypatch):
    rng = random.Random(6)
    words = list({"".join(rng.choices("abAB日😀", k=rng.randint(1, 6))) for _ in range(300)})
    texts = ["".join(rng.choices("abABc日😀", k=200)) for _ in range(20)]
    for fold in (False, True):
        found = []
        for upper in (0, 50, 1 << 21):
            monkeypatch.setattr("lantern.functions.names.UPPER", upper)
            found.append([part.tolist() for part in places(texts, Trie(words, fold))])
        assert found[0] == found[1] == found[2] and len(found[0][0]) > 1000


def test_blocks_are_few_and_stand_in_stages_of_their_own(spark, monkeypatch):
    """name_segments: each 100,000 names were one more Python worker of every task at the same time."""
    table = spark.range(120_000).selectExpr("id as name_ord", "concat('n', lpad(id, 6, '0')) as name")
    some = spark.createDataFrame([(1, "n000007n119999 n120000"), (2, "")], "id long, text string")
    steps = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    whole = names.segments_by_table(some, "text", table)
    monkeypatch.setattr(names, "_apart", names.cut)
    parts = names.segments_by_table(some, "text", table, block=50_000)
    assert steps(whole) == steps(parts) == 1
    want = {1: [("n000007", True), ("n119999", True), (" n120000", False)], 2: []}
    assert all({r.id: [tuple(s) for s in r.segments] for r in df.collect()} == want for df in (whole, parts))
