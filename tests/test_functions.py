import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.functions import text as t
from lantern.functions import display, subsequence, udfs, vectors


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values()) or (1,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in cells.items()) or "x int")
    return row.select(column.alias("v")).first().v


def test_tokens_are_a_set_without_short_words_and_stopwords(spark):
    got = value(spark, t.tokens("x", ["named"]), x="ab abc ABC yang Named ab×cd élan 123")
    assert set(got) == {"ab×cd", "abc", "élan"} and len(got) == 3


def test_collapse_and_ellipsis(spark):
    assert value(spark, t.collapsed("x"), x="  a  b\n\tc ") == "a b c"
    assert value(spark, t.ellipsis("x", 240), x="y" * 240) == "y" * 240
    assert value(spark, t.ellipsis("x", 5), x="abc  def") == "abc…"


def test_first_rule_and_first_term_win(spark):
    assert value(spark, t.first_rule("x", [(r"\bone\b", "A"), (r"\btwo\b", "B")], "other"), x="Two and one") == "A"
    assert value(spark, t.first_rule("x", [(r"\bone\b", "A")], "other"), x="none") == "other"
    assert value(spark, t.contains_any("x", [("f", "Jane"), ("g", "Doe")]), x="DOE, JANE") == "f"
    assert value(spark, t.contains_any("x", [("f", "Jane")]), x="nobody") is None


def test_citations_keep_repeats_and_bounds(spark):
    got = value(spark, t.citations("x", "y"), x="[Sumber 1] [Sumber 0] [Sumber 3] [Sumber 2] [Sumber 1]", y=["a", "b"])
    assert [(c.document_index, c.document_title) for c in got] == [(0, "a"), (1, "b"), (0, "a")]


@pytest.mark.parametrize(
    "reply,n,expected",
    [
        ("1. positive\n2. what\n3) Negative.\n9. positive", 4, "positive negative positive neutral"),
        ("1. negative - it is bad\n\n  2)positive", 2, "negative positive"),
        ("negative\r\nI would say: POSITIVE\n- negative.\n99999999999999999999. negative", 5, "negative positive negative neutral neutral"),
        ("1.\tpositive\u2028positive", 1, "positive"),
        ("1. -positive", 1, "neutral"),
        ("", 2, "neutral neutral"),
        (None, 0, ""),
        ("positive", -1, ""),
    ],
)
def test_labels_of_odd_replies(spark, reply, n, expected):
    assert value(spark, t.labels("x", "n", ["positive", "neutral", "negative"], "neutral"), x=reply, n=n) == expected.split()


def test_numbers_and_dates_that_are_none(spark):
    got = value(spark, t.citations("x", "y"), x="[Sumber 20260101123] [Sumber 1] [Sumber 99999999999999999999]", y=["a"])
    assert [(c.document_index, c.document_title) for c in got] == [(0, "a")]
    for text in ("", "  ", "soon", "2026-13-40", None):
        assert value(spark, t.timestamp_or("x"), x=text) is None
        assert str(value(spark, t.timestamp_or("x", F.lit("2026-01-01").cast("timestamp")), x=text)) == "2026-01-01 00:00:00"
    for text in ("2026-06-20T06:01:18Z", "2026-06-20T06:01:18+00:00", "2026-06-20 06:01:18", "2026-06-20T08:01:18+02:00"):
        assert value(spark, F.unix_seconds(t.timestamp_or("x")), x=text) == 1781935278


@pytest.mark.parametrize("few", [False, True])
def test_many_pairs_at_once_are_as_alike_as_one_by_one(few, monkeypatch):
    rng = random.Random(31)
    texts = ["", "a", "aé日", "x" * 64, "x" * 65, *("".join(rng.choices("abcdeé日", k=rng.randrange(1, 400))) for _ in range(40))]
    for base in texts[5:15]:
        cut = rng.randrange(len(base))
        texts += [base[:cut] + "".join(rng.choices("abz", k=rng.randrange(20))) + base[cut + rng.randrange(20) :], base[::-1]]
    texts = sorted(set(texts))
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j]
    pairs = rng.sample(pairs, 60) if few else pairs
    one, two = np.array(pairs).T
    found = subsequence.Texts(texts)
    monkeypatch.setattr(subsequence, "LANES", 500)
    for least in (30, 55, 70, 85, 100):
        got = subsequence.alike(found, one, two, least)
        assert got.tolist() == [udfs.indel_ratio(texts[i], texts[j]) >= least - 1e-9 for i, j in pairs]
    monkeypatch.setattr(subsequence, "TABLE_BYTES", 1000)  # a table for some texts at a time, and long integers
    assert subsequence.alike(found, one, two, 70).tolist() == [udfs.indel_ratio(texts[i], texts[j]) >= 70 - 1e-9 for i, j in pairs]


def test_json_text(spark):
    row = spark.sql("select array(named_struct('a', 'x \"é\"', 'b', cast(null as int))) as v").select(t.json_text("v").alias("j"), t.json_text(F.lit(None).cast("array<int>")).alias("k")).first()
    assert row.j == '[{"a":"x \\"é\\"","b":null}]' and row.k is None


@pytest.mark.parametrize("mean,label", [(0.15, "neutral"), (0.1501, "positive"), (-0.15, "neutral"), (-0.16, "negative")])
def test_stance_label_edges(spark, mean, label):
    assert value(spark, t.stance_label("x"), x=mean) == label


@pytest.mark.parametrize("given,shown", [("2026-06-20", "20 Juni 2026"), ("2026-06-20T06:01:18Z", "20 Juni 2026 06:01"), ("junk", "junk"), (None, ""), ("2026-13-01", "2026-13-01")])
def test_local_dates(spark, given, shown):
    assert value(spark, t.local_date("x"), x=given) == shown


def test_score_bands(spark):
    bands = [value(spark, display.band("x", display.SCORE_LABELS), x=s) for s in (-40, -39, -10, -9, 15, 16, 45, 46)]
    names = [n for *_, n in display.SCORE_LABELS]
    assert [value(spark, display.band("x", display.SCORE_LABELS), x=x) for x in (-39.5, -9.5, 15.5, 45.5, 46.0)] == [names[i] for i in (1, 2, 2, 3, 4)]
    assert [value(spark, display.band("x", display.SCORE_COLOURS), x=x) for x in (-10.0, 15.9, 16.0)] == ["#c0392b", "#9b7b3f", "#2e7a52"]
    assert bands == [names[i] for i in (0, 1, 1, 2, 2, 3, 3, 4)]
    assert [value(spark, display.band("x", display.RECORD_EMOJI), x=s) for s in (-30, -10, 10, 11, 31)] == ["😠", "🙁", "😐", "🙂", "😊"]


def test_display(spark):
    assert value(spark, display.signed("x"), x=0) == "+0" and value(spark, display.signed("x"), x=-3) == "−3"
    assert value(spark, display.score_place("x"), x=14) == "57.0%" and value(spark, display.signed_fixed("x"), x=0.5) == "+0.50"
    assert value(spark, display.language_name("x"), x="xx") == "XX" and value(spark, display.language_name("x"), x=None) == "original"
    assert value(spark, display.signal_labels("x"), x="velocity,other") == "Kecepatan tinggi, other"
    assert tuple(value(spark, display.short_date("x"), x="19 Jun 2026")) == ("19 Jun", "Juni", "2026")
    assert value(spark, display.initial("x"), x="") == "?" and value(spark, display.ordinal("x"), x=7) == "07"
    assert value(spark, display.request("http://h", q="x"), x="a b&c") == "http://h?q=a+b%26c"


def test_query_builder(spark):
    build = t.search_query("x", F.lit("Jane Doe"), F.array(F.lit("Jane")), ["the", "of"])
    assert value(spark, build, x="The speech of the day") == "Jane Doe speech day"
    assert value(spark, build, x="JANE speaks a b c d e f g") == "JANE speaks a b c d e"


def test_links_are_never_linked_again(spark):
    got = value(spark, t.linked("x", {"Jane": "j", "Jane Doe": "d", "href": "h"}), x="Jane Doe & jane\nend")
    assert got == '<a href="/figure/d" class="fig-link">Jane Doe</a> &amp; <a href="/figure/j" class="fig-link">Jane</a><br>end'
    assert [(s.text, s.is_name) for s in value(spark, t.segments("x", ["Jane"]), x="a Jane b jane")] == [("a ", False), ("Jane", True), (" b jane", False)]
    assert [(s.text, s.is_name) for s in value(spark, t.segments("x", ["Jane", "Jane Doe"]), x="Jane Doe")] == [("Jane", True), (" Doe", False)]  # the first given
    assert [(s.text, s.is_name) for s in value(spark, t.segments("x", []), x="plain")] == [("plain", False)]


def test_sql_literals(spark):
    assert value(spark, t.sql_literal("x"), x="it's") == "'it''s'"
    assert value(spark, t.sql_literal("x"), x=None) == "NULL"


def test_paragraphs_follow_the_parser_state():
    long, short = "x" * 41, "x" * 40
    assert udfs.paragraphs_of(f"<p>{short}</p>" * 9) is None
    assert udfs.paragraphs_of(f"<p>{long}</p>" * 5) == "\n\n".join([long] * 5)
    assert udfs.paragraphs_of(f"<nav><p>{long * 9}</p></nav><script>{long}</script>") is None
    merged = udfs.paragraphs_of(f"<p>{'a' * 150}<p>{'b' * 150}</p>")
    assert merged == "a" * 150 + "b" * 150
    nested = udfs.paragraphs_of(f"<p>{'a' * 100}<p>{'b' * 100}</p>{'c' * 100}</p>")  # the tail is the outer paragraph's
    assert nested == "a" * 100 + "b" * 100 + "\n\n" + "c" * 100
    assert udfs.paragraphs_of(f"<nav><p>menu</nav>{'t' * 250}") is None  # opened inside a skipped element
    assert udfs.paragraphs_of(f"<nav><p>menu</nav>{'t' * 250}</p><p>{'u' * 250}</p>") == "u" * 250
    assert udfs.paragraphs_of(f"<p>{'a' * 150}<nav>{'n' * 90}</p>{'m' * 90}</nav>{'z' * 90}</p><p>{'b' * 60}</p>") == "a" * 150 + "\n\n" + "b" * 60  # closed inside one
    assert udfs.paragraphs_of(f"</p></p><p>{'a' * 250}</p></p>{'z' * 90}") == "a" * 250  # closing while none is open


class ModelOfParagraphs:
    """The same states kept as counts over a list of tokens."""

    @staticmethod
    def read(tokens):
        depth = skipped = 0
        held, out = "", []
        for kind, name in tokens:
            if kind == "open":
                skipped += name == "nav"
                depth += name == "p" and skipped == 0
            elif kind == "close" and name == "nav":
                skipped -= skipped > 0
            elif kind == "close" and depth:
                depth -= 1
                out += [held] if len(held) > 40 else []
                held = ""
            elif kind == "text" and depth and not skipped:
                held += name
        return "\n\n".join(out) if len("\n\n".join(out)) >= 200 else None


def test_paragraphs_equal_a_model_on_random_pages():
    rng = random.Random(5)
    some = 0
    for _ in range(400):
        tokens = [rng.choice([("open", "p"), ("open", "p"), ("close", "p"), ("close", "p"), ("open", "nav"), ("close", "nav"), ("text", rng.choice("abc") * rng.randrange(20, 260))]) for _ in range(20)]
        page = "".join({"open": f"<{n}>", "close": f"</{n}>", "text": n}[k] for k, n in tokens)
        assert udfs.paragraphs_of(page) == ModelOfParagraphs.read(tokens), page
        some += udfs.paragraphs_of(page) is not None
    assert some > 50


def test_indel_ratio_against_a_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(12))) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        expected = 200 * rows[-1][-1] / (len(a) + len(b)) if a or b else 100
        assert udfs.indel_ratio(a, b) == expected
        assert all(udfs.reaches(a, b, least) == (expected >= least) for least in (50, 85, 100))
    a = "".join(rng.choices("abcd", k=2000))
    assert udfs.reaches(a, a[:900] + "x" * 50 + a[900:], 85) and not udfs.reaches(a, "".join(rng.choices("efgh", k=2000)), 85)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(F.length("text") > 300)
    rows = docs.select("lang", udfs.language("text").alias("got")).collect()
    assert np.mean([r.lang == r.got for r in rows]) > 0.85
    cases = {"x" * 19: "id", "xxxx " * 9: "id", "the of and THE dog is in the house": "en", "le chat et la maison, les des une": "fr"}
    table = spark.createDataFrame([(x,) for x in [*cases, None]], "x string")
    assert [r.v for r in table.select(udfs.language("x").alias("v")).collect()] == [*cases.values(), "id"]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, [0.0, 0.0])], "k int, v array<float>")
    got = {r.k: r.centroid for r in vectors.mean_vector(rows, "k", "v", 2).collect()}
    assert np.allclose(got[1], [0.6, 0.8]) and got[2] == [0.0, 0.0]


def test_providers(spark):
    rows = spark.createDataFrame([("good great day",), ("bad",), (None,)], "x string")
    assert [r.v for r in rows.select(udfs.stance()("x").alias("v")).collect()] == ["positive", "negative", "neutral"]
    assert len(rows.select(udfs.embedding()("x").alias("v")).first().v) == 64
    shout = udfs.translation(lambda xs: [x.upper() for x in xs])
    assert [r.v for r in spark.createDataFrame([("short",), ("a text of more than twenty characters",)], "x string").select(shout("x").alias("v")).collect()] == ["short", "A TEXT OF MORE THAN TWENTY CHARACTERS"]
    assert udfs.first_sentences(["One. Two.", "Three"]) == "One. [Sumber 1] Three [Sumber 2]"


def test_logos_and_json(spark):
    got = value(spark, display.logos("x", {"Kompas": "k.png"}), x=["Kompas", "Tempo", "", "Kompas"])
    assert got == ["k.png", "T", "?"]
    assert value(spark, t.json_field("x", "a"), x='{"a": "b"}') == "b" and value(spark, t.json_field("x", "a"), x="junk") is None
    assert [value(spark, t.json_length("x"), x=x) for x in ("[1, 2]", "junk", None)] == [2, 0, 0]


def test_providers_that_fail_give_error_values(spark):
    def broken(texts):
        raise TimeoutError

    rows = spark.createDataFrame([("ask",)], "x string")
    assert tuple(rows.select(udfs.replies("x", lambda xs: [x.upper() for x in xs]).alias("v")).first().v) == ("ASK", "ok")
    assert tuple(rows.select(udfs.replies("x", broken).alias("v")).first().v) == (None, "error:provider:TimeoutError")


def test_one_bad_prompt_of_a_thousand_costs_its_own_answer(spark):
    calls = []

    def provider(texts):
        calls.append(len(texts))
        if "p637" in texts:
            raise TimeoutError
        return [t.upper() for t in texts]

    got = udfs.answered([f"p{i}" for i in range(1000)], provider)
    assert [i for i, (body, status) in enumerate(got) if status != "ok"] == [637] and got[637] == (None, "error:provider:TimeoutError")
    assert all(body == f"P{i}" for i, (body, _) in enumerate(got) if i != 637) and len(calls) < 60
    assert udfs.answered(["a", "b"], lambda texts: texts[:1] if len(texts) > 1 else texts, 0) == [("a", "ok"), ("b", "ok")]
    rows = spark.range(50).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("p")).select("p", udfs.replies("p", lambda texts: [None if "p3" in texts and len(texts) == 1 else t if "p3" not in texts else 1 / 0 for t in texts]).alias("r"))
    assert {(r.p, r.r.status) for r in rows.collect() if r.r.status != "ok"} == {("p3", "error:empty")}


def test_flaky_provider_is_tried_again():
    state = {"left": 2}

    def flaky(texts):
        state["left"] -= 1
        if state["left"] >= 0:
            raise ConnectionError
        return texts

    assert udfs.answered(["a", "b"], flaky) == [("a", "ok"), ("b", "ok")]


def _plain_lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abcde", "abcdefghijklmnopq 😀"])
def test_alike_equals_plain_subsequences(letters, monkeypatch):
    """With whole texts alone, with parts of the alphabet, with lanes and with long integers; empty and equal texts too."""
    rng = random.Random(len(letters))
    base = ["".join(rng.choices(letters, weights=range(1, len(letters) + 1), k=k)) for k in (0, 1, 62, 63, 64, 126, 190, 260)]
    texts = [*base, *("".join(rng.choice(letters) if rng.random() < share else c for c in t if rng.random() > share / 4) for t in base for share in (0, 0.1, 0.2))]
    first, second = np.triu_indices(len(texts), 1)
    plain = np.array([_plain_lcs(texts[i], texts[j]) for i, j in zip(first, second, strict=True)])
    both = np.array([len(texts[i]) + len(texts[j]) for i, j in zip(first, second, strict=True)])
    for part, wide in ((1 << 30, 0), (8, 0), (8, 1 << 30)):
        monkeypatch.setattr(subsequence, "PART_LETTERS", part)
        monkeypatch.setattr(subsequence, "WIDE", wide)
        held = subsequence.Texts(texts)
        assert (len(held.parts()) > 1) == (part == 8)
        for least in (70, 85):
            assert (subsequence.alike(held, first, second, least) == (200 * plain >= least * both)).all()
        for need in (0, 40):
            got = subsequence.shared(held, first, second, np.full(len(first), need))
            assert (got == np.where(plain >= need, plain, -1)).all()


def test_long_texts_are_read_side_by_side(monkeypatch):
    """fuzzy_copypasta: pairs of long texts were read one by one, by long integers; words are closed and opened again where pieces of a text are moved."""
    rng = random.Random(4)
    alone = []
    monkeypatch.setattr(subsequence, "_alone", lambda *args, f=subsequence._alone: alone.append(1) or f(*args))
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=450)) for _ in range(8)]
    moved = [t[k:] + t[:k] if i % 2 else t[:k] + "z" * 200 + t[k + 250 :] for i, t in enumerate(texts) for k in (100 + 90 * i,)]
    texts += [*moved, *("".join(c for c in t if rng.random() > 0.08) for t in texts)]
    first, second = np.triu_indices(len(texts), 1)
    plain = np.array([udfs.lcs(texts[i], texts[j]) for i, j in zip(first, second, strict=True)])
    both = np.array([len(texts[i]) + len(texts[j]) for i, j in zip(first, second, strict=True)])
    held = subsequence.Texts(texts)
    for share, least in ((0.6, 85), (0.01, 85), (0.01, 75)):
        monkeypatch.setattr(subsequence, "FIRST", share)
        expected = 200 * plain >= least * both
        assert (subsequence.alike(held, first, second, least) == expected).all() and expected.any()
    assert len(alone) < 100
    got = subsequence.shared(held, first, second, plain)
    assert (got == plain).all() and (subsequence.shared(held, first, second, plain + 1) == -1).all()
