"""Substring dedup, resampling and the source audit against brute force, and their odd inputs."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.llm import resampling, source_audit, substring_dedup

# ------------------------------------------------------------------ 11 substring dedup


def removed(rows, words):
    """rows: (doc_id, text). The texts that are left, by brute force."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for a in range(len(w) - words + 1):
            key = tuple(w[a : a + words])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - words + 1):
            if i is not None and first[tuple(w[a : a + words])] < i:
                gone |= set(range(a, a + words))
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    return sorted(out, key=str)


def corpus(seed, n=60, words=5):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(9)}" for _ in range(rng.randrange(words, 4 * words))] for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.randrange(4)}" for _ in range(rng.randrange(12))] for _ in range(rng.randrange(5))]
        rows.append((i if rng.random() < 0.9 else rng.randrange(n), rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    return rows


@pytest.mark.parametrize(("seed", "words", "task", "crowd"), [(1, 5, 1 << 20, 1000), (2, 1, 1 << 20, 1000), (3, 8, 40, 1000), (4, 130, 1 << 20, 1000), (5, 2, 7, 3), (6, 6, 30, 5), (7, 9, 1 << 20, 4), (8, 130, 50, 2)])
def test_what_is_left_equals_brute_force(spark, seed, words, task, crowd):
    rows = corpus(seed, words=words if words < 100 else 40)
    if words > 100:
        rows += [(900 + k, " ".join(f"q{j % 7}" for j in range(300))) for k in range(3)]
    rows += [(None, rows[3][1]), (7, None), (8, ""), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substring_dedup.deduplicated(docs, substring_dedup.Params(words=words, task_windows=task, crowd=crowd)).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, words)


def test_a_full_sketch_loses_nothing(spark):
    rows = corpus(9, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    params = substring_dedup.Params(words=5)
    width, bits = substring_dedup.sketch(docs, params)
    object.__setattr__(params, "most_bytes", 1)  # the least width there is
    assert params.width(1 << 60) == 16 and width == 16 and 0 < np.unpackbits(bits[0]).sum() < bits.shape[1] * 8
    got = substring_dedup.deduplicated(docs, substring_dedup.Params(words=5, cells=1e-9, rows=1)).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, 5)


def test_the_sketch_grows_with_the_texts_up_to_its_bound():
    params = substring_dedup.Params()
    assert [params.width(n) for n in (0, 10**8, 10**9, 10**14)] == [16, 22, 25, 28]
    assert params.rows << (params.width(10**16) - 2) == params.most_bytes


def test_estimates_are_never_below_the_count(spark):
    docs = spark.createDataFrame(corpus(11, 100), "doc_id long, text string")
    params = substring_dedup.Params(words=6)
    width, bits = substring_dedup.sketch(docs, params)
    seen = defaultdict(set)
    for n, r in enumerate(docs.collect()):
        for part in substring_dedup.slices(substring_dedup.pa.array([r.text])):
            found = substring_dedup.windows(part.words(), params)
            for p, k in zip(found.piece.tolist(), found.key.tolist(), strict=True):
                seen[p, k].add(n)
    often = np.array([p for (p, _), docs in seen.items() if len(docs) > 1], np.uint64)
    assert len(often) and len(substring_dedup._estimated(often, bits[0], width, params.rows)) == len(often)


def test_extra_columns_and_empty_tables_of_substring_dedup(spark):
    schema = "n_words string, doc_id long, _spans int, text string, start int, gone string"
    docs = spark.createDataFrame([("a", 1, 2, "x y z", 3, "b"), (None, 2, None, "x y z", None, None)], schema)
    got = substring_dedup.deduplicated(docs, substring_dedup.Params(words=2))
    assert got.columns == [*docs.columns, "n_words_", "n_removed"]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [("a", 1, 2, "x y z", 3, "b", 3, 0), (None, 2, None, "", None, None, 3, 3)]
    assert substring_dedup.deduplicated(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ 12 resampling


def integral(v, w, d, u):
    return 2 * v * u + floor(Fraction((w - v) * u * u, d))


def buckets(rows, linear, bucket, longest):
    """rows: (client, sec, cents), one a client and second; second by second."""
    out = defaultdict(lambda: [0, 0, 0])
    lines = defaultdict(list)
    for c, s, v in rows:
        lines[c].append((s, v))
    for c, line in lines.items():
        line.sort()
        for (s, v), after in zip(line, [*line[1:], None], strict=True):
            out[c, s // bucket * bucket][0] += 1
            gap = after[0] - s if after else None
            d = (gap if gap is not None and gap <= longest else 0) if linear else min(gap if gap is not None else longest, longest)
            w = after[1] if linear and after else v
            for u in range(d):
                mine = out[c, (s + u) // bucket * bucket]
                mine[1] += 1
                mine[2] += integral(v, w, d, u + 1) - integral(v, w, d, u)
    return sorted((c, b, n, k, a, a // (2 * k) if k else None) for (c, b), (n, k, a) in out.items())


@pytest.mark.parametrize("signal", ["step", "linear"])
@pytest.mark.parametrize(("bucket", "longest", "block", "batch"), [(60, 45, 120, 1), (7, 30, 20, 50), (21600, 300, 21600, 20_000), (50, 90, 40, 3)])
def test_buckets_equal_sums_by_second(spark, signal, bucket, longest, block, batch):
    rng = random.Random(bucket + longest)
    rows = {(rng.choice([1, 2, 2, 2, -5]), rng.randrange(-400, 900) if bucket < 1000 else 21600 * rng.randrange(-2, 3) + rng.randrange(-400, 400)): rng.choice([rng.randrange(-90, 90), 10**15 + 7, -(10**15)]) for _ in range(160)}
    flat = [(c, s, v) for (c, s), v in rows.items()]
    found = spark.createDataFrame(flat, "client_id long, sec long, cents long")
    got = resampling.resampled(found, resampling.Params(signal, bucket, longest, block, rows=batch)).collect()
    assert sorted(map(tuple, got)) == buckets(flat, signal == "linear", bucket, longest)


def test_points_of_clicks(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (1, at + timedelta(milliseconds=100), 5, 1.005), (2, at + timedelta(milliseconds=900), 5, -2.345), (2, at + timedelta(milliseconds=900), 5, -2.345),
        (None, at, 5, 9.0), (3, at, None, 1.0), (4, None, 5, 1.0), (5, at, 5, None), (6, datetime(1969, 12, 31, 23, 59, 59, 500000), 6, 0.0),
    ]
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, client_id long, value double").withColumn("sec", F.lit("clash")).withColumn("own", F.lit(1))
    want = [(5, 1704067200, floor(100 * -2.345 + 0.5)), (6, -1, 0)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    for other in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", other)
        try:
            assert sorted(map(tuple, resampling.points(clicks).collect())) == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
    assert resampling.resampled(resampling.points(clicks.limit(0))).count() == 0
    with pytest.raises(ValueError, match="no such signal"):
        resampling.resampled(resampling.points(clicks), resampling.Params("cubic"))


# ------------------------------------------------------------------ 13 source audit


def audited(rows, least, top):
    """rows: (text, lang, source); every pair over every kept term."""
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    docs = [(("".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in (t or "")).translate(low)).split(" "), lang or "", source or "") for t, lang, source in rows]
    docs = [([w for w in ws if w], lang, source) for ws, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        held, counts = Counter(), defaultdict(Counter)
        for ws, g, s in docs:
            if g == lang:
                held.update(set(ws))
                counts[s].update(ws)
        kept = sorted(t for t, n in held.items() if n >= least)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("params", [source_audit.Params(3, 4), source_audit.Params(2, 50, entries=5, vectors=2, cells=8), source_audit.Params(4, 2, cells=1 << 22), source_audit.Params(10**6)])
def test_audit_equals_every_pair_over_every_term(spark, params):
    rng = random.Random(params.least_documents)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["Ärger", "ÀB", "zz", "Zz", "日本", "a1b"]
    rows = [(" ".join(rng.choice(words[: rng.randrange(1, len(words))]) for _ in range(rng.randrange(15))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "s10", "é", None])) for _ in range(150)]
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("x y", "it", None), rows[0], rows[0], ("long " * 50_000, "en", "s1")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit("clash"))
    got = source_audit.audit(docs, params).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == audited(rows, params.least_documents, params.top)


def test_audit_of_an_empty_table(spark):
    assert source_audit.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
