"""The methods against brute force, exact round trips and held-out accuracy."""

import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lantern.llm import chat, decontamination, fertility, language_id, license_scan, main_text, mixing, near_dedup, sharding, textscan, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def invented(rng, n, size=900):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# ------------------------------------------------------------------ scanning


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\raé#Z ", max_size=40)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    got = []
    for part in textscan.slices(pa.array(texts, pa.string())):
        words = part.words()
        raw = part.data.tobytes()
        got += [[raw[a:b].decode() for a, b in zip(words.starts[x:y], words.ends[x:y], strict=True)] for x, y in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]


# ------------------------------------------------------------------ 1 toxicity


def test_automaton_finds_exactly_the_misspelt():
    terms = {"idiot", "pathetic", "worthless", "scum"}
    lexicon = toxicity.Lexicon(terms, set())
    rng = random.Random(5)
    letters = "adehiloprstuwcm"
    for _ in range(3000):
        word = list(rng.choice(sorted(terms)))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        word = "".join(word)
        assert lexicon.misspelt(word) == any(levenshtein(word, t) <= toxicity.edits(t) for t in terms), word


def test_quotation_scores_below_abuse(spark):
    docs = spark.createDataFrame([(1, "you are an idiot and a pathet1c loser"), (2, 'the critic wrote that "idiot" is a word of Greek origin'), (3, "a calm day by the sea")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    assert score[1] > 0.7 > score[2] > score[3]


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = [r.predicted for r in rows if r.toxic == 1]
    false = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(hit) >= 0.7 and np.mean(false) <= 0.05


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_windows_and_score_against_a_plain_reading():
    """The weight of each hit, read again from the text around it, and the sums and the score that follow."""
    params, rng = toxicity.Params(), random.Random(41)
    lexicon = toxicity.Lexicon({"idiot", "pathetic"}, {"moro"})
    parts = ["idiot", "idi0t", "pathetic", "moronic", '"', "«", "»", "you", "said", "calm", "sea", "day", "\n", ",", "blue " * 30]
    for _ in range(300):
        text = " ".join(rng.choices(parts, k=rng.randrange(30)))
        found = [(m.group(), *m.span()) for m in toxicity._TOKEN.finditer(text)]
        sums = {"abuse": 0.0, "bent": 0.0, "quoted": 0}
        for i, (word, start, end) in enumerate(found):
            kind = "abuse" if word in ("idiot", "pathetic") or word.startswith("moro") else "bent" if min(levenshtein(word, t) - toxicity.edits(t) for t in ("idiot", "pathetic")) <= 0 and len(word) >= 4 else None
            if kind:
                line = text[:start].split("\n")[-1][-120:], text[end : end + 120].split("\n")[0]
                quoted = line[0].count('"') % 2 == 1 and '"' in line[1] or line[0].rfind("«") > line[0].rfind("»") and "»" in line[1]
                before, around = {w for w, *_ in found[max(0, i - 5) : i]}, {w for w, *_ in found[max(0, i - 5) : i + 6]}
                if quoted or "said" in before:
                    sums["quoted"] += 1
                    sums[kind] += 0.25
                else:
                    sums[kind] += 1.5 if "you" in around else 1.0
        got = toxicity.features(text, lexicon, params)
        a, b, q = sums["abuse"], sums["bent"], sums["quoted"]
        assert np.allclose(got, [min(a, 1), np.log1p(a), np.log1p(b), np.log1p(q), np.sqrt((a + b) / max(1, len(found)))]), text
    score = next(toxicity._scorer(lexicon, toxicity.PRIOR, params)(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([False]), pa.array([text])], names=["doc_id", "held_out", "text"])])))
    assert abs(score.column("score")[0].as_py() - 1 / (1 + np.exp(-(np.r_[1, toxicity.features(text, lexicon, params)] @ toxicity.PRIOR)))) < 1e-12
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.bool_()), pa.array([], pa.string())], names=["doc_id", "held_out", "text"])
    assert next(toxicity._scorer(lexicon, toxicity.PRIOR, params)(iter([none]))).num_rows == 0


def test_long_texts_with_many_hits_are_scored_in_linear_time():
    import time

    lexicon, took = toxicity.Lexicon({"idiot"}, set()), []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        toxicity.features("you idiot calm " * n, lexicon, toxicity.Params())
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]  # eight times the text


# ------------------------------------------------------------------ 2 licences


def test_license_against_all_runs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        words = invented(rng, 60)
        name = rng.choice(list(license_scan.TEMPLATES))
        text = license_scan.TEMPLATES[name].split()
        if i % 3 == 1 and len(text) > 20:
            text[rng.randrange(len(text))] = "changed"
        at = rng.randrange(60)
        rows.append((i, " ".join(words[:at] + (text if i % 4 else []) + words[at:])))
    found = {(r.doc_id, r.license_id): r.dice for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def bigrams(text):
        words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text.lower())
        return list(zip(words, words[1:], strict=False))

    expected = {}
    for i, text in rows:
        mine = bigrams(text)
        for name, template in license_scan.TEMPLATES.items():
            bag = Counter(bigrams(template))
            m, best = sum(bag.values()), 0
            hits = [k for k, g in enumerate(mine) if g in bag]
            for a in hits:
                for b in hits:
                    if a <= b and b - a < 2.5 * m:
                        run = Counter(mine[a : b + 1])
                        best = max(best, 2 * sum((run & bag).values()) / (m + b - a + 1))
            if best >= 0.9 - 1e-12:
                expected[i, name] = best
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def test_of_licences_that_differ_in_a_word_the_nearest_is_best(spark):
    noise = " ".join(invented(random.Random(6), 40))
    names = ["gpl-2.0-header", "gpl-3.0-header", "lgpl-3.0-header", "agpl-3.0-header", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "apache-2.0-header"]
    rows = []
    for i, name in enumerate(names):
        words = license_scan.TEMPLATES[name].split()
        for k in range(max(1, len(words) // 40)):  # a Dice coefficient of 0.9 to 0.99
            words[5 + 37 * k % (len(words) - 10)] = f"edited{k}"
        rows += [(i, f"{noise} {' '.join(words)} {noise}"), (100 + i, f"{noise} {license_scan.TEMPLATES[name]} {noise}")]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    best = {i: [r.license_id for r in found if r.doc_id == i and r.best] for i, _ in rows}
    assert all(best[i] == [name] and best[100 + i] == [name] for i, name in enumerate(names)), best
    near = [r.dice for r in found if r.doc_id < 100 and r.best]
    assert all(0.9 <= d < 1 for d in near)
    assert license_scan.uncovered([(1.0, 0, 10), (0.9, 0, 12), (1.0, 4, 20), (0.95, 30, 5)]) == [False, False, True, True]


# ------------------------------------------------------------------ 3 decontamination


def test_decontamination_recall_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, invented(rng, rng.randrange(14, 60), 4000)) for i in range(40)]
    docs, truth = [], set()
    for d in range(300):
        words = invented(rng, rng.randrange(20, 300), 4000)
        if d % 2:
            i, item = rng.choice(items)
            copy = list(item)
            for _ in range(int(len(item) * rng.choice([0, 0.05, 0.1, 0.2]))):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], ["new"], [copy[k], "more"]])
            if levenshtein(item, copy) <= 0.2 * len(item):
                truth.add((d, i))
            at = rng.randrange(len(words))
            words = words[:at] + copy + words[at:]
        docs.append((d, " ".join(words)))
    rows = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert len(truth & found) / len(truth) >= 0.97
    words = dict(items)
    for r in rows:
        text = dict(docs)[r.doc_id].split()
        n = len(words[r.item_id])
        assert r.distance <= 0.2 * n and r.distance == min(levenshtein(words[r.item_id], text[a:b]) for a in range(max(0, r.first_word - 12), min(len(text), r.first_word + 13)) for b in range(a + n - 12, a + n + 13) if a <= b)


def test_recall_at_the_bound_for_each_length():
    rng = random.Random(12)
    for n in (4, 5, 6, 7, 9, 10, 12, 14, 15, 20, 30, 60, 120):
        allowed = int(0.2 * n + 1e-9)
        items, texts = [[f"i{j}x{k}" for k in range(n)] for j in range(60)], []
        for item in items:
            copy = list(item)
            for k in sorted(rng.sample(range(n), allowed), reverse=True):
                copy[k : k + 1] = rng.choice([[], [f"new{rng.random()}"[5:]], [copy[k], f"more{rng.randrange(10**6)}"]])
            texts.append(" ".join([*invented(rng, 25, 10**6), *copy, *invented(rng, 25, 10**6)]))
        index, found, truth = decontamination.Index(list(range(60)), [" ".join(x) for x in items], decontamination.Params()), set(), set()
        for part in textscan.slices(pa.array(texts)):
            found |= {(part.first + doc, i) for doc, i, *_ in index.matches(part.words(fold=True, punctuation=True))}
        codes = decontamination.word_hashes([" ".join(x) for x in items]), decontamination.word_hashes(texts)
        for j in range(60):
            if decontamination.substring_distance(codes[0][j], codes[1][j], allowed) is not None:
                truth.add((j, j))
        assert len(truth) >= 50 and len(truth & found) >= 0.95 * len(truth) and found <= truth, n


def test_embedding_keeps_short_edit_distances_short():
    """Whole embeddings of an item and its window: far for unrelated words, nearer for edited ones."""
    rng = random.Random(13)
    item = [f"i{k}" for k in range(40)]
    edited = [w if k % 8 else f"e{k}" for k, w in enumerate(item)]
    index = decontamination.Index([0], [" ".join(item)], decontamination.Params())
    words = next(textscan.slices(pa.array([" ".join(edited), " ".join(invented(rng, 40))]))).words(fold=True, punctuation=True)
    both = np.array([[0, 0, 0], [1, 0, 0]])
    assert index.near(words, both).tolist() == [[0, 0, 0]]

def test_decontamination_in_blocks_equals_one_block(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(4, 30)))) for i in range(60)]
    docs = [(d, None if d == 5 else " ".join(["x y z", items[d][1], "and", items[(d * 7) % 60][1]])) for d in range(40)] + [(3, items[3][1])]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontamination.leaks(*frames).collect()))
    got = sorted(map(tuple, decontamination.leaks(*frames, decontamination.Params(block_bytes=2_000)).collect()))
    assert got == want and len(want) > 60


def test_decontamination_index_is_small_and_lets_every_key_through():
    import pickle
    import time

    rng = np.random.default_rng(9)
    keys = rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    table = decontamination.Keys(keys)
    assert len(table.find(keys)) == len(keys) and len(table.find(rng.integers(0, 1 << 63, 50_000).astype(np.uint64))) < 1_000
    assert len(decontamination.Keys(keys[:0]).find(keys)) == 0
    texts = [" ".join(map(str, rng.integers(0, 20_000, rng.integers(5, 40)))) for _ in range(20_000)]
    began = time.perf_counter()
    index = decontamination.Index(list(range(20_000)), texts, decontamination.Params())
    assert time.perf_counter() - began < 20 and len(pickle.dumps(index)) < 16 << 20


def test_decontamination_hamming_limit_keeps_windows_within_the_bound():
    """Apart from the samples: of windows with a fifth of the words edited, the distance of the embeddings drops few."""
    rng = random.Random(10)
    for n in (5, 10, 20, 50, 120):
        items = [[f"v{rng.randrange(5_000)}" for _ in range(n)] for _ in range(150)]
        edited = []
        for item in items:
            some = list(item)
            for k in rng.sample(range(n), n // 5):
                some[k] = rng.choice([f"new{k}", ""])
            edited.append(" ".join(filter(None, some)))
        index = decontamination.Index(list(range(150)), [" ".join(x) for x in items], decontamination.Params())
        words = next(iter(textscan.slices(pa.array(edited, pa.large_string())))).words(fold=True, punctuation=True)
        found = np.array([(i, i, words.bounds[i]) for i in range(150)])
        kept = len(index.near(words, found)) / 150
        print("far", n, kept)
        assert kept >= 0.95


# ------------------------------------------------------------------ 4 mixing


def test_mix_meets_targets_and_keeps_expectations(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 60)), None if i % 7 == 6 else f"s{min(i % 7, 3)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    order = [*sorted(s for s in sizes if s), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, goal, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        goal = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in sizes if x not in capped) for s in sizes}
        over = {s for s in sizes if goal[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert abs(r.target - goal[r.source]) < 1e-6 * total and r.source_size == sizes[r.source]
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
        assert abs(r.copies - goal[r.source] / sizes[r.source]) < 1
    assert len(out) == len(rows)
    assert all(abs(taken[s] - goal[s]) <= 60 for s in sizes)
    again = mixing.mix(docs.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.taken) for r in out)
    seen = np.zeros(3000)
    for seed in range(100, 106):
        for r in mixing.mix(docs, mixing.Params(seed=seed)).select("doc_id", "copies").collect():
            seen[r.doc_id] += r.copies / 6
    some = [r.doc_id for r in out if r.source == "s3"]
    assert abs(seen[some].mean() - goal["s3"] / sizes["s3"]) < 0.05


# ------------------------------------------------------------------ 5 near duplicates


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 8))
def test_banded_alignment(a, b, most):
    exact = levenshtein(a, b)
    assert near_dedup.edit_distance(a, b, most) == (exact if exact <= most else None)


def test_wide_bands_against_a_table():
    rng = random.Random(19)
    for _ in range(60):
        a = [rng.randrange(40) for _ in range(rng.randrange(1, 140))]
        b = [x if rng.random() > 0.5 else rng.randrange(40) for x in a][: rng.randrange(1, 140)] + [rng.randrange(40) for _ in range(rng.randrange(30))]
        exact = levenshtein(a, b)
        assert near_dedup._by_bits(a, b) == exact
        for most in (10, 30, 60, 200):
            assert near_dedup.edit_distance(a, b, most) == (exact if exact <= most else None)


def test_components(spark, monkeypatch):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[max(find(u), find(v))] = min(find(u), find(v))
    for most in (500_000, 40):  # in one task, and in several with rounds
        monkeypatch.setattr(near_dedup, "EDGES_A_TASK", most)
        got = near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert {r.node: r.root for r in got} == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {u: find(u) for u, v in edges if u != v}


def test_near_dedup_recall_against_all_pairs(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        base = invented(rng, rng.randrange(30, 200), 3000)
        texts.append(base)
        for _ in range(rng.randrange(4)):
            copy = [w if rng.random() > 0.04 else "new" for w in base]
            texts.append(copy)
    passage = invented(rng, 60, 3000)
    texts += [passage + invented(rng, 100, 3000) for _ in range(30)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near_dedup.similar(texts[i], texts[j], 0.8)]
    assert sum(found[i] == found[j] for i, j in pairs) >= 0.97 * len(pairs)
    root = list(range(len(texts)))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert all(root[i] == root[c] for i, c in found.items())
    assert near_dedup.keep_one(docs.withColumn("source", F.lit("x"))).count() == len(set(found.values()))


def test_sketches_reach_the_recall_at_each_length_and_similarity():
    rng, params = random.Random(14), near_dedup.Params()
    for n in (5, 6, 8, 10, 11, 20, 64, 80, 81, 100, 500):
        for similarity in (0.8, 0.85):
            texts, pairs = [], 80
            for _ in range(pairs):
                base = invented(rng, n, 30000)
                copy = list(base)
                for k in sorted(rng.sample(range(n), int((1 - similarity) * n + 1e-9)), reverse=True):
                    copy[k : k + 1] = [[f"new{rng.randrange(10**6)}"], [f"new{rng.randrange(10**6)}"], [], [copy[k], "more"]][rng.randrange(4)]
                texts += [base, copy]
            keys = [k for part in textscan.slices(pa.array([" ".join(t) for t in texts])) for k in near_dedup._sketches(part.words(fold=True), params)]
            meets = [len(np.intersect1d(keys[i], keys[i + 1])) > 0 for i in range(0, 2 * pairs, 2) if near_dedup.similar(texts[i], texts[i + 1], 0.8)]
            assert sum(meets) >= 0.9 * len(meets), (n, similarity, np.mean(meets))


def test_shared_words_of_a_tile_against_counters():
    rng = random.Random(15)
    texts = [invented(rng, rng.randrange(0, 60), 40) for _ in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(t) for t in texts])], names=["_text"])
    words = [np.frombuffer(x, "<u4") for x in next(near_dedup._words(iter([batch]))).column("words").to_pylist()]
    exact = np.array([[sum((Counter(a) & Counter(b)).values()) for b in texts[70:]] for a in texts[:70]])
    for bits, slack in ((32, 0), (8, 60)):  # with labels of 8 bits some meet by chance
        labels = [x >> np.uint64(32 - bits) for x in near_dedup.labelled(words)]
        for dense in (0, 100, 4096):
            near_dedup.DENSE, before = dense, near_dedup.DENSE
            got = near_dedup.shared_words(labels[:70], labels[70:])
            near_dedup.DENSE = before
            assert (got >= exact).all() and (got <= exact + slack).all()


def test_near_dedup_finds_pairs_that_share_only_a_crowds_passage(spark):
    rng = random.Random(11)
    passage = invented(rng, 150, 30000)
    texts = [passage + invented(rng, 60, 30000) for _ in range(240)]
    for i in range(0, 20, 2):  # every fourth word of the tail differs, so the two share no five words of it
        texts[i + 1] = [w if j < 150 or j % 4 else "new" for j, w in enumerate(texts[i])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert found == {i: i - i % 2 if i < 20 else i for i in range(240)}
    small = near_dedup.Params(tile=8)  # many tiles find the same
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs, small).collect()} == found


# ------------------------------------------------------------------ 6 fertility


def test_base_figures_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in fertility.score(docs).collect():
        text = texts[r.doc_id]
        words = WORD.findall(text)
        runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
        )
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_token_figures_against_the_encoder(spark):
    import sentencepiece

    encoder = sentencepiece.SentencePieceProcessor(model_file=fertility.Rules().vocabulary)
    texts = ["the cat and the other cat", "日本語 テキスト です 🙂🙂", "", "aé" * 30]
    rows = fertility.score(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()
    for r in rows:
        ids = [i for w in WORD.findall(texts[r.doc_id]) for i in encoder.encode(w)]
        counts = np.array(list(Counter(ids).values())) / max(1, len(ids))
        assert r.n_tokens == len(ids)
        assert abs(r.token_entropy + (counts * np.log2(counts)).sum()) < 1e-9
        assert abs(r.byte_share - sum(map(encoder.is_byte, ids)) / max(1, len(ids))) < 1e-12


def test_bands_reject_what_tokenises_oddly_and_keep_the_rest(spark):
    rng = random.Random(3)
    common = "time people water house world school story night river music paper light green small great young".split()
    rows = [(i, " ".join(rng.choices(common, k=300)) + f" {i}", "en") for i in range(300)]
    rows += [(1000 + i, " ".join("".join(rng.choices("qxzjkvw0987", k=9)) for _ in range(300)), "en") for i in range(5)]
    kept = {r.doc_id: r.kept for r in fertility.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fertility.Rules(max_repeat_percent=100)).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(5))


def test_bands_reject_most_labelled_bad_documents_and_few_good_ones(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("quality is not null")
    rows = fertility.score(spark.read.parquet(f"{folder}/documents.parquet")).filter("not base_failed").join(labels, "doc_id").collect()
    bad, good = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert bad and sum(bad) <= 0.2 * len(bad)
    assert good and sum(good) >= 0.95 * len(good)


def test_bands_and_verdict_against_plain_loops(spark):
    rng = random.Random(31)
    common = "time people water house world school story night river music paper light green small great young".split()
    rows = []
    for i in range(240):
        pool = common if i % 8 else ["".join(rng.choices("qxzjkvw0987", k=9)) for _ in range(40)]
        rows.append((i, " ".join(rng.choices(pool + [f"n{i}"], k=rng.choice([5, 12, 40, 90, 400]))), ["en", "de", None][i % 3]))
    rules = fertility.Rules(max_repeat_percent=100)
    got = fertility.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rules).collect()
    language = {i: lang or "und" for i, _, lang in rows}
    at = lambda values, share: sorted(values)[max(0, int(np.ceil(share * len(values))) - 1)]
    passed = [r for r in got if r.n_words >= 10]
    length = lambda r: int(np.floor(np.log2(r.n_tokens)))
    wide = lambda r: np.sqrt(1 + 100 / max(r.n_tokens, 1))
    rate, byte, entropy = {}, {}, {}
    for name in set(language.values()):
        mine = [r for r in passed if language[r.doc_id] == name]
        rate[name], byte[name] = at([r.chars_per_token for r in mine], 0.5), at([r.byte_share for r in mine], 0.5)
        for k in {length(r) for r in mine}:
            entropy[name, k] = at([r.token_entropy for r in mine if length(r) == k], 0.5)
    off = {r.doc_id: ((r.chars_per_token - rate[language[r.doc_id]]) / wide(r), (r.token_entropy - entropy[language[r.doc_id], length(r)]) / wide(r)) for r in passed}
    half = lambda values: (at(values, 0.75) - at(values, 0.25)) / 2
    kept = {r.doc_id: False for r in got}
    for r in passed:
        name = language[r.doc_id]
        mine = [off[x.doc_id] for x in passed if language[x.doc_id] == name]
        inside = r.byte_share <= byte[name] + 0.25
        for k, middle in ((0, rate[name]), (1, entropy[name, length(r)])):
            own, every = half([o[k] for o in mine]), half([o[k] for o in off.values()])
            width = 4 * 1.4826 * (own * len(mine) + every * 20) / (len(mine) + 20)
            inside &= abs(off[r.doc_id][k]) <= max(width, 0.04 * middle) * (1 + 1e-9)
        kept[r.doc_id] = bool(inside)
    assert {r.doc_id: r.kept for r in got} == kept and 0 < sum(kept.values()) < len(passed)


# ------------------------------------------------------------------ 7 language


def test_language_accuracy_and_fusion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = docs.filter(F.length("text") > 200).select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x.example.org/"), "doc_id").alias("url"), F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"), "lang")
    rows = language_id.identify(pages, docs, language_id.Params(fit_rows=400)).join(pages.select("page_id", F.col("lang").alias("truth")), "page_id").collect()
    assert np.mean([r.lang == r.truth for r in rows]) > 0.9
    text = {r.lang: r.text for r in docs.filter(F.length("text") > 500).groupBy("lang").agg(F.min("text").alias("text")).collect()}
    empty = [(i, "http://de.example.de/", f"<html lang='de'><article><p>{text['de']}</p></article>") for i in range(30)] + [(99, "http://de.example.de/", "<html lang='de'></html>"), (100, "http://fr.example.fr/", f"<html lang='fr'><article>{text['fr']}</article>")]
    got = {r.page_id: r.lang for r in language_id.identify(spark.createDataFrame(empty, "page_id long, url string, html string"), docs).collect()}
    assert got[99] == "de" and got[100] == "fr"


def test_fusion_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    params = language_id.Params(fit_rows=100)
    languages, model = language_id.train(docs, params)
    texts = [r.text for r in docs.filter(F.length("text") > 60).select("text").orderBy("doc_id").limit(40).collect()]
    rng = random.Random(16)
    rows = []
    for i in range(120):
        host = rng.choice(["a.site.de", "b.site.de", "www.x.fr", "y.org", "lone.example.es"])
        declared = rng.choice(["de", "fr", "en", "", "xx"])
        body = rng.choice(["", rng.choice(texts)[: rng.randrange(4, 200)]])
        rows.append((i, f"http://{host}/{i}" if i % 17 else None, f"<html{f' lang={declared!r}' if declared else ''}><article>{body}</article></html>"))
    rows += [(500, None, None), (501, rows[1][1], rows[1][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in language_id.identify(pages, docs, params).collect()}

    hosts = {r.page_id: r.host for r in pages.select("page_id", main_text.host().alias("host")).collect()}
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.string()), pa.array([hosts[r[0]] for r in rows])], names=["page_id", "url", "html", "host"])
    seen = next(language_id._evidence(model, params)(iter([batch]))).to_pylist()
    n, k = len(languages), params.strength
    add = lambda key: {v: np.sum([r["post"] for r in seen if key(r) == v], axis=0) for v in {key(r) for r in seen}}
    domain = lambda host: ".".join(host.split(".")[-2:])
    suffix = lambda host: host.split(".")[-1]
    every = np.sum([r["post"] for r in seen], axis=0)
    by_host, by_domain, by_suffix, said = add(lambda r: r["host"]), add(lambda r: domain(r["host"])), add(lambda r: suffix(r["host"])), add(lambda r: r["declared"])
    smooth = lambda counts, prior, strength: (counts + strength * prior) / (counts.sum() + strength)
    for r in seen:
        prior = smooth(every, np.full(n, 1 / n), 1)
        for counts in (by_suffix[suffix(r["host"])], by_domain[domain(r["host"])], np.maximum(by_host[r["host"]] - r["post"], 0)):
            prior = smooth(counts, prior, k)
        total = np.array(r["weight"]) + np.log(prior) + np.log((said[r["declared"]] + 1) / (every + len(said)))
        share = np.exp(total - total.max())
        out = got[r["page_id"]]
        assert out.lang == languages[int(total.argmax())] and abs(out.confidence - share.max() / share.sum()) < 1e-6
    assert any(r.lang != r.text_lang for r in got.values())  # the other evidence decides some


# ------------------------------------------------------------------ 8 sharding


def test_hypergeometric_law(spark):
    rows = spark.range(4000).select(sharding.hypergeometric(F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 4000).alias("k"))
    got = Counter(r.k for r in rows.collect())
    from math import comb

    for k in range(11):
        assert abs(got[k] / 4000 - comb(20, k) * comb(30, 10 - k) / comb(50, 10)) < 1e-3


def test_matrix_has_its_sums(spark):
    sizes = [(i, n) for i, n in enumerate([10, 0, 300, 7, 55, 1, 999]) if n]
    params = sharding.Params(shards=5)
    rows = sharding.matrix(spark.createDataFrame(sizes, "part long, n long"), 7, 1372, params).collect()
    assert {r.part: sum(r.counts) for r in rows} == dict(sizes)
    assert [sum(r.counts[s] for r in rows) for s in range(5)] == [275, 275, 274, 274, 274]
    assert all(c >= 0 for r in rows for c in r.counts)


def test_shards_are_exact_gapless_and_uniform(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    totals = np.zeros((3, 5))
    for seed in range(5):
        rows = sharding.shard(docs, sharding.Params(shards=5, rows_a_part=200, seed=seed)).collect()
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
            totals[r.doc_id // 1000, r.shard] += 1
        assert all(sorted(x) == list(range(600)) for x in slots.values()) and len(slots) == 5
    assert abs(totals / 5 - 200).max() < 30


# ------------------------------------------------------------------ 9 main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><header>Site</header><nav><ul><li>One<li>Two</ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside>%s<section class="comments"><article><p>First!</p></article></section>
<form><p>Name <input></p></form><div class="ad">Buy</div><footer>&copy; us</footer><script>var x = "<article><p>no</p></article>";</script></body></html>"""


def test_main_text_of_pages(spark):
    bodies = ["<article><h1>Head &amp; tail</h1><p>A&nbsp;b<b>old</b>\n c<br>d<p>Next &lt;p&gt;<div class='share'>Share</div></article>", "<div id='main-content'><p>In a div</p></div>", "<p>Bare</p>"]
    pages = spark.createDataFrame([(i, f"http://h{i}.example.org/", PAGE % b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.extract(pages).collect()}
    assert got == {0: "Head & tail A bold c d Next <p>", 1: "In a div", 2: "Bare"}


def test_a_page_ruled_out_whole_by_a_class_is_read_without_classes():
    assert main_text.main_text('<div class="with-sidebar"><aside>x</aside><article>Text</article></div>') == "Text"
    assert main_text.main_text('<div class="ad">Buy</div><p>Text</p>') == "Text"


def expression(nodes):
    """A wrapper as a regular expression over a page's tags and text checksums."""
    out = ""
    for n in nodes:
        text = not isinstance(n[0], str)
        body = f"#{n[0] or '[0-9]+'};" if text else expression(n[1]) if n[0] == "+" else f"<{re.escape(n[0])}>{expression(n[1])}</>"
        out += f"(?:{body}){['', '?', '+', '*'][n[1 if text else 2]]}"
    return out


def invented_page(rng, depth=3):
    """(html, the same as tags and text checksums)."""
    page = tokens = ""
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(["div", "section", "p", "p", "h2", "li"] if depth else ["p", "h2"])
        if tag in ("div", "section"):
            inner, inside = invented_page(rng, depth - 1)
        else:
            inner = rng.choice(["one", "two", "three", "four"])
            inside = f"#{zlib.crc32(inner.encode())};"
        page, tokens = f"{page}<{tag}>{inner}</{tag}>", f"{tokens}<{tag}>{inside}</>"
    return page, tokens


def test_wrappers_match_every_page_they_cover():
    rng = random.Random(17)
    for _ in range(120):
        wrapper, seen = [], []
        for i in range(5):
            page, tokens = invented_page(rng)
            found = main_text.read(page)
            stream = main_text._marked(found.stream, found.mark)
            wrapper = main_text.aligned(wrapper, stream) if i else stream
            seen.append(tokens)
            assert all(re.fullmatch(expression(wrapper), x) for x in seen)
    assert not re.fullmatch(expression(main_text.read("<div><p>one</p></div>").stream), "<div><p>#7;</></>")


def test_repeated_and_optional_groups_and_slots():
    wrapper = lambda *pages: expression(__import__("functools").reduce(main_text.aligned, (main_text.read(x).stream for x in pages)))
    text = lambda t: f"(?:#{zlib.crc32(t.encode())};)"
    slot = "(?:#[0-9]+;)"
    assert wrapper("<p>a</p><p>b</p><p>c</p>") == f"(?:<p>{slot}</>)+"
    assert wrapper("<dt>a</dt><dd>b</dd><dt>a</dt><dd>c</dd>") == f"(?:(?:<dt>{text('a')}</>)(?:<dd>{slot}</>))+"
    assert wrapper("<h2>a</h2><p>b</p>", "<h2>a</h2><ul><li>x</li></ul><p>c</p>") == f"(?:<h2>{text('a')}</>)(?:<ul>(?:<li>{text('x')}</>)</>)?(?:<p>{slot}</>)"


HOST = """<html><body><nav><a href='/'>Home</a></nav><article class="teaser"><h2>Stories</h2><p>Read what the others read this week, it is good.</p></article>
<div class="c7"><h1>%s</h1><div class="x1"><p>%s</p><p>All of our texts may be printed with our name.</p></div></div><div class="z">%s</div></body></html>"""


def test_the_wrapper_and_not_a_container_name_says_what_the_article_is(spark):
    rng = random.Random(23)
    say = lambda n: " ".join(invented(rng, n))
    rows = [(f"Head {i % 3}", "</p><p>".join(say(40) for _ in range(1 + i % 3)), "Join us" if i % 2 else "Write us") for i in range(8)]
    pages = [(i, "http://own.example.org/", HOST % r) for i, r in enumerate(rows)]
    lone = [(100, "http://lone.example.org/", HOST % rows[0])]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(pages + lone, "page_id long, url string, html string")).collect()}
    notice = "All of our texts may be printed with our name."
    for i, (head, body, _) in enumerate(rows):
        words = " ".join([head, body.replace("</p><p>", " ")])
        assert got[i] in (words, f"{words} {notice}"), got[i]
    assert got[100].startswith("Stories Read what")  # one page tells nothing, so the container's name decides


def test_text_fixed_on_all_pages_of_a_host_is_left_out_of_the_article(spark):
    rng = random.Random(29)
    bodies = [" ".join(invented(rng, 50)) for _ in range(6)]
    pages = [(i, "http://own.example.org/", f"<body><div class='q'><h1>News</h1><blockquote>Share this with all your friends</blockquote><p>{b}</p></div></body>") for i, b in enumerate(bodies)]
    pages += [(10 + i, "http://same.example.org/", pages[0][2]) for i in range(4)]  # equal pages teach no fixed text
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"News {b}" for i, b in enumerate(bodies))
    assert all(got[10 + i] == f"News Share this with all your friends {bodies[0]}" for i in range(4))


def test_hosts_with_many_wrappers_get_one(spark):
    rng = random.Random(9)
    pages = [(i, "http://big.example.org/", "<article>" + "".join(rng.choice(["<p>x</p>", "<h2>y</h2>", "<ul><li>z</li></ul>"]) for _ in range(1 + rng.randrange(9))) + "</article>") for i in range(150)]
    rows = main_text.wrappers(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(40), main_text.Params(chunk=8)).collect()
    assert len(rows) == 1
    pattern = expression(json.loads(rows[0].wrapper))
    deep = "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000
    assert main_text.main_text(deep) == "deep" and re.match(r"\(\?:<article>", pattern)


# ------------------------------------------------------------------ 10 chat


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<|\\>turnbodyend \n é🙂", max_size=60))
def test_escape_is_reversible_and_hides_control_strings(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL.values())


def test_formatted_tokens_read_back(spark):
    turns = [(1, 2, "assistant", "B <|end|> <\\|turn|>"), (1, 1, "user", "A"), (1, 0, "system", ""), (2, 0, "assistant", "x"), (2, 1, "assistant", "y")]
    out = chat.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "turn_no").collect()
    ids = [i for r in out if r.conv_id == 1 for i in r.ids]
    assert chat.rendered(ids) == "<|turn|>system<|body|><|end|><|turn|>user<|body|>A<|end|><|turn|>assistant<|body|>B <\\|end|> <\\\\|turn|><|end|>"
    at = 0
    for r in out:
        at = 0 if r.turn_no == 0 else at
        assert r.first_token == at
        at += len(r.ids)
    loss = [chat.unescape(chat.encoding(chat.VOCABULARY).decode(r.ids[r.loss_from - r.first_token : r.loss_to - r.first_token])) for r in out]
    assert loss == ["", "", "B <|end|> <\\|turn|>", "x", "y"]
