"""Near-duplicate detection by Order MinHash, verified by banded alignment.

Every distinct text gets sketches. A sketch samples the smallest of its k-mers, each labelled with its occurrence
number, under one random order, and keeps them in the order of the text, so it answers to edit similarity rather than
to set overlap. Texts that share a sketch are candidates; a candidate is a link if the word edit distance, found by a
banded alignment, is at most ``1 - similarity`` of the longer text. Classes are the connected components of the links.

With edits spread evenly, two texts of similarity 0.8 share a third of their five-word k-mers, so their Jaccard
coefficient J is 0.2; a sketch of two meets with J squared, one of a single k-mer with J. ``pairs`` tables of two and
``singles`` of one miss (1 - 0.04) ** 20 x (1 - 0.2) ** 12 = 0.03 of such pairs. Short texts have too few five-word
k-mers for that, so texts up to ``short`` words are searched by two-word k-mers, ``short_pairs`` tables of two. Up to ten
words the similarity allows one edit, which keys of the words with each one left out find for certain; longer texts
have the other sketches, and texts on both sides of a limit those of both sides.

Exact copies meet first, as one text. Candidates are then taken in three steps:

1. each text against the one hub that it shares most tables with; a bucket's hub is its text with most
   company in all its buckets, so many near copies meet the one in their middle,
2. each text against the hubs of all its buckets, where the two have no class in common yet,
3. all pairs of different classes in a bucket. They are listed while they are a few for each member. A crowd that
   shares a long passage has more; its texts are dealt into tiles, in which the words that two texts share are counted for
   all pairs at once, and the pairs that this allows are aligned, unless links that the tile has found connect their classes.
   Nothing else is left out, so the time for a crowd grows with its square. Only links leave a tile, fewer than it has classes.

Null and empty texts are copies of each other, and so are texts without a word that are equal. Very long texts are
sketched and aligned whole; an alignment takes time by the edits it allows. Repeated rows are copies. Of texts tied for a
hub the one with the greater number is taken, which changes no class. Null doc_ids are kept and stand last. An empty table gives an
empty result. Extra columns, whatever their names, are kept by ``keep_one``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import cut, fresh, in_arrow, packed, release, stored
from lantern.llm.textscan import mix, runs, slices


@dataclass(frozen=True)
class Params:
    words: int = 5
    similarity: float = 0.8
    #: tables of two k-mers and of one
    pairs: int = 20
    singles: int = 12
    #: texts up to so many words are searched by two-word k-mers, in so many tables of two
    short: int = 80
    short_pairs: int = 24
    #: a bucket is searched pair by pair while it has at most so many pairs of different classes for each member
    pairs_a_member: int = 16
    #: texts and words in each side of a tile of a more crowded bucket
    tile: int = 1024
    tile_words: int = 1 << 19
    #: bins of a text's word counts, which bound the edit distance from below
    bins: int = 256

    @property
    def one_edit(self) -> int:
        """Words of the texts that are searched by leaving out one: the most that allow one edit, and one more."""
        return max(n for n in range(1, 1000) if int((1 - self.similarity) * n + 1e-9) <= 1) + 1


def _minima(words, chosen: np.ndarray, k: int, tables: list[int], salt: int) -> np.ndarray:
    """Keys [text, table] of the chosen texts, which have k words or more; a table samples that many k-mers."""
    at, gram = words.grams(k)
    stay = chosen[words.doc[at]]
    at, gram = at[stay], gram[stay]
    doc = words.doc[at]
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros((len(start), len(tables)), np.uint64)
    if not len(at):
        return out
    _, which, _ = runs(doc, gram)
    label = mix(gram + mix(which.astype(np.uint64)))
    size = np.diff(np.append(start, len(doc)))

    def smallest(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least value of each text, and its place."""
        least = np.minimum.reduceat(value, start)
        place = np.flatnonzero(value == np.repeat(least, size))
        if len(place) != len(start):  # equal values: the first
            place = place[np.unique(np.searchsorted(start, place, "right"), return_index=True)[1]]
        return least, place

    for table, sampled in enumerate(tables):
        value = label * np.uint64((2 * (salt + table) + 1) * 0xA0761D6478BD642F % (1 << 64) | 1)  # labels are mixed already
        least, first = smallest(value)
        key = np.full(len(start), np.uint64(salt + table + 1)) + (least if sampled == 1 else np.uint64(0))
        if sampled > 1:
            value[first] = np.uint64(0xFFFFFFFFFFFFFFFF)
            _, second = smallest(value)  # of a text of one k-mer, that one again
            key = mix(key + label[np.minimum(first, second)]) * np.uint64(0xD6E8FEB86659FD93) + label[np.maximum(first, second)]
        out[:, table] = mix(key) | np.uint64(1)
    return out


def _left_out(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of n words, and their keys: of all words, and of the words with each one left out."""
    docs = np.flatnonzero(words.counts == n)
    each = words.hash[words.bounds[:-1][docs][:, None] + np.arange(n)]
    keys = []
    for out in range(-1, n):
        key = np.full(len(docs), np.uint64(n - (out >= 0)))
        for i in range(n):
            if i != out:
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + each[:, i])
        keys.append(key | np.uint64(1))
    return docs, np.stack(keys, axis=1)


def _sketches(words, params: Params) -> list[np.ndarray]:
    """The keys of each text; none for texts without a word."""
    found: list[list[np.ndarray]] = [[] for _ in words.counts]
    long = words.counts >= min(params.short, int(params.similarity * (params.short + 1)))
    brief = (words.counts > 1) & (words.counts <= params.short)
    kinds = [(long & (words.counts >= params.words), params.words, [2] * params.pairs + [1] * params.singles, 0), (brief, 2, [2] * params.short_pairs, 1000)]
    for chosen, k, tables, salt in kinds:
        for i, keys in zip(np.flatnonzero(chosen), _minima(words, chosen, k, tables, salt), strict=True):
            found[i].append(keys)
    for n in range(1, params.one_edit + 1):
        for i, keys in zip(*_left_out(words, n), strict=True):
            found[i].append(keys)
    return [x[0] if len(x) == 1 else np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in found]


def _bags(words, bins: int) -> np.ndarray:
    """Words of each text by bin of their hash, as 16-bit counts; the highest stands for as many or more."""
    cell = words.doc * bins + (words.hash >> np.uint64(40)).astype(np.int64) % bins
    return np.minimum(np.bincount(cell, minlength=len(words.counts) * bins), 65535).astype("<u2").reshape(-1, bins)


def _scan(params: Params):
    """Replaces the text, the last column, by its word count, sketches and bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, bags = [], [], []
            for part in slices(batch.columns[-1]):
                words = part.words(fold=True)
                keys += [k.view(np.int64) if len(k) else None for k in _sketches(words, params)]
                counts.append(words.counts)
                bags += [b.tobytes() for b in _bags(words, params.bins)]
            arrays = [*batch.columns[:-1], pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "_words", "_keys", "_bag"])

    return run


def digest(text: str = "text") -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)), 1, 16)


#: Edits up to which a band is walked diagonal by diagonal; a wider one is kept as bits.
NARROW = 24


def edit_distance(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return max(len(a), len(b)) if max(len(a), len(b)) <= most else None
    unmatched = max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values())
    if unmatched > most:  # each edit can bring one more pair of equal words
        return None
    if unmatched <= NARROW:
        found = _on_diagonals(a, b, min(most, NARROW))
        if found is not None or most <= NARROW:
            return found
    found = _by_bits(a, b)
    return found if found <= most else None


def _on_diagonals(a: list, b: list, most: int) -> int | None:
    """The distance, by furthest reach on diagonals -most to most."""
    n, m = len(a), len(b)
    if abs(m - n) > most:
        return None
    goal, reach = m - n, {0: 0}
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    reach[0] = i
    for d in range(most + 1):
        if reach.get(goal, -1) >= n:
            return d
        after = {}
        for k in range(-d - 1, d + 2):
            if abs(goal - k) > most - d - 1 and k != goal:
                continue
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            if i < 0 or i + k < 0:
                continue
            i = min(i, n, m - k)
            if i < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            after[k] = i
        reach = after
    return None


def _by_bits(a: list, b: list) -> int:
    """The distance; the differences down a column of the alignment are the bits of two numbers."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, last, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    rise, fall = full, 0
    for x in b:
        equal = at.get(x, 0)
        down = equal | fall
        across = (((equal & rise) + rise) ^ rise) | equal
        more, less = fall | (full & ~(across | rise)), rise & across
        distance += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        rise, fall = (less | ~(down | more)) & full, more & down & full
    return distance


def similar(a: list, b: list, least: float) -> bool:
    longer = max(len(a), len(b))
    return longer > 0 and edit_distance(a, b, int((1 - least) * longer + 1e-9)) is not None


def _verified(params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 128) for i in range(0, whole.num_rows, 128)):
                sides = []
                for name in ("_a", "_b"):
                    lists = []
                    for part in slices(batch.column(batch.schema.get_field_index(name))):
                        words = part.words(fold=True)
                        lists += [words.hash[x:y].tolist() for x, y in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
                    sides.append(lists)
                yes = pa.array([similar(a, b, params.similarity) for a, b in zip(*sides, strict=True)], pa.bool_())
                yield batch.select(["u", "v"]).filter(yes)

    return run


def _possible(params: Params):
    """Keeps pairs whose bags allow the similarity: of the longer text, all words but the allowed edits are shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), "<u2").reshape(-1, params.bins) for n in ("_ba", "_bb"))
                longer = np.maximum(batch.column("_na").to_numpy(), batch.column("_nb").to_numpy())
                shared = np.minimum(a, b).sum(axis=1, dtype=np.int64)
                clipped = (a == 65535).any(axis=1) | (b == 65535).any(axis=1)
                yield batch.select(["u", "v"]).filter(pa.array(clipped | (shared >= params.similarity * longer - 1e-9)))

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text, the last column, by 32 bits of each word."""
    for batch in batches:
        rows = []
        for part in slices(batch.columns[-1]):
            words = part.words(fold=True)
            short = (words.hash >> np.uint64(32)).astype("<u4")
            rows += [short[a:b].tobytes() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.binary())], names=[*batch.schema.names[:-1], "words"])


def labelled(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The words of each text with their occurrence, as 32 bits."""
    size = np.array([len(x) for x in texts])
    flat = np.concatenate(texts).astype(np.uint64)
    _, which, _ = runs(np.repeat(np.arange(len(texts)), size), mix(flat))
    return np.split(mix(mix(flat) + mix(which.astype(np.uint64))) >> np.uint64(32), np.cumsum(size)[:-1])


#: Of a word that more pairs of a tile share, the pairs are counted by a product of matrices.
DENSE = 4096


def shared_words(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """At least as many words as text i of a and text j of b share, by their labels, for all i and j.

    Labels that a text has twice, by chance, are counted once and made up for.
    """
    twice = []

    def places(side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        both = np.unique((np.concatenate(side).astype(np.int64) << 20) | row)
        twice.append(np.array([len(x) for x in side]) - np.bincount(both & ((1 << 20) - 1), minlength=len(side)))
        return both >> 20, both & ((1 << 20) - 1)

    (la, ra), (lb, rb) = places(a), places(b)
    common = np.intersect1d(la, lb)
    left = [np.searchsorted(x, common, side) for x in (la, lb) for side in ("left", "right")]
    na, nb = left[1] - left[0], left[3] - left[2]
    out = np.zeros((len(a), len(b)), np.float32)
    dense = na * nb > DENSE
    for at in np.array_split(np.flatnonzero(dense), -(-int(dense.sum()) // 2048) or 1):
        if len(at):
            sides = []
            for rows, first, size, n in ((ra, left[0], na, len(a)), (rb, left[2], nb, len(b))):
                has = np.zeros((n, len(at)), np.float32)
                column = np.repeat(np.arange(len(at)), size[at])
                has[rows[np.repeat(first[at], size[at]) + np.arange(int(size[at].sum())) - np.repeat(np.cumsum(size[at]) - size[at], size[at])], column] = 1
                sides.append(has)
            out += sides[0] @ sides[1].T
    at = np.flatnonzero(~dense)
    for some in np.array_split(at, -(-int((na[at] * nb[at]).sum()) // (1 << 22)) or 1):
        times = na[some] * nb[some]
        k = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        i = ra[np.repeat(left[0][some], times) + k // np.repeat(nb[some], times)]
        j = rb[np.repeat(left[2][some], times) + k % np.repeat(nb[some], times)]
        out += np.bincount(i * len(b) + j, minlength=out.size).reshape(out.shape)
    return out + np.minimum(twice[0][:, None], twice[1])


def _tile_links(params: Params):
    """Links (u, v) that connect the classes of a tile.

    Pairs of different classes whose words allow the similarity are aligned, those that share most first, unless
    links found before connect their classes, or their first common bucket is another one, where they are compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, column in zip(batch.column("key").to_pylist(), batch.column("texts"), strict=True):
                part = column.values
                tid, root, second = (part.field(f).to_numpy(zero_copy_only=False) for f in ("tid", "root", "second"))
                keys = [np.array(k, np.int64) for k in part.field("_keys").to_pylist()]
                texts = [np.frombuffer(x, "<u4") for x in part.field("words").to_pylist()]
                a = np.flatnonzero(~second)
                b = np.flatnonzero(second) if second.any() else a  # a tile of one block meets itself
                labels, size = labelled(texts), np.array([len(x) for x in texts])
                longer = np.maximum(size[a][:, None], size[b])
                shared = shared_words([labels[i] for i in a], [labels[i] for i in b])
                near = (shared >= params.similarity * longer - 1e-3) & (root[a][:, None] != root[b])
                if b is a:
                    near &= tid[a][:, None] > tid[b]
                i, j = np.nonzero(near)
                order = np.argsort(-(shared[i, j] / longer[i, j]), kind="stable")
                head: dict[int, int] = {}

                def find(x: int, head: dict[int, int] = head) -> int:
                    while x in head:
                        x = head[x]
                    return x

                for x, y in zip(a[i[order]].tolist(), b[j[order]].tolist(), strict=True):
                    p, q = find(int(root[x])), find(int(root[y]))
                    if p != q and np.intersect1d(keys[x], keys[y]).min() == key and similar(texts[x].tolist(), texts[y].tolist(), params.similarity):
                        head[max(p, q)] = min(p, q)
                        out.append((int(max(tid[x], tid[y])), int(min(tid[x], tid[y]))))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _tiled(crowded: DataFrame, bags: DataFrame, bodies: DataFrame, keys: DataFrame, params: Params) -> DataFrame:
    """Links (u, v) that connect all classes of the crowded buckets (columns key, tid, root, main) between which there is one.

    A bucket that fits is one tile. The texts of a larger one are dealt into blocks, and every two blocks are a tile. Blocks hold texts
    of one class of lengths, so only blocks of the same and of neighbouring classes meet; the texts of a bucket's largest
    class of near copies have blocks of their own, which do not meet each other. Tiles are made up of narrow rows; the words come to them once.
    """
    length = F.floor(F.log(F.greatest("_words", F.lit(1))) / F.log(F.lit(1 / params.similarity)) + 1e-9)
    rows = cut(crowded.join(bags.select("tid", "_words"), "tid").select("key", "tid", "root", "_words", (F.col("root") == F.col("main")).alias("main"), length.alias("size")))
    fill = F.greatest(F.count(F.lit(1)) / params.tile, F.sum("_words") / params.tile_words)
    whole = rows.groupBy("key").agg(fill.alias("fill"))
    rows = rows.join(whole, "key").withColumn("main", (F.col("fill") > 1) & F.col("main")).withColumn("size", F.when(F.col("fill") > 1, F.col("size")).otherwise(0))
    cell = ["key", "main", "size"]
    counts = rows.groupBy(*cell).agg(F.ceil(fill).alias("blocks"))
    rows = rows.join(counts, cell).withColumn("p", F.struct("main", "size", F.pmod(F.xxhash64("tid"), F.col("blocks")).alias("block"))).select("key", "tid", "root", "_words", "p")
    blocks = counts.select("key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.struct("main", "size", i.alias("block")))).alias("q"))
    meets = ~(F.col("p.main") & F.col("q.main")) & (F.abs(F.col("p.size") - F.col("q.size")) <= 1)
    dealt = rows.join(blocks, "key").filter(meets).select("key", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), (F.col("p") > F.col("q")).alias("second"), "tid", "root", "_words")
    some = bodies.join(crowded.select("tid").distinct(), "tid").join(keys, "tid").select("tid", "_keys", "_text")
    words = stored(in_arrow(some, _words, "tid long, _keys array<long>, words binary"))
    text = F.struct("tid", "root", "second", "_keys", "words")
    tiles = dealt.select("key", "x", "y", "second", "tid", "root").join(words, "tid").groupBy("key", "x", "y").agg(F.collect_list(text).alias("texts"))
    return in_arrow(tiles.select("key", "texts"), _tile_links(params), "u long, v long").distinct()


def _links(pairs: DataFrame, texts: DataFrame, bags: DataFrame, params: Params) -> DataFrame:
    """The pairs (u, v) whose texts are similar."""
    first = pairs.join(bags.select(F.col("tid").alias("u"), F.col("_bag").alias("_ba"), F.col("_words").alias("_na")), "u")
    both = first.join(bags.select(F.col("tid").alias("v"), F.col("_bag").alias("_bb"), F.col("_words").alias("_nb")), "v")
    longer, shorter = F.greatest("_na", "_nb"), F.least("_na", "_nb")
    return _aligned(in_arrow(both.filter(shorter >= params.similarity * longer - 1e-9), _possible(params), "u long, v long"), texts, params)


def _aligned(likely: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    with_a = likely.join(texts.select(F.col("tid").alias("u"), F.col("_text").alias("_a")), "u")
    with_both = with_a.join(texts.select(F.col("tid").alias("v"), F.col("_text").alias("_b")), "v")
    return in_arrow(with_both.select("u", "v", "_a", "_b"), _verified(params), "u long, v long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) from each node to the least one that the edges of a task connect it to."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not held:
        return
    nodes, places = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    a, b = places.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], names=["u", "v"])


#: Edges that a task connects on its own.
EDGES_A_TASK = 500_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v) of longs: columns node, root (the least node).

    Tasks connect up to ``EDGES_A_TASK`` edges each, which leaves stars. Where there is more than one task, alternating large-star
    and small-star steps go on from there: each works on edges and grouped minima only, so a hub is never gathered in one row. Rounds
    grow with the logarithm of a component's diameter.
    """
    ordered = cut(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u > v").distinct())
    tasks = max(1, -(-ordered.count() // EDGES_A_TASK))
    dealt = ordered.coalesce(tasks) if ordered.rdd.getNumPartitions() >= tasks else ordered.repartition(tasks)
    now = cut(in_arrow(dealt, _stars, "u long, v long"))
    mark = None
    while tasks > 1:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        now = cut(joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u > v").distinct())
        del both, least, large, low, joined
        release(now.sparkSession)
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    return cut(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _crossing(members: DataFrame, allowance: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of different classes inside buckets (columns key, tid, root), and the members of the buckets that have too many."""
    classes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    buckets = classes.groupBy("key").agg(F.sum("n").alias("size"), F.sum(F.col("n").cast("double") * F.col("n")).alias("square"), F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    buckets = buckets.withColumn("few", (F.col("size").cast("double") * F.col("size") - F.col("square")) / 2 <= allowance * F.col("size")).select("key", "few", F.col("top.root").alias("main"))
    rows = members.join(buckets, "key")
    a = rows.filter("few").filter("root != main").select("key", F.col("tid").alias("a"), F.col("root").alias("ra"))
    b = rows.filter("few").select("key", F.col("tid").alias("b"), F.col("root").alias("rb"), "main")
    pairs = a.join(b, "key").filter("ra != rb and (rb = main or a < b)").select(*_ordered("a", "b")).distinct()
    return pairs, rows.filter("not few").select("key", "tid", "root", "main")


def text_classes(docs: DataFrame, params: Params = Params(), text: str = "text") -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(rows, classes): doc_id and _digest of each row; _digest, root and n_links of each text that has links."""
    narrow = docs.select("doc_id", digest(text).alias("_digest"), F.col(f"`{text}`").alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(in_arrow(narrow, _scan(params), f"doc_id {kind}, _digest binary, _words long, _keys array<long>, _bag binary"))
    texts = rows.filter("_keys is not null").groupBy("_digest").agg(F.first("_keys").alias("_keys"), F.min("doc_id").alias("doc_id"), F.first("_words").alias("_words"))
    texts = stored(texts)
    size = texts.count()

    def keep(df: DataFrame, each: int = 1) -> DataFrame:
        return cut(packed(df, size * each))

    texts = keep(texts.withColumn("tid", F.monotonically_increasing_id()))  # written twice, so that the numbers stay
    members = texts.select("tid", F.explode("_keys").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keep(members.join(shared, "key"), 8)
    # a bucket's hub is its text with most company in all its buckets: of many near copies, the one in their middle
    company = members.groupBy("tid").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "tid").groupBy("key").agg(F.max_by("tid", F.struct("company", "tid")).alias("hub"))
    members = keep(members.join(hubs, "key").select("key", "tid", "hub"), 8)

    # the text of one row for each text that shares a bucket
    wanted = keep(texts.join(company.select("tid"), "tid").select("tid", "_digest", F.col("doc_id").alias("_id")))
    source = narrow.join(wanted, "_digest").filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    bodies = stored(source.dropDuplicates(["_digest"]).select("tid", "_text"))  # dealt by digest already
    bags = stored(rows.select("_digest", "_words", "_bag").join(wanted, "_digest").dropDuplicates(["_digest"]).select("tid", "_words", "_bag"))

    star = members.filter("tid != hub").groupBy("tid", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = keep(star.groupBy("tid").agg(F.max(F.struct("n", "hub")).alias("x")).select(*_ordered("tid", "x.hub")).distinct())
    del shared, company, hubs, wanted, source, star
    release(docs.sparkSession)
    links = [keep(_links(best, bodies, bags, params))]
    roots = components(reduce(DataFrame.unionByName, links))

    placed = keep(_rooted(members, roots).select("key", "tid", "hub", "root"), 8)
    hub = placed.filter("tid = hub").select("key", F.col("root").alias("hub_root"))
    rest = placed.join(hub, "key").filter("root != hub_root").select(*_ordered("tid", "hub")).distinct().join(best, ["u", "v"], "left_anti")
    rest = keep(rest)
    tried = best.unionByName(rest)
    links.append(keep(_links(rest, bodies, bags, params)))
    roots = components(reduce(DataFrame.unionByName, links))

    del placed, hub, best, rest
    release(docs.sparkSession)
    placed = keep(_rooted(members.select("key", "tid"), roots), 8)
    pairs, crowded = _crossing(placed, params.pairs_a_member)
    crowded = keep(crowded, 8)
    pairs = keep(pairs.join(tried, ["u", "v"], "left_anti"))
    tried = tried.unionByName(pairs)
    links.append(keep(_links(pairs, bodies, bags, params)))
    del placed, pairs
    release(docs.sparkSession)
    if crowded.limit(1).count():
        roots = components(reduce(DataFrame.unionByName, links))
        main = roots.select(F.col("node").alias("main"), F.col("root").alias("_main"))
        crowded = _rooted(crowded.drop("root"), roots).join(main, "main", "left").withColumn("main", F.coalesce("_main", "main")).drop("_main")
        links.append(keep(_aligned(keep(_tiled(crowded, bags, bodies, texts.select("tid", "_keys"), params)), bodies, params)))  # by whole words once more
    every = keep(reduce(DataFrame.unionByName, links).distinct())
    roots = components(every)
    degree = every.select("u").unionByName(every.select(F.col("v").alias("u"))).groupBy("u").agg(F.count(F.lit(1)).alias("n_links"))
    named = roots.join(degree, F.col("node") == F.col("u")).select(F.col("node").alias("tid"), "root", "n_links")
    return rows.select("doc_id", "_digest"), cut(named.join(texts.select("tid", "_digest"), "tid").select("_digest", "root", "n_links"))


def classes(docs: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """One row a document: doc_id, class_id (the least doc_id of its class), n_links (links of its text to
    other texts that were found; texts of one class are not all compared, so it is a lower bound), copies (rows with
    its very text), kept (one row of each class)."""
    rows, found = text_classes(docs, params)
    texts = rows.groupBy("_digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    texts = texts.join(found, "_digest", "left").withColumn("class", F.coalesce(F.col("root").cast("string").cast("binary"), "_digest"))
    heads = texts.groupBy("class").agg(F.min("least").alias("class_id"))
    texts = texts.join(heads, "class").select("_digest", "class_id", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.join(texts, "_digest").select("doc_id", "class_id", "n_links", "copies", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """One document of each class, with its own columns: the row with the least doc_id."""
    rows, found = text_classes(docs, params)
    texts = rows.groupBy("_digest").agg(F.min("doc_id").alias("least")).join(found.select("_digest", "root"), "_digest", "left")
    heads = texts.groupBy(F.coalesce(F.col("root").cast("string").cast("binary"), "_digest").alias("class")).agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "_digest")).alias("x"))
    heads = heads.select(F.col("x._digest").alias("_d"), F.col("x.least").alias("_id"))
    name, = fresh(docs, "_digest")
    kept = docs.withColumn(name, digest()).join(heads, (F.col(name) == F.col("_d")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    repeated = rows.groupBy("_digest", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if repeated:  # rows repeated whole: one of them
        kept = kept.dropDuplicates(["_d"])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
