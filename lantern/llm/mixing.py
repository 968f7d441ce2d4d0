"""Mixing sources to target weights by pivotal dependent rounding. Native: DataFrame functions only.

A document of source s is wanted f = target / size-of-source times. floor(f) copies are sure; the rest is
a copy probability. A document with a fractional probability is paired with the pool of the documents after it, and
probability mass in words (size x probability) goes at random from one to the other until one of them is 0 or 1, such
that every probability keeps its expectation and the words of the pair stay the same. The pool shares what it gains or loses
alike. Documents come in order of falling size, so a large one is settled while many smaller ones can make up for it, and
the one left at the end is the smallest; a source's taken words miss its target by no more than that one, unless
one document outweighs the rest.

The pairs form a tree. Documents of a source are dealt by hash into leaves of about ``leaf`` rows, ``fan`` leaves into
a node, and so on up to one node for each source. A document that weighs too much for its leaf's pool waits in the
first node above whose pool can make up for it. Nodes are settled from the top: each settles the documents that wait there
against all that is below it and hands the probability on. Leaves settle their own documents, and leave one
undecided at most; those meet pair by pair on the way up. A source that holds most rows just has more leaves. Random
numbers are hashes, so reruns agree however rows are partitioned.

Null text: size 0. Null source: a source of its own, last in order. Documents of size 0 carry no mass and
are decided by a coin each. Rows equal in id, source and size are numbered and each decided. Equal sizes come in the order
of a hash. A source without words has target 0. Very long texts are counted whole. An empty table gives no rows.
``mixed`` needs doc_id, source and text, and keeps these and all other columns; rows equal in all columns stand for one another.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.common import WORD, cut, fresh, numbered, one_of_each, row_key, small, unit


@dataclass(frozen=True)
class Params:
    #: weights of the sources in code point order, repeating
    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    leaf: int = 64
    fan: int = 64
    #: a pool can make up for a document if all below the node weighs so many times as much
    outweigh: int = 8
    seed: int = 11


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """``sizes`` (source, source_size, rows; one row a source) with ``target``.

    All words are shared by weight; a target over its cap stops there and the excess is shared again by
    weight. Each round is one small aggregate; the sources stay distributed.
    """
    weights = F.array(*(F.lit(float(w)) for w in params.weights))
    buckets = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "place_no", buckets)
    rows = cut(ranked.withColumn("_weight", F.element_at(weights, (F.col("place_no") % len(params.weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * float(params.most)))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        over = F.col("_cap") <= level * F.col("_weight")
        share = rows.agg(F.sum(F.when(over, F.col("_cap"))), F.sum(F.when(~over, F.col("_weight"))), F.count_if(over)).first()
        if share[2] == capped:
            break
        capped = share[2]
        if not share[1]:
            break
        level = (total - (share[0] or 0.0)) / share[1]
    return rows.withColumn("target", F.least(F.col("_cap"), F.lit(level) * F.col("_weight"))).drop("place_no", "_weight", "_cap")


def _kept(value: Column, most: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), most.cast("double"))


def _with_pool(acc: Column, e: Column) -> Column:
    """Document ``e`` meets the pool: ``acc`` has size and mass of the document and the pool, which have one probability."""
    size, rest = e["size"], acc["size"] - e["size"]
    share = acc["mass"] / acc["size"]
    mine, pool = share * size, share * rest
    up, down = F.least(size - mine, pool), F.least(mine, rest - pool)
    gains = e["u"] * (up + down) < down  # the document gains with probability down / (up + down)
    whole = (acc["mass"] <= 0) | (acc["mass"] >= acc["size"])
    case = F.when(whole, F.when(acc["mass"] > 0, 1).otherwise(0)).when(rest <= 0, 2)
    case = case.when(gains, F.when(size - mine <= pool, 1).otherwise(3)).otherwise(F.when(mine <= rest - pool, 0).otherwise(4))
    # 0, 1: settled (not taken, taken); 2: nothing left to meet; 3, 4: the pool is settled (none, all taken) and the document is left
    mass = F.when(case == 0, acc["mass"]).when(case == 1, acc["mass"] - size).when(case == 4, rest.cast("double")).otherwise(0.0)
    left = F.struct(e["id"].alias("id"), size.alias("size"), _kept(F.when(case == 4, mine - down).when(case == 3, mine + up).otherwise(mine), size).alias("mass"))
    done = F.struct(e["id"].alias("id"), size.alias("size"), (case == 1).cast("int").alias("more"))
    return F.struct(
        rest.alias("size"),
        _kept(mass, rest).alias("mass"),
        F.when(case < 2, F.concat(acc["done"], F.array(done))).otherwise(acc["done"]).alias("done"),
        F.when(case < 2, acc["left"]).otherwise(F.concat(acc["left"], F.array(left))).alias("left"),
    )


def _in_pair(acc: Column, e: Column) -> Column:
    """The carried document ``acc`` meets ``e``; one is settled and the other carried on."""
    mine, room = acc["mass"], acc["size"] - acc["mass"]
    theirs, their_room = e["mass"], e["size"] - e["mass"]
    up, down = F.least(room, theirs), F.least(mine, their_room)
    gains = e["u"] * (up + down) < down
    both = mine + theirs
    whole = (mine <= 0) | (room <= 0)
    case = F.when(whole, 0).when(gains & (room <= theirs), 1).when(gains, 2).when(mine <= their_room, 3).otherwise(4)
    # 0, 1, 3: the carried one is settled (as it is, taken, not taken); 2, 4: the other is (not taken, taken)
    settles = case.isin(0, 1, 3)
    taken = F.when(case == 0, (mine > 0).cast("int")).otherwise(case.isin(1, 4).cast("int"))
    done = F.struct(F.when(settles, acc["id"]).otherwise(e["id"]).alias("id"), F.when(settles, acc["size"]).otherwise(e["size"]).alias("size"), taken.alias("more"))
    mass = F.when(case == 0, theirs).when(case == 1, both - acc["size"]).when(case == 4, both - e["size"]).otherwise(both)
    size = F.when(settles, e["size"]).otherwise(acc["size"])
    return F.struct(F.when(settles, e["id"]).otherwise(acc["id"]).alias("id"), size.alias("size"), _kept(mass, size).alias("mass"), F.concat(acc["done"], F.array(done)).alias("done"))


def _falling(rows: DataFrame, params: Params, level: int, *more: str) -> DataFrame:
    """Documents (source, node, id, size) of each node as an array in order of falling size."""
    drawn = rows.withColumn("u", unit("source", "id", F.lit(level), seed=params.seed + 1))
    item = F.struct((-F.col("size")).alias("falling"), F.xxhash64(F.lit(params.seed + 2), "id").alias("order"), "id", "size", "u", *more)
    return drawn.groupBy("source", "node").agg(F.array_sort(F.collect_list(item)).alias("docs"), F.sum("size").alias("own"))


def _settled(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes (source, node, docs, all, share) with x: what ``_with_pool`` leaves."""
    none = F.array().cast(f"array<struct<id:{kind},size:bigint,more:int>>")
    start = F.struct(F.col("all").alias("size"), (F.col("share") * F.col("all")).alias("mass"), none.alias("done"), F.array().cast(f"array<struct<id:{kind},size:bigint,mass:double>>").alias("left"))
    share = F.when(F.col("x.size") > 0, F.col("x.mass") / F.col("x.size")).otherwise(0.0)
    return cut(nodes.select("source", "node", F.aggregate("docs", start, _with_pool).alias("x")).select("source", "node", "x", share.alias("share")))


def _paired(rows: DataFrame, params: Params, level: int) -> DataFrame:
    """Folds the documents (source, node, id, size, mass) of each node pair by pair: x is the one left, with what is done."""
    kind = rows.schema["id"].dataType.simpleString()
    first, none = F.element_at("docs", 1), F.array().cast(f"array<struct<id:{kind},size:bigint,more:int>>")
    start = F.struct(first["id"].alias("id"), first["size"].alias("size"), first["mass"].alias("mass"), none.alias("done"))
    return cut(_falling(rows, params, level, "mass").select("source", "node", F.aggregate(F.expr("slice(docs, 2, size(docs))"), start, _in_pair).alias("x")))


def _up(node: Column, params: Params) -> Column:
    return F.floor(node / params.fan).alias("node")


def _rounded(rows: DataFrame, levels: int, params: Params) -> list[DataFrame]:
    """Decides documents (source, id, size, node: their leaf, share: their probability) in tables of source, id, size, more."""
    kind = rows.schema["id"].dataType.simpleString()
    shares = rows.groupBy("source").agg(F.max("share").alias("share"))
    leaves = cut(_falling(rows, params, 0))
    weights, waiting = [leaves.select("source", "node", F.col("own").alias("all"))], []
    if levels > 1:
        heavy = F.col("size") * params.outweigh > F.col("own")
        above = leaves.select("source", "node", "own", F.explode("docs").alias("d")).select("source", "node", "own", "d.id", "d.size").filter(heavy).select("source", _up(F.col("node"), params), "id", "size")
        leaves = leaves.withColumn("docs", F.filter("docs", lambda d: d["size"] * params.outweigh <= F.col("own"))).withColumn("own", F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["size"]))
    for level in range(1, levels):
        weights.append(cut(weights[-1].groupBy("source", _up(F.col("node"), params)).agg(F.sum("all").alias("all"))))
        placed = cut(above.join(weights[-1], ["source", "node"]).withColumn("stays", (F.col("size") * params.outweigh <= F.col("all")) | F.lit(level == levels - 1)))
        waiting.append(_falling(placed.filter("stays").drop("all"), params, level))
        above = placed.filter("not stays").select("source", _up(F.col("node"), params), "id", "size")

    # what hangs under each node, its own documents included
    below = [leaves.select("source", "node", F.col("own").alias("all"))]
    for level in range(1, levels):
        under = below[-1].groupBy("source", _up(F.col("node"), params)).agg(F.sum("all").alias("all"))
        under = under.join(waiting[level - 1].select(F.col("source").alias("s"), F.col("node").alias("n"), "own", "docs"), F.col("source").eqNullSafe(F.col("s")) & (F.col("node") == F.col("n")), "left").drop("s", "n")
        below.append(cut(under.select("source", "node", (F.col("all") + F.coalesce("own", F.lit(0))).alias("all"), F.coalesce("docs", F.array().cast(waiting[level - 1].schema["docs"].dataType)).alias("docs"))))

    done, left = [], []
    share = shares.select("source", F.lit(0).cast("long").alias("node"), "share")
    for level in range(levels - 1, -1, -1):
        nodes = below[level] if level else leaves.withColumnRenamed("own", "all")
        at = F.lit(0).cast("long") if level == levels - 1 else F.floor(F.col("node") / params.fan)
        given = share.select(F.col("source").alias("s"), F.col("node").alias("n"), "share")
        folded = _settled(nodes.join(given, F.col("source").eqNullSafe(F.col("s")) & (at == F.col("n"))).drop("s", "n"), kind)
        done.append(folded.select("source", F.explode("x.done").alias("d")).select("source", "d.*"))
        left.insert(0, folded.select("source", "node", F.explode("x.left").alias("d")).select("source", "node", "d.*"))
        share = folded.select("source", "node", "share")

    open_ = left[0]
    for level in range(1, levels):
        open_ = open_.withColumn("node", F.floor(F.col("node") / params.fan)).unionByName(left[level])
        folded = _paired(open_, params, 100 + level)
        done.append(folded.select("source", F.explode("x.done").alias("d")).select("source", "d.*"))
        open_ = folded.select("source", "node", "x.id", "x.size", "x.mass")
    last = (unit("source", "id", seed=params.seed + 3) * F.col("size") < F.col("mass")).cast("int")
    return [*done, open_.select("source", "id", "size", last.alias("more"))]


def decided(rows: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """For rows (source, size, id): the same with source_size, target and copies.

    ``id`` is a struct that tells documents apart; equal rows are numbered, so each gets its own decision.
    """
    counted = cut(rows.groupBy("source", "size", "id").agg(F.count(F.lit(1)).alias("times")))
    sizes = cut(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("rows")))
    goals = cut(targets(sizes, params))
    goals = goals.withColumn("_f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target", "rows", F.floor("_f").alias("_sure"), (F.col("_f") - F.floor("_f")).alias("_part"))
    goals = small(cut(goals))
    one = counted.withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).withColumn("id", F.struct("id", "no")).drop("no", "times")
    wanted = one.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    most = goals.agg(F.max("rows")).first()[0] or 0
    levels = 1 + (math.ceil(math.log(max(1, math.ceil(most / params.leaf)), params.fan) - 1e-9) if most > params.leaf else 0)
    leaves = F.ceil(F.col("rows") / params.leaf) if levels > 1 else F.lit(1)
    open_ = wanted.filter("_part > 0 and size > 0").select("source", F.pmod(F.xxhash64(F.lit(params.seed), "id"), leaves).alias("node"), "id", "size", F.col("_part").alias("share"))
    done = _rounded(open_, levels, params)
    sure = wanted.filter("not (_part > 0 and size > 0)")
    done.append(sure.select("source", "id", "size", (unit("source", "id", seed=params.seed + 4) < F.col("_part")).cast("int").alias("more")))
    settled = reduce(DataFrame.unionByName, done)
    out = settled.join(goals, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("source", "size", "id.id", F.col("id.no").alias("no"), "source_size", "target", (F.col("_sure") + F.col("more")).cast("long").alias("copies"))


def mix(docs: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id, size, source_size, target, taken, copies, source: one row a document."""
    rows = docs.select("source", n_words(F.col("text")).alias("size"), F.struct("doc_id").alias("id"))
    return decided(rows, params).select(F.col("id.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixed(docs: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """The documents as the mix takes them, with their own columns: each as often as it has copies."""
    key, copies = fresh(docs, "_key", "_copies")
    own = docs.withColumn(key, row_key(docs))
    rows = own.select("source", n_words(F.col("text")).alias("size"), F.struct(F.col(key).alias("key")).alias("id"))
    counts = decided(rows, params).groupBy(F.col("id.key").alias("_k")).agg(F.sum("copies").alias("_c")).filter("_c > 0")
    taken = one_of_each(own, key).join(counts, F.col(key) == F.col("_k")).withColumn(copies, F.col("_c"))
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*(F.col(f"`{c}`") for c in docs.columns))
