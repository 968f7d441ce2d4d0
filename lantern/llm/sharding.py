"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix. Native.

Law: ``rows`` (shard sizes at most one row apart). Rows are dealt by hash into logical partitions of known
sizes. In a uniform shuffle, the numbers of rows that go from each partition to each shard follow a
multivariate hypergeometric law; the matrix is drawn exactly, by halving: a node of a binary tree over
the partitions gets its rows' shard counts, draws those of its left half, and leaves the rest to the
right. Then each partition is permuted and cut by its row of the matrix, rows are exchanged, and every
shard is permuted again. The second permutation sorts by a random key; a shard is cut into ranges of that
key which are counted and numbered on their own, so no task sees a whole shard.

The matrix has at most ``most_parts`` rows, a fixed bound; a larger input has larger partitions.

The rows law takes no account of equal texts; they are spread like any other rows. Null text counts as
empty. Rows equal in id, size and checksum are numbered before they are dealt, so a key that holds a
third of all rows is spread too. Rows with equal random keys stand by id. Very long texts count whole. An empty table gives
an empty result. ``sharded`` keeps all columns, whatever they are; rows equal in all columns stand for one another.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.llm.common import cut, fresh, one_of_each, row_key, small, unit


@dataclass(frozen=True)
class Params:
    shards: int = 24
    rows_a_part: int = 4096
    most_parts: int = 1 << 15
    seed: int = 23


def _empty() -> Column:
    return F.array().cast("array<bigint>")


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked among ``drawn`` of ``total`` without replacement, by inversion at u in (0, 1).

    The law is summed over nine standard deviations and twelve more on each side, beyond which less is
    left than a double resolves; weights come from the ratio of neighbours, so no factorials are needed.
    """
    low, high = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(drawn, marked)
    size = F.greatest(total, F.lit(1).cast("long")).cast("double")
    mean = drawn * marked / size
    deviation = F.sqrt(F.greatest(mean * (total - marked) / size * (total - drawn) / F.greatest(size - 1, F.lit(1.0)), F.lit(0.0)))
    a = F.greatest(low, F.floor(mean - 9 * deviation - 12))
    b = F.least(high, F.ceil(mean + 9 * deviation + 12))
    ks = F.when(b > a, F.sequence(a + 1, b)).otherwise(_empty())

    def ratio(k: Column) -> Column:
        return (marked - k + 1).cast("double") * (drawn - k + 1) / (k.cast("double") * (total - marked - drawn + k))

    def add(acc: Column, k: Column) -> Column:
        weight = acc["w"] * ratio(k)
        return F.struct(weight.alias("w"), (acc["sum"] + weight).alias("sum"))

    weights = F.aggregate(ks, F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum")), add, lambda x: x["sum"])

    def seek(acc: Column, k: Column) -> Column:
        on = acc["sum"] < acc["goal"]
        weight = F.when(on, acc["w"] * ratio(k)).otherwise(acc["w"])
        return F.struct(weight.alias("w"), F.when(on, acc["sum"] + weight).otherwise(acc["sum"]).alias("sum"), acc["goal"].alias("goal"), F.when(on, k).otherwise(acc["k"]).alias("k"))

    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), (u * weights).alias("goal"), a.alias("k"))
    return F.aggregate(ks, start, seek, lambda x: x["k"])


def _left(counts: Column, rows: Column, drawn: Column, node: Column, level: int, params: Params) -> Column:
    """The shard counts of the left half: a multivariate hypergeometric draw, shard by shard."""

    def draw(acc: Column, s: Column) -> Column:
        here = F.element_at(counts, s)
        got = hypergeometric(acc["total"], here, acc["drawn"], unit(F.lit(level), node, s, seed=params.seed))
        return F.struct((acc["total"] - here).alias("total"), (acc["drawn"] - got).alias("drawn"), F.concat(acc["out"], F.array(got)).alias("out"))

    start = F.struct(rows.alias("total"), drawn.alias("drawn"), _empty().alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(params.shards)), start, draw, lambda x: x["out"])


def matrix(sizes: DataFrame, parts: int, total: int, params: Params) -> DataFrame:
    """part, counts (rows to each shard): row sums are the sizes (part, n), column sums the shards' sizes."""
    spark = sizes.sparkSession
    depth = max(parts - 1, 0).bit_length()
    share, more = divmod(total, params.shards)
    whole = [share + (s < more) for s in range(params.shards)]
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.lit(total).cast("long").alias("n"), F.array(*(F.lit(x).cast("long") for x in whole)).alias("counts"))
    for level in range(1, depth + 1):
        below = sizes.groupBy(F.shiftright("part", depth - level).alias("node")).agg(F.sum("n").alias("n"))
        lefts = F.broadcast(below.filter("node % 2 = 0").select(F.shiftright("node", 1).alias("node"), F.col("n").alias("_left")))  # at most most_parts rows
        halved = nodes.join(lefts, "node", "left").withColumn("_left", F.coalesce("_left", F.lit(0).cast("long")))
        halved = halved.withColumn("_counts", _left(F.col("counts"), F.col("n"), F.col("_left"), F.col("node"), level, params))
        rest = F.zip_with("counts", "_counts", lambda x, y: x - y)
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("_left").alias("n"), F.col("_counts").alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("_left")).alias("n"), rest.alias("counts")))
        nodes = halved.select(F.explode(halves).alias("x")).select("x.*").filter("n > 0")
        if level % 4 == 0:
            nodes = cut(nodes)  # each level stands once in the next one's plan
    return nodes.select(F.col("node").alias("part"), "counts")


def placed(rows: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """``rows`` (column id, a struct that may repeat) one by one: id, no, shard, slot."""
    counted = cut(rows.groupBy("id").agg(F.count(F.lit(1)).alias("times")))
    total = counted.agg(F.sum("times")).first()[0] or 0
    parts = min(params.most_parts, max(1, math.ceil(total / params.rows_a_part)))
    one = counted.select("id", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("no"))
    one = one.withColumn("part", F.pmod(F.xxhash64(F.lit(params.seed + 1), "id", "no"), F.lit(parts)))
    sizes = cut(one.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    sums = F.transform(F.sequence(F.lit(1), F.lit(params.shards)), lambda s: F.aggregate(F.slice("counts", F.lit(1), s), F.lit(0).cast("long"), lambda x, y: x + y))
    sent = small(cut(matrix(sizes, parts, total, params).select("part", sums.alias("until"))), params.most_parts)
    first = F.row_number().over(Window.partitionBy("part").orderBy(unit("id", "no", seed=params.seed + 2), "id", "no"))
    dealt = one.withColumn("_first", first).join(sent, "part")
    dealt = dealt.select("id", "no", F.size(F.filter("until", lambda x: x < F.col("_first"))).alias("shard"), unit("id", "no", seed=params.seed + 3).alias("u"))
    ranges = max(1, math.ceil(total / params.shards / params.rows_a_part))
    dealt = cut(dealt.withColumn("range", F.floor(F.col("u") * ranges)))
    held = dealt.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = held.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    second = F.row_number().over(Window.partitionBy("shard", "range").orderBy("u", "id", "no"))
    return dealt.withColumn("_second", second).join(starts, ["shard", "range"]).select("id", "no", "shard", (F.col("_start") + F.col("_second") - 1).cast("long").alias("slot"))


def shard(docs: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id, size (UTF-8 bytes and 8), text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")).alias("id"))
    return placed(rows, params).select("id.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """The documents with their own columns, shard and slot, laid out by them; clashing names get a ``_``."""
    key, = fresh(docs, "_key")
    shard_name, slot_name = fresh(docs, "shard", "slot")
    own = docs.withColumn(key, row_key(docs))
    where = placed(own.select(F.struct(F.col(key).alias("key")).alias("id")), params).select(F.col("id.key").alias("_k"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = one_of_each(own, key).join(where, F.col(key) == F.col("_k"))
    rows = rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.col("_shard").alias(shard_name), F.col("_slot").alias(slot_name))
    n = max(params.shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(n, shard_name, slot_name).sortWithinPartitions(shard_name, slot_name)
