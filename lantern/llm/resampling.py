"""Irregular series to buckets: points of each client become counts, covered seconds and exact integrals.

Points are whole seconds and cents. The signal is ``step`` (a value lasts until the next point, ``longest`` seconds at most, and the
last one so long) or ``linear`` (a value runs straight to the next one, where that is at most ``longest`` seconds away; else it has no length).
In a segment of d seconds from v to w, twice the integral of the first u seconds is 2 v u + floor((w - v) u u / d), with w = v for a step.

A client's time is cut into blocks, and the points that follow a block within ``longest`` seconds are dealt to it, too, as its halo: so
each block knows the next point of all its own, and a client with most points is many blocks. A block has a point a second at most, which bounds it.
Tasks read their blocks in order and hand them, as many as fit a batch, to DuckDB inside the task: a window finds the next point, an ASOF join
to the table of bucket boundaries finds the segment in force at each, and quotients are floored from quotient and remainder in 128 bits. A segment
gives its whole to the bucket of its last second, and each boundary inside moves what lies before it one bucket back. Spark adds these partials up.

Rows with null client, time or value are dropped first; of a client's rows in a second the one with the largest id stays (of equal or null ids the one
with the larger value). Values that are no number, or beyond 18 digits of cents, raise an error. Rows repeated whole count once. Times without zone are
UTC. An empty table gives no bucket. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm.common import in_arrow


@dataclass(frozen=True)
class Params:
    signal: str = "step"
    bucket: int = 6 * 3600
    longest: int = 300
    #: seconds of a block, and memory of DuckDB in a task
    block: int = 6 * 3600
    memory: str = "256MB"
    #: rows of a block that are handed on together, at least
    rows: int = 20_000


def epoch_seconds(at: str, kind: T.DataType) -> Column:
    """Seconds since 1970, floored; a time without zone is UTC, whatever the session's zone."""
    if isinstance(kind, T.TimestampNTZType):
        day = F.datediff(F.col(at).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        return day * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.unix_seconds(F.col(at).cast("timestamp"))


def points(clicks: DataFrame, client: str = "client_id", at: str = "ts", value: str = "value", key: str = "click_id") -> DataFrame:
    """client_id, sec, cents: one row a client and second."""
    second = epoch_seconds(at, clicks.schema[at].dataType)
    rows = clicks.filter(F.col(client).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(F.col(client).cast("long").alias("client_id"), second.alias("sec"), F.col(key).alias("_key"), F.floor(F.lit(100) * F.col(value) + F.lit(0.5)).cast("long").alias("cents"))
    return rows.groupBy("client_id", "sec").agg(F.max(F.struct("_key", "cents")).alias("_top")).select("client_id", "sec", F.col("_top.cents").alias("cents"))


#: The work on some blocks; p holds (client_id, block, sec, cents, own). The quotient is floored from what DuckDB truncates.
_SQL = """
    with led as (
        select *, lead(sec) over w - sec as gap, lead(cents) over w as next_cents from p window w as (partition by client_id, block order by sec)),
    seg as (
        select client_id, block, sec, cents::hugeint as v, {length} as d, {rise} as rise from led where own),
    boundary as (
        select client_id, block, unnest(range(lo - lo % {bucket} - case when lo % {bucket} < 0 then {bucket} else 0 end, hi + 1, {bucket})) as b
        from (select client_id, block, min(sec) as lo, max(sec + d) as hi from seg group by all)),
    cut as (
        select s.*, b, b - sec as u from boundary asof join seg s on boundary.client_id = s.client_id and boundary.block = s.block and boundary.b >= s.sec),
    inside as (
        select client_id, b, u, 2 * v * u as flat, rise * u * u as n, d from cut where u > 0 and u < d),
    whole as (
        select s.client_id, boundary.b as b, d as u, 2 * v * d + rise * d as area from seg s asof join boundary on s.client_id = boundary.client_id and s.block = boundary.block and s.sec + d - 1 >= boundary.b where d > 0),
    begun as (
        select s.client_id, boundary.b as b from seg s asof join boundary on s.client_id = boundary.client_id and s.block = boundary.block and s.sec >= boundary.b),
    moved as (
        select client_id, b, u, flat + n // d - case when n % d < 0 then 1 else 0 end as area from inside),
    parts as (
        select client_id, b, 1 as n_points, 0 as covered, 0::hugeint as area from begun
        union all select client_id, b, 0, u, area from whole
        union all select client_id, b, 0, -u, -area from moved
        union all select client_id, b - {bucket}, 0, u, area from moved)
    select client_id, b as bucket_start, sum(n_points)::bigint as n_points, sum(covered)::bigint as covered_seconds, sum(area)::decimal(38, 0) as area2
    from parts group by client_id, b"""

_PARTIAL = "client_id long, bucket_start long, n_points long, covered_seconds long, area2 decimal(38,0)"


def _resampler(params: Params):
    step = params.signal == "step"
    length = f"least(coalesce(gap, {params.longest}), {params.longest})::bigint" if step else f"(case when gap <= {params.longest} then gap else 0 end)::bigint"
    sql = _SQL.format(length=length, rise="0::hugeint" if step else "coalesce(next_cents::hugeint - cents, 0)", bucket=params.bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        base = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": params.memory, "temp_directory": ""})

        def resampled(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            base.register("p", rows)
            yield from base.sql(sql).to_arrow_table().to_batches()
            base.unregister("p")

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < params.rows:
                continue
            rows = pa.Table.from_batches(held)
            whole = _before_last_block(rows)
            if whole:
                yield from resampled(rows.slice(0, whole))
            held, n = rows.slice(whole).to_batches(), rows.num_rows - whole
        if n:
            yield from resampled(pa.Table.from_batches(held))
        base.close()

    return run


def _before_last_block(rows: pa.Table) -> int:
    """Rows of the blocks that are over: those before the last block that has begun."""
    import numpy as np

    client, block = rows.column("client_id").to_numpy(), rows.column("block").to_numpy()
    other = np.flatnonzero((client != client[-1]) | (block != block[-1]))
    return int(other[-1]) + 1 if len(other) else 0


def resampled(found: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """client_id, bucket_start, n_points, covered_seconds, area2, avg_cents of points (client_id, sec, cents), one a client and second.

    ``found`` may be what ``points`` gives. avg_cents is the floor of area2 / (2 * covered_seconds), null without covered time.
    """
    if params.signal not in ("step", "linear"):
        raise ValueError(f"no such signal: {params.signal}")
    block = (F.col("sec") - F.pmod("sec", F.lit(params.block))).cast("long")
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    reach = -(-params.longest // params.block)  # blocks before a point's own whose halo may hold it
    halo = [
        F.when(F.pmod("sec", F.lit(params.block)) < params.longest - (k - 1) * params.block, F.struct((block - k * params.block).alias("block"), F.lit(False).alias("own")))
        for k in range(1, reach + 1)
    ]
    dealt = found.select("client_id", "sec", "cents", F.explode(F.array_compact(F.array(own, *halo))).alias("of"))
    dealt = dealt.select("client_id", F.col("of.block").alias("block"), "sec", "cents", F.col("of.own").alias("own"))
    blocks = dealt.repartition("client_id", "block").sortWithinPartitions("client_id", "block", "sec")
    partial = in_arrow(blocks, _resampler(params), _PARTIAL)
    total = partial.groupBy("client_id", "bucket_start").agg(F.sum("n_points").alias("n_points"), F.sum("covered_seconds").alias("covered_seconds"), F.sum("area2").alias("area"))
    twice = F.nullif(F.col("covered_seconds") * 2, F.lit(0)).cast("decimal(20,0)")
    average = F.expr("area div twice").cast("long") - F.when((F.col("area") % F.col("twice")) < 0, 1).otherwise(0)
    return total.withColumn("twice", twice).select("client_id", "bucket_start", "n_points", "covered_seconds", F.col("area").cast("long").alias("area2"), average.alias("avg_cents"))
