"""Session, storage and size helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: White space that separates words: space and the code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many rows may be broadcast; it is counted first.
BROADCAST_ROWS = 50_000
#: Bytes of a batch of rows that goes to Python.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only in local mode, where there is one machine, it may be one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lantern-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of frames that are no longer held.

    Spark deletes them when the driver's JVM collects its garbage, which a driver with little to do puts off; an
    operator of many rounds would pile them up until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sample(rows: DataFrame, order: str, text: str, most_bytes: int) -> list[Row]:
    """Rows to fit a model on, collected: the first by ``order`` whose texts have at most so many bytes in all. ``rows`` are few."""
    rows = cut(rows)
    room, n = most_bytes, 0
    for r in rows.select(order, F.octet_length(text).alias("n")).orderBy(order).collect():
        room -= r.n
        if room < 0:
            break
        n += 1
    return rows.orderBy(order).limit(n).collect()


def packed(df: DataFrame, rows: int, each: int = 250_000) -> DataFrame:
    """A table of about so many narrow rows in no more partitions than they need, four for each core at least; it never adds any."""
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def stored(df: DataFrame) -> DataFrame:
    """As cut(), for wide rows: a Parquet table in the shared folder, which goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a cheap (already cut) table for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def unit(*cols, seed: int):
    """A number in (0, 1) drawn from the columns' hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def numbered(df: DataFrame, order: list, name: str, buckets: int) -> DataFrame:
    """Numbers rows from 0 in the given order without one task seeing all of them.

    Rows are dealt by range, counted per range, and numbered inside it; ``df`` must be cut.
    """
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        ranged.withColumn("_place", place)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + F.col("_place") - 1).cast("long"))
        .drop("_part", "_place", "_start")
    )


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_BYTES``, whatever the rows' texts; sets it for the session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df.sparkSession.conf.set(name, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def row_key(df: DataFrame) -> Column:
    """128 bits of all columns: rows with one key are equal, and may stand for one another."""
    values = [F.map_entries(F.col(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema]
    values += [v.isNull() for v in values]  # the hash skips nulls
    return F.struct(F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b"))


def one_of_each(df: DataFrame, key: str) -> DataFrame:
    """One row of each key; tasks leave one each before rows are dealt by the key, so a row repeated often is no hot key."""
    place, = fresh(df, "_first")
    return df.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(key))).filter(F.col(place) == 1).drop(place)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have yet, whatever its case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
