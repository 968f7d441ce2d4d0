"""Changes of immutable tables: each returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """[J4, W2, T6] The row of each key that is greatest in ``order``. A partial aggregate, so hot keys combine early."""
    rest = F.struct(*order, *(c for c in rows.columns if c not in (*order, key)))
    return rows.groupBy(key).agg(F.max(rest).alias("_row")).select(key, "_row.*").select(*rows.columns)


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """[W7, T5] The row of each key that is least in ``order``."""
    rest = F.struct(*order, *(c for c in rows.columns if c not in (*order, key)))
    return rows.groupBy(key).agg(F.min(rest).alias("_row")).select(key, "_row.*").select(*rows.columns)


def insert_if_absent(base: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """[J8, K5] Base and those new rows whose key it lacks; of new rows with one key, the first in ``order``."""
    fresh = first_of_each(new, key, *order).join(base.select(key), key, "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def upsert(base: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """[K3, K4] New rows replace those of base with their keys."""
    return base.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*base.columns))


def update(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """[K2] Values of ``changes`` (key and some columns) that are not null replace those of base."""
    names = [c for c in changes.columns if c != key]
    joined = base.join(changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in names)), key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in base.columns))


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """[K6] Base without the rows of the keys."""
    return base.join(keys.select(key).distinct(), key, "left_anti")


def migrate(rows: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """[K11] The columns of the schema; missing ones hold their default or null. Doing it twice changes nothing."""
    have, defaults = set(rows.columns), defaults or {}
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that break uniqueness, with their numbers of rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(rows: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """[P18] Rows whose foreign key has no parent."""
    return rows.join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")


def with_children(rows: DataFrame, children: DataFrame, key: str, foreign: str) -> DataFrame:
    """[J6] Rows whose key some child refers to."""
    return rows.join(children.select(F.col(foreign).alias(key)), key, "left_semi")


def checked(value: Column, allowed: list[str], what: str) -> Column:
    """[P13] The value; one that is not allowed raises when the row is computed."""
    return F.when(value.isin(allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"{what} not allowed: "), F.coalesce(value, F.lit("null")))))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """[O3] A distributed top-k: each task keeps n rows."""
    return rows.orderBy(*order).limit(n)


def capped_gather(rows: DataFrame, group: str, item: str, item_rank: str, row_rank: str, per_item: int, cap: int) -> DataFrame:
    """[S7, S14, O7] At most ``per_item`` rows of each item, and at most ``cap`` of each group, in rank order."""
    inner = F.row_number().over(Window.partitionBy(group, item).orderBy(row_rank))
    outer = F.row_number().over(Window.partitionBy(group).orderBy(item_rank, row_rank))
    some = rows.withColumn("_i", inner).filter(F.col("_i") <= per_item)
    return some.withColumn("_o", outer).filter(F.col("_o") <= cap).drop("_i", "_o")
