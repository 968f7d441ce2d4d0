"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, source mix, shards.

Each stage gets what its predecessor wrote and works on all of it. All but the last return the columns of
documents; the last adds shard and slot.

Null and empty texts fail the quality rules, so later stages of ``run`` do not see any; on their own, near_duplicates takes them for
copies of each other, decontamination and mixing find nothing in them (mixing decides texts without a word by a coin each), and sharding
deals them out like any row. Null languages are judged as one group, null sources are a source of their own, and a null doc_id is kept as it is.
Very long texts are read whole by every stage. Rows repeated whole are judged alike by quality, one of them stays in near_duplicates, and
mixing and sharding count each. Of near-duplicates the row with the least doc_id stays; other ties are named by the operators. An
empty table passes as an empty table. Extra columns are kept by all stages; where documents have a shard or slot, those added
get a ``_``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lantern.llm import decontamination, fertility, mixing, near_dedup, sharding
from lantern.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules reject go."""
    return fertility.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard and slot and lays the rows out by them."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Tokenisation, LSH and the random draws have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
