"""Sentiment of events from the stances of their comments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.text import collapsed, ellipsis, stance_label, stance_score

# Samples of each stance, their length, and when sentiment is collected again.
SAMPLES, SAMPLE_CHARS, RECENT_DAYS, STALE_HOURS = 2, 240, 3, 6


def distribution(comments: DataFrame) -> DataFrame:
    """[A6 to A8] Counts of each stance, mean score and label of each event."""
    score = stance_score("stance")
    return comments.groupBy("event_id").agg(
        F.count_if(F.col("stance") == "negative").alias("n_negative"),
        F.count_if(F.col("stance") == "neutral").alias("n_neutral"),
        F.count_if(F.col("stance") == "positive").alias("n_positive"),
        F.count(F.lit(1)).alias("sample_size"),
        F.avg(score).alias("score"),
    ).withColumn("label", stance_label("score"))


def samples(comments: DataFrame, n: int = SAMPLES, chars: int = SAMPLE_CHARS) -> DataFrame:
    """[W1, F8] The first comments of each stance, negative then neutral then positive, cut to a length."""
    first = F.row_number().over(Window.partitionBy("event_id", "stance").orderBy("comment_id"))
    place = F.when(F.col("stance") == "negative", 0).when(F.col("stance") == "neutral", 1).otherwise(2)
    rows = comments.filter(F.col("stance").isin("negative", "neutral", "positive")).withColumn("_n", first).filter(F.col("_n") <= n)
    return rows.select("event_id", place.alias("place"), F.col("_n").alias("no"), "stance", ellipsis(collapsed("text"), chars).alias("text"))


def to_refresh(events: DataFrame, sentiment: DataFrame, as_of: datetime, days: int = RECENT_DAYS, hours: int = STALE_HOURS) -> DataFrame:
    """[J5, J6, T4] Approved events without sentiment, and recent ones whose last is stale."""
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp")
    last = sentiment.groupBy("event_id").agg(F.max(F.col("collected_at").cast("timestamp")).alias("last_at"))
    rows = events.filter(F.col("status") == "approved").join(last, "event_id", "left")
    recent = F.col("event_date").cast("timestamp") >= F.date_trunc("day", now - F.expr(f"interval {int(days)} days"))
    stale = F.col("last_at") <= now - F.expr(f"interval {int(hours)} hours")
    return rows.filter(F.col("last_at").isNull() | (recent & stale)).drop("last_at")


def average_by_figure(events: DataFrame, last: DataFrame) -> DataFrame:
    """[A27] The mean of the events' latest scores, weighed by their samples."""
    joined = events.select("event_id", "figure_id").join(last, "event_id")
    return joined.groupBy("figure_id").agg((F.sum(F.col("score") * F.col("sample_size")) / F.sum("sample_size")).alias("score"))
