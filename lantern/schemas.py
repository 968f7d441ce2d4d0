"""[K10, K11] Tables of the timeline pipeline; nested values are nested columns, times are timestamps in UTC."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from lantern.operators.tables import migrate

DDL = {
    "articles": "article_id string, figure_id string, source string, url string, title string, summary string, body string, body_original string, body_lang string, fetch_status string, published_at timestamp, fetched_at timestamp, event_id string",
    "events": "event_id string, figure_id string, title string, event_date timestamp, event_type string, status string, created_at timestamp",
    "event_summaries": "event_id string, summary_text string, citations array<struct<document_index:int,document_title:string>>, n_outlets bigint, single_source_flag boolean, model string, generated_at timestamp",
    "sentiment": "event_id string, channel string, score double, label string, sample_size bigint, collected_at timestamp",
    "comments": "comment_id bigint, event_id string, item_id string, author_id string, author_name string, text string, like_count int, published_at timestamp, stance string, collected_at timestamp",
    "signals": "event_id string, anomaly_score double, anomaly_pct double, suspicious_ids array<bigint>, signals string, analyzed_at timestamp",
    "corrections": "correction_id bigint, event_id string, submitted_by string, body string, status string, created_at timestamp",
}
DEFAULTS = {"events": {"event_type": "other", "status": "new"}, "comments": {"like_count": 0}, "corrections": {"status": "open"}}
STATUSES = ["new", "summarized", "approved", "rejected"]


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(DDL[name])


def create(spark: SparkSession, database: str = "default") -> None:
    """Creates the tables that are not there."""
    for name, columns in DDL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def conform(rows, name: str):
    """Rows with the table's columns and types; missing ones hold their defaults."""
    return migrate(rows, schema(name), DEFAULTS.get(name))
