"""Thread responses as a table function of SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


def _inside(value: Any, *path: str) -> Any:
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)


@udtf(returnType="video_id string, comment_ord int, text string, author_id string, author_name string, like_count int, published string")
class ThreadComments:
    """[U9, S6] Comments of the responses (video_id, value) of a table argument, at most ``cap`` of each; a response that is no JSON has none.

    A row is read on its own, so a video may have any number of responses. Dates stay texts: ``try_to_timestamp`` reads them in SQL.
    """

    def eval(self, row: Row, cap: int = 100) -> Iterator[tuple]:
        try:
            items = _inside(json.loads(row["value"] or ""), "items")
        except ValueError:
            return
        for i, item in enumerate(items[:cap] if isinstance(items, list) else []):
            comment = _inside(item, "snippet", "topLevelComment", "snippet")
            text = _text(_inside(comment, "textDisplay")) or _text(_inside(comment, "textOriginal"))
            likes = _inside(comment, "likeCount")
            likes = likes if type(likes) is int and abs(likes) < 1 << 31 else 0
            if text:
                author = _text(_inside(comment, "authorChannelId", "value"))
                yield row["video_id"], i, text, author, _text(_inside(comment, "authorDisplayName")), likes, _text(_inside(comment, "publishedAt"))


def register(spark: SparkSession, name: str = "thread_comments") -> None:
    """Makes ``SELECT … FROM thread_comments(TABLE(responses) PARTITION BY (video_id), 100)`` known to the session."""
    spark.udtf.register(name, ThreadComments)
