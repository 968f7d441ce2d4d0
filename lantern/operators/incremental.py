"""[A16 to A19] Signals of coordinated behaviour kept up to date with new comments.

What other comments say about a comment goes through three small tables: which author was on which event first when, which text is whose, and which
texts are close. They are merged with the new comments; then only the events are scored again that the new comments touch: their own, those of
their authors where an author is now flagged over events, and those with a text that is, or is close to, a new one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.operators import signals


@dataclass
class State:
    """comments (all, with the columns that signals need, and sorted, null for short texts); authors (author_id, event_id, published_at: the first); texts
    (sorted, author); close (a, b)."""

    comments: DataFrame
    authors: DataFrame
    texts: DataFrame
    close: DataFrame


Keep = Callable[[DataFrame, str], DataFrame]


def _flagged(authors: DataFrame, cross: int, seconds: int) -> DataFrame:
    """author_id, signal of the authors flagged over events."""
    one = signals.cross_event_authors(authors, cross).select("author_id", F.lit("cross_event").alias("signal"))
    return one.unionByName(signals.velocity_authors(authors, seconds).select("author_id", F.lit("velocity").alias("signal")))


def _sorted(comments: DataFrame) -> DataFrame:
    norm = signals.normal_text("text")
    return comments.withColumn("sorted", F.when(F.length(norm) >= signals.COPY_FROM, signals.sorted_tokens(norm)))


def advance(state: State | None, new: DataFrame, keep: Keep, cross: int = signals.CROSS_EVENTS, seconds: int = signals.VELOCITY_SECONDS, percent: int = signals.VOLUME_PERCENT) -> tuple[State, DataFrame]:
    """The state with the new comments in it, and the composite rows of the events that were scored again: all others are as before.

    ``keep(rows, name)`` writes a table of the new state and gives it back as read; a comment must come once.
    """
    new = keep(_sorted(new.select("event_id", "comment_id", "author_id", "text", "stance", "published_at")), "new")
    author = F.coalesce(F.col("author_id").cast("string"), F.lit("")).alias("author")
    firsts = new.groupBy("author_id", "event_id").agg(F.min("published_at").alias("published_at"))
    texts = new.filter("sorted is not null").select("sorted", author).distinct()
    if state is None:
        comments, authors, held = new, keep(firsts, "authors"), keep(texts, "texts")
        close = keep(signals.close_texts(held.select("sorted").distinct()), "close")
        touched = new.select("event_id").distinct()
    else:
        comments = state.comments.unionByName(new)  # what is kept is not written again
        authors = keep(state.authors.unionByName(firsts).groupBy("author_id", "event_id").agg(F.min("published_at").alias("published_at")), "authors")
        held = keep(state.texts.unionByName(texts).distinct(), "texts")
        unseen = texts.select("sorted").distinct().join(state.texts.select("sorted"), "sorted", "left_anti")
        marked = held.select("sorted").distinct().join(unseen.withColumn("fresh", F.lit(True)), "sorted", "left").fillna(False, ["fresh"])
        close = keep(state.close.unionByName(signals.close_texts(marked)), "close")
        mine = new.select("author_id").distinct()
        before, now = (_flagged(rows.join(mine, "author_id", "left_semi"), cross, seconds) for rows in (state.authors, authors))
        turned = before.exceptAll(now).unionByName(now.exceptAll(before)).select("author_id").distinct()
        said = texts.select("sorted").distinct()
        near = close.join(said.select(F.col("sorted").alias("a")), "a", "left_semi").select(F.col("b").alias("sorted"))
        near = near.unionByName(close.join(said.select(F.col("sorted").alias("b")), "b", "left_semi").select(F.col("a").alias("sorted")))
        touched = new.select("event_id").unionByName(authors.join(turned, "author_id", "left_semi").select("event_id"))
        touched = touched.unionByName(comments.join(said.unionByName(near).distinct(), "sorted", "left_semi").select("event_id")).distinct()
    touched = keep(touched, "touched")
    rows = comments.join(touched, "event_id", "left_semi")
    found = signals.signals(rows, percent=percent, with_copies=False).filter("signal not in ('cross_event', 'velocity')")
    found = found.unionByName(rows.join(_flagged(authors, cross, seconds), "author_id").select("event_id", "comment_id", "signal"))
    found = found.unionByName(signals.copies(rows.filter("sorted is not null").select("event_id", "comment_id", "sorted", author), held, close))
    return State(comments, authors, held, close), signals.composite(rows, found)
