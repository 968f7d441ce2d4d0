"""Live feeds as a stream, and connectors that keep a session.

``LiveFeeds`` is a streaming Python data source. Its offset is a time: a batch holds the entries that the feeds date after the last offset and up to
the new one, so a batch that is run again after a failure gives the same rows, none twice and none to two batches, as long as the feeds still list them.
Nothing is kept on the driver but that time. Feeds are dealt into partitions by the requests that a task may make, and a task pauses between them.
"""

from __future__ import annotations

import base64
import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from importlib import import_module
from xml.etree import ElementTree

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lantern.sources.landed import status_of

#: Seconds that a request may take.
TIMEOUT = 20
_SCHEMA = "source string, entry_ord int, title string, summary string, link string, published timestamp, status string"


def fetch(address: str, headers: dict[str, str] | None = None, body: bytes | None = None) -> bytes:
    """[S2] What an address (http, https or file) gives."""
    with urllib.request.urlopen(urllib.request.Request(address, data=body, headers=headers or {}), timeout=TIMEOUT) as got:
        return got.read()


def dated(text: str | None) -> float | None:
    """Epoch seconds of a feed's date, in the mail's form or ISO; None if it is none. A date without zone is UTC."""
    for read in (parsedate_to_datetime, datetime.fromisoformat):
        try:
            found = read((text or "").strip())
        except (ValueError, TypeError):
            continue
        return (found if found.tzinfo else found.replace(tzinfo=UTC)).timestamp()
    return None


def entries(feed: bytes) -> Iterator[tuple[int, str, str, str, float | None]]:
    """[S1] Place, title, summary, link and time of each entry of an RSS text."""
    for i, item in enumerate(ElementTree.fromstring(feed).iter("item")):
        text = lambda tag: (item.findtext(tag) or "").strip()  # noqa: B023, E731
        yield i, text("title"), text("description"), text("link"), dated(text("pubDate"))


class _Feeds(InputPartition):
    def __init__(self, feeds: list[tuple[str, str]], after: float, until: float):
        self.feeds, self.after, self.until = feeds, after, until


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.feeds = list(zip(options["names"].split("\n"), options["places"].split("\n"), strict=True))
        self.since, self.until = float(options.get("since", 0)), float(options.get("until", math.inf))
        self.every, self.lag = float(options.get("every", 60)), float(options.get("lag", 0))
        self.budget, self.pause = int(options.get("budget", 10)), float(options.get("pause", 1.0))
        self.connector = options.get("connector", "lantern.sources.live:fetch")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        now = min(self.until, time.time() - self.lag)
        return {"until": max(self.since, now if now == self.until else now // self.every * self.every)}

    def partitions(self, start: dict, end: dict) -> list[_Feeds]:
        return [_Feeds(self.feeds[i : i + self.budget], start["until"], end["until"]) for i in range(0, len(self.feeds), self.budget)]

    def read(self, partition: _Feeds) -> Iterator[tuple]:
        module, name = self.connector.split(":")
        get = getattr(import_module(module), name)
        for i, (source, place) in enumerate(partition.feeds):
            if i:
                time.sleep(self.pause)
            try:
                found = list(entries(get(place)))
            except urllib.error.HTTPError as e:
                yield source, None, None, None, None, None, status_of(e.code, None)
                continue
            except Exception as e:  # whatever a client or parser raises
                yield source, None, None, None, None, None, status_of(None, type(e).__name__)
                continue
            for at, title, summary, link, when in found:
                if when is not None and partition.after < when <= partition.until:
                    yield source, at, title, summary, link, datetime.fromtimestamp(when, UTC), "ok"

    def commit(self, end: dict) -> None:
        """Nothing is held for a batch."""


class LiveFeeds(DataSource):
    """[S1, S3, T7] ``spark.readStream.format("lantern_live")``: options ``names`` and ``places`` (one a line), ``since`` and ``until`` (epoch seconds), ``every``
    (seconds between batches), ``lag`` (seconds that entries may come late), ``budget`` (requests of a task), ``pause`` (seconds between them) and ``connector``
    (``module:function`` from an address to bytes). A feed that fails is a row with its status. Entries without a date are left to ``lantern_feed``.
    """

    @classmethod
    def name(cls) -> str:
        return "lantern_live"

    def schema(self) -> T.StructType | str:
        return _SCHEMA

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


class TokenSession:
    """[S11] A client for ``responses`` that trades its credentials for a token, and holds it until it expires or is refused.

    Each task has a copy of its own, so a task makes one exchange for all its requests, and one more after a refusal (401).
    """

    def __init__(self, token_url: str, client_id: str, secret: str, agent: str, margin: float = 30.0, get: Callable[..., bytes] = fetch):
        if not client_id or not secret:
            raise ValueError("client id and secret are needed")
        self.token_url, self.agent, self.margin, self.get = token_url, agent, margin, get
        self.basic = base64.b64encode(f"{client_id}:{secret}".encode()).decode()
        self.token, self.until = None, 0.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"token": None, "until": 0.0}

    def renew(self) -> None:
        body = urllib.parse.urlencode({"grant_type": "client_credentials"}).encode()
        reply = json.loads(self.get(self.token_url, {"Authorization": f"Basic {self.basic}", "User-Agent": self.agent, "Content-Type": "application/x-www-form-urlencoded"}, body))
        if not reply.get("access_token"):
            raise ValueError("no access_token in the reply")
        self.token, self.until = reply["access_token"], time.monotonic() + float(reply.get("expires_in", 3600)) - self.margin

    def __call__(self, address: str) -> bytes:
        for last in (False, True):
            if self.token is None or time.monotonic() >= self.until:
                self.renew()
            try:
                return self.get(address, {"Authorization": f"Bearer {self.token}", "User-Agent": self.agent})
            except urllib.error.HTTPError as e:
                if e.code != 401 or last:
                    raise
                self.token = None
        raise AssertionError
