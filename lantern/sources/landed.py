"""Sources as landed files: configuration, feeds, video and forum APIs, catalog; and sinks.

Connectors land raw responses; everything from there on is a DataFrame with a declared schema. Live
feeds can be read through the Python data source ``FeedSource``, one input partition a feed.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lantern.functions.display import lookup, request
from lantern.functions.text import contains_any, non_empty, sql_literal, timestamp_or, url_id
from lantern.functions.udfs import unescaped

FIGURE = "figure_ord int, figure_id string, name string, role string, aliases array<string>, active boolean"
SOURCE = "source_ord int, name string, rss string, weight double"
ENTRY = "source string, entry_ord int, title string, summary string, link string, published timestamp, updated timestamp"
VIDEOS = "items array<struct<id:struct<videoId:string>,snippet:struct<title:string,channelId:string,channelTitle:string,publishedAt:string>>>"
THREADS = (
    "items array<struct<snippet:struct<topLevelComment:struct<snippet:struct<textDisplay:string,textOriginal:string,"
    "authorChannelId:struct<value:string>,authorDisplayName:string,likeCount:int,publishedAt:string>>>>>"
)
LISTING = "data struct<children:array<struct<kind:string,data:struct<id:string,title:string,url:string,num_comments:int,permalink:string,body:string,author:string>>>>"


def figures(spark: SparkSession, text: str) -> DataFrame:
    """[S15] Active figures of a TOML text, in their order."""
    rows = tomllib.loads(text).get("figure", [])
    kept = [(i, r["id"], r["name"], r.get("role", ""), list(r.get("aliases", [])), bool(r.get("active", True))) for i, r in enumerate(rows)]
    return spark.createDataFrame(kept, FIGURE).filter("active")


def outlets(spark: SparkSession, text: str) -> DataFrame:
    """[S15] Sources of a TOML text."""
    rows = tomllib.loads(text).get("source", [])
    return spark.createDataFrame([(i, r["name"], r["rss"], float(r.get("weight", 0.5))) for i, r in enumerate(rows)], SOURCE)


def feed_entries(files: DataFrame) -> DataFrame:
    """[S1] Entries of landed RSS texts (source, value), parsed inside the JVM; a feed that is no XML has none."""
    kind = "channel struct<item:array<struct<title:string,description:string,link:string,pubDate:string>>>"
    items = files.select("source", F.posexplode(F.from_xml("value", kind, {"rowTag": "rss"})["channel"]["item"]).alias("entry_ord", "item"))
    day = F.regexp_replace(F.regexp_replace("item.pubDate", "^\\s*[A-Za-z]+,\\s*", ""), "(GMT|UTC|Z)\\s*$", "+0000")
    published = F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z"))
    return items.select("source", "entry_ord", "item.title", F.col("item.description").alias("summary"), "item.link", published.alias("published"), F.lit(None).cast("timestamp").alias("updated"))


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """[S17] A table of a relational database; ``partitionColumn`` and its bounds let tasks read ranges."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def first_row(rows: DataFrame) -> dict | None:
    """[S17] The first row of a lookup, or none."""
    found = rows.limit(1).collect()
    return found[0].asDict(recursive=True) if found else None


def status_of(status: int | None, error: str | None) -> str:
    """[S3, T8] What a connector writes down about a download: ``ok`` or the error as a value."""
    return f"error:download:{error}" if error else "ok" if status is not None and status < 400 else f"error:download:HTTP{status}"


def feed_articles(entries: DataFrame) -> DataFrame:
    """[S1, F1, P11] Articles of feed entries; those without link go."""
    return entries.filter(F.length("link") > 0).select(
        url_id("link").alias("article_id"), "source", F.col("link").alias("url"), "title", "summary",
        F.coalesce("published", "updated").alias("published_at"), "entry_ord",
    )


# Channels of video searches, by handle, and international ones by what their titles hold, in order of precedence.
DOMESTIC_CHANNELS = {
    "kompastv": "Kompas TV", "metrotvnews": "Metro TV", "cnnindonesiaofficial": "CNN Indonesia TV", "tvOneNews": "tvOne", "inewsdotid": "iNews", "beritasatu": "Berita Satu",
}
INTERNATIONAL_CHANNELS = [
    ("al jazeera", "Al Jazeera"), ("bloomberg", "Bloomberg"), ("bbc news", "BBC News"), ("reuters", "Reuters"), ("associated press", "Associated Press"),
    ("channel newsasia", "Channel NewsAsia"), ("cna", "Channel NewsAsia"), ("south china morning post", "South China Morning Post"), ("dw news", "DW News"),
    ("france 24", "France 24"), ("abc news", "ABC News"), ("nikkei asia", "Nikkei Asia"), ("guardian news", "The Guardian"),
]
#: Parameters of a search at home, and abroad.
DOMESTIC_SEARCH = {"part": "snippet", "type": "video", "maxResults": "5", "relevanceLanguage": "id", "regionCode": "ID", "order": "date", "videoDuration": "medium"}
INTERNATIONAL_SEARCH = {"part": "snippet", "type": "video", "maxResults": "5", "order": "date", "videoDuration": "medium"}


def search_request(base: str, query: str, international: bool = False) -> Column:
    """[S4, S8, S9, F39] The address of a search for the texts of a column."""
    values = INTERNATIONAL_SEARCH if international else DOMESTIC_SEARCH
    return request(base, **{k: F.lit(v) for k, v in values.items()}, q=F.col(query))


def domestic_videos(found: DataFrame) -> DataFrame:
    """[S8] Videos with their channel's name: that of its id, or of a handle, whatever spaces and case its title has, else the title, else ``YouTube``."""
    plain = F.lower(F.regexp_replace(F.coalesce("channel", F.lit("")), r"\s+", ""))
    names = {k.lower(): v for k, v in DOMESTIC_CHANNELS.items()} | {v.replace(" ", "").lower(): v for v in DOMESTIC_CHANNELS.values()}
    known = lookup("channel_id", DOMESTIC_CHANNELS, F.lit(None).cast("string")) if "channel_id" in found.columns else F.lit(None).cast("string")
    return found.withColumn("channel", F.coalesce(known, lookup(plain, names, F.coalesce(F.nullif("channel", F.lit("")), F.lit("YouTube")))))


def international_videos(found: DataFrame, channels: list[tuple[str, str]] | None = None) -> DataFrame:
    """[S9, J19] Videos of known channels, under the name of the first whose key the title holds; others go."""
    pairs = [(name, key) for key, name in channels or INTERNATIONAL_CHANNELS]
    return found.withColumn("channel", contains_any(F.coalesce("channel", F.lit("")), pairs)).filter("channel is not null")


def responses(requests: DataFrame, get: Callable[[str], bytes | str], url: str = "url") -> DataFrame:
    """[S2, S3, S4, S11, T8] What a connector gets for each address: the rows with ``value`` and ``status``. An error is a value, never an exception.

    ``get`` is handed in (an HTTP client with its headers, tokens and pauses), is run where the rows are, and gives text, or bytes of UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, states = [], []
            for address in batch.column(batch.schema.get_field_index(url)).to_pylist():
                try:
                    got = get(address)
                    text = got.decode("utf-8", "replace") if isinstance(got, bytes) else got
                    values.append(text or None)
                    states.append("ok" if text else "error:empty")
                except Exception as e:  # whatever a client raises
                    values.append(None)
                    states.append(f"error:download:{type(e).__name__}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string()), pa.array(states, pa.string())], names=[*batch.schema.names, "value", "status"])

    kept = requests.select(*(c for c in requests.columns if c not in ("value", "status")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, value string, status string")


def ingest_counts(entries: DataFrame, attributed: DataFrame, known: DataFrame | None) -> DataFrame:
    """[A21] One row: entries fetched, entries with link that a figure matches, articles inserted, and those skipped as known or repeated.

    ``attributed``: the matched articles before repeated and known ones are left out; ``known``: article_id of those stored.
    """
    ids = attributed.groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    ids = ids.withColumn("is_new", F.lit(True)) if known is None else ids.join(known.select("article_id").distinct().withColumn("_known", F.lit(True)), "article_id", "left").withColumn("is_new", F.col("_known").isNull())
    counts = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched"), F.count_if("is_new").alias("inserted"))
    return entries.agg(F.count(F.lit(1)).alias("fetched")).crossJoin(F.broadcast(counts)).withColumn("skipped_existing", F.col("matched") - F.col("inserted"))  # a row each


def videos(responses: DataFrame, body: str = "value") -> DataFrame:
    """[S5, S8] Videos of landed search responses, each with its key as an article; items without id go. A date that is none is null."""
    items = responses.select(F.posexplode(F.from_json(body, VIDEOS)["items"]).alias("video_ord", "item"))
    rows = items.select(
        "video_ord", F.col("item.id.videoId").alias("video_id"), "item.snippet.title", F.col("item.snippet.channelId").alias("channel_id"),
        F.col("item.snippet.channelTitle").alias("channel"), timestamp_or("item.snippet.publishedAt").alias("published_at"),
    )
    rows = rows.filter(F.length("video_id") > 0).withColumn("article_id", url_id(F.concat(F.lit("yt-"), "video_id")))
    return rows.withColumn("url", F.concat(F.lit("https://youtube.com/watch?v="), "video_id"))


def video_comments(responses: DataFrame, body: str = "value", cap: int = 100) -> DataFrame:
    """[S6] Comments of landed thread responses (video_id, body): shown text or original, at most ``cap`` a response."""
    items = responses.select("video_id", F.posexplode(F.from_json(body, THREADS)["items"]).alias("comment_ord", "item"))
    s = "item.snippet.topLevelComment.snippet"
    text = non_empty(f"{s}.textDisplay", F.col(f"{s}.textOriginal"))
    rows = items.filter(F.col("comment_ord") < cap).select(
        "video_id", "comment_ord", text.alias("text"), F.col(f"{s}.authorChannelId.value").alias("author_id"),
        F.col(f"{s}.authorDisplayName").alias("author_name"), F.coalesce(f"{s}.likeCount", F.lit(0)).alias("like_count"),
        timestamp_or(f"{s}.publishedAt").alias("published_at"),
    )
    return rows.filter(F.length("text") > 0)


def forum_posts(responses: DataFrame, body: str = "value") -> DataFrame:
    """[S12] Posts with comments."""
    items = responses.select(F.posexplode(F.from_json(body, LISTING)["data"]["children"]).alias("post_ord", "item"))
    return items.select("post_ord", "item.data.id", "item.data.title", "item.data.url", "item.data.num_comments", "item.data.permalink").filter("num_comments > 0")


def forum_comments(responses: DataFrame, body: str = "value") -> DataFrame:
    """[S13] Top-level comments that were not taken away, in the schema of all channels."""
    items = responses.select("post_id", F.posexplode(F.from_json(body, LISTING)["data"]["children"]).alias("comment_ord", "item"))
    kept = items.filter((F.col("item.kind") == "t1") & (F.length("item.data.body") > 0) & ~F.col("item.data.body").isin("[removed]", "[deleted]"))
    return kept.select("post_id", "comment_ord", F.col("item.data.body").alias("text"), F.col("item.data.author").alias("author_id"))


def transcripts(lines: DataFrame, preference: list[str]) -> DataFrame:
    """[S10, F26] One transcript a video (video_id, language, lines): in the most preferred language, character references as characters."""
    rank = F.array_position(F.array(*(F.lit(p) for p in preference)), F.col("language"))
    ranked = lines.withColumn("_rank", rank).filter("_rank > 0")
    return ranked.groupBy("video_id").agg(F.min_by(F.array_join("lines", " "), "_rank").alias("text")).withColumn("text", unescaped("text"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """[S18, A25] Rows of each table."""
    out = None
    for name, rows in sorted(tables.items()):
        one = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def table_columns(tables: dict[str, DataFrame]) -> list[tuple[str, int, str, str, bool]]:
    """[S18] (table, place, column, type, nullable) of each column: the catalogue listing, from the schemas alone."""
    return [(name, i, f.name, f.dataType.simpleString(), f.nullable) for name, rows in sorted(tables.items()) for i, f in enumerate(rows.schema)]


def sql_dump(rows: DataFrame, table: str) -> DataFrame:
    """[K9] One INSERT statement a row; null columns are left out."""
    names = [F.when(F.col(c).isNotNull(), F.lit(c)) for c in rows.columns]
    values = [F.when(F.col(c).isNotNull(), sql_literal(c)) for c in rows.columns]
    return rows.select(F.concat(F.lit(f"INSERT INTO {table} ("), F.concat_ws(", ", *names), F.lit(") VALUES ("), F.concat_ws(", ", *values), F.lit(");")).alias("statement"))


def statements(script: str) -> list[str]:
    """The statements of a SQL script. Semicolons inside quotes and comments do not end one."""
    parts = re.findall(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|;|[^;'\"`/-]+|.", script, re.S)
    out = [""]
    for part in parts:
        if part == ";":
            out.append("")
        elif not part.startswith(("--", "/*")):
            out[-1] += part
    return [s.strip() for s in out if s.strip()]


def run_script(spark: SparkSession, script: str) -> None:
    """[F45, K10] Runs the statements of a SQL script."""
    for statement in statements(script):
        spark.sql(statement)


def stage_output(rows: DataFrame, path: str, stage: str, run: str) -> None:
    """[K1, K12] Appends what a stage of a run gives, in one commit; the same run written again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/stage={stage}/run={run}")


def copy_table(rows: DataFrame, columns: list[str], write: Callable[[DataFrame], None]) -> None:
    """[K7, K8] Hands the columns, keys among them, to a writer such as ``lambda d: d.write.jdbc(...)``."""
    write(rows.select(*columns))


class _Feed(InputPartition):
    def __init__(self, name: str, place: str):
        self.name, self.place = name, place


class _FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[_Feed]:
        names, places = self.options["names"].split("\n"), self.options["places"].split("\n")
        return [_Feed(n, p) for n, p in zip(names, places, strict=True)]

    def read(self, partition: _Feed) -> Iterator[tuple]:
        from xml.etree import ElementTree

        with open(partition.place, "rb") as feed:
            root = ElementTree.parse(feed).getroot()
        for i, item in enumerate(root.iter("item")):
            text = lambda tag: (item.findtext(tag) or "").strip()  # noqa: B023, E731
            yield partition.name, i, text("title"), text("description"), text("link"), text("pubDate")


class FeedSource(DataSource):
    """[S1, U9] RSS files by path: ``spark.read.format("lantern_feed").option("names", …).option("places", …)``, one a line."""

    @classmethod
    def name(cls) -> str:
        return "lantern_feed"

    def schema(self) -> T.StructType | str:
        return "source string, entry_ord int, title string, summary string, link string, published string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FeedReader(self.options)
