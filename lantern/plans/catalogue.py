"""The library's queries over the driver's tables, each with its SQL where SQL can express it.

Adapters read the tables as what the operators expect: events are comments (author user_id, stance by
event_type), documents are articles (outlet source), orders are events of a figure (customer), lineitem
rows are articles of an order (outlet supplier).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.functions import display
from lantern.functions import text as t
from lantern.functions.udfs import FREQUENT, language, paragraphs
from lantern.functions.vectors import mean_vector
from lantern.operators import clustering, sentiment, signals, tables, timeline
from lantern.operators.names import linked_by_table, segments_by_table
from lantern.plans import pipeline
from lantern.sources import landed, threads
from lantern.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TERMS = [("alpha", ["wereld", "thanthed"]), ("beta", ["heit", "lich"]), ("gamma", ["ción", "mente"]), ("delta", ["the"])]
RULES = [(r"\b(heit|keit)\b", "german"), (r"\b(mente|ado)\b", "spanish"), (r"\b(ment|eux)\b", "french"), (r"\b(the|that)\b", "english")]
AS_OF = datetime(1998, 12, 1)
STANCE = "case event_type when 'error' then 'negative' when 'view' then 'neutral' when 'click' then 'neutral' else 'positive' end"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    keys = {"type": F.col("event_type"), "day": F.date_format("ts", "yyyy-MM-dd"), "hour": F.date_format("ts", "yyyy-MM-dd HH")}
    return read(spark, sf_dir, "events").select(
        keys[key].alias("event_id"), F.col("event_id").alias("comment_id"), F.col("user_id").alias("author_id"), F.expr(STANCE).alias("stance"), F.col("ts").alias("published_at"),
        F.when(F.col("event_type") == "error", F.sha2(t.json_field("props", "k"), 256)).otherwise("").alias("text"),
    )


def orders_as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "summarized").otherwise("new")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("figure_id"), F.col("o_orderdate").alias("event_date"), status.alias("status"), F.col("o_orderpriority").alias("title"))


def lines_as_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("source"), F.col("l_shipdate").alias("published_at"), F.col("l_partkey").alias("article_id"), F.col("l_linenumber").alias("no"))


def long(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


HOUR, DAY = "strftime(ts, '%Y-%m-%d %H')", "strftime(ts, '%Y-%m-%d')"


@query("""
    with firsts as (select user_id, event_type, min(ts) as t from events group by 1, 2),
    gaps as (select user_id, epoch_us(t) - lag(epoch_us(t)) over (partition by user_id order by t, event_type) as gap from firsts)
    select user_id as author_id, min(gap) as least_gap_us from gaps where gap <= 3600000000 group by 1""")
def velocity_authors(spark, sf_dir):
    return signals.velocity_authors(comments(spark, sf_dir, "type"))


@query(f"""
    select user_id as author_id, count(distinct {DAY}) as n_events from events group by 1 having count(distinct {DAY}) >= 28""")
def cross_event_authors(spark, sf_dir):
    return signals.cross_event_authors(comments(spark, sf_dir, "day"), 28)


@query(f"""
    with c as (select {HOUR} as event_id, user_id as author_id, count(*) as n from events group by 1, 2)
    select * from (select *, cast(sum(n) over (partition by event_id) as bigint) as n_event from c) where n * 100 > n_event * 20""")
def volume_dominance(spark, sf_dir):
    return signals.dominant_authors(comments(spark, sf_dir, "hour")).select("event_id", "author_id", "n", "n_event")


_MAJORITY = f"""
    with c as (select {HOUR} as event_id, {STANCE} as stance, count(*) as n, min(event_id) as seen from events group by 1, 2),
    m as (select event_id, stance as majority from c qualify row_number() over (partition by event_id order by n desc, seen) = 1)"""


@query(_MAJORITY + " select * from m")
def majority_stance(spark, sf_dir):
    return signals.majority_stance(comments(spark, sf_dir, "hour"))


_EXTREME = f"select {HOUR} as event_id, e.event_id as comment_id, 'extremity' as signal from events e join m on m.event_id = {HOUR} where {STANCE} <> majority and {STANCE} <> 'neutral'"


@query(f"{_MAJORITY} {_EXTREME}")
def extreme_comments(spark, sf_dir):
    return signals.extreme_comments(comments(spark, sf_dir, "hour"))


@query(f"""{_MAJORITY},
    k as (select {HOUR} as event_id, event_id as comment_id, user_id as author_id, ts,
        case when event_type = 'error' then json_extract_string(props, '$.k') end as said from events),
    x as (select author_id from k group by 1 having count(distinct event_id) >= 95),
    f as (select author_id, event_id, min(ts) as first_at from k group by 1, 2),
    v as (select distinct author_id from (select author_id, epoch_us(first_at) - lag(epoch_us(first_at)) over (partition by author_id order by first_at, event_id) as gap from f) where gap <= 60000000),
    d as (select event_id, author_id from (select event_id, author_id, count(*) as n, sum(count(*)) over (partition by event_id) as total from k group by 1, 2) where n * 100 > total * 20),
    s as (
        select event_id, comment_id, 'cross_event' as signal, 0 as place, 30 as weight from k where author_id in (select author_id from x)
        union all select event_id, comment_id, 'copypasta', 1, 25 from k where said in (select said from k group by 1 having count(distinct author_id) > 1)
        union all select event_id, comment_id, signal, 2, 20 from ({_EXTREME})
        union all select event_id, comment_id, 'velocity', 3, 15 from k where author_id in (select author_id from v)
        union all select k.event_id, k.comment_id, 'volume', 4, 10 from k join d on d.event_id = k.event_id and d.author_id = k.author_id),
    w as (select event_id, cast(sum(weight) as double) / 100 as score, string_agg(signal, ',' order by place) as signals from (select distinct event_id, signal, place, weight from s) group by 1),
    i as (select event_id, count(distinct comment_id) as n from s group by 1),
    a as (select event_id, count(*) as n_comments from k group by 1)
    select a.event_id, n_comments, coalesce(score, 0.0) as anomaly_score, coalesce(w.signals, '') as signals, coalesce(i.n, 0) as n_suspicious,
        round_even(coalesce(i.n, 0) * 100.0 / n_comments, 1)::double as anomaly_pct
    from a left join w on w.event_id = a.event_id left join i on i.event_id = a.event_id""")
def composite_anomaly(spark, sf_dir):
    """All five signals. Comments of errors have a checksum for a text, and checksums are never alike, so SQL can say what is a copy."""
    rows = comments(spark, sf_dir, "hour")
    found = signals.signals(rows, cross=95, seconds=60)
    return signals.composite(rows, found).select("event_id", "n_comments", "anomaly_score", "signals", "n_suspicious", "anomaly_pct")


@query(f"""
    select {DAY} as event_id, count(*) filter ({STANCE} = 'negative') as n_negative, count(*) filter ({STANCE} = 'neutral') as n_neutral,
        count(*) filter ({STANCE} = 'positive') as n_positive, count(*) as sample_size,
        avg(case {STANCE} when 'positive' then 1 when 'negative' then -1 else 0 end) as score,
        case when avg(case {STANCE} when 'positive' then 1 when 'negative' then -1 else 0 end) > 0.15 then 'positive'
             when avg(case {STANCE} when 'positive' then 1 when 'negative' then -1 else 0 end) < -0.15 then 'negative' else 'neutral' end as label
    from events group by 1""")
def stance_distribution(spark, sf_dir):
    return sentiment.distribution(comments(spark, sf_dir, "day"))


@query("""
    with c as (select conv_id, turn, case role when 'user' then 'negative' when 'assistant' then 'positive' else 'neutral' end as stance,
        trim(regexp_replace(text, '\\s+', ' ', 'g')) as flat from conversations),
    r as (select *, row_number() over (partition by conv_id, stance order by turn) as k from c)
    select conv_id as event_id, case stance when 'negative' then 0 when 'neutral' then 1 else 2 end as place, cast(k as int) as no, stance,
        case when length(flat) > 240 then concat(rtrim(substring(flat, 1, 240)), '…') else flat end as text
    from r where k <= 2""")
def sample_per_stance(spark, sf_dir):
    stance = F.when(F.col("role") == "user", "negative").when(F.col("role") == "assistant", "positive").otherwise("neutral")
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("event_id"), F.col("turn").alias("comment_id"), stance.alias("stance"), "text")
    return sentiment.samples(rows)


@query("select event_id, ts, user_id, event_type, value, props from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_per_user(spark, sf_dir):
    return tables.latest(read(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("""
    with last as (select l_orderkey, max(l_shipdate) as last_at from lineitem group by 1)
    select o_orderkey as event_id from orders left join last on l_orderkey = o_orderkey
    where o_orderstatus = 'F' and (last_at is null or (o_orderdate >= timestamp '1997-12-01' and last_at <= timestamp '1998-11-30 18:00:00'))""")
def stale_refresh(spark, sf_dir):
    collected = lines_as_articles(spark, sf_dir).select("event_id", F.col("published_at").alias("collected_at"))
    return sentiment.to_refresh(orders_as_events(spark, sf_dir), collected, AS_OF, days=365, hours=6).select("event_id")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def figures_without_events(spark, sf_dir):
    return tables.orphans(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def figures_with_events(spark, sf_dir):
    return tables.with_children(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


@query("""
    with new as (select l_orderkey, l_partkey, l_linenumber from lineitem qualify row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) = 1)
    select p_partkey as key, p_name as label from part
    union all select l_partkey, concat('order ', l_orderkey) from new where l_partkey not in (select p_partkey from part)""")
def insert_if_absent(spark, sf_dir):
    base = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("label"))
    new = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("label"), "l_orderkey", "l_linenumber")
    return tables.insert_if_absent(base, new, "key", "l_orderkey", "l_linenumber")


@query("""
    with last as (select o_custkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
    select c_custkey as key, coalesce(o_orderstatus, 'none') as status from customer left join last on o_custkey = c_custkey
    union all select o_custkey, o_orderstatus from last where o_custkey not in (select c_custkey from customer)""")
def upsert(spark, sf_dir):
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("none").alias("status"))
    last = tables.latest(read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderdate", "o_orderkey")
    return tables.upsert(base, last.select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")), "key")


@query("""
    with c as (select l_orderkey, max(l_returnflag) as flag from lineitem group by 1)
    select o_orderkey as key, coalesce(flag, o_orderstatus) as status, o_totalprice as price from orders left join c on l_orderkey = o_orderkey""")
def update_by_key(spark, sf_dir):
    base = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    changes = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_returnflag").alias("status"))
    return tables.update(base, changes, "key")


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def delete_by_key(spark, sf_dir):
    gone = read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.delete(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_orderkey")


@query("""
    select c_custkey as figure_id, c_name as name, count(o_orderkey) as n_events from customer
    left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1, 2""")
def figure_status_counts(spark, sf_dir):
    figures = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("figure_id"), F.col("c_name").alias("name"))
    return timeline.status_counts(figures, orders_as_events(spark, sf_dir), "approved")


@query("select o_custkey as figure_id, count(*) as n_events from orders group by 1 order by max(o_orderdate) desc nulls first, 1")
def figure_counts(spark, sf_dir):
    return timeline.figure_counts(orders_as_events(spark, sf_dir))


@query("""
    select o_custkey as figure_id, count(*) as n_rows, count(distinct o_orderkey) as n_events, count(distinct l_suppkey) as n_outlets
    from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def figure_meta(spark, sf_dir):
    return timeline.figure_meta(orders_as_events(spark, sf_dir), lines_as_articles(spark, sf_dir))


@query("""
    select o_orderkey as event_id, count(*) as n_rows, count(distinct l_suppkey) as n_outlets, max(c_mktsegment) as label
    from orders left join lineitem on l_orderkey = o_orderkey left join customer on c_custkey = o_custkey group by 1""")
def figure_events_fanout(spark, sf_dir):
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("figure_id"), F.col("c_mktsegment").alias("label"))
    return timeline.events_fanout(orders_as_events(spark, sf_dir), lines_as_articles(spark, sf_dir), people)


@query("""
    with a as (select l_orderkey, string_agg(concat(strftime(l_shipdate, '%Y-%m-%d'), '/', l_suppkey, '/', l_partkey), ' ' order by l_shipdate, l_linenumber, l_suppkey, l_partkey) as articles, count(*) as n from lineitem group by 1)
    select o_orderkey as event_id, o_orderdate as event_date, articles, coalesce(n, 0) as n_articles from orders left join a on l_orderkey = o_orderkey where o_orderstatus = 'O'""")
def review_queue_nested(spark, sf_dir):
    events = orders_as_events(spark, sf_dir)
    summaries = events.select("event_id", F.lit("").alias("summary_text"), F.array("title").alias("citations"), F.lit(0).alias("single_source_flag"))
    lines = lines_as_articles(spark, sf_dir).select("event_id", "published_at", F.col("no").alias("article_id"), "source", F.col("article_id").cast("string").alias("title"), F.lit("").alias("url"))
    rows = timeline.queue(events, summaries, lines)
    text = F.array_join(F.transform("articles", lambda x: F.concat_ws("/", F.date_format(x["published_at"], "yyyy-MM-dd"), x["source"].cast("string"), x["title"])), " ")
    return rows.select("event_id", "event_date", text.alias("articles"), F.when(F.col("articles").isNotNull(), long(F.size("articles"))).otherwise(F.lit(0).cast("long")).alias("n_articles"))


@query("""
    with last as (select l_orderkey, l_linestatus, l_quantity from lineitem qualify row_number() over (partition by l_orderkey order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_suppkey desc) = 1)
    select o_orderkey as event_id, o_custkey as figure_id, l_linestatus as label, l_quantity as score from orders left join last on l_orderkey = o_orderkey where o_orderstatus = 'F'""")
def timeline_latest(spark, sf_dir):
    events = orders_as_events(spark, sf_dir)
    number = F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("sentiment_id")
    moods = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), number, F.col("l_shipdate").alias("collected_at"), F.lit("").alias("channel"), F.col("l_quantity").alias("score"), F.col("l_linestatus").alias("label"), F.lit(1).alias("sample_size"))
    return timeline.timeline(events, events.select("event_id", F.lit("").alias("summary_text")), moods).select("event_id", "figure_id", "label", "score")


@query("""
    select o_custkey as figure_id, round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 6) as score from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def average_by_figure(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("sample_size"))
    return sentiment.average_by_figure(orders_as_events(spark, sf_dir), lines).withColumn("score", F.round("score", 6))


@query("""
    select doc_id as event_id, source as figure_id from documents where source <> 'src0' and contains(lower(text), 'worthless') order by doc_id limit 5""")
def related_topk(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    events = docs.select(F.col("doc_id").alias("event_id"), F.col("source").alias("figure_id"), F.lit("approved").alias("status"), F.lit(None).cast("timestamp").alias("event_date"))
    summaries = docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("summary_text"))
    return timeline.related(events, summaries, "src0", "Worthless").select("event_id", "figure_id")


@query("""
    select md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as event_id, count(distinct source) as n_outlets, count(*) as n_articles,
        count(distinct source) < 2 as single_source, string_agg(distinct source, ',' order by source) as outlets
    from documents group by 1""")
def corroboration(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.md5(F.lower(t.collapsed("text"))).alias("event_id"), "source")
    return timeline.corroboration(docs).withColumn("outlets", F.array_join("outlets", ","))


@query("""
    select doc_id, case when contains(lower(text), 'wereld') or contains(lower(text), 'thanthed') then 'alpha' when contains(lower(text), 'heit') or contains(lower(text), 'lich') then 'beta'
        when contains(lower(text), 'ción') or contains(lower(text), 'mente') then 'gamma' else 'delta' end as figure_id
    from documents where contains(lower(text), 'wereld') or contains(lower(text), 'thanthed') or contains(lower(text), 'heit') or contains(lower(text), 'lich')
        or contains(lower(text), 'ción') or contains(lower(text), 'mente') or contains(lower(text), 'the')""")
def attribute_contains(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("summary"))
    return timeline.attributed(docs, TERMS).select("doc_id", "figure_id")


@query(SQL["attribute_contains"])
def attribute_by_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.lit("").alias("title"), F.col("text").alias("summary"))
    terms = spark.createDataFrame([(i, f, term) for i, (f, names) in enumerate(TERMS) for term in names], "figure_ord int, figure_id string, term string")
    return timeline.attributed_by_table(docs, terms).select(F.col("article_id").alias("doc_id"), "figure_id")


#: Names: the words of six letters and more that documents begin with, in the order of the first document of each.
_NAMES = """
    with n as (select regexp_extract(text, '^[A-Z][a-z]{5,}') as name, min(doc_id) as first_doc from documents group by 1 having name <> ''),
    p as (select concat('(', string_agg(name, '|' order by first_doc, name), ')') as given, concat('(', string_agg(name, '|' order by length(name) desc, name), ')') as longest from n)"""


def first_words(docs: DataFrame) -> DataFrame:
    names = docs.select("doc_id", F.regexp_extract("text", "^[A-Z][a-z]{5,}", 0).alias("name")).filter("name <> ''")
    return names.groupBy("name").agg(F.min("doc_id").alias("name_ord"))


@query(f"""{_NAMES},
    s as (select doc_id, regexp_extract_all(text, given) as names, list_filter(string_split(regexp_replace(text, given, concat(chr(1), '\\1', chr(1)), 'g'), chr(1)), lambda x: x <> '') as parts from documents, p)
    select doc_id, array_to_string(names, '|') as names, cast(len(parts) as bigint) as n_segments from s""")
def name_segments(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    cut = segments_by_table(docs.select("doc_id", "text"), "text", first_words(docs))
    names = F.transform(F.filter("segments", lambda s: s["is_name"]), lambda s: s["text"])
    return cut.select("doc_id", F.array_join(names, "|").alias("names"), long(F.size("segments")).alias("n_segments"))


_ESCAPED = "replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&#34;'), chr(39), '&#39;'), chr(10), '<br>')"


@query(f"""{_NAMES},
    m as (select doc_id, string_split(regexp_replace({_ESCAPED}, longest, concat(chr(1), '\\1', chr(2)), 'gi'), chr(1)) as parts from documents, p)
    select doc_id, concat(parts[1], array_to_string(list_transform(parts[2:], lambda x: concat('<a href="/figure/', lower(split_part(x, chr(2), 1)), '" class="fig-link">',
        upper(x[1]), lower(split_part(x[2:], chr(2), 1)), '</a>', split_part(x, chr(2), 2))), '')) as linked from m""")
def linked_names(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    names = first_words(docs).select("name", F.lower("name").alias("page"))
    return linked_by_table(docs.select("doc_id", "text"), "text", names, out="text").select("doc_id", F.col("text").alias("linked"))


@query("""
    select cast(user_id as varchar) as video_id, cast(0 as int) as comment_ord, props as text, cast(user_id as varchar) as author_id, cast(event_id as varchar) as author_name, cast(event_id % 50 as int) as like_count, ts as published_at
    from events where length(props) > 0
    union all select cast(user_id as varchar), 1, event_type, null, cast(event_id as varchar), 0, null from events where length(event_type) > 0""")
def thread_function(spark, sf_dir):
    """Each event is a response with two comments, the second without shown text, author, likes and readable date."""
    threads.register(spark)
    channel, name = F.struct(F.col("user_id").cast("string").alias("value")), F.col("event_id").cast("string").alias("authorDisplayName")
    shown = F.struct(F.col("props").alias("textDisplay"), channel.alias("authorChannelId"), name, (F.col("event_id") % 50).alias("likeCount"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("publishedAt"))
    other = F.struct(F.lit("").alias("textDisplay"), F.col("event_type").alias("textOriginal"), name, F.lit("soon").alias("publishedAt"))
    whole = lambda s: F.to_json(F.struct(F.struct(F.struct(s.alias("snippet")).alias("topLevelComment")).alias("snippet")))
    body = F.concat(F.lit('{"items":['), F.concat_ws(",", whole(shown), whole(other)), F.lit("]}"))
    responses = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"), body.alias("value"))
    return spark.sql("""
        select video_id, comment_ord, text, author_id, author_name, like_count, try_to_timestamp(published) as published_at
        from thread_comments(table(select * from {responses}) partition by (video_id), 100)""", responses=responses)


@query("select sha256(url) as article_id, min(page_id) as page_id, first(url order by page_id) as url from pages where length(url) > 0 group by 1")
def url_dedupe(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").filter(F.length("url") > 0).select(t.url_id("url").alias("article_id"), "page_id", "url")
    return tables.first_of_each(pages, "article_id", "page_id")


_TOKENS = (
    "list_distinct(list_filter(list_transform(regexp_extract_all(text, '[a-zA-ZÀ-ɏ]+'), lambda w: lower(w)), lambda w: length(w) > 2 and w not in "
    + "(" + ", ".join(f"'{w}'" for w in t.STOPWORDS) + ")))"
)


@query(f"select doc_id, cast(len({_TOKENS}) as bigint) as n_tokens from documents")
def token_sets(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", long(F.size(t.tokens("text"))).alias("n_tokens"))


@query(f"""
    with d as (select doc_id, source, {_TOKENS} as words from documents), p as (select *, lag(words) over (partition by source order by doc_id) as before from d)
    select doc_id, cast(len(list_intersect(words, before)) as bigint) as n_shared from p where before is not null""")
def shared_tokens(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    before = F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))  # narrow rows; the words are joined
    pairs = docs.select("doc_id", before.alias("before")).filter("before is not null")
    words = docs.select("doc_id", t.tokens("text").alias("words"))
    both = pairs.join(words, "doc_id").join(words.select(F.col("doc_id").alias("before"), F.col("words").alias("held")), "before")
    return both.select("doc_id", long(t.shared("words", "held")).alias("n_shared"))


@query("""
    select doc_id, case when regexp_matches(lower(text), '\\b(heit|keit)\\b') then 'german' when regexp_matches(lower(text), '\\b(mente|ado)\\b') then 'spanish'
        when regexp_matches(lower(text), '\\b(ment|eux)\\b') then 'french' when regexp_matches(lower(text), '\\b(the|that)\\b') then 'english' else 'other' end as event_type
    from (select doc_id, regexp_replace(text, '[^a-zA-Z]+', ' ', 'g') as text from documents)""")
def event_type_infer(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^a-zA-Z]+", " ").alias("text"))
    return docs.select("doc_id", t.first_rule("text", RULES, "other").alias("event_type"))


@query("""
    select source as event_id, case min(case when regexp_matches(x, '\\b(heit|keit)\\b') then 0 when regexp_matches(x, '\\b(mente|ado)\\b') then 1
        when regexp_matches(x, '\\b(ment|eux)\\b') then 2 when regexp_matches(x, '\\b(the|that)\\b') then 3 else 4 end)
        when 0 then 'german' when 1 then 'spanish' when 2 then 'french' when 3 then 'english' else 'other' end as event_type
    from (select source, lower(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')) as x from documents) group by 1""")
def event_types_by_event(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("event_id"), F.regexp_replace("text", "[^a-zA-Z]+", " ").alias("text"))
    return clustering.event_types(docs, RULES)


@query("""
    with f as (select doc_id, source, string_split(text, chr(10))[1] as line from documents),
    w as (select *, list_filter(string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' '), lambda x: x <> '' and lower(x) not in ('the', 'of', 'and', 'de', 'la', 'der', 'die')) as words from f)
    select doc_id, trim(case when contains(lower(line), lower(source)) then array_to_string(words[1:7], ' ') else concat_ws(' ', source, array_to_string(words[1:7], ' ')) end) as query from w""")
def query_builder(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.substring_index("text", "\n", 1).alias("line"))
    built = t.search_query("line", "source", F.array("source"), ["the", "of", "and", "de", "la", "der", "die"])
    return docs.select("doc_id", built.alias("query"))


@query("""
    with x as (select n_nationkey, unnest(list_filter([n_nationkey, n_regionkey], lambda k: k between 1 and 5)) as no from nation),
    r as (select row_number() over (order by r_regionkey) as no, r_name from region)
    select n_nationkey, cast(x.no - 1 as int) as document_index, r_name as document_title from x join r on r.no = x.no""")
def citation_extract(spark, sf_dir):
    names = read(spark, sf_dir, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"]).alias("titles"))
    text = F.concat(F.lit("a [Sumber "), F.col("n_nationkey").cast("string"), F.lit("] b [Sumber "), F.col("n_regionkey").cast("string"), F.lit("]."))
    rows = read(spark, sf_dir, "nation").crossJoin(F.broadcast(names))  # one row
    return rows.select("n_nationkey", F.explode(t.citations(text, "titles")).alias("c")).select("n_nationkey", "c.*")


@query("""
    select event_id, concat(day(ts), ' ', ['Januari','Februari','Maret','April','Mei','Juni','Juli','Agustus','September','Oktober','November','Desember'][month(ts)], ' ', year(ts), ' ', strftime(ts, '%H:%M')) as shown from events""")
def local_dates(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", t.local_date(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("shown"))


@query("""
    with s as (select event_id, cast(event_id % 201 - 100 as int) as score from events)
    select event_id, case when score <= -40 then 'Mayoritas menolak' when score <= -10 then 'Cenderung negatif' when score < 16 then 'Terbelah / netral' when score < 46 then 'Cenderung positif' else 'Mayoritas mendukung' end as band,
        case when score <= -10 then '#c0392b' when score < 16 then '#9b7b3f' else '#2e7a52' end as colour,
        concat(printf('%.1f', (score + 100) / 2.0::double), '%') as place, concat(case when score < 0 then '−' else '+' end, abs(score)) as shown from s""")
def score_bands(spark, sf_dir):
    score = (F.col("event_id") % 201 - 100).cast("int")
    rows = read(spark, sf_dir, "events").select("event_id", score.alias("score"))
    return rows.select("event_id", display.band("score", display.SCORE_LABELS).alias("band"), display.band("score", display.SCORE_COLOURS).alias("colour"), display.score_place("score").alias("place"), display.signed("score").alias("shown"))


@query("select strftime(o_orderdate, '%Y-%m') as month, count(*) as n, min(o_orderdate) as first_at, max(o_orderdate) as last_at from orders group by 1")
def month_groups(spark, sf_dir):
    return timeline.by_month(read(spark, sf_dir, "orders"), "o_orderdate")


@query("select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(t.json_field("props", "k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double))"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("group_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("place"), F.col("vec_id").alias("at"))


@query(f"select a.label as group_id, a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where {_DOT} >= 0.35")
def cosine_pairs(spark, sf_dir):
    return timeline.similar_pairs(_vectors(spark, sf_dir), 0.35).select("group_id", "a", "b")


@query(f"""
    with p as (select a.vec_id as a, b.vec_id as b, {_DOT} as s from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where {_DOT} >= 0.35),
    d as (select a as id, 'next' as direction, b as other, s from p union all select b, 'previous', a, s from p)
    select id, direction, other from d qualify row_number() over (partition by id, direction order by s desc, other) = 1""")
def follow_links(spark, sf_dir):
    return timeline.follow_links(_vectors(spark, sf_dir), 0.35).select("id", "direction", "other")


@query("""
    with m as (select label, pos, avg(embedding[pos]::double) as x from embeddings, range(1, 65) r(pos) group by 1, 2)
    select label, cast(pos as int) as pos, round(x / sqrt(sum(x * x) over (partition by label)), 6) as x from m""")
def centroid_by_label(spark, sf_dir):
    means = mean_vector(read(spark, sf_dir, "embeddings"), "label", "embedding", 64)
    return means.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", (F.col("pos") + 1).alias("pos"), F.round("x", 6).alias("x"))


@query("""
    with n as (select doc_id, source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as x from documents)
    select doc_id from n where length(x) >= 15 and x in (select x from n group by 1 having count(distinct source) > 1)""")
def exact_copypasta(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("author_id"), "text")
    return signals.exact_copies(rows).select("doc_id")


@query()
def fuzzy_copypasta(spark, sf_dir):
    """No SQL: the indel ratio is not built in. Tested against all pairs. Over all documents, whole, of their sources."""
    rows = read(spark, sf_dir, "documents").select(F.lit(0).alias("event_id"), F.col("doc_id").alias("comment_id"), F.col("source").alias("author_id"), "text")
    return signals.copypasta(rows).select("event_id", "comment_id")


@query()
def html_paragraphs(spark, sf_dir):
    """No SQL: a parser's state. Tested on hand-made pages."""
    body = paragraphs("html")
    return read(spark, sf_dir, "pages").select("page_id", body.alias("body")).select("page_id", "body", F.when(F.col("body").isNull(), "error:extract").otherwise("ok").alias("status"))


_FREQUENT = ", ".join("{'n': len(list_filter(words, lambda w: w in (" + ", ".join(f"'{w}'" for w in words) + f"))), 'place': {-i}, 'name': '{name}'}}" for i, (name, words) in enumerate(sorted(FREQUENT.items())))


@query(f"""
    with w as (select doc_id, length(trim(text)) as n, regexp_extract_all(lower(trim(text)), '[\\p{{L}}\\p{{N}}_]+') as words from documents),
    b as (select doc_id, n, list_sort([{_FREQUENT}])[-1] as best from w)
    select doc_id, case when n < 20 or best.n = 0 then 'id' else best.name end as language from b""")
def detect_language(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", language("text").alias("language"))


_SAID = "pidato|debat|unjuk rasa|peraturan|kunjungan|rapat|wawancara|jumpa pers|pernyataan|pelantikan|putusan|pemilu|kandidat|mundur|cuaca".split("|")
_RULE_CASES = " ".join(f"when regexp_matches(said, '{pattern}') then '{name}'" for pattern, name in clustering.EVENT_TYPES)


@query(f"""
    with s as (select event_id, concat('Hari ini ', [{', '.join(f"'{w}'" for w in _SAID)}][event_id % {len(_SAID)} + 1], ' dan ', [{', '.join(f"'{w}'" for w in _SAID)}][user_id % {len(_SAID)} + 1], ' lagi') as said from events)
    select event_id, case {_RULE_CASES} else 'other' end as event_type from s""")
def event_type_rules(spark, sf_dir):
    """The fourteen rules over sentences made of their words."""
    said = t.literals(_SAID)
    word = lambda c: F.element_at(said, (F.col(c) % len(_SAID) + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Hari ini "), word("event_id"), F.lit(" dan "), word("user_id"), F.lit(" lagi")).alias("said"))
    return rows.select("event_id", t.first_rule("said", clustering.EVENT_TYPES, "other").alias("event_type"))


@query()
def greedy_cluster(spark, sf_dir):
    """No SQL: each step depends on all before. Tested against a plain loop."""
    at = F.timestamp_micros((F.lit(1_700_000_000) + F.col("vec_id") * 600) * 1_000_000)
    words = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), t.tokens("text").alias("tokens"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("figure_id"), F.col("vec_id").alias("article_id"), at.alias("published_at"), "embedding").join(words, "article_id", "left")
    return clustering.cluster(rows.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))), clustering.Params(least_similarity=0.3))


@query("select date_trunc('hour', ts)::timestamp as start_at, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def hourly_window(spark, sf_dir):
    rows = streams.volume(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
    return rows.withColumn("start_at", F.col("start_at").cast("timestamp_ntz"))


@query("""
    with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
    s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as no from g)
    select user_id, min(ts) as start_at, max(ts) + interval 30 minutes as end_at, count(*) as n from s group by user_id, no""")
def session_windows(spark, sf_dir):
    rows = streams.sessions(read(spark, sf_dir, "events"))
    return rows.withColumn("start_at", F.col("start_at").cast("timestamp_ntz")).withColumn("end_at", F.col("end_at").cast("timestamp_ntz"))


_TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query(" union all ".join(f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in _TABLES))
def table_counts(spark, sf_dir):
    return landed.table_counts({n: read(spark, sf_dir, n) for n in _TABLES})


@query("""
    with v as (select *, chr(39) as q from customer)
    select concat('INSERT INTO customer (c_custkey, c_name, c_mktsegment', case when c_nationkey > 0 then ', c_nationkey' else '' end, ') VALUES (', q, c_custkey, q, ', ', q, replace(c_name, '#', concat(q, q)), q, ', ', q, c_mktsegment, q,
        case when c_nationkey > 0 then concat(', ', q, c_nationkey, q) else '' end, ');') as statement from v""")
def sql_dump(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("'")).alias("c_name"), "c_mktsegment", F.when(F.col("c_nationkey") > 0, F.col("c_nationkey")).alias("c_nationkey"))
    return landed.sql_dump(rows, "customer")


@query("select distinct event_type, upper(substring(event_type, 1, 1)) as initial, lpad(cast(length(event_type) as varchar), 2, '0') as no from events order by 1")
def filter_chips(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type").distinct()
    return rows.select("event_type", F.upper(display.initial("event_type")).alias("initial"), display.ordinal(F.length("event_type")).alias("no")).orderBy("event_type")


@query("""
    select event_id, user_id from (select event_id, user_id, row_number() over (partition by user_id, event_type order by event_id) as r, event_type from events)
    where r <= 3 qualify row_number() over (partition by user_id order by event_type, event_id) <= 10""")
def capped_gather(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return tables.capped_gather(rows, "user_id", "event_type", "event_type", "event_id", 3, 10).select("event_id", "user_id")


@query("""
    with s as (select event_id, cast(event_id % 201 - 100 as int) as score, value from events)
    select event_id, case when score <= -40 then '😡' when score <= -10 then '🙁' when score < 16 then '😐' when score < 46 then '🙂' else '😄' end as emoji,
        case when score > 30 then '😊' when score > 10 then '🙂' when score > -10 then '😐' when score > -30 then '🙁' else '😠' end as record,
        lpad(cast(event_id % 100 as varchar), 2, '0') as no, least(event_id, 100) as clamped from s""")
def display_values(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 201 - 100).cast("int").alias("score"))
    return rows.select("event_id", display.band("score", display.SCORE_EMOJI).alias("emoji"), display.band("score", display.RECORD_EMOJI).alias("record"), display.ordinal(F.col("event_id") % 100).alias("no"), long(display.clamped("event_id", 100)).alias("clamped"))


@query("""
    select event_id, concat(day(ts), ' ', strftime(ts, '%b')) as badge, ['Januari','Februari','Maret','April','May','Juni','Juli','Aug','September','Oct','November','Dec'][month(ts)] as month,
        cast(year(ts) as varchar) as year from events""")
def short_dates(spark, sf_dir):
    """English short months that the table does not know stay as they are."""
    shown = display.short_date(F.date_format("ts", "d MMM yyyy"))
    return read(spark, sf_dir, "events").select("event_id", shown.alias("d")).select("event_id", "d.badge", "d.month", "d.year")


@query("select o_orderkey as event_id, coalesce(c_name, cast(o_custkey as varchar)) as name from orders left join (select * from customer where c_custkey % 3 > 0) on c_custkey = o_custkey")
def named_figures(spark, sf_dir):
    figures = read(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").cast("string").alias("figure_id"), F.col("c_name").alias("name"))
    rows = orders_as_events(spark, sf_dir).select("event_id", F.col("figure_id").cast("string").alias("figure_id"))
    return timeline.named(rows, figures).select("event_id", "name")


@query("select l_orderkey as event_id, l_linenumber as article_id, cast(row_number() over (partition by l_orderkey order by l_shipdate nulls first, l_linenumber) as int) as citation_no from lineitem")
def numbered_sources(spark, sf_dir):
    lines = lines_as_articles(spark, sf_dir).select("event_id", "published_at", F.col("no").alias("article_id"))
    return pipeline.numbered_sources(lines).select("event_id", "article_id", "citation_no")


_STATUS = "case o_orderstatus when 'F' then 'approved' when 'O' then 'summarized' else 'new' end"


@query(f"select o_custkey as event_id, {_STATUS} as status from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, {_STATUS} desc) = 1")
def current_status(spark, sf_dir):
    log = orders_as_events(spark, sf_dir).select(F.col("figure_id").alias("event_id"), F.col("event_date").alias("at"), "status")
    return pipeline.current_status(log)


@query("""
    with c as (select l_orderkey, max(l_shipdate) as last_at from lineitem group by 1)
    select o_orderkey as event_id from orders join c on l_orderkey = o_orderkey where o_orderstatus <> 'F' or last_at > o_orderdate + interval 100 days""")
def to_analyse(spark, sf_dir):
    events = orders_as_events(spark, sf_dir)
    analysed = events.filter(F.col("status") == "approved").select("event_id", (F.col("event_date") + F.expr("interval 100 days")).alias("analyzed_at"))
    collected = lines_as_articles(spark, sf_dir).select("event_id", F.col("published_at").alias("collected_at"))
    return signals.to_analyse(events.select("event_id"), analysed, collected)


@query("select p_partkey as article_id from part where p_size % 4 < 2 order by p_partkey limit 50")
def fetch_queue(spark, sf_dir):
    state = F.when(F.col("p_size") % 4 == 1, "error:empty").when(F.col("p_size") % 4 > 1, "ok")
    articles = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("article_id"), state.alias("fetch_status"), F.lit(None).cast("timestamp").alias("fetched_at"))
    return pipeline.to_fetch(articles, retry_failed=True, limit=50).select("article_id")


@query("select doc_id as article_id from documents where length(text) > 0 and lang <> 'fr' and source not in ('src0', 'src3') order by doc_id limit 100")
def translate_queue(spark, sf_dir):
    body, done = F.when(F.length("text") > 0, F.col("text")), F.when(F.col("lang") == "fr", "was")
    articles = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.concat(F.lit("YouTube/"), "source").alias("source"), body.alias("body"), done.alias("body_original"))
    return pipeline.to_translate(articles, ("src0", "src3"), 100).select("article_id")


_LINE = (
    "case event_id % 8 when 0 then concat(event_id, '. ', {s}) when 1 then concat(event_id, ')', upper({s}), ' - it is') when 2 then '' when 3 then concat('I would say ', {s}, '  ') "
    "when 4 then concat('1. what ', {s}) when 5 then concat('99999999999999. ', {s}) when 6 then concat('- ', {s}, '.') else concat(' ', event_id, '.  ', {s}, ': so') end"
).format(s=f"({STANCE})")


@query(f"""
    with l as (select user_id, event_id, lower(trim({_LINE})) as line from events),
    w as (select user_id, event_id, case when regexp_matches(line, '^[0-9]+[.)]\\s*\\w') then regexp_extract(line, '^[0-9]+[.)]\\s*(\\w+)', 1) else regexp_extract(line, '(\\S*)$', 1) end as word from l),
    g as (select user_id, count(*) as n, coalesce(list(word order by event_id) filter (word in ('positive', 'neutral', 'negative')), []) as found from w group by 1)
    select user_id, n, array_to_string(list_concat(found, list_transform(range(n), lambda i: 'neutral'))[1:n], ' ') as labels from g""")
def reply_labels(spark, sf_dir):
    """A reply a user, a line for each event: numbered, blank, with explanations, without number, and out of bounds."""
    lines = read(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_LINE).alias("line"))
    replies = lines.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("reply"))
    return replies.select("user_id", "n", F.array_join(t.labels("reply", "n", list(t.STANCES), "neutral"), " ").alias("labels"))


@query("""
    with m as (select l_partkey from lineitem where l_partkey % 5 < 4), k as (select l_partkey, count(*) as n from m group by 1)
    select (select count(*) from lineitem) as fetched, cast(sum(n) as bigint) as matched, count(*) filter (l_partkey % 2 = 1) as inserted,
        cast(sum(n) as bigint) - count(*) filter (l_partkey % 2 = 1) as skipped_existing from k""")
def ingest_counts(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("article_id"))
    known = read(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("article_id"))
    return landed.ingest_counts(lines, lines.filter("article_id % 5 < 4"), known)


@query("""
    with h as (select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages)
    select page_id, case when contains(lower(host), 'news') then 'first' when contains(lower(host), 'a') then 'second' else 'third' end as channel
    from h where contains(lower(host), 'news') or contains(lower(host), 'a') or contains(lower(host), 'e')""")
def channel_names(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("channel"))
    return landed.international_videos(rows, [("news", "first"), ("a", "second"), ("e", "third")])


@query("""
    select page_id, md5(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;'), chr(10), '<br>')) as escaped from pages""")
def html_escaped(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(t.html_escaped("html")).alias("escaped"))


@query("select doc_id, case lang when 'en' then 'English' when 'fr' then 'Français' when 'es' then 'Español' when 'de' then 'Deutsch' else coalesce(upper(lang), 'original') end as language from documents")
def language_names(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", display.language_name("lang").alias("language"))
