"""Text and display functions as Column expressions; survey ids in brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of a token, stopwords of the lexical guard, months, stance scores, language names.
TOKEN = "[a-zA-ZÀ-ɏ]+"
STOPWORDS = (
    "yang dan di ke dari untuk dengan pada ini itu akan ada atau juga tidak dalam sebagai oleh para the a an of to in on for and is are"
).split()
MONTHS = "Januari Februari Maret April Mei Juni Juli Agustus September Oktober November Desember".split()
QUERY_STOPWORDS = "dan di ke dari yang untuk dengan pada bahas soal hingga akan bakal buka suara kabar kemarin".split()
STANCES = {"positive": 1, "neutral": 0, "negative": -1}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def non_empty(x: str | Column, other: Column | None = None) -> Column:
    """[P14] The value unless it is null or empty."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), other if other is not None else F.lit(None))


def url_id(x: str | Column) -> Column:
    """Key of an article."""
    return F.sha2(_c(x), 256)


def joined_text(title: str, summary: str, body: str) -> Column:
    """Title, summary and body on lines of their own, without empty ones."""
    return F.concat_ws("\n", _c(title), non_empty(summary), non_empty(body))


def collapsed(x: str | Column) -> Column:
    """White space of any script as single spaces, trimmed."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def tokens(x: str | Column, exclude: list[str] | None = None) -> Column:
    """The set of lowered words of three letters and more, without stopwords and excluded terms."""
    words = F.transform(F.regexp_extract_all(_c(x), F.lit(f"({TOKEN})"), F.lit(1)), F.lower)
    kept = F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))
    return F.array_except(kept, literals([*STOPWORDS, *(exclude or [])]))


def shared(a: str | Column, b: str | Column) -> Column:
    """[U-2] Size of the intersection."""
    return F.size(F.array_intersect(_c(a), _c(b)))


def sorted_tokens(x: str | Column) -> Column:
    """The words in order, joined by spaces: what a token sort ratio compares."""
    return F.array_join(F.array_sort(F.split(collapsed(x), " ")), " ")


def ellipsis(x: str | Column, n: int) -> Column:
    """[F8] At most n characters; a longer text loses trailing space and gains an ellipsis."""
    return F.when(F.length(_c(x)) > n, F.concat(F.rtrim(F.substring(_c(x), 1, n)), F.lit("…"))).otherwise(_c(x))


def contains_any(text: str | Column, terms: list[tuple[str, str]]) -> Column:
    """[F2, J3] The value of the first (value, term) whose term the lowered text holds, or null."""
    low, out = F.lower(_c(text)), None
    for value, term in terms:
        hit = low.contains(term.lower())
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out if out is not None else F.lit(None).cast("string")


def first_rule(text: str | Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first (pattern, value) that is found in the lowered text."""
    low, out = F.lower(_c(text)), None
    for pattern, value in rules:
        hit = low.rlike(pattern)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def search_query(title: str | Column, name: str | Column, aliases: str | Column, stopwords: list[str], words: int = 7) -> Column:
    """The first words of a title without stopwords, led by the name unless an alias stands in the title."""
    title = F.coalesce(_c(title), F.lit(""))
    kept = F.filter(F.split(collapsed(title), " "), lambda w: (w != "") & ~F.lower(w).isin(stopwords))
    phrase = F.array_join(F.slice(kept, 1, words), " ")
    named = F.exists(_c(aliases), lambda a: F.contains(F.lower(title), F.lower(a)))
    return F.trim(F.when(named, phrase).otherwise(F.concat_ws(" ", _c(name), phrase)))


def citations(text: str | Column, titles: str | Column, marker: str = "Sumber") -> Column:
    """Places cited as [marker n], as (document_index from 0, document_title); places out of range are left out."""
    numbers = F.transform(F.regexp_extract_all(_c(text), F.lit(rf"\[{marker} (\d+)\]"), F.lit(1)), lambda n: n.try_cast("int"))
    inside = F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(_c(titles))))
    return F.transform(inside, lambda n: F.struct((n - 1).alias("document_index"), F.element_at(_c(titles), n).alias("document_title")))


#: Where a text's lines end.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def labels(response: str | Column, n: str | Column, valid: list[str], default: str) -> Column:
    """The n labels of a reply, in the order of its lines: the word after a line's number, or the last word of a line without one.

    Lines whose word is no label do not count; labels that are missing are the default, and those beyond n are left out.
    """
    lines = F.transform(F.split(F.coalesce(_c(response), F.lit("")), LINE_END), lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    numbered = r"(?U)^\d+[.)]\s*(\w+)"

    def word(line: Column) -> Column:
        return F.when(line.rlike(numbered), F.regexp_extract(line, numbered, 1)).otherwise(F.regexp_extract(line, r"(?U)(\S*)$", 1))

    found = F.filter(F.transform(lines, word), lambda w: w.isin(valid))
    size = F.greatest(F.coalesce(_c(n).cast("int"), F.lit(0)), F.lit(0))
    return F.slice(F.concat(found, F.array_repeat(F.lit(default), size)), F.lit(1), size)


def timestamp_or(x: str | Column, other: Column | None = None) -> Column:
    """The time that a text says, in any ISO shape; another (null, if none is given) for null, empty and odd ones."""
    read = F.try_to_timestamp(F.nullif(F.trim(_c(x)), F.lit("")))
    return read if other is None else F.coalesce(read, other)


def json_text(x: str | Column) -> Column:
    """A nested value as JSON; null stays null, and fields that are null are written."""
    return F.to_json(_c(x), {"ignoreNullFields": "false"})


def json_field(x: str | Column, name: str) -> Column:
    """A field of a JSON text; null where the text is no JSON or lacks it."""
    return F.get_json_object(_c(x), f"$.{name}")


def json_length(x: str | Column) -> Column:
    """[F28, A20] Items of a JSON array; 0 for null and for what is none."""
    return F.coalesce(F.json_array_length(_c(x)), F.lit(0))


def stance_score(x: str | Column) -> Column:
    """[F46]"""
    out = None
    for stance, value in STANCES.items():
        out = F.when(_c(x) == stance, F.lit(value)) if out is None else out.when(_c(x) == stance, F.lit(value))
    return out


def stance_label(mean: str | Column, edge: float = 0.15) -> Column:
    """[A8]"""
    return F.when(_c(mean) > edge, "positive").when(_c(mean) < -edge, "negative").otherwise("neutral")


def local_date(x: str | Column) -> Column:
    """A day, month name, year and time, if any; text that is no date stays, null is empty."""
    x = _c(x)
    part = lambda pattern, i: F.regexp_extract(x, pattern, i)
    full = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}:\d{2}))?"
    month = F.when(part(full, 2) != "", part(full, 2).cast("int"))
    name = F.when(month.between(1, 12), F.element_at(literals(MONTHS), F.when(month.between(1, 12), month).otherwise(1)))
    day = F.concat_ws(" ", part(full, 3).cast("int").cast("string"), name, part(full, 1))
    return F.when(x.isNull(), "").when(name.isNull(), x).otherwise(F.concat(day, F.when(part(full, 4) != "", F.concat(F.lit(" "), part(full, 4))).otherwise("")))


def corroborated(outlets: str | Column) -> Column:
    """[F35]"""
    return F.when(_c(outlets) >= 2, "corroborated").otherwise("single source")


def html_escaped(x: str | Column) -> Column:
    """Markup characters as references, newlines as breaks."""
    out = _c(x)
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\n", "<br>")):
        out = F.replace(out, F.lit(plain), F.lit(reference))
    return out


def linked(x: str | Column, pages: dict[str, str]) -> Column:
    """Escaped text with every name as a link to its figure; longer names win, and links are never linked again."""
    import html
    import re

    if not pages:
        return html_escaped(x)
    plain = lambda n: html.escape(n).replace("&quot;", "&#34;").replace("&#x27;", "&#39;")
    names = sorted(pages, key=lambda n: (-len(n), n))
    marked = F.regexp_replace(html_escaped(x), "(?i)(" + "|".join(re.escape(plain(n)) for n in names) + ")", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    anchors = F.create_map(*(F.lit(y) for n in names for y in (plain(n).lower(), f'<a href="/figure/{pages[n]}" class="fig-link">{plain(n)}</a>')))

    def link(part: Column) -> Column:
        name = F.substring_index(part, "\u0002", 1)
        return F.concat(F.element_at(anchors, F.lower(name)), F.substring(part, F.length(name) + 2, F.length(part)))

    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), link), ""))


def segments(x: str | Column, names: list[str]) -> Column:
    """The text as an array of (text, is_name) in order. Names stand in their exact case; of two that begin together the first given counts."""
    import re

    if not names:
        return F.transform(F.filter(F.array(_c(x)), lambda p: p != ""), lambda p: F.struct(p.alias("text"), F.lit(False).alias("is_name")))
    marked = F.regexp_replace(_c(x), "(" + "|".join(re.escape(n) for n in names) + ")", "\u0001\u0002$1\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.replace(p, F.lit("\u0002"), F.lit("")).alias("text"), F.startswith(p, F.lit("\u0002")).alias("is_name")))


def sql_literal(x: str | Column) -> Column:
    """A value as SQL text."""
    return F.when(_c(x).isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(_c(x).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")))


def formatted_sources(articles: str | Column) -> Column:
    """Numbered source documents of an array of (source, published_at, title, summary, body)."""

    def one(a: Column, i: Column) -> Column:
        head = F.concat(F.lit("[Sumber "), (i + 1).cast("string"), F.lit("]: "), a["source"], F.lit(" — "), F.coalesce(a["published_at"].cast("string"), F.lit("")))
        return F.concat_ws("\n\n", head, a["title"], F.coalesce(F.nullif(a["body"], F.lit("")), a["summary"]))

    return F.array_join(F.transform(_c(articles), one), "\n\n---\n\n")
