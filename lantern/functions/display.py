"""How values are shown: bands, colours, names and formats, as Column expressions; survey ids in brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands of a score from -100 to 100 as (comparison, limit, value) in order, the last for the rest; colours, labels and names.
SCORE_LABELS = [("<=", -40, "Mayoritas menolak"), ("<=", -10, "Cenderung negatif"), ("<", 16, "Terbelah / netral"), ("<", 46, "Cenderung positif"), ("", 0, "Mayoritas mendukung")]
SCORE_EMOJI = [("<=", -40, "😡"), ("<=", -10, "🙁"), ("<", 16, "😐"), ("<", 46, "🙂"), ("", 0, "😄")]
SCORE_COLOURS = [("<=", -10, "#c0392b"), ("<", 16, "#9b7b3f"), ("", 0, "#2e7a52")]
RECORD_EMOJI = [("<=", -30, "😠"), ("<=", -10, "🙁"), ("<=", 10, "😐"), ("<=", 30, "🙂"), ("", 0, "😊")]
TYPE_COLOURS = {
    "Pidato": "#8b5e3c", "Debat": "#c0392b", "Demonstrasi": "#a93226", "Kebijakan": "#2e7a52", "Kunjungan": "#3a7ca5",
    "Pertemuan": "#5b6c8a", "Wawancara": "#7a6f58", "Konferensi Pers": "#6b3a6b", "Pernyataan": "#6b645b", "Pelantikan": "#9b7b3f",
    "Keputusan": "#c06a2b", "Pemilu": "#3a4a8b", "Pencalonan": "#8b5e3c", "Pengunduran Diri": "#8b2e1f", "other": "#6b645b",
}
SIGNAL_LABELS = {"cross_event": "Lintas peristiwa", "copypasta": "Teks serupa", "extremity": "Ekstrem", "velocity": "Kecepatan tinggi", "volume": "Dominasi volume"}
LANGUAGE_NAMES = {
    "en": "English", "ar": "العربية", "zh": "中文", "fr": "Français", "es": "Español", "de": "Deutsch", "ja": "日本語", "ko": "한국어", "pt": "Português", "ru": "Русский",
}
SHORT_MONTHS = {
    "Jan": "Januari", "Feb": "Februari", "Mar": "Maret", "Apr": "April", "Mei": "Mei", "Jun": "Juni",
    "Jul": "Juli", "Agu": "Agustus", "Sep": "September", "Okt": "Oktober", "Nov": "November", "Des": "Desember",
}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def band(score: str | Column, bands: list[tuple[str, float, str]]) -> Column:
    """The value of the first band that holds the score, whole or not."""
    out = F.lit(bands[-1][2])
    for how, limit, value in reversed(bands[:-1]):
        out = F.when(_c(score) <= limit if how == "<=" else _c(score) < limit, value).otherwise(out)
    return F.when(_c(score).isNotNull(), out)


def lookup(x: str | Column, names: dict[str, str], other: Column) -> Column:
    """[F36, F37, J21] The name of a key, or another value."""
    table = F.create_map(*(F.lit(y) for pair in names.items() for y in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(_c(x), F.lit(""))), other)


def signal_labels(signals: str | Column) -> Column:
    """Labels of a comma-joined list."""
    return F.array_join(F.transform(F.split(_c(signals), ","), lambda s: lookup(s, SIGNAL_LABELS, s)), ", ")


def language_name(code: str | Column) -> Column:
    """[F37]"""
    return lookup(code, LANGUAGE_NAMES, F.coalesce(F.nullif(F.upper(_c(code)), F.lit("")), F.lit("original")))


def short_date(x: str | Column) -> Column:
    """[F16] Day badge, month name and year of a date such as ``19 Jun 2026``."""
    part = F.split(_c(x), " ")
    month = F.get(part, F.lit(1))
    return F.struct(F.concat_ws(" ", F.get(part, F.lit(0)), month).alias("badge"), lookup(month, SHORT_MONTHS, month).alias("month"), F.get(part, F.lit(2)).alias("year"))


def score_place(x: str | Column) -> Column:
    """[F32] The place of a score on a scale of 0 to 100, in percent."""
    return F.format_string("%.1f%%", (_c(x) + 100) / F.lit(2.0))


def signed(x: str | Column) -> Column:
    """[F33]"""
    return F.concat(F.when(_c(x) < 0, "−").otherwise("+"), F.abs(_c(x)).cast("string"))


def signed_fixed(x: str | Column) -> Column:
    """[F43]"""
    return F.format_string("%+.2f", _c(x).cast("double"))


def ordinal(x: str | Column) -> Column:
    """[F44]"""
    return F.lpad(_c(x).cast("string"), 2, "0")


def logos(outlets: str | Column, names: dict[str, str]) -> Column:
    """[A24, J21] The logos of a list of outlets, each once, where it stands first; an outlet without one has its initial."""
    return F.array_distinct(F.transform(F.coalesce(_c(outlets), F.array().cast("array<string>")), lambda o: lookup(o, names, initial(o))))


def initial(x: str | Column) -> Column:
    """The first character of a name, or a question mark."""
    return F.substring(F.coalesce(F.nullif(_c(x), F.lit("")), F.lit("?")), 1, 1)


def request(base: str, **values: str | Column) -> Column:
    """An address with url-encoded parameters."""
    parts = [F.concat(F.lit(f"{name}="), F.url_encode(_c(v))) for name, v in values.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *parts))


def clamped(x: str | Column, most: int) -> Column:
    """[F42]"""
    return F.least(_c(x), F.lit(most))
