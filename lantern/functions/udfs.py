"""What the built-in functions cannot express, as Arrow-batched functions, and the pluggable providers.

A provider is a plain function over a batch (a list of texts); the defaults here are deterministic and
need neither network nor model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, groupby, pairwise
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose text is no paragraph, least lengths, languages' frequent words.
SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "form"}
PARAGRAPH_OVER, BODY_FROM = 40, 200
FREQUENT = {
    "en": "the and of to in is was that for with by it on as are this".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
    "id": "yang dan di dari untuk dengan pada ini itu akan ada atau juga tidak dalam sebagai oleh".split(),
}


class _Markup(HTMLParser):
    """What a page does, in order: (name, 1) for a tag that opens, (name, -1) for one that closes, (text, 0) for text."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, int]] = []
        self.handle_starttag = lambda name, _: self.seen.append((name, 1))
        self.handle_endtag = lambda name: self.seen.append((name, -1))
        self.handle_data = lambda text: self.seen.append((text, 0))
        self.feed(page)


def paragraphs_of(page: str | None) -> str | None:
    """[U1] The long paragraphs of a page, or None if they are short in all.

    The page is a line of events, over which two depths run that never fall below zero: of skipped elements, and of p elements opened outside
    those. Text counts where the first is zero and the second is not. Wherever the second falls, what counted since it last fell
    is a paragraph; so an unclosed p runs on, and text after a nested one belongs to the next to close.
    """
    seen = _Markup(page or "").seen

    def depth(steps: Iterable[int]) -> list[int]:
        return list(accumulate(steps, lambda deep, step: max(0, deep + step), initial=0))

    skipped = depth(step if name in SKIPPED else 0 for name, step in seen)
    inside = depth(step if name == "p" and (step < 0 or not out) else 0 for (name, step), out in zip(seen, skipped, strict=False))
    falls = list(accumulate((b < a for a, b in pairwise(inside)), initial=0))
    said = [(fall, text) for (text, step), fall, deep, out in zip(seen, falls, inside, skipped, strict=False) if not step and deep and not out and fall < falls[-1]]
    texts = (" ".join("".join(text for _, text in part).split()) for _, part in groupby(said, key=itemgetter(0)))
    body = "\n\n".join(text for text in texts if len(text) > PARAGRAPH_OVER)
    return body if len(body) >= BODY_FROM else None


@F.pandas_udf(T.StringType())
def paragraphs(pages: pd.Series) -> pd.Series:
    return pages.map(paragraphs_of)


@F.pandas_udf(T.StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """Character references as characters."""
    return texts.map(lambda t: None if t is None else unescape(t))


def lcs(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence, one bit a letter; once it cannot reach ``least`` any more, something below that."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, letter in enumerate(a):
        masks[letter] = masks.get(letter, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for i, letter in enumerate(b):
        hit = row & masks.get(letter, 0)
        row = ((row + hit) | (row - hit)) & full
        if i % 256 == 255 and len(a) - row.bit_count() + len(b) - i - 1 < least:
            break
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """200 x LCS / (both lengths); two empty texts are equal."""
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def reaches(a: str, b: str, least: float) -> bool:
    """Whether the indel ratio is ``least`` or more."""
    n = len(a) + len(b)
    need = math.ceil(least * n / 200 - 1e-9)
    return n == 0 or lcs(a, b, need) >= need


def language(text: str | Column) -> Column:
    """[F23, U5] The language with most frequent words in the text, the first by name of equal ones; Indonesian for short texts and none.

    The words are extracted once, and go through one fold that counts for all languages.
    """
    text = F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    names = sorted(FREQUENT)
    some = F.filter(words, lambda w: w.isin(sorted(set().union(*FREQUENT.values()))))

    def counted(n: Column, word: Column) -> Column:
        return F.struct(*((n[name] + word.isin(FREQUENT[name]).cast("int")).alias(name) for name in names))

    def best(n: Column) -> Column:
        top = F.greatest(*(n[name] for name in names))
        first = F.coalesce(*(F.when(n[name] == top, name) for name in names))
        return F.when(top > 0, first).otherwise("id")

    found = F.aggregate(some, F.struct(*(F.lit(0).alias(name) for name in names)), counted, best)
    return F.when(F.length(text) < 20, "id").otherwise(found)


def hashed_embedding(texts: list[str], dimension: int = 64) -> np.ndarray:
    """[U7] Signed hashed word counts, normalised: the default embedding."""
    import zlib

    out = np.zeros((len(texts), dimension), np.float32)
    for i, text in enumerate(texts):
        for word in re.findall(r"[a-zA-ZÀ-ɏ]+", (text or "").lower()):
            code = zlib.crc32(word.encode())
            out[i, code % dimension] += 1 if code >> 16 & 1 else -1
        norm = float(np.sqrt((out[i].astype(float) ** 2).sum()))
        if norm:
            out[i] /= norm
    return out


def embedding(provider: Callable[[list[str]], np.ndarray] = hashed_embedding) -> Callable[[Column], Column]:
    """A column function for a provider, which is set up once a worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(provider([t or "" for t in texts])))

    return embed


# Words of the default stance lexicon.
POSITIVE = set("bagus hebat setuju dukung mantap baik terbaik good great agree support best love excellent".split())
NEGATIVE = set("buruk jelek bohong korupsi gagal tolak malu bad worst lie corrupt fail reject shame hate terrible".split())


def lexicon_stance(texts: list[str]) -> list[str]:
    """[U4] Stance by words for and against: the default classifier."""
    out = []
    for text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        tilt = sum(w in POSITIVE for w in words) - sum(w in NEGATIVE for w in words)
        out.append("positive" if tilt > 0 else "negative" if tilt < 0 else "neutral")
    return out


def stance(provider: Callable[[list[str]], list[str]] = lexicon_stance) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def classify(texts: pd.Series) -> pd.Series:
        return pd.Series(provider(list(texts)))

    return classify


def answered(prompts: list[str], provider: Callable[[list[str]], list[str]], retries: int = 2) -> list[tuple[str | None, str]]:
    """[S19, T8] (body, status) for each prompt: a batch that fails is tried again, then halved, so one bad prompt costs its own answer only.

    A provider that answers too few or too many fails, too. At most (retries + 1) * 2 * (bad prompts) * log2(batch) calls more than one are made.
    """
    for _ in range(retries + 1):
        try:
            out = list(provider(prompts))
            if len(out) != len(prompts):
                raise ValueError("answers are not as many as prompts")
            return [(x, "ok") if x else (None, "error:empty") for x in out]
        except Exception as e:  # the provider's own errors become values
            failed = f"error:provider:{type(e).__name__}"
    if len(prompts) == 1:
        return [(None, failed)]
    half = len(prompts) // 2
    return answered(prompts[:half], provider, retries) + answered(prompts[half:], provider, retries)


def replies(prompts: str | Column, provider: Callable[[list[str]], list[str]], retries: int = 2) -> Column:
    """[S19, T8] What a chat or completion provider answers to each prompt, as (body, status); an error is a value, not an exception."""

    @F.pandas_udf("body string, status string")
    def ask(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(answered(list(texts), provider, retries) if len(texts) else [], columns=["body", "status"], dtype=object)

    return ask(F.col(prompts) if isinstance(prompts, str) else prompts)


def same(texts: list[str]) -> list[str]:
    """[U6] The default translator leaves texts as they are."""
    return texts


def translation(provider: Callable[[list[str]], list[str]] = same, least: int = 20) -> Callable[[Column], Column]:
    """Texts under ``least`` characters stay; a result of no more characters than that is null."""

    @F.pandas_udf(T.StringType())
    def translate(texts: pd.Series) -> pd.Series:
        long = [t is not None and len(t.strip()) >= least for t in texts]
        done = iter(provider([t for t, yes in zip(texts, long, strict=True) if yes]))
        out = [(lambda r: r if r and len(r) > least else None)(next(done)) if yes else t for t, yes in zip(texts, long, strict=True)]
        return pd.Series(out, dtype=object)

    return translate


def first_sentences(sources: list[str]) -> str:
    """[U8] The first sentence of each source with its citation: the default summary."""
    heads = [re.split(r"(?<=[.!?])\s", (s or "").strip(), maxsplit=1)[0] for s in sources]
    return " ".join(f"{h} [Sumber {i}]" for i, h in enumerate(heads, 1) if h)


def summary(provider: Callable[[list[str]], str] = first_sentences) -> Callable[[Column], Column]:
    @F.pandas_udf(T.StringType())
    def summarise(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: provider(list(g)))

    return summarise
