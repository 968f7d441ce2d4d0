"""Toxicity: a lexicon trie searched with Levenshtein automata, and scores of the context of each hit.

The lexicon is a list of insults (a parameter) and what labelled rows teach: words, and word beginnings,
that stand in toxic documents behind many different words and in clean ones never. Counting distinct
neighbours, not documents, keeps the copies of one toxic document from teaching their whole text.

Levenshtein automata of the lexicon's terms run together over its trie, as one machine that is
determinised as words need it: a state is a set of (trie node, edits so far). So a misspelt word is found in one
step a letter, however large the lexicon. Forms that clean training rows hold are no misspellings.

Each hit is weighed by its window of words: inside quotation marks or behind a word of reporting it counts
as quotation, else as abuse, and more if the reader is addressed. A logistic regression over these sums,
fitted on the same rows, gives the score.

Training takes at most ``fit_toxic`` and ``fit_clean`` labelled rows, those with the least hash, of texts
of at most ``fit_chars`` characters and ``fit_bytes`` in all; held-out rows are never among them. Scoring reads every whole text.

Null or empty text: no hit, the score of a clean text. Null doc_id: not held out. Conflicting labels of
one id: toxic. No label at all: the built-in list and fixed weights decide. Repeated rows and texts with equal hits are scored
alike. Very long texts are scored whole, in time that grows with their length. An empty table gives no rows. Extra columns,
language and source are neither read nor carried.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import in_arrow, sample

# Common insults, words of reporting, and words that address the reader.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile cretin loser losers scum scumbag trash garbage worthless pathetic disgusting "
    "clown clowns fool foolish bastard bitch asshole shithead dickhead jerk creep freak retard vermin parasite pig swine filth filthy lowlife degenerate "
    "idiota imbécil estúpido estúpida basura cabrón gilipollas mierda connard connasse salaud abruti crétin débile ordure arschloch idiotin trottel depp dummkopf abschaum"
).split()
REPORTING = set("said says say called calls wrote writes quoted quote word term insult slur dijo dice llamó palabra dit disait appelé mot sagte sagt nannte wort schrieb".split())
ADDRESS = set("you your you're u are tu eres usted vous êtes toi du bist dich ihr sie".split())
OPENING, CLOSING = "\"“«„‘", "\"”»“’"
_TOKEN = re.compile(r"[^\s,;:/|\"()\[\]{}<>«»“”„.?!…]+")
_EDGE = "'*-_#$%&~`‘’+="


@dataclass(frozen=True)
class Params:
    fit_toxic: int = 2000
    fit_clean: int = 4000
    fit_chars: int = 20_000
    fit_bytes: int = 24 << 20
    #: false terms expected in a lexicon from labels that tell nothing
    false_terms: float = 0.5
    prefixes: tuple[int, ...] = (4, 5, 6)
    window: int = 5
    quoted: float = 0.25
    threshold: float = 0.7
    insults: tuple[str, ...] = field(default=tuple(INSULTS))


def edits(term: str) -> int:
    """Edits that a misspelling of the term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Terms and beginnings in a trie with a Levenshtein automaton, determinised on demand."""

    KEEP = 200_000

    def __init__(self, terms: set[str], beginnings: set[str], benign: set[str] | None = None):
        self.terms, self.beginnings, self.benign = set(terms), set(beginnings), benign or set()
        self.child: list[dict[str, int]] = [{}]
        self.ends, self.most = [-1], [0]
        for term in sorted(self.terms):
            node, allowed = 0, edits(term)
            self.most[0] = max(self.most[0], allowed)
            for letter in term:
                if letter not in self.child[node]:
                    self.child[node][letter] = len(self.child)
                    self.child.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                node = self.child[node][letter]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node] = allowed
        self._clear()

    def __getstate__(self):
        return self.terms, self.beginnings, self.benign

    def __setstate__(self, state):
        self.__init__(*state)

    def _clear(self) -> None:
        start = self._closed({0: 0})
        self.states, self.number, self.step, self.accept = [start], {start: 0}, [{}], [self._accepts(start)]
        self.memo: dict[str, int] = {}

    def _closed(self, reach: dict[int, int]) -> tuple:
        """Adds what leaving out letters of the term reaches."""
        todo = list(reach.items())
        while todo:
            node, e = todo.pop()
            if reach.get(node) != e:
                continue
            for below in self.child[node].values():
                if e + 1 <= self.most[below] and e + 1 < reach.get(below, 99):
                    reach[below] = e + 1
                    todo.append((below, e + 1))
        return tuple(sorted(reach.items()))

    def _accepts(self, state: tuple) -> bool:
        return any(self.ends[node] >= e for node, e in state)

    def _next(self, at: int, letter: str) -> int:
        reach: dict[int, int] = {}

        def to(node: int, e: int) -> None:
            if e <= self.most[node] and e < reach.get(node, 99):
                reach[node] = e

        for node, e in self.states[at]:
            to(node, e + 1)
            for edge, below in self.child[node].items():
                to(below, e + (edge != letter))
        state = self._closed(reach)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.step.append({})
            self.accept.append(self._accepts(state))
        self.step[at][letter] = self.number[state]
        return self.number[state]

    def misspelt(self, word: str) -> bool:
        at = 0
        for letter in word:
            after = self.step[at].get(letter)
            at = self._next(at, letter) if after is None else after
            if not self.states[at]:
                return False
        return self.accept[at]

    def find(self, token: str) -> int:
        """0: nothing, 1: a term or a beginning of one, 2: a misspelt term."""
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) > self.KEEP or len(self.states) > self.KEEP:
                self._clear()
            word = token.strip(_EDGE)
            if word in self.terms or any(word.startswith(b) for b in self.by_start().get(word[:4], ())):
                found = 1
            else:
                found = 2 if len(word) >= 4 and word not in self.benign and self.misspelt(word) else 0
            self.memo[token] = found
        return found

    def by_start(self) -> dict[str, list[str]]:
        if not hasattr(self, "_starts"):
            self._starts = defaultdict(list)
            for b in self.beginnings:
                self._starts[b[:4]].append(b)
        return self._starts


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def learn(toxic: list[str], clean: list[str], params: Params) -> Lexicon:
    """The lexicon from training texts."""
    seen, plain, starts = set(), defaultdict(set), defaultdict(lambda: (set(), set()))
    for text in clean:
        seen.update(tokens(text))
    seen = {w.strip(_EDGE) for w in seen}
    clean_starts = {w[:n] for w in seen for n in params.prefixes if len(w) >= n}
    for text in toxic:
        before = ""
        for token in tokens(text):
            word = token.strip(_EDGE)
            if word not in seen and len(word) >= 4:
                plain[word].add(before)
                for n in params.prefixes:
                    if len(word) >= n and word[:n] not in clean_starts:
                        starts[word[:n]][0].add(before)
                        starts[word[:n]][1].add(word)
            before = word
    share = len(toxic) / max(1, len(toxic) + len(clean))
    distinct = sum(len(x) > 1 for x in plain.values()) + sum(len(x) > 1 for x, _ in starts.values()) + 1
    least = max(3, math.ceil(math.log(distinct / params.false_terms) / -math.log(min(max(share, 1e-6), 0.9))))
    terms = {w for w, x in plain.items() if len(x) >= least}
    beginnings: set[str] = set()
    for b in sorted((b for b, (x, words) in starts.items() if len(x) >= least and len(words) >= 4), key=len):
        if not any(b.startswith(x) for x in beginnings):
            beginnings.add(b)
    terms = {t for t in terms if not any(t.startswith(b) for b in beginnings)}
    lexicon = Lexicon(terms | set(params.insults), beginnings)
    return Lexicon(lexicon.terms, beginnings, {w for w in seen if lexicon.find(w) == 2} - lexicon.terms)


def _window(low: str, spans: list[tuple[int, int]], words: list[str], i: int, params: Params) -> float:
    """How far the hit at word i of a lowered text is abuse: less in quotation, 1.5 if the reader is addressed."""
    start, end = spans[i]
    left = low[low.rfind("\n", max(0, start - 120), start) + 1 or max(0, start - 120) : start]
    right = low[end : end + 120].split("\n")[0]
    around = words[max(0, i - params.window) : i + params.window + 1]
    for o, c in zip(OPENING, CLOSING, strict=True):
        opened = left.count(o) % 2 == 1 if o == c else left.rfind(o) > left.rfind(c)
        if opened and c in right:
            return params.quoted
    if REPORTING & set(words[max(0, i - params.window) : i]):
        return params.quoted
    return 1.5 if ADDRESS & set(around) else 1.0


def features(text: str, lexicon: Lexicon, params: Params) -> list[float]:
    """Sums over the hits: abuse, misspelt abuse, quotations, and abuse among all words."""
    low = text.lower()
    words = _TOKEN.findall(low)
    kinds = [lexicon.find(w) for w in words]
    hits = [i for i, k in enumerate(kinds) if k]
    if not hits:
        return [0.0] * 5
    spans = [m.span() for m in _TOKEN.finditer(low)]
    abuse = bent = quoted = 0.0
    for i in hits:
        weight = _window(low, spans, words, i, params)
        if weight < 1:
            quoted += 1
        if kinds[i] == 1:
            abuse += weight
        else:
            bent += weight
    return [min(abuse, 1.0), math.log1p(abuse), math.log1p(bent), math.log1p(quoted), math.sqrt((abuse + bent) / len(words))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps; both classes weigh as they come."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


#: Weights where no labels are given: one insult that is no quotation is enough.
PRIOR = np.array([-4.0, 3.5, 2.5, 1.0, 0.2, 2.0])


def held_out():
    """Rows that take no part in the training."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, params: Params) -> tuple[Lexicon, np.ndarray]:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = docs.filter(F.col("text").isNotNull() & (F.length("text") <= params.fit_chars) & F.col("doc_id").isNotNull())
    picked = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, params.fit_toxic), (0, params.fit_clean))]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # at most fit_toxic + fit_clean rows
    rows = short.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sample(rows.withColumn("at", F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")), "at", "text", params.fit_bytes)
    rows.sort(key=lambda r: r.doc_id)
    toxic, clean = [r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0]
    lexicon = learn(toxic, clean, params)
    if not toxic or not clean:
        return lexicon, PRIOR
    x = np.array([features(t, lexicon, params) for t in toxic + clean])
    return lexicon, fit(x, np.r_[np.ones(len(toxic)), np.zeros(len(clean))])


def _scorer(lexicon: Lexicon, weights: np.ndarray, params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            x = np.array([[1.0, *features(column[i].as_py() or "", lexicon, params)] for i in range(len(column))], float).reshape(len(column), len(weights))
            score = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            arrays = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= params.threshold).astype(np.int32))]
            hits = x[:, 1:]
            arrays += [pa.array(np.expm1(hits[:, i])) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted", "abuse", "misspelt", "quoted"])

    return run


def score(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, score, predicted, then the sums of the hits' weights: one row a document."""
    lexicon, weights = train(docs, labels, params)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(rows, _scorer(lexicon, weights, params), f"doc_id {kind}, held_out boolean, score double, predicted int, abuse double, misspelt double, quoted double")
