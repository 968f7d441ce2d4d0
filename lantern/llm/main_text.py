"""Main text of pages by wrappers: union-free regular expressions inferred per host.

A page is a nested stream of block elements and texts; each text is kept as its checksum. Neighbouring runs of one
shape are folded to a repeated group. The streams of a host are aligned one after another to its wrapper, level by
level: elements of one name and class meet, a run that one side lacks becomes optional, a run that one side repeats
becomes a repeated group, and texts that differ become a slot, while a text that all pages share stays fixed. Tasks
align the pages of a host that they hold, and those wrappers are aligned in a tree of bounded chunks until a
host has one, so a host with most pages is no hot group.

The wrapper decides what the article is: its region is the innermost element that holds nine tenths of the
characters in slots, links apart. Each page is aligned to its host's wrapper, and the texts that fall into the region
are its article, without those that are fixed there. Menus, headers, footers, sidebars, forms, scripts and
styles are told by their elements and never take part; adverts, notices and comments inside the region by the words of
their class names. Those words and the container names are also the way out where a wrapper tells nothing: a host
with a single page, pages that all have one text, or texts that stand in the bare body.

Null or empty html: empty text. Null url: host empty. Equal pages give equal rows and teach no fixed text. Very long
pages are read in one pass and take part whole; elements deeper than ``DEPTH`` are read as their ancestor at that
depth, which loses no text. Of regions with equal shares the first counts. An empty table gives no rows. Extra columns are not carried.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import cut, in_arrow, small


@dataclass(frozen=True)
class Params:
    #: wrappers that are aligned together
    chunk: int = 64
    #: hosts whose wrappers a task holds at a time
    hosts: int = 2000
    #: share of the characters in slots that the region holds
    share: float = 0.9
    #: pages with different longest texts on which a text must stand to count as fixed, and to be left out of the region
    fixed: int = 2
    boilerplate: int = 3


#: Siblings of a repeated run at most, levels of elements, and cells of an alignment that is found by dynamic programming.
FOLD, DEPTH, CELLS = 12, 200, 250_000
OPTIONAL, REPEATED = 1, 2


# Element names of HTML, and words of class, id and role attributes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = set("nav header footer aside form button select option input dialog menu svg canvas object audio video map script style noscript template textarea title iframe head".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
WORDS = set(
    "nav navbar navigation menu menubar sidebar aside footer header masthead ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist reply "
    "replies respond disqus breadcrumb breadcrumbs pagination pager related recommended widget toolbar copyright skip hidden".split()
)
MAIN_WORDS = set("content article post entry story main body maincontent articlebody".split())
CONTAINERS = ("article", "main", "content")
BLOCKS = set("html body div article section main td th tr tbody table center blockquote figure".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSED_BY = {
    "p": set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes or text): open, close and text, in one pass."""
    at, n = 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            yield "text", "", page[at:tag]
        if tag == n:
            return
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), tag):
            end = page.find(">", tag)
            at = n if end < 0 else end + 1
            continue
        name = _NAME.match(page, tag + 1)
        if not name:
            yield "text", "", "<"
            at = tag + 1
            continue
        end = _tag_end(page, name.end())
        found = name[1].lower()
        if page[tag + 1] == "/":
            yield "close", found, ""
        else:
            yield "open", found, page[name.end() : end]
        at = end + 1
        if found in RAW and page[tag + 1] != "/":
            close = re.compile(rf"</{re.escape(found)}(?=[\s/>])", re.I).search(page, at)
            at = n if not close else close.start()


_QUOTED = re.compile(r"=\s*(\"[^\"]*\"|'[^']*')|>")


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag; one inside quotes does not."""
    end = page.find(">", at)
    if end < 0:
        return len(page)
    if page.find("=", at, end) < 0:
        return end
    for m in _QUOTED.finditer(page, at):
        if m[0] == ">":
            return m.start()
    return end


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _names(attributes: dict[str, str]) -> list[str]:
    raw = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", raw) if w]


def _role(name: str, attributes: dict[str, str], words: list[str]) -> tuple[int, str]:
    """The rank of an element (0, 1: outside the article by its class names, 2: by element or role), and which container it is, if any."""
    if name in ("html", "body"):
        return 0, ""
    role = attributes.get("role", "").lower()
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    rank = 2 if name in OUTSIDE or role in ROLES or hidden else 1 if WORDS & set(words) else 0
    if name == "article" or role == "article" or attributes.get("itemprop") == "articleBody":
        return rank, "article"
    if name == "main" or role == "main":
        return rank, "main"
    return rank, "content" if name in ("div", "section", "td") and MAIN_WORDS & set(words) else ""


# A node is an element [key, children, flags, shape] or a text [checksum (0: slot), flags, characters, those in links, pages, blocks].


@dataclass
class Page:
    """What one pass over a page finds: its nested stream, and its texts as (text, rank, containers, containers by elements).

    The rank is 0 for text that may be the article, 1 where class names rule it out and 2 where elements do.
    """

    stream: list
    blocks: list[tuple[str, int, frozenset, frozenset]]

    @property
    def mark(self) -> int:
        """Tells pages with different articles apart: the checksum of the longest text."""
        return zlib.crc32(max((b[0] for b in self.blocks if b[1] < 2), key=len, default="").encode())


class _Reader:
    def __init__(self):
        self.root: list = ["", [], 0, 0]
        self.blocks: list = []
        self.buffer: list[str] = []
        self.linked = self.in_link = 0
        self.top = ("", 0, frozenset(), frozenset(), self.root)
        self.stack: list[tuple] = []

    def flush(self) -> None:
        if not self.buffer:
            return
        text = " ".join(html.unescape("".join(self.buffer)).split())
        linked, self.linked = self.linked, 0
        self.buffer.clear()
        if text:
            _, rank, strict, loose, node = self.top
            if node is not None:
                node[1].append([zlib.crc32(text.encode()) or 1, 0, len(text), min(linked, len(text)), [], [len(self.blocks)]])
            self.blocks.append((text, rank, strict, loose))

    def push(self, name: str, rank: int, strict: frozenset, loose: frozenset, key: str | None) -> None:
        node = None if rank > 1 else self.top[4]
        if node is not None and key is not None and len(self.stack) < DEPTH:
            node = [key, [], 0, 0]
            self.top[4][1].append(node)
        self.top = (name, rank, strict, loose, node)
        self.stack.append(self.top)

    def pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            node = self.stack.pop()[4]
            self.top = self.stack[-1] if self.stack else ("", 0, frozenset(), frozenset(), self.root)
            if node is not None and node is not self.top[4]:
                self.finish(node)

    def finish(self, node: list) -> None:
        if node[1]:
            node[1] = folded(node[1])
            node[3] = _shape(node)
        else:
            self.top[4][1].pop()

    def read(self, page: str) -> Page:
        for kind, name, rest in events(page):
            if kind == "text":
                self.buffer.append(rest)
                self.linked += len(rest) * self.in_link
            elif name in INLINE:
                self.inline(kind, name, rest)
            elif kind == "open" and name == "br":
                self.buffer.append(" ")
            else:
                self.flush()
                if kind == "open":
                    self.open(name, rest)
                else:
                    depth = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name), -1)
                    if depth >= 0:
                        self.pop(depth)
        self.flush()
        self.pop(0)
        return Page(folded(self.root[1]), self.blocks)

    def inline(self, kind: str, name: str, rest: str) -> None:
        if name == "a":
            self.in_link = int(kind == "open")
        if kind == "open":
            attributes = _attributes(rest)
            rank = _role(name, attributes, _names(attributes))[0] if attributes else 0
            if rank:
                self.flush()
                _, above, strict, loose, _ = self.top
                self.push(name, max(above, rank), strict, loose, f"{name}.ad" if rank == 1 else None)
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == name:
                self.flush()
                self.pop(depth)
                return
            if self.stack[depth][0] not in INLINE:
                return

    def open(self, name: str, rest: str) -> None:
        while self.stack:
            depth = len(self.stack) - 1
            while depth >= 0 and self.stack[depth][0] in INLINE:
                depth -= 1
            if depth < 0 or name not in CLOSED_BY.get(self.stack[depth][0], ()):
                break
            self.pop(depth)
        if name in VOID:
            return
        attributes = _attributes(rest)
        words = _names(attributes) if attributes else []
        rank, container = _role(name, attributes, words)
        _, above, strict, loose, _ = self.top
        if container and rank < 2:
            loose = loose | {container}
            strict = strict if rank else strict | {container}
        self.push(name, max(above, rank), strict, loose, ".".join([name, *(re.sub(r"\d+", "0", w) for w in words)]))


def read(page: str) -> Page:
    return _Reader().read(page)


def _is_text(node: list) -> bool:
    return not isinstance(node[0], str)


def _key(node: list) -> str:
    return "#" if _is_text(node) else node[0] if node[0] != "+" else "+" + ",".join(map(_key, node[1]))


def _shape(node: list) -> int:
    return zlib.crc32(f"{node[0]}({','.join(str(1 if _is_text(x) else x[3]) for x in node[1])})".encode())


def _shapes(nodes: list) -> list[int]:
    return [1 if _is_text(x) else x[3] for x in nodes]


def _flagged(node: list, flag: int) -> list:
    node[1 if _is_text(node) else 2] |= flag
    return node


def folded(nodes: list) -> list:
    """Siblings with neighbouring runs of one shape merged to a repeated node, or to a repeated group ``+`` of some."""
    out: list = []
    shapes: list[int] = []
    for node in nodes:
        out.append(node)
        shapes.append(_shapes([node])[0])
        for size in range(1, min(FOLD, len(out) - 1) + 1):
            run = shapes[-size:]
            group = out[-size - 1]
            if size > 1 and group[0] == "+" and _shapes(group[1]) == run:
                group[1] = [merged(x, y) for x, y in zip(group[1], out[-size:], strict=True)]
                del out[-size:], shapes[-size:]
                break
            if len(out) >= 2 * size and shapes[-2 * size : -size] == run:
                both = [merged(x, y) for x, y in zip(out[-2 * size : -size], out[-size:], strict=True)]
                if size == 1:
                    out[-2:] = [_flagged(both[0], REPEATED)]
                else:
                    out[-2 * size :] = [["+", both, REPEATED, 0]]
                    out[-1][3] = _shape(out[-1])
                shapes[-2 * size :] = _shapes(out[-1:])
                break
    return out


def merged(a: list, b: list) -> list:
    """The node that covers both, which have one key."""
    if _is_text(a):
        marks = a[4] if a[4] == b[4] else sorted({*a[4], *b[4]})[:3]
        return [a[0] if a[0] == b[0] else 0, a[1] | b[1], a[2] + b[2], a[3] + b[3], marks, a[5] + b[5]]
    out = [a[0], aligned(a[1], b[1]), a[2] | b[2], 0]
    out[3] = _shape(out)
    return out


def _grouped(nodes: list, other: list) -> list:
    """The nodes with each run that the other side repeats as that group."""
    for group in (x for x in other if x[0] == "+"):
        keys, out, i = [_key(x) for x in group[1]], [], 0
        while i < len(nodes):
            run = nodes[i : i + len(keys)]
            if [_key(x) for x in run] == keys:
                node = ["+", run, 0, 0]
                node[3] = _shape(node)
                out.append(node)
                i += len(run)
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of the nodes that meet: in order, of one key, and as alike as can be."""
    keys_a, keys_b = [_key(x) for x in a], [_key(x) for x in b]
    if len(a) * len(b) > CELLS:
        blocks = SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_matching_blocks()
        return [(m.a + k, m.b + k) for m in blocks for k in range(m.size)]
    inner = [[{_key(y) for y in x[1]} if not _is_text(x) else {"#"} for x in side] for side in (a, b)]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    meets: dict[tuple[int, int], float] = {}
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = max(below[j], row[j + 1])
            if keys_a[i] == keys_b[j]:
                x, y = inner[0][i], inner[1][j]
                alike = 1 + 2 * len(x & y) / (len(x) + len(y)) + (_is_text(a[i]) and a[i][0] == b[j][0] != 0)
                meets[i, j] = alike
                row[j] = max(row[j], below[j + 1] + alike)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if (i, j) in meets and best[i][j] == best[i + 1][j + 1] + meets[i, j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: list, b: list) -> list:
    """The union-free expression that covers both streams."""
    if _shapes(a) == _shapes(b):
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    a, b = _grouped(a, b), _grouped(b, a)
    out, i, j = [], 0, 0
    for x, y in [*_pairs(a, b), (len(a), len(b))]:
        out += [_flagged(n, OPTIONAL) for n in a[i:x]]
        out += [_flagged(n, OPTIONAL) for n in b[j:y]]
        if x < len(a):
            out.append(merged(a[x], b[y]))
        i, j = x + 1, y + 1
    return out


def _marked(nodes: list, mark: int) -> list:
    """The stream of a page as a wrapper: texts with the mark of their page and without their places."""
    todo = list(nodes)
    while todo:
        node = todo.pop()
        if _is_text(node):
            node[4], node[5] = [mark], []
        else:
            todo += node[1]
    return nodes


def _outside(node: list) -> bool:
    return bool(WORDS & set(node[0].split(".")[1:]))


def _weights(node: list, params: Params, by_words: bool) -> tuple[int, int]:
    """Characters in the slots and in the fixed texts of a node."""
    if _is_text(node):
        fixed = node[0] and len(node[4]) >= params.fixed
        return (0, node[2]) if fixed else (node[2] - node[3], 0)
    if by_words and _outside(node):
        return 0, 0
    slots = fixed = 0
    for x in node[1]:
        s, f = _weights(x, params, by_words)
        slots, fixed = slots + s, fixed + f
    return slots, fixed


def region(wrapper: list, params: Params = Params()) -> list[int] | None:  # noqa: B008
    """Path (places of children) to the element that holds the article, or None if the wrapper does not tell."""
    marks = set()
    todo = list(wrapper)
    while todo and len(marks) < 2:
        node = todo.pop()
        if _is_text(node):
            marks.update(node[4])
        else:
            todo += node[1]
    if len(marks) < 2:
        return None
    root = ["", wrapper, 0, 0]
    by_words = _weights(root, params, True)[0] > 0
    all_slots, fixed = _weights(root, params, by_words)
    if not all_slots or all_slots < fixed:
        return None
    path, node, found = [], root, []
    while True:
        inside = [(_weights(x, params, by_words)[0], -i) for i, x in enumerate(node[1]) if not _is_text(x) and x[0].split(".")[0] in BLOCKS and not x[2] & REPEATED]
        most, place = max(inside, default=(0, 0))
        if most < params.share * all_slots:
            break
        path = [*path, -place]
        node = node[1][-place]
        found.append((path, node))
    semantic = [p for p, n in found if n[0].split(".")[0] in ("article", "main")]
    if semantic:
        return semantic[-1]
    while len(found) > 1 and found[-2][1][0].split(".")[0] not in ("html", "body") and _adds_headings(found[-2][1], path[-1], params, by_words):
        found.pop()
        path = found[-1][0]
    return path if found and found[-1][1][0].split(".")[0] not in ("html", "body") else None


def _adds_headings(node: list, child: int, params: Params, by_words: bool) -> bool:
    """Whether all slots of an element beside one child of it are headings."""
    rest = [x for i, x in enumerate(node[1]) if i != child and _weights(x, params, by_words)[0]]
    return bool(rest) and all(not _is_text(x) and x[0].split(".")[0] in HEADINGS for x in rest)


def _inside(nodes: list, wrapper: list, path: list[int] | None, inside: bool, params: Params) -> Iterator[int]:
    """Places of the blocks that fall into the region and are not fixed there."""
    a, b = _grouped(nodes, wrapper), _grouped(wrapper, nodes)
    target = wrapper[path[0]] if path else None
    met = dict(_pairs(a, b))
    for i, node in enumerate(a):
        other = b[met[i]] if i in met else None
        if _is_text(node):
            if inside and not (other and other[0] and len(other[4]) >= params.boilerplate):
                yield from node[5]
            continue
        here = inside or other is not None and other is target and len(path) == 1
        if node[0].split(".")[0] in HEADINGS and here:
            yield from _blocks(node)
        elif here or other is not None and other is target:
            yield from _inside(node[1], other[1] if other else [], None if here else path[1:], here, params)


def _blocks(node: list) -> Iterator[int]:
    for x in node[1]:
        yield from x[5] if _is_text(x) else _blocks(x)


def by_containers(page: Page) -> str:
    """The texts of the first container that the page has, by the names of elements and classes alone."""
    for limit, kind in ((0, 2), (1, 3)):  # a page that its class names rule out whole is read again without them
        for name in (*CONTAINERS, ""):
            texts = [b[0] for b in page.blocks if b[1] <= limit and (not name or name in b[kind])]
            if texts:
                return " ".join(texts)
    return ""


def main_text(page: str, wrapper: list | None = None, path: list[int] | None = None, params: Params = Params()) -> str:  # noqa: B008
    """The article of a page by its host's wrapper and region; by containers where there is none or it holds nothing."""
    found = read(page)
    if wrapper and path:
        places = sorted(_inside(found.stream, wrapper, path, False, params))
        for limit in (0, 1):
            texts = [found.blocks[i][0] for i in places if found.blocks[i][1] <= limit]
            if texts:
                return " ".join(texts)
    return by_containers(found)


def _wrapped(params: Params):
    """The wrapper of each host among the pages of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            rows = [pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, names=["host", "wrapper"])

        for batch in batches:
            for i in range(batch.num_rows):
                name, page = batch.column(0)[i].as_py(), read(batch.column(1)[i].as_py() or "")
                stream = _marked(page.stream, page.mark)
                if stream:
                    held[name] = aligned(held[name], stream) if name in held else stream
                if len(held) >= params.hosts:
                    yield out()
        yield out()

    return run


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    wrapper: list = []
    for i, other in enumerate(sorted(group["wrapper"])):
        wrapper = aligned(wrapper, json.loads(other)) if i else json.loads(other)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(wrapper)]})


def wrappers(pages: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """host, wrapper (JSON): one row a host that has text."""
    rows = pages.select(host().alias("host"), F.col("html").cast("string").alias("html"))
    now = cut(in_arrow(rows, _wrapped(params), "host string, wrapper string"))
    while True:
        counts = cut(now.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            return now
        chunks = now.join(small(counts), "host").withColumn("chunk", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / params.chunk)))
        now = cut(chunks.groupBy("host", "chunk").applyInPandas(lambda g: _merge(g[["host", "wrapper"]]), "host string, wrapper string"))


def _extract(params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                name, wrapper = batch.column("host")[i].as_py(), batch.column("wrapper")[i].as_py()
                if name not in known:
                    if len(known) >= params.hosts:
                        known.clear()
                    nodes = json.loads(wrapper) if wrapper else []
                    path = region(nodes, params) if nodes else None
                    known[name] = (nodes if path else None, path)
                texts.append(main_text(batch.column("html")[i].as_py() or "", *known[name], params))
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return run


#: Bytes of wrappers that may be broadcast.
BROADCAST_BYTES = 16 << 20


def extract(pages: DataFrame, params: Params = Params()) -> DataFrame:  # noqa: B008
    """page_id, url, text, n_chars: one row a page."""
    found = wrappers(pages, params)
    if (found.agg(F.sum(F.octet_length("wrapper").cast("long"))).first()[0] or 0) <= BROADCAST_BYTES:
        found = small(found)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host())
    kind = pages.schema["page_id"].dataType.simpleString()
    return in_arrow(rows.join(found, "host", "left").select("page_id", "url", "html", "host", "wrapper"), _extract(params), f"page_id {kind}, url string, text string, n_chars long")
