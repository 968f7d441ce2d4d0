"""Places of many names in texts at once: a trie of arrays, walked from all places of a batch together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Stands between texts; above all code points, so no name holds it.
BETWEEN = 0x110000
#: Cells of a trie's table of its upper levels, and code points of texts that are walked together.
UPPER, RUN = 1 << 21, 1 << 18


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def ascii_lower(codes: np.ndarray) -> np.ndarray:
    return np.where((codes >= 65) & (codes <= 90), codes + 32, codes)


class Trie:
    """Names as one sorted array of (node, letter); the node that a letter leads to is its place there, plus one.

    Of equal names the first counts, empty names never do. Levels are built and walked whole, so there is no loop over letters.
    Letters are numbered, 0 being all that no name holds; where a letter leads to from a node of the upper levels is looked up in a table.
    """

    def __init__(self, names: list[str], fold: bool = False):
        self.fold = fold
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        flat = code_points("".join(names))
        flat = ascii_lower(flat) if fold else flat
        self.letters, flat = np.unique(flat, return_inverse=True)
        self.wide = len(self.letters) + 1
        begin, node, alive = np.cumsum(sizes) - sizes, np.zeros(len(names), np.int64), np.arange(len(names))
        levels, made, depth = [np.empty(0, np.int64)], 1, 0
        self.ends = [1]  # of each level, the node after its last one
        while len(alive := alive[sizes[alive] > depth]):
            level, place = np.unique(node[alive] * self.wide + flat[begin[alive] + depth] + 1, return_inverse=True)
            node[alive] = made + place
            levels.append(level)
            made, depth = made + len(level), depth + 1
            self.ends.append(made)
        self.keys = np.concatenate(levels)
        self.name_at = np.full(made, len(names), np.int32)
        np.minimum.at(self.name_at, node, np.arange(len(names), dtype=np.int32))
        self.name_at[self.name_at == len(names)] = -1
        self.name_at[0] = -1
        self._number = self._upper = None

    def _tables(self) -> None:
        """Made where the trie is used, so they are not sent with it: the number of each letter, and the nodes below those of the upper levels."""
        if self._number is None:
            self._number = np.zeros(BETWEEN + 1, np.int32)
            self._number[self.letters] = np.arange(1, self.wide)
            if self.fold:
                self._number[65:91] = self._number[97:123]
            upper = max([end for end in self.ends if end * self.wide <= UPPER], default=0)
            some = self.keys[: np.searchsorted(self.keys, upper * self.wide)]
            self._upper = np.zeros(upper * self.wide, np.int32)
            self._upper[some] = np.arange(1, len(some) + 1)

    def _below(self, node: np.ndarray, letter: np.ndarray, depth: int) -> np.ndarray:
        """The nodes that letters lead to from nodes of one level, 0 where there is none."""
        key = node * self.wide + letter
        if self.ends[depth] * self.wide <= len(self._upper):
            return self._upper[key]
        place = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(place, len(self.keys) - 1)] == key, place + 1, 0)

    def found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, name) of every place of every name, overlapping ones too; ``codes`` ends with ``BETWEEN``."""
        self._tables()
        letters = self._number[codes]
        at = np.flatnonzero(letters)
        node, size, out = np.zeros(len(at), np.int64), 0, [(at[:0],) * 3]
        while len(at) and size + 1 < len(self.ends):
            below = self._below(node, letters[at + size], size)
            known = below > 0
            at, node, size = at[known], below[known].astype(np.int64), size + 1
            name = self.name_at[node]
            hit = name >= 0
            out.append((at[hit], at[hit] + size, name[hit].astype(np.int64)))
        return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def joined(texts: list[str | None] | pa.Array, most: int = RUN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts in runs of about ``most`` code points, a longer text alone: (first text, text after the last, code points, where each text begins)."""
    first, parts, size, many = 0, [], 0, len(texts)
    for i, text in enumerate(texts):
        text = text.as_py() if isinstance(text, pa.Scalar) else text
        parts += [code_points(text or ""), np.array([BETWEEN])]
        size += len(parts[-2]) + 1
        if size >= most or i + 1 == many:
            lengths = np.array([len(p) + 1 for p in parts[::2]])
            yield first, i + 1, np.concatenate(parts), np.cumsum(lengths) - lengths
            first, parts, size = i + 1, [], 0


def places(texts: list[str | None], trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, name) of every place of every name in each text."""
    out = [(np.empty(0, np.int64),) * 4]
    for first, _, codes, begins in joined(texts):
        start, end, name = trie.found(codes)
        row = np.searchsorted(begins, start, "right") - 1
        out.append((first + row, start - begins[row], end - begins[row], name))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def byte_places(codes: np.ndarray) -> np.ndarray:
    """Where each code point begins in UTF-8, and where the last ends; ``BETWEEN`` takes no place."""
    size = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64)
    return np.concatenate([[0], np.cumsum(np.where(codes == BETWEEN, 0, size))])


def firsts(start: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """In order of start, of the places that begin together that of least rank."""
    order = np.lexsort((rank, start))
    return order[np.diff(start[order], prepend=-1) > 0]


def apart(start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> list[int]:
    """Which places of a text stay, from the left, when none may overlap; of those that begin together that of least rank stays."""
    kept, free = [], 0
    order = firsts(start, rank)
    for i, begin, over in zip(order.tolist(), start[order].tolist(), end[order].tolist(), strict=True):
        if begin >= free:
            kept.append(i)
            free = over
    return kept
