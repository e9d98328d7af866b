"""Words of many texts at once, as arrays: no Python loop over words.

Texts are laid end to end as code points, a bounded number at a time. Runs of letters, digits and underscores are words, and so are runs of any other
characters than white space. A word's number is a polynomial of its code points modulo 2**64, taken from running sums."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points laid out at once. Longer texts are cut behind white space; a longer word is laid out whole.
BLOCK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
LAST = 0x10FFFF
Block = tuple[list[int], list[int], list[str]]


@lru_cache(1)
def kinds() -> np.ndarray:
    """0 white space, 1 letter, digit or underscore, 2 other."""
    table = np.full(LAST + 1, 2, np.uint8)
    for c in map(chr, range(LAST + 1)):
        if c.isalnum() or c == "_":
            table[ord(c)] = 1
        elif c.isspace():
            table[ord(c)] = 0
    return table


@lru_cache(2)
def powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, np.uint64))


@lru_cache(1)
def lowered() -> np.ndarray:
    """Lower case of each code point, where that is one code point."""
    table = np.arange(LAST + 1, dtype=np.uint32)
    for c in range(LAST + 1):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


def cut_behind(text: str, at: int, limit: int) -> int:
    """Where to cut a text that goes on: behind the last space or line end within the limit, or the first beyond it."""
    last = max(text.rfind(" ", at, at + limit), text.rfind("\n", at, at + limit)) + 1
    found = [k for k in (text.find(" ", at + limit), text.find("\n", at + limit)) if k >= 0]
    return last or min(found, default=len(text) - 1) + 1


def blocks(texts: list[str | None], limit: int = BLOCK, context: int = 0) -> Iterator[Block]:
    """Row numbers, places in their texts, and the parts of texts, about ``limit`` characters with separators at a time. A part
    that goes on with a text begins ``context`` characters before its place, where it is cut anywhere."""
    rows: list[int] = []
    places: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            end = len(text)
            if end - at >= limit:
                end = at + limit - 1 if context else cut_behind(text, at, limit - 1)
            if held and held + end - at + 1 > limit:
                yield rows, places, parts
                rows, places, parts, held = [], [], [], 0
            rows.append(row)
            places.append(at)
            parts.append(text[max(0, at - context) : end])
            held += end - at + 1
            at = end
            if at >= len(text):
                break
    if rows:
        yield rows, places, parts


def whole_texts(texts: list[str | None], limit: int = BLOCK) -> Iterator[list[Block]]:
    """The blocks again, those together that parts of one text go through."""
    held: list[Block] = []
    for block in blocks(texts, limit):
        if held and not block[1][0]:
            yield held
            held = []
        held.append(block)
    if held:
        yield held


class Words:
    """``row`` (of its text), ``start`` and ``end`` (in the block), ``place`` (of its start in its text) and ``number`` of
    every word of a block, in order; ``codes`` are the block's code points."""

    def __init__(self, rows: list[int], places: list[int], parts: list[str], lower: bool = False):
        self.codes = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if lower:
            self.codes = lowered()[self.codes]
        self.begin = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        kind = kinds()[self.codes]
        edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        start = edge[kind[edge] > 0]
        self.kind = kind[start]
        ends = np.append(edge[1:], len(kind))
        self.start, self.end = start, ends[kind[edge] > 0]
        self.part = np.searchsorted(self.begin, start, "right") - 1
        self.row = np.asarray(rows, np.int64)[self.part]
        self.place = start - self.begin[self.part] + np.asarray(places, np.int64)[self.part]
        self.number = self.polynomial(self.start, self.end)

    def polynomial(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of any stretches of the block, the same wherever they stand."""
        if not hasattr(self, "sums"):
            size = max(BLOCK, 1 << int(len(self.codes)).bit_length())
            self.back = powers(size, pow(int(BASE), -1, 1 << 64))
            self.sums = np.zeros(len(self.codes) + 1, np.uint64)
            np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * powers(size, int(BASE))[: len(self.codes)], out=self.sums[1:])
        found = (self.sums[end] - self.sums[start]) * self.back[start]
        return (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
