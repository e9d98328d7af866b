"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case, with every run of other characters than letters, digits and underscores
as one space. An item of m characters may occur with up to ``errors * m`` edits. Cut into one piece more than that, at
least one piece must occur exactly: one automaton finds all pieces of all items in one pass over a text. Each hit names a
window, and Myers' bit-parallel distance, for many windows at once, decides whether the item is in it.

Items shorter than ``min_chars`` after normalisation prove nothing inside a sentence: they match without edits, as a whole
line of a text. Test items come in blocks of at most BLOCK_CHARS characters (longer items alone). One block is one pass over
the texts in one task function; of more, each pass ends in a written table of the few texts with matches before the next
begins, so one block at a time is on the driver and broadcast. Null or empty texts hold no items; items with a null id are
matched like others, items without a letter or digit by none. Repeated rows are each matched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listing_lake.llm.common import written
from listing_lake.llm.textvec import BLOCK, blocks, kinds, lowered
from listing_lake.llm.tokens import forget

BLOCK_CHARS = 500_000
BATCH = 1024
LEAK = "array<struct<item_id:long,distance:int,start:long,end:long>>"


def normal(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points, and the place each came from. Line ends between texts stay."""
    word = kinds()[codes] == 1
    out = np.where(word, lowered()[codes], 32).astype(np.uint32)
    keep = word | np.concatenate([[False], word[:-1]])
    at = np.flatnonzero(keep)
    return out[at], at


def normal_text(text: str | None) -> str:
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    return normal(codes)[0].tobytes().decode("utf-32-le", "surrogatepass").strip()


class Items:
    """The pieces of a block of test items, and their bit masks for Myers' distance."""

    def __init__(self, items: list[tuple[int | None, str]], errors: float, min_chars: int):
        import ahocorasick

        named = [(i, normal_text(t)) for i, t in items]
        self.named = [(i, t) for i, t in named if len(t) >= min_chars]
        self.short: dict[str, list[int | None]] = {}
        for i, t in named:
            if 0 < len(t) < min_chars:
                self.short.setdefault(t, []).append(i)
        self.budget = np.array([int(errors * len(t)) for _, t in self.named], np.int64)
        self.length = np.array([len(t) for _, t in self.named], np.int64)
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.named):
            n = int(self.budget[k]) + 1
            edges = [len(t) * j // n for j in range(n + 1)]
            for a, b in zip(edges, edges[1:], strict=False):
                places.setdefault(t[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        letters = sorted({c for _, t in self.named for c in t})
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.words = int(-(-max(self.length, default=1) // 64))
        self.masks = np.zeros((len(self.named), len(letters) + 1, self.words), np.uint64)
        rank = {c: r + 1 for r, c in enumerate(letters)}
        for k, (_, t) in enumerate(self.named):
            for j, c in enumerate(t):
                self.masks[k, rank[c], j // 64] |= np.uint64(1 << j % 64)

    def ranks(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.letters, codes)
        at = np.minimum(at, len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, 0)

    def distances(self, item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edit distance of each item to any stretch of its window (ranks, one row each), and where that ends."""
        n, words = len(item), int(-(-self.length[item].max() // 64))
        one, top = np.uint64(1), np.uint64(63)
        pv, mv = np.full((words, n), np.iinfo(np.uint64).max, np.uint64), np.zeros((words, n), np.uint64)
        last, bit = (self.length[item] - 1) // 64, ((self.length[item] - 1) % 64).astype(np.uint64)
        score = self.length[item].copy()
        best, end = score.copy(), np.zeros(n, np.int64)
        for j in range(windows.shape[1]):
            eq_all = self.masks[item, windows[:, j]]
            ph_in, mh_in = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            for w in range(words):
                p, m = pv[w], mv[w]
                eq = eq_all[:, w]
                xv = eq | m
                eq = eq | mh_in
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = m | ~(xh | p), p & xh
                here = last == w
                score += here * (((ph >> bit) & one).astype(np.int64) - ((mh >> bit) & one).astype(np.int64))
                ph_out, mh_out = ph >> top, mh >> top
                ph, mh = (ph << one) | ph_in, (mh << one) | mh_in
                pv[w], mv[w] = mh | ~(xv | ph), ph & xv
                ph_in, mh_in = ph_out, mh_out
            better = score < best
            best[better], end[better] = score[better], j
        return best, end

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text, the items it holds: the best match of each, with places in code points of the text."""
        out: list[dict[int, tuple]] = [{} for _ in texts]
        longest = max((len(t) for t in texts if t), default=0)
        for rows, _, parts in blocks(texts, max(BLOCK, longest + 2)) if self.named else ():
            codes = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
            flat, came = normal(codes)
            edge = np.searchsorted(came, begin)
            hits: set[tuple[int, int, int]] = set()
            for stop, (size, where) in self.automaton.iter(flat.tobytes().decode("utf-32-le", "surrogatepass")):
                for k, offset in where:
                    step = int(self.budget[k]) + 1
                    hits.add((k, (stop + 1 - size - offset) // step * step, int(stop)))
            if not hits:
                continue
            found = np.array(sorted({(k, d, int(np.searchsorted(edge, s, "right")) - 1) for k, d, s in hits}), np.int64)
            found = found[np.argsort(self.length[found[:, 0]], kind="stable")]
            ranks = np.append(self.ranks(flat), 0)
            for at in range(0, len(found), BATCH):
                item, diagonal, part = found[at : at + BATCH].T
                low = np.maximum(diagonal - self.budget[item], edge[part])
                high = np.minimum(diagonal + self.length[item] + 2 * self.budget[item] + 1, edge[part + 1])
                span = low[:, None] + np.arange(int((high - low).max()))
                windows = np.where(span < high[:, None], ranks[np.minimum(span, len(ranks) - 1)], 0)
                best, end = self.distances(item, windows)
                for i in np.flatnonzero(best <= self.budget[item]):
                    k, stop = int(item[i]), int(low[i] + end[i])
                    start = max(int(low[i]), stop - int(self.length[k]) + 1)
                    row, zero = rows[part[i]], int(begin[part[i]])
                    told = (int(best[i]), int(came[start]) - zero, int(came[min(stop, len(came) - 1)]) - zero + 1)
                    out[row][k] = min(out[row].get(k, told), told)
        lines = [self.lines(t) for t in texts]
        return [[{"item_id": self.named[k][0], "distance": d, "start": a, "end": b} for k, (d, a, b) in sorted(x.items())] + y for x, y in zip(out, lines, strict=True)]

    def lines(self, text: str | None) -> list[dict]:
        """Short items that are a whole line of a text: the first such line of each."""
        found, at = {}, 0
        for line in (text or "").splitlines(keepends=True) if self.short else ():
            for i in self.short.get(normal_text(line), ()):
                found.setdefault(i, {"item_id": i, "distance": 0, "start": at, "end": at + len(line.rstrip("\r\n"))})
            at += len(line)
        return list(found.values())


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The test items, a block of bounded size at a time: runs of items in hash order, cut where the block is full. Each is read
    once, from a table sorted by block."""
    some = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    total = some.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= BLOCK_CHARS:
        found = [sorted(((r.id, r.text) for r in some.collect()), key=str)] if total else []
        yield from found
        return
    # hash ranges hold about half a block each on average; sums within a range then cut it
    ranges = 2 * -(-total // BLOCK_CHARS)
    some = some.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(ranges)))
    held = F.sum(F.length("text")).over(W.partitionBy("part").orderBy("id", "text").rowsBetween(W.unboundedPreceding, -1))
    some = some.withColumn("piece", F.floor(F.coalesce(held, F.lit(0)) / BLOCK_CHARS))
    some = written(some.repartitionByRange("part", "piece").sortWithinPartitions("part", "piece"), "benchmark-blocks")
    for r in some.select("part", "piece").distinct().orderBy("part", "piece").collect():
        rows = some.filter((F.col("part") == r.part) & (F.col("piece") == r.piece)).collect()
        yield sorted(((x.id, x.text) for x in rows), key=str)


def finder(shared, errors: float, min_chars: int):
    made: dict[str, Items] = {}

    def leaks(texts: pd.Series) -> pd.Series:
        forget()
        if "items" not in made:
            made["items"] = Items(shared.value, errors, min_chars)
        return pd.Series(made["items"].leaks(texts.tolist()))

    return F.pandas_udf(leaks, LEAK)


def match(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    errors: float = 0.06, min_chars: int = 25, leaks_col: str = "leaks",
) -> DataFrame:
    """Adds ``leaks``: item_id, distance, start and end of each test item that a text holds."""
    none, text = F.array().cast(LEAK), F.col(text_col)
    keys = {"_a": F.xxhash64(text), "_b": F.xxhash64(F.lit(1), text)}  # equal texts hold equal items
    first, passes = None, []
    for some in item_blocks(benchmark, item_col, item_text_col):
        if first is not None:
            passes.append(one_pass(docs.select(text.alias("_text"), *(v.alias(k) for k, v in keys.items())), first, errors, min_chars))
        first = some
    if not passes:
        if first is None:
            return docs.withColumn(leaks_col, none)
        shared = docs.sparkSession.sparkContext.broadcast(first)
        return docs.withColumn(leaks_col, finder(shared, errors, min_chars)(text))
    passes.append(one_pass(docs.select(text.alias("_text"), *(v.alias(k) for k, v in keys.items())), first, errors, min_chars))
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    every = every.groupBy("_a", "_b").agg(F.flatten(F.collect_list("_leaks")).alias("_leaks"))
    out = docs.withColumns(keys).join(every, ["_a", "_b"], "left")
    return out.select(*docs.columns, F.coalesce("_leaks", none).alias(leaks_col))


def one_pass(texts: DataFrame, items: list[tuple[int | None, str]], errors: float, min_chars: int) -> DataFrame:
    """Texts with matches among one block of items, once each, written before the block's broadcast goes."""
    shared = texts.sparkSession.sparkContext.broadcast(items)
    found = texts.withColumn("_leaks", finder(shared, errors, min_chars)("_text")).drop("_text").filter(F.size("_leaks") > 0)
    found = written(found.groupBy("_a", "_b").agg(F.first("_leaks").alias("_leaks")), "benchmark-leaks")
    shared.destroy()
    return found


def digest(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """One row for each document and test item in it."""
    held = match(docs.select("doc_id", "text"), benchmark, leaks_col="_leaks", **parameters).select("doc_id", F.explode("_leaks").alias("leak"))
    return held.select("doc_id", "leak.item_id", "leak.distance", "leak.start", "leak.end")
