"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: majority bits of the XXH64 of word shingles. Distinct fingerprints are linked when at most ``distance`` bits
differ, and classes are connected components; a document's component id is the smallest document id in its class.

Finding links: 64 bits are cut into ``distance + 2`` blocks; fingerprints within the distance agree on two blocks at least,
so they meet in one of the buckets that two blocks' bits name. A bucket of more than CHUNK fingerprints is dealt into chunks
and becomes a task group for each pair of chunks, so no group grows with the data. A task lays its groups one after the other,
each in Gray rank order, and builds one index over a run of them: nodes over NODE neighbours hold the bits that all of them
share (mask and pattern) and the range of groups they lie in, nodes over those likewise. The search goes down from the top: two
nodes whose shared bits differ in more than ``distance`` places, or that have no group in common, are pruned with all that is
below. All links come from that search. A group gives a spanning forest of its links, never all pairs. Components are then
found by alternating large and small stars on written edge tables.

A null, empty or wordless text has fingerprint zero and is linked like any other. Repeated rows are one class. Null ids
join classes but never name one, unless there is no other id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.llm.common import written
from listing_lake.llm.tokens import forget

CHUNK, NODE, SALT = 1024, 8, 32
#: Fingerprints under one index: runs of groups end at the first group behind so many.
RUN = 2048
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    digest, joined = xxhash.xxh64_digest, b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    pairs = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in pairs]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """``_id``, ``fp`` (the fingerprint as a signed long) and the long columns ``keys`` of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch[1].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(found, pa.int64()), *batch.columns[2:]], ["_id", "fp", *keys])

    schema = ", ".join(f"{c} long" for c in ("_id", "fp", *keys))
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *keys).mapInArrow(each, schema)


def gray_rank(fp: Column) -> Column:
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def bucket_keys(fp: Column, distance: int) -> Column:
    """The bits of every two blocks, with the number of the two."""
    n = distance + 2
    edges = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in itertools.pairwise(edges)]
    widths = [b - a for a, b in itertools.pairwise(edges)]
    keys = [
        F.lit(k << 40).cast("long").bitwiseOR(F.shiftleft(block[i], widths[j])).bitwiseOR(block[j])
        for k, (i, j) in enumerate(itertools.combinations(range(n), 2))
    ]
    return F.array(*keys)


class GrayIndex:
    """Nodes over fingerprints in order of their group and Gray rank; level 0 is the fingerprints themselves. A node is the bits
    that all below it share, which bits these are, and its first and last group."""

    def __init__(self, fps: np.ndarray, group: np.ndarray | None = None):
        every = np.full(len(fps), np.iinfo(np.uint64).max, np.uint64)
        group = np.zeros(len(fps), np.int64) if group is None else group
        self.levels = [(fps, every, group, group)]
        while len(self.levels[-1][0]) > NODE:
            self.levels.append(self.above())

    def above(self) -> tuple[np.ndarray, ...]:
        """The level over the highest one."""
        pattern, mask, first, last = self.levels[-1]
        at = np.arange(0, len(pattern), NODE)
        ones = np.bitwise_and.reduceat(pattern, at)
        same = ~(ones ^ np.bitwise_or.reduceat(pattern, at)) & np.bitwise_and.reduceat(mask, at)
        return ones & same, same, first[at], last[np.minimum(at + NODE, len(last)) - 1]


def links(a: GrayIndex, b: GrayIndex, distance: int, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of one group within the distance, level by level from the top; the indexes have as many levels."""
    top = len(a.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[top][0])), np.arange(len(b.levels[top][0])), indexing="ij"))
    for level in range(top, -1, -1):
        (pa_, ma, fa, la), (pb, mb, fb, lb) = a.levels[level], b.levels[level]
        if level < top:
            step = np.arange(NODE)
            i, j = (i[:, None, None] * NODE + step[:, None] + 0 * step), (j[:, None, None] * NODE + step + 0 * step[:, None])
            i, j = i.ravel(), j.ravel()
            there = (i < len(pa_)) & (j < len(pb))
            i, j = i[there], j[there]
        if itself:
            i, j = (x[(i < j) if level == 0 else (i <= j)] for x in (i, j))
        met = (fa[i] <= lb[j]) & (fb[j] <= la[i])
        i, j = i[met], j[met]
        near = np.bitwise_count((pa_[i] ^ pb[j]) & ma[i] & mb[j]) <= distance
        i, j = i[near], j[near]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and roots: one edge for each position that isn't the first of its component."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def edges_between(fps: np.ndarray, side: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the two sides of a pair of chunks."""
    left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    a, b = GrayIndex(fps[left]), GrayIndex(fps[right])
    for x in (a, b):
        while len(x.levels) < max(len(a.levels), len(b.levels)):
            x.levels.append(x.above())
    i, j = links(a, b, distance, False) if len(left) and len(right) else (left[:0], left[:0])
    member, root = forest(len(fps), left[i], right[j])
    return fps[member], fps[root]


def edges_within(fps: np.ndarray, group: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of whole groups, a run of groups under one index after the other. ``group`` rises."""
    starts, at = np.flatnonzero(np.diff(group)) + 1, 0
    while at < len(fps):
        later = starts[np.searchsorted(starts, at + RUN) :]
        end = int(later[0]) if len(later) else len(fps)
        index = GrayIndex(fps[at:end], group[at:end])
        member, root = forest(end - at, *links(index, index, distance, True))
        yield fps[at:end][member], fps[at:end][root]
        at = end


def near_pairs(fps: DataFrame, distance: int) -> DataFrame:
    """Edges ``u``, ``v`` between distinct fingerprints that connect all that are linked."""
    members = fps.select("fp", F.explode(bucket_keys(F.col("fp"), distance)).alias("key"))
    full = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = members.join(full, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    members = members.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # a pair of chunks c < d is group (c, d); a chunk on its own is group (c, c)
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2)
    grouped = members.select("key", F.least("c", "o").alias("c"), F.greatest("c", "o").alias("d"), "fp", gray_rank(F.col("fp")).alias("gray"), side.cast("int").alias("side"))
    grouped = grouped.repartition("key", "c", "d").sortWithinPartitions("key", "c", "d", "gray")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in itertools.chain(batches, [None]):
            if pdf is not None:
                pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                same = (pdf[["key", "c", "d"]] == pdf[["key", "c", "d"]].iloc[-1]).all(axis=1).to_numpy() if len(pdf) else np.zeros(0, bool)
                cut = len(pdf) - int(same.sum())  # the last group may go on in the next batch
                held, pdf = pdf.iloc[cut:], pdf.iloc[:cut]
            else:
                pdf = held
            if pdf is None or not len(pdf):
                continue
            fp, side = pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
            keys = pdf[["key", "c", "d"]].to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            size = np.diff([*begin, len(pdf)])
            group = np.repeat(np.arange(len(size)), size)
            mixed = np.add.reduceat(side > 0, begin) > 0
            alone = ~mixed[group]
            out = [(fp[:0], fp[:0]), *edges_within(fp[alone], group[alone], distance)]
            out += [edges_between(fp[b : b + n], side[b : b + n], distance) for b, n in zip(begin[mixed], size[mixed], strict=True)]
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            yield pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return grouped.mapInPandas(each, "u long, v long").distinct()


def stars(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of edges u > v by alternating stars: (u, v) with v the least node of u's component."""

    def told(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def with_least(rows: DataFrame, least: DataFrame, how: str) -> DataFrame:
        """A node of very many edges is dealt to SALT tasks, and its least neighbour goes to each."""
        salts = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        return rows.withColumn("_s", F.pmod(F.xxhash64("a", "b"), F.lit(SALT)).cast("int")).join(salts, ["a", "_s"], how)

    edges = written(edges, label)
    before = told(edges)
    while before[0]:
        # large star: a node's greater neighbours move to its least neighbour; one without lesser neighbours keeps them
        least = edges.groupBy(F.col("u").alias("a")).agg(F.min("v").alias("m"))
        moved = with_least(edges.select(F.col("v").alias("a"), F.col("u").alias("b")), least, "left")
        large = written(moved.select(F.col("b").alias("u"), F.coalesce("m", "a").alias("v")).distinct(), label)
        # small star: a node and its lesser neighbours move to the least of them
        least = large.groupBy(F.col("u").alias("a")).agg(F.min("v").alias("m"))
        moved = with_least(large.select(F.col("u").alias("a"), F.col("v").alias("b")), least, "inner")
        pairs = F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("b").alias("u"), F.col("m").alias("v")))
        edges = written(moved.select(F.explode(pairs).alias("e")).select("e.*").filter("u > v").distinct(), label)
        after = told(edges)
        if after == before:
            break
        before = after
    return edges


def classed(distinct: DataFrame, distance: int) -> DataFrame:
    """Adds ``root``, the least fingerprint of the class, to distinct fingerprints."""
    roots = stars(near_pairs(distinct, distance), "simhash-edges")
    joined = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("v", "fp")).drop("v")
    return written(joined, "simhash-classes")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """One row per input row: the id, ``fp`` and ``component_id``."""
    each = written(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "simhash-fp")
    distinct = each.groupBy("fp").agg(F.min("_id").alias("least"))
    classes = classed(distinct, distance)
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(classes.join(names, "root").select("fp", "component_id"), "simhash-classes")
    return each.join(classes, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, keys: tuple[str, ...], *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """The long columns ``keys`` of one row of each class: of the rows with its smallest id, the one of the least keys.
    Null ids come last. Rows combine by fingerprint before they meet by class, so no task holds a class."""
    each = fingerprints(docs, id_col=id_col, text_col=text_col, words=words, keys=keys)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", *keys)).alias("first")
    distinct = written(each.groupBy("fp").agg(first), "simhash-fp")
    return classed(distinct, distance).groupBy("root").agg(F.min("first").alias("first")).select(*(F.col(f"first.{c}").alias(c) for c in keys))


def digest(docs: DataFrame, **parameters) -> DataFrame:
    """The contract's columns."""
    found = near_duplicates(docs, **parameters)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
