"""Nearest neighbours by vantage-point trees, one per shard.

Vectors go to the nearest of a bounded number of top-level vantage points, and those of one point by hash to shards of a
bounded size. Every query first searches one shard of its own vantage point; that gives it a radius. It then goes to each
shard that the triangle inequality, with the gap between the query and the shard's ring around its vantage point stretched by
``factor``, can't rule out. A shard's rows lie together, vectors before queries: one task reads the vectors, builds their
tree once, and searches it for the queries a block at a time. So vectors move once, queries as often as shards are open to
them, and no group grows with the data. In the tree, a node's vantage point splits its vectors at the median distance, and a
side is pruned by the same rule. Factor 1 is exact search; larger factors prune more. Distances are Euclidean in double
precision on the original vectors; ties go to the smaller id.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or candidates, and
neither do rows without an id. Only vectors of one length are compared. Repeated rows are candidates each, but a row is
never the neighbour of its own id. Queries alike in id and vector are one query; one id with two vectors is two queries.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listing_lake.llm.common import written

LEAF, BLOCK = 64, 512
FOUND = "query_id long, query_key long, vec_id long, score double"


class Tree:
    """A vantage-point tree over the rows of ``x``: a node is (rows, None) for a leaf, or (vantage row, radius, near, far)."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x, self.rng = x, np.random.default_rng(seed)
        self.root = self.node(np.arange(len(x)))

    def node(self, rows: np.ndarray) -> tuple:
        if len(rows) <= LEAF:
            return rows, None
        vantage = rows[self.rng.integers(len(rows))]
        away = distances(self.x[rows], self.x[vantage][None])[:, 0]
        order = np.argsort(away, kind="stable")
        half = len(rows) // 2
        return vantage, float(away[order[half - 1]]), float(away[order[half]]), self.node(rows[order[:half]]), self.node(rows[order[half:]])


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x (rows) to all of q (columns), summed over differences: zero for equal rows."""
    out = np.empty((len(x), len(q)))
    for k in range(0, len(x), 256):
        gap = x[k : k + 256, None] - q[None]
        out[k : k + 256] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


class Search:
    """The k best rows of a tree for a block of queries, which go down the tree together."""

    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, radius: np.ndarray | None = None):
        self.tree, self.ids, self.q, self.query_ids, self.k, self.factor = tree, ids, queries, query_ids, k, factor
        self.best = np.full((len(queries), k), np.inf)
        self.radius = np.full(len(queries), np.inf) if radius is None else radius  # what lies beyond isn't wanted
        self.names = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.seen = 0
        self.visit(tree.root, np.arange(len(queries)))

    def offer(self, rows: np.ndarray, some: np.ndarray) -> None:
        away = distances(self.tree.x[rows], self.q[some]).T
        self.seen += away.size
        names = np.broadcast_to(self.ids[rows], away.shape)
        away = np.where(names == self.query_ids[some][:, None], np.inf, away)
        away, names = np.hstack([self.best[some], away]), np.hstack([self.names[some], names])
        order = np.lexsort((names, away))[:, : self.k]
        self.best[some], self.names[some] = np.take_along_axis(away, order, 1), np.take_along_axis(names, order, 1)

    def visit(self, node: tuple, some: np.ndarray) -> None:
        if not len(some):
            return
        if node[1] is None:
            return self.offer(node[0], some)
        vantage, inner, outer, near, far = node
        away = distances(self.tree.x[vantage][None], self.q[some])[0]
        inside = away <= (inner + outer) / 2
        # how far a query must go to reach either side at all; never less than the true bound would be off by rounding
        slack = 1e-9 * (1 + away)
        gaps = ((near, away - inner - slack), (far, outer - away - slack))
        for group, order in ((inside, gaps), (~inside, gaps[::-1])):
            for child, gap in order:
                open_ = group & (gap * self.factor <= np.minimum(self.best[some, self.k - 1], self.radius[some]))
                self.visit(child, some[open_])


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, and not all zero."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda c: c != 0)


def to_points(points: list[list[float]]):
    """A column function: the number of the nearest vantage point of the same length (-1: none is), and the distances to all."""
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(points):
        by_length.setdefault(len(p), []).append(i)
    held = {n: np.array([points[i] for i in some]) for n, some in by_length.items()}

    def nearest(vectors: pd.Series) -> pd.DataFrame:
        point, first, all_away = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors), np.int32), [np.zeros(0)] * len(vectors)
        size = vectors.map(len).to_numpy()
        for n, some in by_length.items():
            at = np.flatnonzero(size == n)
            if len(at):
                away = distances(np.stack(vectors.iloc[at].to_numpy()).astype(float), held[n])
                point[at], first[at] = np.array(some, np.int32)[away.argmin(axis=1)], some[0]
                for i, row in zip(at, away, strict=True):
                    all_away[i] = row
        return pd.DataFrame({"point": point, "away": all_away, "first": first})

    return F.pandas_udf(nearest, "point int, away array<double>, first int")


def shard_search(k: int, factor: float):
    """Rows sorted by shard, vectors before queries; every query's k best vectors of its shard."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, vectors, tree = None, [], None
        for pdf in batches:
            mark = pdf[["dim", "point", "part"]].to_numpy()
            cuts = np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1
            for begin, end in itertools.pairwise([0, *cuts, len(pdf)]):
                if end == begin:
                    continue
                rows, here = pdf.iloc[begin:end], tuple(mark[begin])
                if here != at:
                    at, vectors, tree = here, [], None
                asked = rows["query_key"].notna().to_numpy()
                if not asked.all():
                    vectors.append(rows[~asked])
                rows = rows[asked]
                if not len(rows) or not vectors:
                    continue
                if tree is None:
                    base = pd.concat(vectors).sort_values("id")
                    names, tree = base["id"].to_numpy(np.int64), Tree(np.stack(base["vector"].to_numpy()))
                for some in (rows.iloc[i : i + BLOCK] for i in range(0, len(rows), BLOCK)):
                    ids = some["id"].to_numpy(np.int64)
                    got = Search(tree, names, np.stack(some["vector"].to_numpy()), ids, k, factor, some["radius"].to_numpy(float))
                    there = np.isfinite(got.best) & (got.names != np.iinfo(np.int64).max)
                    told = (np.repeat(x, k)[there.ravel()] for x in (ids, some["query_key"].to_numpy(np.int64)))
                    yield pd.DataFrame(dict(zip(("query_id", "query_key", "vec_id", "score"), (*told, got.names[there], got.best[there]), strict=True)))

    return find


def search(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, factor: float = 1.0,
    shard_rows: int = 4096, points: int = 64,
) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of each query's k nearest vectors. ``points``: the most top-level
    vantage points of each vector length; they are what is collected and sent to the tasks."""

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return df.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))

    base, asked = clean(vectors), clean(queries)
    spread = F.xxhash64("vector", F.lit("point"))
    counts = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(points).collect()}
    chosen = []
    for dim, n in counts.items():
        want = min(points, math.ceil(n / shard_rows))
        rows = base.filter(F.col("dim") == dim).groupBy("vector").agg(F.first(spread).alias("h")).orderBy("h", "vector").limit(want)
        chosen += [list(r.vector) for r in rows.collect()]
    near = to_points(chosen)
    base = base.withColumn("near", near("vector"))
    own = F.get("near.away", F.col("near.point") - F.col("near.first"))
    base = written(base.select("id", "vector", "dim", F.col("near.point").alias("point"), own.alias("away")), "vptree-vectors")
    # shards of each vantage point, and the ring around it that holds them: a row for each of at most ``points`` points of at
    # most ``points`` lengths, and one for each other length
    rings = base.groupBy("dim", "point").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"), F.min("away").alias("low"), F.max("away").alias("high"))
    rings = F.broadcast(written(rings, "vptree-rings"))
    placed = base.join(rings, ["dim", "point"]).withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.col("parts")).cast("int"))
    placed = written(placed.select("id", "vector", "dim", "point", "part"), "vptree-shards")

    asked = asked.withColumn("query_key", F.xxhash64("vector")).dropDuplicates(["id", "query_key", "vector"])
    asked = asked.withColumn("near", near("vector"))
    asked = written(asked.select("id", "vector", "dim", "query_key", F.col("near.point").alias("point"), "near.away", "near.first"), "vptree-queries")

    def found(pairs: DataFrame) -> DataFrame:
        rows = placed.select("dim", "point", "part", "id", "vector", F.lit(None).cast("long").alias("query_key"), F.lit(None).cast("double").alias("radius"))
        rows = rows.unionByName(pairs.select("dim", "point", "part", "id", "vector", "query_key", "radius"))
        rows = rows.repartition("dim", "point", "part").sortWithinPartitions("dim", "point", "part", F.col("query_key").asc_nulls_first())
        return rows.mapInPandas(shard_search(k, factor), FOUND)

    home_part = F.pmod(F.xxhash64("id", "query_key"), F.col("parts")).cast("int")
    home = asked.join(rings, ["dim", "point"]).withColumns({"part": home_part, "radius": F.lit(float("inf"))})
    first = written(found(home), "vptree-first")
    radius = first.groupBy(F.col("query_id").alias("id"), "query_key").agg(F.max("score").alias("radius"), F.count("*").alias("n"))
    radius = radius.withColumn("radius", F.when(F.col("n") >= k, F.col("radius")).otherwise(float("inf"))).drop("n")
    rest = asked.withColumnRenamed("point", "own").join(radius, ["id", "query_key"], "left").join(rings, "dim")
    away = F.get("away", F.col("point") - F.col("first"))
    gap = F.when(F.col("point") >= 0, F.greatest(away - F.col("high"), F.col("low") - away)).otherwise(0.0) - (1 + F.coalesce(away, F.lit(0.0))) * 1e-9
    reach = F.coalesce("radius", F.lit(float("inf")))
    rest = rest.filter(gap * factor <= reach).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = rest.filter((F.col("point") != F.col("own")) | (F.col("part") != home_part)).withColumn("radius", reach)
    both = first.unionByName(found(rest))
    order = W.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame, **parameters) -> DataFrame:
    """The contract's columns: rows whose vec_id is divisible by 100 are the queries."""
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0), **parameters)


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c <> 0)) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
