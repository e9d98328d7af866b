import math

import numpy as np

from listing_lake.llm import vptree


def brute(rows, k=10):
    good = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 100 == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(q, v, strict=True))), j) for j, v in good if j != i and len(v) == len(q))
            out.setdefault(i, near[:k])
    return out


def compared(spark, rows, **parameters):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS shard").repartition(3)
    got = {}
    for r in sorted(vptree.digest(frame, **parameters).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return got, brute(rows)


def test_factor_one_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:400] = x[0]  # one vector many times, ties everywhere
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [None] * 8), (1400, [1.0, 2.0]), (1401, [1.0, 2.5]), (None, [1.0] * 8), (1500, [])]
    got, want = compared(spark, rows, shard_rows=100, points=5)
    assert got.keys() == {q for q, w in want.items() if w}
    for q, near in got.items():
        assert [n for _, n in near] == [n for _, n in want[q]]
        assert np.allclose([s for s, _ in near], [s for s, _ in want[q]], rtol=0, atol=1e-12)
    assert compared(spark, [(100, [1.0])])[0] == {}


def test_larger_factors_prune_more_and_keep_most():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 16))
    x = centers[rng.integers(20, size=4000)] + 0.3 * rng.normal(size=(4000, 16))
    tree, ids = vptree.Tree(x), np.arange(4000)
    seen, recall = [], []
    exact = vptree.Search(tree, ids, x[:50], ids[:50], 10, 1.0)
    for factor in (1.0, 1.1, 3.0):
        got = vptree.Search(tree, ids, x[:50], ids[:50], 10, factor)
        seen.append(got.seen)
        recall.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got.names, exact.names, strict=True)]))
    assert seen[0] > seen[1] > seen[2] and recall[0] == 1 and recall[1] > 0.9


def test_repeated_queries_are_one(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50, 250)]
    frame = spark.createDataFrame([*rows, rows[50], rows[50], (200, [9.0, 9.0, 9.0, 9.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.digest(frame, shard_rows=40).collect():
        got.setdefault(r.query_id, []).append(r.rank)
    assert sorted(got[100]) == list(range(1, 11)) and sorted(got[200]) == sorted([*range(1, 11)] * 2)


def test_lengths_beyond_the_points_are_searched_too(spark):
    rows = [(100 * i + j, [float(i * j + 1)] * (i + 1)) for i in range(8) for j in range(12)]
    got, want = compared(spark, rows, points=3, shard_rows=4)
    assert {q: [n for _, n in near] for q, near in got.items()} == {q: [n for _, n in near] for q, near in want.items() if near}
