import re

import numpy as np
import xxhash

from listing_lake.llm import simhash


def brute(rows, distance=4):
    fps = []
    for _, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", lower)
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    ids = {}
    for (doc_id, _), p in zip(rows, part, strict=True):
        if doc_id is not None:
            ids[p] = min(ids.get(p, doc_id), doc_id)
    return sorted((str(r[0]), f"{f:016x}", ids.get(p)) for r, f, p in zip(rows, fps, part, strict=True))


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = list(rng.choice(vocabulary, 120)) if i % 3 or not rows else rows[rng.integers(len(rows))][1].split()
        if words and rng.random() < 0.7:
            words[rng.integers(len(words))] = "X"
        rows.append((int(rng.integers(10**6)), " ".join(words)))
    return rows


def test_components_match_brute_force(spark, monkeypatch):
    rows = texts(np.random.default_rng(4), 250)
    rows += [(5, None), (7, ""), (6, " \t\n"), (None, "a b"), (8, "A\x0bB"), (9, "é \x85 ñ"), (1, rows[0][1]), (1, rows[0][1]), (3, "long word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS component_id").repartition(3)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.digest(docs).collect())
    assert got == brute(rows)
    assert simhash.digest(docs.filter("doc_id = -1")).collect() == []


def test_large_groups_lose_no_link(spark, monkeypatch):
    """A tight cluster many times the size of a chunk, and its links against all pairs."""
    monkeypatch.setattr(simhash, "CHUNK", 50)
    rng = np.random.default_rng(6)
    center = rng.integers(0, 2**64, 3, dtype=np.uint64)
    fps = {int(c) for c in center}
    while len(fps) < 700:
        flips = rng.choice(64, rng.integers(1, 6), replace=False)
        fps.add(int(center[rng.integers(3)]) ^ sum(1 << int(b) for b in flips))
    a = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(a[:, None] ^ a) <= 4
    part = np.arange(len(a))
    while True:
        new = np.array([part[n].min() for n in near])
        if (new == part).all():
            break
        part = new
    frame = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    roots = {r.u: r.v for r in simhash.stars(simhash.near_pairs(frame, 4), "test").collect()}
    got = [roots.get(int(x), int(x)) for x in a.view(np.int64)]
    assert len(set(zip(got, part, strict=True))) == len(set(got)) == len(set(part))


def test_index_finds_what_all_pairs_find():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(60)]))
    i, j = simhash.links(simhash.GrayIndex(fps), simhash.GrayIndex(fps), 4, True)
    want = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= 4, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


def test_runs_of_groups_under_one_index(monkeypatch):
    """Groups of all sizes, many under one index: the links of each group, and none between groups."""
    monkeypatch.setattr(simhash, "RUN", 40)
    rng = np.random.default_rng(9)
    sizes = [1, 2, 2, 3, 9, 70, 1, 8, 2, 150, 2]
    group = np.repeat(np.arange(len(sizes)), sizes)
    center = rng.integers(0, 2**64, 2, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in group], np.uint64)
    fps = center[rng.integers(0, 2, len(group))] ^ flips
    rank = lambda x: sum(((int(x) >> k).bit_count() & 1) << k for k in range(64))
    order = sorted(range(len(group)), key=lambda k: (group[k], rank(fps[k])))
    fps = fps[order]
    index = simhash.GrayIndex(fps, group)
    i, j = simhash.links(index, index, 4, True)
    near = (np.bitwise_count(fps[:, None] ^ fps) <= 4) & (group[:, None] == group)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(np.triu(near, 1)).tolist()))
    runs = list(simhash.edges_within(fps, group, 4))
    assert len(runs) > 2
    member, root = simhash.forest(len(fps), i, j)
    assert sum(len(u) for u, _ in runs) == len(member) == len(root)
