import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from listing_lake.llm import packing
from listing_lake.llm.queries import vocabulary


def checked(rows, got, capacity):
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for slots in bins.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        edges = [0, first, *range(first + capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    return len(bins)


def test_every_piece_has_a_place(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "word " * int(n), "x") for i, n in enumerate(rng.integers(0, 120, 300))]
    rows += [(1000, None, "x"), (None, "null id", "y"), (5, "again", None), (5, "again", None), (1001, "a b " * 500, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = packing.digest(docs, tokenizer=vocabulary("byte_bpe_50k.json"), end_id=2, capacity=128, shard_pieces=100).collect()
    used = checked(rows, got, 128)
    assert used <= 1.03 * sum(r.length for r in got) / 128 + 5
    assert packing.digest(docs.filter("doc_id = -1"), tokenizer=vocabulary("byte_bpe_50k.json"), end_id=2).collect() == []


def test_genetic_steps_keep_the_pieces():
    import random

    rng = random.Random(3)
    sizes = Counter(rng.randint(1, 100) for _ in range(500))
    one, two = packing.best_fit([], sizes, 100), packing.scattered(sizes, 100, rng)
    for plan in (one, two, packing.crossover(one, two, sizes, 100, rng), packing.mutate(two, 100, rng)):
        assert Counter(n for b in plan for n in b) == sizes
        assert max(map(sum, plan)) <= 100
    best = packing.evolve(sizes, 100, "s", [two], 6, 20)
    assert len(best) <= min(len(one), len(two))
    assert packing.decoded(*packing.coded(best)) == best


def test_crossover_wins_bins():
    """Where best-fit leaves bins to win, the search wins most of them, and more with crossover than without."""
    import random

    bound = fit = with_it = without = 0
    for k in range(12):
        rng = random.Random(k)
        sizes = Counter(rng.randint(30, 200) for _ in range(400))
        bound += -(-sum(n * c for n, c in sizes.items()) // 300)
        fit += len(packing.best_fit([], sizes, 300))
        with_it += len(packing.evolve(sizes, 300, f"{k}", [], 6, 40, 12))
        without += len(packing.evolve(sizes, 300, f"{k}", [], 6, 40, 12, False))
    assert bound <= with_it < without < fit and with_it - bound <= 0.1 * (fit - bound)


def test_full_pieces_stay_where_they_are(spark):
    """Pieces of full length are never shuffled, however many there are, and each is a sequence of its own."""
    parts = spark.range(5000).selectExpr("id % 50 AS doc_id", "CAST(id AS int) AS piece", "1024 * id AS start", "CASE WHEN id % 100 = 0 THEN 7L ELSE 1024L END AS length")
    got = packing.pack(parts).collect()
    full = [r.sequence_id for r in got if r.length == 1024]
    assert len(got) == 5000 and len(full) == len(set(full)) == 4950 and max(full) < 0 and all(r.offset == 0 for r in got if r.length == 1024)
    assert len({r.sequence_id for r in got if r.length == 7}) == 1
    plan = packing.pack(parts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.rindex("monotonically_increasing_id") > max(plan.rindex("Window"), plan.rindex("Join"))
