"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut; the first piece takes the remainder).
Pieces are dealt by hash to shards of a bounded number of pieces. Pieces of one length are interchangeable, so a shard is a
histogram of lengths, and a chromosome is a list of bins, each a list of lengths. Each shard has several islands, each in a
task of its own. On an island, crossover injects whole well-filled bins of one parent, drops the other parent's bins that
would use a piece twice, and best-fits the displaced pieces; mutation takes bins with room and some full ones apart and fills
them anew, each as far as any choice of its pieces can. Between rounds, each island's elite moves to the next island
of its shard. The best plan of a shard then gives each piece its sequence and offset by its rank among equal lengths.

Null texts count as empty: a document of the end id alone. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listing_lake.llm.common import written
from listing_lake.llm.tokens import MEMO_ENTRIES

Bin = list[int]
LOOSE = 400


def pieces(docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """Every document's pieces: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and ``ids`` (little-endian uint32 bytes; null
    without ``keep_ids``: then they never leave the worker)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from listing_lake.llm.tokens import encoder

        encode, end = encoder(tokenizer, memo_entries), np.array([end_id], "<u4").tobytes()
        names = ["_id", "piece", "start", "length", "ids_crc32", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        # a few texts at a time: the ids of a whole batch would be the largest thing in the worker
        for some in (batch.slice(k, 500) for batch in batches for k in range(0, batch.num_rows, 500)):
            rows: list[tuple] = []
            for name, text in zip(some[0].to_pylist(), some[1].to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(itertools.pairwise(edges)):
                    piece_ids = ids[4 * a : 4 * b]
                    rows.append((name, k, a, b - a, zlib.crc32(piece_ids), piece_ids if keep_ids else None))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(cut, "_id long, piece int, start long, length long, ids_crc32 long, ids binary").withColumnRenamed("_id", id_col)


def best_fit(bins: list[Bin], left: Counter, capacity: int) -> list[Bin]:
    """Put the pieces of ``left`` (length to count), longest first, each into the fullest bin that still takes it."""
    bins = [list(b) for b in bins]
    room: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        room.setdefault(capacity - sum(b), []).append(i)
    open_rooms = sum(1 << r for r in room if r)
    for length in sorted(left, reverse=True):
        for _ in range(left[length]):
            fits = open_rooms >> length
            if fits:
                r = length + (fits & -fits).bit_length() - 1
                i = room[r].pop()
                if not room[r]:
                    open_rooms ^= 1 << r
                bins[i].append(length)
            else:
                r, i = capacity, len(bins)
                bins.append([length])
            if rest := r - length:
                room.setdefault(rest, []).append(i)
                open_rooms |= 1 << rest
    return bins


def scattered(sizes: Counter, capacity: int, rng: random.Random) -> list[Bin]:
    """A first plan unlike the others: some pieces go in at random before the rest are best-fitted."""
    early = Counter({n: rng.randint(0, c // 2) for n, c in sizes.items()})
    order = [n for n, c in early.items() for _ in range(c)]
    rng.shuffle(order)
    bins: list[Bin] = [[]]
    for n in order:
        if sum(bins[-1]) + n > capacity:
            bins.append([])
        bins[-1].append(n)
    bins = [b for b in bins if sum(b) >= 0.97 * capacity]
    return best_fit(bins, sizes - Counter(n for b in bins for n in b), capacity)


def crossover(one: list[Bin], two: list[Bin], sizes: Counter, capacity: int, rng: random.Random) -> list[Bin]:
    """Inject well-filled bins of ``one`` into ``two``."""
    full = [b for b in one if sum(b) >= 0.995 * capacity]
    child = [b for b in full if rng.random() < 0.6]
    left = Counter(sizes)
    for b in child:
        left.subtract(b)
    for b in sorted(two, key=sum, reverse=True):
        need = Counter(b)
        if sum(b) >= 0.9 * capacity and all(left[n] >= c for n, c in need.items()):
            child.append(b)
            left.subtract(need)
    return best_fit(child, +left, capacity)


def filled(pieces: list[int], capacity: int) -> list[Bin]:
    """Bins filled one after the other: the longest piece left, and those that leave least room beside it. ``sums[k]`` has a
    bit for every sum of the first k of the rest."""
    left, bins = sorted(pieces, reverse=True), []
    while left:
        room = capacity - left[0]
        low, sums = (1 << room + 1) - 1, [1]
        for n in left[1:]:
            sums.append((sums[-1] | sums[-1] << n) & low if n <= room else sums[-1])
            if sums[-1] >> room & 1:
                break
        best, k, used = sums[-1].bit_length() - 1, len(sums) - 1, []
        while best:
            while sums[k - 1] >> best & 1:
                k -= 1
            used.append(k)
            best -= left[k]
            k -= 1
        bins.append([left[0], *(left[k] for k in used)])
        for k in [*used, 0]:
            del left[k]
    return bins


def mutate(plan: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """Take bins with room (at most LOOSE of them) and some full ones apart, and fill bins anew with what was in them."""
    loose, full = [], []
    for i, b in enumerate(plan):
        (loose if sum(b) < capacity else full).append(i)
    out = {*rng.sample(loose, min(LOOSE, len(loose))), *rng.sample(full, min(LOOSE // 4, len(full)))}
    return [b for i, b in enumerate(plan) if i not in out] + filled([n for i in out for n in plan[i]], capacity)


def fitness(plan: list[Bin], capacity: int) -> tuple[int, float]:
    return len(plan), -sum((sum(b) / capacity) ** 2 for b in plan)


def evolve(sizes: Counter, capacity: int, seed: str, elites: list[list[Bin]], population: int, generations: int, patience: int = 2, cross: bool = True) -> list[Bin]:
    """One island's round: the best plan it finds. It ends when no plan can use fewer bins, or when ``patience`` generations have
    found no better one. Without ``cross`` children are mutations alone."""
    rng = random.Random(seed)
    least = -(-sum(n * c for n, c in sizes.items()) // capacity)
    value = lambda p: fitness(p, capacity)
    plans = sorted(elites or [best_fit([], sizes, capacity), scattered(sizes, capacity, rng)], key=value)
    idle = 0
    for _ in range(generations):
        if len(plans[0]) == least or idle == patience:
            break
        before = value(plans[0])
        two = plans[rng.randrange(1, len(plans))] if len(plans) > 1 else plans[0]
        child = crossover(plans[0], two, sizes, capacity, rng) if cross and (len(plans) > 2 or elites) else plans[0]
        plans = sorted([*plans, mutate(child, capacity, rng)], key=value)[:population]
        idle = idle + 1 if value(plans[0]) == before else 0
    return plans[0]


def coded(plan: list[Bin]) -> tuple[bytes, bytes]:
    return np.array([len(b) for b in plan], "<i4").tobytes(), np.array([n for b in plan for n in b], "<i4").tobytes()


def decoded(counts: bytes, lengths: bytes) -> list[Bin]:
    ends = np.cumsum(np.frombuffer(counts, "<i4"))
    return [b.tolist() for b in np.split(np.frombuffer(lengths, "<i4"), ends[:-1])] if len(ends) else []


ELITE = "shard long, island int, bins int, counts binary, lengths binary"


def plans(sizes: DataFrame, shards: int, *, capacity: int, islands: int, rounds: int, population: int, generations: int, patience: int) -> DataFrame:
    """The best plan of each shard. ``sizes``: shard, length, n."""
    # Groups cost seconds and few bytes: deal them by number, or they would be put together by size.
    tasks = min(shards * islands, 2000)
    rows = written(sizes, "packing-sizes").withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(islands)))))
    rows = rows.repartition(tasks, "shard", "island")
    elites = None
    for turn in range(rounds):

        def search(key: tuple, hist: pd.DataFrame, found: list[list[Bin]], turn: int) -> pd.DataFrame:
            count = Counter(dict(zip(hist["length"].tolist(), hist["n"].tolist(), strict=True)))
            best = evolve(count, capacity, f"{key}-{turn}", found, population, generations, patience)
            return pd.DataFrame([(key[0], key[1], len(best), *coded(best))], columns=["shard", "island", "bins", "counts", "lengths"])

        def first(key, hist):
            return search(key, hist, [], 0)

        def seeded(turn: int):
            def later(key, hist, came):
                return search(key, hist, [decoded(c, n) for c, n in zip(came["counts"], came["lengths"], strict=True)], turn)

            return later

        if elites is None:
            elites = rows.groupBy("shard", "island").applyInPandas(first, ELITE)
        else:
            moved = elites.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
            came = elites.unionByName(moved).repartition(tasks, "shard", "island")
            both = rows.groupBy("shard", "island").cogroup(came.groupBy("shard", "island"))
            elites = both.applyInPandas(seeded(turn), ELITE)
        elites = written(elites, "packing-elites")
    best = F.min_by(F.struct("counts", "lengths"), F.struct("bins", "island")).alias("plan")
    return elites.groupBy("shard").agg(best).select("shard", "plan.counts", "plan.lengths")


def places(plan: DataFrame) -> DataFrame:
    """A plan's slots: shard, length, ``rank`` among the shard's slots of that length, sequence_id and offset."""

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, counts, lengths in zip(batch["shard"], batch["counts"], batch["lengths"], strict=True):
                n, each = np.frombuffer(counts, "<i4"), np.frombuffer(lengths, "<i4").astype("int64")
                bins = np.repeat(np.arange(len(n)), n)
                ends = np.cumsum(each)
                begin = np.repeat(ends[np.cumsum(n) - 1] - np.add.reduceat(each, np.cumsum(n) - n), n) if len(n) else ends
                out = pd.DataFrame({"shard": shard, "length": each, "sequence_id": bins + (int(shard) << 24), "offset": ends - each - begin})
                yield out.assign(rank=out.groupby("length").cumcount() + 1)

    return plan.mapInPandas(slots, "shard long, length long, sequence_id long, offset long, rank long")


def pack(
    parts: DataFrame, *, capacity: int = 1024, id_col: str = "doc_id", shard_pieces: int = 8192,
    islands: int = 2, rounds: int = 2, population: int = 6, generations: int = 6, patience: int = 2,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (a written table, so that counting them costs little). Any columns
    beside the id, ``piece`` and ``length`` come along."""
    # a piece of full length is a sequence of its own: it is never shuffled, and negative numbers keep it apart from the plans'
    full = parts.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    loose = parts.filter(F.col("length") < capacity)
    n = max(1, math.ceil(loose.count() / shard_pieces))
    dealt = loose.withColumn("_shard", F.pmod(F.xxhash64(F.col(id_col), F.col("piece")), F.lit(n)))
    sizes = dealt.groupBy(F.col("_shard").alias("shard"), "length").agg(F.count("*").alias("n"))
    plan = plans(sizes, n, capacity=capacity, islands=islands, rounds=rounds, population=population, generations=generations, patience=patience)
    ranked = dealt.withColumn("_rank", F.row_number().over(W.partitionBy("_shard", "length").orderBy(id_col, "piece", "start")).cast("long"))
    slot = places(plan).select(F.col("shard").alias("_shard"), F.col("length").alias("_length"), F.col("rank").alias("_rank"), "sequence_id", "offset")
    same = (ranked["_shard"] == slot["_shard"]) & (ranked["length"] == slot["_length"]) & (ranked["_rank"] == slot["_rank"])
    placed = ranked.join(slot, same).drop(slot["_shard"]).drop(slot["_rank"])
    return placed.select(*parts.columns, "sequence_id", "offset").unionByName(full)


def digest(docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int = 1024, memo_entries: int = MEMO_ENTRIES, **parameters) -> DataFrame:
    """The contract's columns: ids stay in the task that made them, their checksum and length travel."""
    parts = written(pieces(docs, tokenizer=tokenizer, end_id=end_id, capacity=capacity, keep_ids=False, memo_entries=memo_entries).drop("ids"), "packing-pieces")
    return pack(parts, capacity=capacity, **parameters)
