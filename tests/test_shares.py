"""Groups in order over many tasks: against plain loops, with shares that cut through groups, and no window over a whole group."""

import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_lake.operators import comparables, observations, shared, training


@pytest.fixture
def many_shares(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set(name, "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset(name)


def test_running_sums(spark, many_shares):
    rows = [(None if k == 3 else k, i, i % 5) for k in (1, 2, 3) for i in range(400 if k == 1 else 7)]
    frame = spark.createDataFrame(rows, "k int, i int, v long").repartition(5)
    got = shared.with_running(frame, F.struct("k"), [F.col("i")], "v", "test")
    assert got.select("_part").distinct().count() > 3
    want = {(k, i): sum(i2 % 5 for i2 in range(i + 1)) for k, i, _ in rows}
    assert {(r.k, r.i): r._upto for r in got.collect()} == want


def test_temporal_split_is_that_of_ranks(spark, many_shares):
    rng = np.random.default_rng(1)
    rows = [("hot", int(t), i) for i, t in enumerate(rng.integers(0, 60, 500))] + [("ties", 5, i) for i in range(90)] + [("few", None if i < 1 else i, i) for i in range(6)] + [("bad", None, i) for i in range(40)] + [(None, i, i) for i in range(10)]
    frame = spark.createDataFrame(rows, "k string, t long, i int").repartition(4)
    got = {(r.k, r.i): r.part for r in training.temporal_split(frame, ["k"], "t", ["i"]).collect()}
    for key in ("hot", "ties", "few", None):
        timed = sorted((t, i) for k, t, i in rows if k == key and t is not None)
        cut = min(max(int(len(timed) * 0.8), 1), len(timed) - 1)
        assert [got.pop((key, i)) for _, i in timed] == ["train"] * cut + ["test"] * (len(timed) - cut)
    assert len(got) == 40 and {k for k, _ in got} == {"bad"} and set(got.values()) == {"train", "test"}


def test_even_sample_is_that_of_ranks(spark, many_shares):
    rng = np.random.default_rng(2)
    rows = [("hot", int(v), i) for i, v in enumerate(rng.integers(0, 9, 300))] + [("one", 1, 1), (None, 2, 1), (None, None, 2), ("two", 1, 1), ("two", 1, 2)]
    frame = spark.createDataFrame(rows, "k string, v int, i int").repartition(4)
    got = sorted((str(r.k), str(r.v), r.i) for r in observations.even_sample(frame, "k", ["v", "i"], 7).collect())
    want = []
    for key in ("hot", "one", "two", None):
        some = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want += [some[p] for p in sorted({int(i / 6 * (len(some) - 1) + 0.5) for i in range(7)})]
    assert got == sorted((str(k), str(v), i) for k, v, i in want)


def test_comparables_without_own_price_are_those_of_plain_lists(spark, many_shares):
    rng = np.random.default_rng(3)
    rows = [("hot", float(p)) for p in rng.integers(1, 90, 700)] + [("hot", 30.0)] * 900 + [("one", 4.0)] + [("two", 1.0), ("two", 2.0)] + [(None, float(p)) for p in (1, 2, 2, 9)]
    frame = spark.createDataFrame(rows, "k string, p double").repartition(4)
    got = {(r.k, r.p): (r.market_floor, r.market_median, r.market_spread, r.comparables_count) for r in comparables.excluding_own_price(frame, ["k"], "p").collect()}
    assert len(got) == len(set(rows))
    for (key, price), told in got.items():
        rest = [p for k, p in rows if k == key and p != price]
        assert told == ((min(rest), statistics.median(rest), max(rest) - min(rest), len(rest)) if rest else (price, price, 0.0, 1))


def test_no_window_holds_a_group(spark):
    frame = spark.createDataFrame([("a", 1.0, 1)], "k string, p double, i int")
    plans = [
        comparables.excluding_own_price(frame, ["k"], "p"), observations.even_sample(frame, "k", ["p", "i"], 3), training.temporal_split(frame.withColumn("t", F.col("i")), ["k"], "t", ["i"]),
    ]
    for df in plans:
        for window in re.findall(r"Window \[.*", df._jdf.queryExecution().executedPlan().toString()):
            assert "_part" in window
