"""Layers, retention, inserts and counters: what is lost, repeated or counted twice, and what must not be."""

import json

import pytest
from pyspark.sql import functions as F

from listing_lake.operators import snapshot
from listing_lake.sources import files
from listing_lake.streaming import intake


def layer(spark, path):
    return sorted((str(r.d), str(r.league), r.id) for r in spark.read.parquet(path).collect())


def test_dates_written_one_after_the_other_both_stay(spark, tmp_path):
    path = str(tmp_path / "layer")
    make = lambda rows: spark.createDataFrame(rows, "d string, league string, id int")
    assert files.write_layer(make([("d1", "A", 1), ("d1", None, 2)]), path, ["d", "league"]) == [("d1", "A"), ("d1", "unknown")]
    assert files.write_layer(make([("d2", "A", 3)]), path, ["d", "league"]) == [("d2", "A")]
    assert layer(spark, path) == [("d1", "A", 1), ("d1", "unknown", 2), ("d2", "A", 3)]
    files.write_layer(make([("d2", "A", 4)]), path, ["d", "league"])
    files.write_layer(make([("d2", "A", 5)]), path, ["d", "league"], mode="append")
    assert layer(spark, path)[2:] == [("d2", "A", 4), ("d2", "A", 5)]
    assert files.write_layer(make([]), path, ["d", "league"]) == []
    got = files.read_partitions(spark, path, [("d1", "unknown")])
    assert [r.id for r in got.collect()] == [2] and files.read_partitions(spark, path, []).collect() == []
    with pytest.raises(ValueError, match="mode"):
        files.write_layer(make([]), path, ["d"], mode="x")


def test_retention_touches_only_what_it_must(spark, tmp_path):
    path = tmp_path / "layer"
    rows = spark.createDataFrame([("2024-01-01", "A", 1), ("2024-01-02", "A/B", 2), ("2024-01-02", "A/B", 3), ("2024-01-03", "A", 4), ("2024-01-03", "B", 6), (None, "A", 5)], "d string, league string, id int")
    files.write_layer(rows, str(path), ["d", "league"])
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert files.drop_partitions(spark, str(path), "d", "2024-01-02", dry_run=True) == ["2024-01-01"] and len(layer(spark, str(path))) == 6
    assert files.drop_partitions(spark, str(path), "d", "2024-01-02") == ["2024-01-01"]
    assert files.rewrite_partitions(spark, str(path), ~F.col("id").isin(3, 4)) == (1, 1)
    assert layer(spark, str(path)) == [("2024-01-02", "A/B", 2), ("2024-01-03", "B", 6), ("unknown", "A", 5)]
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    kept = {p for p in after if "league=B" in str(p) or "unknown" in str(p)}
    assert len(kept) == 2 and all(before[p] == after[p] for p in kept)


def table(spark, target):
    return sorted((str(r.k), r.t, r.v) for r in intake.stored(spark, target).collect())


def test_replayed_batches_add_nothing_and_the_first_row_wins(spark, tmp_path):
    target = str(tmp_path / "events")
    make = lambda rows: spark.createDataFrame(rows, "k string, t int, v string").repartition(1)
    one, two = make([("a", 2, "late"), ("a", 1, "first"), ("a", 1, "second"), (None, 3, "null"), (None, 4, "later")]), make([("a", 0, "again"), (None, 0, "again"), ("b", 5, "new")])
    insert = intake.upsert_batch(target, ["k"], ["t"], "run")
    insert(one, 0)
    want = [("None", 3, "null"), ("a", 1, "first")]
    assert table(spark, target) == want
    insert(one, 0)  # the same batch again, after its rows were stored
    assert table(spark, target) == want
    insert(two, 1)
    insert(two, 1)
    want = sorted([*want, ("b", 5, "new")])
    assert table(spark, target) == want
    intake.upsert_batch(target, ["k"], ["t"], "other")(one.unionByName(two), 0)  # from another checkpoint
    assert table(spark, target) == want
    insert(make([]), 2)
    assert table(spark, target) == want and intake.stored(spark, str(tmp_path / "none")) is None


def test_a_stream_in_batches_counts_rows_and_duplicates(spark, tmp_path):
    """Three batches of a stream; its counters are those of the run, not of the last batch."""
    rows = [[(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], [(1, "2024-01-01 00:01:00"), (3, "2024-01-01 00:01:01")], [(4, "2024-01-01 00:02:00")]]
    progress = intake.RunProgress()
    spark.streams.addListener(progress)
    try:
        for k, part in enumerate(rows):
            spark.createDataFrame(part, "id int, at string").selectExpr("id", "CAST(at AS timestamp) AS at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = intake.insert_once(spark.readStream.schema("id int, at timestamp").parquet(f"{tmp_path}/in"), ["id"], "at")
            intake.to_files(stream, f"{tmp_path}/out", f"{tmp_path}/log")
            for _ in range(100):
                if len(progress.ended) > k:
                    break
                import time

                time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    told = progress.counters()
    assert (told["rows"], told["inserted"], told["duplicates"]) == (6, 4, 2) and told["batches"] >= 3 and told["rows_per_second"] > 0
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 4]


def test_snapshots_count_each_layer_and_keep_earlier_dates(spark, tmp_path):
    item = lambda **x: json.dumps({"baseType": "Opal Wand", "ilvl": 80, "explicitMods": ["+40 to maximum Life"]} | x)
    rows = [
        ("stash", "L", "a", "2024-01-01T00:00:00Z", "2024-01-01T00:05:00Z", 10.0, item(), 1), ("stash", "L", "a", "2024-01-01T00:00:00Z", "2024-01-01T00:05:00Z", 10.0, item(), 2),
        ("trade", "L", "a", "2024-01-01T00:30:00Z", "2024-01-01T00:32:00Z", 20.0, item(), 3), ("stash", "L", "b", "2024-01-01T00:00:00Z", None, 5.0, "{bad", 4),
        ("trade", "L", "c", "2024-01-01T00:00:00Z", "2024-01-01T08:00:00Z", 5.0, "{}", 5), ("trade", None, "", "bad time", "2024-01-01T08:00:00Z", 5.0, item(baseType="Gold Ring"), 6),
    ]
    schema = "source string, league string, item_id string, indexed string, collected_at string, price_chaos double, raw_item_json string, n int"
    frame = spark.createDataFrame(rows, schema).repartition(3)
    told = {(r.layer, r.metric): r.value for r in snapshot.build(frame, str(tmp_path), default_date="1999-01-01", order=["n"]).collect()}
    want = {"rows_read": 6, "invalid_json_skipped": 1, "rows_valid": 5, "rows": 4, "rows_deduped": 1, "dedup_rate": 0.1667, "partitions": 2, "source.both": 2, "source.stash": 0, "source.trade": 2, "freshness_band.fresh": 2, "freshness_band.aging": 1, "freshness_band.unknown": 1}
    assert {k: told["bronze", k] for k in want} == want
    assert [told["silver", k] for k in ("rows_input", "normalized", "normalization_failures", "rows", "partitions")] == [4, 3, 1, 2, 2]
    assert [told["gold", k] for k in ("rows_input", "rows", "partitions")] == [2, 2, 2]
    gold = spark.read.parquet(f"{tmp_path}/gold")
    kept = {r.item_id: r for r in gold.collect()}
    assert kept["a"].price_chaos == 20.0 and kept["a"].price_fix_suspected and kept["a"].seen_count == 2 and kept["a"].has_life == 1.0
    none = {(r.layer, r.metric): r.value for r in snapshot.build(frame.filter("n < 0"), str(tmp_path / "none"), default_date="1999-01-01", order=["n"]).collect()}
    assert none.keys() == told.keys() and set(none.values()) == {0.0}
    later = spark.createDataFrame([("stash", "L", "z", "2024-01-02T00:00:00Z", "2024-01-02T00:05:00Z", 7.0, item(), 1)], schema)
    snapshot.build(later, str(tmp_path), default_date="1999-01-01", order=["n"])
    assert spark.read.parquet(f"{tmp_path}/gold").count() == 3 and spark.read.parquet(f"{tmp_path}/bronze").count() == 5


def observed(spark, n=400):
    """Sightings of few items in two leagues: equal events, payloads that are bad, empty or hold the id, times that can't be read, blank offers."""
    rows = []
    for i in range(n):
        own, league = [f"i{i * 7 % 23}", f"i{i * 7 % 23}", "", None][0 if i % 9 else i % 4], ["A", "B", None][i * 5 % 3]
        inner = {"baseType": ["Opal Wand", "Gold Ring"][i % 2], "ilvl": 60 + i % 30, "explicitMods": ["+40 to maximum Life"]} | ({"id": f"i{i % 5}", "indexed": "2024-02-01T00:00:00Z"} if i % 6 == 0 else {})
        raw = "{bad" if i % 17 == 0 else " { } " if i % 19 == 0 else "[1]" if i % 29 == 0 else json.dumps(inner)
        seen = ["bad time", "", f"2024-01-{i * 3 % 28 + 1:02}T{i % 24:02}:00:00Z"][2 if i % 11 else i % 2]
        row = (["stash", "trade"][i * 3 % 2], league, own, seen, f"2024-03-01T{i % 24:02}:00:00Z", float(i % 13), raw, f"c{i % 40}", ["hi", None, " "][0 if i % 8 else i % 3], i)
        rows += [row] if i % 10 else [row, (*row[:1], "B", *row[2:6], raw.replace(", ", " , "), *row[7:9], i + n)]
    schema = "source string, league string, item_id string, indexed string, collected_at string, price_chaos double, raw_item_json string, change_id string, whisper string, n int"
    return spark.createDataFrame(rows, schema).repartition(5)


def test_rows_of_an_item_are_moved_once_and_told_as_by_the_plain_steps(spark, tmp_path, monkeypatch):
    import re

    from listing_lake.operators import observations, valuation

    plans, write = {}, files.write_layer
    monkeypatch.setattr(files, "write_layer", lambda df, path, by, **more: (plans.update({path.rsplit("/", 1)[1]: df._jdf.queryExecution().executedPlan().toString()}), write(df, path, by, **more))[1])
    frame, out = observed(spark), {}
    for deal in (True, False):
        told = {(r.layer, r.metric): r.value for r in snapshot.build(frame, f"{tmp_path}/{deal}", default_date="1999-01-01", order=["n"], deal=deal).collect()}
        assert set(re.findall(r"Exchange (\w+\(\w+)", plans["bronze"])) - {"RoundRobinPartitioning(5"} == {"hashpartitioning(_p"} and "Exchange hash" not in plans["silver"]
        out[deal] = told, {layer: spark.read.parquet(f"{tmp_path}/{deal}/{layer}") for layer in ("bronze", "silver")}
    # the same by one step after the other, each with a shuffle of its own
    rows = frame.withColumns({c: F.lit(None).cast("string") for c in ("account_name", "query_id", "base_type")}).withColumn("payload", observations.canonical_json(F.col("raw_item_json"))).filter("payload LIKE '{%'")
    plain = observations.keep_last(rows.withColumn("event_key", observations.event_key(*snapshot.KEY)).drop("payload"), ["event_key"], [F.col("n")])
    plain = observations.reconcile(plain, seen=F.try_to_timestamp("indexed"), collected=F.try_to_timestamp("collected_at"), price="price_chaos").cache()
    names = ["event_key", "n", "item_id", "raw_item_json", "first_seen_at", "last_seen_at", "seen_count", "source_count", F.col("all_sources").alias("source"), "price_fix_suspected"]
    want = sorted(map(str, plain.select(*names).collect()))
    listings = valuation.listed(plain.drop("base_type", "source").withColumnRenamed("all_sources", "source"))
    latest = observations.latest_per_item(listings.withColumn("_at", F.try_to_timestamp("listed_at")), "item_id", "_at", ["event_key"])
    kept = sorted(map(str, latest.select("event_key", "item_id", "n").collect()))
    names[8] = "source"
    for told, layers in out.values():
        assert sorted(map(str, layers["bronze"].select(*names).collect())) == want
        assert sorted(map(str, layers["silver"].select("event_key", "item_id", "n").collect())) == kept
        assert told["silver", "normalized"] == listings.count() and told["silver", "rows"] == len(kept) and told["bronze", "rows_valid"] == rows.count() > told["bronze", "rows"] == len(want)
    assert len(kept) < listings.count() and "is_latest" not in out[True][1]["silver"].columns


def test_snapshots_of_bad_payloads_alone_count_what_was_read(spark, tmp_path):
    bad = observed(spark).withColumn("raw_item_json", F.lit("{bad"))
    told = {(r.layer, r.metric): r.value for r in snapshot.build(bad, str(tmp_path), default_date="1999-01-01", order=["n"]).collect()}
    assert told["bronze", "rows_read"] == told["bronze", "invalid_json_skipped"] == bad.count() and told["bronze", "rows"] == told["gold", "rows"] == 0
