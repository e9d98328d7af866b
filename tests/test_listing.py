"""Rules of the listing jobs on small literal frames."""

import json

import pytest
from pyspark.sql import functions as F

from listing_lake.functions import listing as L
from listing_lake.operators import comparables, meta, observations, scan, training, upkeep, valuation
from listing_lake.sources import files
from listing_lake.streaming import intake


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "note, want",
    [
        ("~b/o 12 chaos", (12.0, "chaos")), ("~price 2 divine", (2.0, "divine")), ("~b/o 3 exa", (3.0, "exalted")), ("~price 1 alch", (1.0, "alchemy")), ("price 12 chaos", None),
        ("~price 1/2 divine", (1.0, "divine")), ("~b/o chaos 5", None), ("~b/o 5chaos", None), ("~b/o 0 chaos", None), ("~b/o inf chaos", None), ("", None), ("~b/o", None), ("~b/o 5d chaos 3 divine", None),
    ],
)
def test_price_notes(spark, note, want):
    got = one(spark, L.parse_price_note(F.lit(note)).alias("p")).p
    assert (got and tuple(got)) == want
    assert one(spark, L.parse_price_note(F.lit(None).cast("string")).alias("p")).p is None


def test_rarity_and_rates(spark):
    got = one(spark, *(L.useful_item(F.lit(f), F.lit(c)).alias(f"r{i}") for i, (f, c) in enumerate([(2, 5.0), (3, 5.0), (1, 5.0), (2, 0.0)])))
    assert tuple(got) == ("rare", "unique", None, None)
    assert one(spark, L.to_chaos_fixed(F.lit(2.0), F.lit("divine")), L.rate_name(F.lit("alch")), L.rate_name(F.lit("vaal")))[:] == (250.0, "Orb of Alchemy", "Vaal Orb")


def item(spark, base, mods, ilvl, fractured=False, tiers=None, implicit=()):
    rows = [(base, list(mods), list(implicit), [], ilvl, fractured, tiers)]
    frame = spark.createDataFrame(rows, "base_type string, explicit_mods array<string>, implicit_mods array<string>, influences array<string>, ilvl int, fractured boolean, native_tiers map<string,int>")
    return valuation.normalize(frame).first()


def test_families_and_plausibility(spark):
    assert item(spark, "Opal Ring", [], 80).item_family == "accessory_generic"
    assert item(spark, "Large Cluster Jewel", [], 80).item_family == "jewel_cluster"
    good = item(spark, "Imbued Wand", ["80% increased Spell Damage"], 84, tiers={"SpellDamage": 1})
    assert "SpellDamage_T1" in good.mod_tokens and not good.tier_ilvl_mismatch and good.numeric.spell_damage_pct == 80
    bad = item(spark, "Imbued Wand", ["80% increased Spell Damage"], 70, tiers={"SpellDamage": 1})
    assert bad.tier_ilvl_mismatch and bad.low_ilvl_context and "SpellDamage_T1_approx" in bad.mod_tokens and "SpellDamage_T1" not in bad.mod_tokens
    gems = item(spark, "Imbued Wand", ["+1 to Level of all Spell Skill Gems"], 40)
    assert gems.twink_override and gems.numeric.plus_all_spell_gems == 1.0 and not gems.low_ilvl_context
    assert item(spark, "Opal Ring", [], 70, fractured=True).fractured_low_ilvl_brick
    assert [one(spark, L.ilvl_band(F.lit(i)))[0] for i in (60, 74, 75, 83, 84)] == ["low", "low", "mid", "mid", "high"]


def sightings(spark, rows):
    frame = spark.createDataFrame(rows, "league string, item_id string, source string, indexed string, collected string, price double")
    return frame.withColumns({c: F.try_to_timestamp(c) for c in ("indexed", "collected")})


def test_two_sources_reconcile(spark):
    t = "2026-03-01T10:%s:00Z"
    rows = [("L", "a", "stash", t % "00", t % "05", 50.0), ("L", "a", "trade", t % "00", t % "02", 52.0), ("L", "b", "stash", t % "00", t % "00", 10.0), ("L", "b", "stash", t % "30", t % "30", 20.0), ("L", "", "stash", None, t % "01", 1.0), ("L", None, "trade", "bad", t % "01", 1.0)]
    got = observations.reconcile(sightings(spark, rows), seen=F.col("indexed"), collected=F.col("collected"), price="price")
    got = observations.aged(got, "indexed", "collected").orderBy("item_id", "price").collect()
    assert len(got) == 6
    a = [r for r in got if r.item_id == "a"]
    assert {(r.all_sources, r.seen_count, r.source_count, r.price_fix_suspected, r.freshness_band) for r in a} == {("both", 2, 2, False, "fresh")} and sorted(r.listing_age_seconds for r in a) == [120, 300]
    b = [r for r in got if r.item_id == "b"]
    assert all(r.price_fix_suspected and r.first_seen_at.minute == 0 and r.last_seen_at.minute == 30 for r in b)
    assert all((r.seen_count, r.freshness_band) == (1, "unknown") for r in got if not r.item_id)


def test_keep_last_and_latest(spark):
    frame = spark.createDataFrame([("k", 1, "2020-01-01"), ("k", 2, None), ("", 3, None), ("", 4, None), ("j", 5, "2020-01-02"), ("j", 6, "2020-01-01")], "id string, n int, t string")
    assert sorted(r.n for r in observations.latest_per_item(frame, "id", "t", ["n"]).collect()) == [2, 3, 4, 5]
    assert sorted(r.n for r in observations.keep_last(frame, ["id"], [F.col("n")]).collect()) == [2, 4, 6]
    key = one(spark, observations.event_key("id").alias("k")) if False else frame.select(observations.event_key("id", "t").alias("k")).first().k
    assert len(key) == 40
    docs = spark.createDataFrame([('{"b": 1, "a": {"d": 2, "c": 3}}',), ("[1]",), ("bad",), (None,)], "j string")
    assert [tuple(r) for r in docs.select(observations.valid_object(F.col("j")), observations.canonical_json(F.col("j"))).collect()] == [(True, '{"a":{"c":3,"d":2},"b":1}'), (False, "[1]"), (False, None), (False, None)]


def test_comparables_against_brute_force(spark):
    import random
    import statistics

    rng = random.Random(1)
    rows = [(rng.choice("xy"), float(rng.choice([0, 1, 2, 3, 3, 5, 8, 100]))) for _ in range(60)] + [("z", 7.0), ("z", 7.0), ("w", 0.0)]
    got = comparables.with_comparables(spark.createDataFrame(rows, "base string, price double"), ["base"], "price").collect()
    assert len(got) == len(rows)
    for r in got:
        rest = [p for b, p in rows if b == r.base and p != r.price and p > 0]
        want = (min(rest), statistics.median(rest), max(rest) - min(rest), len(rest)) if rest else (r.price, r.price, 0.0, 1)
        assert (r.market_floor, r.market_median, r.market_spread, r.comparables_count) == pytest.approx(want)
        floor, median, spread, _ = want
        place = "near_market" if not rest else "below_floor" if r.price <= max(1, floor * 0.98) else "outlier" if r.price > max(median * 1.35, floor + max(spread, 10)) else "near_market"
        assert r.pricing_position == place


def test_splits_gates_and_metrics(spark):
    rows = [("f", f"2026-01-01 {h:02d}:00:00", h) for h in range(10)] + [("g", None, 1), ("g", "2026-01-01 00:00:00", 2), ("g", None, 3)]
    frame = spark.createDataFrame(rows, "fam string, t string, n int").withColumn("t", F.to_timestamp("t"))
    got = training.temporal_split(frame, ["fam"], "t", ["n"]).collect()
    assert sorted((r.n, r.part) for r in got if r.fam == "f") == [(n, "train" if n < 8 else "test") for n in range(10)]
    assert len([r for r in got if r.fam == "g"]) == 3
    told = spark.createDataFrame(list(zip([20.0, 45.0, 80.0, 120.0, 180.0, 220.0], [25.0, 35.0, 70.0, 150.0, 210.0, 200.0])), "y double, p double")
    assert training.bucket_rmse(told, "y", "p").first()[:] == pytest.approx((7.9056941504, 22.360679775, 25.4950975679))
    few = spark.createDataFrame([(1.0, "f")] * 30, "y double, item_family string")
    assert training.quality_gates(few, "y").first().failed == "too_few_rows"
    versions = spark.createDataFrame([("f", "a", 1.0, 2.0, 1), ("f", "b", 1.5, 2.0, 2), ("f", "c", 3.0, 2.0, 3), ("f", "d", None, 2.0, 4)], "family string, run_id string, rmse double, baseline_rmse double, created_at int")
    assert {r.run_id: r.status for r in training.promotions(versions).collect()} == {"a": "archived", "b": "active", "c": "rejected", "d": "rejected"}
    assert training.fingerprint(told).first() == training.fingerprint(told.orderBy(F.desc("y")).repartition(3)).first()


def test_quantiles_and_even_samples_against_brute_force(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    rows = [(k, rng.choice([0.0, 1.0, 1.0001, 5.5, 1e6, -3.0, -0.2, 0.1, rng.random()])) for k in ["a", "b", None] for _ in range(rng.randint(20, 60))] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), ("a", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.q0, r.q1, r.q2) for r in training.quantiles(frame, ["k"], "v", (0.25, 0.5, 0.9)).collect()}
    assert got.keys() == {"a", "b", None, "one", "two"}
    for k, told in got.items():
        assert told == pytest.approx(tuple(np.quantile([v for j, v in rows if j == k and v is not None], (0.25, 0.5, 0.9))))
    assert training.quantiles(frame, [], "v", (0.5,)).first().q0 == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert training.quantiles(frame.filter("false"), ["k"], "v", (0.5,)).count() == 0

    ranked = [(k, n // 3 if n else None, n) for k, most in (("a", 50), ("b", 4), (None, 9)) for n in range(most)]
    some = observations.even_sample(spark.createDataFrame(ranked, "k string, t int, n int"), "k", ["t", "n"], 5).collect()
    want = {("a", round(i / 4 * 49 + 1e-9)) for i in range(5)} | {("b", n) for n in range(4)} | {(None, i * 2) for i in range(5)}
    assert {(r.k, r.n) for r in some} == want and len(some) == len(want)


def test_reports_and_files(spark, tmp_path):
    lines = [{"ts_utc": "2026-03-11T0%d:00:00Z" % (i + 7), "component": "c", "duration_ms": d, "status": s} for i, (d, s) in enumerate([(100, "ok"), (300, "error"), (200, "ok")])]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.jsonl").write_text("\n".join([*map(json.dumps, lines), "not json", "[1]", "", json.dumps({"component": " "})]))
    r = upkeep.ops_report(files.metric_events(spark, str(tmp_path / "m"))).first()
    assert (r.runs, r.ok_runs, r.error_runs, r.avg_ms, r.p50_ms, r.p95_ms) == (3, 2, 1, 200, 200, 300) and r.last_ts.hour == 9
    frame = spark.createDataFrame([("2026-01-01", None, 1), (None, "L", 2), ("2026-01-01", "L", 3)], "d string, league string, n int")
    assert len(files.write_layer(frame, str(tmp_path / "layer"), ["d", "league"])) == 3
    assert spark.read.parquet(str(tmp_path / "layer")).filter("league = 'unknown'").count() == 1
    files.export(frame.withColumn("a", F.array("n")), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).filter("a = '[1]'").count() == 1
    rates = files.economy_rates([spark.createDataFrame([("A", 1.0), ("", 2.0), ("B", 0.0)], "name string, chaos double"), spark.createDataFrame([("A", 3.0)], "name string, chaos double")])
    assert [tuple(r) for r in rates.collect()] == [("A", 3.0)]


def page(change, items):
    payload = {"next_change_id": "n", "stashes": [{"stash": "~price 9 chaos", "league": "L", "accountName": "me", "items": [json.dumps(i) for i in items]}]}
    return json.dumps({"change_id": change, "collected_at": "2026-03-01T10:00:00Z", "items_count": len(items), "raw_payload": payload})


def test_intake_stream_with_replay(spark, tmp_path):
    landing = tmp_path / "landing/2026-03-01"
    landing.mkdir(parents=True)
    items = [{"id": "i1", "frameType": 2, "note": "~b/o 5 chaos", "baseType": "Ring"}, {"id": "", "frameType": 2, "note": "~b/o 5 chaos"}, {"id": "i2", "frameType": 1, "note": "~b/o 5 chaos"}, {"id": "i3", "frameType": 3}]
    (landing / "a.ndjson").write_text(page("c1", items) + "\n\nbad line\n")

    def run():
        pages = files.read_stash_pages(spark, str(tmp_path / "landing"), stream=True)
        events = intake.insert_once(intake.page_events(pages), ["change_id", "item_id"], "collected_at")
        intake.to_files(events, str(tmp_path / "out"), str(tmp_path / "log"))
        return sorted((r.change_id, r.item_id, r.price_chaos, r.rarity) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("c1", "i1", 5.0, "rare"), ("c1", "i3", 9.0, "unique")]
    assert run() == first and run() == first
    (landing / "b.ndjson").write_text(page("c1", items) + "\n" + page("c2", items[:1]))
    assert run() == [*first, ("c2", "i1", 5.0, "rare")]
    files_ = {r.object_path.rsplit("/", 1)[1]: r for r in files.landing_manifest(spark, str(tmp_path / "landing")).collect()}
    assert (files_["a.ndjson"].pages, files_["a.ndjson"].items, files_["b.ndjson"].last_change_id, files_["b.ndjson"].run_id) == (1, 4, "c2", "2026-03-01")


def test_ttl_keeps_by_last_kept(spark):
    rows = [("a", 0, 1), ("a", 100, 2), ("a", 121, 3), ("a", 200, 4), ("a", 241, 5), ("", 0, 6), ("", 1, 7), (None, 1, 8), ("b", 50, 9)]
    frame = spark.createDataFrame(rows, "k string, s long, n int").withColumn("t", F.timestamp_seconds("s"))
    assert sorted(r.n for r in intake.ttl_dedupe(frame, "k", "t", "n").collect()) == [1, 3, 5, 6, 7, 8, 9]


def test_ttl_stream_is_the_batch_form(spark, tmp_path):
    rows = [("a", 0, 1), ("a", 100, 2), ("a", 121, 2**60 + 1), ("", 0, 6), (None, 1, 8), ("b", 50, 9), ("a", 121, 2**60 + 3)]
    later = [("a", 200, 4), ("a", 241, 5), ("", 1, 7), ("b", 60, None), ("b", 170, 11), ("c", 1000, 12)]
    schema = "k string, s long, n long"
    frames = [spark.createDataFrame(r, schema).withColumn("t", F.timestamp_seconds(F.col("s") + 10**9)) for r in (rows, later)]
    out = []
    for frame in frames:  # two runs of one stream: the state outlives the first
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        intake.to_files(intake.ttl_dedupe_stream(stream, "k", "t", "n"), str(tmp_path / "out"), str(tmp_path / "log"))
        out.append(sorted(((r.k, r.s, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str))
    assert out[0] == sorted([("a", 0, 1), ("a", 121, 2**60 + 1), ("", 0, 6), (None, 1, 8), ("b", 50, 9)], key=str)
    assert out[1] == sorted([*out[0], ("a", 241, 5), ("", 1, 7), ("b", 170, 11), ("c", 1000, 12)], key=str)


def test_weights(spark):
    mods = spark.createDataFrame([("m", "prefix", ["g"], [("defence", 500), ("shield", 300)], ["base_life"], None, None), ("u", "unique", ["g"], [("shield", 900)], [], None, None)], "mod_id string, generation_type string, groups array<string>, spawn_weights array<struct<tag string, weight int>>, stats array<string>, required_level int, is_essence_only boolean".replace("tag string", "tag:string").replace("weight int", "weight:int"))
    mods = meta.clean_mods(mods)
    assert [tuple(r) for r in mods.select(meta.weight_for(F.lit("defence")), meta.weight_for(F.lit("none")), "required_level").collect()] == [(500, 0, 1)]
    assert meta.spawn_pool(mods, "shield", "prefix", ["g", "h"]).first().pool == 300 and meta.spawn_pool(mods, "none").first().pool == 0
    assert meta.mods_by_stats(mods, ["LIFE"], "prefix", "shield").count() == 1


def test_high_ticket_flag(spark):
    row = spark.createDataFrame([(120.0, 0.70, 150.0, "generic", 84)], "listed_price double, confidence double, predicted_value double, item_family string, ilvl int")
    row = row.withColumns({"corrupted": F.lit(False), "fractured": F.lit(False), "influences": F.array().cast("array<string>"), "model_source": F.lit("family_model"), "twink_override": F.lit(False), "tier_ilvl_mismatch": F.lit(False), "listed_at": F.lit(None).cast("timestamp")})
    assert row.select(scan.risk_flags("2026-01-01", 48.0).alias("f")).first().f == ["high_ticket_low_confidence"]


def test_native_tiers(spark):
    from listing_lake.functions import tiers

    nested = {"extended": {"mods": {"explicit": [{"name": "Spell Damage", "tier": 2}, {"name": "of spell damage", "tier": "T1"}, {"name": "Life", "tier": True, "rank": "S3"}]}}, "other": {"tier": 1, "name": "life"}}
    rows = [(json.dumps(nested),), ('{"mods": [1, {"tier": 0, "name": "life"}]}',), ("bad \"tier\"",), (None,), ('{"id": 1}',)]
    got = [r.t for r in spark.createDataFrame(rows, "j string").select(tiers.native_tiers(F.col("j")).alias("t")).collect()]
    assert [(r.tiers, r["count"]) for r in got] == [({"SpellDamage": 1, "Life": 3}, 3), ({}, 0), ({}, 0), ({}, 0), ({}, 0)]
