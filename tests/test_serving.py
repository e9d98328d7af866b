"""Models by registry: routing, broken models, bad documents; native tiers and listings of payloads."""

import json

import pytest
from pyspark.sql import functions as F

from listing_lake.functions import tiers
from listing_lake.operators import exits, serving, training, valuation
from listing_lake.sources import files


@pytest.fixture(scope="module")
def silver(spark):
    bases = ["Opal Wand", "Cobalt Jewel", "Gold Ring", "Zodiac Garb", "Odd Thing"]
    rows = [(i, bases[i % 5], 70 + i % 20, [f"{i % 30 + 10}% increased Spell Damage", f"+{i % 50 + 30} to maximum Life"], [], [], False, False, float(10 + i % 37)) for i in range(200)]
    schema = "id int, base_type string, ilvl int, explicit_mods array<string>, implicit_mods array<string>, influences array<string>, fractured boolean, corrupted boolean, price_chaos double"
    return valuation.normalize(spark.createDataFrame(rows, schema)).cache()


@pytest.fixture(scope="module")
def fitted(silver):
    gold = valuation.features(silver).withColumn("part", F.when(F.col("id") % 7 == 0, "test").otherwise("train"))
    out = {}
    for family in ("wand_caster", "jewel_cluster"):
        out |= training.train_models(gold, [(family, F.col("item_family") == family)], "price_chaos", serving.feature_names(family), depth=2, rounds=2)[0]
    return out


def registry(spark, fitted, base, rmse=1.0):
    versions = serving.publish(spark, fitted, f"file://{base}", "run-2", {f: (rmse, 2.0) for f in fitted}, "2001-01-02")
    older = versions.withColumn("run_id", F.lit("run-1")).withColumn("created_at", F.lit("2001-01-01"))
    serving.write_registry(versions.unionByName(older), f"file://{base}/registry")
    return f"file://{base}/registry"


def told(report):
    return {r.family: (r.run_id, r.state) for r in report.collect()}


def test_rows_go_to_their_familys_active_model(spark, silver, fitted, tmp_path):
    path = registry(spark, fitted, tmp_path)
    assert {(r.family, r.run_id) for r in serving.active_versions(spark, path).collect()} == {(f, "run-2") for f in fitted}
    models, report = serving.load(spark, path)
    assert told(report)["wand_caster"] == ("run-2", "loaded") and told(report)["generic"] == (None, "no_model") and set(models) == set(fitted)
    got = {r.id: r for r in serving.predict_with_registry(silver.withColumn("features", F.lit("x")).withColumn("prediction", F.lit(1)), models).collect()}
    plain = {r.id: r for r in valuation.predict(silver).collect()}
    assert len(got) == 200
    for i, r in got.items():
        modelled = r.item_family in fitted
        assert r.model_source == ("family_model" if modelled else "family_fallback") and r.features == "x" and r.prediction == 1
        assert (r.confidence > plain[i].confidence) == modelled and (modelled or r.predicted_value == plain[i].predicted_value)
    from pyspark.ml.feature import VectorAssembler

    some = valuation.features(silver).filter("item_family = 'wand_caster'").na.fill(0.0)
    direct = fitted["wand_caster"].transform(VectorAssembler(inputCols=serving.feature_names("wand_caster"), outputCol="features").transform(some))
    assert all(abs(got[r.id].predicted_value - max(0.0, r.prediction)) <= 0.05 + 1e-9 for r in direct.collect())


def test_a_broken_model_leaves_its_family_to_the_fallback(spark, silver, fitted, tmp_path):
    path = registry(spark, fitted, tmp_path)
    fitted["jewel_cluster"].write().overwrite().save(f"file://{tmp_path}/wand_caster/run-2")
    assert told(serving.load(spark, path)[1])["wand_caster"] == ("run-2", "checksum_mismatch")
    for f in (tmp_path / "jewel_cluster" / "run-2" / "data").iterdir():
        f.unlink()
    models, report = serving.load(spark, path)
    assert not models and told(report)["jewel_cluster"] == ("run-2", "checksum_mismatch")
    got = serving.predict_with_registry(silver, models)
    assert got.filter("model_source <> 'family_fallback'").count() == 0 and got.count() == 200


def test_bad_registry_and_missing_models_take_the_legacy_folder(spark, fitted, tmp_path):
    bad = tmp_path / "registry.json"
    bad.write_text("{invalid-json")
    legacy = f"file://{tmp_path}/legacy"
    fitted["wand_caster"].write().save(f"{legacy}/price_oracle_wand_caster")
    (tmp_path / "legacy" / "price_oracle_generic").mkdir()
    (tmp_path / "legacy" / "price_oracle_generic" / "x").write_text("corrupted-model")
    models, report = serving.load(spark, f"file://{bad}", legacy)
    assert set(models) == {"wand_caster"} and told(report)["generic"] == (None, "unreadable") and told(report)["wand_caster"] == (None, "loaded")
    assert serving.load(spark, f"file://{tmp_path}/nowhere")[0] == {}
    assert told(serving.load(spark, registry(spark, fitted, tmp_path, rmse=3.0))[1])["wand_caster"] == (None, "no_model")


def test_exits_trust_a_models_value_more(spark):
    base = {"confidence": 0.6, "target_confidence": 0.6, "pricing_position": "near_market", "comparables_count": 1, "low_ilvl_context": False, "twink_override": False, "oracle_confidence": 0.6, "expected_profit": 50.0}
    exit_ = "named_struct('link_cost', 0.0, 'strength', 'weak', 'n', 1L, 'position', 'near_market', 'floor', 5.0)"
    rows = spark.createDataFrame([(s, *base.values()) for s in ("family_fallback", "family_model")], ["model_source", *base])
    rows = rows.selectExpr("*", f"{exit_} AS exit", "array(named_struct('probability', 0.5, 'brick_risk', 0.1)) AS steps")
    got = {r.model_source: r.exit_confidence for r in exits.plan_confidence(rows, 1000.0).collect()}
    assert round(got["family_model"] - got["family_fallback"], 2) == 0.08


DEEP = {"tier": "T3", "name": "Life deep"}
for _ in range(300):
    DEEP = {"a": [DEEP]}
PAYLOADS = [
    (None, {}, 0), ("", {}, 0), ("{bad", {}, 0), ('"tier"', {}, 0), (json.dumps({"extended": DEEP}), {"Life": 3}, 1),
    ('{"mods":' + "[" * 20_000 + "]" * 20_000 + ',"tier":1}', {}, 0),
    (json.dumps({"mods": {"explicit": [{"name": "increased Spell Damage", "tier": "P2"}, {"magnitudes": [[{"id": "life_roll", "rank": 4}]]}]}}), {"SpellDamage": 2, "Life": 4}, 2),
    (json.dumps({"explicit": [{"tier": True, "rank": "tier 7", "mod": "Resist"}, {"tier": -3, "value": 2.9, "mod": "suppress"}, {"tier": "x1", "name": "life"}, {"tier": 0, "name": "life"}]}), {"Resist": 7, "SpellSuppress": 2}, 2),
    (json.dumps({"hashes": [{"tier": "s 4", "text": "casting speed"}, {"tier": "12a", "official_tier": "tiert5", "text": "Critical spell Life"}, {"rank": 1}]}), {"CastSpeed": 4, "CritChanceSpells": 5, "Life": 5}, 3),
    (json.dumps({"other": {"tier": 1, "name": "life"}}), {}, 0), (json.dumps({"mods": [{"tier": 9, "name": "life"}, {"tier": 2, "key": "Life x", "value": 1}]}), {"Life": 2}, 2),
]


def test_native_tiers_of_any_shape_and_depth(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, *_) in enumerate(PAYLOADS)], "i int, p string")
    got = rows.withColumn("t", tiers.native_tiers(F.col("p"))).drop("p")
    assert "Python" not in got._jdf.queryExecution().toString()
    assert {r.i: (r.t.tiers, r.t["count"]) for r in got.collect()} == {i: (t, n) for i, (_, t, n) in enumerate(PAYLOADS)}


def test_listings_of_payloads(spark):
    item = {"id": "a", "baseType": "Opal Wand", "ilvl": 60, "explicitMods": ["10% increased Spell Damage"], "influences": {"shaper": True}, "mods": [{"name": "Spell Damage", "tier": "T1"}], "accountName": "Ann"}
    rows = [
        (1, json.dumps(item), 12.34, None, None, "hi", None), (2, json.dumps(item), 5.0, "divine", 0.0, "", None), (3, "{}", 5.0, None, None, "hi", None), (4, "[]", 5.0, None, None, "hi", None), (5, None, 5.0, None, None, "hi", None),
        (6, json.dumps({"id": ""}), 5.05, "divine", 2.0, "hi", "Bob"), (7, json.dumps(item | {"ilvl": 0, "explicitMods": None}), None, "", None, "hi", ""),
    ]
    frame = spark.createDataFrame(rows, "n int, raw_item_json string, price_chaos double, price_currency string, price_amount double, whisper string, account_name string")
    got = {r.n: r for r in valuation.normalize(valuation.listed(frame)).collect()}
    assert set(got) == {1, 6, 7} and set(r.n for r in valuation.normalize(valuation.listed(frame.drop("whisper"))).collect()) == {1, 2, 6, 7}
    assert got[1].mod_tokens == ["SpellDamage", "SpellDamage_T1_approx"] and got[1].tier_ilvl_mismatch and got[1].tier_source == "native" and got[1].listed_price == 12.3
    assert (got[1].seller, got[1].listing_currency, got[1].listing_amount, got[1].influences) == ("Ann", "chaos", 12.34, ["shaper"])
    assert (got[6].base_type, got[6].ilvl, got[6].seller, got[6].listing_currency, got[6].listing_amount) == ("Unknown Base", 1, "Bob", "divine", 2.0)
    assert (got[7].ilvl, got[7].listing_amount, got[7].mod_tokens, got[7].seller) == (1, 0.0, [], "Ann")


def test_training_sets_are_read_in_both_forms(spark, tmp_path):
    raw = spark.createDataFrame([(json.dumps({"baseType": "Opal Wand", "explicitMods": ["+40 to maximum Life"]}), 4.0), ("{}", 4.0), (json.dumps({"baseType": "x"}), 0.0)], "raw_item_json string, price_chaos double")
    raw.write.parquet(f"{tmp_path}/raw")
    got = files.read_training_set(spark, f"{tmp_path}/raw", ["has_life"]).collect()
    assert [(r.item_family, r.has_life, r.life_flat) for r in got] == [("wand_caster", 1.0, 40.0)]
    files.read_training_set(spark, f"{tmp_path}/raw", ["has_life"]).select("item_family", "price_chaos", "has_life").write.parquet(f"{tmp_path}/gold")
    assert files.read_training_set(spark, f"{tmp_path}/gold", ["has_life"]).count() == 1
    with pytest.raises(ValueError, match="ilvl"):
        files.read_training_set(spark, f"{tmp_path}/gold", ["ilvl"])
