"""Steps whose work or shuffles grew faster than their input, and texts that hung on an engine's rounding."""

import pytest
from pyspark.sql import functions as F

from listing_lake.functions import mods
from listing_lake.operators import valuation

MODS = ["+1 to Level of all Spell Skill Gems", "10% increased Spell Damage, -5 and 12.5", "+20% to Fire Resistance and -3", None, "", "Maximum LIFE", "Casting Speed"]


def test_mods_are_read_by_batches_and_null_lists_stay_null(spark):
    rows = spark.createDataFrame([(0, MODS), (1, []), (2, None), (3, [None]), (4, MODS[1:3] * 2)], "n int, mods array<string>")
    out = rows.select("n", F.arrow_udf(mods.facts, mods.FACTS)("mods").alias("f"))
    got = {r.n: r.f for r in out.collect()}
    assert got[2] is None and got[1].tokens == [] and got[3].tags == [] and got[1].numeric.life_flat == 0.0
    assert got[0].tokens == ["SpellDamage", "Resist", "Life", "CastSpeed"] and got[0].tags == ["spell", "spell", "resistance", "life"]
    assert tuple(got[0].numeric) == (12.5, 0.0, 0.0, 0.0, 20.0, 1.0) and got[0].gem == 1.0
    assert got[4].numeric.spell_damage_pct == 25.0 and got[4].numeric.resist_total == 40.0 and got[4].tokens == ["SpellDamage", "Resist"] * 2


def test_mods_are_not_interpreted_row_by_row(spark):
    rows = spark.createDataFrame([("Wand", MODS, [], [], 84, False)], "base_type string, explicit_mods array<string>, implicit_mods array<string>, influences array<string>, ilvl int, fractured boolean")
    plan = valuation.normalize(rows)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan


def test_values_half_way_do_not_hang_on_the_last_bit(spark):
    from listing_lake.operators import meta

    rows = [("n", "b", 125.44999999999999), ("n", "a", 125.45), ("n", "c", 125.40)]
    methods = spark.createDataFrame(rows, "niche string, method string, value_delta double").selectExpr("*", "1.0D AS hit_probability", "0.0D AS method_cost", "0.0D AS brick_risk", "0.0D AS niche_base_cost")
    assert [(r.method, r.ev_net_value) for r in meta.craft_values(methods).orderBy("rank").collect()] == [("a", 125.5), ("b", 125.5), ("c", 125.4)]


def test_labels_have_the_decimals_of_printf(spark):
    from listing_lake.functions import listing as L

    values = [9999.25, 9999.75, 9999.35, 0.25, 0.05, 0.15, 0.95, 9999.95, -0.25, -12.35, 1e-9, 0.0, 123456.65, 7.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", L.one_decimal(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in got} == {v: f"{v:.1f}" for v in values}


def test_fits_get_rows_alike_once_and_the_trees_stay(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import GBTRegressor

    from listing_lake.operators import training

    rows = [("ab"[i % 2], float(i % 7), float(i % 3), "test" if i % 5 == 0 else "train", (i % 7) * 3.0 + (i % 2) * (i % 3) + i * 37 % 101 / 10) for i in range(3000)]
    gold = spark.createDataFrame([*rows, ("c", None, 1.0, "train", 2.0)], "kind string, x double, y double, part string, price double").cache()
    plain = {}
    for kind in "ab":
        some = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(gold.filter(F.col("kind") == kind)).withColumn("validating", F.col("part") == "test")
        plain[kind] = GBTRegressor(labelCol="price", maxDepth=3, stepSize=0.3, maxIter=8, validationIndicatorCol="validating", seed=42).fit(some)
    read, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df: read.append(df.count()) or fit(self, df))
    models, told = training.train_models(gold, [(k, F.col("kind") == k) for k in "abc"], "price", ["x", "y"], depth=3, rate=0.3, rounds=8)
    assert read == [2 * 7 * 3 * 2] * 2 and models["c"] is None and told.count() == 3000
    for kind in "ab":
        assert models[kind].getNumTrees == plain[kind].getNumTrees
        assert all(abs(models[kind].predict(v) - plain[kind].predict(v)) < 1e-9 for v in (Vectors.dense(x, y) for x in range(7) for y in range(3)))


def test_summed_rows_keep_number_sum_and_squares(spark):
    from listing_lake.operators import training

    rows = [("a", 1.0), ("a", 4.0), ("a", 10.0), ("b", 5.0), ("b", 5.0), (None, 2.0), ("n", None), ("n", 1.0)]
    out = training.summed_rows(spark.createDataFrame(rows, "k string, t double"), ["k"], "t").collect()
    told = {k: [(r.t, r.weight) for r in out if r.k == k] for k in ("a", "b", None, "n")}
    assert len(told["a"]) == 2 and [round(sum(w * t**p for t, w in told["a"]), 9) for p in (0, 1, 2)] == [3, 15, 117]
    assert told["b"] == [(5.0, 2.0)] and told[None] == [(2.0, 1.0)] and all(t is None for t, _ in told["n"])


def test_items_and_notes_are_parsed_once(spark):
    import json

    from listing_lake.streaming import intake

    notes = ["~price 2 divine", "~b/o 1/2 chaos", "~price 5", "~price chaos 5", "price 3 chaos", "~price -1 chaos", "~price x 4 (div) chaos", "", None, " ~PRICE .5 Exalted ", "~price 1e999 chaos", "~price 3 xx chaos 4 divine"]
    items = [json.dumps({"id": f"i{n}", "frameType": 2 + n % 2, "note": note}) for n, note in enumerate(notes)]
    items += [json.dumps({"id": i, "frameType": f, "note": "~price 1 chaos"}) for i, f in (("", 2), (None, 2), ("x", 0), ("y", None), ("z", 3))] + ["{bad", "[]"]
    pages = spark.createDataFrame([("c", "2024-01-01T00:00:00Z", ("n", [("~b/o 7 chaos", "L", "a", items), ("plain", None, "b", [items[8], items[0]])]))], intake.PAGE.replace("next_change_id string, stashes_count int, items_count int, ", "", 1).replace(", _corrupt string", ""))
    events = intake.page_events(pages)
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("split(") == 1
    got = sorted((r.item_id, r.rarity, r.stash_name, r.price_amount, r.price_currency, r.price_chaos) for r in events.collect())
    rare = lambda n: "rare" if n % 2 == 0 else "unique"
    own = [(0, 2.0, "divine", 250.0), (1, 1.0, "chaos", 1.0), (6, 4.0, "divine", 500.0), (8, 7.0, "chaos", 7.0), (9, 0.5, "exalted", 30.0), (11, 3.0, "chaos", 3.0)]
    want = [(f"i{n}", rare(n), "~b/o 7 chaos", *told) for n, *told in own] + [("z", "unique", "~b/o 7 chaos", 1.0, "chaos", 1.0), ("i0", "rare", "plain", 2.0, "divine", 250.0)]
    assert got == sorted(want)


def test_exports_join_once_and_write_compressed_text(spark, monkeypatch):
    from pathlib import Path

    from listing_lake.plans import landings
    from listing_lake.sources import files

    seen, export = [], files.export
    monkeypatch.setattr(files, "export", lambda df, path, fmt, **more: (seen.append((df._jdf.queryExecution().executedPlan().toString(), path)), export(df, path, fmt, **more)))
    got = landings.exports(spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 3 and not any("Join" in plan for plan, _ in seen)
    for _, path in seen:
        parts = [p.name for p in Path(path.removeprefix("file://")).iterdir() if p.name.startswith("part-")]
        assert parts and all(p.endswith(".gz") for p in parts)
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    by = {f: sorted((r.source, r.n, r.levels, r.total) for r in got if r.fmt == f) for f in ("json", "jsonl", "csv")}
    assert by["json"] == by["jsonl"] == by["csv"] and sum(r[1] for r in by["csv"]) == lines


def test_top_plans_write_no_plan_out_in_a_filter(spark):
    import duckdb

    import __spark_entry__

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = __spark_entry__.queries()["top_plans"](spark, sf)
    filters = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter " in line]
    assert filters and max(map(len, filters)) < 2000
    want = db.execute(__spark_entry__.oracle_sql()["top_plans"]).fetchall()
    assert len(want) == 12 and [tuple(r) for r in got.orderBy("plan_rank").collect()] == want


def test_top_plans_are_of_plans_to_keep_alone(spark):
    from listing_lake.operators import planner

    plans = spark.createDataFrame([(i, [None, True, False][i % 3]) for i in range(30)], "n int, good boolean")
    best = lambda k, keep=None: [(r.plan_rank, r.n) for r in planner.top_plans(plans, [F.desc("n")], F.col("n").cast("string"), k, keep).orderBy("plan_rank").collect()]
    assert best(3, F.col("good")) == [(1, 28), (2, 25), (3, 22)] and best(2) == [(1, 29), (2, 28)]
    assert best(20, F.col("good") & (F.col("n") < 9)) == [(1, 7), (2, 4), (3, 1)] and best(5, F.lit(False)) == []


@pytest.mark.parametrize("name", ["bucket_rmse", "regression_metrics", "temporal_split", "feature_overlap"])
def test_splits_join_the_lines_once(spark, name):
    import duckdb

    import __spark_entry__

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, sf)
    assert "l_orderkey" not in got._jdf.queryExecution().executedPlan().toString()
    sql = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in sql.description]
    norm = lambda rows: sorted((tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert sorted(columns) == sorted(got.columns) and norm(got.select(columns).collect()) == norm(sql.fetchall())
