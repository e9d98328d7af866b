"""Registered queries that start from whole item payloads, and on models from the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from listing_lake.functions import listing as L
from listing_lake.operators import comparables, scan, serving, training, valuation
from listing_lake.operators.shared import folder, written
from listing_lake.plans import jobs, layers
from listing_lake.plans.driver_tables import AS_OF, ITEMS, TIE, items

TIES = ", ".join(TIE)
#: Of each listing's payload: how its tiers are told, as (condition, tiered objects in JSON) that both engines read alike.
TIERED = (
    ("line_no <= 2", """concat('"extended":{"mods":{"explicit":[{"name":"increased Spell Damage","tier":"P', CAST(size % 7 AS STRING), '"},{"magnitudes":[[{"id":"life_roll","rank":', CAST(line_no AS STRING), '}]]}]}},')"""),
    ("line_no = 3", """concat('"mods":[{"text":"Cast Speed","tier":true,"value":', CAST(size AS STRING), '}],')"""),
    ("line_no = 4", "'\"hashes\":{\"explicit\":[[\"stat_1\",[0]]]},\"other\":{\"tier\":1,\"name\":\"life\"},'"),
)


def _observed(spark, d):
    """Listings as observed rows: the whole payload as JSON; some payloads empty or bad, some whispers blank, some fields missing."""
    tiers = F.expr("CASE " + " ".join(f"WHEN {rule} THEN {told}" for rule, told in TIERED) + " ELSE '' END")
    item = F.struct(
        F.when(F.col("size") % 11 > 0, F.col("base_type")).alias("baseType"), F.when(F.col("size") % 13 > 0, F.col("ilvl")).alias("ilvl"), F.col("explicit_mods").alias("explicitMods"), F.col("implicit_mods").alias("implicitMods"),
        F.map_from_arrays("influences", F.transform("influences", lambda _: F.lit(True))).alias("influences"), "fractured", "corrupted",
    )
    raw = F.concat(F.lit("{"), tiers, F.substring(F.to_json(item), 2, 1 << 30))
    raw = F.when(F.col("ext_price") % 17 < 1, "{}").when(F.col("ext_price") % 19 < 1, "[1]").when(F.col("ext_price") % 23 < 1, "{bad").otherwise(raw)
    whisper = F.when(F.col("quantity") > 48, "").otherwise(F.lit("@seller hi"))
    rows = items(spark, d).withColumns({"raw_item_json": raw, "whisper": whisper, "price_amount": F.col("price_step"), "account_name": F.col("seller"), "indexed": F.col("indexed_ts").cast("string")})
    return rows.select(*TIE, "price_chaos", "price_amount", "account_name", "indexed", "collected_ts", "raw_item_json", "whisper")


def _silver(spark, d):
    return valuation.normalize(valuation.listed(_observed(spark, d)))


def silver_of_payloads(spark, d):
    """Silver from whole payloads: listings without an item or a whisper dropped, native tiers and what is implausible of them."""
    return _silver(spark, d).select(
        *TIE, "base_type", "item_family", "ilvl", F.array_join("mod_tokens", ",").alias("mod_tokens"), "native_tier_count", "tier_source", "tier_ilvl_mismatch", "prefix_count", "suffix_count", "low_ilvl_context",
        "listed_price", "listing_currency", "listing_amount", "seller",
    )


def tier_mismatch_scan(spark, d):
    """Rows by family, tier source and whether the scan flags their tiers as implausible."""
    silver = written(_silver(spark, d).withColumn("listed_at", F.col("collected_ts")), "silver")
    valued = valuation.predict(silver)
    rows = comparables.with_comparables(valued, ["item_family", "base_type"], "listed_price")
    out = scan.opportunities(rows, as_of=AS_OF, stale_hours=2000.0, min_profit=10.0)
    flagged = F.array_contains("risk_flags", "tier_ilvl_mismatch")
    return out.groupBy("item_family", "tier_source").agg(F.count("*").alias("n"), F.sum(flagged.cast("long")).alias("flagged"))


def gold_utility(spark, d):
    """Meta utility of listings by their tags' scores, over families."""
    scores = jobs.tag_counts(spark, d).select("tag", "score")
    gold = valuation.features(valuation.normalize(items(spark, d)), scores)
    return gold.groupBy("item_family").agg(F.count("*").alias("n"), F.round(F.sum("meta_utility_score"), 3).alias("utility"), F.max("meta_utility_score").alias("most"))


#: Families of the query's registry by what becomes of their models.
SERVED = {"wand_caster": "loaded", "jewel_cluster": "loaded", "accessory_generic": "checksum_mismatch", "body_armour_defense": "no_model", "generic": "no_model"}


def _serving_silver(spark, d):
    """What features and values take of silver, written once: the training set reads it, and so does each model's branch."""
    names = ("price_chaos", "item_family", "ilvl", "mod_tokens", "numeric", "influences", "fractured", "open_prefixes", "open_suffixes")
    return written(valuation.normalize(items(spark, d)).select(*TIE, *names), "serving-silver")


def _registry(spark, silver):
    """A registry of small models: two as they were saved, one changed behind the registry's back, one that the policy rejects."""
    names = sorted({n for f in SERVED for n in serving.feature_names(f)})
    gold = valuation.features(silver).select("item_family", "price_chaos", F.when(F.col("o_key") % 5 == 0, "test").otherwise("train").alias("part"), *names)
    gold = written(training.summed_rows(gold, ["item_family", "part", *names], "price_chaos"), "serving-gold")
    models = {}
    for family in ("wand_caster", "jewel_cluster", "accessory_generic", "generic"):
        fitted, _ = training.train_models(gold, [(family, F.col("item_family") == family)], "price_chaos", serving.feature_names(family), depth=2, rate=0.3, rounds=2, weight="weight")
        if fitted[family] is not None:
            models[family] = fitted[family]
    base = folder(spark, "models")
    metrics = {f: (1.0, 2.0) if f != "generic" else (3.0, 2.0) for f in models}
    versions = written(serving.publish(spark, models, base, "run-1", metrics, "2001-06-01T00:00:00Z"), "versions")
    serving.write_registry(versions, f"{base}/registry")
    models["generic"].write().overwrite().save(f"{base}/accessory_generic/run-1")
    return f"{base}/registry"


def registry_predictions(spark, d):
    """Every listing's value with models from the registry: a model's value is only said to be there, all else is exact."""
    silver = _serving_silver(spark, d)
    models, _ = serving.load(spark, _registry(spark, silver))
    out = serving.predict_with_registry(silver, models)
    modelled = F.col("model_source") == "family_model"
    return out.select(*TIE, "item_family", "model_source", "confidence", "feature_completeness", F.when(~modelled, F.col("predicted_value")).alias("fallback"), (F.col("predicted_value") >= 0).alias("sane"))


def registry_report(spark, d):
    """What became of each family's model."""
    return serving.load(spark, _registry(spark, _serving_silver(spark, d)))[1].select("family", "run_id", "state").withColumn("run_id", F.when(F.col("state") != "no_model", F.col("run_id")))


_QUERIES = (silver_of_payloads, tier_mismatch_scan, gold_utility, registry_predictions, registry_report)
QUERIES = {f.__name__: f for f in _QUERIES}

_SPELL, _LIFE = "CASE WHEN line_no <= 2 AND size % 7 > 0 THEN size % 7 END", "CASE WHEN line_no <= 2 THEN line_no END"
_CAST = "CASE WHEN line_no = 3 THEN size END"
_HIGH = layers._CASE("item_family", L.HIGH_TIER_LEVEL, L.HIGH_TIER_LEVEL["generic"])
_ADDED = ", ".join(
    f"CASE WHEN {t} IS NOT NULL AND list_contains(tokens, '{name}') THEN '{name}_T' || {t} || CASE WHEN {t} <= {L.HIGH_TIER_RANK} AND ilvl < {_HIGH} THEN '_approx' ELSE '' END END"
    for name, t in (("CastSpeed", _CAST), ("Life", _LIFE), ("SpellDamage", _SPELL))
)
#: The given silver SQL over payloads: other defaults, fewer rows, and tiers among the tokens.
PAYLOAD_SILVER = (
    layers.SILVER.replace(
        f"FROM ({ITEMS}) x)",
        f"""FROM (SELECT * REPLACE (CASE WHEN size % 11 > 0 THEN base_type ELSE 'Unknown Base' END AS base_type, CASE WHEN size % 13 > 0 THEN ilvl ELSE 1 END AS ilvl) FROM ({ITEMS}) w
  WHERE ext_price % 17 >= 1 AND ext_price % 19 >= 1 AND ext_price % 23 >= 1 AND quantity <= 48) x)""",
    )
    .replace("AS p FROM b)", "AS p FROM b2)")
    .replace(
        "\nc AS (SELECT *, least(",
        f"""\nb2 AS (SELECT * REPLACE (list_concat(tokens, list_filter([{_ADDED}], lambda v: v IS NOT NULL)) AS tokens), ({_SPELL} IS NOT NULL)::INTEGER + ({_LIFE} IS NOT NULL)::INTEGER + ({_CAST} IS NOT NULL)::INTEGER AS tiered,
  coalesce(least({_SPELL}, {_LIFE}, {_CAST}) <= {L.HIGH_TIER_RANK}, false) AND ilvl < {_HIGH} AS mismatch FROM b),\nc AS (SELECT *, least(""",
    )
)
_SOURCE = "CASE WHEN tiered > 0 THEN 'native' ELSE tier_source END"
_MODELS = ", ".join(f"'{f}'" for f, state in SERVED.items() if state == "loaded")
_MODELLED = layers.VALUED.replace("0.35 + feature_completeness", f"CASE WHEN item_family IN ({_MODELS}) THEN 0.55 ELSE 0.35 END + feature_completeness")
ORACLES = {
    "silver_of_payloads": f"""{PAYLOAD_SILVER} SELECT {TIES}, base_type, item_family, ilvl, array_to_string(tokens, ',') AS mod_tokens, tiered AS native_tier_count, {_SOURCE} AS tier_source, mismatch AS tier_ilvl_mismatch,
      prefix_count, suffix_count, low_ilvl_context, round(price_chaos + 1e-9, 1) AS listed_price, 'chaos' AS listing_currency, CASE WHEN price_step <> 0 THEN price_step ELSE price_chaos END AS listing_amount, seller FROM silver""",
    "tier_mismatch_scan": f"{PAYLOAD_SILVER} SELECT item_family, {_SOURCE} AS tier_source, count(*) AS n, count(*) FILTER (mismatch) AS flagged FROM silver GROUP BY ALL",
    "gold_utility": f"""{layers.SILVER}, scores AS ({jobs.ORACLES["tag_counts"]}), g AS (SELECT item_family, coalesce((SELECT round(avg(score), 3) FROM scores WHERE list_contains(tags, tag) AND score > 0), 0.0) AS u FROM silver)
      SELECT item_family, count(*) AS n, round(sum(u), 3) AS utility, max(u) AS most FROM g GROUP BY 1""",
    "registry_predictions": f"""{_MODELLED} SELECT {TIES}, item_family, CASE WHEN item_family IN ({_MODELS}) THEN 'family_model' ELSE 'family_fallback' END AS model_source, confidence, feature_completeness,
      CASE WHEN item_family NOT IN ({_MODELS}) THEN predicted_value END AS fallback, true AS sane FROM valued""",
    "registry_report": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {repr('run-1') if s != 'no_model' else 'NULL'}, '{s}')" for f, s in SERVED.items()) + ") AS t(family, run_id, state)",
}
