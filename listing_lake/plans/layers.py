"""Registered queries on layers: bronze, silver, gold, comparables and the scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from listing_lake.functions import listing as L
from listing_lake.functions import tiers
from listing_lake.operators import comparables, exits, observations, planner, scan, valuation
from listing_lake.plans.driver_tables import AS_OF, ITEMS, LISTINGS, TIE, dealt, items, listings, table



def _rolled(spark, d):
    return observations.rollup(listings(spark, d), seen=F.col("indexed_ts"), collected=F.col("collected_ts"), price="price_chaos")


def bronze_rollup(spark, d):
    return _rolled(spark, d)


def freshness(spark, d):
    aged = observations.aged(listings(spark, d), "indexed_ts", "collected_ts", scale=1000.0)
    return aged.groupBy("source", "freshness_band").agg(F.count("*").alias("n"), F.round(F.max("listing_age_seconds"), 3).alias("oldest"))


def keep_last_event(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("event_key"))
    return observations.keep_last(docs, ["event_key"], [F.col("source"), F.col("doc_id")])


def latest_per_item(spark, d):
    bad = F.when(F.col("line_no") != 3, F.col("indexed_ts"))  # times that could not be read
    rows = listings(spark, d).select("item_id", bad.alias("time"), *TIE)  # what is carried through the aggregate is what is asked for
    return observations.latest_per_item(rows, "item_id", "time", list(TIE)).select("item_id", "time", *TIE)


def reconcile(spark, d):
    rows = observations.reconcile(listings(spark, d), seen=F.col("indexed_ts"), collected=F.col("collected_ts"), price="price_chaos")
    return rows.groupBy("all_sources", "price_fix_suspected").agg(F.count("*").alias("n"), F.sum("seen_count").alias("sightings"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def event_payloads(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", observations.valid_object(F.col("props")).alias("valid"), observations.canonical_json(F.col("props")).alias("payload"),
        observations.event_key("event_type", "user_id", "props").alias("event_key"),
    )


def layer_metrics(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("event_key"))
    return observations.layer_metrics(docs, observations.keep_last(docs, ["event_key"], [F.col("doc_id")]))


def source_distribution(spark, d):
    return listings(spark, d).groupBy("league", "source").agg(F.count("*").alias("n"))


def stratified_sample(spark, d):
    from pyspark.sql import Window as W

    rows = listings(spark, d).withColumn("bucket", L.price_bucket(F.col("price_step")))
    order = W.partitionBy("base_type", "bucket").orderBy(F.desc("indexed_ts"), *TIE)
    return rows.filter("bucket IS NOT NULL").withColumn("n", F.row_number().over(order)).filter("n <= 3").select("base_type", "bucket", "n", *TIE)


def even_sample(spark, d):
    return observations.even_sample(listings(spark, d).select("base_type", *TIE), "base_type", list(TIE), 7)


def price_notes(spark, d):
    li = table(spark, d, "lineitem")
    note = F.expr(NOTE)
    out = li.select("l_orderkey", "l_linenumber", "l_extendedprice", note.alias("note")).withColumn("p", L.parse_price_note(F.col("note")))
    chaos = L.to_chaos_fixed(F.col("p.amount"), F.col("p.currency"))
    return out.groupBy("note").agg(F.first("p.amount").alias("amount"), F.first("p.currency").alias("currency"), F.first(chaos).alias("chaos"), F.first(L.useful_item(F.lit(2), chaos)).alias("rarity"), F.count("*").alias("n"))


NOTE = """CASE l_linenumber WHEN 1 THEN concat('~b/o ', CAST(CAST(l_quantity AS INT) AS STRING), ' chaos') WHEN 2 THEN concat('~price ', CAST(CAST(l_quantity AS INT) AS STRING), '/2 Divine')
  WHEN 3 THEN concat('~price chaos ', CAST(CAST(l_quantity AS INT) AS STRING)) WHEN 4 THEN concat(' ~price ', CAST(CAST(l_quantity AS INT) AS STRING), '.5 exa') WHEN 5 THEN '~b/o 5chaos'
  WHEN 6 THEN concat('price ', CAST(CAST(l_quantity AS INT) AS STRING), ' chaos') ELSE concat('~b/o ', CAST(CAST(l_quantity AS INT) - 10 AS STRING), ' foo alch') END"""
ALIASES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in L.CURRENCY_ALIASES.items()) + "}"


def priced_by_rates(spark, d):
    """Orders as prices in several currencies, against a rate table made from nations."""
    rates = table(spark, d, "nation").filter("n_nationkey < 3").select(F.expr("element_at(array('Divine Orb', 'Exalted Orb', 'Vaal Orb'), n_nationkey + 1)").alias("name"), (F.col("n_nationkey") * 10 + 5.0).alias("chaos"))
    o = table(spark, d, "orders").select("o_orderkey", F.expr("element_at(array('divine', 'exalted', 'vaal', 'unknown', 'chaos'), CAST(o_orderkey % 5 AS INT) + 1)").alias("currency"), (F.col("o_totalprice") / 1000).alias("amount"))
    out = o.withColumn("name", L.rate_name(F.col("currency"))).join(F.broadcast(rates), "name", "left")
    chaos = F.when(F.col("currency") == "chaos", F.col("amount")).otherwise(F.col("amount") * F.col("chaos"))
    return out.groupBy("currency").agg(F.count("*").alias("n"), F.count(chaos).alias("priced"), F.round(F.sum(chaos), 2).alias("total"))


def silver(spark, d):
    out = valuation.normalize(items(spark, d))
    return out.select(
        *TIE, "item_family", "ilvl_band", F.array_join("mod_tokens", ",").alias("mod_tokens"), F.array_join("tag_tokens", ",").alias("tag_tokens"), "prefix_count", "suffix_count", "open_prefixes", "open_suffixes",
        "numeric.spell_damage_pct", "numeric.cast_speed_pct", "numeric.life_flat", "numeric.resist_total", "numeric.plus_all_spell_gems", "twink_override", "low_ilvl_context", "fractured_low_ilvl_brick", "tier_source",
    )


def gold(spark, d):
    out = valuation.features(valuation.normalize(items(spark, d)))
    names = [*valuation.FLAGS, "mod_count", "open_affixes", "is_influenced", "spell_crit_pct"]
    return out.groupBy("item_family").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names))


def _valued(spark, d):
    return valuation.predict(valuation.normalize(items(spark, d)).withColumns({"listed_price": F.col("price_step").cast("double"), "listed_at": F.col("collected_ts")}))


def valuations(spark, d):
    return _valued(spark, d).select(*TIE, "item_family", "predicted_value", "confidence", "feature_completeness", "model_source")


def comparable_stats(spark, d):
    return comparables.stats(listings(spark, d).withColumn("price", F.col("price_step").cast("double")), ["base_type"], "price")


def comparables_excluding_own_price(spark, d):
    return comparables.excluding_own_price(listings(spark, d).withColumn("price", F.col("price_step").cast("double")), ["base_type", "league"], "price")


def market_index(spark, d):
    rows = valuation.normalize(items(spark, d)).withColumns({"price": F.col("price_step").cast("double"), "link_count": (F.col("line_no") % 3 + 4).cast("int")})
    index = comparables.market_index(rows)
    out = comparables.with_market_index(rows.select("item_family", "base_type", "link_count", "ilvl"), index)
    return out.groupBy("item_family", "base_type", "ilvl_index", "link_count").agg(F.count("*").alias("n"), F.max("market_floor").alias("market_floor"), F.max("market_median").alias("market_median"), F.max("six_market_median").alias("six_market_median"))


def _scanned(spark, d):
    rows = comparables.with_comparables(_valued(spark, d), ["item_family", "base_type"], "listed_price")
    return scan.opportunities(rows, as_of=AS_OF, stale_hours=2000.0, min_profit=10.0)


def scan_opportunities(spark, d):
    return _scanned(spark, d).select(*TIE, "score", "ml_value", "profit", "trusted_profit", "relative_discount", F.array_join("risk_flags", ",").alias("risk_flags"), "pricing_position", "market_median", "comparables_count", "filter_reason")


def scan_funnel(spark, d):
    return scan.funnel(_scanned(spark, d)).select("reason", "n", "max_profit")


def top_opportunities(spark, d):
    return scan.top(_scanned(spark, d), 50, list(TIE)).select(*TIE, "score", "trusted_profit", "profit")


def buy_filters(spark, d):
    out = _scanned(spark, d).select(scan.open_market_reason(AS_OF).alias("open_reason"), scan.safe_buy_reason(AS_OF).alias("safe_reason"))
    return out.groupBy("open_reason", "safe_reason").agg(F.count("*").alias("n"))


BANDS = ((1, 1, 74, 0.0, 30.0), (2, 75, 83, 0.0, 50.0), (3, 60, 100, 30.0, 80.0), (4, 84, 100, 50.0, None))


def scan_segments(spark, d):
    bands = spark.createDataFrame(list(BANDS), "segment int, ilvl_min int, ilvl_max int, price_min double, price_max double")
    rows = scan.segments(listings(spark, d), bands, "price_step")
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.min("price_step").alias("least"), F.max("price_step").alias("most"))


def candidates(spark, d):
    bands = spark.createDataFrame(list(BANDS), "segment int, ilvl_min int, ilvl_max int, price_min double, price_max double")
    rows = scan.segments(listings(spark, d).select("item_id", "ilvl", "price_step", *TIE), bands, "price_step").drop("ilvl")
    return scan.candidate_cap(rows, 15, ["segment", "price_step", *TIE]).select("item_id", "segment", "price_step", *TIE)


def trade_links(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", L.trade_link("https://trade.example/search", F.concat(F.col("c_mktsegment"), F.lit(" a/b ä")), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("")).alias("link"))


PAYLOAD = """concat('{"extended": {"mods": [{"name": "Spell Damage of ', p_name, '", "tier": ', CAST(p_size AS STRING), '}, {"text": "life", "rank": "T', CAST(p_size % 5 AS STRING), '"}]}}')"""


def native_tiers(spark, d):
    told = dealt(table(spark, d, "part")).select("p_partkey", tiers.native_tiers(F.expr(PAYLOAD)).alias("t"))
    return told.select("p_partkey", F.element_at("t.tiers", "SpellDamage").alias("spell_tier"), F.coalesce(F.element_at("t.tiers", "Life"), F.lit(0)).alias("life_tier"), F.col("t.count").alias("tiered"))


BUDGET = 1500.0


def flip_targets(spark, d):
    out = planner.steps(planner.target(_scanned(spark, d), BUDGET))
    return out.select(*TIE, F.array_join("goal_mods", ",").alias("goal_mods"), F.array_join("missing_mods", ",").alias("missing_mods"), "target_value", "target_confidence", F.array_join(F.col("steps.target_mod"), ",").alias("step_mods"), "craft_cost")


def _planned(spark, d):
    rows = planner.steps(planner.target(_scanned(spark, d), BUDGET)).withColumn("link_count", (F.col("line_no") % 3 + 4).cast("int"))
    return exits.plan_confidence(exits.exit_estimates(exits.linked(rows), BUDGET), BUDGET)


def exit_estimates(spark, d):
    return _planned(spark, d).select(*TIE, F.col("exit.sale").alias("sale"), F.col("exit.links").alias("links"), F.col("exit.position").alias("position"), F.col("exit.strength").alias("strength"), "plan_cost", "expected_profit")


def plan_confidence(spark, d):
    return _planned(spark, d).select(*TIE, "base_confidence", "craft_confidence", "exit_confidence", "plan_confidence")


def plan_gates(spark, d):
    return exits.plan_gates(_planned(spark, d), BUDGET).select(*TIE, F.array_join("plan_reasons", ",").alias("plan_reasons"))


def top_plans(spark, d):
    """The twelve best plans of all that pass the gates."""
    plans = exits.plan_gates(_planned(spark, d), BUDGET)
    order = [F.desc("trusted_profit_of_plan"), F.desc("plan_confidence"), F.desc("expected_profit"), *TIE]
    best = planner.top_plans(plans, order, F.format_string("%s: trusted %sc", "base_type", L.one_decimal(F.col("trusted_profit_of_plan"))), keep=F.size("plan_reasons") == 0)
    return best.select("plan_rank", *TIE, "trusted_profit_of_plan", "plan_confidence", "expected_profit", F.array_join("alternatives", "; ").alias("alternatives"))


def explanations(spark, d):
    """How each listing's value came about, over the scan."""
    return _scanned(spark, d).select(*TIE, scan.explanation().alias("explanation"))


def plan_rebase(spark, d):
    """Orders as plans, their lines as steps."""
    step = F.struct("l_linenumber", "l_extendedprice", "l_partkey", (F.col("l_quantity") - 5).alias("value_delta"), (F.col("l_tax") * 100).alias("expected_cost"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    anchor = F.floor(F.col("o_totalprice") / 2000)
    after = planner.rebased(F.col("steps"), anchor, anchor + F.col("o_orderkey") % 100, anchor - 30, F.lit(40.0))
    rows = rows.select("o_orderkey", after.alias("after"))
    return rows.select("o_orderkey", F.size("after").alias("n"), F.array_position(F.col("after.stop_here"), True).cast("int").alias("stop"), F.element_at("after.value_after", -1).alias("last"), F.element_at("after.value_after", 1).alias("first"))


def plan_alternatives(spark, d):
    order = [F.desc("c_acctbal"), F.col("c_custkey")]
    best = planner.top_plans(table(spark, d, "customer"), order, F.format_string("%s: trusted %sc", "c_name", L.one_decimal(F.col("c_acctbal"))))
    return best.select("plan_rank", "c_custkey", F.array_join("alternatives", "; ").alias("alternatives"))


_QUERIES = (
    plan_rebase, plan_alternatives, flip_targets, native_tiers, exit_estimates, plan_confidence, plan_gates, top_plans, explanations,
    bronze_rollup, freshness, keep_last_event, latest_per_item, reconcile, event_payloads, layer_metrics, source_distribution, stratified_sample, even_sample, price_notes, priced_by_rates, silver, gold, valuations,
    comparable_stats, comparables_excluding_own_price, market_index, scan_opportunities, scan_funnel, top_opportunities, buy_filters, scan_segments, candidates, trade_links,
)
QUERIES = {f.__name__: f for f in _QUERIES}

TIES = ", ".join(TIE)
AGE = "round(greatest((epoch_us(collected_ts) - epoch_us(indexed_ts)) / 1e6, 0.0), 3)"
BANDED = "CASE WHEN age <= 900 THEN 'fresh' WHEN age <= 21600 THEN 'active' WHEN age <= 172800 THEN 'aging' ELSE 'stale' END"
ROLLUP = f"""SELECT league, item_id, min(indexed_ts) AS first_seen_at, max(indexed_ts) AS last_seen_at, count(*) AS seen_count, count(DISTINCT source) AS source_count,
  min(price_chaos) AS min_price, max(price_chaos) AS max_price, CASE WHEN count(DISTINCT source) > 1 THEN 'both' ELSE min(source) END AS source,
  min(price_chaos) > 0 AND max(price_chaos) > 1.5 * min(price_chaos) AS price_fix_suspected FROM ({LISTINGS}) l GROUP BY league, item_id"""


def _has(text: str, *words: str) -> str:
    return "(" + " AND ".join(f"contains({text}, '{w}')" for w in words) + ")"


_TOKEN_RULES = ", ".join("CASE WHEN " + " OR ".join(_has("t", *ws) for ws in ways) + f" THEN '{name}' END" for name, ways in L.MOD_TOKENS)
_TAG_RULES = ", ".join(f"CASE WHEN {' OR '.join(_has('t', w) for w in words)} THEN '{tag}' END" for tag, words in L.MOD_TAGS)
_TEXT = "replace(replace(lower(m), '%', ' percent '), '+', ' ')"
_DISTINCT = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_NUM = lambda m: f"list_transform(regexp_extract_all({m}, '[-+]?\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE)"


def _total(kind: str, *ways: tuple[str, ...]) -> str:
    rule = " OR ".join(_has(_TEXT, *w) for w in ways)
    value = f"list_max({_NUM('m')})" if kind == "max" else f"list_sum(list_filter({_NUM('m')}, lambda x: x > 0))"
    return f"coalesce(list_sum(list_transform(mods, lambda m: CASE WHEN {rule} THEN coalesce({value}, 0.0) ELSE 0.0 END)), 0.0)"


_GEM = r"(?i)\+(\d+)\s+to\s+level\s+of\s+all\s+.+?skill\s+gems"
_CASE = lambda col, values, default: "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"
SILVER = f"""
WITH i AS (SELECT *, list_concat(explicit_mods, implicit_mods) AS mods, lower(base_type) AS low FROM ({ITEMS}) x),
a AS (SELECT *, flatten(list_transform(mods, lambda m: list_filter(list_transform([{_TEXT}], lambda t: [{_TOKEN_RULES}])[1], lambda v: v IS NOT NULL))) AS raw_tokens,
  list_concat(CASE WHEN contains(low, 'wand') THEN ['wand', 'caster'] ELSE [] END, CASE WHEN {" OR ".join(_has("low", w) for w in ("armour", "garb", "regalia"))} THEN ['body_armour'] ELSE [] END,
    CASE WHEN contains(low, 'jewel') THEN ['jewel'] ELSE [] END, CASE WHEN {" OR ".join(_has("low", w) for w in ("ring", "amulet", "belt"))} THEN ['accessory'] ELSE [] END,
    flatten(list_transform(mods, lambda m: list_filter(list_transform([{_TEXT}], lambda t: [{_TAG_RULES}])[1], lambda v: v IS NOT NULL))), list_transform(influences, lambda v: lower(v))) AS raw_tags FROM i),
b AS (SELECT *, {_DISTINCT("raw_tokens")} AS tokens, {_DISTINCT("raw_tags")} AS tags,
  CASE WHEN contains(low, 'wand') THEN 'wand_caster' WHEN contains(low, 'jewel') THEN 'jewel_cluster' WHEN {" OR ".join(_has("low", w) for w in ("ring", "amulet", "belt"))} THEN 'accessory_generic'
    WHEN {" OR ".join(_has("low", w) for w in ("armour", "garb", "regalia"))} THEN 'body_armour_defense' ELSE 'generic' END AS item_family,
  {_total("max", ("spell", "damage", "increased"))} AS spell_damage_pct, {_total("max", ("cast speed",), ("casting speed",))} AS cast_speed_pct, {_total("max", ("critical", "spell", "chance"))} AS spell_crit_pct,
  {_total("max", ("maximum life",))} AS life_flat, {_total("sum", ("resist",))} AS resist_total,
  coalesce(list_max(list_transform(mods, lambda m: CASE WHEN contains(lower(m), 'spell') THEN coalesce(TRY_CAST(regexp_extract(m, '{_GEM}', 1) AS DOUBLE), 0.0) ELSE 0.0 END)), 0.0) AS plus_all_spell_gems,
  len(list_filter(mods, lambda m: coalesce(TRY_CAST(regexp_extract(m, '{_GEM}', 1) AS INTEGER), 0) >= 1)) > 0 AS twink_override FROM a),
c AS (SELECT *, least(len(explicit_mods), 6) AS n, least(3, (least(len(explicit_mods), 6) + 1) // 2) AS p FROM b),
e AS (SELECT *, CASE WHEN n = 0 THEN 0 WHEN p + least(3, n - p) > len(tokens) THEN greatest(0, len(tokens) - p) ELSE least(3, n - p) END AS s FROM c),
silver AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE p END AS prefix_count, s AS suffix_count, greatest(0, 3 - CASE WHEN n = 0 THEN 0 ELSE p END) AS open_prefixes, greatest(0, 3 - s) AS open_suffixes,
  NOT twink_override AND ilvl < {_CASE("item_family", L.LOW_LEVEL, 80)} AS low_ilvl_context,
  CASE WHEN greatest(spell_damage_pct, cast_speed_pct, spell_crit_pct, life_flat, resist_total, plus_all_spell_gems) > 0 THEN 'fallback_numeric' ELSE 'none' END AS tier_source,
  CASE WHEN ilvl <= 74 THEN 'low' WHEN ilvl <= 83 THEN 'mid' ELSE 'high' END AS ilvl_band, fractured OR len(influences) > 0 AS is_inf FROM e)"""
_TOK = lambda t: f"list_contains(tokens, '{t}')"
_WEIGHT = lambda w: "list_sum(list_transform(tokens, lambda t: " + _CASE("t", w, valuation.OTHER_TOKEN) + "))"
_FAMILY = lambda values, of: "CASE item_family " + " ".join(f"WHEN '{f}' THEN {of(v)}" for f, v in values.items()) + " END"
_BONUS = lambda s: "greatest(0.0, " + ", ".join(f"CASE WHEN {' AND '.join(map(_TOK, need))} THEN {b} ELSE 0.0 END" for need, b in s) + ")"
_HITS = lambda need: "(" + " + ".join(f"{_TOK(t)}::INTEGER" for t in need) + f") / {len(need)}.0"
VALUED = f"""{SILVER},
v0 AS (SELECT *, price_step::DOUBLE AS listed_price, collected_ts AS listed_at, 'family_fallback' AS model_source, round(1e-9 + greatest(0.2, {_FAMILY(valuation.REQUIRED, _HITS)}), 2) AS feature_completeness,
  round(1e-9 + {_FAMILY(valuation.BASE_VALUE, str)} + coalesce({_FAMILY(valuation.TOKEN_WEIGHTS, _WEIGHT)}, 0.0) + {" + ".join(f"{c} * {w}" for c, w in valuation.NUMERIC_WEIGHTS.items())} + {_FAMILY(valuation.SYNERGIES, _BONUS)}
    + greatest(0.0, ilvl - 75.0) * 1.5 + (open_prefixes + open_suffixes) * 4.0 + CASE WHEN is_inf THEN 18.0 ELSE 0.0 END, 1) AS predicted_value FROM silver),
valued AS (SELECT *, round(1e-9 + greatest(0.3, least(0.95, 0.35 + feature_completeness * 0.25 + CASE WHEN item_family <> 'generic' THEN 0.1 ELSE 0.0 END + CASE WHEN is_inf THEN 0.05 ELSE 0.0 END + CASE WHEN ilvl >= 84 THEN 0.05 ELSE 0.0 END)), 2) AS confidence FROM v0)"""
_PEN = "list_sum(list_transform(flags0, lambda f: " + _CASE("f", scan.PENALTIES, 0.0) + "))"
_HOURS = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(listed_at)) / 3.6e9)"
SCAN = f"""{VALUED},
cmp AS (SELECT h.item_family, h.base_type, h.listed_price, min(l.listed_price) AS f, quantile_cont(l.listed_price, 0.5) AS m, max(l.listed_price) - min(l.listed_price) AS sp, count(l.listed_price) AS k
  FROM (SELECT DISTINCT item_family, base_type, listed_price FROM valued) h LEFT JOIN (SELECT item_family, base_type, listed_price FROM valued WHERE listed_price > 0) l
    ON h.item_family = l.item_family AND h.base_type = l.base_type AND h.listed_price <> l.listed_price GROUP BY 1, 2, 3),
w AS (SELECT v.*, round(coalesce(f, v.listed_price), 1) AS market_floor, round(coalesce(m, v.listed_price), 1) AS market_median, round(coalesce(sp, 0.0), 1) AS market_spread, greatest(k, 1) AS comparables_count, k = 0 AS alone
  FROM valued v JOIN cmp USING (item_family, base_type, listed_price)),
w1 AS (SELECT *, CASE WHEN alone THEN 'near_market' WHEN listed_price <= greatest(1.0, market_floor * 0.98) THEN 'below_floor' WHEN listed_price > greatest(market_median * 1.35, market_floor + greatest(market_spread, 10.0)) THEN 'outlier' ELSE 'near_market' END AS pricing_position,
  list_filter([CASE WHEN {_HOURS} > 2000 AND listed_price <= 2 AND listed_price > 0 AND predicted_value / listed_price >= 8 THEN 'price_fix_suspected' END, CASE WHEN {_HOURS} > 2000 THEN 'stale_listing' END, CASE WHEN confidence < 0.5 THEN 'low_confidence' END,
    CASE WHEN listed_price >= 80 AND confidence < 0.75 THEN 'high_ticket_low_confidence' END, CASE WHEN listed_price < 5 THEN 'cheap_listing' END, CASE WHEN corrupted THEN 'corrupted' END, CASE WHEN fractured THEN 'fractured' END,
    CASE WHEN len(influences) > 0 THEN 'influenced' END, 'family_fallback', CASE WHEN low_ilvl_context THEN 'low_ilvl_context' END], lambda v: v IS NOT NULL) AS flags0 FROM w),
w2 AS (SELECT *, predicted_value - listed_price AS pr, greatest(predicted_value - listed_price, 0.0) * confidence AS tp, greatest((predicted_value - listed_price) / greatest(listed_price, 1.0), 0.0) AS roi,
  greatest((predicted_value - listed_price) / greatest(predicted_value, 1.0), 0.0) AS off FROM w1),
w3 AS (SELECT *, CASE WHEN listed_price <= 0 THEN 0.0 ELSE round(1e-9 + greatest(0.0, tp * 0.9 + least(roi, 3.0) * 16.0 + least(off, 0.8) * 20.0 + confidence * 25.0 - {_PEN}
    - CASE WHEN listed_price < 5 AND confidence >= 0.45 AND confidence < 0.6 THEN 16.0 ELSE 0.0 END), 1) END AS s0,
  CASE WHEN listed_price <= 0 THEN 0.0 ELSE round(1e-9 + tp, 1) END AS tp0, CASE WHEN listed_price <= 0 THEN 0.0 ELSE round(1e-9 + pr, 1) END AS pr0, CASE WHEN listed_price <= 0 THEN 0.0 ELSE round(1e-9 + off, 2) END AS off0,
  comparables_count < 3 AS weak, greatest(1.6 * CASE WHEN market_median > 0 THEN market_median WHEN market_floor > 0 THEN market_floor ELSE listed_price END, listed_price * 1.1, 15.0) AS cap FROM w2),
w4 AS (SELECT *, CASE WHEN weak THEN list_concat(flags0, ['fallback_low_evidence']) ELSE flags0 END AS flags1, weak AND predicted_value > cap AS cut FROM w3),
w5 AS (SELECT *, CASE WHEN cut THEN round(1e-9 + cap, 1) ELSE predicted_value END AS ml_value, CASE WHEN cut THEN round(1e-9 + round(cap, 1) - listed_price, 1) ELSE pr0 END AS profit FROM w4),
w6 AS (SELECT *, CASE WHEN cut THEN round(1e-9 + greatest(profit / greatest(ml_value, 1.0), 0.0), 2) ELSE off0 END AS relative_discount, CASE WHEN cut THEN round(1e-9 + greatest(profit, 0.0) * confidence, 1) ELSE tp0 END AS trusted_profit,
  round(1e-9 + greatest(0.0, s0 + CASE pricing_position WHEN 'below_floor' THEN 14.0 WHEN 'near_market' THEN 4.0 ELSE -8.0 END + least(greatest(market_median - listed_price, 0.0), 80.0) * 0.08
    - (CASE WHEN comparables_count <= 1 THEN 6.0 ELSE 0.0 END + CASE WHEN market_spread > greatest(market_median * 1.1, 30.0) THEN 4.0 ELSE 0.0 END + CASE WHEN feature_completeness < 0.4 THEN 5.0 ELSE 0.0 END)), 1) AS s1,
  CASE WHEN weak AND market_median > 0 THEN CASE WHEN ml_value / greatest(market_median, 1.0) > 3 THEN 'low_evidence_ml_market_divergence_3x' WHEN ml_value / greatest(market_median, 1.0) > 2 THEN 'low_evidence_ml_market_divergence_2x' END END AS far FROM w5),
w7 AS (SELECT *, CASE WHEN far IS NULL THEN s1 ELSE round(1e-9 + greatest(0.0, s1 - CASE WHEN ends_with(far, '3x') THEN 80.0 ELSE 55.0 END), 1) END AS score, CASE WHEN far IS NULL THEN flags1 ELSE list_concat(flags1, [far]) END AS flags,
  CASE WHEN far IS NOT NULL THEN far WHEN low_ilvl_context AND NOT twink_override AND pricing_position = 'outlier' THEN 'low_ilvl_outlier'
    WHEN (ml_value >= 150 OR profit >= 80) AND NOT twink_override AND (low_ilvl_context OR ilvl < {_CASE("item_family", scan.HIGH_TICKET_LEVEL, 75)}) THEN 'high_ticket_low_ilvl_without_override'
    WHEN weak AND pricing_position = 'outlier' THEN 'fallback_low_evidence_outlier' WHEN weak AND confidence < 0.65 THEN 'fallback_low_evidence_low_confidence'
    WHEN weak AND profit < 15 AND relative_discount < 0.18 THEN 'fallback_low_evidence_weak_value' WHEN weak AND low_ilvl_context AND NOT twink_override THEN 'fallback_low_evidence_low_ilvl'
    WHEN NOT (profit > 0 AND ml_value > listed_price) THEN 'ml_signal_negative'
    WHEN NOT CASE WHEN comparables_count <= 1 THEN relative_discount >= 0.25 OR profit >= 20 WHEN pricing_position = 'below_floor' THEN true WHEN market_median > 0 THEN listed_price <= market_median * 0.94 WHEN market_floor > 0 THEN listed_price <= market_floor ELSE false END THEN 'market_signal_negative'
    ELSE 'ml_market_consensus_ok' END AS agreed FROM w6),
scanned AS (SELECT *, array_to_string(flags, ',') AS risk_flags, CASE WHEN ilvl < 75 AND NOT twink_override THEN 'filtered_ilvl' WHEN fractured AND low_ilvl_context THEN 'filtered_brick' WHEN listed_price < 1 THEN 'filtered_min_price'
  WHEN list_contains(flags, 'price_fix_suspected') THEN 'filtered_price_fix' WHEN agreed <> 'ml_market_consensus_ok' THEN agreed WHEN profit < 10 THEN 'filtered_min_profit' END AS filter_reason FROM w7)"""
_SEGMENT = "CASE " + " ".join(f"WHEN ilvl BETWEEN {a} AND {b} AND price_step >= {lo}" + (f" AND price_step <= {hi}" if hi is not None else "") + f" THEN {k}" for k, a, b, lo, hi in BANDS) + " END"
_BUCKET = "CASE " + " ".join(f"WHEN price_step BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in L.PRICE_BUCKETS) + " END"
_INDEX = """SELECT item_family, base_type, link_count, ilvl_index, round(min(price), 1) AS market_floor, round(quantile_cont(price, 0.5), 1) AS market_median FROM r WHERE price > 0 GROUP BY ALL"""

ORACLES = {
    "bronze_rollup": ROLLUP,
    "freshness": f"SELECT source, {BANDED} AS freshness_band, count(*) AS n, round(max(age), 3) AS oldest FROM (SELECT source, {AGE} / 1000.0 AS age FROM ({LISTINGS}) l) a GROUP BY 1, 2",
    "keep_last_event": "SELECT doc_id, source, event_key FROM (SELECT doc_id, source, sha1(text) AS event_key, row_number() OVER (PARTITION BY sha1(text) ORDER BY source DESC, doc_id DESC) AS n FROM documents) d WHERE n = 1",
    "latest_per_item": f"SELECT item_id, time, {TIES} FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY time IS NULL DESC, time DESC, {', '.join(t + ' DESC' for t in TIE)}) AS n FROM (SELECT *, CASE WHEN line_no <> 3 THEN indexed_ts END AS time FROM ({LISTINGS}) l) t) r WHERE n = 1",
    "reconcile": f"SELECT r.source AS all_sources, r.price_fix_suspected, count(*) AS n, sum(seen_count)::BIGINT AS sightings, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM ({LISTINGS}) l JOIN ({ROLLUP}) r USING (league, item_id) GROUP BY 1, 2",
    "event_payloads": "SELECT event_id, json_type(props) = 'OBJECT' AS valid, replace(props, ' ', '') AS payload, sha1(concat_ws('|', event_type, user_id::VARCHAR, coalesce(props, 'None'))) AS event_key FROM events",
    "layer_metrics": "SELECT count(*) AS rows_read, count(DISTINCT sha1(text)) AS rows_kept, round(1 - count(DISTINCT sha1(text)) / count(*), 4) AS dedup_rate FROM documents",
    "source_distribution": f"SELECT league, source, count(*) AS n FROM ({LISTINGS}) l GROUP BY 1, 2",
    "stratified_sample": f"SELECT base_type, bucket, n::INTEGER AS n, {TIES} FROM (SELECT *, row_number() OVER (PARTITION BY base_type, bucket ORDER BY indexed_ts DESC, {TIES}) AS n FROM (SELECT *, {_BUCKET} AS bucket FROM ({LISTINGS}) l) b WHERE bucket IS NOT NULL) r WHERE n <= 3",
    "even_sample": f"SELECT base_type, {TIES} FROM (SELECT *, row_number() OVER (PARTITION BY base_type ORDER BY {TIES}) - 1 AS i, count(*) OVER (PARTITION BY base_type) AS n FROM ({LISTINGS}) l) r WHERE n <= 7 OR list_contains(list_transform(range(7), lambda k: round(k / 6.0 * (n - 1))::INTEGER), i::INTEGER)",
    "price_notes": f"""WITH t AS (SELECT {NOTE} AS note FROM lineitem), u AS (SELECT note, count(*) AS n, lower(trim(note)) AS low FROM t GROUP BY note),
      k AS (SELECT *, string_split_regex(trim(replace(regexp_replace(low, '^~(b/o|price)', ''), '/', ' ')), '\\s+') AS tokens FROM u),
      p AS (SELECT *, list_position(list_transform(tokens, lambda x: regexp_matches(x, '^[+-]?[0-9]+([.][0-9]+)?$')), true) AS a, list_position(list_transform(tokens, lambda x: map_contains({ALIASES}, regexp_replace(x, '[^a-z]', '', 'g'))), true) AS c FROM k),
      g AS (SELECT *, CASE WHEN regexp_matches(low, '^~(b/o|price)') AND coalesce(a, 0) > 0 AND coalesce(c, 0) > a THEN CASE WHEN tokens[a]::DOUBLE > 0 THEN tokens[a]::DOUBLE END END AS amount FROM p),
      h AS (SELECT *, CASE WHEN amount IS NOT NULL THEN ({ALIASES})[regexp_replace(tokens[c], '[^a-z]', '', 'g')] END AS currency FROM g)
      SELECT note, amount, currency, round(amount * CASE currency WHEN 'chaos' THEN 1 WHEN 'alchemy' THEN 0.25 WHEN 'exalted' THEN 60 WHEN 'divine' THEN 125 END, 2)::DOUBLE AS chaos, CASE WHEN amount > 0 THEN 'rare' END AS rarity, n FROM h""",
    "priced_by_rates": """WITH r AS (SELECT ['Divine Orb', 'Exalted Orb', 'Vaal Orb'][n_nationkey + 1] AS name, n_nationkey * 10 + 5.0 AS rate FROM nation WHERE n_nationkey < 3),
      o AS (SELECT ['divine', 'exalted', 'vaal', 'unknown', 'chaos'][o_orderkey % 5 + 1] AS currency, o_totalprice / 1000 AS amount FROM orders),
      j AS (SELECT currency, CASE WHEN currency = 'chaos' THEN amount ELSE amount * rate END AS chaos FROM o LEFT JOIN r ON lower(name) = currency || ' orb')
      SELECT currency, count(*) AS n, count(chaos) AS priced, round(sum(chaos)::DOUBLE, 2) AS total FROM j GROUP BY 1""",
    "silver": f"""{SILVER} SELECT {TIES}, item_family, ilvl_band, array_to_string(tokens, ',') AS mod_tokens, array_to_string(tags, ',') AS tag_tokens, prefix_count::INTEGER AS prefix_count, suffix_count::INTEGER AS suffix_count,
      open_prefixes::INTEGER AS open_prefixes, open_suffixes::INTEGER AS open_suffixes, spell_damage_pct, cast_speed_pct, life_flat, resist_total, plus_all_spell_gems, twink_override, low_ilvl_context, fractured AND low_ilvl_context AS fractured_low_ilvl_brick, tier_source FROM silver""",
    "gold": f"""{SILVER} SELECT item_family, count(*) AS n, {", ".join(f"sum({_TOK(t)}::INTEGER)::DOUBLE AS {c}" for c, t in valuation.FLAGS.items())}, sum(len(tokens))::DOUBLE AS mod_count,
      sum(open_prefixes + open_suffixes)::DOUBLE AS open_affixes, sum(is_inf::INTEGER)::DOUBLE AS is_influenced, sum(spell_crit_pct) AS spell_crit_pct FROM silver GROUP BY 1""",
    "valuations": f"{VALUED} SELECT {TIES}, item_family, predicted_value, confidence, feature_completeness, model_source FROM valued",
    "comparable_stats": f"SELECT base_type, round(min(price_step), 1) AS market_floor, round(quantile_cont(price_step, 0.5), 1) AS market_median, round(max(price_step) - min(price_step), 1) AS market_spread, count(*) AS comparables_count FROM (SELECT base_type, price_step::DOUBLE AS price_step FROM ({LISTINGS}) x) l WHERE price_step > 0 GROUP BY 1",
    "comparables_excluding_own_price": f"""WITH l AS (SELECT base_type, league, price_step::DOUBLE AS price FROM ({LISTINGS}) x WHERE price_step > 0)
      SELECT h.base_type, h.league, h.price, round(coalesce(min(l.price), h.price), 1) AS market_floor, round(coalesce(quantile_cont(l.price, 0.5), h.price), 1) AS market_median, round(coalesce(max(l.price) - min(l.price), 0.0), 1) AS market_spread,
        greatest(count(l.price), 1) AS comparables_count FROM (SELECT DISTINCT * FROM l) h LEFT JOIN l ON h.base_type = l.base_type AND h.league = l.league AND h.price <> l.price GROUP BY 1, 2, 3""",
    "market_index": f"""{SILVER}, r AS (SELECT *, price_step::DOUBLE AS price, line_no % 3 + 4 AS link_count, CASE WHEN item_family <> 'body_armour_defense' THEN 'any' WHEN ilvl >= 84 THEN '84plus' WHEN ilvl >= 78 THEN '78to83' ELSE 'low' END AS ilvl_index FROM silver),
      x AS ({_INDEX}) SELECT item_family, base_type, ilvl_index, link_count::INTEGER AS link_count, count(*) AS n, max(x.market_floor) AS market_floor, max(x.market_median) AS market_median, max(y.market_median) AS six_market_median
      FROM r LEFT JOIN x USING (item_family, base_type, ilvl_index, link_count) LEFT JOIN (SELECT item_family, base_type, ilvl_index, market_median FROM x WHERE link_count = 6) y USING (item_family, base_type, ilvl_index) GROUP BY 1, 2, 3, 4""",
    "scan_opportunities": f"{SCAN} SELECT {TIES}, score, ml_value, profit, trusted_profit, relative_discount, risk_flags, pricing_position, market_median, comparables_count, filter_reason FROM scanned",
    "scan_funnel": f"{SCAN} SELECT coalesce(filter_reason, 'passed') AS reason, count(*) AS n, max(profit) AS max_profit FROM scanned GROUP BY 1",
    "top_opportunities": f"{SCAN} SELECT {TIES}, score, trusted_profit, profit FROM scanned WHERE filter_reason IS NULL ORDER BY score DESC, trusted_profit DESC, profit DESC, {TIES} LIMIT 50",
    "buy_filters": f"""{SCAN}, f AS (SELECT CASE WHEN confidence < 0.45 THEN 'filtered_open_confidence' WHEN listed_price < 5 AND confidence < 0.6 THEN 'filtered_open_cheap_low_confidence' WHEN listed_price < 5 AND profit < 20 THEN 'filtered_open_cheap_low_profit'
      WHEN listed_price < 5 AND {_HOURS} > 12 THEN 'filtered_open_cheap_stale' END AS open_reason, CASE WHEN confidence < CASE WHEN listed_price >= 120 THEN 0.82 WHEN listed_price >= 50 THEN 0.78 ELSE 0.7 END THEN 'filtered_safe_buy_confidence'
      WHEN {_HOURS} > 24 THEN 'filtered_safe_buy_age' WHEN listed_price < 5 THEN 'filtered_safe_buy_price' END AS safe_reason FROM scanned) SELECT open_reason, safe_reason, count(*) AS n FROM f GROUP BY 1, 2""",
    "flip_targets": f"""{SCAN}, g AS (SELECT *, CASE WHEN item_family = 'body_armour_defense' AND contains(lower(base_type), 'garb') AND ilvl >= 84 THEN ['Life1', 'SpellSuppress1', 'Resist1'] ELSE {_FAMILY(planner.GOALS, lambda g: str(list(g)))} END AS goals FROM scanned),
      g1 AS (SELECT *, list_filter(goals, lambda x: NOT list_contains(tokens, x)) AS missing FROM g),
      g2 AS (SELECT *, least(3, prefix_count + len(list_filter(missing, lambda x: x IN {planner.PREFIXES}))) AS tp_, least(3, suffix_count + len(list_filter(missing, lambda x: x IN {planner.SUFFIXES}))) AS ts_,
        list_distinct(list_concat(list_concat(tokens, missing), list_transform(missing, lambda x: replace(x, '1', '')))) AS tok2 FROM g1),
      g3 AS (SELECT *, {_FAMILY(valuation.REQUIRED, _HITS).replace("tokens", "tok2")} AS fc2, round(1e-9 + {_FAMILY(valuation.BASE_VALUE, str)} + {_FAMILY(valuation.TOKEN_WEIGHTS, _WEIGHT).replace("(tokens", "(tok2")} + {_FAMILY(valuation.SYNERGIES, _BONUS).replace("tokens", "tok2")}
        + greatest(0.0, ilvl - 75.0) * 1.5 + (6 - tp_ - ts_) * 4.0 + CASE WHEN is_inf THEN 18.0 ELSE 0.0 END, 1) AS target_value FROM g2),
      g4 AS (SELECT *, round(1e-9 + greatest(0.3, least(0.95, 0.35 + round(1e-9 + greatest(0.2, fc2), 2) * 0.25 + CASE WHEN item_family <> 'generic' THEN 0.1 ELSE 0.0 END + CASE WHEN is_inf THEN 0.05 ELSE 0.0 END + CASE WHEN ilvl >= 84 THEN 0.05 ELSE 0.0 END)), 2) AS oc,
        list_concat(CASE WHEN list_contains(flags, 'fractured') OR list_contains(flags, 'influenced') THEN ['cleanup'] ELSE [] END, CASE WHEN len(missing) > 0 THEN missing[1:3] ELSE goals[1:2] END) AS step_list FROM g3)
      SELECT {TIES}, array_to_string(goals, ',') AS goal_mods, array_to_string(missing, ',') AS missing_mods, target_value, round(1e-9 + greatest(0.35, least(0.9, CASE WHEN item_family = 'body_armour_defense'
        THEN oc * 0.6 + confidence * 0.25 + CASE WHEN comparables_count >= 3 THEN 0.08 ELSE -0.02 END - CASE WHEN low_ilvl_context THEN 0.05 ELSE 0.0 END ELSE oc * 0.55 + confidence * 0.25 + CASE WHEN comparables_count >= 3 THEN 0.04 ELSE -0.03 END END)), 2) AS target_confidence,
        array_to_string(step_list, ',') AS step_mods, round(1e-9 + list_sum(list_transform(step_list, lambda x: {_CASE("x", {k: round(v[1] / max(v[2], 0.05), 1) for k, v in planner.ACTIONS.items()} | {"cleanup": 18.2}, 6.0)})), 1) AS craft_cost FROM g4""",
    "scan_segments": f"SELECT {_SEGMENT} AS segment, count(*) AS n, min(price_step) AS least, max(price_step) AS most FROM ({LISTINGS}) l WHERE {_SEGMENT} IS NOT NULL GROUP BY 1",
    "candidates": f"""WITH s AS (SELECT *, {_SEGMENT} AS segment FROM ({LISTINGS}) l), f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY segment, price_step, {TIES}) AS n FROM s WHERE segment IS NOT NULL)
      SELECT item_id, segment, price_step, {TIES} FROM f WHERE n = 1 ORDER BY segment, price_step, {TIES} LIMIT 90""",
    "plan_rebase": """WITH l AS (SELECT l_orderkey, row_number() OVER w AS i, greatest(l_quantity - 5, 0.0) AS g, l_tax * 100 AS c, sum(greatest(l_quantity - 5, 0.0)) OVER w AS done, sum(l_tax * 100) OVER w AS cost,
        sum(greatest(l_quantity - 5, 0.0)) OVER (PARTITION BY l_orderkey) AS whole, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey ROWS UNBOUNDED PRECEDING)),
      v AS (SELECT o_orderkey, i, n, cost, floor(o_totalprice / 2000) AS a, round(1e-9 + floor(o_totalprice / 2000) + CASE WHEN whole > 0 THEN (o_orderkey % 100) * done / whole ELSE 0.0 END, 1) AS after FROM orders JOIN l ON o_orderkey = l_orderkey)
      SELECT o_orderkey, max(n)::INTEGER AS n, coalesce(min(i) FILTER (after - (a - 30) - cost > 0 AND after - (a - 30) - cost >= 24), 0)::INTEGER AS stop, arg_max(after, i) AS last, arg_min(after, i) AS first FROM v GROUP BY 1""",
    "plan_alternatives": """WITH b AS (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS plan_rank FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12), n AS (SELECT *, c_name || ': trusted ' || printf('%.1f', c_acctbal) || 'c' AS label FROM b)
      SELECT plan_rank, c_custkey, concat_ws('; ', lead(label, 1) OVER (ORDER BY plan_rank), lead(label, 2) OVER (ORDER BY plan_rank)) AS alternatives FROM n""",
    "native_tiers": "SELECT p_partkey, p_size AS spell_tier, p_size % 5 AS life_tier, 1 + (p_size % 5 > 0)::INTEGER AS tiered FROM part",
    "trade_links": "SELECT c_custkey, 'https://trade.example/search/' || url_encode(c_mktsegment || ' a/b ä') || '/' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '#' || c_custkey ELSE '' END AS link FROM customer",
}

_LEAN = _CASE("x", {k: v[2] for k, v in planner.ACTIONS.items()} | {"cleanup": planner.REPAIR[2]}, planner.OTHER_ACTION[2])
_BRICK = _CASE("x", {k: v[4] for k, v in planner.ACTIONS.items()} | {"cleanup": planner.REPAIR[4]}, planner.OTHER_ACTION[4])
_BY = lambda col, values: _CASE(col, values, "NULL")


def _exit_sql(name: str, floor: str, median: str, spread: str, n: str, links: str, cost: float, rule: str) -> str:
    """One candidate exit as columns with the name in front."""
    return f"""
  {name}0 AS (SELECT *, {floor} AS {name}_f, {median} AS {name}_m, {spread} AS {name}_s, {n} AS {name}_n FROM {{0}}),
  {name}1 AS (SELECT *, CASE WHEN {name}_n >= 3 AND {name}_m > 0 THEN {name}_m * 0.6 + target_value * 0.4 WHEN {name}_n >= 1 AND {name}_m > 0 THEN {name}_f * 0.25 + {name}_m * 0.4 + least(target_value, {name}_m * 1.1) * 0.35
    ELSE {name}_f * 0.55 + least(target_value, greatest({name}_f * 1.15, {name}_f + 10)) * 0.45 END AS {name}_raw FROM {name}0),
  {name}2 AS (SELECT *, CASE WHEN {name}_m > 0 THEN greatest(least({name}_raw, greatest({name}_m * 1.1, {name}_f + greatest({name}_s * 0.35, 10.0))), {name}_f) ELSE {name}_raw END AS {name}_sale,
    CASE WHEN {name}_n >= 3 THEN 'strong' WHEN {name}_n >= 2 THEN 'moderate' ELSE 'weak' END AS {name}_w FROM {name}1),
  {name}3 AS (SELECT *, {rule} AND ({name}_f > 0 OR {name}_m > 0) AS {name}_ok, (round(1e-9 + {name}_sale, 1) - listed_price - craft_cost - {cost}) * {_BY(f"{name}_w", exits.SUPPORT)} * greatest(oc, 0.25) AS {name}_p,
    CASE WHEN {name}_f <= 0 AND {name}_m <= 0 THEN 'near_market' WHEN {name}_sale <= greatest({name}_f * 1.05, {name}_f + 5) THEN 'below_floor' WHEN {name}_m > 0 AND {name}_sale > greatest({name}_m * 1.18, {name}_f + greatest({name}_s, 15.0)) THEN 'outlier' ELSE 'near_market' END AS {name}_pos FROM {name}2)"""


_FLIP = ORACLES["flip_targets"].replace(f"SELECT {TIES}, array_to_string(goals", f"SELECT {TIES}, oc, step_list, array_to_string(goals")
_PICK = lambda x: f"CASE WHEN use_six THEN six_{x} ELSE own_{x} END"
PLANS = f"""
WITH ft AS ({_FLIP}), sc AS ({SCAN} SELECT {TIES}, item_family, base_type, ilvl, listed_price, profit, confidence, low_ilvl_context, twink_override, market_floor, market_median, market_spread, comparables_count, pricing_position,
    (line_no % 3 + 4)::INTEGER AS link_count, CASE WHEN item_family <> 'body_armour_defense' THEN 'any' WHEN ilvl >= 84 THEN '84plus' WHEN ilvl >= 78 THEN '78to83' ELSE 'low' END AS ilvl_index FROM scanned),
  ix AS (SELECT item_family, base_type, ilvl_index, link_count, round(min(listed_price), 1) AS xf, round(quantile_cont(listed_price, 0.5), 1) AS xm, round(max(listed_price) - min(listed_price), 1) AS xs, count(*) AS xn FROM sc WHERE listed_price > 0 GROUP BY 1, 2, 3, 4),
  j AS (SELECT sc.*, ft.oc, ft.step_list, ft.goal_mods, ft.target_value, ft.target_confidence, ft.craft_cost, o.xf AS oxf, o.xm AS oxm, o.xs AS oxs, o.xn AS oxn, s.xf AS sxf, s.xm AS sxm, s.xs AS sxs, s.xn AS sxn
    FROM sc JOIN ft USING ({TIES}) LEFT JOIN ix o USING (item_family, base_type, ilvl_index, link_count) LEFT JOIN (SELECT * FROM ix WHERE link_count = 6) s ON sc.item_family = s.item_family AND sc.base_type = s.base_type AND sc.ilvl_index = s.ilvl_index),
  {_exit_sql("own", "greatest(coalesce(oxf, CASE WHEN market_floor > 0 AND market_median > 0 THEN least(market_floor, market_median) ELSE greatest(market_floor, market_median) END), market_floor)",
             "greatest(coalesce(oxm, CASE WHEN market_floor > 0 AND market_median > 0 THEN round(1e-9 + (market_floor + market_median) / 2, 1) ELSE greatest(market_floor, market_median) END), market_median)",
             "greatest(coalesce(oxs, CASE WHEN market_floor > 0 AND market_median > 0 THEN round(1e-9 + abs(market_median - market_floor), 1) ELSE 0.0 END), market_spread)",
             "greatest(coalesce(oxn, (market_floor > 0)::INTEGER + (market_median > 0)::INTEGER), comparables_count)", "link_count", 0.0, "true").format("j")},
  {_exit_sql("six", "sxf", "sxm", "sxs", "sxn", "6", exits.SIX_LINK_COST, f"item_family = 'body_armour_defense' AND link_count < 6 AND coalesce(sxn, 0) > 0 AND {exits.SIX_LINK_COST} <= {BUDGET}").format("own3")},
  k AS (SELECT *, coalesce(six_ok, false) AND (NOT own_ok OR six_p > own_p) AS use_six FROM six3),
  k1 AS (SELECT *, own_ok OR use_six AS there, {_PICK("f")} AS ef, {_PICK("n")} AS en, {_PICK("w")} AS strength, {_PICK("pos")} AS position, round(1e-9 + {_PICK("sale")}, 1) AS sale, CASE WHEN use_six THEN 6 ELSE link_count END AS links, CASE WHEN use_six THEN {exits.SIX_LINK_COST} ELSE 0.0 END AS lc FROM k),
  k2 AS (SELECT *, round(1e-9 + craft_cost + lc, 1) AS plan_cost FROM k1),
  k3 AS (SELECT *, round(1e-9 + sale - listed_price - plan_cost, 1) AS expected_profit,
    greatest(0.2, least(0.95, confidence * 0.55 + target_confidence * 0.2 + CASE WHEN pricing_position = 'below_floor' THEN 0.15 ELSE 0.0 END + CASE WHEN comparables_count >= 3 THEN 0.08 ELSE -0.05 END - CASE WHEN low_ilvl_context AND NOT twink_override THEN 0.1 ELSE 0.0 END)) AS b,
    greatest(0.0, least(0.9, (list_sum(list_transform(step_list, lambda x: {_LEAN})) + use_six::INTEGER) / greatest(len(step_list) + use_six::INTEGER, 1) - (list_sum(list_transform(step_list, lambda x: {_BRICK})) + use_six::INTEGER * 0.05) * 0.08
      - CASE WHEN use_six AND {exits.SIX_LINK_COST} > {BUDGET} * 0.75 THEN 0.12 ELSE 0.0 END)) AS cr,
    greatest(0.0, least(0.9, {_BY("strength", exits.EVIDENCE)} + oc * 0.18 - CASE WHEN en < 2 THEN 0.12 ELSE 0.0 END - 0.08 - CASE WHEN position = 'outlier' THEN 0.12 ELSE 0.0 END - CASE WHEN use_six THEN 0.08 ELSE 0.0 END)) AS ex FROM k2),
  planned AS (SELECT *, round(1e-9 + b, 2) AS base_confidence, round(1e-9 + cr, 2) AS craft_confidence, round(1e-9 + ex, 2) AS exit_confidence, round(1e-9 + greatest(0.0, least(0.92, b * 0.3 + cr * 0.3 + ex * 0.4)), 2) AS plan_confidence FROM k3),
  gated AS (SELECT *, round(1e-9 + expected_profit * plan_confidence, 1) AS trusted_profit_of_plan, array_to_string(list_filter([CASE WHEN profit <= 0 THEN 'base_not_discounted' END, CASE WHEN item_family = 'body_armour_defense' AND low_ilvl_context AND NOT twink_override THEN 'body_armour_low_ilvl' END,
    CASE WHEN NOT there THEN 'no_exit' END, CASE WHEN there AND plan_cost > {BUDGET} THEN 'over_budget' END, CASE WHEN there AND expected_profit <= 0 THEN 'non_profitable_plan' END, CASE WHEN there AND craft_confidence <= 0 THEN 'craft_ineligible' END,
    CASE WHEN there AND plan_confidence < 0.45 THEN 'confidence_too_low' END, CASE WHEN there AND en < 2 AND NOT (use_six AND ef > 0) THEN 'fallback_exit_low_evidence' END, CASE WHEN there AND position = 'outlier' AND en < 3 THEN 'exit_outlier_low_evidence' END], lambda v: v IS NOT NULL), ',') AS plan_reasons FROM planned)"""
_THERE = lambda *names: ", ".join(f"CASE WHEN there THEN {n} END AS {n}" for n in names)
ORACLES |= {
    "exit_estimates": f"{PLANS} SELECT {TIES}, {_THERE('sale', 'links', 'position', 'strength', 'plan_cost', 'expected_profit')} FROM gated",
    "plan_confidence": f"{PLANS} SELECT {TIES}, base_confidence, {_THERE('craft_confidence', 'exit_confidence', 'plan_confidence')} FROM gated",
    "plan_gates": f"{PLANS} SELECT {TIES}, plan_reasons FROM gated",
    "top_plans": f"""{PLANS}, best AS (SELECT *, row_number() OVER (ORDER BY trusted_profit_of_plan DESC, plan_confidence DESC, expected_profit DESC, {TIES})::INTEGER AS plan_rank FROM gated WHERE plan_reasons = '' QUALIFY plan_rank <= 12),
      n AS (SELECT *, base_type || ': trusted ' || printf('%.1f', trusted_profit_of_plan) || 'c' AS label FROM best)
      SELECT plan_rank, {TIES}, trusted_profit_of_plan, plan_confidence, expected_profit, concat_ws('; ', lead(label, 1) OVER (ORDER BY plan_rank), lead(label, 2) OVER (ORDER BY plan_rank)) AS alternatives FROM n""",
    "explanations": f"""{SCAN} SELECT {TIES}, concat_ws('; ', printf('valued at %.1f by %s with confidence %.2f', ml_value, model_source, confidence), printf('market floor %.1f, median %.1f over %d listings, %s', market_floor, market_median, comparables_count, pricing_position),
      CASE WHEN len(flags) > 0 THEN 'risks: ' || array_to_string(flags, ', ') END, 'consensus: ' || agreed) AS explanation FROM scanned""",
}
