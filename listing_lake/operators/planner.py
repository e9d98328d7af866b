"""Flip targets and steps for scanned listings, as one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.functions import listing as L
from listing_lake.operators import valuation

# Goal mods by family; action, base cost, chance, value gained and brick risk by mod; sides of mods.
GOALS = {
    "wand_caster": ("SpellDamage1", "CastSpeed1", "CritChanceSpells1"), "body_armour_defense": ("Life1", "Resist1"), "jewel_cluster": ("Life1", "CritChanceSpells1"),
    "accessory_generic": ("Life1", "Resist1", "Attributes1"), "generic": ("Life1", "Resist1"),
}
SUPPRESS_GOALS = ("Life1", "SpellSuppress1", "Resist1")
ACTIONS = {
    "SpellDamage1": ("essence", 30.0, 0.42, 34.0, 0.22), "CastSpeed1": ("harvest_reforge", 20.0, 0.33, 28.0, 0.28), "CritChanceSpells1": ("bench_craft", 8.0, 1.0, 18.0, 0.02),
    "Life1": ("essence", 18.0, 0.48, 30.0, 0.18), "SpellSuppress1": ("harvest_reforge", 24.0, 0.24, 42.0, 0.30), "Resist1": ("bench_craft", 4.0, 1.0, 16.0, 0.01), "Attributes1": ("bench_craft", 4.0, 1.0, 12.0, 0.01),
}
OTHER_ACTION = ("bench_craft", 6.0, 1.0, 10.0, 0.02)
REPAIR = ("annul_repair", 18.2, 0.55, 12.0, 0.2)
PREFIXES, SUFFIXES = ("SpellDamage1", "Life1", "Mana1"), ("CastSpeed1", "CritChanceSpells1", "SpellSuppress1", "Resist1", "Attributes1")
DEFENCES = ((("plate",), "armour"), (("garb", "carnal", "silks"), "evasion_energy_shield"), (("regalia", "robe", "vestment"), "energy_shield"), (("leather", "jerkin", "tunic", "doublet"), "evasion"))
ATTRIBUTES = {"armour": "str", "evasion": "dex", "energy_shield": "int", "armour_evasion": "str_dex", "armour_energy_shield": "str_int", "evasion_energy_shield": "dex_int"}

c = F.col


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def defence_profile(base: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for words, name in DEFENCES:
        out = out.when(L.any_word(F.lower(base), words), name)
    return out.otherwise("unknown")


def attribute_profile(base: Column) -> Column:
    return L.lookup(ATTRIBUTES, defence_profile(base), "unknown")


def suppression_eligible(base: Column) -> Column:
    return defence_profile(base).contains("evasion") | attribute_profile(base).contains("dex")


def target(df: DataFrame, budget: float) -> DataFrame:
    """``goal_mods``, and ``target_value`` and ``target_confidence`` of the item as it would be with them."""
    cost = ACTIONS["SpellSuppress1"][1] / max(ACTIONS["SpellSuppress1"][2], 0.05)
    suppress = (c("item_family") == "body_armour_defense") & suppression_eligible(c("base_type")) & (c("ilvl") >= 84) & F.lit(cost <= 0.6 * budget)
    array = lambda mods: F.array(*map(F.lit, mods))
    df = df.withColumn("goal_mods", F.when(suppress, array(SUPPRESS_GOALS)).otherwise(valuation.by_family(GOALS, array)))
    df = df.withColumn("missing_mods", F.array_except("goal_mods", "mod_tokens"))
    more = lambda side: F.size(F.array_intersect("missing_mods", array(side)))
    prefix, suffix = F.least(F.lit(3), c("prefix_count") + more(PREFIXES)), F.least(F.lit(3), c("suffix_count") + more(SUFFIXES))
    changed = {
        "mod_tokens": F.array_union("mod_tokens", "goal_mods"), "open_prefixes": F.greatest(F.lit(0), 3 - prefix), "open_suffixes": F.greatest(F.lit(0), 3 - suffix),
        "numeric": F.struct(*(F.lit(0.0).alias(n) for n in valuation.NUMERIC_WEIGHTS)), "feature_completeness": None,
    }
    kept = df.withColumn("_kept", F.struct(*(n for n in changed)))
    as_target = kept.withColumns({k: v for k, v in changed.items() if v is not None}).withColumn("feature_completeness", valuation.completeness())
    as_target = as_target.withColumns({"target_value": valuation.fallback_value(), "oracle_confidence": valuation.confidence(F.lit(False))})
    out = as_target.withColumns({n: c(f"_kept.{n}") for n in changed}).drop("_kept")
    body, many = c("item_family") == "body_armour_defense", c("comparables_count") >= 3
    sure = F.when(body, c("oracle_confidence") * 0.6 + c("confidence") * 0.25 + F.when(many, 0.08).otherwise(-0.02) - F.when(c("low_ilvl_context"), 0.05).otherwise(0.0)).otherwise(
        c("oracle_confidence") * 0.55 + c("confidence") * 0.25 + F.when(many, 0.04).otherwise(-0.03)
    )
    return out.withColumn("target_confidence", L.rounded(clamp(sure, 0.35, 0.9), 2))


def action(mod: Column, name: str, config: tuple) -> Column:
    kind, cost, chance, gain, brick = config
    return F.struct(F.lit(kind).alias("action_type"), mod.alias("target_mod"), F.lit(round(cost / max(chance, 0.05), 1) if name != "cleanup" else cost).alias("expected_cost"), F.lit(chance).alias("probability"), F.lit(gain).alias("value_delta"), F.lit(brick).alias("brick_risk"))


def steps(df: DataFrame) -> DataFrame:
    """``steps``: at most three missing goals, else the first two goals; a repair goes first for fractured or influenced items."""

    def of(mod: Column) -> Column:
        out = F.when(F.lit(False), action(mod, "", OTHER_ACTION))
        for name, config in ACTIONS.items():
            out = out.when(mod == name, action(mod, name, config))
        return out.otherwise(action(mod, "", OTHER_ACTION))

    chosen = F.when(F.size("missing_mods") > 0, F.slice("missing_mods", 1, 3)).otherwise(F.slice("goal_mods", 1, 2))
    made = F.transform(chosen, of)
    repair = F.array_contains("risk_flags", "fractured") | F.array_contains("risk_flags", "influenced")
    df = df.withColumn("steps", F.when(repair, F.concat(F.array(action(F.lit("cleanup"), "cleanup", REPAIR)), made)).otherwise(made))
    return df.withColumn("craft_cost", L.rounded(total("expected_cost"), 1))


def total(field: str) -> Column:
    return F.aggregate("steps", F.lit(0.0), lambda a, s: a + s[field])


def rebased(steps: Column, anchor: Column, sale: Column, price: Column, profit: Column) -> Column:
    """Steps (struct with value_delta and expected_cost) with the value after each: the gap from anchor to sale spread by the
    steps' shares of positive value, summed up. ``stop_here`` marks the first step whose interim profit is positive and
    reaches 60 % of the plan's. Without any positive value all steps stay at the anchor."""
    gain = lambda s: F.greatest(s["value_delta"], F.lit(0.0))
    whole = F.aggregate(steps, F.lit(0.0), lambda a, s: a + gain(s))
    gap = F.greatest(sale - anchor, F.lit(0.0))

    def add(acc: Column, s: Column) -> Column:
        done, cost = acc["done"] + gain(s), acc["cost"] + s["expected_cost"]
        after = L.rounded(anchor + F.when(whole > 0, gap * done / whole).otherwise(0.0), 1)
        interim = after - price - cost
        stop = (acc["stop"] == 0) & (interim > 0) & (interim >= profit * 0.6)
        step = F.struct(after.alias("value_after"), stop.alias("stop_here"))
        return F.struct(done.alias("done"), cost.alias("cost"), F.when(stop, F.lit(1)).otherwise(acc["stop"]).alias("stop"), F.concat(acc["out"], F.array(step)).alias("out"))

    none = F.array().cast("array<struct<value_after:double,stop_here:boolean>>")
    start = F.struct(F.lit(0.0).alias("done"), F.lit(0.0).alias("cost"), F.lit(0).alias("stop"), none.alias("out"))
    return F.aggregate(steps, start, add, lambda acc: acc["out"])


def top_plans(plans: DataFrame, order: list[Column], label: Column, k: int = 12, keep: Column | None = None) -> DataFrame:
    """The k best plans by the given order, with ``plan_rank`` and the labels of the next two as ``alternatives``. ``keep``: the rule of plans
    that may be among them. It leads the order, and what it rejects is dropped behind the top-k: the engine would move a filter before it
    below all projections that make a plan, and write them out in its condition over and over."""
    from pyspark.sql import Window as W

    if keep is None:
        best = plans.orderBy(*order).limit(k)
    else:
        best = plans.withColumn("_kept", F.coalesce(keep, F.lit(False))).orderBy(F.desc("_kept"), *order).limit(k).filter("_kept").drop("_kept")
    w = W.orderBy(*order)  # over k rows
    return best.withColumns({"plan_rank": F.row_number().over(w), "alternatives": F.array_compact(F.array(F.lead(label, 1).over(w), F.lead(label, 2).over(w)))})
