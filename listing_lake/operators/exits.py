"""What a crafted item may sell for, how far to trust its plan, and the gates a plan has to pass: projections, and one equi-join
with the market index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.functions import listing as L
from listing_lake.operators import comparables
from listing_lake.operators.shared import per_group
from listing_lake.operators.planner import clamp, suppression_eligible, total

# Support of a profit and start of the exit confidence by strength of evidence; weights of the three confidences.
# The numbers and labels of ``candidate``, ``plan_confidence`` and ``plan_gates`` are fixed values too.
SUPPORT = {"strong": 0.85, "moderate": 0.68, "weak": 0.45}
EVIDENCE = {"strong": 0.82, "moderate": 0.66, "weak": 0.44}
WEIGHTS, MOST = (0.3, 0.3, 0.4), 0.92
SIX_LINK_COST = 1200.0

c = F.col


def linked(df: DataFrame, price: str = "listed_price", link_count: str = "link_count") -> DataFrame:
    """Adds the market index at a listing's own link count (``own_*``) and at six (``six_*``)."""
    index = per_group(comparables.market_index(df, price, link_count), "market-index")
    names = ["market_floor", "market_median", "market_spread", "comparables_count"]
    keys = ["item_family", "base_type", "ilvl_index"]
    band = F.when(c("ilvl") >= 84, "84plus").when(c("ilvl") >= 78, "78to83").otherwise("low")
    df = df.withColumn("ilvl_index", F.when(c("item_family") == "body_armour_defense", band).otherwise("any"))
    own = index.select(*keys, link_count, *(c(n).alias(f"own_{n}") for n in names))
    six = index.filter(c(link_count) == 6).select(*keys, *(c(n).alias(f"six_{n}") for n in names))
    return df.join(own, [*keys, link_count], "left").join(six, keys, "left")


def position(sale: Column, floor: Column, median: Column, spread: Column) -> Column:
    return (
        F.when((floor <= 0) & (median <= 0), "near_market").when(sale <= F.greatest(floor * 1.05, floor + 5), "below_floor")
        .when((median > 0) & (sale > F.greatest(median * 1.18, floor + F.greatest(spread, F.lit(15.0)))), "outlier").otherwise("near_market")
    )


def candidate(floor: Column, median: Column, spread: Column, n: Column, links: Column, link_cost: float) -> Column:
    """An exit as a struct: a blend of median, floor and oracle value by the evidence, held near the market. Null where there is
    no market at all."""
    oracle = c("target_value")
    sale = F.when((n >= 3) & (median > 0), median * 0.6 + oracle * 0.4).when(
        (n >= 1) & (median > 0), floor * 0.25 + median * 0.4 + F.least(oracle, median * 1.1) * 0.35
    ).otherwise(floor * 0.55 + F.least(oracle, F.greatest(floor * 1.15, floor + 10)) * 0.45)
    held = F.greatest(F.least(sale, F.greatest(median * 1.1, floor + F.greatest(spread * 0.35, F.lit(10.0)))), floor)
    sale = F.when(median > 0, held).otherwise(sale)
    strength = F.when(n >= 3, "strong").when(n >= 2, "moderate").otherwise("weak")
    profit = L.rounded(sale, 1) - c("listed_price") - c("craft_cost") - link_cost
    supported = profit * L.lookup(SUPPORT, strength) * F.greatest(c("oracle_confidence"), F.lit(0.25))
    told = F.struct(
        supported.alias("supported"), L.rounded(sale, 1).alias("sale"), floor.alias("floor"), median.alias("median"), n.cast("long").alias("n"),
        position(sale, floor, median, spread).alias("position"), strength.alias("strength"), links.cast("int").alias("links"), F.lit(link_cost).alias("link_cost"),
    )
    return F.when((floor > 0) | (median > 0), told)


def exit_estimates(df: DataFrame, budget: float, six_link_cost: float = SIX_LINK_COST) -> DataFrame:
    """Adds ``exit``: the better supported of selling at the item's own link count and, for body armours within the budget, at
    six links. ``df``: scanned listings with target, steps and the market index."""
    floor, median, spread, n = (c(x) for x in ("market_floor", "market_median", "market_spread", "comparables_count"))
    both, one = (floor > 0) & (median > 0), F.greatest(floor, median)
    own = {  # without listings in the index, the listing's own floor and median stand for them
        "floor": F.coalesce("own_market_floor", F.when(both, F.least(floor, median)).otherwise(one)), "median": F.coalesce("own_market_median", F.when(both, L.rounded((floor + median) / 2, 1)).otherwise(one)),
        "spread": F.coalesce("own_market_spread", F.when(both, L.rounded(F.abs(median - floor), 1)).otherwise(0.0)), "n": F.coalesce("own_comparables_count", (floor > 0).cast("long") + (median > 0).cast("long")),
    }
    at_own = candidate(F.greatest(own["floor"], floor), F.greatest(own["median"], median), F.greatest(own["spread"], spread), F.greatest(own["n"], n), c("link_count"), 0.0)
    may = (c("item_family") == "body_armour_defense") & (c("link_count") < 6) & (c("six_comparables_count") > 0) & F.lit(six_link_cost <= budget)
    at_six = F.when(may, candidate(c("six_market_floor"), c("six_market_median"), c("six_market_spread"), c("six_comparables_count"), F.lit(6), six_link_cost))
    df = df.withColumns({"_own": at_own, "_six": at_six})
    better = c("_six").isNotNull() & (c("_own").isNull() | (c("_six.supported") > c("_own.supported")))
    df = df.withColumn("exit", F.when(better, c("_six")).otherwise(c("_own"))).drop("_own", "_six")
    cost = L.rounded(c("craft_cost") + c("exit.link_cost"), 1)
    return df.withColumns({"plan_cost": cost, "expected_profit": L.rounded(c("exit.sale") - c("listed_price") - cost, 1)})


def plan_confidence(df: DataFrame, budget: float) -> DataFrame:
    """Adds ``base_confidence``, ``craft_confidence``, ``exit_confidence`` and ``plan_confidence``, and ``trusted_profit_of_plan``. An exit
    value of the fallback (``model_source``) is trusted less than a model's."""
    linking = c("exit.link_cost") > 0
    odd = c("low_ilvl_context") & ~c("twink_override")
    base = c("confidence") * 0.55 + c("target_confidence") * 0.2 + F.when(c("pricing_position") == "below_floor", 0.15).otherwise(0.0)
    base = clamp(base + F.when(c("comparables_count") >= 3, 0.08).otherwise(-0.05) - F.when(odd, 0.1).otherwise(0.0), 0.2, 0.95)
    more = linking.cast("int")
    craft = (total("probability") + more) / F.greatest(F.size("steps") + more, F.lit(1)) - (total("brick_risk") + more * 0.05) * 0.08
    craft = clamp(craft - F.when(linking & (c("exit.link_cost") > budget * 0.75), 0.12).otherwise(0.0), 0.0, 0.9)
    end = L.lookup(EVIDENCE, c("exit.strength")) + c("oracle_confidence") * 0.18 - F.when(c("exit.n") < 2, 0.12).otherwise(0.0)
    end = end - F.when(c("model_source") == "family_fallback", 0.08).otherwise(0.0)
    end = clamp(end - F.when(c("exit.position") == "outlier", 0.12).otherwise(0.0) - F.when(linking, 0.08).otherwise(0.0), 0.0, 0.9)
    whole = clamp(base * WEIGHTS[0] + craft * WEIGHTS[1] + end * WEIGHTS[2], 0.0, MOST)
    named = {"base_confidence": base, "craft_confidence": craft, "exit_confidence": end, "plan_confidence": whole}
    df = df.withColumns({k: L.rounded(v, 2) for k, v in named.items()})
    return df.withColumn("trusted_profit_of_plan", L.rounded(c("expected_profit") * c("plan_confidence"), 1))


def plan_gates(df: DataFrame, budget: float, six_link_cost: float = SIX_LINK_COST) -> DataFrame:
    """Adds ``plan_reasons``: what speaks against a plan, in order; empty for plans to keep."""
    body, linking = c("item_family") == "body_armour_defense", c("exit.link_cost") > 0
    no_suppress = F.array_contains("goal_mods", "SpellSuppress1") & ~suppression_eligible(c("base_type"))
    rules = (
        (c("profit") <= 0, "base_not_discounted"), (body & c("low_ilvl_context") & ~c("twink_override"), "body_armour_low_ilvl"),
        (body & no_suppress, "suppression_base_ineligible"), (body & (c("comparables_count") <= 0) & (c("market_floor") <= 0), "body_armour_low_liquidity"),
        (body & (c("link_count") <= 0) & (c("comparables_count") < 2), "linkless_low_evidence"),
        (body & (c("link_count") < 6) & F.lit(six_link_cost > budget) & (c("market_median") <= c("listed_price")), "insufficient_budget_for_linking"),
        (c("exit").isNull(), "no_exit"), (c("plan_cost") > budget, "over_budget"), (c("expected_profit") <= 0, "non_profitable_plan"),
        (c("craft_confidence") <= 0, "craft_ineligible"), (c("plan_confidence") < 0.45, "confidence_too_low"),
        ((c("model_source") == "family_fallback") & (c("exit.n") < 2) & ~(linking & (c("exit.floor") > 0)), "fallback_exit_low_evidence"), ((c("exit.position") == "outlier") & (c("exit.n") < 3), "exit_outlier_low_evidence"),
    )
    return df.withColumn("plan_reasons", F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules))))
