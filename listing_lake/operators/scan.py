"""The scan: segments, risk flags, scores, evidence caps, consensus, and the ranked result with its funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.functions import listing as L

# Score penalties by flag, and least item level of a high ticket by family. The numbers and labels in ``market_score``,
# ``divergence``, ``divergence_penalty``, ``consensus_reason`` and the two buy filters below are fixed values too: results hang on them.
PENALTIES = {
    "price_fix_suspected": 45.0, "stale_listing": 14.0, "low_confidence": 18.0, "high_ticket_low_confidence": 18.0, "cheap_listing": 18.0,
    "corrupted": 10.0, "family_fallback": 6.0, "low_ilvl_context": 12.0, "tier_ilvl_mismatch": 20.0, "fallback_low_evidence": 15.0,
}
HIGH_TICKET_LEVEL = {"wand_caster": 75, "body_armour_defense": 78, "jewel_cluster": 80, "accessory_generic": 75, "generic": 75}

c = F.col
#: Segments become one expression; more than so many are refused.
MOST_SEGMENTS = 256


def age_hours(listed: Column, as_of: str) -> Column:
    """Hours before ``as_of``; null where the time can't be read."""
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(listed.cast("timestamp"))) / 3.6e9


def segments(listings: DataFrame, bands: DataFrame, price: str) -> DataFrame:
    """Each listing's first segment by order: item level and price within both ends, an open top where ``price_max`` is
    null. ``bands`` is a list of a few segments made in code; listings in none are dropped."""
    rows = bands.limit(MOST_SEGMENTS + 1).collect()
    if len(rows) > MOST_SEGMENTS:
        raise ValueError(f"more than {MOST_SEGMENTS} segments")
    out = F.when(F.lit(False), F.lit(0))
    for r in sorted(rows, key=lambda r: r.segment):
        top = F.lit(True) if r.price_max is None else c(price) <= r.price_max
        out = out.when(c("ilvl").between(r.ilvl_min, r.ilvl_max) & (c(price) >= r.price_min) & top, r.segment)
    return listings.withColumn("segment", out).filter(c("segment").isNotNull())


def candidate_cap(listings: DataFrame, max_items: int, order: list[str]) -> DataFrame:
    """At most min(120, max(6 * max_items, 40)) distinct items, in the given order. An item's first row is an aggregate, so its rows
    combine before they are shuffled."""
    first = F.min_by(F.struct(*listings.columns), F.struct(*order)).alias("_row")
    first = listings.groupBy(F.col("item_id").alias("_item")).agg(first).select("_row.*")
    return first.orderBy(*order).limit(min(120, max(6 * max_items, 40)))


def risk_flags(as_of: str, stale_hours: float, price: str = "listed_price", listed: str = "listed_at") -> Column:
    hours, p = age_hours(c(listed), as_of), c(price)
    stale = F.coalesce(hours > stale_hours, F.lit(False))
    low = c("ilvl") < L.lookup(L.LOW_LEVEL, c("item_family"), L.LOW_LEVEL["generic"])
    rules = (
        ("price_fix_suspected", stale & (p <= 2.0) & (p > 0) & (c("predicted_value") / p >= 8.0)), ("stale_listing", stale), ("low_confidence", c("confidence") < 0.5),
        ("high_ticket_low_confidence", (p >= 80) & (c("confidence") < 0.75)), ("cheap_listing", p < 5), ("corrupted", c("corrupted")), ("fractured", c("fractured")),
        ("influenced", F.size("influences") > 0), ("family_fallback", c("model_source") == "family_fallback"), ("low_ilvl_context", low & ~c("twink_override")),
        ("tier_ilvl_mismatch", c("tier_ilvl_mismatch")),
    )
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))


def base_scores(df: DataFrame) -> DataFrame:
    """``score``, ``trusted_profit``, ``profit`` and ``relative_discount`` from the uncapped value; zeros for no price."""
    p, v, conf, flags = c("listed_price"), c("predicted_value"), c("confidence"), c("risk_flags")
    profit = v - p
    trusted, roi, off = F.greatest(profit, F.lit(0.0)) * conf, F.greatest(profit / F.greatest(p, F.lit(1.0)), F.lit(0.0)), F.greatest(profit / F.greatest(v, F.lit(1.0)), F.lit(0.0))
    lost = F.aggregate(flags, F.lit(0.0), lambda a, f: a + L.lookup(PENALTIES, f, 0.0))
    doubt = F.when(F.array_contains(flags, "cheap_listing") & (conf >= 0.45) & (conf < 0.60), 16.0).otherwise(0.0)
    score = trusted * 0.9 + F.least(roi, F.lit(3.0)) * 16.0 + F.least(off, F.lit(0.8)) * 20.0 + conf * 25.0 - lost - doubt
    good = lambda x, n: F.when(p <= 0, 0.0).otherwise(L.rounded(x, n))
    return df.withColumns({"score": good(F.greatest(score, F.lit(0.0)), 1), "trusted_profit": good(trusted, 1), "profit": good(profit, 1), "relative_discount": good(off, 2)})


def evidence_cap(df: DataFrame) -> DataFrame:
    """A value without a model and with fewer than three comparables is held near the market; profits follow."""
    weak = (c("model_source") == "family_fallback") & (c("comparables_count") < 3)
    anchor = F.when(c("market_median") > 0, c("market_median")).when(c("market_floor") > 0, c("market_floor")).otherwise(c("listed_price"))
    cap = L.rounded(F.greatest(anchor * 1.6, c("listed_price") * 1.1, F.lit(15.0)), 1)
    cut = weak & (c("predicted_value") > F.greatest(anchor * 1.6, c("listed_price") * 1.1, F.lit(15.0)))
    out = df.withColumn("risk_flags", F.when(weak, F.array_union("risk_flags", F.array(F.lit("fallback_low_evidence")))).otherwise(c("risk_flags")))
    out = out.withColumn("ml_value", F.when(cut, cap).otherwise(c("predicted_value"))).withColumn("_cut", cut)
    profit = F.when(c("_cut"), L.rounded(c("ml_value") - c("listed_price"), 1)).otherwise(c("profit"))
    out = out.withColumn("profit", profit)
    off = L.rounded(F.greatest(c("profit") / F.greatest("ml_value", F.lit(1.0)), F.lit(0.0)), 2)
    trusted = L.rounded(F.greatest("profit", F.lit(0.0)) * c("confidence"), 1)
    return out.withColumns({"relative_discount": F.when(c("_cut"), off).otherwise(c("relative_discount")), "trusted_profit": F.when(c("_cut"), trusted).otherwise(c("trusted_profit"))}).drop("_cut")


def market_score(df: DataFrame) -> DataFrame:
    place = F.when(c("pricing_position") == "below_floor", 14.0).when(c("pricing_position") == "near_market", 4.0).otherwise(-8.0)
    gap = F.least(F.greatest(c("market_median") - c("listed_price"), F.lit(0.0)), F.lit(80.0)) * 0.08
    few = F.when(c("comparables_count") <= 1, 6.0).otherwise(0.0) + F.when(c("market_spread") > F.greatest(c("market_median") * 1.1, F.lit(30.0)), 4.0).otherwise(0.0)
    few = few + F.when(c("feature_completeness") < 0.4, 5.0).otherwise(0.0)
    return df.withColumn("score", L.rounded(F.greatest(c("score") + place + gap - few, F.lit(0.0)), 1))


def divergence() -> Column:
    """How far a little-evidenced value is from the market: ``3x``, ``2x`` or null."""
    ratio = c("ml_value") / F.greatest("market_median", F.lit(1.0))
    return F.when((c("comparables_count") < 3) & (c("market_median") > 0), F.when(ratio > 3.0, "low_evidence_ml_market_divergence_3x").when(ratio > 2.0, "low_evidence_ml_market_divergence_2x"))


def divergence_penalty(df: DataFrame) -> DataFrame:
    out = df.withColumn("_far", divergence())
    lost = F.when(c("_far").endswith("3x"), 80.0).when(c("_far").endswith("2x"), 55.0).otherwise(0.0)
    flags = F.when(c("_far").isNotNull(), F.array_union("risk_flags", F.array("_far"))).otherwise(c("risk_flags"))
    return out.withColumns({"score": F.when(c("_far").isNull(), c("score")).otherwise(L.rounded(F.greatest(c("score") - lost, F.lit(0.0)), 1)), "risk_flags": flags}).drop("_far")


def consensus_reason() -> Column:
    """The first rule that rejects, or ``ml_market_consensus_ok``."""
    outlier, free = c("pricing_position") == "outlier", ~c("twink_override")
    ticket = (c("ml_value") >= 150.0) | (c("profit") >= 80.0)
    weak = (c("model_source") == "family_fallback") & (c("comparables_count") < 3)
    market = (
        F.when(c("comparables_count") <= 1, (c("relative_discount") >= 0.25) | (c("profit") >= 20.0)).when(c("pricing_position") == "below_floor", True)
        .when(c("market_median") > 0, c("listed_price") <= c("market_median") * 0.94).when(c("market_floor") > 0, c("listed_price") <= c("market_floor")).otherwise(False)
    )
    return (
        F.when(divergence().isNotNull(), divergence()).when(c("low_ilvl_context") & free & outlier, "low_ilvl_outlier")
        .when(ticket & free & (c("low_ilvl_context") | (c("ilvl") < L.lookup(HIGH_TICKET_LEVEL, c("item_family"), HIGH_TICKET_LEVEL["generic"]))), "high_ticket_low_ilvl_without_override")
        .when(weak & outlier, "fallback_low_evidence_outlier").when(weak & (c("confidence") < 0.65), "fallback_low_evidence_low_confidence")
        .when(weak & (c("profit") < 15.0) & (c("relative_discount") < 0.18), "fallback_low_evidence_weak_value").when(weak & c("low_ilvl_context") & free, "fallback_low_evidence_low_ilvl")
        .when(~((c("profit") > 0) & (c("ml_value") > c("listed_price"))), "ml_signal_negative").when(~market, "market_signal_negative").otherwise("ml_market_consensus_ok")
    )


def open_market_reason(as_of: str, listed: str = "listed_at") -> Column:
    cheap, hours = c("listed_price") < 5.0, age_hours(c(listed), as_of)
    return (
        F.when(c("confidence") < 0.45, "filtered_open_confidence").when(cheap & (c("confidence") < 0.60), "filtered_open_cheap_low_confidence")
        .when(cheap & (c("profit") < 20.0), "filtered_open_cheap_low_profit").when(cheap & (hours > 12.0), "filtered_open_cheap_stale")
    )


def safe_buy_reason(as_of: str, listed: str = "listed_at") -> Column:
    need = F.when(c("listed_price") >= 120, 0.82).when(c("listed_price") >= 50, 0.78).otherwise(0.70)
    return F.when(c("confidence") < need, "filtered_safe_buy_confidence").when(age_hours(c(listed), as_of) > 24, "filtered_safe_buy_age").when(c("listed_price") < 5, "filtered_safe_buy_price")


def explanation() -> Column:
    """One line of text on how the value came about."""
    market = F.format_string("market floor %.1f, median %.1f over %d listings, %s", "market_floor", "market_median", "comparables_count", "pricing_position")
    value = F.format_string("valued at %.1f by %s with confidence %.2f", "ml_value", "model_source", "confidence")
    risk = F.when(F.size("risk_flags") > 0, F.concat(F.lit("risks: "), F.array_join("risk_flags", ", ")))
    return F.concat_ws("; ", value, market, risk, F.concat(F.lit("consensus: "), consensus_reason()))


def opportunities(valued: DataFrame, *, as_of: str, stale_hours: float, min_profit: float, min_price: float = 1.0) -> DataFrame:
    """All listings with scores and ``filter_reason``: the first stage that rejects, null for what passes. ``valued`` has
    predictions and comparable stats, and may have ``whisper``: rows where that is blank can't be bought. The base score uses the uncapped value; the market's part follows the cap."""
    out = valued.withColumn("risk_flags", risk_flags(as_of, stale_hours))
    out = divergence_penalty(market_score(evidence_cap(base_scores(out))))
    unoffered = F.coalesce(c("whisper"), F.lit("")) == "" if "whisper" in valued.columns else F.lit(False)
    early = (
        F.when(unoffered, "filtered_no_whisper").when(c("listed_price").isNull(), "filtered_price_unknown").when((c("ilvl") < 75) & ~c("twink_override"), "filtered_ilvl").when(c("fractured_low_ilvl_brick"), "filtered_brick")
        .when(c("listed_price") < min_price, "filtered_min_price").when(F.array_contains("risk_flags", "price_fix_suspected"), "filtered_price_fix")
    )
    agreed = consensus_reason()
    reason = F.coalesce(early, F.when(agreed != "ml_market_consensus_ok", agreed), F.when(c("profit") < min_profit, "filtered_min_profit"))
    return out.withColumn("filter_reason", reason)


def funnel(scanned: DataFrame) -> DataFrame:
    """Rows, average and greatest profit, and average score by reject reason, ``passed`` for what passes."""
    by = scanned.groupBy(F.coalesce("filter_reason", F.lit("passed")).alias("reason"))
    return by.agg(F.count("*").alias("n"), L.rounded(F.avg("profit"), 1).alias("avg_profit"), F.max("profit").alias("max_profit"), L.rounded(F.avg("score"), 1).alias("avg_score"))


def top(scanned: DataFrame, k: int, tie: list[str]) -> DataFrame:
    """The k best that pass, by score, trusted profit and profit. A top-k: each task keeps k rows."""
    return scanned.filter(c("filter_reason").isNull()).orderBy(F.desc("score"), F.desc("trusted_profit"), F.desc("profit"), *tie).limit(k)
