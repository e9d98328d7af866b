"""Prices of comparable listings. All exact, from price histograms: a hot base is a few hundred rows after the first sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listing_lake.operators.shared import across, in_shares, per_group, share_window


def position(price: Column, floor: Column, median: Column, spread: Column) -> Column:
    return (
        F.when(price <= F.greatest(F.lit(1.0), floor * 0.98), "below_floor")
        .when(price > F.greatest(median * 1.35, floor + F.greatest(spread, F.lit(10.0))), "outlier").otherwise("near_market")
    )


def stats(df: DataFrame, keys: list[str], price: str) -> DataFrame:
    """Floor, exact median, spread and count of positive prices per key."""
    return histogram_stats(histogram(df, keys, price), keys)


def histogram(df: DataFrame, keys: list[str], price: str) -> DataFrame:
    """Positive prices ``p`` of each key and their counts ``c``."""
    return df.filter(F.col(price) > 0).groupBy(*keys, F.col(price).alias("p")).agg(F.count("*").alias("c"))


def histogram_stats(hist: DataFrame, keys: list[str]) -> DataFrame:
    return hist.groupBy(*keys).agg(
        F.round(F.min("p"), 1).alias("market_floor"), F.round(F.percentile("p", 0.5, F.col("c")), 1).alias("market_median"),
        F.round(F.max("p") - F.min("p"), 1).alias("market_spread"), F.sum("c").alias("comparables_count"),
    )


def excluding_own_price(df: DataFrame, keys: list[str], price: str) -> DataFrame:
    """Per key and distinct price: stats of all positive prices of the key but that one. A price that leaves nothing is
    compared with itself, count 1.

    With c listings at a price and b below it, the k-th of the rest is the k-th of all if k <= b, else the (k + c)-th. Both
    middle ranks are put into one order with the histogram's upper ranks; the next histogram row holds the answer."""
    return histogram_without_own(histogram(df, keys, price), keys, price)


def histogram_without_own(hist: DataFrame, keys: list[str], price: str) -> DataFrame:
    """A group's prices lie in shares of bounded size (:mod:`shared`), each summed on its own; what a row needs of the rest of its
    group are sums, ends and neighbours of the shares before and behind."""
    group, asc = F.struct(*keys), W.unboundedPreceding
    rows = in_shares(hist, group, [F.col("p")], "price-histogram")
    over = {
        "before": ("before", F.sum("held")), "n": ("all", F.sum("held")), "first": ("all", F.min("low")), "last": ("all", F.max("high")),
        "behind": ("behind", F.min("low")), "below": ("before", F.max("high")),
    }
    shares = across(rows, {"held": F.sum("c"), "low": F.min("p"), "high": F.max("p")}, over)
    by = share_window()
    rows = rows.withColumns({"here": F.sum("c").over(by.rowsBetween(asc, 0)), "lead": F.lead("p").over(by), "lag": F.lag("p").over(by)})
    hist = rows.join(shares, ["_group", "_part"]).withColumns(
        {"upto": F.col("here") + F.coalesce("before", F.lit(0)), "next": F.coalesce("lead", "behind"), "prior": F.coalesce("lag", "below")}
    ).withColumns({"b": F.col("upto") - F.col("c"), "m": F.col("n") - F.col("c")})
    rank = lambda k: F.when(k <= F.col("b"), k).otherwise(k + F.col("c"))
    asked = F.explode(F.array(rank(F.floor((F.col("m") - 1) / 2) + 1), rank(F.floor(F.col("m") / 2) + 1))).alias("at")
    queries = hist.filter("m > 0").select("_group", "p", asked, F.lit(0).alias("kind"), F.lit(None).cast("double").alias("held"))
    upper = hist.select("_group", F.lit(None).cast("double").alias("p"), F.col("upto").alias("at"), F.lit(1).alias("kind"), F.col("p").cast("double").alias("held"))
    both = queries.unionByName(upper)
    both = in_shares(both.withColumnRenamed("_group", "g"), F.col("g"), [F.col("at"), F.col("kind")], "price-ranks")
    # prices rise with their upper ranks: the next one is the least that is still to come
    far = across(both, {"least": F.min("held")}, {"far": ("behind", F.min("least"))})
    both = both.withColumn("held", F.min("held").over(share_window().rowsBetween(0, W.unboundedFollowing))).filter("kind = 0")
    found = both.join(far, ["_group", "_part"]).withColumn("held", F.coalesce("held", "far"))
    middle = found.groupBy("_group", "p").agg(F.avg("held").alias("median"))
    out = hist.join(middle, ["_group", "p"], "left")
    floor, most = F.when(F.col("b") > 0, F.col("first")).otherwise(F.col("next")), F.when(F.col("upto") < F.col("n"), F.col("last")).otherwise(F.col("prior"))
    none = F.col("m") == 0
    return out.select(
        *keys, F.col("p").alias(price), F.round(F.when(none, F.col("p")).otherwise(floor), 1).alias("market_floor"),
        F.round(F.when(none, F.col("p")).otherwise(F.col("median")), 1).alias("market_median"),
        F.round(F.when(none, F.lit(0.0)).otherwise(most - floor), 1).alias("market_spread"), F.when(none, 1).otherwise(F.col("m")).cast("long").alias("comparables_count"),
    )


def with_comparables(df: DataFrame, keys: list[str], price: str) -> DataFrame:
    """Listings with their comparable stats and position. A price of 0 or less has all positive prices of its key to compare
    with, and itself where there is none. The joins are on stats, one row per key and price at most."""
    hist = histogram(df, keys, price)  # of keys and price alone; both kinds of stats share its shuffle
    own = histogram_without_own(hist, keys, price)
    names = ["market_floor", "market_median", "market_spread", "comparables_count"]
    own = own.select(*(F.col(c).alias(f"_{c}") for c in [*keys, price]), *(F.struct(*names).alias("_own"),))
    own = per_group(own, "price-own")
    every = histogram_stats(hist, keys).select(*(F.col(c).alias(f"_e_{c}") for c in keys), F.struct(*names).alias("_all"))
    every = per_group(every, "price-all")
    out = df.join(own, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, price]], "left")
    out = out.join(every, [F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in keys], "left")
    alone = {"market_floor": F.round(price, 1), "market_median": F.round(price, 1), "market_spread": F.lit(0.0), "comparables_count": F.lit(1)}
    out = out.withColumns({c: F.coalesce(f"_own.{c}", f"_all.{c}", alone[c]) for c in names})
    # with nothing to compare, the position is near the market whatever the price
    some = F.coalesce(F.col("_all.comparables_count") > F.when(F.col("_own").isNull(), 0).otherwise(F.lit(0)), F.lit(False))
    alone_now = ~some | ((F.col("_own.comparables_count") == 1) & (F.col("_own.market_floor") == F.round(price, 1)))
    place = F.when(alone_now, "near_market").otherwise(position(F.col(price), F.col("market_floor"), F.col("market_median"), F.col("market_spread")))
    return out.select(*df.columns, *names, place.alias("pricing_position"))


def market_index(df: DataFrame, price: str = "price", link_count: str = "link_count") -> DataFrame:
    """Price stats per family, base, link count and item level band; the band counts for body armours only."""
    band = F.when(F.col("ilvl") >= 84, "84plus").when(F.col("ilvl") >= 78, "78to83").otherwise("low")
    band = F.when(F.col("item_family") == "body_armour_defense", band).otherwise("any")
    return stats(df.withColumn("ilvl_index", band), ["item_family", "base_type", link_count, "ilvl_index"], price)


def with_market_index(df: DataFrame, index: DataFrame, link_count: str = "link_count") -> DataFrame:
    """Index stats at a listing's own link count and, as ``six_*``, at six links. Two equi-joins with the same small table."""
    band = F.when(F.col("ilvl") >= 84, "84plus").when(F.col("ilvl") >= 78, "78to83").otherwise("low")
    df = df.withColumn("ilvl_index", F.when(F.col("item_family") == "body_armour_defense", band).otherwise("any"))
    names = ["market_floor", "market_median", "market_spread", "comparables_count"]
    keys = ["item_family", "base_type", "ilvl_index"]
    six = index.filter(F.col(link_count) == 6).select(*keys, *(F.col(c).alias(f"six_{c}") for c in names))
    return df.join(index, [*keys, link_count], "left").join(six, keys, "left")
