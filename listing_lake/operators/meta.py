"""Tags of ladder builds, their scores, and an item's utility; weights of mods and chances to hit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.functions import listing as L
from listing_lake.operators.shared import per_group


def tags_of(names: DataFrame, dimension: DataFrame, name: str = "name") -> DataFrame:
    """Tags of each distinct name: an exact entry of the dimension (entry, position, tags), else the first entry in table
    order where either holds the other. Blank names have none. The dimension is a table of a few dozen entries made in code;
    names are made distinct before they meet it."""
    some = names.select(F.lower(F.trim(name)).alias("_name")).filter("_name <> ''").distinct()
    near = some.join(dimension, F.col("_name").contains(F.col("entry")) | F.col("entry").contains(F.col("_name")))
    rank = F.struct((F.col("entry") != F.col("_name")).alias("inexact"), "position")
    return near.groupBy("_name").agg(F.min_by("tags", rank).alias("tags"))


def tag_counts(builds: DataFrame, skills: DataFrame, keystones: DataFrame) -> DataFrame:
    """How often each tag occurs: skills with repeats, keystones once per build. ``builds``: skills and keystones arrays."""
    used = builds.select(F.explode("skills").alias("name")).select(F.lower(F.trim("name")).alias("_name"))
    held = builds.select(F.explode(F.array_distinct(F.transform("keystones", lambda k: F.lower(F.trim(k))))).alias("_name"))
    out = used.join(tags_of(used.withColumnRenamed("_name", "name"), skills), "_name").unionByName(held.join(tags_of(held.withColumnRenamed("_name", "name"), keystones), "_name"))
    return out.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def keystone_sets(builds: DataFrame, *fields: str, alias: str = "keystones") -> DataFrame:
    """Each build's keystones: the union of several fields, each a text or an array of texts; blanks are left out."""
    kinds = dict(builds.dtypes)
    each = (F.coalesce(F.col(f) if kinds[f].startswith("array") else F.array(f), F.array().cast("array<string>")) for f in fields)
    union = F.array_distinct(F.filter(F.concat(*each), lambda k: k.isNotNull() & (F.trim(k) != "")))
    return builds.withColumn(alias, union)


def tag_scores(counts: DataFrame) -> DataFrame:
    """Min-max of the counts, at least .1; .5 for all where they are equal."""
    ends = counts.agg(F.min("n").alias("_low"), F.max("n").alias("_high"))  # one row
    score = F.when(F.col("_high") == F.col("_low"), 0.5).otherwise(F.greatest(F.round((F.col("n") - F.col("_low")) / (F.col("_high") - F.col("_low")), 3), F.lit(0.1)))
    return counts.join(F.broadcast(ends)).select("tag", "n", score.alias("score"))


def meta_utility(items: DataFrame, scores: DataFrame, tags: str, how: str = "mean", key: str = "item_key") -> DataFrame:
    """Mean, greatest or (capped at 1) summed score of an item's scored tags; 0 where none is. Only distinct tag sets are
    exploded."""
    sets = items.select(F.array_sort(F.array_distinct(tags)).alias("_set")).distinct()
    each = sets.select("_set", F.explode("_set").alias("tag")).join(scores.filter("score > 0").select("tag", "score"), "tag")
    agg = {"mean": F.avg("score"), "max": F.max("score"), "sum": F.least(F.avg("score"), F.lit(1.0))}[how]
    found = each.groupBy("_set").agg(F.round(agg, 3).alias("meta_utility_score"))
    found = per_group(found, "tag-sets")
    out = items.withColumn("_set", F.array_sort(F.array_distinct(tags))).join(found, "_set", "left")
    return out.withColumn("meta_utility_score", F.coalesce("meta_utility_score", F.lit(0.0))).drop("_set")


def sample_builds(builds: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    """n builds by the order of a seeded MD5 of their key: the same ones in any engine and however the rows lie."""
    return builds.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(seed)).cast("binary")), key).limit(n)


def clean_mods(raw: DataFrame) -> DataFrame:
    """Mods that can be rolled: no unique or implicit generation; defaults level 1 and not essence-only."""
    out = raw.filter(~F.col("generation_type").isin("unique", "implicit"))
    return out.withColumns({"required_level": F.coalesce("required_level", F.lit(1)), "is_essence_only": F.coalesce("is_essence_only", F.lit(False))})


def weight_for(tag: Column) -> Column:
    """Spawn weight of a mod for a tag: the first entry of that tag, 0 without one."""
    hit = F.filter("spawn_weights", lambda w: w["tag"] == tag)
    return F.coalesce(F.get(hit, F.lit(0))["weight"], F.lit(0))


def mods_by_stats(mods: DataFrame, patterns: list[str], generation_type: str | None = None, tag: str | None = None) -> DataFrame:
    hit = F.exists("stats", lambda s: sum((F.lower(s).contains(p.lower()).cast("int") for p in patterns), F.lit(0)) > 0)
    out = mods.filter(hit)
    out = out.filter(F.col("generation_type") == generation_type) if generation_type else out
    return out.filter(weight_for(F.lit(tag)) > 0) if tag else out


def spawn_pool(mods: DataFrame, tag: str, generation_type: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """Total weight of the mods that can roll on a tag; a mod of several wanted groups counts once."""
    out = mods.filter(F.col("generation_type") == generation_type) if generation_type else mods
    out = out.filter(F.arrays_overlap("groups", F.array(*map(F.lit, groups)))) if groups else out
    return out.agg(F.coalesce(F.sum(weight_for(F.lit(tag))), F.lit(0)).alias("pool"))


def hit_chances(mods: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chance of each target of ``wanted`` (target, tag, generation_type, mod_id: a row for each mod of a target): the mods'
    weight over the pool's, within .01 and .99. Verified if every mod can roll; with a reason where nothing can."""
    each = mods.select("mod_id", "generation_type", F.explode("spawn_weights").alias("w")).select("mod_id", "generation_type", F.col("w.tag").alias("tag"), F.col("w.weight").alias("weight"))
    pool = each.groupBy("tag", "generation_type").agg(F.sum("weight").alias("pool"))
    targets = wanted.select("target", "tag", "mod_id").join(each.drop("generation_type"), ["mod_id", "tag"], "left")
    hits = targets.groupBy("target").agg(F.sum(F.coalesce("weight", F.lit(0))).alias("hit"), F.min(F.coalesce("weight", F.lit(0))).alias("least"))
    out = wanted.select("target", "tag", "generation_type").distinct().join(hits, "target", "left").join(pool, ["tag", "generation_type"], "left").na.fill(0, ["hit", "least", "pool"])
    none = (F.col("hit") == 0) | (F.col("pool") == 0)
    chance = F.when(none, 0.0).otherwise(F.greatest(F.lit(0.01), F.least(F.col("hit") / F.col("pool"), F.lit(0.99))))
    reason = F.when(F.col("hit") == 0, "targets_without_weight").when(F.col("pool") == 0, "empty_pool").otherwise("")
    return out.select("target", "tag", "generation_type", "hit", "pool", chance.alias("hit_probability"), F.when(none | (F.col("least") <= 0), "fallback").otherwise("verified").alias("source"), reason.alias("fallback_reason"))


def craft_values(methods: DataFrame) -> DataFrame:
    """Expected value of each (niche, method) and its rank: chance times gain, less cost, less the brick risk's share (.4) of
    the niche's base cost. The best of a niche is recommended if it gains."""
    from pyspark.sql import Window as W

    ev = L.rounded(F.col("hit_probability") * F.col("value_delta") - F.col("method_cost") - F.col("brick_risk") * F.col("niche_base_cost") * 0.4, 1)
    out = methods.withColumn("ev_net_value", ev)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("niche").orderBy(F.desc("ev_net_value"), "method")))
    return out.withColumn("recommended", (F.col("rank") == 1) & (F.col("ev_net_value") > 0))


def veiled_chance(open_prefixes: Column, open_suffixes: Column) -> Column:
    """Chance of a veiled mod to be a prefix: all of it if only prefixes are open, half if both are."""
    return F.when((open_prefixes > 0) & (open_suffixes > 0), 0.5).when(open_prefixes > 0, 1.0).otherwise(0.0)


# Chance of 1, 2 or 3 kept mods by pool size; tags that a fossil favours and blocks.
RETENTION = {1: (1.0, 0.0, 0.0), 2: (0.33, 0.66, 0.0), 3: (0.20, 0.50, 0.30), 4: (0.0, 0.3888, 0.6111), 5: (0.0, 0.20, 0.80), 6: (0.0, 0.0, 1.0)}
FOSSILS = {
    "Metallic Fossil": (("lightning",), ("physical",)), "Jagged Fossil": (("physical",), ()), "Corroded Fossil": ((), ("elemental", "fire", "cold", "lightning")),
    "Dense Fossil": (("defences",), ("life",)), "Pristine Fossil": (("life",), ("defences",)),
}


def recombine_chances(mods: DataFrame, desired: DataFrame, pair: str = "pair") -> DataFrame:
    """Chance that fusing a pair of items keeps its desired mods, half of it for the base. ``mods``: pair, kind (prefix or
    suffix), mod_id, mod_group, place (the first item's mods before the second's); ``desired``: pair, mod_id. Per side the
    pool has one mod of each group, the first; pools of none or more than six give nothing to a side that wants something."""
    first = F.struct("place", "mod_id")
    group = F.when(F.coalesce("mod_group", F.lit("")) == "", F.concat_ws("|", F.lit("own"), "mod_id", F.col("place").cast("string"))).otherwise(F.col("mod_group"))
    pool = mods.withColumn("_group", group).groupBy(pair, "kind", "_group").agg(F.min_by("mod_id", first).alias("mod_id"))
    wanted = desired.select(pair, "mod_id", F.lit(1).alias("want")).distinct()
    sides = pool.join(wanted, [pair, "mod_id"], "left").groupBy(pair, "kind").agg(F.count("*").alias("size"), F.count("want").alias("hits"))
    odds = F.when(F.lit(False), F.lit(0.0))
    for size, chances in RETENTION.items():
        kept = sum((p * F.least(F.lit((k + 1) / size) * F.col("hits"), F.lit(1.0)) for k, p in enumerate(chances) if p), F.lit(0.0))
        odds = odds.when(F.col("size") == size, kept)
    side = F.when(F.col("hits") == 0, 1.0).otherwise(odds.otherwise(0.0))
    every = sides.groupBy(pair).agg(F.product(side).alias("odds"))
    return every.select(pair, (F.col("odds") * 0.5).alias("chance"))


def mod_chances(mods: DataFrame, *, fossils: tuple[str, ...] = (), catalyst_tags: tuple[str, ...] = (), quality: int = 0, occupied: tuple[str, ...] = (), pool: str = "pool") -> DataFrame:
    """Share of each mod in its pool's weight. ``mods``: pool, mod_id, mod_group, tags, weight. Fossils block tags (weight 0)
    or favour them (ten times); a catalyst adds its quality in percent to mods of its tags; mods of occupied groups are out
    of the pool's total."""
    good = [t for f in fossils for t in FOSSILS.get(f, ((), ()))[0]]
    bad = [t for f in fossils for t in FOSSILS.get(f, ((), ()))[1]]
    has = lambda tags: F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else F.lit(False)
    weight = F.when(has(bad), 0).when(has(good), F.col("weight") * 10).otherwise(F.col("weight"))
    weight = F.floor(weight * F.when(has(list(catalyst_tags)), 1 + quality / 100).otherwise(1.0))
    free = ~F.coalesce(F.col("mod_group").isin(*occupied), F.lit(False)) if occupied else F.lit(True)
    out = mods.withColumns({"_w": weight.cast("long"), "_free": free})
    total = out.groupBy(pool).agg(F.sum(F.when(F.col("_free"), F.col("_w")).otherwise(0)).alias("_total"))
    return out.join(total, pool).select(pool, "mod_id", F.when(F.col("_total") > 0, F.col("_w") / F.col("_total")).otherwise(0.0).alias("chance"))
