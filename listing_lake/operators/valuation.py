"""Silver to gold: normalised items, features, and the value of an item without a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.functions import listing as L
from listing_lake.functions.tiers import native_tiers
from listing_lake.operators import meta, observations

# Token weights (OTHER_TOKEN for tokens unknown), base values and synergies by family, weights of numeric features; the
# tokens a family's item should have (REQUIRED), tokens behind the flags (FLAGS), and each family's features in order (FAMILY_FEATURES).
TOKEN_WEIGHTS = {
    "wand_caster": {"SpellDamage": 70.0, "CastSpeed": 55.0, "CritChanceSpells": 65.0, "Mana": 12.0},
    "body_armour_defense": {"Life": 50.0, "SpellSuppress": 60.0, "Resist": 30.0},
    "jewel_cluster": {"Life": 40.0, "SpellDamage": 50.0, "CritChanceSpells": 42.0, "Resist": 25.0},
    "accessory_generic": {"Life": 45.0, "Resist": 35.0, "Attributes": 25.0, "Mana": 15.0},
    "generic": {"Life": 30.0, "Resist": 20.0, "CritChanceSpells": 25.0, "SpellDamage": 28.0},
}
OTHER_TOKEN = 8.0
BASE_VALUE = {"wand_caster": 18.0, "body_armour_defense": 24.0, "jewel_cluster": 12.0, "accessory_generic": 15.0, "generic": 10.0}
SYNERGIES = {
    "wand_caster": ((("SpellDamage", "CastSpeed"), 220.0), (("SpellDamage", "CritChanceSpells"), 260.0), (("SpellDamage", "CastSpeed", "CritChanceSpells"), 420.0)),
    "body_armour_defense": ((("Life", "SpellSuppress"), 180.0), (("Life", "Resist"), 130.0), (("Life", "SpellSuppress", "Resist"), 340.0)),
    "jewel_cluster": ((("Life", "CritChanceSpells"), 120.0), (("SpellDamage", "CritChanceSpells"), 160.0)),
    "accessory_generic": ((("Life", "Resist"), 110.0), (("Attributes", "Resist"), 90.0)),
    "generic": ((("Life", "Resist"), 85.0),),
}
NUMERIC_WEIGHTS = {"spell_damage_pct": 0.45, "cast_speed_pct": 0.5, "spell_crit_pct": 0.22, "life_flat": 0.12, "resist_total": 0.18, "plus_all_spell_gems": 140.0}
REQUIRED = {
    "wand_caster": ("SpellDamage", "CastSpeed", "CritChanceSpells"), "body_armour_defense": ("Life", "SpellSuppress", "Resist"),
    "jewel_cluster": ("Life", "CritChanceSpells"), "accessory_generic": ("Life", "Resist", "Attributes"), "generic": ("Life", "Resist"),
}
FLAGS = {
    "has_spell_damage": "SpellDamage", "has_cast_speed": "CastSpeed", "has_spell_crit": "CritChanceSpells", "has_life": "Life", "has_suppress": "SpellSuppress",
    "has_resist": "Resist", "has_crit": "CritChanceSpells", "has_attributes": "Attributes", "has_mana": "Mana",
}
FAMILY_FEATURES = {
    "wand_caster": ("ilvl", "has_spell_damage", "has_cast_speed", "has_spell_crit", "open_affixes", "is_influenced", "mod_count"),
    "body_armour_defense": ("ilvl", "has_life", "has_suppress", "has_resist", "open_prefixes", "open_suffixes", "is_influenced"),
    "jewel_cluster": ("ilvl", "has_life", "has_crit", "has_resist", "mod_count", "open_affixes"),
    "accessory_generic": ("ilvl", "has_life", "has_resist", "has_attributes", "has_mana", "mod_count"),
    "generic": ("ilvl", "has_life", "has_resist", "has_crit", "mod_count", "open_affixes"),
}


def by_family(values: dict, of) -> Column:
    """A value by item family; the generic one for families unknown."""
    out = None
    for family, value in values.items():
        if family != "generic":
            out = (F.when if out is None else out.when)(F.col("item_family") == family, of(value))
    return out.otherwise(of(values["generic"]))


ITEM = """id string, baseType string, ilvl double, explicitMods array<string>, implicitMods array<string>, influences map<string,string>, fractured boolean, corrupted boolean,
  accountName string, indexed string"""


def text(*cs: Column) -> Column:
    """The first of the values whose text isn't empty."""
    return F.coalesce(*(F.when(c.cast("string") != "", c.cast("string")) for c in cs))


def offered(columns: list[str], checked: bool = False) -> Column:
    """Which observed rows are listings: those whose payload is an object that isn't empty, and whose ``whisper``, if they have one, isn't blank.
    ``checked``: all payloads are known to be objects, so none is parsed."""
    good = ~F.col("raw_item_json").rlike(observations.EMPTY)
    good = good if checked else observations.valid_object(F.col("raw_item_json")) & good
    return good & (F.coalesce("whisper", F.lit("")) != "") if "whisper" in columns else good


def listed(rows: DataFrame) -> DataFrame:
    """Listings of observed rows (``raw_item_json``, ``price_chaos``, and what else is known of price, seller and time): the item of the
    payload with its defaults, and the listing around it. Rows whose payload is no object or an empty one are dropped, and so
    are those whose ``whisper`` is blank, where rows have that column; without it the offer stands. The payload's native tiers
    come along."""
    there = set(rows.columns)
    own = lambda name: F.col(name) if name in there else F.lit(None)
    none, item = F.array().cast("array<string>"), lambda c: F.col(f"_item.{c}")
    tiered = rows.filter(offered(rows.columns)).withColumn("_item", F.from_json("raw_item_json", ITEM)).withColumn("_tiers", native_tiers(F.col("raw_item_json")))
    price = F.coalesce(own("price_chaos").cast("double"), F.lit(0.0))
    level = F.when(F.coalesce(item("ilvl"), F.lit(0.0)) != 0, item("ilvl")).otherwise(1).cast("int")
    given = {
        "item_id": text(own("item_id"), item("id")), "base_type": F.coalesce(item("baseType"), F.lit("Unknown Base")), "ilvl": level,
        "explicit_mods": F.coalesce(item("explicitMods"), none), "implicit_mods": F.coalesce(item("implicitMods"), none), "influences": F.coalesce(F.array_sort(F.map_keys(item("influences"))), none),
        "fractured": F.coalesce(item("fractured"), F.lit(False)), "corrupted": F.coalesce(item("corrupted"), F.lit(False)), "listed_price": L.rounded(price, 1),
        "listing_currency": F.coalesce(text(own("price_currency")), F.lit("chaos")), "listing_amount": F.coalesce(F.nullif(own("price_amount").cast("double"), F.lit(0.0)), price),
        "seller": F.coalesce(text(own("account_name"), item("accountName")), F.lit("")), "listed_at": text(own("indexed"), item("indexed")),
        "native_tiers": F.col("_tiers.tiers"), "native_tier_count": F.col("_tiers.count"),
    }
    return tiered.withColumns(given).drop("_item", "_tiers")


def normalize(items: DataFrame) -> DataFrame:
    """The silver projection: tokens, tags, family, affix counts and plausibility, row by row. ``native_tiers`` (map of
    token to best tier) is used where the input has it."""
    facts = F.col("_facts")
    out = items.withColumn("_facts", L.mod_facts(F.concat("explicit_mods", "implicit_mods")))
    out = out.withColumns({"mod_tokens": L.mod_tokens(facts), "tag_tokens": L.tag_tokens(F.col("base_type"), facts, F.col("influences")), "numeric": facts["numeric"], "twink_override": L.twink_override(facts)})
    # mods never bear the tags that decide on a family: base and influences alone give it, so sums by family read no mods
    tags = F.concat(L.base_tags(F.col("base_type")), F.transform("influences", F.lower))
    out = out.withColumn("item_family", L.item_family(F.col("base_type"), tags)).drop("_facts")
    if "native_tiers" in items.columns:
        tiers = F.col("native_tiers")
        out = out.withColumn("tier_ilvl_mismatch", L.tier_mismatch(tiers, F.col("item_family"), F.col("ilvl")))
        out = out.withColumn("mod_tokens", L.tiered_tokens(F.col("mod_tokens"), tiers, F.col("item_family"), F.col("ilvl")))
    else:
        out = out.withColumn("tier_ilvl_mismatch", F.lit(False))
    out = out.withColumn("affixes", L.affix_counts(F.size("mod_tokens"), F.size("explicit_mods")))
    low = L.low_ilvl_context(F.col("item_family"), F.col("ilvl"), F.col("twink_override"))
    some = reduce(lambda a, b: a | b, (F.col(f"numeric.{c}") > 0 for c in NUMERIC_WEIGHTS))
    native = F.coalesce(F.col("native_tier_count"), F.lit(0)) > 0 if "native_tier_count" in items.columns else F.lit(False)
    return out.select(
        *(c for c in out.columns if c != "affixes"), "affixes.*", low.alias("low_ilvl_context"), (F.col("fractured") & low).alias("fractured_low_ilvl_brick"),
        F.when(native, "native").when(some, "fallback_numeric").otherwise("none").alias("tier_source"), L.ilvl_band(F.col("ilvl")).alias("ilvl_band"),
    )


def has(token: str) -> Column:
    return F.array_contains("mod_tokens", token) | F.array_contains("mod_tokens", f"{token}1")


def influenced() -> Column:
    return F.col("fractured") | (F.size("influences") > 0)


def features(silver: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Adds the gold feature columns, all doubles. ``scores`` (tag, score) give each item the mean score of its tags; without
    them that is 0."""
    if scores is not None:
        silver = meta.meta_utility(silver.drop("meta_utility_score"), scores, "tag_tokens")
    utility = F.lit(0.0) if scores is None else F.col("meta_utility_score")
    flags = {name: has(token).cast("double") for name, token in FLAGS.items()}
    return silver.withColumns(
        flags | {"mod_count": F.size("mod_tokens").cast("double"), "open_affixes": (F.col("open_prefixes") + F.col("open_suffixes")).cast("double"), "is_influenced": influenced().cast("double"), "meta_utility_score": utility}
        | {c: F.col(f"numeric.{c}") for c in NUMERIC_WEIGHTS}
    )


def feature_vector(gold: DataFrame, family: str) -> DataFrame:
    """A family's ordered features as one vector column, null features as 0."""
    from pyspark.ml.feature import VectorAssembler

    names = [*FAMILY_FEATURES.get(family, FAMILY_FEATURES["generic"]), *NUMERIC_WEIGHTS, "meta_utility_score"]
    some = gold.filter(F.col("item_family") == family)
    some = some.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in some.columns else F.lit(0.0) for c in names})
    return VectorAssembler(inputCols=names, outputCol="features").transform(some)


TOKENS = [t for t, _ in L.MOD_TOKENS]
_BITS = {t: 1 << i for i, t in enumerate(TOKENS)} | {f"{t}1": 1 << (i + len(TOKENS)) for i, t in enumerate(TOKENS)}


def token_bits() -> Column:
    """One bit for each known token and, above those, for each one's first tier."""
    return F.aggregate("mod_tokens", F.lit(0), lambda a, t: a.bitwiseOR(L.lookup(_BITS, t, 0)))


def by_tokens(of) -> Column:
    """A value by item family and known tokens (with or without tier), from one table of all their sets."""
    families = list(BASE_VALUE)
    table = ",".join(repr(float(of(family, {t for t in TOKENS if bits & _BITS[t]}))) for family in families for bits in range(1 << len(TOKENS)))
    held = token_bits().bitwiseOR(F.shiftright(token_bits(), len(TOKENS))).bitwiseAND((1 << len(TOKENS)) - 1)
    family = by_family({f: i << len(TOKENS) for i, f in enumerate(families)}, F.lit)
    return F.get(F.split(F.lit(table), ",").cast("array<double>"), family + held)


def token_value(family: str, tokens: set[str]) -> float:
    """Weights of known tokens beyond that of unknown ones, and the best synergy."""
    weights = TOKEN_WEIGHTS[family]
    return sum(weights.get(t, OTHER_TOKEN) - OTHER_TOKEN for t in tokens) + max([0.0, *(bonus for need, bonus in SYNERGIES[family] if tokens.issuperset(need))])


def fallback_value() -> Column:
    """Value by the distinct tokens, among them each one's plain name where only its first tier is told."""
    plain = F.bit_count(F.shiftright(token_bits(), len(TOKENS)).bitwiseAND(F.bitwise_not(token_bits())))
    value = (F.size(F.array_distinct("mod_tokens")) + plain) * OTHER_TOKEN + by_tokens(token_value)
    numeric = reduce(lambda a, b: a + b, (F.col(f"numeric.{c}") * w for c, w in NUMERIC_WEIGHTS.items()))
    level = F.greatest(F.lit(0.0), F.col("ilvl") - 75.0) * 1.5
    return L.rounded(by_family(BASE_VALUE, F.lit) + value + numeric + level + (F.col("open_prefixes") + F.col("open_suffixes")) * 4.0 + F.when(influenced(), 18.0).otherwise(0.0), 1)


def completeness() -> Column:
    hits = by_tokens(lambda family, tokens: len(tokens.intersection(REQUIRED[family])) / len(REQUIRED[family]))
    return L.rounded(F.greatest(F.lit(0.2), hits), 2)


def confidence(modelled: Column) -> Column:
    c = F.when(modelled, 0.55).otherwise(0.35) + F.col("feature_completeness") * 0.25 + F.when(F.col("item_family") != "generic", 0.1).otherwise(0.0)
    c = c + F.when(influenced(), 0.05).otherwise(0.0) + F.when(F.col("ilvl") >= 84, 0.05).otherwise(0.0)
    return L.rounded(F.greatest(F.lit(0.3), F.least(F.lit(0.95), c)), 2)


def predict(silver: DataFrame, modelled: str | None = None) -> DataFrame:
    """Adds ``predicted_value``, ``confidence``, ``feature_completeness`` and ``model_source``. ``modelled``: a column with the
    family model's value, null where the family has no active model."""
    model = F.col(modelled) if modelled else F.lit(None).cast("double")
    out = silver.withColumn("feature_completeness", completeness())
    return out.withColumns(
        {
            "predicted_value": F.when(model.isNotNull(), L.rounded(F.greatest(model, F.lit(0.0)), 1)).otherwise(fallback_value()), "confidence": confidence(model.isNotNull()),
            "model_source": F.when(model.isNotNull(), "family_model").otherwise("family_fallback"),
        }
    )
