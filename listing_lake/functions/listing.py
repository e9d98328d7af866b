"""Column functions for listings: prices, times, mod texts, families and plausibility. Only mod texts leave the JVM, as Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listing_lake.functions import mods as mods_of
from listing_lake.functions.rules import GEM_LEVEL, MOD_TAGS, MOD_TOKENS, NUMBER  # noqa: F401
from listing_lake.functions.tiers import bound

# Currency spellings and their names, and fixed rates in chaos.
CURRENCY_ALIASES = {
    "chaos": "chaos", "c": "chaos", "chaosorb": "chaos", "chaosorbs": "chaos",
    "divine": "divine", "div": "divine", "divineorb": "divine", "divineorbs": "divine",
    "exalted": "exalted", "exa": "exalted", "ex": "exalted", "exalt": "exalted", "exaltedorb": "exalted",
    "alchemy": "alchemy", "alch": "alchemy", "a": "alchemy", "orbofalchemy": "alchemy",
}
FIXED_RATES = {"chaos": 1.0, "alchemy": 0.25, "exalted": 60.0, "divine": 125.0}

# Freshness bands by age in seconds.
FRESHNESS = ((900, "fresh"), (21600, "active"), (172800, "aging"))

# Price buckets of the sampler.
PRICE_BUCKETS = ((1, 15), (16, 50), (51, 150), (151, 500), (501, 5000))

# Least item level by family, for a plausible context and for high tiers; the rank up to which a tier is high.
LOW_LEVEL = {"wand_caster": 82, "body_armour_defense": 84, "jewel_cluster": 84, "accessory_generic": 82, "generic": 80}
HIGH_TIER_LEVEL = {"wand_caster": 82, "body_armour_defense": 84, "jewel_cluster": 84, "accessory_generic": 80, "generic": 78}
HIGH_TIER_RANK = 2

# Tags by words of a base type.
BASE_TAGS = ((("wand",), ("wand", "caster")), (("armour", "garb", "regalia"), ("body_armour",)), (("jewel",), ("jewel",)), (("ring", "amulet", "belt"), ("accessory",)))
# What counts as a number in a price note.
STRICT_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"


def rounded(x: Column, places: int) -> Column:
    """Half up, with a nudge so that the last bit of a sum does not decide what is half way."""
    return F.round(x + F.lit(1e-9), places)


def one_decimal(x: Column) -> Column:
    """Text of a double with one decimal, by its exact binary value, half to even, as ``printf`` has it; the JVM's own goes by the
    shortest decimal and half up. Parts below 2**-58 never decide."""
    whole = F.floor(F.abs(x))
    tenfold = F.floor((F.abs(x) - whole) * F.lit(float(1 << 58))) * 10
    tenths, rest = F.shiftright(tenfold, 58), tenfold.bitwiseAND((1 << 58) - 1)
    up = (rest > 1 << 57) | ((rest == 1 << 57) & (tenths % 2 == 1))
    n = whole * 10 + tenths + up.cast("long")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def lookup(values: dict, key: Column, default=None) -> Column:
    found = F.element_at(literal_map(values), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def any_word(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def parse_price_note(note: Column) -> Column:
    """struct<amount, currency> of a note such as ``~price 2 divine``. The amount must stand before the first token whose
    letters name a currency, and be positive; ``/`` only separates, so ``1/2 divine`` is 1. Both null otherwise."""
    low = F.lower(F.trim(note))
    tokens = F.split(F.trim(F.translate(F.regexp_replace(low, r"^~(b/o|price)", ""), "/", " ")), r"\s+")
    place = lambda array: F.array_position(array, True)

    def told(names: Column, numeric: Column, named: Column, amount: Column) -> Column:
        good = (numeric > 0) & (named > numeric) & (amount > 0) & (amount < float("inf"))
        return F.when(good, F.struct(amount.alias("amount"), F.get(names, (named - 1).cast("int")).alias("currency")))

    def read(words: Column, names: Column) -> Column:
        places = F.struct(place(F.transform(words, lambda t: t.rlike(STRICT_NUMBER))).alias("numeric"), place(F.transform(names, lambda n: n != "")).alias("named"))
        amount = lambda at: F.get(words, (at["numeric"] - 1).cast("int")).try_cast("double")
        return bound(places, lambda at: bound(amount(at), lambda x: told(names, at["numeric"], at["named"], x)))

    name = lambda t: F.coalesce(lookup(CURRENCY_ALIASES, F.regexp_replace(t, r"[^\p{L}]", "")), F.lit(""))
    return F.when(low.rlike(r"^~(b/o|price)"), bound(tokens, lambda words: bound(F.transform(words, name), lambda names: read(words, names))))


def to_chaos_fixed(amount: Column, currency: Column) -> Column:
    return F.when(amount > 0, F.round(amount * lookup(FIXED_RATES, currency), 2))


def rate_name(currency: Column) -> Column:
    """Display name under which an exchange lists a currency."""
    low = F.lower(currency)
    known = {"divine": "Divine Orb", "exalted": "Exalted Orb", "mirror": "Mirror of Kalandra", "alch": "Orb of Alchemy", "alchemy": "Orb of Alchemy"}
    return F.coalesce(lookup(known, low), F.concat(F.initcap(currency), F.lit(" Orb")))


def useful_item(frame_type: Column, chaos: Column) -> Column:
    """Rarity of a priced rare or unique item; null for all others."""
    return F.when(chaos > 0, F.when(frame_type == 2, "rare").when(frame_type == 3, "unique"))


def age_seconds(indexed: Column, collected: Column) -> Column:
    gap = (F.unix_micros(collected.cast("timestamp")) - F.unix_micros(indexed.cast("timestamp"))) / 1e6
    return F.when(gap.isNotNull(), F.round(F.greatest(gap, F.lit(0.0)), 3))


def freshness_band(age: Column) -> Column:
    out = F.when(age.isNull(), "unknown")
    for most, name in FRESHNESS:
        out = out.when(age <= most, name)
    return out.otherwise("stale")


def ilvl_band(ilvl: Column) -> Column:
    return F.when(ilvl <= 74, "low").when(ilvl <= 83, "mid").otherwise("high")


def price_bucket(price: Column) -> Column:
    """Label of the bucket that holds the price, both ends inclusive; null outside all and between two."""
    out = F.when(F.lit(False), F.lit(""))
    for low, high in PRICE_BUCKETS:
        out = out.when(price.between(low, high), f"{low}-{high}")
    return out


def mod_facts(mods: Column) -> Column:
    """What the rules read of the mods (:mod:`mods`), worked out once for a row, by batches."""
    return F.arrow_udf(mods_of.facts, mods_of.FACTS)(mods)


def mod_tokens(facts: Column) -> Column:
    """Distinct tokens of mods in first-seen order."""
    return F.array_distinct(facts["tokens"])


def twink_override(facts: Column) -> Column:
    return facts["gem"] >= 1


def base_tags(base: Column) -> Column:
    low, none = F.lower(base), F.array().cast("array<string>")
    return F.concat(*(F.when(any_word(low, words), F.array(*map(F.lit, tags))).otherwise(none) for words, tags in BASE_TAGS))


def tag_tokens(base: Column, facts: Column, influences: Column) -> Column:
    return F.array_distinct(F.concat(base_tags(base), facts["tags"], F.transform(influences, F.lower)))


def item_family(base: Column, tags: Column) -> Column:
    low = F.lower(base)
    caster = F.array_contains(tags, "wand") & F.array_contains(tags, "caster")
    return (
        F.when(low.contains("wand") | caster, "wand_caster").when(low.contains("jewel"), "jewel_cluster")
        .when(any_word(low, ("ring", "amulet", "belt")), "accessory_generic")
        .when(any_word(low, ("armour", "garb", "regalia")), "body_armour_defense").otherwise("generic")
    )


def affix_counts(n_tokens: Column, n_explicit: Column) -> Column:
    n = F.least(n_explicit, F.lit(6))
    prefix = F.least(F.lit(3), F.floor((n + 1) / 2).cast("int"))
    suffix = F.least(F.lit(3), n - prefix)
    suffix = F.when(prefix + suffix > n_tokens, F.greatest(F.lit(0), n_tokens - prefix)).otherwise(suffix)
    prefix, suffix = F.when(n > 0, prefix).otherwise(0), F.when(n > 0, suffix).otherwise(0)
    return F.struct(
        prefix.alias("prefix_count"), suffix.alias("suffix_count"),
        F.greatest(F.lit(0), 3 - prefix).alias("open_prefixes"), F.greatest(F.lit(0), 3 - suffix).alias("open_suffixes"),
    )


def low_ilvl_context(family: Column, ilvl: Column, override: Column) -> Column:
    return ~override & (ilvl < lookup(LOW_LEVEL, family, LOW_LEVEL["generic"]))


def tiered_tokens(tokens: Column, tiers: Column, family: Column, ilvl: Column) -> Column:
    """Tokens with ``_T<n>`` added for each native tier of a token that is there, ``_approx`` behind it where the item level
    is too low for so high a tier. ``tiers``: map<token, tier>."""
    bad = lambda t: (t <= HIGH_TIER_RANK) & (ilvl < lookup(HIGH_TIER_LEVEL, family, HIGH_TIER_LEVEL["generic"]))
    held = F.filter(F.array_sort(F.map_entries(tiers)), lambda e: F.array_contains(tokens, e["key"]))
    more = F.transform(held, lambda e: F.concat(e["key"], F.lit("_T"), e["value"].cast("string"), F.when(bad(e["value"]), "_approx").otherwise("")))
    return F.array_distinct(F.concat(tokens, F.coalesce(more, F.array().cast("array<string>"))))


def tier_mismatch(tiers: Column, family: Column, ilvl: Column) -> Column:
    high = F.exists(F.map_values(tiers), lambda t: t <= HIGH_TIER_RANK)
    return F.coalesce(high & (ilvl < lookup(HIGH_TIER_LEVEL, family, HIGH_TIER_LEVEL["generic"])), F.lit(False))


def trade_link(base_url: str, league: Column, query_id: Column, item_id: Column) -> Column:
    name = F.replace(F.url_encode(league), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(base_url.rstrip("/") + "/"), name, F.lit("/"), query_id, F.when(item_id != "", F.concat(F.lit("#"), item_id)).otherwise(""))
