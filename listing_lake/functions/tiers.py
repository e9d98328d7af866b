"""Native tiers of an item payload: nested JSON of any shape and depth, walked in the row by column functions alone.

A payload is parsed once into a variant. A walk keeps the containers of one level and what the levels before gave; its number
of steps is that of the opening brackets, which no depth exceeds. Payloads that name no tier key aren't parsed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where tiers are looked for, the keys of a tier and of its text, and tokens by words of the text.
ROOTS = ("extended", "mods", "hashes", "explicit")
TIER_KEYS = ("tier", "tierNumber", "tier_number", "tierRank", "tier_rank", "officialTier", "official_tier", "rank", "value")
TEXT_KEYS = ("name", "id", "mod", "text", "type", "key", "hash", "explicit")
TOKENS = (
    ("SpellDamage", ("spell", "damage")), ("CastSpeed", ("cast speed",)), ("CastSpeed", ("casting speed",)), ("CritChanceSpells", ("critical", "spell")),
    ("Life", ("life",)), ("Resist", ("resist",)), ("SpellSuppress", ("suppress",)),
)
#: A number that stands alone or right behind one of three letters or the word, and isn't the beginning of a longer word.
NUMBERED = r"(?iU)(?<!\w)(?:tier)?[pst]?([0-9]+)(?!\w)"
MOST_STEPS = 1000
FOUND = "array<struct<text:string,rank:int>>"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once: inside lambdas an expression is evaluated wherever it stands."""
    return F.transform(F.array(value), use)[0]


def rank_of(value: Column) -> Column:
    """A positive tier from a number or from text such as ``T1``; null for anything else."""

    def read(kind: Column) -> Column:
        text = F.regexp_extract(F.try_variant_get(value, "$", "string"), NUMBERED, 1)
        number = F.when(kind == "STRING", F.when(text != "", text).try_cast("double"))
        return number.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(value, "$", "double"))

    return bound(bound(F.schema_of_variant(value), read), lambda n: F.when((n >= 1) & (n < 2**31), F.floor(n).cast("int")))


def tiered(entry: Column) -> Column:
    """An object's text and tier, in an array; empty where it has no tier. ``entry``: its fields as a map."""
    ranks = (bound(F.try_element_at(entry, F.lit(k)), lambda v: F.when(v.isNotNull(), rank_of(v))) for k in TIER_KEYS)
    words = (F.coalesce(F.try_variant_get(F.try_element_at(entry, F.lit(k)), "$", "string"), F.lit("")) for k in TEXT_KEYS)
    one = lambda rank: F.when(rank.isNotNull(), F.array(F.struct(F.lower(F.concat_ws(" ", *words)).alias("text"), rank.alias("rank"))))
    some = F.arrays_overlap(F.map_keys(entry), F.array(*map(F.lit, TIER_KEYS)))
    return F.coalesce(F.when(some, bound(F.coalesce(*ranks), one)), F.array().cast(FOUND))


def looked_into(value: Column) -> Column:
    """The values of an object or an array, or none, and its tier if it is an object that has one."""
    of = lambda entry: F.struct(F.coalesce(F.map_values(entry), F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>")).alias("inside"), tiered(entry).alias("found"))
    return bound(F.try_variant_get(value, "$", "map<string,variant>"), of)


def all_tiered(payload: Column) -> Column:
    """Text and tier of every object with a tier, however deep."""
    none = F.array().cast("array<variant>")
    roots = bound(F.try_parse_json(payload), lambda doc: F.filter(F.array(*(F.try_variant_get(doc, f"$.{k}", "variant") for k in ROOTS)), lambda v: v.isNotNull()))
    start = F.struct(F.coalesce(roots, none).alias("level"), F.array().cast(FOUND).alias("found"))
    steps = F.least(F.length(F.regexp_replace(payload, r"[^\[{]", "")), F.lit(MOST_STEPS))  # the parser reads no deeper

    def step(acc: Column, _: Column) -> Column:
        on = lambda each: F.struct(F.flatten(each["inside"]).alias("level"), F.concat(acc["found"], F.flatten(each["found"])).alias("found"))
        return F.when(F.size(acc["level"]) > 0, bound(F.transform(acc["level"], looked_into), on)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), steps), start, step, lambda acc: acc["found"])


def native_tiers(payload: Column) -> Column:
    """struct<tiers map<string,int>, count int> of a payload: the best tier of each token, and how many objects have a tier.
    Null, bad and deeper JSON than the parser reads (a thousand levels) has none."""
    hit = F.coalesce(payload.rlike('"(' + "|".join(TIER_KEYS) + ')"'), F.lit(False))
    found = F.coalesce(F.when(hit, all_tiered(payload)), F.array().cast(FOUND))

    def best(token: str, every: Column) -> Column:
        ways = [words for name, words in TOKENS if name == token]
        named = lambda x: reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (x["text"].contains(w) for w in words)) for words in ways))
        return F.struct(F.lit(token).alias("key"), F.array_min(F.transform(F.filter(every, named), lambda x: x["rank"])).alias("value"))

    def told(every: Column) -> Column:
        entries = F.filter(F.array(*(best(t, every) for t in dict(TOKENS))), lambda e: e["value"].isNotNull())
        return F.struct(F.map_from_entries(entries).alias("tiers"), F.size(every).alias("count"))

    return F.transform(F.array(found), told)[0]  # so that the walk is done once
