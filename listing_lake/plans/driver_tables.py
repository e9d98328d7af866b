"""Adapters: the given tables reshaped into listings, sightings and pipeline events, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-06-01 00:00:00"
TIE = ("o_key", "p_key", "s_key", "line_no", "ext_price")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One select list for both engines: plain SQL only.
LISTING_COLUMNS = """
  CAST(l_partkey AS STRING) AS item_id, l_returnflag AS league,
  CASE WHEN l_linestatus = 'O' THEN 'stash' ELSE 'trade' END AS source,
  replace(replace(replace(p_name, 'anvil', 'wand'), 'plate', 'garb'), 'gizmo', 'cluster jewel') AS base_type,
  60 + p_size % 30 AS ilvl, o_orderdate AS indexed_ts, l_shipdate AS collected_ts,
  l_extendedprice / 100.0 AS price_chaos, CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS price_step, CAST(l_suppkey AS STRING) AS seller,
  l_orderkey AS o_key, l_partkey AS p_key, l_suppkey AS s_key, l_linenumber AS line_no, l_extendedprice AS ext_price,
  l_linenumber = 5 AS corrupted, l_linenumber = 6 AS fractured, l_linenumber = 7 AS influenced, p_size AS size, l_quantity AS quantity
"""
LISTINGS = f"SELECT {LISTING_COLUMNS} FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey"

#: Mod texts by size and line, as (condition, text) in SQL that both engines read alike; the last one is implicit.
MODS = (
    ("size % 7 IN (0, 1)", "concat(CAST(size AS STRING), '% increased Spell Damage')"),
    ("size % 7 IN (1, 2)", "concat(CAST(line_no + 5 AS STRING), '% increased Cast Speed')"),
    ("size % 7 IN (1, 4)", "'30% increased Critical Strike Chance for Spells'"),
    ("size % 7 IN (2, 3, 5)", "concat('+', CAST(size + 40 AS STRING), ' to maximum Life')"),
    ("size % 7 IN (3, 5)", "concat('+', CAST(line_no * 4 AS STRING), '% to Fire Resistance')"),
    ("size % 7 = 5", "concat(CAST(line_no + 8 AS STRING), '% chance to Suppress Spell Damage')"),
    ("size % 7 = 6", "'+1 to Level of all Spell Skill Gems'"),
    ("line_no = 4", "'+20 to Strength and -5 to Chaos Resistance'"),
)
IMPLICIT = ("line_no = 1", "'+25 to maximum Mana'")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of items: lineitem with its part and order. Both dimension joins are on keys; the engine picks how."""
    lines = dealt(table(spark, sf_dir, "lineitem")).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.selectExpr(*(c.strip() for c in _split(LISTING_COLUMNS)))


def dealt(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores (a small file of one row group) dealt over all of them, as all that follows is work
    row by row. Tables of any size worth the name have the splits and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _split(columns: str) -> list[str]:
    """The top-level items of a select list."""
    out, depth, part = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with mod texts and influences."""
    mods = F.array_compact(F.array(*(F.expr(f"CASE WHEN {c} THEN {t} END") for c, t in MODS)))
    implicit = F.array_compact(F.array(F.expr(f"CASE WHEN {IMPLICIT[0]} THEN {IMPLICIT[1]} END")))
    influences = F.when(F.col("influenced"), F.array(F.lit("Shaper"))).otherwise(F.array().cast("array<string>"))
    return listings(spark, sf_dir).withColumns({"explicit_mods": mods, "implicit_mods": implicit, "influences": influences})


ITEMS = f"""SELECT *, list_filter([{", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in MODS)}], lambda m: m IS NOT NULL) AS explicit_mods,
  list_filter([CASE WHEN {IMPLICIT[0]} THEN {IMPLICIT[1]} END], lambda m: m IS NOT NULL) AS implicit_mods,
  CASE WHEN influenced THEN ['Shaper'] ELSE CAST([] AS VARCHAR[]) END AS influences FROM ({LISTINGS}) l"""
