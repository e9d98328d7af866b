"""A snapshot of observed listings: bronze, silver and gold layers, each written once, and the counts of every layer.

Counts are observed on the frames as they are written: no layer is computed or read a second time to be counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from listing_lake.operators import observations, training, valuation
from listing_lake.sources import files

SOURCES = ("stash", "trade", "both")
BANDS = ("fresh", "active", "aging", "stale", "unknown")
KEY = ("source", "account_name", "change_id", "query_id", "item_id", "base_type", "indexed", "price_chaos", "payload")


def shares(column: str, known: tuple[str, ...]) -> list[Column]:
    """Rows of each known value of a column, and of any other."""
    named = [F.count_if(F.coalesce(F.col(column) == v, F.lit(False))).alias(f"{column}.{v}") for v in known]
    return [*named, F.count_if(~F.coalesce(F.col(column).isin(*known), F.lit(False))).alias(f"{column}.other")]


def build(observed: DataFrame, path: str, *, default_date: str, order: list[str], scores: DataFrame | None = None, deal: bool = True) -> DataFrame:
    """Write the layers of ``observed`` rows (``source``, ``league``, ``item_id``, ``indexed``, ``collected_at``, ``price_chaos``,
    ``raw_item_json``, and what else is known) under ``path``; returns metrics as rows of layer, metric and value.

    Bronze: rows with a valid payload, of equal events the last by ``order``, with what is known of each item, and whether they are its latest
    listing. Silver: the latest listing of each item. Gold: their features, equal rows once. Earlier snapshots' partitions stay. ``deal``: as
    bronze is written, rows are dealt by date and league; without it they are moved once less, and each task writes to all dates it has."""
    spark = observed.sparkSession
    read, valid, bronze_seen, silver_in, gold_out = (Observation() for _ in range(5))
    rows = observed.withColumns({c: F.lit(None).cast("string") for c in KEY if c not in observed.columns and c != "payload"})
    rows = rows.withColumn("payload", observations.canonical_json(F.col("raw_item_json")))  # parsed once; an object's begins with a brace
    good = F.coalesce(F.col("payload").startswith("{"), F.lit(False))
    # equal events have the same payload, so they have the same item; bytes of the key are half as long as its text
    inner = lambda c: F.from_json(c, "id string, indexed string")
    rows = rows.withColumns({"event_key": F.when(good, F.unhex(observations.event_key(*KEY))), "_id": valuation.text(F.col("item_id"), inner("payload")["id"])}).drop("payload")
    rows = observations.by_item(rows, F.col("_id"), F.xxhash64(*(c for c in KEY if c != "payload"))).drop("_id")
    rows = rows.observe(read, F.count("*").alias("rows_read"), F.count_if(F.col("event_key").isNull()).alias("invalid_json_skipped")).filter("event_key IS NOT NULL")
    rows = rows.observe(valid, F.count("*").alias("rows_valid"))
    seen, collected = F.try_to_timestamp("indexed"), F.try_to_timestamp("collected_at")
    offered, at = valuation.offered(rows.columns, checked=True), F.try_to_timestamp(valuation.text(F.col("indexed"), inner("raw_item_json")["indexed"]))
    bronze = observations.gathered(rows, event="event_key", order=order, offered=offered, at=at, seen=seen, collected=collected, price="price_chaos")
    bronze = bronze.withColumn("event_key", F.lower(F.hex("event_key")))
    bronze = observations.aged(bronze.withColumns({"_a": seen, "_b": collected}), "_a", "_b").drop("_a", "_b")
    bronze = bronze.withColumn("source", F.col("all_sources")).drop("all_sources").withColumn("snapshot_date", observations.snapshot_date(default_date, "indexed", "collected_at"))
    bronze = bronze.observe(bronze_seen, F.count("*").alias("rows"), *shares("source", SOURCES), *shares("freshness_band", BANDS))
    parts = {"bronze": files.write_layer(bronze, f"{path}/bronze", ["snapshot_date", "league"], deal=deal)}
    # the next layers start from what is written, so nothing above is computed again
    bronze = files.read_partitions(spark, f"{path}/bronze", parts["bronze"], textual(bronze, "snapshot_date", "league").schema)
    bronze = bronze.observe(silver_in, F.count("*").alias("rows_input"), F.count_if(valuation.offered(bronze.columns, checked=True)).alias("normalized")).filter("is_latest").drop("is_latest")
    names = [c for c in bronze.columns if c not in ("item_id", "listed_price")]
    silver = valuation.normalize(valuation.listed(bronze))
    numbers = silver.select("numeric.*").columns
    flat = silver.select("*", *(F.col(f"numeric.{c}").alias(f"numeric_{c}") for c in numbers)).drop("numeric")
    silver_rows = Observation()
    parts["silver"] = files.write_layer(flat.observe(silver_rows, F.count("*").alias("rows")), f"{path}/silver", ["snapshot_date", "league", "item_family"])
    silver = files.read_partitions(spark, f"{path}/silver", parts["silver"], textual(flat, "snapshot_date", "league", "item_family").schema).withColumn("numeric", F.struct(*(F.col(f"numeric_{c}").alias(c) for c in numbers)))
    wanted = (
        *names, "item_id", "item_family", "ilvl_band", "base_type", "ilvl", "listed_at", *valuation.FLAGS, "mod_count", "open_affixes", "open_prefixes", "open_suffixes", "is_influenced",
        *valuation.NUMERIC_WEIGHTS, "meta_utility_score",
    )
    gold = valuation.features(silver, scores).select(*dict.fromkeys(wanted))
    gold = training.drop_duplicate_gold(gold, ["event_key"]).observe(gold_out, F.count("*").alias("rows"))
    parts["gold"] = files.write_layer(gold, f"{path}/gold", ["snapshot_date", "league", "item_family"])
    told = {f"bronze.{k}": v for o in (read, valid, bronze_seen) for k, v in o.get.items()}
    told |= {f"silver.{k}": v for o in (silver_in, silver_rows) for k, v in o.get.items()} | {f"gold.{k}": v for k, v in gold_out.get.items()}
    told["bronze.rows_deduped"] = told["bronze.rows_valid"] - told["bronze.rows"]
    told["bronze.dedup_rate"] = round(told["bronze.rows_deduped"] / told["bronze.rows_read"], 4) if told["bronze.rows_read"] else 0.0
    told["silver.normalization_failures"] = told["silver.rows_input"] - told["silver.normalized"]
    told["gold.rows_input"] = told["silver.rows"]
    told |= {f"{layer}.partitions": len(found) for layer, found in parts.items()}
    rows = [(*name.split(".", 1), float(value)) for name, value in sorted(told.items())]
    return spark.createDataFrame(rows, "layer string, metric string, value double")


def textual(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})

