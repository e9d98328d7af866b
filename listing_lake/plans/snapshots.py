"""Registered queries on layers as they are written: a whole snapshot and its counts, retention of partitions, inserts by stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from listing_lake.operators import snapshot
from listing_lake.operators.shared import folder
from listing_lake.plans.driver_tables import LISTINGS, TIE, items, table
from listing_lake.sources import files
from listing_lake.streaming import intake

TIES = ", ".join(TIE)


#: Observed on the first day of the order's year, so that a snapshot has few dates.
YEAR = "date_trunc('year', indexed_ts)"


def snapshot_metrics(spark, d):
    """Bronze, silver and gold of all listings as observed rows (some repeated, some payloads bad or empty), by the counts of each layer."""
    item = F.struct(F.col("base_type").alias("baseType"), "ilvl", F.col("explicit_mods").alias("explicitMods"), F.col("implicit_mods").alias("implicitMods"), "fractured", "corrupted")
    raw = F.when(F.col("size") % 10 == 0, "{bad").when(F.col("size") % 10 == 1, "{}").otherwise(F.to_json(item))
    rows = items(spark, d).withColumns({"raw_item_json": raw, "change_id": F.concat_ws("-", *TIE), "indexed": F.expr(f"CAST({YEAR} AS STRING)"), "collected_at": F.expr(f"CAST({YEAR} + size * INTERVAL 500 SECOND AS STRING)"), "account_name": F.col("seller")})
    rows = rows.withColumn("copy", F.explode(F.when(F.col("line_no") == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = rows.select("source", "league", "item_id", "indexed", "collected_at", "price_chaos", "account_name", "change_id", "raw_item_json", "copy")
    told = snapshot.build(rows, folder(spark, "snapshot"), default_date="1999-01-01", order=["change_id", "copy"], deal=False)
    # which of two equally late rows of an item stays is by their event keys; partitions of the later layers hang on that
    return told.filter("layer = 'bronze' OR metric <> 'partitions'")


DAY = "2024-01-04"


def layer_retention(spark, d):
    """Events as a layer of days, written in two goes; old days dropped, one kind's every seventh row taken out of the rest."""
    path = folder(spark, "retention")
    events = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    for part in (0, 1):
        files.write_layer(events.filter(F.dayofmonth("ts") % 2 == part), path, ["day", "event_type"])
    files.drop_partitions(spark, path, "day", DAY)
    files.rewrite_partitions(spark, path, ~((F.col("event_type") == "click") & (F.col("event_id") % 7 == 0)))
    left = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    return left.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def stream_upsert(spark, d):
    """Events inserted by a stream, in three batches by time and once more by a replay of all of them: the first of each key stays.
    Some keys are null."""
    base = folder(spark, "upsert")
    user = F.when(F.col("user_id") % 20 != 0, F.col("user_id"))
    events = table(spark, d, "events").select("event_id", user.alias("user_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    cuts = events.agg(F.percentile_approx("ts", F.array(F.lit(0.3), F.lit(0.7))).alias("c")).first().c
    parts = (events.filter(F.col("ts") < cuts[0]), events.filter((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), events.filter(F.col("ts") >= cuts[1]))
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        intake.upsert_stream(spark.readStream.schema(events.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/log", keys, order, "first")
    intake.upsert_stream(spark.readStream.schema(events.schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/log2", keys, order, "again")
    return intake.stored(spark, f"{base}/out").select("event_id", "user_id", "event_type", "ts").withColumn("ts", F.col("ts").cast(table(spark, d, "events").schema["ts"].dataType))


_QUERIES = (snapshot_metrics, layer_retention, stream_upsert)
QUERIES = {f.__name__: f for f in _QUERIES}

_AGE = "size * 500"
_BAND = f"CASE WHEN {_AGE} <= 900 THEN 'fresh' WHEN {_AGE} <= 21600 THEN 'active' WHEN {_AGE} <= 172800 THEN 'aging' ELSE 'stale' END"
_COUNTS = {
    ("bronze", "rows_read"): "(SELECT count(*) + count(*) FILTER (line_no = 7) FROM l)", ("bronze", "invalid_json_skipped"): "(SELECT count(*) FILTER (size % 10 = 0) + count(*) FILTER (line_no = 7 AND size % 10 = 0) FROM l)",
    ("bronze", "rows_valid"): "(SELECT count(*) + count(*) FILTER (line_no = 7) FROM b)", ("bronze", "rows"): "(SELECT count(*) FROM b)", ("bronze", "rows_deduped"): "(SELECT count(*) FILTER (line_no = 7) FROM b)",
    ("bronze", "dedup_rate"): "(SELECT round((SELECT count(*) FILTER (line_no = 7) FROM b) / (count(*) + count(*) FILTER (line_no = 7)), 4) FROM l)",
    ("bronze", "partitions"): "(SELECT count(*) FROM (SELECT DISTINCT year(indexed_ts), league FROM b))",
    **{("bronze", f"source.{s}"): f"(SELECT count(*) FILTER (found = '{s}') FROM s)" for s in snapshot.SOURCES}, ("bronze", "source.other"): "0",
    **{("bronze", f"freshness_band.{s}"): f"(SELECT count(*) FILTER ({_BAND} = '{s}') FROM b)" for s in snapshot.BANDS}, ("bronze", "freshness_band.other"): "0",
    ("silver", "rows_input"): "(SELECT count(*) FROM b)", ("silver", "normalized"): "(SELECT count(*) FILTER (size % 10 <> 1) FROM b)", ("silver", "normalization_failures"): "(SELECT count(*) FILTER (size % 10 = 1) FROM b)",
    **{(layer, name): "(SELECT count(DISTINCT item_id) FILTER (size % 10 <> 1) FROM b)" for layer, name in (("silver", "rows"), ("gold", "rows_input"), ("gold", "rows"))},
}
ORACLES = {
    "snapshot_metrics": f"""WITH l AS ({LISTINGS}), b AS (SELECT * FROM l WHERE size % 10 <> 0),
      s AS (SELECT CASE WHEN count(DISTINCT source) OVER (PARTITION BY league, item_id) > 1 THEN 'both' ELSE source END AS found FROM b)
      """ + " UNION ALL ".join(f"SELECT '{layer}' AS layer, '{name}' AS metric, {sql}::DOUBLE AS value" for (layer, name), sql in _COUNTS.items()),
    "layer_retention": f"""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events
      WHERE strftime(ts, '%Y-%m-%d') >= '{DAY}' AND NOT (event_type = 'click' AND event_id % 7 = 0) GROUP BY 1, 2""",
    "stream_upsert": """SELECT event_id, u AS user_id, event_type, ts FROM (SELECT *, CASE WHEN user_id % 20 <> 0 THEN user_id END AS u,
      row_number() OVER (PARTITION BY CASE WHEN user_id % 20 <> 0 THEN user_id END, event_type ORDER BY ts, event_id) AS r FROM events) e WHERE r = 1""",
}
