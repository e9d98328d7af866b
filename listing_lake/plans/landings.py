"""Registered queries on files as they land: pages, metric events, manifests, rates, catalogs, exports. What they read is written from
the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from listing_lake.operators.shared import folder, written
from listing_lake.plans.driver_tables import LISTINGS, TIE, listings, table
from listing_lake.sources import files
from listing_lake.streaming import intake

TIES = ", ".join(TIE)


def _landed(spark, d):
    """Orders as pages of one stash each, as JSON lines; with bad lines and blank ones among them."""
    item = F.struct(
        F.concat_ws("-", *TIE).alias("id"), F.col("base_type").alias("baseType"), "ilvl", (F.col("line_no") % 4).alias("frameType"),
        F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("~price "), F.col("quantity").cast("int").cast("string"), F.lit(" divine"))).alias("note"),
    )
    by = listings(spark, d).groupBy("o_key").agg(F.collect_list(item).alias("items"), F.min("league").alias("league"))
    name = F.when(F.col("o_key") % 2 == 0, "~b/o 3 chaos").otherwise("plain")
    stash = F.struct(name.alias("stash"), "league", F.lit("seller").alias("accountName"), "items")
    page = F.struct(
        F.col("o_key").cast("string").alias("change_id"), F.lit("2024-01-01T00:00:00Z").alias("collected_at"), F.lit("n").alias("next_change_id"), F.lit(1).alias("stashes_count"),
        F.size("items").alias("items_count"), F.struct(F.lit("n").alias("next_change_id"), F.array(stash).alias("stashes")).alias("raw_payload"),
    )
    path = folder(spark, "landing")
    lines = by.select(F.explode(F.array(F.to_json(page), F.when(F.col("o_key") % 5 == 0, "{bad").otherwise(""))).alias("value"))
    lines.write.text(f"{path}/2024-01-01")
    return path


def landed_items(spark, d):
    """Priced rare and unique items of pages as they landed."""
    events = intake.page_events(files.read_stash_pages(spark, _landed(spark, d)))
    return events.groupBy("league", "rarity").agg(F.count("*").alias("n"), F.round(F.sum("price_chaos"), 2).alias("total"), F.countDistinct("item_id").alias("items"))


def manifest_totals(spark, d):
    """The manifest of landed files, summed up: which file holds which page is up to the writer."""
    m = files.landing_manifest(spark, _landed(spark, d))
    return m.agg(F.sum("pages").alias("pages"), F.sum("items").alias("items"), F.max("run_id").alias("run_id"), (F.countDistinct("content_sha256") == F.count_if(~F.col("is_empty")) + (F.count_if("is_empty") > 0).cast("int")).alias("distinct_files"))


def metric_log(spark, d):
    """Metric events of log files of every kind of event, bad lines and blank components left out."""
    path = folder(spark, "metrics")
    name = F.when(F.col("event_id") % 11 > 0, F.col("event_type")).otherwise(" ")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc"), name.alias("component"), F.col("user_id").cast("string").alias("run_id"), F.col("value").cast("bigint").alias("duration_ms"), F.lit("ok").alias("status")))
    line = F.when(F.col("event_id") % 13 == 0, "{bad").when(F.col("event_id") % 17 == 0, "[1]").otherwise(line)
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return files.metric_events(spark, path).groupBy("component").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("run_id").alias("last_run"))


def economy_rates(spark, d):
    """Rates from three overviews, where a later one wins."""
    p = table(spark, d, "part")
    one = p.groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").alias("chaos"))
    two = p.groupBy(F.concat(F.lit(" "), F.col("p_brand")).alias("name")).agg((F.max("p_size") - 49).alias("chaos"))
    three = p.filter("p_size % 2 = 0").groupBy(F.col("p_name").alias("name")).agg((F.min("p_size") * 10).alias("chaos")).unionByName(spark.range(1).select(F.lit(" ").alias("name"), F.lit(5).alias("chaos")))
    return files.economy_rates([one, two, three])


def latest_snapshots(spark, d):
    """The newest catalog row of a kind, of any date and of one."""
    o = table(spark, d, "orders").select(F.concat(F.lower("o_orderstatus"), F.lit("/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("/"), F.col("o_orderkey")).alias("object_path"), F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM").alias("snapshot_date"))).alias("metadata"))
    return files.latest_snapshot(o, "o").select(F.lit("any").alias("which"), "object_path").unionByName(files.latest_snapshot(o, "o", "1997-03").select(F.lit("one").alias("which"), "object_path"))


def offers(spark, d):
    """Offers with a price in chaos by a table of rates; others are left out."""
    rates = table(spark, d, "nation").select(F.expr("element_at(array('Divine Orb', 'Exalted Orb', 'Vaal Orb'), n_nationkey % 3 + 1)").alias("name"), "n_nationkey").groupBy("name").agg((F.max("n_nationkey") * 10 + 5.0).alias("chaos"))
    o = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey").cast("string")).otherwise("").alias("item_id"), F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderdate")).alias("indexed"), F.lit("L").alias("league"), (F.col("o_orderkey") % 50).cast("double").alias("amount"),
        F.expr("element_at(array('divine', 'exalted', 'vaal', 'unknown', 'chaos'), CAST(o_orderkey % 5 AS INT) + 1)").alias("currency"),
    )
    return intake.offer_events(o, rates).groupBy("currency").agg(F.count("*").alias("n"), F.sum("price_chaos").alias("total"))


def exports(spark, d):
    """Rows exported in every format and read back. They are written once before, so that no format joins them anew, and their text is
    compressed, as most of what moves is text."""
    rows = written(listings(spark, d).select(*TIE, F.array("league", "source").alias("tags"), F.struct("ilvl").alias("item")), "export-rows")
    told = None
    for fmt in ("json", "jsonl", "csv"):
        path = folder(spark, f"export-{fmt}")
        files.export(rows, path, fmt, compression="gzip")
        if fmt == "csv":
            back = spark.read.option("header", True).option("escape", '"').csv(path).select(F.col("ext_price").cast("double").alias("x"), F.from_json("tags", "array<string>").alias("tags"), F.from_json("item", "ilvl int").alias("item"))
        else:
            back = spark.read.schema("ext_price double, tags array<string>, item struct<ilvl:int>").json(path).withColumnRenamed("ext_price", "x")
        one = back.groupBy(F.lit(fmt).alias("fmt"), F.element_at("tags", 2).alias("source")).agg(F.count("*").alias("n"), F.sum("item.ilvl").alias("levels"), F.round(F.sum("x"), 2).alias("total"))
        told = one if told is None else told.unionByName(one)
    return told


_QUERIES = (landed_items, manifest_totals, metric_log, economy_rates, latest_snapshots, offers, exports)
QUERIES = {f.__name__: f for f in _QUERIES}
_CHAOS = "CASE WHEN line_no % 2 = 0 THEN floor(quantity) * 125 WHEN o_key % 2 = 0 THEN 3 END"
_EXPORT = " UNION ALL ".join(f"SELECT '{fmt}' AS fmt, source, count(*) AS n, sum(ilvl)::BIGINT AS levels, round(sum(ext_price), 2) AS total FROM ({LISTINGS}) l GROUP BY ALL" for fmt in ("json", "jsonl", "csv"))
ORACLES = {
    "landed_items": f"""WITH l AS ({LISTINGS}), g AS (SELECT *, min(league) OVER (PARTITION BY o_key) AS page_league, {_CHAOS} AS chaos FROM l)
      SELECT page_league AS league, CASE line_no % 4 WHEN 2 THEN 'rare' ELSE 'unique' END AS rarity, count(*) AS n, round(sum(chaos), 2)::DOUBLE AS total, count(DISTINCT ({TIES})) AS items FROM g WHERE line_no % 4 IN (2, 3) AND chaos > 0 GROUP BY ALL""",
    "manifest_totals": f"SELECT count(DISTINCT o_key) AS pages, count(*) AS items, '2024-01-01' AS run_id, true AS distinct_files FROM ({LISTINGS}) l",
    "metric_log": """SELECT event_type AS component, count(*) AS n, sum(trunc(value)::BIGINT)::BIGINT AS total_ms, max(user_id::VARCHAR) AS last_run FROM events
      WHERE event_id % 11 > 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 GROUP BY 1""",
    "economy_rates": """WITH a AS (SELECT p_name AS name, max(p_size) AS chaos, 0 AS r FROM part GROUP BY 1 UNION ALL SELECT p_brand, max(p_size) - 49, 1 FROM part GROUP BY 1 UNION ALL SELECT p_name, min(p_size) * 10, 2 FROM part WHERE p_size % 2 = 0 GROUP BY 1)
      SELECT name, arg_max(chaos, r)::DOUBLE AS chaos FROM a WHERE chaos > 0 GROUP BY 1""",
    "latest_snapshots": """WITH o AS (SELECT lower(o_orderstatus) || '/' || strftime(o_orderdate, '%Y%m%d') || '/' || o_orderkey AS object_path, strftime(o_orderdate, '%Y-%m') AS month FROM orders)
      SELECT 'any' AS which, max(object_path) AS object_path FROM o WHERE starts_with(object_path, 'o/') HAVING count(*) > 0 UNION ALL SELECT 'one', max(object_path) FROM o WHERE starts_with(object_path, 'o/') AND month = '1997-03' HAVING count(*) > 0""",
    "offers": """WITH r AS (SELECT n_nationkey % 3 AS k, max(n_nationkey) * 10 + 5.0 AS chaos FROM nation GROUP BY 1),
      o AS (SELECT o_orderkey % 5 AS k, (o_orderkey % 50)::DOUBLE AS amount FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 11 > 0),
      p AS (SELECT ['divine', 'exalted', 'vaal', 'unknown', 'chaos'][o.k + 1] AS currency, CASE WHEN o.k = 4 THEN amount ELSE amount * chaos END::DOUBLE AS price FROM o LEFT JOIN r ON r.k = o.k)
      SELECT currency, count(*) AS n, sum(price) AS total FROM p WHERE price > 0 GROUP BY 1""",
    "exports": _EXPORT,
}
