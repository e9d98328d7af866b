"""Registered queries on training sets, operations, tags, crafting and intake."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from listing_lake.operators import meta, observations, training, upkeep, valuation
from listing_lake.operators.shared import folder, written
from listing_lake.plans.driver_tables import AS_OF, LISTINGS, TIE, items, listings, table
from listing_lake.streaming import intake

TIES = ", ".join(TIE)


def iqr_bounds(spark, d):
    return training.iqr_bounds(listings(spark, d), "base_type", "price_chaos").select("base_type", *(F.round(c, 8).alias(c) for c in ("q25", "q75", "low", "high")))


def remove_price_outliers(spark, d):
    out = training.remove_price_outliers(listings(spark, d).withColumn("price", F.pow("price_chaos", F.lit(3))), "base_type", "price")
    return out.groupBy("base_type").agg(F.count("*").alias("n"), F.max("price_chaos").alias("most"))


def remove_stale_cheap(spark, d):
    gold = valuation.features(valuation.normalize(items(spark, d)))
    out = training.remove_stale_cheap(gold, AS_OF, "collected_ts", "price_step")
    return out.groupBy("item_family").agg(F.count("*").alias("n"), F.min("price_step").alias("least"))


def _training_set(spark, d):
    gold = valuation.features(valuation.normalize(items(spark, d)))
    return gold.withColumn("listed_at", F.when(F.col("line_no") != 2, F.col("collected_ts")))


def quality_gates(spark, d):
    target = F.when(F.col("price_step") != 1, F.col("price_step")).alias("price_step")  # some targets are null, and some 0
    rows = _training_set(spark, d).select("item_family", "ilvl", target, "has_life", "mod_count", "league")
    return training.quality_gates(rows, "price_step")


def _split(rows, *names):
    """Rows with their part, and the columns asked for. The split and what follows read rows several times; so those columns are written once,
    and neither the joins behind the rows nor what is worked out of them is done again."""
    wanted = dict.fromkeys(("item_family", "listed_at", *TIE, *names))
    return training.temporal_split(written(rows.select(*wanted), "split-rows"), ["item_family"], "listed_at", list(TIE))


def temporal_split(spark, d):
    return _split(_training_set(spark, d)).select("item_family", "part", *TIE)


def feature_overlap(spark, d):
    names = ["item_family", "ilvl", "has_life", "mod_count", "price_step"]
    split = _split(_training_set(spark, d), *names)
    return training.feature_overlap(split.filter("part = 'train'"), split.filter("part = 'test'"), names)


def _baseline(spark, d):
    split = _split(valuation.predict(_training_set(spark, d)), "price_chaos", "predicted_value")
    base = training.median_baseline(split.filter("part = 'train'"), ["item_family"], "price_chaos")
    return split.filter("part = 'test'").join(base, "item_family")


def regression_metrics(spark, d):
    out = training.regression_metrics(_baseline(spark, d), ["item_family"], "price_chaos", "predicted_value", "baseline")
    return out.select("item_family", "n", *(F.round(c, 4).alias(c) for c in ("rmse", "mae", "baseline_rmse")))


def bucket_rmse(spark, d):
    return training.bucket_rmse(_baseline(spark, d), "price_chaos", "predicted_value").select(*(F.round(c, 4).alias(c) for c in ("rmse_low", "rmse_mid", "rmse_high")))


def family_models(spark, d, depth: int = 3, rounds: int = 5, rate: float = 0.2):
    """Boosted trees for every family and each of its level bands; groups too small to fit are rows of their own. Trees are
    fewer and smaller than the operator's default, as a check fits up to twenty models."""
    names = sorted({n for some in valuation.FAMILY_FEATURES.values() for n in some})
    split = _split(_training_set(spark, d), "ilvl_band", "price_chaos", *names)
    split = written(split.select("item_family", "ilvl_band", "part", "price_chaos", *names), "training")  # read by every fit
    told = []
    for family, names in valuation.FAMILY_FEATURES.items():
        fam = F.col("item_family") == family
        groups = [(family, fam), *((f"{family}/{band}", fam & (F.col("ilvl_band") == band)) for band in ("low", "mid", "high"))]
        models, out = training.train_models(split, groups, "price_chaos", list(names), depth=depth, rounds=rounds, rate=rate)
        if out is not None:
            told.append(out.groupBy("model", "part").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("price_chaos"), 2))), 1).alias("rmse"), F.lit("fitted").alias("state")))
        thin = [(name,) for name, model in models.items() if model is None]
        if thin:
            told.append(spark.createDataFrame(thin, "model string").select("model", F.lit(None).cast("string").alias("part"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("rmse"), F.lit("falls back to family").alias("state")))
    return reduce(lambda x, y: x.unionByName(y), told)


def family_counts(spark, d):
    return training.family_counts(_training_set(spark, d))


def drop_duplicate_gold(spark, d):
    rows = listings(spark, d).select("base_type", "ilvl", "price_step", "league", F.to_date("collected_ts").alias("snapshot_date"), "o_key", "line_no", "ext_price")
    return training.drop_duplicate_gold(rows, ["o_key", "line_no", "ext_price"]).select("base_type", "ilvl", "price_step", "o_key", "line_no", "ext_price")


def raw_training_rows(spark, d):
    """Two event tables from the listings, one without the trade columns."""
    rows = listings(spark, d)
    stash, trade = rows.filter("source = 'stash'").select("item_id", "price_step"), rows.filter("source = 'trade'").select("item_id", "price_step", "seller")
    out = training.raw_training_rows([stash, trade], "price_step")
    return out.groupBy("item_id").agg(F.count("*").alias("n"), F.count("seller").alias("sellers"), F.sum("price_step").alias("total"))


def keystones(spark, d):
    builds = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("keystone"), F.array(F.col("o_orderstatus"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, " ")).alias("tree"))
    return meta.keystone_sets(builds, "keystone", "tree").select("o_orderkey", F.array_join("keystones", ",").alias("keystones"))


def sample_builds(spark, d):
    return meta.sample_builds(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 100, "o_orderkey")


def manifest_status(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderstatus")).alias("status"))
    return upkeep.manifest_status(o)


def snapshot_dates(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    e = table(spark, d, "events").select("event_id", text.alias("indexed"), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("collected"))
    return e.select("event_id", observations.snapshot_date("1999-01-01", "indexed", "collected").alias("snapshot_date"))


def query_contexts(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "stash").otherwise("trade").alias("source"), F.col("event_type").alias("stash_name"), F.col("user_id").alias("change_id"), F.col("event_id").alias("query_id"))
    return e.select("event_id", observations.query_context(F.col("source"), ("stash_name", "change_id"), ("query_id",)).alias("context"))


def observation_union(spark, d):
    e = table(spark, d, "events")
    stash, trade = e.filter("event_id % 2 = 0").select("event_id", F.col("ts").alias("indexed"), "user_id"), e.filter("event_id % 2 = 1").select("event_id", F.col("ts").alias("indexed"))
    return observations.load_observations(stash, trade, {"user_id": 0}).select("event_id", "user_id", "indexed", "collected_at", "source", "source_rank")


def veiled_chances(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", meta.veiled_chance(F.col("p_size") % 3, F.col("p_size") % 2).alias("chance"))


def family_vectors(spark, d):
    """The wand family's feature vectors: how long they are, and their sums."""
    from pyspark.ml.functions import vector_to_array

    gold = valuation.features(valuation.normalize(items(spark, d)))
    out = valuation.feature_vector(gold, "wand_caster").select(vector_to_array("features").alias("v"))
    return out.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.round(F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)), 1).alias("total"))


def fingerprint(spark, d):
    return training.fingerprint(listings(spark, d).select("item_id", "ilvl", "price_step"))


def model_promotion(spark, d):
    c = table(spark, d, "customer")
    versions = c.select(F.col("c_mktsegment").alias("family"), F.col("c_name").alias("run_id"), (F.col("c_acctbal") % 100).alias("rmse"), F.when(F.col("c_custkey") % 7 != 0, F.lit(60.0)).alias("baseline_rmse"), F.col("c_custkey").alias("created_at"))
    return training.promotions(versions, 1.0, 5.0).groupBy("family", "status", "decision_reason").agg(F.count("*").alias("n"), F.max("run_id").alias("newest"))


def _runs(spark, d):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("user_id") % 5 == 0, "skipped").otherwise("ok")
    return table(spark, d, "events").select((F.col("user_id") % 12).alias("component"), status.alias("status"), F.col("value").alias("duration_ms"), "ts", "event_id")


def ops_report(spark, d):
    return upkeep.ops_report(_runs(spark, d)).withColumns({"error_rate": F.round("error_rate", 6), "avg_ms": F.round("avg_ms", 4)})


def latest_record(spark, d):
    return upkeep.latest_record(_runs(spark, d).filter("status = 'ok'"), "ts").select("event_id", "component", "ts")


def retention_report(spark, d):
    return upkeep.retention_report(table(spark, d, "orders"), "o_orderdate", AS_OF, 900, by=["o_orderstatus"]).select("o_orderstatus", "rows_affected", "oldest", "newest")


def apply_retention(spark, d):
    return upkeep.apply_retention(table(spark, d, "orders"), "o_orderdate", AS_OF, 900).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("oldest"))


def orphans(spark, d):
    files = table(spark, d, "orders").select(F.concat(F.lit("landing/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 9 == 0, ".tmp").otherwise(".ndjson")).alias("object_path"), "o_orderkey")
    manifest = table(spark, d, "lineitem").filter("l_linenumber < 3").select(F.concat(F.lit("landing/"), F.col("l_orderkey").cast("string"), F.lit(".ndjson")).alias("object_path"))
    return upkeep.orphans(files, manifest).select("object_path", "o_orderkey")


def integrity(spark, d):
    catalog = table(spark, d, "documents").filter("doc_id % 10 <> 3").select(F.col("doc_id").cast("string").alias("object_path"), F.when(F.col("doc_id") % 4 != 0, F.sha2(F.col("text").cast("binary"), 256)).alias("content_sha256"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    actual = table(spark, d, "documents").filter("doc_id % 10 <> 5").select(F.col("doc_id").cast("string").alias("object_path"), F.sha2(text.cast("binary"), 256).alias("actual_sha256"))
    return upkeep.integrity(catalog, actual)


def manifest_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("object_path"), F.col("o_orderdate").alias("uploaded_at"), F.col("o_orderkey").alias("id"))
    return upkeep.upsert(o.filter("id % 2 = 0"), o.filter("id % 2 = 1"), ["object_path"], ["uploaded_at", "id"])


def checkpoint_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("name"), F.lit(1).cast("long").alias("pages"), F.col("value").alias("items"), F.col("event_type").alias("change_id"), F.col("event_id").alias("at"))
    return upkeep.checkpoint_upsert(e.filter("at % 3 = 0"), e.filter("at % 3 <> 0"), "name", ["pages", "items"], "change_id", "at").withColumn("items", F.round("items", 2))


def table_health(spark, d):
    return upkeep.table_health({n: table(spark, d, n) for n in ("orders", "events", "part", "customer")})


def active_models(spark, d):
    versions = table(spark, d, "customer").select(F.col("c_mktsegment").alias("family"), F.col("c_name").alias("run_id"), F.col("c_acctbal").alias("rmse"))
    return upkeep.active_models(versions.groupBy("family").agg(F.max("run_id").alias("active_version")), versions)


SKILLS = ((0, "red", ("fire", "attack")), (1, "blue", ("cold", "spell")), (2, "ring", ("life",)), (3, "cold rod", ("cold", "caster")), (4, "od", ("rod",)))


def _tagged(spark, d):
    dimension = spark.createDataFrame([(p, e, list(t)) for p, e, t in SKILLS], "position int, entry string, tags array<string>")
    lines = listings(spark, d).groupBy("o_key").agg(F.collect_list("base_type").alias("skills"), F.collect_list(F.when(F.col("line_no") < 4, F.col("base_type"))).alias("keystones"))
    return dimension, lines


def tag_counts(spark, d):
    dimension, builds = _tagged(spark, d)
    return meta.tag_scores(meta.tag_counts(builds, dimension, dimension))


def meta_utility(spark, d):
    dimension, builds = _tagged(spark, d)
    scores = meta.tag_scores(meta.tag_counts(builds, dimension, dimension))
    tags = F.transform(F.split("base_type", " "), lambda w: F.when(w == "red", "fire").when(w == "blue", "cold").when(w == "ring", "life").otherwise(w))
    parts = listings(spark, d).select("p_key", "base_type").distinct().withColumn("tags", tags)
    return meta.meta_utility(parts, scores, "tags", key="p_key").select("p_key", "base_type", "meta_utility_score")


def _mods(spark, d):
    p = table(spark, d, "part")
    weights = F.array(F.struct(F.lower("p_type").alias("tag"), F.col("p_size").cast("int").alias("weight")), F.struct(F.lit("any").alias("tag"), (F.col("p_size") % 3).cast("int").alias("weight")))
    gen = F.when(F.col("p_partkey") % 5 == 0, "unique").when(F.col("p_partkey") % 2 == 0, "prefix").otherwise("suffix")
    mods = p.select(F.col("p_partkey").alias("mod_id"), gen.alias("generation_type"), F.array("p_brand").alias("groups"), weights.alias("spawn_weights"), F.array("p_name").alias("stats"), F.lit(None).cast("int").alias("required_level"), F.lit(None).cast("boolean").alias("is_essence_only"))
    return meta.clean_mods(mods)


def mods_by_stats(spark, d):
    return meta.mods_by_stats(_mods(spark, d), ["RING", "rod"], "prefix", "any").select("mod_id", "required_level")


def _hit_chances(spark, d, parts):
    wanted = parts.select(F.lower("p_type").alias("tag"), F.when(F.col("p_partkey") % 2 == 0, "prefix").otherwise("suffix").alias("generation_type"), F.col("p_partkey").alias("mod_id"))
    wanted = wanted.withColumn("target", F.concat_ws("-", "tag", "generation_type"))
    return meta.hit_chances(_mods(spark, d), wanted).withColumn("hit_probability", F.round("hit_probability", 6))


def hit_chances(spark, d):
    return _hit_chances(spark, d, table(spark, d, "part"))


hit_chances_whole = hit_chances


def craft_values(spark, d):
    c = table(spark, d, "customer")
    methods = c.select(F.col("c_nationkey").alias("niche"), F.col("c_name").alias("method"), ((F.col("c_custkey") % 97 + 1) / 100).alias("hit_probability"), F.lit(300.0).alias("value_delta"), F.abs(F.col("c_acctbal") / 50).alias("method_cost"), ((F.col("c_custkey") % 31) / 100).alias("brick_risk"), (F.col("c_nationkey") * 10.0).alias("niche_base_cost"))
    return meta.craft_values(methods).select("niche", "method", "rank", "recommended")


def _recombine_chances(lines):
    li = lines.select(F.col("l_orderkey").alias("pair"), F.when(F.col("l_partkey") % 2 == 0, "prefix").otherwise("suffix").alias("kind"), F.col("l_partkey").alias("mod_id"), (F.col("l_partkey") % 5).cast("string").alias("mod_group"), (F.col("l_linenumber") % 2).alias("place"))
    return meta.recombine_chances(li, li.filter("mod_id % 3 = 0").select("pair", "mod_id")).withColumn("chance", F.round("chance", 6))


def recombine_chances(spark, d):
    return _recombine_chances(table(spark, d, "lineitem"))


recombine_chances_whole = recombine_chances


def mod_chances(spark, d):
    p = table(spark, d, "part")
    tag = F.element_at(F.array(*map(F.lit, ("life", "defences", "physical", "fire"))), (F.col("p_size") % 4 + 1).cast("int"))
    mods = p.select(F.col("p_brand").alias("pool"), F.col("p_partkey").alias("mod_id"), F.col("p_type").alias("mod_group"), F.array(tag).alias("tags"), F.col("p_size").alias("weight"))
    out = meta.mod_chances(mods, fossils=("Dense Fossil",), catalyst_tags=("fire",), quality=20, occupied=("SMALL",))
    return out.withColumn("chance", F.round("chance", 8))


def hourly_counts(spark, d):
    return intake.hourly_counts(table(spark, d, "events"), "ts", ["event_type"])


def ttl_dedupe(spark, d):
    return intake.ttl_dedupe(table(spark, d, "events"), "user_id", "ts", "event_id", 3600.0).select("event_id", "user_id", "ts")


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(f"{d}/events.parquet") if _is_folder(spark, f"{d}/events.parquet") else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_insert_once(spark, d):
    """A stream over the events' file, keyed insert, run to its end."""
    base = folder(spark, "stream")
    events = intake.insert_once(_event_stream(spark, d), ["user_id", "event_type"], "ts", "400 days")
    intake.to_files(events, f"{base}/out", f"{base}/log")
    return spark.read.parquet(f"{base}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def stream_ttl_dedupe(spark, d):
    """A stream over the events' file, de-duplicated by time to live, run to its end."""
    base = folder(spark, "stream")
    events = intake.ttl_dedupe_stream(_event_stream(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3600.0, "400 days")
    intake.to_files(events, f"{base}/out", f"{base}/log")
    return spark.read.parquet(f"{base}/out").withColumn("ts", F.col("ts").cast(table(spark, d, "events").schema["ts"].dataType))


def _is_folder(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


_QUERIES = (
    iqr_bounds, remove_price_outliers, remove_stale_cheap, quality_gates, temporal_split, feature_overlap, regression_metrics, bucket_rmse, family_models, fingerprint, model_promotion, ops_report, latest_record, retention_report,
    apply_retention, orphans, integrity, manifest_upsert, checkpoint_upsert, table_health, active_models, tag_counts, meta_utility, mods_by_stats, hit_chances, craft_values, recombine_chances, mod_chances, hourly_counts, ttl_dedupe, stream_insert_once, stream_ttl_dedupe,
    family_counts, drop_duplicate_gold, raw_training_rows, keystones, sample_builds, manifest_status, snapshot_dates, query_contexts, observation_union, veiled_chances, family_vectors,
)
QUERIES = {f.__name__: f for f in _QUERIES} | {"hit_chances_whole": hit_chances_whole, "recombine_chances_whole": recombine_chances_whole}


def _oracles() -> dict[str, str]:
    from listing_lake.plans.layers import SILVER, VALUED

    tok = lambda t: f"list_contains(tokens, '{t}')::INTEGER"
    split = f"""t AS (SELECT *, CASE WHEN line_no <> 2 THEN collected_ts END AS listed_time FROM %s),
      u AS (SELECT *, row_number() OVER (PARTITION BY item_family ORDER BY listed_time, {TIES}) AS rnk, count(*) OVER (PARTITION BY item_family) AS cnt FROM t WHERE listed_time IS NOT NULL),
      s AS (SELECT *, CASE WHEN rnk <= least(greatest(floor(round(cnt * 0.8, 9)), 1), cnt - 1) THEN 'train' ELSE 'test' END AS part FROM u)"""
    scored = f"""{VALUED}, {split % "valued"}, base AS (SELECT item_family, quantile_cont(price_chaos, 0.5) AS baseline FROM s WHERE part = 'train' GROUP BY 1),
      tested AS (SELECT s.*, baseline FROM s JOIN base USING (item_family) WHERE part = 'test')"""
    runs = "SELECT user_id % 12 AS component, CASE WHEN event_type = 'error' THEN 'error' WHEN user_id % 5 = 0 THEN 'skipped' ELSE 'ok' END AS status, value AS duration_ms, ts, event_id FROM events"
    cutoff = f"o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY"
    dimension = "(VALUES " + ", ".join(f"({p}, '{e}', [{', '.join(repr(x) for x in t)}])" for p, e, t in SKILLS) + ") AS dim(position, entry, tags)"
    scores = f"""l AS ({LISTINGS}), names AS (SELECT DISTINCT base_type FROM l),
      tagged AS (SELECT base_type, arg_min(tags, (CASE WHEN entry = base_type THEN 0 ELSE 100 END) + position) AS tags FROM names JOIN {dimension} ON contains(base_type, entry) OR contains(entry, base_type) GROUP BY 1),
      used AS (SELECT base_type FROM l UNION ALL SELECT base_type FROM (SELECT DISTINCT o_key, base_type FROM l WHERE line_no < 4) k),
      counts AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM used JOIN tagged USING (base_type)) x GROUP BY 1),
      scores AS (SELECT tag, n, CASE WHEN max(n) OVER () = min(n) OVER () THEN 0.5 ELSE greatest(round((n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()), 3), 0.1) END AS score FROM counts)"""
    gen = "CASE WHEN p_partkey % 5 = 0 THEN 'unique' WHEN p_partkey % 2 = 0 THEN 'prefix' ELSE 'suffix' END"
    return {
        "iqr_bounds": f"SELECT base_type, round(a, 8) AS q25, round(b, 8) AS q75, round(a - 1.5 * (b - a), 8) AS low, round(b + 1.5 * (b - a), 8) AS high FROM (SELECT base_type, quantile_cont(price_chaos, 0.25) AS a, quantile_cont(price_chaos, 0.75) AS b FROM ({LISTINGS}) l GROUP BY 1) q",
        "remove_price_outliers": f"""WITH l AS (SELECT *, pow(price_chaos, 3) AS price FROM ({LISTINGS}) x), q AS (SELECT base_type, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM l GROUP BY 1)
          SELECT base_type, count(*) AS n, max(price_chaos) AS most FROM l JOIN q USING (base_type) WHERE price BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY 1""",
        "remove_stale_cheap": f"""{SILVER}, q AS (SELECT quantile_cont(price_step, 0.25) AS q25 FROM silver) SELECT item_family, count(*) AS n, min(price_step) AS least FROM silver, q
          WHERE NOT (coalesce((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(collected_ts)) / 3.6e9 > 48, false) AND {" + ".join(map(tok, ("Life", "Resist", "SpellDamage", "CastSpeed", "CritChanceSpells", "SpellSuppress")))} >= 2 AND price_step <= q25) GROUP BY 1""",
        "quality_gates": f"""{SILVER}, r AS (SELECT item_family, ilvl, nullif(price_step, 1) AS price_step, {tok("Life")} AS has_life, len(tokens) AS mod_count, league FROM silver)
          SELECT count(*) FILTER (price_step IS NULL) AS null_targets, count(*) FILTER (price_step <= 0) AS bad_targets, count(DISTINCT price_step) AS distinct_targets, round(stddev_pop(price_step), 4) AS target_std, count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r) x) AS exact_duplicates,
            (SELECT max(k) FROM (SELECT count(*) AS k FROM r GROUP BY item_family) f) AS largest_family, CASE WHEN count(*) FILTER (price_step IS NULL) > 0 THEN 'target_null' WHEN count(*) FILTER (price_step <= 0) > 0 THEN 'target_not_positive' WHEN (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r) x)) / count(*) > 0.2 THEN 'too_many_duplicates' END AS failed FROM r""",
        "temporal_split": f"{SILVER}, {split % 'silver'} SELECT item_family, part, {TIES} FROM s",
        "feature_overlap": f"{SILVER}, {split % 'silver'}, f AS (SELECT part, item_family, ilvl, {tok('Life')} AS has_life, len(tokens) AS mod_count, price_step FROM s) SELECT count(*) AS overlap FROM (SELECT * EXCLUDE (part) FROM f WHERE part = 'train' INTERSECT SELECT * EXCLUDE (part) FROM f WHERE part = 'test') x",
        "regression_metrics": f"{scored} SELECT item_family, count(*) AS n, round(sqrt(avg(pow(predicted_value - price_chaos, 2))), 4) AS rmse, round(avg(abs(predicted_value - price_chaos)), 4) AS mae, round(sqrt(avg(pow(baseline - price_chaos, 2))), 4) AS baseline_rmse FROM tested GROUP BY 1",
        "bucket_rmse": f"{scored} SELECT " + ", ".join(f"round(sqrt(avg(pow(predicted_value - price_chaos, 2)) FILTER ({rule})), 4) AS {name}" for name, rule in (("rmse_low", "price_chaos <= 50"), ("rmse_mid", "price_chaos > 50 AND price_chaos <= 150"), ("rmse_high", "price_chaos > 150"))) + " FROM tested",
        "model_promotion": """WITH v AS (SELECT c_mktsegment AS family, c_name AS run_id, c_acctbal % 100 AS rmse, CASE WHEN c_custkey % 7 <> 0 THEN 60.0 END AS base, c_custkey AS at FROM customer),
          r AS (SELECT *, CASE WHEN base IS NULL OR rmse IS NULL THEN 'invalid_metrics' WHEN rmse > base THEN 'rmse_above_ratio_threshold' WHEN base - rmse < 5 THEN 'abs_improvement_below_threshold' ELSE 'promotion_policy_satisfied' END AS decision_reason FROM v),
          a AS (SELECT family, max(at) AS top FROM r WHERE decision_reason = 'promotion_policy_satisfied' GROUP BY 1)
          SELECT family, CASE WHEN decision_reason <> 'promotion_policy_satisfied' THEN 'rejected' WHEN r.at = top THEN 'active' ELSE 'archived' END AS status, decision_reason, count(*) AS n, max(run_id) AS newest FROM r LEFT JOIN a USING (family) GROUP BY 1, 2, 3""".replace(" AS at ", " AS seq ").replace("max(at)", "max(seq)").replace("r.at", "r.seq"),
        "ops_report": f"""SELECT component, count(*) AS runs, count(*) FILTER (status = 'ok') AS ok_runs, count(*) FILTER (status = 'error') AS error_runs, round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate, round(avg(duration_ms), 4) AS avg_ms,
          quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms, max(ts) AS last_ts FROM ({runs}) r GROUP BY 1""",
        "latest_record": f"SELECT event_id, component, ts FROM ({runs}) r WHERE status = 'ok' ORDER BY ts DESC LIMIT 1",
        "retention_report": f"SELECT o_orderstatus, count(*) AS rows_affected, min(o_orderdate) AS oldest, max(o_orderdate) AS newest FROM orders WHERE {cutoff} GROUP BY 1",
        "apply_retention": f"SELECT o_orderpriority, count(*) AS n, min(o_orderdate) AS oldest FROM orders WHERE NOT ({cutoff}) GROUP BY 1",
        "orphans": "SELECT 'landing/' || o_orderkey || '.ndjson' AS object_path, o_orderkey FROM orders WHERE o_orderkey % 9 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 3)",
        "integrity": """SELECT doc_id::VARCHAR AS object_path, CASE WHEN doc_id % 10 = 3 THEN 'not_in_catalog' WHEN doc_id % 10 = 5 THEN 'missing_file' WHEN doc_id % 4 = 0 THEN 'legacy' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'valid' END AS state FROM documents""",
        "manifest_upsert": "SELECT o_custkey AS object_path, max(o_orderdate) AS uploaded_at, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 1",
        "checkpoint_upsert": "SELECT user_id AS name, count(*) AS pages, round(sum(value), 2) AS items, arg_max(event_type, event_id) AS change_id, max(event_id) AS at_id FROM events GROUP BY 1".replace("at_id", '"at"'),
        "table_health": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ("orders", "events", "part", "customer")),
        "active_models": "SELECT c_mktsegment AS family, max(c_name) AS run_id, arg_max(c_acctbal, c_name) AS rmse FROM customer GROUP BY 1",
        "tag_counts": f"WITH {scores} SELECT tag, n, score FROM scores",
        "meta_utility": f"""WITH {scores}, p AS (SELECT DISTINCT p_key, base_type FROM l), w AS (SELECT DISTINCT p_key, base_type, CASE x WHEN 'red' THEN 'fire' WHEN 'blue' THEN 'cold' WHEN 'ring' THEN 'life' ELSE x END AS tag FROM (SELECT p_key, base_type, unnest(string_split(base_type, ' ')) AS x FROM p) y)
          SELECT p_key, base_type, coalesce(round(avg(score) FILTER (score > 0), 3), 0.0) AS meta_utility_score FROM w LEFT JOIN scores USING (tag) GROUP BY 1, 2""",
        "mods_by_stats": f"SELECT p_partkey AS mod_id, 1 AS required_level FROM part WHERE {gen} = 'prefix' AND (contains(p_name, 'ring') OR contains(p_name, 'rod')) AND p_size % 3 > 0",
        "hit_chances": f"""WITH m AS (SELECT p_partkey AS id, {gen} AS generation_type, lower(p_type) AS tag, p_size AS weight FROM part WHERE {gen} <> 'unique'),
          pools AS (SELECT tag, generation_type, sum(weight)::BIGINT AS pool FROM m GROUP BY 1, 2),
          t AS (SELECT lower(p_type) AS tag, CASE WHEN p_partkey % 2 = 0 THEN 'prefix' ELSE 'suffix' END AS generation_type, p_partkey AS id FROM part),
          h AS (SELECT t.tag, t.generation_type, sum(coalesce(weight, 0))::BIGINT AS hit, min(coalesce(weight, 0)) AS least FROM t LEFT JOIN m ON m.id = t.id AND m.tag = t.tag GROUP BY 1, 2)
          SELECT tag || '-' || generation_type AS target, tag, generation_type, hit, coalesce(pool, 0)::BIGINT AS pool, round(CASE WHEN hit = 0 OR coalesce(pool, 0) = 0 THEN 0.0 ELSE greatest(0.01, least(hit / pool, 0.99)) END, 6) AS hit_probability,
            CASE WHEN hit = 0 OR coalesce(pool, 0) = 0 OR least <= 0 THEN 'fallback' ELSE 'verified' END AS source, CASE WHEN hit = 0 THEN 'targets_without_weight' WHEN coalesce(pool, 0) = 0 THEN 'empty_pool' ELSE '' END AS fallback_reason
          FROM h LEFT JOIN pools USING (tag, generation_type)""",
        "craft_values": """WITH e AS (SELECT c_nationkey AS niche, c_name AS method, round((c_custkey % 97 + 1) / 100 * 300.0 - abs(c_acctbal / 50) - (c_custkey % 31) / 100 * c_nationkey * 10.0 * 0.4 + 1e-9, 1) AS ev FROM customer),
          r AS (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY ev DESC, method)::INTEGER AS rank FROM e) SELECT niche, method, rank, rank = 1 AND ev > 0 AS recommended FROM r""",
        "recombine_chances": f"""WITH l AS (SELECT l_orderkey AS pair, CASE WHEN l_partkey % 2 = 0 THEN 'prefix' ELSE 'suffix' END AS kind, l_partkey AS mod_id, l_partkey % 5 AS g, l_linenumber % 2 AS place FROM lineitem),
          f AS (SELECT pair, kind, g, arg_min(mod_id, place * 1000000000 + mod_id) AS mod_id FROM l GROUP BY 1, 2, 3), z AS (SELECT pair, kind, count(*) AS n, count(*) FILTER (mod_id % 3 = 0) AS h FROM f GROUP BY 1, 2),
          o AS (SELECT pair, CASE WHEN h = 0 THEN 1.0 {" ".join(f"WHEN n = {n} THEN " + " + ".join(f"{p} * least({k + 1} / {n}.0 * h, 1.0)" for k, p in enumerate(ps) if p) for n, ps in meta.RETENTION.items())} ELSE 0.0 END AS odds FROM z)
          SELECT pair, round(product(odds::DOUBLE) * 0.5, 6) AS chance FROM o GROUP BY 1""",
        "mod_chances": """WITH w AS (SELECT p_brand AS pool, p_partkey AS mod_id, p_type = 'SMALL' AS taken, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN p_size * 10 WHEN 3 THEN floor(p_size * 1.2)::BIGINT ELSE p_size END AS w FROM part),
          t AS (SELECT pool, sum(CASE WHEN taken THEN 0 ELSE w END) AS total FROM w GROUP BY 1) SELECT pool, mod_id, round(CASE WHEN total > 0 THEN w / total ELSE 0.0 END, 8) AS chance FROM w JOIN t USING (pool)""",
        "hourly_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "ttl_dedupe": """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
          k AS (SELECT event_id, user_id, ts, r, ts AS kept, true AS keep FROM e WHERE r = 1
            UNION ALL SELECT e.event_id, e.user_id, e.ts, e.r, CASE WHEN epoch_us(e.ts) - epoch_us(k.kept) >= 3600000000 THEN e.ts ELSE k.kept END, epoch_us(e.ts) - epoch_us(k.kept) >= 3600000000 FROM k JOIN e ON e.user_id = k.user_id AND e.r = k.r + 1)
          SELECT event_id, user_id, ts FROM k WHERE keep""",
        "family_counts": f"{SILVER} SELECT item_family, count(*) AS n FROM silver GROUP BY 1",
        "drop_duplicate_gold": f"""SELECT base_type, ilvl, price_step, o_key, line_no, ext_price FROM (SELECT *, row_number() OVER (PARTITION BY base_type, ilvl, price_step ORDER BY o_key DESC, line_no DESC, ext_price DESC) AS n FROM ({LISTINGS}) l) r WHERE n = 1""",
        "raw_training_rows": f"SELECT item_id, count(*) AS n, count(*) FILTER (source = 'trade') AS sellers, sum(price_step) AS total FROM ({LISTINGS}) l WHERE price_step > 0 GROUP BY 1",
        "keystones": "SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderstatus <> o_orderpriority THEN ',' || o_orderstatus ELSE '' END AS keystones FROM orders",
        "sample_builds": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || '-7'), o_orderkey LIMIT 100",
        "manifest_status": "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1",
        "snapshot_dates": "SELECT event_id, CASE WHEN event_id % 3 <> 0 OR event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '1999-01-01' END AS snapshot_date FROM events",
        "query_contexts": """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"change_id":' || user_id || ',"stash_name":"' || event_type || '"}' ELSE '{"query_id":' || event_id || '}' END AS context FROM events""",
        "observation_union": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE 0 END AS user_id, ts AS indexed, ts AS collected_at, CASE WHEN event_id % 2 = 0 THEN 'stash' ELSE 'trade' END AS source, (event_id % 2)::INTEGER AS source_rank FROM events",
        "veiled_chances": "SELECT p_partkey, CASE WHEN p_size % 3 > 0 AND p_size % 2 > 0 THEN 0.5 WHEN p_size % 3 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS chance FROM part",
        "family_vectors": f"""{SILVER} SELECT count(*) AS n, {len(valuation.FAMILY_FEATURES["wand_caster"]) + len(valuation.NUMERIC_WEIGHTS) + 1} AS width, round(sum(ilvl + {" + ".join(map(tok, ("SpellDamage", "CastSpeed", "CritChanceSpells")))}
          + open_prefixes + open_suffixes + is_inf::INTEGER + len(tokens) + {" + ".join(valuation.NUMERIC_WEIGHTS)}), 1) AS total FROM silver WHERE item_family = 'wand_caster'""",
        "fingerprint": f"""SELECT sum(('0x' || substr(md5(length(ilvl::VARCHAR) || ':' || ilvl || length(item_id) || ':' || item_id || length(price_step::VARCHAR) || ':' || price_step), 1, 15))::BIGINT)::VARCHAR AS data_hash,
          count(*) AS row_count, sha256('ilvl:int,item_id:string,price_step:double') AS schema_hash FROM ({LISTINGS}) l""",
        "stream_insert_once": "SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY 1, 2",
    }


ORACLES = _oracles()
ORACLES["stream_ttl_dedupe"] = ORACLES["ttl_dedupe"]  # one file is one micro-batch: the stream keeps what the batch form keeps
ORACLES |= {f"{name}_whole": ORACLES[name] for name in ("hit_chances", "recombine_chances")}
