"""Operations: reports on runs, retention, file integrity, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ops_report(events: DataFrame, component: str = "component") -> DataFrame:
    """Runs, outcomes and durations per component; percentiles by nearest rank. Other statuses count as runs only."""
    ok, bad = F.col("status") == "ok", F.col("status") == "error"
    return events.groupBy(component).agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("ok_runs"), F.count_if(bad).alias("error_runs"), (F.count_if(bad) / F.count("*")).alias("error_rate"),
        F.avg("duration_ms").alias("avg_ms"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_ms)").alias("p50_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").alias("p95_ms"), F.max("ts").alias("last_ts"),
    )


def latest_record(events: DataFrame, time: str) -> DataFrame:
    """The newest record as one row."""
    return events.agg(F.max_by(F.struct(*events.columns), time).alias("r")).filter("r IS NOT NULL").select("r.*")


def expired(time: str, as_of: str, days: int) -> Column:
    return F.col(time) < F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS")


def retention_report(df: DataFrame, time: str, as_of: str, days: int, size: str | None = None, by: list[str] = ()) -> DataFrame:
    """What lies before the cutoff: rows, bytes, oldest and newest."""
    old = df.filter(expired(time, as_of, days))
    return old.groupBy(*by).agg(F.count("*").alias("rows_affected"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes") if size else F.lit(0).alias("bytes"), F.min(time).alias("oldest"), F.max(time).alias("newest"))


def apply_retention(df: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than the cutoff; rows without a time stay. A plain filter, so it prunes files and partitions."""
    return df.filter(F.coalesce(~expired(time, as_of, days), F.lit(True)))


def orphans(files: DataFrame, manifest: DataFrame, path: str = "object_path", suffix: str = ".ndjson") -> DataFrame:
    """Landing files that no manifest row names."""
    return files.filter(F.col(path).endswith(suffix)).join(manifest.select(path).distinct(), path, "left_anti")


def integrity(catalog: DataFrame, actual: DataFrame, key: str = "object_path", stored: str = "content_sha256", found: str = "actual_sha256") -> DataFrame:
    """State of each file: valid, legacy (no stored sum), mismatch, missing_file, or not_in_catalog."""
    a, b = catalog.select(key, stored, F.lit(True).alias("_listed")), actual.select(key, found, F.lit(True).alias("_there"))
    state = F.when(F.col("_listed").isNull(), "not_in_catalog").when(F.col("_there").isNull(), "missing_file").when(F.col(stored).isNull() | (F.col(stored) == ""), "legacy")
    return a.join(b, key, "full").select(key, state.when(F.col(stored) == F.col(found), "valid").otherwise("mismatch").alias("state"))


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per key over both tables: the newest by the given columns, fresh before stored on ties."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    best = F.max_by(F.struct(*(c for c in both.columns if c != "_new")), F.struct(*newest, "_new")).alias("_row")
    return both.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(best).select("_row.*")


def checkpoint_upsert(stored: DataFrame, fresh: DataFrame, key: str, counters: list[str], latest: str, order: str) -> DataFrame:
    """Counters of a checkpoint added up, its latest position kept."""
    both = stored.unionByName(fresh)
    return both.groupBy(key).agg(*(F.sum(c).alias(c) for c in counters), F.max_by(latest, order).alias(latest), F.max(order).alias(order))


def table_health(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def manifest_status(manifest: DataFrame, status: str = "status") -> DataFrame:
    """Manifest rows by status; a null or blank one is ``unknown``."""
    name = F.when(F.trim(status) != "", F.col(status)).otherwise("unknown")
    return manifest.groupBy(name.alias("status")).agg(F.count("*").alias("n"))


def active_models(registry: DataFrame, versions: DataFrame) -> DataFrame:
    """Each family's active version: ``registry`` has family and active_version, ``versions`` a row for each family and
    run_id with what is known of it."""
    return versions.join(registry.select("family", F.col("active_version").alias("run_id")), ["family", "run_id"])
