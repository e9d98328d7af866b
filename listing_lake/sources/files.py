"""Readers and writers of landing files, layers, exports and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listing_lake.operators import valuation
from listing_lake.operators.shared import written
from listing_lake.streaming.intake import PAGE


def read_stash_pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One row per page of NDJSON landing files, any depth; blank and bad lines are left out."""
    reader = (spark.readStream if stream else spark.read).schema(PAGE).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt")
    pages = reader.json(path)
    return pages.filter(F.col("_corrupt").isNull() & F.col("change_id").isNotNull()).drop("_corrupt")


def write_layer(df: DataFrame, path: str, partitions: list[str], *, mode: str = "replace", deal: bool = True) -> list[tuple[str, ...]]:
    """Write a layer by partition columns, nulls as ``unknown``; returns the partitions that it has rows for. Partitions of earlier
    writes stay: ``replace`` puts the new rows in place of those in the same partitions, so a repeated write changes nothing,
    ``append`` adds to them. Rows are dealt by the partition columns, and the engine splits
    large ones, so a hot partition is several files and a small one is one; without ``deal`` they stay where they are, and each task writes
    a file to each partition that it has rows for, which is the better way where partitions are few and rows are many."""
    seen = Observation()
    df = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in partitions})
    df = (df.hint("rebalance", *partitions) if deal else df).observe(seen, F.collect_set(F.struct(*partitions)).alias("partitions"))
    writer = df.write.partitionBy(*partitions).option("compression", "zstd")
    if mode == "replace":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    elif mode == "append":
        writer.mode("append").parquet(path)
    else:
        raise ValueError(f"unknown mode {mode}")
    return sorted(tuple(r) for r in seen.get["partitions"])


def read_partitions(spark: SparkSession, path: str, partitions: list[tuple[str, ...]], schema: StructType | None = None) -> DataFrame:
    """The given partitions of a layer, partition columns as text; no other file is opened. With ``schema``, a layer without any
    files is an empty frame."""
    if not partitions and schema is not None:
        return spark.createDataFrame([], schema)
    names = partition_columns(spark, path)
    reader = spark.read.option("basePath", path)
    reader = reader.schema(schema) if schema is not None else reader
    folders = ["/".join(f"{n}={escaped(v)}" for n, v in zip(names, p, strict=True)) for p in partitions]
    df = reader.parquet(*(f"{path}/{f}" for f in folders)) if folders else spark.read.parquet(path).filter("false")
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The partition columns of a layer, from one folder name at each depth."""
    names, at = [], spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while at is not None:
        inside = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName()]
        at = inside[0] if inside else None
        if at is not None:
            names.append(at.getName().split("=")[0])
    return names


def escaped(value: str) -> str:
    """A partition value as Spark writes it in a folder's name."""
    return spark_names().escapePathName(value)


def spark_names():
    return SparkSession.active().sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils


def drop_partitions(spark: SparkSession, path: str, column: str, before: str, dry_run: bool = False) -> list[str]:
    """Retention by whole partitions: folders of ``column`` (the first partition column) whose value comes before ``before`` go, all
    others aren't touched. Returns the values that go; ``unknown`` never does."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for found in fs.listStatus(at):
        name = found.getPath().getName()
        value = spark_names().unescapePathName(name.split("=", 1)[1]) if name.startswith(f"{column}=") else "unknown"
        if value not in ("unknown", "__HIVE_DEFAULT_PARTITION__") and value < before:
            gone.append(value)
            if not dry_run:
                fs.delete(found.getPath(), True)
    return sorted(gone)


def rewrite_partitions(spark: SparkSession, path: str, keep: Column) -> tuple[int, int]:
    """Retention by rows: partitions that hold a row against ``keep`` are written anew without such rows, all others aren't touched.
    Partitions that lose all rows go. Returns how many were rewritten and how many went. Rows whose rule is null stay."""
    names = partition_columns(spark, path)
    layer = spark.read.parquet(path)
    layer = layer.withColumns({n: F.col(n).cast("string") for n in names}).withColumn("_keep", F.coalesce(keep, F.lit(True)))
    counts = layer.groupBy(*names).agg(F.count_if("_keep").alias("kept"), F.count_if(~F.col("_keep")).alias("lost")).filter("lost > 0").collect()
    full = [tuple(r[n] for n in names) for r in counts if r.kept]
    empty = [tuple(r[n] for n in names) for r in counts if not r.kept]
    if full:
        rows = read_partitions(spark, path, full).filter(F.coalesce(keep, F.lit(True)))
        write_layer(written(rows, "retained"), path, names)
    for p in empty:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/" + "/".join(f"{n}={escaped(v)}" for n, v in zip(names, p, strict=True)))
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(full), len(empty)


def read_training_set(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """A gold layer as it is; raw rows (``raw_item_json`` and ``price_chaos``) are featurised; any other form is refused."""
    df = spark.read.parquet(path)
    if {"raw_item_json", "price_chaos"} <= set(df.columns):
        return featurised(df)
    if missing := {"price_chaos", "item_family", *features} - set(df.columns):
        raise ValueError(f"not a training set, it lacks {sorted(missing)}")
    return df


def featurised(raw: DataFrame) -> DataFrame:
    """Gold features of raw rows; rows whose payload is no item, or whose price is not positive, are left out."""
    return valuation.features(valuation.normalize(valuation.listed(raw.filter("price_chaos > 0"))))


def export(df: DataFrame, path: str, fmt: str, compression: str | None = None) -> None:
    """json (one object a line), jsonl (the same) or csv; nested columns become JSON text in csv. ``compression``: of the files, such as
    ``gzip``; a file is then read by one task, so it should be no larger than what one task wrote."""
    if fmt == "csv":
        df = df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("array", "struct", "map"))})
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path, compression=compression)
    elif fmt in ("json", "jsonl"):
        df.write.mode("overwrite").json(path, compression=compression)
    else:
        raise ValueError(f"unknown format {fmt}")


def metric_events(spark: SparkSession, path: str) -> DataFrame:
    """Metric events of JSON lines; bad lines, other values than objects and blank components are left out."""
    schema = "ts_utc string, component string, run_id string, duration_ms bigint, status string, error_count int, payload map<string,string>, _corrupt string"
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.filter(F.col("_corrupt").isNull() & (F.trim(F.coalesce("component", F.lit(""))) != "")).withColumn("ts", F.to_timestamp("ts_utc")).drop("_corrupt")


def landing_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per landing file: size, SHA-256, pages, items, first and last change id, and whether no page is valid."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select(F.col("path").alias("object_path"), F.col("length").alias("file_size_bytes"), F.sha2("content", 256).alias("content_sha256"), F.col("modificationTime").alias("modified_at"))
    pages = read_stash_pages(spark, path).select("change_id", "items_count", F.input_file_name().alias("object_path"), F.monotonically_increasing_id().alias("line"))
    by = pages.groupBy(F.regexp_replace("object_path", "^file:/+", "file:/").alias("object_path")).agg(
        F.count("*").alias("pages"), F.sum("items_count").alias("items"), F.min_by("change_id", "line").alias("first_change_id"), F.max_by("change_id", "line").alias("last_change_id")
    )
    out = files.withColumn("object_path", F.regexp_replace("object_path", "^file:/+", "file:/")).join(by, "object_path", "left").na.fill(0, ["pages", "items"])
    return out.withColumn("is_empty", F.col("pages") == 0).withColumn("run_id", F.element_at(F.split("object_path", "/"), -2))


def economy_rates(lists: list[DataFrame]) -> DataFrame:
    """Name to chaos from several overviews (name, chaos); a later list wins. Blank names and prices of 0 or less are left out."""
    out = None
    for rank, df in enumerate(lists):
        df = df.select(F.trim("name").alias("name"), F.col("chaos").cast("double").alias("chaos"), F.lit(rank).alias("rank"))
        out = df if out is None else out.unionByName(df)
    out = out.filter("name <> '' AND chaos > 0")
    return out.groupBy("name").agg(F.max_by("chaos", F.struct("rank", "chaos")).alias("chaos"))


REGISTRY = """families map<string,struct<active_version:string,versions:array<struct<run_id:string,model_path:string,model_sha256:string,status:string,created_at:string,
  metrics:struct<rmse:double,baseline_rmse:double>>>>>, _corrupt string"""


def _families(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(REGISTRY).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return doc.filter("families IS NOT NULL").select(F.explode("families").alias("family", "v"))


def registry_state(spark: SparkSession, path: str) -> DataFrame:
    """Active version per family from a registry document; nothing from a bad one."""
    return _families(spark, path).select("family", "v.active_version", F.size("v.versions").alias("versions"))


def registry_versions(spark: SparkSession, path: str) -> DataFrame:
    """A row for each family and version of a registry document; nothing from a bad one."""
    each = _families(spark, path).select("family", F.explode("v.versions").alias("x"))
    return each.select("family", "x.run_id", "x.model_path", "x.model_sha256", "x.status", "x.created_at", "x.metrics.rmse", "x.metrics.baseline_rmse")


def latest_snapshot(catalog: DataFrame, kind: str, date: str | None = None) -> DataFrame:
    """The newest catalog row of a type, by object path; of one date if given."""
    rows = catalog.filter(F.col("object_path").startswith(kind + "/"))
    rows = rows.filter(F.get_json_object("metadata", "$.snapshot_date") == date) if date else rows
    return rows.orderBy(F.desc("object_path")).limit(1)
