"""Family models between training and valuation: saved, entered in a registry, checked, loaded and applied.

A registry is one JSON document: for each family its active version and all versions, each with the folder of its model and
the checksum of that folder's data. What can't be read, or isn't what was saved, leaves its family to the fallback value."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_lake.operators import training, upkeep, valuation
from listing_lake.sources import files

#: So many families may have models; each is a branch of the plan. More are refused, not cut off.
MOST_FAMILIES = 64
VERSIONS = "family string, run_id string, model_path string, model_sha256 string, rmse double, baseline_rmse double, created_at string"
REPORT = "family string, run_id string, model_path string, state string"


def feature_names(family: str) -> list[str]:
    """A family's features in the order in which its models read them."""
    return [*valuation.FAMILY_FEATURES.get(family, valuation.FAMILY_FEATURES["generic"]), *valuation.NUMERIC_WEIGHTS, "meta_utility_score"]


def checksum(spark: SparkSession, path: str) -> str | None:
    """SHA-256 over a saved model's data files: of each its folder, name and content. Null where there is none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    each = found.select(F.concat_ws(":", F.regexp_extract("path", r"([^/]+/[^/]+)$", 1), F.sha2("content", 256)).alias("file"))
    told = each.agg(F.array_sort(F.collect_list("file")).alias("files"))
    return told.select(F.when(F.size("files") > 0, F.sha2(F.array_join("files", "\n").cast("binary"), 256))).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def publish(spark: SparkSession, models: dict[str, GBTRegressionModel], base: str, run_id: str, metrics: dict[str, tuple[float, float]], created_at: str) -> DataFrame:
    """Save fitted models under ``base/family/run_id``; a row of VERSIONS for each. ``metrics``: rmse and baseline rmse by family."""
    rows = []
    for family, model in models.items():
        path = f"{base.rstrip('/')}/{family}/{run_id}"
        model.write().overwrite().save(path)
        rows.append((family, run_id, path, checksum(spark, path), *map(float, metrics[family]), created_at))
    return spark.createDataFrame(rows, VERSIONS)


def write_registry(versions: DataFrame, path: str, **policy) -> None:
    """Judge versions (:func:`training.promotions`) and write the registry document. A document is as long as its list of
    versions, which grows with training runs, not with listings."""
    judged = training.promotions(versions, **policy)
    names = ("run_id", "model_path", "model_sha256", "status", "created_at", "decision_reason")
    version = F.struct(*names, F.struct("rmse", "baseline_rmse").alias("metrics"))
    active = F.max(F.when(F.col("status") == "active", F.col("run_id")))
    by = judged.groupBy("family").agg(F.struct(active.alias("active_version"), F.array_sort(F.collect_list(version)).alias("versions")).alias("entry"))
    doc = by.agg(F.map_from_entries(F.collect_list(F.struct("family", "entry"))).alias("families"))
    doc.select(F.to_json(F.struct("families")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def active_versions(spark: SparkSession, path: str) -> DataFrame:
    """Each family's active version as the registry document has it; nothing from a bad document."""
    return upkeep.active_models(files.registry_state(spark, path), files.registry_versions(spark, path))


def load(spark: SparkSession, registry: str, legacy: str | None = None, families: list[str] | None = None) -> tuple[dict[str, GBTRegressionModel], DataFrame]:
    """Models to predict with, by family, and a row of REPORT for each family: ``loaded``, ``checksum_mismatch``, ``unreadable`` or
    ``no_model``. A family without a model folder that exists takes ``legacy/price_oracle_family``, if that does."""
    rows = active_versions(spark, registry).select("family", "run_id", "model_path", "model_sha256").limit(MOST_FAMILIES + 1).collect() if exists(spark, registry) else []
    if len(rows) > MOST_FAMILIES:
        raise ValueError(f"the registry has models of more than {MOST_FAMILIES} families")
    known = {r.family: (r.run_id, r.model_path, r.model_sha256) for r in rows}
    models, told = {}, []
    for family in sorted({*known, *(families or valuation.FAMILY_FEATURES)}):
        run_id, path, wanted = known.get(family, (None, None, None))
        if not path or not exists(spark, path):
            run_id, path, wanted = None, f"{legacy.rstrip('/')}/price_oracle_{family}" if legacy else None, None
        state = "loaded"
        try:
            if not path or not exists(spark, path):
                state = "no_model"
            elif wanted and checksum(spark, path) != wanted:
                state = "checksum_mismatch"
            else:
                model = GBTRegressionModel.load(path)
                if model.numFeatures != len(feature_names(family)):
                    raise ValueError(f"{path} reads {model.numFeatures} features")
                models[family] = model
        except (Py4JJavaError, PySparkException, ValueError):  # a model that can't be read is no reason to value nothing
            state = "unreadable"
        told.append((family, run_id, path, state))
    return models, spark.createDataFrame(told, REPORT)


def predict_with_registry(silver: DataFrame, models: dict[str, GBTRegressionModel], scores: DataFrame | None = None) -> DataFrame:
    """:func:`valuation.predict`, with the family's model where there is one. One plan: each family's rows go through its model in
    a branch of their own (a layer partitioned by family is read once), all others through the fallback. Null features are 0."""
    gold = valuation.features(silver, scores)
    branches = [gold.filter(~F.coalesce(F.col("item_family").isin(*models), F.lit(False)) if models else F.lit(True)).withColumn("_model", F.lit(None).cast("double"))]
    for family, model in sorted(models.items()):
        names = [f"_f{k}" for k in range(len(feature_names(family)))]
        some = gold.filter(F.col("item_family") == family)
        some = some.withColumns({k: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for k, c in zip(names, feature_names(family), strict=True)})
        some = VectorAssembler(inputCols=names, outputCol="_features").transform(some)
        told = model.setFeaturesCol("_features").setPredictionCol("_model").transform(some)
        branches.append(told.select(*gold.columns, "_model"))
    both = reduce(DataFrame.unionByName, branches)
    return valuation.predict(both, "_model").select(*silver.columns, "predicted_value", "confidence", "feature_completeness", "model_source")
