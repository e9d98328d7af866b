"""Training sets: filters, gates, splits, metrics, and boosted-tree price models per family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listing_lake.operators.shared import per_group, with_running, written

SIGNALS = ("has_life", "has_resist", "has_spell_damage", "has_cast_speed", "has_spell_crit", "has_suppress")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """Exact, linearly interpolated quantiles ``q0``, ``q1``, ... of each group; a group without a value has no row.

    Values are counted, their counts are summed in narrow logarithmic buckets (which keep the order), and only the buckets
    that hold a wanted rank are looked into. So a group is a few thousand bucket rows, and no task holds all its values."""
    group = F.struct(F.lit(0).alias("_"), *keys)  # nulls inside a struct meet in groups and joins
    hist = df.filter(F.col(value).isNotNull()).groupBy(group.alias("_key"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    hist = hist.withColumn("_b", F.signum("_v") * F.floor(F.log1p(F.abs("_v")) * 1024))
    by = W.partitionBy("_key")
    buckets = hist.groupBy("_key", "_b").agg(F.sum("_c").alias("_s")).withColumns({"_upto": F.sum("_s").over(by.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)), "_n": F.sum("_s").over(by)})
    asked = buckets.select("*", F.posexplode(F.array(*map(F.lit, shares))).alias("_i", "_share")).withColumn("_at", F.col("_share") * (F.col("_n") - 1))
    asked = asked.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).withColumn("_before", F.col("_upto") - F.col("_s"))
    asked = asked.filter("_rank >= _before AND _rank < _upto").select("_key", "_b", "_i", "_at", "_rank", "_before")
    seen = F.col("_before") + F.sum("_c").over(W.partitionBy("_key", "_i", "_rank").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    found = hist.join(asked, ["_key", "_b"]).withColumn("_seen", seen).filter("_rank < _seen AND _rank >= _seen - _c")
    weight = F.when(F.floor("_at") == F.ceil("_at"), 1.0).when(F.col("_rank") == F.floor("_at"), F.ceil("_at") - F.col("_at")).otherwise(F.col("_at") - F.floor("_at"))
    out = found.groupBy("_key").agg(*(F.sum(F.when(F.col("_i") == i, F.col("_v") * weight)).alias(f"q{i}") for i in range(len(shares))))
    return out.select(*(F.col("_key").getField(k).alias(k) for k in keys), *(f"q{i}" for i in range(len(shares))))


def iqr_bounds(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per group: linearly interpolated quartiles, and bounds one and a half ranges beyond them."""
    q25, q75 = F.col("q0"), F.col("q1")
    return quantiles(df, [key], value, (0.25, 0.75)).select(key, q25.alias("q25"), q75.alias("q75"), (q25 - 1.5 * (q75 - q25)).alias("low"), (q75 + 1.5 * (q75 - q25)).alias("high"))


def remove_price_outliers(df: DataFrame, key: str, value: str, least_rows: int = 10) -> DataFrame:
    """Rows inside their group's bounds; sets of at most ``least_rows`` stay as they are."""
    if df.limit(least_rows + 1).count() <= least_rows:
        return df
    bounds = iqr_bounds(df, key, value).select(F.col(key).alias("_key"), "low", "high")
    return df.join(bounds, F.col(key).eqNullSafe(F.col("_key"))).filter(F.col(value).between(F.col("low"), F.col("high"))).drop("_key", "low", "high")


def remove_stale_cheap(df: DataFrame, as_of: str, listed: str, price: str, hours: float = 48.0, least_signals: int = 2, least_rows: int = 10) -> DataFrame:
    """Drops rows that are stale, rich in signals and no dearer than the lower quartile of all. Unreadable times are fresh."""
    if df.limit(least_rows + 1).count() <= least_rows:
        return df
    quartile = quantiles(df, [], price, (0.25,)).select(F.col("q0").alias("_q25"))  # one row
    signals = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) for c in SIGNALS if c in df.columns))
    old = F.coalesce((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(listed).cast("timestamp"))) / 3.6e9 > hours, F.lit(False))
    return df.join(F.broadcast(quartile)).filter(~(old & (signals >= least_signals) & (F.col(price) <= F.col("_q25")))).drop("_q25")


def audit(df: DataFrame) -> DataFrame:
    """Rows, and exact duplicates: rows beyond the first of each whole-row value. Only two hashes of a row are shuffled."""
    whole = F.struct(*df.columns)
    each = df.select(F.xxhash64(whole).alias("a"), F.sha1(F.to_json(whole).cast("binary")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicates"))


def quality_gates(df: DataFrame, target: str, *, min_rows: int = 50, min_targets: int = 10, max_duplicates: float = 0.2, min_family: int = 20) -> DataFrame:
    """One row: the figures of the gates, and ``failed``, the first gate that fails or null."""
    if target not in df.columns:
        return df.sparkSession.createDataFrame([("target_missing",)], "failed string")
    t = F.col(target)
    told = df.agg(
        F.sum(t.isNull().cast("long")).alias("null_targets"), F.sum((t <= 0).cast("long")).alias("bad_targets"),
        F.countDistinct(t).alias("distinct_targets"), F.round(F.stddev_pop(t), 4).alias("target_std"),
    ).join(audit(df))
    if "item_family" in df.columns:
        told = told.join(df.groupBy("item_family").count().agg(F.max("count").alias("largest_family")))
    else:
        told = told.withColumn("largest_family", F.lit(None).cast("long"))
    n = F.col("row_count")
    return told.withColumn(
        "failed",
        F.when(F.col("null_targets") > 0, "target_null").when(F.col("bad_targets") > 0, "target_not_positive").when(n < min_rows, "too_few_rows")
        .when(F.col("distinct_targets") < min_targets, "too_few_targets").when(F.col("target_std") <= 0, "no_spread")
        .when(F.col("exact_duplicates") / n > max_duplicates, "too_many_duplicates").when(F.col("largest_family").isNull(), "family_missing").when(F.col("largest_family") < min_family, "family_too_small"),
    )


def family_counts(df: DataFrame) -> DataFrame:
    """Rows of each family, nulls as a family of their own."""
    return df.groupBy("item_family").agg(F.count("*").alias("n"))


def drop_duplicate_gold(df: DataFrame, order: list[str], ignore: tuple[str, ...] = ("snapshot_date", "league")) -> DataFrame:
    """One row of those alike in all columns but ``ignore`` and ``order``: the last by ``order``. Groups meet by two hashes of
    what they share, and rows combine before the shuffle."""
    same = F.struct(*(c for c in df.columns if c not in (*ignore, *order)))
    keyed = df.groupBy(F.xxhash64(same).alias("_a"), F.sha1(F.to_json(same).cast("binary")).alias("_b"))
    return keyed.agg(F.max_by(F.struct(*df.columns), F.struct(*order, *(c for c in ignore if c in df.columns))).alias("_row")).select("_row.*")


def raw_training_rows(events: list[DataFrame], price: str = "price_chaos") -> DataFrame:
    """All rows of several event tables with a positive price, on one list of columns, ready to be featurised."""
    some = [df.filter(F.col(price) > 0) for df in events]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some)


def temporal_split(df: DataFrame, keys: list[str], time: str, tie: list[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``part`` (train or test) per group: the earliest int(n * (1 - test_size)) rows train, at least one on each side,
    where at least two times and 80 % of them can be read (rows without a time are then dropped); else a seeded split.

    Instants of a group are counted and summed up in shares of bounded size (:mod:`shared`). The last instant of the training part is
    then known for each group; rows of other instants are told by their time alone, and only rows of that instant are ranked,
    again in shares. So neither the instants of a group nor the ties of one are in one task."""
    good = F.col(time).isNotNull()
    group = F.struct(*keys)  # nulls inside a struct meet in groups and joins
    df = df.withColumn("_g", group)
    instants = df.groupBy("_g", F.col(time).alias("_t")).agg(F.count("*").alias("_c"))
    sizes = instants.groupBy("_g").agg(F.sum("_c").alias("_rows"), F.sum(F.when(F.col("_t").isNotNull(), F.col("_c")).otherwise(0)).alias("_timed"))
    sizes = sizes.withColumn("_by_time", (F.col("_timed") >= 2) & (F.col("_timed") >= 0.8 * F.col("_rows")))
    sizes = sizes.withColumn("_cut", F.least(F.greatest(F.floor(F.round(F.col("_timed") * (1 - test_size), 9)), F.lit(1)), F.col("_timed") - 1))
    summed = with_running(instants.filter("_t IS NOT NULL"), F.col("_g"), [F.col("_t")], "_c", "split-instants").select("_g", "_t", "_c", "_upto")
    edge = summed.join(sizes, "_g").filter((F.col("_upto") >= F.col("_cut")) & (F.col("_upto") - F.col("_c") < F.col("_cut")))
    # so many of the rows at the edge's instant still train
    sizes = sizes.join(edge.select("_g", F.col("_t").alias("_edge"), (F.col("_cut") - (F.col("_upto") - F.col("_c"))).alias("_room")), "_g", "left")
    sizes = per_group(sizes, "split-sizes")
    out = df.join(sizes, "_g").filter(~F.col("_by_time") | good)
    at_edge = F.coalesce(F.col("_by_time") & (F.col(time) == F.col("_edge")), F.lit(False))
    ties = with_running(out.filter(at_edge).withColumn("_one", F.lit(1)), F.col("_g"), [F.col(c) for c in tie], "_one", "split-ties")
    ties = ties.withColumn("part", F.when(F.col("_upto") <= F.col("_room"), "train").otherwise("test"))
    chance = F.pmod(F.xxhash64(*tie, F.lit(seed)), F.lit(1000)) < int(1000 * (1 - test_size))
    clear = out.filter(~at_edge).withColumn("part", F.when(F.when(F.col("_by_time"), F.col(time) < F.col("_edge")).otherwise(chance), "train").otherwise("test"))
    names = [c for c in df.columns if c != "_g"]
    return clear.select(*names, "part").unionByName(ties.select(*names, "part"))


def feature_overlap(train: DataFrame, test: DataFrame, features: list[str]) -> DataFrame:
    """Distinct feature rows that are in both."""
    return train.select(*features).distinct().intersect(test.select(*features).distinct()).agg(F.count("*").alias("overlap"))


def median_baseline(train: DataFrame, keys: list[str], target: str) -> DataFrame:
    return per_group(quantiles(train, keys, target, (0.5,)).withColumnRenamed("q0", "baseline"), "baseline")


def regression_metrics(df: DataFrame, keys: list[str], target: str, predicted: str, baseline: str) -> DataFrame:
    rmse = lambda p: F.sqrt(F.avg(F.pow(F.col(p) - F.col(target), 2)))
    return df.groupBy(*keys).agg(rmse(predicted).alias("rmse"), F.avg(F.abs(F.col(predicted) - F.col(target))).alias("mae"), rmse(baseline).alias("baseline_rmse"), F.count("*").alias("n"))


def bucket_rmse(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """Root mean squared error for targets to 50, to 150 and beyond; null for an empty bucket."""
    square = F.pow(F.col(predicted) - F.col(target), 2)
    of = lambda rule: F.sqrt(F.avg(F.when(rule, square)))
    t = F.col(target)
    return df.agg(of(t <= 50).alias("rmse_low"), of((t > 50) & (t <= 150)).alias("rmse_mid"), of(t > 150).alias("rmse_high"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free hash of the rows, and a hash of the columns, by functions that any engine has: of each row the first 60 bits of the
    MD5 of its values' texts (each with its length before it, a null as ``-``), added up, so that repeated rows count."""
    names = sorted(df.columns)
    text = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    row = F.conv(F.substring(F.md5(F.concat(*map(text, names)).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    columns = ",".join(f"{c}:{t}" for c, t in sorted(df.dtypes))
    told = df.agg(F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("data_hash"), F.count("*").alias("row_count"))
    return told.withColumn("schema_hash", F.sha2(F.lit(columns).cast("binary"), 256))


def summed_rows(df: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Rows alike in ``keys`` as one row, or as two where their targets differ, with ``weight``, how many rows it stands for. The two lie
    one standard deviation below and above the mean, so the number, the sum and the sum of squares of the targets are those of
    all rows. Squared loss and variance know no more of rows that are alike, so a tree is the same. A target that is null or no number stays one."""
    t = F.col(target).cast("double")
    mean = F.when(F.count(t) == F.count("*"), F.avg(t))
    by = df.groupBy(*keys).agg(F.count("*").alias("_n"), mean.alias("_mean"), F.stddev_pop(t).alias("_off"))
    sides = F.when(F.col("_off") > 0, F.array(F.col("_mean") - F.col("_off"), F.col("_mean") + F.col("_off"))).otherwise(F.array("_mean"))
    by = by.withColumn("_sides", sides)
    return by.select(*keys, F.explode("_sides").alias(target), (F.col("_n") / F.size("_sides")).alias("weight"))


def train_models(
    gold: DataFrame, groups: list[tuple[str, Column]], target: str, features: list[str], *, least_rows: int = 20, depth: int = 5, rate: float = 0.05, rounds: int = 120, weight: str | None = None
) -> tuple[dict, DataFrame]:
    """A boosted-tree model per group with ``least_rows`` rows or more, early stopping on rows marked ``part = test``; the
    fitted models (null for a group of fewer rows, which falls back to its family), and predictions of all rows of fitted groups
    with their group's name. A fit goes over its rows dozens of times, so it gets :func:`summed_rows`, written once; ``weight`` is the column
    of rows that are so already."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    filled = gold.na.fill(0.0, features).withColumn("validating", F.coalesce(F.col("part") == "test", F.lit(False)))
    assembled = assembler.transform(filled)
    rules, source, counted = {name: rule for name, rule in groups}, assembled, weight
    if weight is None:
        marks = {f"_in{i}": F.coalesce(rule, F.lit(False)) for i, (_, rule) in enumerate(groups)}
        rules, counted = {name: F.col(mark) for (name, _), mark in zip(groups, marks, strict=True)}, "weight"
        inside = filled.withColumns(marks).filter(reduce(lambda a, b: a | b, map(F.col, marks)))
        source = assembler.transform(written(summed_rows(inside, [*marks, "validating", *features], target), "training-sums"))
    models, out = {}, None
    for name, rule in groups:
        some = source.filter(rules[name])
        if (some.agg(F.sum(counted)).first()[0] or 0) < least_rows:
            models[name] = None
            continue
        models[name] = GBTRegressor(labelCol=target, weightCol=counted, maxDepth=depth, stepSize=rate, maxIter=rounds, validationIndicatorCol="validating", seed=42).fit(some)
        told = models[name].transform(assembled.filter(rule).withColumn("model", F.lit(name))).drop("features", "validating")
        out = told if out is None else out.unionByName(told)
    return models, out


def promotions(versions: DataFrame, max_ratio: float = 1.0, min_gain: float = 0.0) -> DataFrame:
    """Status and reason of each model version: the last of a family that meets the policy is active, earlier ones that do
    are archived, all others rejected."""
    known = F.col("rmse").isNotNull() & F.col("baseline_rmse").isNotNull()
    ratio, gain = F.col("rmse") <= F.col("baseline_rmse") * max_ratio, F.col("baseline_rmse") - F.col("rmse") >= min_gain
    reason = F.when(~known, "invalid_metrics").when(~ratio, "rmse_above_ratio_threshold").when(~gain, "abs_improvement_below_threshold").otherwise("promotion_policy_satisfied")
    out = versions.withColumn("decision_reason", reason)
    good = out.filter(F.col("decision_reason") == "promotion_policy_satisfied").groupBy("family").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("_active"))
    out = out.join(good, "family", "left")
    status = F.when(F.col("decision_reason") != "promotion_policy_satisfied", "rejected").when(F.col("run_id") == F.col("_active"), "active").otherwise("archived")
    return out.withColumn("status", status).drop("_active")
