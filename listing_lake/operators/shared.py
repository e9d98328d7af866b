"""Tables in the folder that all executors share, and groups of any size in order over many tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; one of our own only on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/listing_lake/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_group(df: DataFrame, label: str) -> DataFrame:
    """A row for each group, written before rows are joined to it: its size is then known, so the engine sends a few groups to the
    rows, rather than all rows of a group to one task."""
    return written(df, label)


def in_shares(df: DataFrame, group: Column, order: list[Column], label: str) -> DataFrame:
    """Rows sorted by group and order over all tasks, written once, with ``_group``, their place ``_at`` and the share ``_part`` they
    lie in. A share is a range of one or more groups, so a group of any size is in as many shares as it takes, and what follows
    works on (group, share). Nulls inside a struct meet in groups and joins, so ``group`` should be one."""
    rows = df.withColumn("_group", group)
    rows = rows.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order)
    return written(rows.withColumn("_at", F.monotonically_increasing_id()), label).withColumn("_part", F.shiftright("_at", 33))


def share_window():
    """A group's rows in one share, in order."""
    return W.partitionBy("_group", "_part").orderBy("_at")


def across(shares: DataFrame, facts: dict[str, Column], over: dict[str, tuple[str, Column]]) -> DataFrame:
    """A row for each group and share with ``facts`` (aggregates), and ``over``: what a group's shares before or behind it give,
    as ``name: (which, column)`` with ``before``, ``behind`` or ``all``. There are no more of these rows than tasks and groups."""
    one = shares.groupBy("_group", "_part").agg(*(c.alias(k) for k, c in facts.items()))
    by = W.partitionBy("_group").orderBy("_part")
    frames = {"before": by.rowsBetween(W.unboundedPreceding, -1), "behind": by.rowsBetween(1, W.unboundedFollowing), "all": by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)}
    return one.select("_group", "_part", *(c.over(frames[which]).alias(k) for k, (which, c) in over.items()))


def with_running(df: DataFrame, group: Column, order: list[Column], value: str, label: str) -> DataFrame:
    """Adds ``_upto``, the sum of ``value`` over a group's rows up to this one, and ``_n``, its sum over the group. Each share sums its own
    rows; sums of the shares before it are added."""
    rows = in_shares(df, group, order, label)
    over = {"_before": ("before", F.sum("_sum")), "_n": ("all", F.sum("_sum"))}
    sums = across(rows, {"_sum": F.sum(value)}, over)
    here = F.sum(value).over(share_window().rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_here", here).join(sums, ["_group", "_part"])
    return rows.withColumn("_upto", F.col("_here") + F.coalesce("_before", F.lit(0))).drop("_here", "_before")
