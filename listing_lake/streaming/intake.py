"""Intake of listing pages and offers as streams. The same functions take batch frames, which is how they are tested."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from listing_lake.functions import listing as L

PAGE = (
    "change_id string, collected_at string, next_change_id string, stashes_count int, items_count int, "
    "raw_payload struct<next_change_id:string, stashes:array<struct<stash:string, league:string, accountName:string, items:array<string>>>>, _corrupt string"
)
ITEM = "id string, baseType string, name string, ilvl int, frameType int, note string"


def page_events(pages: DataFrame) -> DataFrame:
    """Priced rare and unique items of stash pages as event rows. Items without an id or a usable price note are left out. An item
    and its note come from generators of one row, over which the engine neither copies an expression nor moves a filter, so each is
    parsed once; notes are those of rare and unique items alone."""
    stash = pages.select("change_id", "collected_at", F.explode("raw_payload.stashes").alias("s"))
    item = stash.select("change_id", "collected_at", "s.stash", "s.league", "s.accountName", F.explode("s.items").alias("raw"))
    item = item.select("*", F.explode(F.array(F.from_json("raw", ITEM))).alias("i"))
    item = item.filter(L.useful_item(F.col("i.frameType"), F.lit(1.0)).isNotNull() & (F.col("i.id") != ""))
    item = item.select("*", F.explode(F.array(L.parse_price_note(F.coalesce("i.note", "stash")))).alias("p"))
    item = item.withColumn("chaos", L.to_chaos_fixed(F.col("p.amount"), F.col("p.currency")))
    good = item.withColumn("rarity", L.useful_item(F.col("i.frameType"), F.col("chaos"))).filter("rarity IS NOT NULL")
    return good.select(
        "change_id", F.col("i.id").alias("item_id"), "league", F.col("accountName").alias("account_name"), F.col("stash").alias("stash_name"), "rarity", F.col("i.baseType").alias("base_type"),
        F.col("i.ilvl").alias("item_level"), F.col("p.amount").alias("price_amount"), F.col("p.currency").alias("price_currency"), F.col("chaos").alias("price_chaos"),
        F.col("raw").alias("raw_item_json"), F.to_timestamp("collected_at").alias("collected_at"),
    )


def insert_once(events: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key. In a stream, keys are held for ``delay`` of event time: repeats come from replays."""
    if events.isStreaming:
        seen = events.observe("intake", F.count("*").alias("rows")).withWatermark(time, delay)
        return seen.dropDuplicatesWithinWatermark(keys).observe("kept", F.count("*").alias("rows"))
    return events.dropDuplicates(keys)


def offer_events(offers: DataFrame, rates: DataFrame) -> DataFrame:
    """Offers (id, indexed, league, amount, currency) as events with a price in chaos; those without any are left out."""
    priced = offers.withColumn("name", L.rate_name(F.col("currency"))).join(rates, "name", "left")
    chaos = F.when(F.col("currency") == "chaos", F.col("amount")).otherwise(F.col("amount") * F.col("chaos"))
    return priced.withColumn("price_chaos", F.round(chaos, 2)).drop("name", "chaos").filter("item_id <> '' AND indexed IS NOT NULL AND price_chaos > 0")


def hourly_counts(events: DataFrame, time: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    """Events per hour and group, in tumbling windows."""
    events = events.withWatermark(time, delay) if events.isStreaming else events
    return events.groupBy(F.window(time, "1 hour").alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), *by, "n")


def ttl_dedupe(events: DataFrame, key: str, time: str, tie: str, seconds: float = 120.0) -> DataFrame:
    """Rows seen at least ``seconds`` after the last kept row of their key; blank keys all stay. Greedy, so one pass in time
    order: only key, time and tie go to Python, sorted by Spark and streamed, so a hot key is never a group in memory."""
    rows = events.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    flat = rows.select(F.col(key).cast("string").alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(tie).alias("tie"))
    flat = flat.repartition("k").sortWithinPartitions("k", "t", "tie")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = None, None
        for pdf in batches:
            good = []
            for k, t in zip(pdf["k"].tolist(), pdf["t"].tolist(), strict=True):
                fresh = k != last or t - at >= seconds * 1e6
                good.append(fresh)
                if fresh:
                    last, at = k, t
            yield pdf.loc[good, ["tie"]]

    kept = flat.mapInPandas(keep, f"tie {events.schema[tie].dataType.simpleString()}")
    blank = events.filter(F.col(key).isNull() | (F.col(key).cast("string") == ""))
    return events.join(kept.withColumnRenamed("tie", tie), tie, "left_semi").unionByName(blank)


def ttl_dedupe_stream(events: DataFrame, key: str, time: str, tie: str, seconds: float = 120.0, delay: str = "10 minutes") -> DataFrame:
    """``ttl_dedupe`` on a stream: the time of a key's last kept row is its state, dropped once the watermark has passed it by
    ``seconds``. Rows later than ``delay`` (or not after 1970) go, rows before the last kept one are repeats, blank keys all stay. A task holds a
    key's rows of one micro-batch, whose size the source limits."""
    whole = {f.name: f.dataType for f in events.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    events = events.withWatermark(time, delay)
    blank = F.col(key).isNull() | (F.col(key).cast("string") == "")
    # pandas has no null integers: they travel as text
    flat = events.filter(~blank).withColumns({"_k": F.col(key).cast("string"), "_tie": F.col(tie)}).withColumns({c: F.col(c).cast("string") for c in whole})

    def keep(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values([time, "_tie"], ignore_index=True)
        last = state.get[0] if state.exists else None
        good = []
        for t in rows[time].astype("datetime64[us]").astype("int64").tolist():
            good.append(last is None or t - last >= seconds * 1e6)
            last = t if good[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last / 1e3 + seconds * 1e3) + 1, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[good].drop(columns=["_k", "_tie"])

    kept = flat.groupBy("_k").applyInPandasWithState(keep, flat.drop("_k", "_tie").schema, "last long", "append", "EventTimeTimeout")
    return kept.withColumns({c: F.col(c).cast(t) for c, t in whole.items()}).unionByName(events.filter(blank))


def to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what is there and stop. Files and their commit log make replays harmless."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: The partition of each batch in a table that batches are inserted into: the ledger and the rows are one commit.
BATCH = "_batch"


def upsert_batch(target: str, keys: list[str], order: list[str], run: str):
    """For ``foreachBatch``: insert the rows whose key ``target`` lacks, of each key the first by ``order``, then by the batch's own
    order. Null keys are keys like others.

    A batch is one partition, named by ``run`` (one name for each checkpoint) and the batch's number, and written as a whole. A batch
    that is tried again finds its partition's place taken by nothing or by itself, and writes the same rows in it; rows under
    another run or number are already there, so they are insert-or-ignore. Keys meet by equality of structs, so a hot key is a
    partial aggregate and one row."""

    def insert(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        name = f"{run}-{batch_id}"
        key = F.struct(*keys)
        arrival = batch.withColumn("_arrival", F.monotonically_increasing_id())
        first = F.min_by(F.struct(*batch.columns), F.struct(*order, "_arrival")).alias("_row")
        fresh = arrival.groupBy(key.alias("_key")).agg(first)
        known = stored(spark, target)
        if known is not None:
            others = known.filter(F.col(BATCH) != name).select(key.alias("_key"))
            fresh = fresh.join(others, "_key", "left_anti")
        fresh.select("_row.*", F.lit(name).alias(BATCH)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(target)

    return insert


def stored(spark: SparkSession, target: str) -> DataFrame | None:
    """A table that batches are inserted into, or None before its first batch has rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not any(s.getPath().getName().startswith(f"{BATCH}=") for s in fs.listStatus(at)):
        return None
    return spark.read.parquet(target).withColumn(BATCH, F.col(BATCH).cast("string"))


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], run: str) -> None:
    """Run a stream over what is there into ``target`` and stop. Counts of rows go to listeners as the metric ``intake``."""
    seen = stream.observe("intake", F.count("*").alias("rows"))
    query = seen.writeStream.foreachBatch(upsert_batch(target, keys, order, run)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class RunProgress(StreamingQueryListener):
    """Counters over all batches of a run: attach with ``spark.streams.addListener``. Rows kept are those of the observed metric
    ``kept``; a stream that has none keeps what it reads."""

    def __init__(self):
        self.batches = self.rows = self.kept = 0
        self.seconds = 0.0
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        told = event.progress
        metrics = told.observedMetrics or {}
        rows = metrics["intake"]["rows"] if "intake" in metrics else told.numInputRows
        if told.numInputRows or rows:
            self.batches += 1
        self.rows += rows
        self.kept += metrics["kept"]["rows"] if "kept" in metrics else rows
        self.seconds += told.batchDuration / 1000

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.append(str(event.runId))

    def counters(self) -> dict[str, float]:
        per_second = self.rows / self.seconds if self.seconds else 0.0
        return {"batches": self.batches, "rows": self.rows, "inserted": self.kept, "duplicates": self.rows - self.kept, "rows_per_second": per_second}


def progress(query) -> dict[str, float]:
    """Counters of a stream's last batch."""
    told = query.lastProgress
    return {"rows": told["numInputRows"], "rows_per_second": told["processedRowsPerSecond"]} if told else {"rows": 0, "rows_per_second": 0.0}
