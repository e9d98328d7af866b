"""Bronze: de-duplicated sightings and what is known of each item over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.functions import listing as L
from listing_lake.operators.shared import with_running


#: How objects begin, and how those of no field do.
OBJECT, EMPTY = r"^[ \t\r\n]*\{", r"^[ \t\r\n]*\{[ \t\r\n]*\}"


def event_key(*columns: str) -> Column:
    """SHA-1 over the columns' texts; a null counts as the text ``None``, so it differs from an empty one."""
    return F.sha1(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns)).cast("binary"))


def canonical_json(payload: Column) -> Column:
    """Key-sorted compact JSON; null where the payload is no JSON."""
    return F.to_json(F.try_parse_json(payload))


def valid_object(payload: Column) -> Column:
    """Whether JSON is an object: what the parser takes and what begins with a brace."""
    return F.coalesce(payload.rlike(OBJECT) & F.try_parse_json(payload).isNotNull(), F.lit(False))


def load_observations(stash: DataFrame | None, trade: DataFrame | None, defaults: dict[str, object]) -> DataFrame:
    """Union of two event tables on one column list. Absent columns and ``collected_at`` take their defaults."""
    parts = []
    for rank, (name, df) in enumerate((("stash", stash), ("trade", trade))):
        if df is not None:
            df = df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})
            if "collected_at" not in df.columns and "indexed" in df.columns:
                df = df.withColumn("collected_at", F.col("indexed"))
            parts.append(df.withColumns({"source": F.lit(name), "source_rank": F.lit(rank)}))
    if not parts:
        raise ValueError("no event table")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def query_context(source: Column, stash: tuple[str, ...], trade: tuple[str, ...]) -> Column:
    """Key-sorted JSON of the fields that tell where a sighting came from."""
    return F.when(source == "stash", F.to_json(F.struct(*sorted(stash)))).when(source == "trade", F.to_json(F.struct(*sorted(trade))))


def snapshot_date(default: str, *times: str) -> Column:
    """Date of the first of the times that can be read, as text."""
    return F.coalesce(*(F.date_format(F.try_to_timestamp(F.col(t)), "yyyy-MM-dd") for t in times), F.lit(default))


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order. An aggregation on the key: rows combine before the shuffle."""
    best = F.max_by(F.struct(*df.columns), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("_row")
    return df.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(best).select("_row.*")


def latest_per_item(df: DataFrame, item: str, time: str, tie: list[str]) -> DataFrame:
    """One row per item id: the latest time, where a time that can't be read counts as latest. Rows without an id all stay."""
    named = df.filter(F.col(item).isNotNull() & (F.col(item) != ""))
    return keep_last(named, [item], [F.col(time).isNull(), F.col(time), *map(F.col, tie)]).unionByName(df.filter(F.col(item).isNull() | (F.col(item) == "")))


def rollup(df: DataFrame, *, seen: Column, collected: Column, price: str, keys: tuple[str, ...] = ("league", "item_id"), source: str = "source", also: dict[str, Column] | None = None) -> DataFrame:
    """Per league and item: first and last seen, sightings, sources, price range, and whether the price looks like an anomaly
    (the greatest over one and a half times the least, both positive). ``also``: other aggregates; with them, rows without an id are a group too."""
    named = df.filter(F.col(keys[1]).isNotNull() & (F.col(keys[1]) != "")) if also is None else df
    at = F.coalesce(seen, collected)
    out = named.groupBy(*keys).agg(
        F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count("*").alias("seen_count"),
        (F.max((F.col(source) == "stash").cast("int")) + F.max((F.col(source) == "trade").cast("int"))).cast("long").alias("source_count"),
        F.min(source).alias("_source"), F.min(price).alias("min_price"), F.max(price).alias("max_price"), *(v.alias(k) for k, v in (also or {}).items()),
    )
    return out.select(
        *keys, "first_seen_at", "last_seen_at", "seen_count", "source_count", "min_price", "max_price",
        F.when(F.col("source_count") > 1, "both").otherwise(F.col("_source")).alias("source"),
        F.coalesce((F.col("min_price") > 0) & (F.col("max_price") > 1.5 * F.col("min_price")), F.lit(False)).alias("price_fix_suspected"), *(also or {}),
    )


def reconcile(df: DataFrame, **parameters) -> DataFrame:
    """Sightings with the rollup of their item joined on; rows without an id get a rollup of themselves alone."""
    keys = parameters.get("keys", ("league", "item_id"))
    rolled = rollup(df, **parameters).select(*(F.col(k).alias(f"_{k}") for k in keys), "first_seen_at", "last_seen_at", "seen_count", "source_count", F.col("source").alias("all_sources"), "price_fix_suspected")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return _filled(df.join(rolled, on, "left").drop(*(f"_{k}" for k in keys)), **parameters)


def _filled(out: DataFrame, **parameters) -> DataFrame:
    """Rows that no rollup was found for have one of themselves alone."""
    at = F.coalesce(parameters["seen"], parameters["collected"])
    fill = {"first_seen_at": at, "last_seen_at": at, "seen_count": F.lit(1), "source_count": F.lit(1), "all_sources": F.col(parameters.get("source", "source")), "price_fix_suspected": F.lit(False)}
    return out.withColumns({c: F.coalesce(c, v) for c, v in fill.items()})


KNOWN = ("first_seen_at", "last_seen_at", "seen_count", "source_count", "all_sources", "price_fix_suspected")


def by_item(df: DataFrame, item: Column, spread: Column) -> DataFrame:
    """Rows dealt by ``item``, those without one by ``spread``, and the text ``_p`` of that. Counts of an :class:`Observation` belong behind this
    step: where it hands on no row, the engine leaves out what is before it, and counts there are lost."""
    place = F.coalesce(F.when(item != "", item), F.concat(F.lit("\0"), spread.cast("string")))
    return df.withColumn("_p", place).repartition("_p")


def gathered(df: DataFrame, *, event: str, order: list[str], offered: Column, at: Column, **parameters) -> DataFrame:
    """Of equal events (``event``) the last by ``order``, each with the rollup of its league and item as by :func:`reconcile`, and ``is_latest``:
    whether it is the row of :func:`latest_per_item` among rows that are ``offered``, by the time ``at`` and the event.

    ``df`` is dealt :func:`by_item`, and equal events have the same item. So whole rows are shuffled once: what is taken out, summed up and
    looked up here is of one item, and stays where it is. Nothing holds an item's rows, but one task goes through them."""
    last = F.max_by(F.struct(*(c for c in df.columns if c not in ("_p", event))), F.struct(*order)).alias("_row")
    events = df.groupBy("_p", event).agg(last).select("_p", event, "_row.*")
    rolled = rollup(events, keys=("league", "item_id", "_p"), also={"_best": F.max(F.when(offered, F.struct(at.isNull().alias("bad"), at.alias("at"), F.col(event).alias("event"))))}, **parameters)
    entry = F.struct(F.struct("league", "item_id"), F.struct(*(F.col("source" if c == "all_sources" else c).alias(c) for c in KNOWN)))
    items = rolled.groupBy(F.col("_p").alias("_item")).agg(F.map_from_entries(F.collect_list(F.when(F.coalesce("item_id", F.lit("")) != "", entry))).alias("_known"), F.max("_best")["event"].alias("_latest"))
    out = events.join(items, F.col("_p") == F.col("_item"), "left").withColumn("_known", F.try_element_at("_known", F.struct("league", "item_id")))
    latest = F.coalesce(offered & (F.col("_p").startswith("\0") | (F.col(event) == F.col("_latest"))), F.lit(False))
    return _filled(out.withColumns({c: F.col(f"_known.{c}") for c in KNOWN} | {"is_latest": latest}), **parameters).drop("_p", "_item", "_known", "_latest")


def aged(df: DataFrame, indexed: str, collected: str, scale: float = 1.0) -> DataFrame:
    age = L.age_seconds(F.col(indexed), F.col(collected)) / scale
    return df.withColumn("listing_age_seconds", age).withColumn("freshness_band", L.freshness_band(F.col("listing_age_seconds")))


def layer_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows read and kept, and the share that de-duplication removed."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    both = n(before, "rows_read").join(n(after, "rows_kept"))  # two single rows
    return both.withColumn("dedup_rate", F.round(1 - F.col("rows_kept") / F.greatest("rows_read", F.lit(1)), 4))


def even_sample(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """At most n rows of each key, at evenly spaced places of their order, first and last included.

    Values of the first order column are counted for each key and summed up in shares of bounded size (:mod:`shared`). Only values
    at a wanted place send rows on to be ranked, again in shares, so neither a hot key nor a hot value is in one task."""
    first, *rest = order
    value = F.struct(F.col(key).alias("k"), F.col(first).alias("v"))  # nulls inside a struct meet in groups and joins
    counts = df.groupBy(value.alias("_value")).agg(F.count("*").alias("_c"))
    counts = with_running(counts, F.struct("_value.k"), [F.col("_value.v")], "_c", "even-values")
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(i / max(1, n - 1) * (F.col("_n") - 1)).cast("long"))
    places = F.array_distinct(F.filter(places, lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto"))))
    wanted = counts.select("_value", (F.col("_upto") - F.col("_c")).alias("_below"), places.alias("_places")).filter(F.size("_places") > 0)
    out = df.withColumn("_value", value).join(wanted, "_value").withColumn("_one", F.lit(1))
    out = with_running(out, F.col("_value"), [F.col(c) for c in (rest or order)], "_one", "even-ties")
    return out.filter(F.array_contains("_places", F.col("_upto") - 1 + F.col("_below"))).select(*df.columns)
