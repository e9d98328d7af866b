"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found row by row. Their value hashes are then counted over the whole corpus by distinct repositories and
distinct owners: a value that many owners hold is a copied example, one that few hold looks live. Values are compared by
SHA-256 only and never leave the row that holds them.

Null or empty texts have no spans. A null owner or repository counts as one owner or repository of its own. Repeated rows
count once in the frequencies and come back as often as they came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.llm.common import whole, written

#: Kinds in the order in which spans that start together are listed; pattern, group that holds the value, least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (ASSIGN, 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "opaque": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
SPAN = "array<struct<start:bigint,end:bigint,rank:int,kind:string,hash:string>>"


def matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of one kind as spans in code points. The pieces between matches come from
    ``split`` by the same pattern, so their lengths and those of the matches add up to the places."""
    pattern, group, least = KINDS[kind]
    rank = list(KINDS).index(kind)
    rows = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(
            start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"), F.sha2(x["value"].cast("binary"), 256).alias("hash"),
        )
        wanted = F.length(x["value"]) >= least
        if kind == "opaque":
            wanted = wanted & x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
        kept = F.when(wanted, F.array(span)).otherwise(F.array().cast(SPAN))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], kept).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(rows, start, step)["out"]).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_base`` (spans of the base kinds) and ``_more`` (opaque tokens that touch no base span)."""
    text = whole(F.col(text_col))
    docs = docs.withColumn("_base", F.array_sort(F.concat(*(matches(text, k) for k in BASE))))
    docs = docs.withColumn("_more", matches(text, "opaque"))
    clear = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return docs.withColumn("_more", F.filter("_more", clear))


def ownership(found: DataFrame, owner_col: str, repo_col: str) -> DataFrame:
    """Per candidate hash: distinct owners and repositories. Every step combines before it shuffles, so a value that a
    third of the corpus holds costs a row for each task, owner and repository, not a group."""
    each = found.select(
        F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
        F.explode(F.array_distinct(F.transform(F.concat("_base", "_more"), lambda s: s["hash"]))).alias("hash"),
    ).distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def marked(docs: DataFrame, *, text_col: str, owner: Column, repo: Column, max_owners: int, max_repos: int, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of every row with its ``_base`` spans (each with ``live``) and ``_spans`` (base spans and the opaque
    tokens that look live). Rows with spans meet the rare hashes by a key of their text: equal texts have equal spans, and what
    is rare depends on the hash alone, so neither repeated ids nor rows without spans form a group."""
    found = find(docs.withColumns({"_owner": owner, "_repo": repo, "_key": F.xxhash64(text_col)}), text_col)
    found = written(found.select(*keep, "_owner", "_repo", "_key", "_base", "_more"), "secrets-found")
    some, none = F.size("_base") + F.size("_more") > 0, F.array().cast("array<string>")
    rare = ownership(found.filter(some), "_owner", "_repo").filter((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))
    held = found.filter(some).select("_key", F.explode(F.concat("_base", "_more")["hash"]).alias("hash")).distinct()
    live = written(held.join(rare.select("hash"), "hash").groupBy("_key").agg(F.collect_set("hash").alias("_live")), "secrets-live")
    both = found.filter(some).join(live, "_key", "left").withColumn("_live", F.coalesce("_live", none))
    both = both.select(*found.columns, "_live").unionByName(found.filter(~some).withColumn("_live", none))
    told = lambda spans: F.transform(spans, lambda s: s.withField("live", F.array_contains("_live", s["hash"])))
    both = both.withColumn("_base", told(F.col("_base")))
    return both.select(*keep, "_base", F.array_sort(F.concat("_base", F.filter(told(F.col("_more")), lambda s: s["live"]))).alias("_spans"))


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
    max_owners: int = 2, max_repos: int = 20,
) -> DataFrame:
    """One row per input row: the id, ``base`` and ``spans`` (base spans and the opaque tokens that look live), each span
    with ``live`` (at most ``max_owners`` owners and ``max_repos`` repositories hold its value)."""
    columns = {"_id": F.col(id_col), "_of": F.col(owner_col), "_in": F.col(repo_col), "_text": F.col(text_col)}
    rows = docs.select(*(c.alias(k) for k, c in columns.items()))
    out = marked(rows, text_col="_text", owner=F.col("_of"), repo=F.col("_in"), max_owners=max_owners, max_repos=max_repos, keep=("_id",))
    return out.select(F.col("_id").alias(id_col), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def redact(
    docs: DataFrame, *, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = 2, max_repos: int = 20,
    mark: str = "[secret]",
) -> DataFrame:
    """Replace every span's characters by ``mark`` in the row that holds it; overlapping spans become one mark. Rows without
    spans stay as they are. Texts go to the shared folder with their spans; only rows with spans are shuffled."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.col("_text").substr((acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        more = F.when(fresh, F.array(gap, F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    def finish(acc: Column) -> Column:
        rest = F.col("_text").substr((acc["at"] + 1).cast("int"), F.lit(2147483647))
        return F.concat(F.array_join(acc["out"], ""), rest)

    others = [c for c in docs.columns if c != text_col]  # as one struct, so no column's name can clash
    rows = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("_row"), F.col(text_col).alias("_text"))
    both = marked(rows, text_col="_text", owner=F.col(f"_row.{owner_col}"), repo=F.col(f"_row.{repo_col}"), max_owners=max_owners, max_repos=max_repos, keep=("_row", "_text"))
    masked = F.when(F.size("_spans") == 0, F.col("_text")).otherwise(F.aggregate("_spans", start, step, finish))
    return both.select(*(masked.alias(c) if c == text_col else F.col(f"_row.{c}").alias(c) for c in docs.columns))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, **parameters) -> DataFrame:
    """The contract's columns, and how many spans look live."""
    scanned = scan(docs, **parameters)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def _sql_spans(kind: str) -> str:
    pattern, group, least = KINDS[kind]
    pattern = pattern.replace("'", "''")
    rank = list(KINDS).index(kind)
    more = "AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')" if kind == "opaque" else ""
    return f"""
      SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, v, s AS "start", s + length(h) AS "end" FROM (
        SELECT doc_id, source, hit[i] AS h, value[i] AS v,
               list_sum(list_transform(gap[1:i], lambda x: length(x)))::BIGINT
               + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
        FROM (SELECT doc_id, source, hit, value, gap, unnest(range(1, len(hit) + 1)) AS i FROM (
          SELECT doc_id, source, regexp_extract_all(t, '{pattern}', 0) AS hit, regexp_extract_all(t, '{pattern}', {group}) AS value,
                 regexp_split_to_array(t, '{pattern}') AS gap FROM d WHERE regexp_matches(t, '{pattern}')) a) b) c
      WHERE length(v) >= {least} {more}"""


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_sql_spans(k) for k in BASE)}),
opaque AS (SELECT * FROM ({_sql_spans("opaque")}) o
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b."start" < o."end" AND o."start" < b."end")),
own AS (SELECT v, count(DISTINCT source) + max((source IS NULL)::INTEGER) AS owners, count(DISTINCT doc_id) + max((doc_id IS NULL)::INTEGER) AS repos
  FROM (SELECT doc_id, source, v FROM base UNION ALL SELECT doc_id, source, v FROM opaque) u GROUP BY v),
marked AS (
  SELECT b.*, true AS is_base, owners <= 2 AND repos <= 20 AS live FROM base b JOIN own USING (v)
  UNION ALL SELECT o.*, false, true FROM opaque o JOIN own USING (v) WHERE owners <= 2 AND repos <= 20),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
  coalesce(string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) FILTER (is_base), '') AS base,
  string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) AS spans FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live
FROM d LEFT JOIN per USING (doc_id)
"""
