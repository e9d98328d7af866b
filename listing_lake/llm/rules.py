"""Quality rules, in DataFrame functions only: counted base rules, and a hashed n-gram log-likelihood ratio.

Words are runs of other characters than ASCII's white space. Words and word pairs are hashed to ``2**bits`` buckets. Two
multinomials over the buckets are counted over all rows: the trusted target (rows whose id is labelled good) and the raw
corpus (every row, the trusted ones too). Their pseudo-counts are in proportion to their sizes, so an n-gram that says nothing
has the ratio zero. A bucket's ratio is the difference of the two log probabilities, in whole millionths, so sums are exact
and a verdict doesn't hang on the order of an addition. A text's score is the sum of its
n-grams' ratios divided by their number; the text is kept if that is at least ``least``, the same for every text and without
a draw. The ratios are ``2**bits`` numbers whatever the input; they come to the tasks as one array.

Counts combine in the tasks before they are shuffled, and scoring is row by row, so no source or copied text is a group. The
ids of the trusted rows are broadcast only up to BROADCAST_IDS of them; beyond, they are joined by a shuffle.

Null and empty texts have no words: all counts are zero, the score is zero, and the base rules drop them. Without a trusted
row all ratios are zero, and the base rules alone decide. Of rows that repeat a label's id, one good label makes the id
trusted; rows of an id that repeats all count. Null ids are never trusted. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.llm import sqltext
from listing_lake.llm.common import whole, written

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Anything but the counted symbols.
OTHERS = "[^#*$%&|<>]+"
BROADCAST_IDS = 1_000_000
#: Ratios are kept in whole millionths.
UNIT = 1_000_000


def words(text: Column) -> Column:
    """The words in order, repeats included."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` looks into it at many places."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def coded(ws: Column, bits: int) -> Column:
    """One long for each word: its bucket below, and 32 bits up that of the pair it begins, ``2**bits`` behind the last word. Both
    come from the words' CRC-32."""
    low = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))

    def every(ns: Column) -> Column:
        pair = lambda n, i: F.coalesce(low(n * 31 + F.get(ns, i + 1)), F.lit(1 << bits).cast("long"))
        return F.transform(ns, lambda n, i: low(n) + F.shiftleft(pair(n, i), 32))

    return let(F.transform(ws, lambda w: F.crc32(w.cast("binary"))), every)


def word_bucket(code: Column, bits: int) -> Column:
    return code.bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")


def pair_bucket(code: Column) -> Column:
    return F.shiftright(code, 32).cast("int")


def windows(ws: Column) -> Column:
    """A 64-bit hash of every window of three words."""

    def every(ns: Column) -> Column:
        first = F.slice(ns, F.lit(1), F.greatest(F.size(ns) - 2, F.lit(0)))
        return F.transform(first, lambda n, i: F.xxhash64(n, F.get(ns, i + 1), F.get(ns, i + 2)))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), every)


def repeated_words(hashes: Column) -> Column:
    """Words inside windows of three words that occur twice or more. Windows are known by 64-bit hashes. They are sorted with their
    places; neighbours that are equal give places, and each place covers up to three words until the next. Texts whose windows
    are all different skip the sort."""

    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda xs, x, k: F.coalesce(F.get(xs, k)["h"] == x["h"], F.lit(False))
    again = let(order, lambda xs: F.filter(xs, lambda x, k: same(xs, x, k - 1) | same(xs, x, k + 1)))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    reach = let(places, lambda at: F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda acc, n: acc + n)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0).cast("long"))


def counted(rows: DataFrame) -> DataFrame:
    """Adds the columns of the base rules to rows with ``_text`` and its words ``_ws``."""
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = rows.withColumns({"_windows": windows(F.col("_ws")), "_lines": lines})
    return rows.withColumns({
        "n_words": F.size("_ws").cast("long"),
        "word_chars": F.length(F.array_join("_ws", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_text", OTHERS, "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_windows")),
    }).drop("_windows", "_lines")


def trusted(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``_text`` and ``_good`` of every row."""
    good = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_of")).distinct()
    if good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.join(good, F.col("_id") == F.col("_of"), "left").select("_text", F.col("_of").isNotNull().cast("long").alias("_good"))


def ratios(rows: DataFrame, *, bits: int, smooth: float) -> DataFrame:
    """``bucket`` and ``ratio`` (whole millionths) of every bucket that occurs, from ``_text`` and ``_good``."""
    codes = rows.select("_good", F.explode(coded(words(whole(F.col("_text"))), bits)).alias("c"))
    both = F.array(word_bucket(F.col("c"), bits), pair_bucket(F.col("c")))
    grams = codes.select("_good", F.explode(both).alias("bucket")).filter(F.col("bucket") < 1 << bits)
    counts = written(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_good").alias("target")), "rules-counts")
    raw, target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()
    ratio = F.log((F.col("target") + smooth) / (F.col("raw") * F.lit(target / max(raw, 1)) + smooth))
    return counts.select("bucket", F.round(ratio * UNIT if target else F.lit(0.0)).cast("long").alias("ratio"))


def table_of(found: DataFrame, bits: int) -> Column:
    """The ratios as one array by bucket, zero where a bucket does not occur and for the bucket of no pair. So the one task that
    makes it reads ``2**bits`` rows and one, whatever the input."""
    every = found.sparkSession.range((1 << bits) + 1).join(found, F.col("id") == F.col("bucket"), "left")
    row = every.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("ratio", F.lit(0)).alias("ratio")))).alias("r"))
    return row.select(F.col("r.ratio").alias("r")).scalar()


def judge(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = 16,
    smooth: float = 4.0, least: float = -0.14, min_words: int = 50, max_repeated: float = 0.5,
) -> DataFrame:
    """One row per input row: the id, the base counts, ``base_failed``, ``llr`` (per n-gram) and ``kept``."""
    found = ratios(trusted(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col), bits=bits, smooth=smooth)
    rows = docs.select(F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text")).withColumn("_ws", words(F.col("_text")))
    rows = counted(rows).withColumns({"_codes": coded(F.col("_ws"), bits), "_ratios": table_of(found, bits)})
    ratio = lambda bucket: F.get("_ratios", bucket)
    total = F.aggregate("_codes", F.lit(0).cast("long"), lambda acc, c: acc + ratio(word_bucket(c, bits)) + ratio(pair_bucket(c)))
    told = rows.withColumn("total", total).drop("_text", "_ws", "_codes", "_ratios")
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeated) * F.col("n_words"))
    told = told.withColumns({"base_failed": failed, "llr": F.col("total") / F.greatest(grams, F.lit(1)) / UNIT})
    kept = ~F.col("base_failed") & (F.col("total") >= F.lit(round(least * UNIT)) * grams)
    return told.withColumn("kept", kept).drop("total").withColumnRenamed("_id", id_col)


def digest(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The contract's columns, and the score."""
    return judge(docs, labels, **parameters)


def oracle(bits: int = 16, smooth: float = 4.0, least: float = -0.14) -> str:
    """The same in SQL. Checksums are worked out for each distinct n-gram."""
    return f"""
WITH
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) IS TRUE AS good FROM documents),
w AS (SELECT r, doc_id, t, good, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
spots AS (SELECT r, good, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
coded AS (SELECT w, {sqltext.crc32("w")} AS n FROM (SELECT DISTINCT ws[i] AS w FROM spots) x),
numbered AS (SELECT r, good, i, n FROM spots JOIN coded ON w = ws[i]),
grams AS (SELECT r, n & {(1 << bits) - 1} AS bucket, good FROM numbered UNION ALL
  SELECT a.r, (a.n * 31 + b.n) & {(1 << bits) - 1}, a.good FROM numbered a JOIN numbered b ON a.r = b.r AND b.i = a.i + 1),
counts AS (SELECT bucket, count(*) AS raw, count(*) FILTER (good) AS target FROM grams GROUP BY bucket),
ratio AS (SELECT bucket, CASE WHEN (SELECT sum(target) FROM counts) = 0 THEN 0 ELSE
    round(ln((target + {smooth}::DOUBLE) / (raw * (SELECT sum(target)::DOUBLE / sum(raw)::DOUBLE FROM counts) + {smooth}::DOUBLE)) * {UNIT})::BIGINT END AS ratio FROM counts),
score AS (SELECT r, sum(ratio)::BIGINT AS total FROM grams JOIN ratio USING (bucket) GROUP BY r),
windows AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM spots WHERE i + 2 <= len(ws)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) y WHERE n > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) z GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
told AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(total, 0)::BIGINT AS total
  FROM w JOIN lines USING (r) LEFT JOIN repeated USING (r) LEFT JOIN score USING (r)),
ruled AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(2 * n_words - 1, 0) AS n FROM told)
SELECT doc_id, n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  total / greatest(n, 1) / {UNIT} AS llr, NOT base_failed AND total >= {round(least * UNIT)} * n AS kept FROM ruled
"""
