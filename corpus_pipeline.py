"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, secret scan, best-fit packing.

Every stage reads all that the one before it kept, and its decisions take effect: documents of no language go, one document
of each near-duplicate class stays, documents that hold a benchmark item go, secrets are masked in the text, and the rest
is packed. All stages but the last return the columns of ``documents``. A clean document passes every filter unchanged, but
for ``lang`` where that was null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listing_lake.llm import decontaminate, language, packing, secret_scan, simhash
from listing_lake.llm.common import crc_mod, table, written
from listing_lake.llm.queries import vocabulary

#: Below this score a language is a guess between several, and the document is rejected.
LEAST_LANGUAGE_SCORE = 0.3


def rowed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that an operator reads, and all others as one struct ``_row``: no name of another column can clash."""
    return docs.select(F.struct(F.lit(0).alias("_"), *(c for c in docs.columns if c not in columns)).alias("_row"), *columns)


def unrowed(rows: DataFrame, docs: DataFrame, *columns: str, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them new."""
    old = lambda c: F.col(c if c in columns else f"_row.{c}")
    return rows.select(*(new.get(c, old(c)).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no language (null, or without a letter) and texts whose language is a guess."""
    model = language.learned(docs, crc_mod(F.col("doc_id"), 4) != 2)
    told = language.predict(rowed(docs, "text"), model)
    kept = told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return unrowed(kept, docs, "text", lang=F.coalesce("_row.lang", "lang_pred"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: a row of the id that names the class. Where rows of the class repeat that id, or have no
    id at all, the one whose content has the least hash stays, of rows alike in all columns one."""
    keys = ("_key", "_key2")
    keyed = rowed(docs).withColumns({k: F.xxhash64(F.lit(n), "_row", *(F.col(f"_row.{c}").isNull() for c in docs.columns)) for n, k in enumerate(keys)})
    kept = simhash.one_of_each(keyed, keys, id_col="_row.doc_id", text_col="_row.text")
    # copies alike in all columns go before the join, in the tasks that read them
    single = keyed.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_key"))).filter("_n = 1")
    return unrowed(single.join(kept, list(keys)), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontaminate.match(rowed(docs, "text"), table(spark, sf_dir, "benchmark"), leaks_col="_leaks")
    return unrowed(found.filter(F.size("_leaks") == 0), docs, "text")


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret span; ``n_chars`` follows the text where it changes."""
    names = ("text", "source", "doc_id")
    masked = secret_scan.redact(rowed(docs, *names).withColumn("before", F.length("text")))
    length = F.when(F.length("text") == F.col("before"), F.col("_row.n_chars")).otherwise(F.length("text").cast("long"))
    return unrowed(masked, docs, *names, n_chars=length)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 1024 tokens. The memo of ids is small, since the same workers have served the
    stages before."""
    return packing.digest(docs, tokenizer=vocabulary("byte_bpe_50k.json"), end_id=2, memo_entries=100_000)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_masking", secret_masking),
    ("best_fit_packing", best_fit_packing),
]

#: XXH64, learned models, edit distances and token ids are beyond SQL; the stages have brute-force tests instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
