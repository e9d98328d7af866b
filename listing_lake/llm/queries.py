"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from listing_lake.llm import bitplane, decontaminate, language, merkle, packing, quality, repair, rules, secret_scan, simhash, toxicity, url_graph, vptree
from listing_lake.llm.common import shared_dir, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_output(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/listing_lake/ids-{uuid.uuid4().hex}"
    return bitplane.digest(table(spark, d, "documents"), path, tokenizer=vocabulary("word_bpe_49k.json"), end_id=1)


QUERIES = {
    "op1_secret_scan": lambda spark, d: secret_scan.digest(table(spark, d, "documents")),
    "op2_quality": lambda spark, d: quality.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_simhash": lambda spark, d: simhash.digest(table(spark, d, "documents")),
    "op4_vptree": lambda spark, d: vptree.digest(table(spark, d, "embeddings")),
    "op5_language": lambda spark, d: language.digest(table(spark, d, "documents")),
    "op6_packing": lambda spark, d: packing.digest(table(spark, d, "documents"), tokenizer=vocabulary("byte_bpe_50k.json"), end_id=2),
    "op7_token_output": token_output,
    "op8_decontaminate": lambda spark, d: decontaminate.digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_url_graph": lambda spark, d: url_graph.judge(table(spark, d, "pages")),
    "op10_toxicity": lambda spark, d: toxicity.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op11_rules": lambda spark, d: rules.digest(table(spark, d, "documents"), table(spark, d, "labels")),
    "op12_merkle": lambda spark, d: merkle.digest(table(spark, d, "documents")),
    "op13_repair": lambda spark, d: repair.digest(table(spark, d, "conversations")),
}

ORACLES = {
    "op1_secret_scan": secret_scan.ORACLE,
    "op4_vptree": vptree.ORACLE,
    "op9_url_graph": url_graph.ORACLE,
    "op11_rules": rules.oracle(),
    "op12_merkle": merkle.oracle(),
    "op13_repair": repair.oracle(),
}
