"""Each stage keeps clean documents, takes out what it is there for, and returns the columns of documents."""

import corpus_pipeline
from listing_lake.llm.common import table

SF = "/root/testdata/sf0.01"
CLASHING = ("_lang", "lang_pred", "score", "_n", "_key", "_key2", "_row", "_leaks", "_base", "_spans", "_text", "fp", "first", "root", "_a", "_before")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    clean = docs.orderBy("doc_id").first().text
    rows = [
        (10**6, None, "en", "s", 0), (10**6 + 1, "12 !!", "en", "s", 5), (10**6 + 2, clean, "en", None, 1), (10**6 + 3, f"pre {item} post", None, "s", 2),
        (10**6 + 4, "Die und der ungeheitlich schverbeung. token=abcdefgh12345 enheitkeit", "de", "s", 68), (10**6 + 4, "Die und der ungeheitlich schverbeung. token=abcdefgh12345 enheitkeit", "de", "s", 68),
    ]
    docs = docs.unionByName(spark.createDataFrame(rows, SCHEMA)).repartition(3).selectExpr("*", *(f"'{c}' AS {c}" for c in CLASHING))
    at = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.written(stage(spark, at, SF), "test")
        assert at.columns == docs.columns
        seen[name] = {r.doc_id: r for r in at.collect()}
        assert all(r[c] == c for r in seen[name].values() for c in CLASHING)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert ids - seen["language_id"].keys() == {10**6, 10**6 + 1}
    first = seen["near_dedup"].keys()
    assert 10**6 + 2 not in first and 0 in first and len(first) < 950
    assert 10**6 + 3 in first and 10**6 + 3 not in seen["benchmark_decontamination"]
    masked = seen["secret_masking"][10**6 + 4]
    assert masked.text == "Die und der ungeheitlich schverbeung. [secret] enheitkeit" and masked.n_chars == len(masked.text)
    assert seen["secret_masking"].keys() == seen["benchmark_decontamination"].keys()
    packed = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert {r.doc_id for r in packed} == seen["secret_masking"].keys()


def test_nothing_in_nothing_out(spark):
    assert corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame([], SCHEMA), SF).collect() == []
    assert corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame([], SCHEMA), SF).collect() == []
    assert corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame([], SCHEMA), SF).collect() == []
    assert corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame([], SCHEMA), SF).collect() == []
    assert corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame([], SCHEMA), SF).collect() == []


def test_near_dedup_keeps_one_row_of_each_class(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    rows = [
        (None, text["a"], "en", "s", 1), (None, text["a"], "en", "t", 1), (None, text["a"], "en", "s", 1), (None, text["b"], "en", "s", 1),
        (7, text["c"], "en", "s", 1), (7, text["d"], "en", "s", 1), (8, text["c"], "en", "s", 1), (9, text["d"], None, "s", 1), (None, text["d"], "en", "s", 1),
        (3, text["e"], None, "x", 1), (3, text["e"], "x", None, 1), (3, None, "en", "s", 0),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    found = got.collect()
    want = [(None, text["a"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (3, text["e"]), (3, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in found))) == sorted(map(str, want))
    assert {tuple(r) for r in found} <= set(rows)
