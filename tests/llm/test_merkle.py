"""Merkle manifest: plain recursion on small tables, positions in the logs, odd rows."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from listing_lake.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    for level in tree[:-1]:
        begin = i - i % 16
        yield level[begin:i], level[i + 1 : begin + 16]
        i //= 16


def plain(rows):
    """The contract's rows by recursion; rows are doc_id, source, lang, n_chars, text."""
    groups = {}
    for row in rows:
        groups.setdefault((row[1] is not None, (row[1] or "").encode()), []).append(row)
    groups = {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k, v in sorted(groups.items())}
    trees = {k: levels([leaf(r) for r in v]) for k, v in groups.items()}
    top = levels([t[-1][0] for t in trees.values()])
    out = []
    for g, (k, members) in enumerate(groups.items()):
        for i, row in enumerate(members):
            given, siblings = leaf(row), []
            if zlib.crc32(str(row[0] if row[0] is not None else "").encode()) % 5 == 0 and row[4] is not None:
                given = leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for left, right in (*path(trees[k], i), *path(top, g)):
                siblings += left + right
                given = h("".join(left) + given + "".join(right))
            out.append((str(row[0]), leaf(row), trees[k][-1][0], top[-1][0], h("".join(siblings)), given, given == top[-1][0]))
    return sorted(out)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def got(docs, **parameters):
    return sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in merkle.digest(docs, **parameters).collect())


def rows_of(n):
    rows = [(i, f"s{i % 3}" if i % 7 else "hot", "en", i, f"Text {i} É" * (i % 4)) for i in range(n)]
    rows += [(5, None, None, None, None), (10, None, "fr", 1, "AbC"), (None, "hot", "en", 3, "No Id"), (2**53 + 1, "big", "x", 1, "B"), (2**53 + 2, "big", "x", 1, "B")]
    rows += [(3, "twice", "en", 1, "Same")] * 3 + [(3, "twice", "en", 1, "other"), (25, "", "en", 0, ""), (30, "Z", "en", 9, "long " * 30_000), (35, "é", "en", 2, "AZ")]
    return rows


@pytest.mark.parametrize(("step", "n"), [(3, 700), (1, 700), (2, 16)])
def test_proofs_are_those_of_plain_recursion(spark, step, n):
    """With one level a stage, trees take several stages and blocks."""
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS tree", "1 AS row", "2 AS digest", "3 AS id", "4 AS leaf").repartition(3)
    assert got(docs, step=step) == plain(rows)


def test_single_rows_and_none(spark):
    one = [(5, "a", "en", 1, "X")]
    assert got(spark.createDataFrame(one, SCHEMA)) == plain(one)
    two = [(5, "a", "en", 1, "X"), (6, "b", "en", 1, "Y")]
    assert got(spark.createDataFrame(two, SCHEMA)) == plain(two)
    none = merkle.digest(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns == ["doc_id", *COLUMNS]


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4096, 4097, 5000])
def test_positions_are_those_of_an_append_log(n):
    """What is complete is appended, from the leaves up; the closed form names its place."""
    at, count = 0, [0] * (merkle.height(n) + 1)
    for i in range(n):
        level, k = 0, i
        while True:
            assert merkle.position(level, k, n) == at
            at, count[level] = at + 1, count[level] + 1
            if level == merkle.height(n) or ((k + 1) % 16 and k + 1 < merkle.nodes_at(level, n)):
                break
            level, k = level + 1, k // 16
    assert at == sum(merkle.nodes_at(k, n) for k in range(merkle.height(n) + 1))


def test_log_is_gapless(spark):
    rows = [(i, "hot", "en", 1, "t") for i in range(4500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    leaves = docs.select(F.lit("=hot").alias("tree"), F.col("doc_id").alias("id"), F.sha2(F.col("doc_id").cast("string").cast("binary"), 256).alias("digest"), F.lit(None).cast("string").alias("changed"))
    placed = merkle.numbered(leaves, ["id"], "test").withColumn("id", F.col("id").cast("string"))
    log = merkle.climb(placed, merkle.stages_of(placed), "test")
    found = sorted((r.pos, r.level, r.i) for r in log.collect())
    assert [p for p, *_ in found] == list(range(4500 + 282 + 18 + 2 + 1))
    assert all(merkle.position(level, i, 4500) == p for p, level, i in found)
