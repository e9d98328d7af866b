"""Merkle dataset manifest as postorder append logs.

Every row is a leaf; each group (source) has a tree of runs of ARITY nodes, and the groups' subroots have one more. A tree's log
holds its nodes in the order in which they are complete: a node stands behind the last of its children. Subtrees are aligned, so
where a node stands follows from its level and number alone (``position``): all subtrees before it are full, and their sizes
add up. Builders take aligned blocks of ``ARITY**step`` neighbours of one level, each a group of its own, and write ``step`` levels
of the log above them; the tops of the blocks are the next stage's neighbours. Proofs go the other way: from the top, each
stage reads its blocks of the log, finds every node's siblings by their positions, and hands what is above down to the block
below. So no task holds more than a block, whatever the size of a group, and a stage is one shuffle of narrow rows.

Leaves are numbered by a range sort, rows counted for each range and group, and sums of these counts: no group is in one task.

Null values are leaves' values like others (``-``), and a null group comes first. A null id comes first in its group and counts as
the empty text where a checksum of it is asked for. Rows that repeat an id lie by their leaf; rows alike in all fields have
equal leaves and any order among themselves. A group of one row has that leaf as subroot; one group's subroot is the root. No
rows, no result. Other columns have no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listing_lake.llm import sqltext
from listing_lake.llm.common import written

#: Children of a node, and levels in a stage.
ARITY, STEP = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def nodes_at(level: int, leaves: int) -> int:
    return -(-leaves // ARITY**level)


def height(leaves: int) -> int:
    """The root's level."""
    h = 0
    while nodes_at(h, leaves) > 1:
        h += 1
    return h


def position(level: int, number: int, leaves: int) -> int:
    """A node's place in the log of a tree of so many leaves: what is complete before its first leaf, and its subtree's size. The
    subtrees before are full; its own may end early."""
    first = number * ARITY**level
    held = min(ARITY**level, leaves - first)
    before, x = 0, first
    while x:
        before += x
        x //= ARITY
    return before + sum(nodes_at(k, held) for k in range(level + 1)) - 1


def entry(value: Column) -> Column:
    """One field of a leaf: its bytes' number and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*map(entry, columns.values())).cast("binary"), 256)


def numbered(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Adds ``i``, a row's place in its ``tree`` by the columns ``order``, and ``n``, the tree's rows. A table sorted by ranges is
    written once; each range counts its rows of each tree, and sums of the counts give where they begin."""
    sorted_rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    there = written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), label)
    there = there.withColumn("_part", F.shiftright("_at", 33))
    held = there.groupBy("tree", "_part").agg(F.count("*").alias("_held"), F.min("_at").alias("_first"))
    by_part = W.partitionBy("tree").orderBy("_part")
    before = F.coalesce(F.sum("_held").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begin = held.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_held").over(W.partitionBy("tree")).alias("n"))
    return there.join(begin, ["tree", "_part"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


LOG = "tree string, n long, stage int, block long, level int, i long, pos long, digest string, id string, changed string"


def builder(stage: int, step: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Writes the log of one aligned block: its neighbours (only in the first stage; others' are in the log) and the nodes above
    them, each as soon as it is complete."""
    base = step * stage

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        tree, n = key[0], int(rows["n"].iloc[0])
        top = min(height(n), base + step)
        runs: list[list[str]] = [[] for _ in range(step)]
        out = []

        def append(level: int, i: int, digest: str, name: str | None = None, changed: str | None = None) -> None:
            out.append((tree, n, level // step, i // ARITY ** (step - level % step), level, i, position(level, i, n), digest, name, changed))

        for i, digest, *own in zip(*(rows[c].tolist() for c in ("i", "digest", "id", "changed")), strict=True):
            if not stage:
                append(0, i, digest, *own)
            level = base
            while level < top:
                runs[level - base].append(digest)
                if (i + 1) % ARITY and i + 1 < nodes_at(level, n):
                    break
                digest = digest_of("".join(runs[level - base]))
                runs[level - base].clear()
                level, i = level + 1, i // ARITY
                append(level, i, digest)
        return pd.DataFrame(out, columns=[x.split()[0] for x in LOG.split(", ")])

    return build


def stages_of(rows: DataFrame, step: int = STEP) -> int:
    """How many stages the largest tree takes."""
    n = rows.agg(F.max("n")).first()[0]
    return max(1, -(-height(n) // step)) if n else 0


def climb(leaves: DataFrame, stages: int, label: str, step: int = STEP) -> DataFrame:
    """The log of all trees, from ``tree``, ``i``, ``n``, ``digest``, and a leaf's ``id`` and ``changed`` digest."""
    logs, nodes = [], leaves
    for stage in range(stages):
        blocks = nodes.select("tree", "i", "n", "digest", "id", "changed", F.expr(f"i div {ARITY**step}").alias("block"))
        logs.append(written(blocks.groupBy("tree", "block").applyInPandas(builder(stage, step), LOG), label))
        top = step * (stage + 1)
        nodes = logs[-1].filter((F.col("level") == top) & (F.col("n") > ARITY**top))
    return reduce(DataFrame.unionByName, logs)


def roots(log: DataFrame) -> DataFrame:
    """``tree``, ``n`` and the digest of each tree's root: the one node at its level."""
    return log.filter(F.col("i") == 0).groupBy("tree", "n").agg(F.max_by("digest", "level").alias("digest"))


PATH = "tree string, block long, path string, subroot string, root string"
PROOF = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def sides(stage: int, step: int, nodes: pd.DataFrame, above: str) -> list[tuple[int, str, str | None, str | None, list[str]]]:
    """Of each node at the stage's lowest level: number, digest, id, changed digest and its path, level by level ``left,right``: the siblings'
    digests before and behind it. Siblings are found by their positions in the log."""
    base, n = step * stage, int(nodes["n"].iloc[0])
    top = min(height(n), base + step)
    at = dict(zip(nodes["pos"].tolist(), nodes["digest"].tolist(), strict=True))
    known: dict[tuple[int, int], list[str]] = {}

    def path(level: int, i: int) -> list[str]:
        if level == top:
            return [above] if above else []
        if (level, i) not in known:
            run = range(i - i % ARITY, min(i - i % ARITY + ARITY, nodes_at(level, n)))
            found, rest = [at[position(level, k, n)] for k in run], path(level + 1, i // ARITY)
            for k in run:
                known[level, k] = ["".join(found[: k - run[0]]) + "," + "".join(found[k - run[0] + 1 :]), *rest]
        return known[level, i]

    low = nodes[nodes["level"] == base]
    own = zip(*(low[c].tolist() for c in ("i", "digest", "id", "changed")), strict=True)
    return [(i, *rest, path(base, i)) for i, *rest in own]


def fold(digest: str, path: str) -> str:
    """The root that a leaf's digest and its path lead to."""
    for level in path.split(";") if path else ():
        left, right = level.split(",")
        digest = digest_of(left + digest + right)
    return digest


def downward(stage: int, step: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def paths(key: tuple, nodes: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(nodes) and len(came):
            up = came.iloc[0]
            out = [(key[0], i, ";".join(p), up["subroot"], up["root"]) for i, *_, p in sides(stage, step, nodes, up["path"])]
        return pd.DataFrame(out, columns=[x.split()[0] for x in PATH.split(", ")])

    return paths


def prover(step: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def prove(key: tuple, nodes: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(nodes) and len(came):
            up = came.iloc[0]
            for _, leaf, name, changed, path in sides(0, step, nodes, up["path"]):
                text = ";".join(path)
                siblings = text.replace(",", "").replace(";", "")
                folded = fold(leaf if changed is None else changed, text)
                out.append((name, leaf, up["subroot"], up["root"], digest_of(siblings), folded))
        return pd.DataFrame(out, columns=[x.split()[0] for x in PROOF.split(", ")])

    return prove


def starts_of(tops: DataFrame, stage: int, step: int) -> DataFrame:
    """The trees whose root a stage's only block reaches."""
    low = F.lit(stage == 0) | (F.col("n") > ARITY ** (step * stage))
    return tops.filter(low & (F.col("n") <= ARITY ** (step * (stage + 1)))).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")


def descend(log: DataFrame, tops: DataFrame, stages: int, least: int, step: int) -> DataFrame | None:
    """Paths of the nodes at level ``step * least``, as PATH with their number as ``block``, and of the trees that begin there.
    ``tops``: tree, n, path, subroot and root of each tree."""
    paths = None
    for stage in range(stages - 1, least - 1, -1):
        begin = starts_of(tops, stage, step)
        paths = begin if paths is None else paths.unionByName(begin)
        nodes = log.filter(F.col("stage") == stage).groupBy("tree", "block")
        paths = nodes.cogroup(paths.groupBy("tree", "block")).applyInPandas(downward(stage, step), PATH)
    return paths


def proofs(
    docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None,
    changes: Column | None = None, step: int = STEP,
) -> DataFrame:
    """One row per input row: the id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of its siblings, level by level), and
    ``folded_root``: what the row's leaf and its siblings lead to. Where ``changes`` is true, that leaf is worked out with the
    columns ``changed`` in place of the row's own."""
    columns = {f: F.col(f) for f in fields}
    other = F.when(changes, leaf_of(columns | changed)) if changes is not None and changed else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf_of(columns).alias("digest"), other.alias("changed"))
    rows = written(rows.withColumn("salt", F.monotonically_increasing_id()), "merkle-leaves")
    placed = numbered(rows, ["id", "digest", "salt"], "merkle-sorted")
    stages = stages_of(placed, step)
    kind = docs.schema[id_col].dataType
    if not stages:
        return docs.sparkSession.createDataFrame([], PROOF).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
    log = climb(placed.withColumn("id", F.col("id").cast("string")), stages, "merkle-log", step)
    # the tree over the groups: its leaves are their subroots, known by number
    groups = roots(log).select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("n").alias("leaves"), "digest", F.col("tree").alias("id"), F.lit(None).cast("string").alias("changed"))
    groups = written(numbered(groups, ["group"], "merkle-groups"), "merkle-groups")
    upper_stages = stages_of(groups, step)
    upper = climb(groups, upper_stages, "merkle-upper", step)
    root = roots(upper).select("tree", "n", F.lit("").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    down = descend(upper, root, upper_stages, 0, step).select(F.col("block").alias("i"), "path", "root")
    tops = groups.join(down, "i").select(F.col("group").alias("tree"), F.col("leaves").alias("n"), "path", F.col("digest").alias("subroot"), "root")
    tops = written(tops, "merkle-tops")
    paths = starts_of(tops, 0, step)
    if stages > 1:
        paths = paths.unionByName(descend(log, tops, stages, 1, step))
    found = log.filter("stage = 0").groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInPandas(prover(step), PROOF)
    return found.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(docs: DataFrame, **parameters) -> DataFrame:
    """The contract's columns: where 5 divides an id's checksum, the text's capitals were changed after the manifest was made."""
    changes = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    told = proofs(docs, changed={"text": F.translate("text", UPPER, LOWER)}, changes=changes, **parameters)
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def entry_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column} END"


def oracle(levels: int = 6, upper: int = 4) -> str:
    """The same in SQL, level by level, for groups of up to ``16**levels`` rows and up to ``16**upper`` groups."""

    def tree(t: str, height: int) -> list[str]:
        out = []
        for k in range(height):
            out.append(f"{t}{k + 1} AS (SELECT g, i // 16 AS i, (n + 15) // 16 AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {t}{k} WHERE n > 1 GROUP BY g, i // 16, n)")
            side = "coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i {} a.i), '')"
            out.append(
                f"{t}s{k} AS (SELECT a.g, a.i, {side.format('<')} AS l, {side.format('>')} AS r FROM {t}{k} a JOIN {t}{k} b ON a.g = b.g AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY a.g, a.i)"
            )
        return out

    def folded(p: str, t: str, height: int) -> list[str]:
        step = "{p}{m} AS (SELECT x.row, x.g, x.i // 16 AS i, path || coalesce(l || r, '') AS path, CASE WHEN l IS NULL THEN d ELSE sha256(l || d || r) END AS d FROM {p}{k} x LEFT JOIN {t}s{k} s ON s.g = x.g AND s.i = x.i)"
        return [step.format(p=p, t=t, k=k, m=k + 1) for k in range(height)]

    leaf = "sha256(" + " || ".join(entry_sql(c) for c in FIELDS) + ")"
    other = "sha256(" + " || ".join(entry_sql(c) for c in FIELDS[:-1]) + " || " + entry_sql(f"translate(text, '{UPPER}', '{LOWER}')") + ")"
    parts = [
        f"""d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS g, {leaf} AS leaf,
  CASE WHEN {sqltext.crc32("coalesce(doc_id::VARCHAR, '')")} % 5 = 0 THEN {other} ELSE {leaf} END AS given FROM documents)""",
        "t0 AS (SELECT row, given, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS d FROM d)",
        *tree("t", levels),
        "subs AS (" + " UNION ALL ".join(f"SELECT g, d FROM t{k} WHERE n = 1" for k in range(levels + 1)) + ")",
        "u0 AS (SELECT g AS of, 1 AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, d FROM subs)",
        *tree("u", upper),
        "top AS (" + " UNION ALL ".join(f"SELECT d FROM u{k} WHERE n = 1" for k in range(upper + 1)) + ")",
        "p0 AS (SELECT row, g, i, '' AS path, given AS d FROM t0)",
        *folded("p", "t", levels),
        f"q0 AS (SELECT row, u0.g, u0.i, path, p.d FROM p{levels} p JOIN u0 ON u0.of = p.g)",
        *folded("q", "u", upper),
    ]
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subs.d AS subroot, top.d AS root, sha256(path) AS proof_sha256, q.d AS folded_root, q.d = top.d AS verified
FROM d JOIN subs USING (g) JOIN q{upper} q USING (row), top"""
    )
