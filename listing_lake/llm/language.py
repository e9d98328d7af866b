"""Language identification by hierarchical discrimination: first the family, then one-versus-one linear support vector
machines between the languages of that family.

Features are hashed character n-grams (one to three characters; letters in lower case, everything else as a space), each by
its share of the text. Every machine learns from a sample of at most ``per_lang`` labelled ids of each language, one text each
(those whose id hashes under that share of all; a family's machine from about 16 times as many in all), in a task of its own,
and comes back as one vector of ``2**bits`` weights. Of rows that repeat an id and language, the least text counts. Languages
outside ``FAMILIES`` are families of their own, so any set of labels works.

Null texts and texts without a letter are ``und`` with score 0; so is everything when nothing is labelled. The score is the
winning family's probability times the winning language's within it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from listing_lake.llm.common import crc_mod
from listing_lake.llm.textvec import blocks, kinds, lowered
from listing_lake.llm.tokens import forget

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
#: The learned languages, sorted, and the machines by name.
Model = tuple[list[str], dict[str, np.ndarray]]
ORDERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only-{lang}")


def grams(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and hashed places of all character n-grams, a block of texts at a time."""
    shift = np.uint64(64 - bits)
    for rows, places, parts in blocks(texts, context=2):
        codes = lowered()[np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = [len(p) + 1 for p in parts]
        letters = (kinds()[codes] == 1) & ~((codes >= 48) & (codes < 58))
        code = np.where(letters, codes, 32).astype(np.uint64)
        row, begin = np.repeat(np.asarray(rows), size), np.cumsum([0, *size[:-1]])
        # a gram ends in its part, behind what the part repeats of the one before it
        at = np.arange(len(code)) - np.repeat(begin, size)
        fresh = (at >= np.repeat(np.minimum(places, 2), size)) & (at < np.repeat(size, size) - 1)
        key = code * ORDERS[0]
        for k in range(3):
            if k:
                key = key[:-1] * ORDERS[k] + code[k:] * ORDERS[0]
            use = (letters[: len(key)] | letters[k:]) & fresh[k:] & (at[k:] >= k)
            mixed = key ^ (key >> np.uint64(31))
            yield row[: len(key)][use], ((mixed * ORDERS[2])[use] >> shift).astype(np.int64)


def machine(x: np.ndarray, y: np.ndarray, steps: int, penalty: float) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge loss, accelerated gradient); y is 1 or -1. The last column
    of x is 1, for the intercept. Classes count alike, however many texts they have. x is changed in place."""
    spread = x.std(axis=0) + np.float32(1e-4)
    spread[-1] = 1
    x /= spread  # in place: the texts' features are the largest thing in the task
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    bound = 2 * float(each @ np.einsum("ij,ij->i", x, x)) + penalty
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - ((-2 * each * y * slack) @ x + penalty * v) / bound
        v = new + k / (k + 3) * (new - w)
        w = new
    return w / spread


def train(labelled: DataFrame, *, bits: int = 12, per_lang: int = 400, steps: int = 150, penalty: float = 1e-3) -> Model:
    """``labelled``: _id, _text, _lang. One machine per family against the rest and per pair of languages in a family."""
    counts = {r[0]: r[1] for r in labelled.groupBy("_lang").count().collect()}
    langs, ring = sorted(counts), 1 << 30
    share = F.when(F.lit(False), F.lit(0))
    for lang in langs:
        share = share.when(F.col("_lang") == lang, F.lit(min(ring, per_lang * ring // counts[lang])))
    picked = labelled.filter(F.pmod(F.xxhash64("_id"), F.lit(ring)) < share)
    # one text for each id, and no more than ``per_lang`` ids of a language: those of least hash
    picked = picked.groupBy("_lang", "_id").agg(F.min("_text").alias("_text"))
    first = W.partitionBy("_lang").orderBy(F.pmod(F.xxhash64("_id"), F.lit(ring)), "_id")
    picked = picked.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_lang).drop("_n")
    of: dict[str, list[str]] = {}
    for lang in langs:
        of.setdefault(family(lang), []).append(lang)
    tasks = {f"family {f}": {x: 1 if x in of[f] else -1 for x in langs} for f in of} if len(of) > 1 else {}
    tasks |= {f"pair {a!r} {b!r}": {a: 1, b: -1} for some in of.values() for a, b in itertools.combinations(some, 2)}
    if not tasks:
        return langs, {}

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        pdf = pdf.sort_values(["_lang", "_id"])
        x = np.zeros((len(pdf), (1 << bits) + 1), np.float32)
        for row, place in grams(pdf["_text"].tolist(), bits):
            np.add.at(x, (row, place), 1)
        x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
        x[:, -1] = 1
        y = pdf["_lang"].map(tasks[key[0]]).to_numpy(np.float32)
        return pd.DataFrame({"task": [key[0]], "weights": [machine(x, y, steps, penalty).tolist()]})

    # a family's machine sees all languages: of many, a smaller share each
    part = {t: min(ring, 16 * ring // len(side)) for t, side in tasks.items()}
    sides = [F.struct(F.lit(t).alias("task"), F.lit(x).alias("lang"), F.lit(part[t]).alias("part")) for t, side in tasks.items() for x in side]
    mine = lambda s: (s["lang"] == F.col("_lang")) & (F.pmod(F.xxhash64("_id", F.lit("family")), F.lit(ring)) < s["part"])
    dealt = picked.withColumn("_task", F.explode(F.filter(F.array(*sides), mine)["task"]))
    found = dealt.select("_task", "_id", "_lang", "_text").groupBy("_task").applyInPandas(fit, "task string, weights array<double>")
    return langs, {r.task: np.array(r.weights) for r in found.collect()}


def predict(docs: DataFrame, model: Model, *, bits: int = 12, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``."""
    langs, machines = model
    names = sorted(machines)
    of: dict[str, list[str]] = {}
    for lang in langs:
        of.setdefault(family(lang), []).append(lang)
    matrix = np.stack([machines[n] for n in names]) if names else np.zeros((0, 1))
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def sure(margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-4 * np.clip(margin, -8, 8)))

    def apply(texts: pd.Series) -> pd.DataFrame:
        forget()
        w, rows = shared.value, texts.tolist()
        total, n = np.zeros((len(names), len(rows))), np.zeros(len(rows))
        if len(w):
            for row, place in grams(rows, bits):
                n += np.bincount(row, minlength=len(rows))
                for k in range(len(names)):
                    total[k] += np.bincount(row, w[k][place], len(rows))
            total = total / np.maximum(n, 1) + w[:, -1:]
        margin = dict(zip(names, total, strict=True))
        families = list(of)
        chance = np.stack([sure(margin[f"family {f}"]) if len(of) > 1 else np.ones(len(rows)) for f in families])
        chance /= chance.sum(axis=0)
        best, top = chance.argmax(axis=0), chance.max(axis=0)
        lang, share = np.empty(len(rows), object), np.ones(len(rows))
        for k, f in enumerate(families):
            votes, weight = np.zeros((len(of[f]), len(rows))), np.zeros((len(of[f]), len(rows)))
            for (i, a), (j, b) in itertools.combinations(enumerate(of[f]), 2):
                p = sure(margin[f"pair {a!r} {b!r}"])
                for at, q in ((i, p), (j, 1 - p)):
                    votes[at] += q > 0.5
                    weight[at] += q / max(1, len(of[f]) - 1)
            wins = (votes + weight / 2).argmax(axis=0) if len(of[f]) > 1 else np.zeros(len(rows), int)
            here = best == k
            lang[here] = np.array(of[f], object)[wins[here]]
            if len(of[f]) > 1:
                share[here] = weight[wins[here], np.flatnonzero(here)]
        return pd.DataFrame({"lang": lang, "score": top * share})

    if not langs:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    found = F.pandas_udf(apply, "lang string, score double")(F.col(text_col))
    has = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    told = docs.withColumn("_found", found)
    return told.select(
        *docs.columns, F.when(has, F.col("_found.lang")).otherwise("und").alias("lang_pred"), F.when(has, F.col("_found.score")).otherwise(0.0).alias("score")
    )


def learned(docs: DataFrame, learn: Column, **parameters) -> Model:
    """Languages and machines from the rows of ``docs`` that ``learn`` allows and whose lang and text are known."""
    usable = learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    return train(docs.filter(usable).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang")), **parameters)


def digest(docs: DataFrame, **parameters) -> DataFrame:
    """The contract's columns. Rows with remainder 2 are held out of the sample."""
    model = learned(docs, crc_mod(F.col("doc_id"), 4) != 2, **parameters)
    told = predict(docs.select("doc_id", "text"), model, **{k: v for k, v in parameters.items() if k == "bits"})
    return told.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
