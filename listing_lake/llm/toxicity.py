"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Token labels come from document labels: a word, or a word's first ``PREFIX`` letters, is a cue if toxic documents explain it
and it explains them. Cues are picked greedily out of a bounded sample: the one that covers most toxic texts not covered so
far, as long as hardly any other text has it. A token of a toxic text that carries a cue is labelled toxic, all others not.
The field has two states. A token's features are hashed: the word, its first letters, and the words next to it. Shards of the
sample train apart by gradient steps on the exact likelihood, each in a task of its own, and their weights are averaged.

It learns from windows of ``RUN`` tokens: all that hold a cue, and one of ``thin`` others.

Whole texts are tagged as one chain each, however long. A document's score is its greatest forward-backward marginal; tokens
at one half and more, next to each other, are spans, with offsets in code points. Null, empty and wordless texts have no
tokens and score 0, as everything does when no cue is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lake.llm.common import crc_mod
from listing_lake.llm.quality import sampled
from listing_lake.llm.textvec import Words, blocks, whole_texts

PREFIX, RUN = 5, 64
#: Emission score of a token without known features.
START = -4.0
SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA5A3564F8F3D2B1D))
FIELD = tuple[np.ndarray, np.ndarray]


def cues_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a block's words and of their first letters. Marks have neither; short words have no first letters."""
    head = words.polynomial(words.start, np.minimum(words.end, words.start + PREFIX)) ^ SALTS[0]
    real = words.kind == 1
    return np.where(real, words.number, 0), np.where(real & (words.end - words.start > PREFIX), head, 0)


def places_of(row: np.ndarray, word: np.ndarray, head: np.ndarray, bits: int) -> np.ndarray:
    """Hashed features of every token, a column each. ``row``: the token's text."""
    first = np.diff(row, prepend=-1) != 0
    before = np.where(first, 0, np.roll(word, 1))
    after = np.where(np.roll(first, -1), 0, np.roll(word, -1))
    return np.stack([(x * s >> np.uint64(64 - bits)).astype(np.int64) for x, s in zip((word, head, before, after), SALTS, strict=True)])


def runs_of(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The run and the place in it of every token: RUN tokens of one text at a time."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    at = np.arange(len(row)) - np.repeat(first, np.diff([*first, len(row)]))
    run = np.cumsum(at % RUN == 0) - 1
    return run, at % RUN, int(run[-1]) + 1 if len(run) else 0


def forward_backward(score: np.ndarray, there: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state, and expected transitions (2 x 2), for many runs at once. ``score``: emission scores of
    the toxic state by run and place; ``there``: which places are taken; ``step``: transition scores."""
    odds, t = np.exp(np.clip(score, -30, 30)), np.exp(step)
    n, length = score.shape
    ahead, back = np.empty((length, 2, n)), np.ones((length, 2, n))
    now = np.stack([np.ones(n), odds[:, 0]])
    ahead[0] = now / now.sum(axis=0)
    for k in range(1, length):
        now = t.T @ ahead[k - 1]
        now[1] *= odds[:, k]
        ahead[k] = np.where(there[:, k], now / now.sum(axis=0), ahead[k - 1])
    for k in range(length - 2, -1, -1):
        now = back[k + 1].copy()
        now[1] *= odds[:, k + 1]
        now = t @ now
        back[k] = np.where(there[:, k + 1], now / now.sum(axis=0), 1.0)
    both = ahead * back
    marginal = np.where(there, (both[:, 1] / both.sum(axis=1)).T, 0.0)
    moves = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            m = ahead[:-1, a] * t[a, b] * back[1:, b] * (odds.T[1:] if b else 1.0)
            total = sum(ahead[:-1, i] * t[i, j] * back[1:, j] * (odds.T[1:] if j else 1.0) for i in range(2) for j in range(2))
            moves[a, b] = (m / total)[there.T[1:]].sum()
    return marginal, moves


def fit_field(tokens: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], size: int, steps: int, rate: float) -> FIELD:
    """AdaGrad on the log-likelihood of labelled runs: (places, run, at, label) of each block; places are under ``size``."""
    w, step = np.zeros(size), np.zeros((2, 2))
    seen, seen_step = np.full(size, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(steps):
        for places, run, at, label in tokens:
            shape = (int(run[-1]) + 1, RUN)
            score, there = np.zeros(shape), np.zeros(shape, bool)
            score[run, at], there[run, at] = w[places].sum(axis=0) + START, True
            marginal, moves = forward_backward(score, there, step)
            slope = np.bincount(places.ravel(), np.tile(label - marginal[run, at], len(places)), size) - 1e-3 * w
            follows = at[1:] > 0
            held = np.bincount(2 * label[:-1][follows] + label[1:][follows], minlength=4).reshape(2, 2)
            turn = held - moves - 1e-3 * step
            seen += slope**2
            seen_step += turn**2
            w += rate * slope / np.sqrt(seen)
            step += rate * turn / np.sqrt(seen_step)
    return w, step


def signatures(words: Words, n: int) -> np.ndarray:
    """A number per text that near copies mostly share: the least of its words under three orders, combined."""
    out = np.zeros(n, np.uint64)
    for salt in SALTS[:3]:
        least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, words.row, (words.number ^ salt) * SALTS[3])
        out = out * SALTS[0] ^ least
    return out


def find_cues(sample: DataFrame, *, least: int = 6, clean: float = 0.97, plain: int = 40) -> list[int]:
    """Numbers of the cues. Texts count by signature, so a group of copies counts about once. A cue has ``least`` toxic
    texts, ``clean`` of all texts that have it are toxic, and it covers some that no better cue covers, or has ``plain``
    toxic texts. What is collected is bounded by the sample."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            label = pdf["_label"].to_numpy()
            for block in blocks(pdf["_text"].tolist()):
                words = Words(*block, lower=True)
                same = signatures(words, len(pdf)).view(np.int64)
                for cue in cues_of(words):
                    pair = pd.DataFrame({"row": words.row, "cue": cue.view(np.int64)})
                    pair = pair[pair["cue"] != 0].drop_duplicates()
                    yield pd.DataFrame({"cue": pair["cue"], "same": same[pair["row"]], "_label": label[pair["row"]]})

    pairs = sample.select("_text", "_label").mapInPandas(each, "cue long, same long, _label int")
    pairs = pairs.groupBy("cue", "same").agg(F.max("_label").alias("_label"))
    toxic = F.collect_list(F.when(F.col("_label") == 1, F.col("same")))
    counts = pairs.groupBy("cue").agg(F.sum("_label").alias("bad"), F.count("*").alias("n"), toxic.alias("same"))
    found = counts.filter((F.col("bad") >= least) & (F.col("bad") >= clean * F.col("n"))).collect()
    has = {r.cue: set(r.same) for r in found}
    covered: set[int] = set()
    cues: list[int] = []
    for cue in sorted(has, key=lambda c: (-len(has[c]), c)):
        if len(has[cue]) >= plain or len(has[cue] - covered) >= max(3, len(has[cue]) // 20):
            cues.append(cue)
            covered |= has[cue]
    return cues


def train(sample: DataFrame, *, bits: int = 21, shards: int = 4, steps: int = 30, rate: float = 0.5, thin: int = 4) -> FIELD:
    """Averaged weights of the shards: ``2**bits`` and four transition scores at most."""
    cues = np.array(find_cues(sample), np.int64).view(np.uint64)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        tokens = []
        for block in blocks(pdf["_text"].tolist()):
            words = Words(*block, lower=True)
            run, at, n = runs_of(words.row)
            if not n:
                continue
            word, head = cues_of(words)
            label = ((np.isin(word, cues) | np.isin(head, cues)) & (pdf["_label"].to_numpy()[words.row] == 1)).astype(np.int64)
            hot = np.bincount(run, label, n) > 0
            keep = (hot | (np.arange(n) % thin == 0))[run]
            tokens.append((places_of(words.row, word, head, bits)[:, keep], np.unique(run[keep], return_inverse=True)[1], at[keep], label[keep]))
        used = np.unique(np.concatenate([t[0].ravel() for t in tokens])) if tokens else np.zeros(0, np.int64)
        w, step = fit_field([(np.searchsorted(used, p), *rest) for p, *rest in tokens], len(used), steps, rate)
        return pd.DataFrame({"place": [*used, -1, -2, -3, -4], "weight": [*w, *step.ravel()]})

    if not len(cues):
        return np.zeros(0), np.zeros((2, 2))
    dealt = sample.withColumn("_shard", F.pmod(F.xxhash64("_id", F.lit("shard")), F.lit(shards)))
    weights = dealt.groupBy("_shard").applyInPandas(fit, "place long, weight double").groupBy("place").agg((F.sum("weight") / shards).alias("weight"))
    w, step = np.zeros(1 << bits), np.zeros(4)
    told = weights.toArrow()
    place, weight = (told[c].to_numpy() for c in ("place", "weight"))
    w[place[place >= 0]] = weight[place >= 0]
    step[-place[place < 0] - 1] = weight[place < 0]
    return w.astype(np.float32), step.reshape(2, 2)


def tag(docs: DataFrame, field: FIELD, *, text_col: str = "text") -> DataFrame:
    """Adds ``score`` and ``spans`` (start, end, score: the greatest marginal within)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def apply(texts: pd.Series) -> pd.DataFrame:
        w, step = shared.value
        best, spans = np.zeros(len(texts)), [[] for _ in range(len(texts))]
        for group in whole_texts(texts.tolist()) if len(w) else ():
            found = []
            for block in group:
                words = Words(*block, lower=True)
                found.append((words.row, words.place, words.end - words.start, *cues_of(words)))
            row, place, length, word, head = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(row):
                continue
            first = np.diff(row, prepend=-1) != 0
            p = chain_marginals(w[places_of(row, word, head, int(np.log2(len(w))))].sum(axis=0) + START, first, step)
            np.maximum.at(best, row, p)
            at = np.flatnonzero(p >= 0.5)
            begins = np.concatenate([[True], (np.diff(at) > 1) | first[at[1:]]]) if len(at) else np.zeros(0, bool)
            for one in np.split(at, np.flatnonzero(begins)[1:]) if len(at) else ():
                spans[row[one[0]]].append({"start": int(place[one[0]]), "end": int(place[one[-1]] + length[one[-1]]), "score": float(p[one].max())})
        return pd.DataFrame({"score": best, "spans": spans})

    found = F.pandas_udf(apply, "score double, spans array<struct<start:long,end:long,score:double>>")(F.col(text_col))
    return docs.withColumn("_found", found).select(*docs.columns, "_found.score", "_found.spans")


def row_sums(m: np.ndarray) -> np.ndarray:
    """For products of all 2 x 2 matrices so far: the sums of their columns, scaled to sum 1. ``m``: the four numbers of each
    matrix. Runs of RUN matrices are multiplied side by side; between runs goes one step each, on four numbers."""
    n = m.shape[1]
    size = -(-n // RUN)
    full = np.zeros((4, size * RUN))
    full[[0, 3]] = 1.0
    full[:, :n] = m
    a, b, c, d = np.ascontiguousarray(full.reshape(4, size, RUN).transpose(0, 2, 1))
    out = np.empty((RUN, 4, size))
    p, q, r, s = a[0], b[0], c[0], d[0]
    for k in range(RUN):
        if k:
            p, q, r, s = p * a[k] + q * c[k], p * b[k] + q * d[k], r * a[k] + s * c[k], r * b[k] + s * d[k]
        scale = 1.0 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
        out[k] = p, q, r, s
    left, right = np.empty(size), np.empty(size)
    x = y = 0.5  # the row of ones, times all runs before
    for k, (p, q, r, s) in enumerate(out[-1].T.tolist()):
        left[k], right[k] = x, y
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    sums = np.stack([left * out[:, 0] + right * out[:, 2], left * out[:, 1] + right * out[:, 3]])
    sums /= sums.sum(axis=0)
    return sums.transpose(0, 2, 1).reshape(2, -1)[:, :n]


def chain_marginals(score: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The toxic state's marginals for texts laid end to end; ``first``: where a text begins. Messages are products of one
    matrix a token; a text's first token has one of equal rows, which forgets all that comes before it."""
    odds, t = np.exp(np.clip(score, -30, 30)), np.exp(step)
    ahead = np.stack([np.where(first, 1.0, x) * y for x, y in ((t[0, 0], 1.0), (t[0, 1], odds), (t[1, 0], 1.0), (t[1, 1], odds))])
    # backward: what follows a token, seen from its states; nothing follows a last token
    last, after = np.roll(first, -1), np.roll(odds, -1)
    back = np.stack([np.where(last, 1.0, x) for x in (t[0, 0] + 0 * after, t[1, 0] + 0 * after, t[0, 1] * after, t[1, 1] * after)])
    both = row_sums(ahead) * row_sums(back[:, ::-1])[:, ::-1]
    return both[1] / both.sum(axis=0)


def digest(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000, threshold: float = 0.7, **parameters) -> DataFrame:
    """The contract's columns, and the offending offsets. Rows with remainder 1 are held out of the sample."""
    field = train(sampled(docs, labels, "toxic", crc_mod(F.col("doc_id"), 3) != 1, max_rows), **parameters)
    scored = tag(docs.select("doc_id", "text"), field)
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "spans",
    )
