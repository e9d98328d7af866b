"""Quality rules: the counts against plain loops, the ratio against plain counters, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from listing_lake.llm import rules

TEXTS = [
    None, "", " \t\n", "one", "one two", "a b c", "a b c a b c", "a a a a a", "x y\nx y\n\nx y\n \n z#|", "é ñ\x0bç\x0c<b> 50% *", "a b c d",
    "w " * 60, "k1 k2 k3 " + "q r s " * 3 + "k1 k2 k3", "long " * 20_000 + "tail", "\n".join(["same line here"] * 4), " ".join(f"w{i}" for i in range(70)),
]


def plain(text, min_words=50):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    failed = len(words) < min_words or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def test_counts_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join(rng.choice(["a", "b", "c", "d", "\n"], rng.integers(1, 90))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "w1 w2", "y"), (3, "one", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string").selectExpr("*", "1 AS _ws", "2 AS n_words", "3 AS kept").repartition(3)
    labels = spark.createDataFrame([(15, 1), (15, 0), (11, 0), (None, 1), (999, 1), (2, None)], "doc_id long, quality int")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted((str(r.doc_id), *(r[n] for n in names)) for r in rules.digest(docs, labels).collect())
    assert got == sorted((str(i), *plain(t)) for i, t, _ in rows)
    assert rules.digest(docs.filter("doc_id = -1"), labels).collect() == []


def ratio(texts, good, bits, smooth):
    """Of each text: its score per n-gram, with counters instead of the engine."""
    mask = (1 << bits) - 1

    def grams(text):
        ns = [zlib.crc32(w.encode()) for w in re.findall("[^\x20\x09-\x0d]+", text or "")]
        return [n & mask for n in ns] + [(a * 31 + b) & mask for a, b in zip(ns, ns[1:], strict=False)]

    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        target.update(grams(t) if i in good else [])
    share = sum(target.values()) / sum(raw.values())
    of = {b: round(math.log((target[b] + smooth) / (raw[b] * share + smooth)) * rules.UNIT) for b in raw}
    return [sum(of[b] for b in grams(t)) / max(1, len(grams(t))) / rules.UNIT for t in texts]


def test_ratio_and_verdict_against_counters(spark):
    rng = np.random.default_rng(9)
    prose, junk = [f"p{i}" for i in range(300)], [f"J{i}!!" for i in range(300)]
    texts = [" ".join(rng.choice(junk if i % 5 == 0 else prose, 80)) for i in range(200)]
    good = {i for i in range(0, 200, 2) if i % 5}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(0, 200, 2)], "doc_id long, quality int")
    for ids in (rules.BROADCAST_IDS, 3):
        rules.BROADCAST_IDS, before = ids, rules.BROADCAST_IDS
        try:
            got = {r.doc_id: r for r in rules.digest(docs, labels, bits=10).collect()}
        finally:
            rules.BROADCAST_IDS = before
        want = ratio(texts, good, 10, 4.0)
        assert all(abs(got[i].llr - w) < 1e-9 for i, w in enumerate(want))
    full = {r.doc_id: r.kept for r in rules.digest(docs, labels).collect()}
    assert all(full[i] == (i % 5 != 0) for i in range(200))
    assert all(r.kept != r.base_failed for r in rules.digest(docs, labels.filter("quality = 7")).collect())
