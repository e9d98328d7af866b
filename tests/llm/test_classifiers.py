"""Held-out accuracy on the given tables, and the defined results of odd rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_lake.llm import language, quality, textvec, toxicity
from listing_lake.llm.common import table

SF = "/root/testdata/sf0.01"
ODD = [(10**9, None, None), (10**9 + 1, "", "en"), (10**9 + 2, "123 !!", "en"), (None, "x", "en"), (3, "long " * 300_000, "en"), (3, "again", None)]


def with_odd(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    return docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string")).withColumn("score", F.lit("clash"))


def test_words_are_those_of_a_plain_split():
    import re

    texts = ["a bc, d_1!! é\n ñ", "", None, "x" * 30 + " y " * 40, "  ", "İ 𝒳 end"]
    got = [[] for _ in texts]
    places = [[] for _ in texts]
    for block in textvec.blocks(texts, 150):
        words = textvec.Words(*block)
        letters = "".join(map(chr, words.codes))
        for a, b, row, place in zip(words.start, words.end, words.row, words.place, strict=True):
            got[row].append(letters[a:b])
            places[row].append(place)
    want = [[(m.group(), m.start()) for m in re.finditer(r"\w+|[^\w\s]+", t or "")] for t in texts]
    assert [list(zip(g, p, strict=True)) for g, p in zip(got, places, strict=True)] == want


TEXTS = ["a bc, d_1!! é\n ñ a bc", "", None, "x" * 700, "  ", "İ 𝒳 end", "one two two three " * 90, "b" * 300 + " b " + "c" * 300 + "é é"]


def test_ngrams_are_those_of_a_plain_loop(monkeypatch):
    """Long texts and long words in small blocks give the n-grams of one loop over all words."""
    import re

    whole = [np.concatenate(x) for x in zip(*quality.ngrams(TEXTS, 18), strict=True)]
    monkeypatch.setattr(quality.whole_texts, "__defaults__", (50,))
    small = [np.concatenate(x) for x in zip(*quality.ngrams(TEXTS, 18), strict=True)]
    of = lambda found: sorted(zip(*(x.tolist() for x in found), strict=True))
    assert of(whole) == of(small)
    words = [re.findall(r"\w+|[^\w\s]+", t or "") for t in TEXTS]
    assert np.bincount(whole[0], minlength=len(TEXTS)).tolist() == [2 * len(w) - bool(w) for w in words]
    place: dict = {}
    for i in range(len(TEXTS)):
        repeats = ["<repeat>" if k and w == words[i][k - 1] else w for k, w in enumerate(words[i])]
        grams = [*repeats, *itertools.pairwise(repeats)]
        for gram, at in zip(grams, whole[1][whole[0] == i], strict=False) if i != 6 else ():
            assert place.setdefault(gram, at) == at


def test_character_grams_are_those_of_a_plain_loop(monkeypatch):
    of = lambda found: sorted(itertools.chain.from_iterable(zip(r.tolist(), p.tolist(), strict=True) for r, p in found))
    whole = of(language.grams(TEXTS, 12))
    monkeypatch.setattr(language.blocks, "__defaults__", (40, 0))
    assert of(language.grams(TEXTS, 12)) == whole
    monkeypatch.undo()
    place, n = {}, 0
    for t in TEXTS:
        clean = "".join(c if (c.isalnum() or c == "_") and not "0" <= c <= "9" else " " for c in t or "")
        clean = "".join(c.lower() if len(c.lower()) == 1 else c for c in clean)
        grams = [clean[a : a + k] for k in (1, 2, 3) for a in range(len(clean) - k + 1)]
        grams = [g for g in grams if g[0] != " " or g[-1] != " "]
        found = [p for _, ps in language.grams([t], 12) for p in ps.tolist()]
        assert len(found) == len(grams)
        n += len(grams)
        assert all(place.setdefault(g, at) == at for g, at in zip(grams, found, strict=True))
    assert len(whole) == n


def test_ftrl_is_the_plain_rule():
    rng = np.random.default_rng(3)
    rows = [(np.append(np.unique(rng.integers(0, 16, 4)), 16), None, int(rng.integers(2))) for _ in range(40)]
    rows = [(at, np.append(rng.random(len(at) - 1), 1.0), y) for at, _, y in rows]
    got = quality.ftrl(rows, 4, 3, 0.5, 0.1, 0.02, 0.01)
    z, n = [0.0] * 17, [0.0] * 17
    weight = lambda i: 0.0 if abs(z[i]) <= 0.02 else -(z[i] - math.copysign(0.02, z[i])) / ((0.1 + math.sqrt(n[i])) / 0.5 + 0.01)
    for _ in range(3):
        for at, value, y in rows:
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, value, strict=True))))
            for i, v in zip(at, value, strict=True):
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * w[i]
                n[i] += g * g
    assert np.allclose(got, [weight(i) for i in range(17)])


def test_labels_of_any_text_are_predicted(spark):
    docs = table(spark, SF, "documents").withColumn("lang", F.when(F.col("lang") == "en", "pt br").when(F.col("lang") == "de", "pt").when(F.col("lang") == "fr", "it"))
    got = language.digest(docs, per_lang=200).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"] & got["lang"].notna()]
    assert set(got["lang_pred"]) <= {"pt br", "pt", "it", "und"} and (held["lang_pred"] == held["lang"]).mean() > 0.95


def test_repeated_labelled_rows_count_once(spark):
    labels = spark.createDataFrame([(0, 1), (2, 0), (3, 1), (3, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame([(0, f"t{i % 3}") for i in range(50)] + [(2, None), (3, "x"), (None, "y")], "doc_id long, text string")
    got = quality.sampled(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted((r._id, r._text, r._label) for r in got) == [(0, "t0", 1), (3, "x", 1)]
    assert quality.digest(docs.filter("doc_id < 0"), labels).collect() == []
    assert len(toxicity.digest(docs, labels.withColumnRenamed("quality", "toxic")).collect()) == docs.count()


def test_quality(spark):
    labels = table(spark, SF, "labels")
    got = quality.digest(with_odd(spark), labels).toPandas()
    assert len(got) == 1000 + len(ODD) and got["score"].between(0, 1).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    both = both[both["held_out"]]
    assert (both["predicted"] == both["quality"]).mean() > 0.9
    assert len(quality.digest(with_odd(spark), labels.filter("doc_id < 0")).collect()) == 1000 + len(ODD)


def test_language(spark):
    got = language.digest(with_odd(spark), per_lang=200).toPandas()
    assert (got["score"].between(0, 1)).all() and len(got) == 1000 + len(ODD)
    assert (got[got["doc_id"] >= 10**9]["lang_pred"] == "und").all()
    both = got.merge(table(spark, SF, "documents").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    alone = language.digest(with_odd(spark).filter("doc_id < 0"))
    assert alone.collect() == []


def test_language_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    """A language whose rows share one id gives one text; another gives no more than asked for."""
    rows = [(7, f"hello the {i}", "en") for i in range(3000)] + [(i, f"bonjour le {i}", "fr") for i in range(100, 900)] + [(2, "hola", "es"), (3, "ciao", "it")]
    labelled = spark.createDataFrame(rows, "_id long, _text string, _lang string")
    sizes = spark.sparkContext.accumulator(0)
    whole = language.machine

    def machine(x, y, steps, penalty):
        sizes.add(len(x))
        return whole(x, y, steps, penalty)

    monkeypatch.setattr(language, "machine", machine)
    _, machines = language.train(labelled, per_lang=30, steps=2)
    assert sizes.value <= len(machines) * (1 + 30 + 1 + 1)


def test_votes_are_those_of_plain_loops(spark):
    """Family, pairs and votes of given machines, one text and n-gram after the other."""
    rng = np.random.default_rng(11)
    langs, bits = ["de", "en", "es", "fr", "it", "pt"], 8
    of = {}
    for x in langs:
        of.setdefault(language.family(x), []).append(x)
    names = [f"family {f}" for f in of] + [f"pair {a!r} {b!r}" for some in of.values() for a, b in itertools.combinations(some, 2)]
    machines = {n: rng.normal(size=(1 << bits) + 1) * 20 for n in names}
    texts = ["Hello there", "ça va bien", "x", "der die das und " * 30, "uno due tre", "12 !", None, "a\nb c"]
    got = language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (langs, machines), bits=bits).collect()
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        places = np.concatenate([place for _, place in language.grams([r.text], bits)])
        sure = {n: 1 / (1 + np.exp(-4 * np.clip(w[places].mean() + w[-1], -8, 8))) for n, w in machines.items()}
        chance = {f: sure[f"family {f}"] / sum(sure[f"family {g}"] for g in of) for f in of}
        best = max(of, key=chance.get)
        votes = {x: [0, 0.0] for x in of[best]}
        for a, b in itertools.combinations(of[best], 2):
            p = sure[f"pair {a!r} {b!r}"]
            for x, q in ((a, p), (b, 1 - p)):
                votes[x] = [votes[x][0] + (q > 0.5), votes[x][1] + q / (len(of[best]) - 1)]
        want = max(of[best], key=lambda x: votes[x][0] + votes[x][1] / 2)
        share = votes[want][1] if len(of[best]) > 1 else 1
        assert r.lang_pred == want and np.isclose(r.score, chance[best] * share)


@pytest.mark.parametrize("langs", [["en", "fr"], ["en", "fr", "es"], ["en"]])
def test_families_of_one_language_are_predicted(spark, langs):
    docs = table(spark, SF, "documents").filter(F.col("lang").isin(langs))
    got = language.digest(docs, per_lang=200).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    for lang in langs:
        some = held[held["lang"] == lang]
        assert len(some) and (some["lang_pred"] == lang).mean() > 0.95


def test_toxicity(spark):
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text").join(labels.select("doc_id"), "doc_id")
    odd = spark.createDataFrame([r[:2] for r in ODD if r[0] != 3], "doc_id long, text string")
    got = toxicity.digest(docs.unionByName(odd), labels, max_rows=3000).toPandas()
    assert got["score"].between(0, 1).all()
    assert (got[got["doc_id"].fillna(10**9) >= 10**9]["predicted"] == 0).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    assert (held[held["toxic"] == 0]["predicted"] == 0).mean() > 0.97


def test_whole_chains_and_their_spans(spark, monkeypatch):
    """Score, spans and offsets of whole texts against one direct chain for each, in blocks of any size."""
    import re

    rng = np.random.default_rng(7)
    field = rng.normal(size=1 << 8).astype(np.float32) * 3, rng.normal(size=(2, 2))
    texts = ["a bc, d é ñ a bc " * 40, "", None, "xX " * 90, "One  two\nTwo three 𝒳𝒳 " * 30, "w" * 400 + " y"]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double").drop("score")
    got = {r.doc_id: r for r in toxicity.tag(docs, field).collect()}
    for i, text in enumerate(texts):
        found = list(re.finditer(r"\w+|[^\w\s]+", text or ""))
        if not found:
            assert (got[i].score, got[i].spans) == (0.0, [])
            continue
        words = textvec.Words([0], [0], [text], lower=True)
        emission = field[0][toxicity.places_of(words.row, *toxicity.cues_of(words), 8)].sum(axis=0)[None] + toxicity.START
        p, _ = toxicity.forward_backward(emission, np.ones_like(emission, dtype=bool), field[1])
        assert np.isclose(got[i].score, p.max())
        want, before = [], -2
        for k in np.flatnonzero(p[0] >= 0.5):
            if k == before + 1:
                want[-1] = (want[-1][0], found[k].end(), max(want[-1][2], p[0, k]))
            else:
                want.append((found[k].start(), found[k].end(), p[0, k]))
            before = k
        assert [(s.start, s.end) for s in got[i].spans] == [w[:2] for w in want]
        assert np.allclose([s.score for s in got[i].spans], [w[2] for w in want])
    lengths = (6, 1, 64, 200, 65)
    score, first = rng.normal(size=sum(lengths)) * 5, np.zeros(sum(lengths), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    p = toxicity.chain_marginals(score, first, field[1])
    for a, n in zip(np.cumsum([0, *lengths[:-1]]), lengths, strict=True):
        want, _ = toxicity.forward_backward(score[None, a : a + n], np.ones((1, n), bool), field[1])
        assert np.allclose(p[a : a + n], want[0])


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    score, step = rng.normal(size=(3, toxicity.RUN)) * 2, rng.normal(size=(2, 2))
    there = np.zeros_like(score, dtype=bool)
    lengths = (6, 4, 1)
    for i, n in enumerate(lengths):
        there[i, :n] = True
    p, moves = toxicity.forward_backward(score, there, step)
    want_moves = np.zeros((2, 2))
    for i, n in enumerate(lengths):
        weight, on, paths = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            e = np.exp(sum(score[i, k] for k in range(n) if path[k]) + sum(step[a, b] for a, b in itertools.pairwise(path)))
            weight += e
            on += e * np.array(path)
            for a, b in itertools.pairwise(path):
                paths[a, b] += e
        assert np.allclose(p[i, :n], on / weight)
        want_moves += paths / weight
    assert np.allclose(moves, want_moves)
