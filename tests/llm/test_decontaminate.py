import random

import numpy as np

from listing_lake.llm import decontaminate


def distance(item, text):
    """Least edit distance of an item to any stretch of a text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        k = rng.randrange(len(text))
        text[k : k + 1] = rng.choice([[], ["x"], [text[k], "y"]])
    return "".join(text)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 8))).strip() or "a"
    items = [(i, " ".join(word() for _ in range(rng.choice([8, 20, 45])))) for i in range(12)] + [(None, "the item without an id, but long enough"), (99, "short"), (98, None)]
    docs = []
    for i in range(120):
        text = " ".join(word() for _ in range(rng.choice([0, 5, 60])))
        if i % 2:
            item = rng.choice(items[:13])[1]
            text += " " + edited(rng, item, rng.randint(0, len(item) // 10)).upper().replace(" ", rng.choice([" ", ",  ", "\n"])) + " " + text
        docs.append((i, text))
    return items, [*docs, (500, None), (None, items[0][1]), (3, items[1][1]), (3, items[1][1]), (501, "𝒳 " * 5 + items[2][1] + "w " * 700_000)]


def test_matches_are_those_of_the_plain_table(spark):
    items, docs = cases(1)
    norm = decontaminate.normal_text
    want = set()
    for n, (_, text) in enumerate(docs[:-1]):
        for i, item in items:
            if len(norm(item)) >= 25 and (d := distance(norm(item), norm(text))) <= int(0.06 * len(norm(item))):
                want.add((n, i, d))
    found = decontaminate.Items([x for x in items if x[1]], 0.06, 25).leaks([t for _, t in docs[:-1]])
    assert {(n, x["item_id"], x["distance"]) for n, some in enumerate(found) for x in some} == want and len(want) > 20
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, leaks string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(frame, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.distance) for r in got if r.doc_id != 501) == sorted((str(docs[n][0]), str(i), d) for n, i, d in want)
    assert [(r.item_id, r.distance, r.start) for r in got if r.doc_id == 501 and r.item_id == 2] == [(2, 0, 10)]
    assert decontaminate.digest(frame, bench.filter("item_id < 0")).collect() == []


def test_blocks_of_items_add_up(spark, monkeypatch):
    items, docs = cases(2)
    frame, bench = spark.createDataFrame(docs[:-1], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.digest(frame, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    sizes = [sum(len(t) for _, t in some) for some in decontaminate.item_blocks(bench, "item_id", "text")]
    assert len(sizes) > 5 and sum(sizes) == sum(len(t) for _, t in items if t) and max(sizes) <= 300 + max(len(t) for _, t in items if t)
    assert sorted(map(str, decontaminate.digest(frame, bench).collect())) == whole and len(whole) > 10
    assert np.ndim(whole) == 1


def test_short_items_match_as_whole_lines(spark):
    items = [(1, "Short one!"), (2, "short  ONE"), (3, "?!"), (4, "𐐀𐐁 x"), (5, "")]
    docs = [(1, "a\r\n  short, one \nb"), (2, "a short one"), (3, "?!"), (4, "y\n\n𐐨𐐩 X."), (5, "short one"), (6, None)]
    got = decontaminate.digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0, 3, 16), (1, 2, 0, 3, 16), (4, 4, 0, 3, 8), (5, 1, 0, 0, 9), (5, 2, 0, 0, 9)]
