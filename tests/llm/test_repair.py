"""Conversation repair: every sequence of edits on short conversations, plain tables on longer ones, conversations in parts, odd rows."""

import itertools
import re
import zlib
from hashlib import sha256

import numpy as np

from listing_lake.llm import repair

GRAMMAR = re.compile("(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def every_edit(rows, fault):
    """Least (cost, audit, lines) over all edits, with up to two inserted turns at a place."""
    best = None
    inserts = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    choices = []
    for (_, role, text), f in zip(rows, fault, strict=True):
        some = [(3, "D", None)]
        if f not in (1, 2):
            late = int(f == 3)
            some += [(late, "K", (role, text)), *((2 + late, "R", (NAMES[x], text)) for x in "ua")]
        choices.append(some)
    for edits in itertools.product(*choices):
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for k, put in enumerate(places):
                cost, audit, lines = cost + 2 * len(put), audit + "I" * len(put), lines + [(NAMES[x], "") for x in put]
                if k < len(rows):
                    c, letter, line = edits[k]
                    cost, audit = cost + c, audit + letter
                    lines = lines + [line] * (line is not None)
            if GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
                one = (cost, audit, lines)
                best = one if best is None or one[:2] < best[:2] else best
    return best


def table(rows, fault):
    """Least (cost, audit, lines) by a plain table of whole audits: states nothing, s, u, a."""
    state = {0: (0, "", [])}

    def inserted(state):
        for _ in range(3):
            for s, (c, e, t) in list(state.items()):
                to, line = (3, ("assistant", "")) if s == 2 else (2, ("user", ""))
                one = (c + 2, e + "I", [*t, line])
                state[to] = min(state.get(to, one), one, key=lambda x: x[:2])
        return state

    for (_, role, text), f in zip(rows, fault, strict=True):
        new = {}
        for s, (c, e, t) in inserted(dict(state)).items():
            some = [(s, (c + 3, e + "D", t))]
            late = int(f == 3)
            if f not in (1, 2):
                need = "a" if s == 2 else "u"
                if role[:1] == "s" and s == 0:
                    some.append((1, (c + late, e + "K", [*t, (role, text)])))
                kept = role[:1] == need
                some.append((3 if s == 2 else 2, (c + late + 2 * (not kept), e + "RK"[kept], [*t, (role if kept else NAMES[need], text)])))
            for to, one in some:
                new[to] = min(new.get(to, one), one, key=lambda x: x[:2])
        state = new
    state = inserted(dict(state))
    return min((state[s] for s in (0, 3) if s in state), key=lambda x: x[:2])


def expected(rows, search=table):
    out = []
    for conv in {r[0] for r in rows}:
        held = hurt([r for r in rows if r[0] == conv])
        fault = faults(held)
        turns = [r[0] for r in held if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = search(held, fault)
        digest = sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.append((str(conv), gaps, *(fault.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest))
    return sorted(out)


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(frame):
    return sorted((str(r.conv_id), *(r[c] for c in COLUMNS)) for r in repair.digest(frame).collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def made(rng, convs, longest):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "uncle"], ["Hello.", "Why?", "cut off", "", None, " \n", "Yes!  ", "end.\n"]
    chance = [0.35, 0.35, 0.1, 0.1, 0.04, 0.03, 0.03]
    rows = []
    for c in range(convs):
        for t in range(int(rng.integers(1, longest))):
            text = texts[rng.integers(len(texts))] if rng.random() < 0.5 else f"Turn {rng.integers(40)}."
            rows.append((c, t if rng.random() < 0.9 else None, str(x) if (x := rng.choice(np.array(roles, object), p=chance)) is not None else None, text))
    return rows


def test_short_conversations_against_all_edits(spark):
    rows = made(np.random.default_rng(2), 60, 4)
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "No."), (900, None, "user", "x"), (901, 5, "user", "A."), (901, 5, "user", "A."), (901, 5, "assistant", "B.")]
    kept = {c for c in {r[0] for r in rows} if len(hurt([r for r in rows if r[0] == c])) <= 3}
    rows = [r for r in rows if r[0] in kept]
    assert len(kept) > 40
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS at", "3 AS fault", "4 AS conv").repartition(3)
    want = expected(rows, every_edit)
    assert want == expected(rows)
    assert got(frame) == want
    assert repair.digest(frame.filter("conv_id = -1")).collect() == []


def test_long_and_divided_conversations_against_a_table(spark):
    """Without joined partitions, a long conversation is in the shares of several tasks."""
    rng = np.random.default_rng(5)
    rows = made(rng, 40, 30) + [(1000, t, "user" if t % 2 == 0 else "assistant", f"Line {t % 150}.") for t in range(400)]
    rows += [(1001, None, r, x) for r, x in zip(["user", "assistant"] * 100, ["Same."] * 200, strict=True)] + [(1002, 1, "user", "long " * 40_000 + "."), (1002, 2, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    for parts in ("4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set(name, "false")
        try:
            assert got(frame) == expected(rows)
            if parts == "23":
                found = repair.segments(repair.faulty(repair.damaged(frame))).groupBy("key").count().filter("key = '=1000'").first()
                assert found["count"] > 1
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset(name)


def test_stacks_are_those_of_the_grammar():
    for n in range(8):
        for initials in itertools.product("sua", repeat=n):
            node = repair.START
            for x in initials:
                node = node and repair.shifted(node, x)
            assert bool(node and node[0] in repair.ACCEPT) == bool(GRAMMAR.fullmatch("".join(initials)))
