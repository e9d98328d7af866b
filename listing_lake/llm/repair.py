"""Conversation structure repair: generalised LR parsing of the roles, with weighted edits.

The grammar is ``(s?(ua)+)?`` over the roles' initials: T -> s P | P, P -> P u a | u a, or nothing. Its LR automaton's stacks
form a graph: a node is a state with the node below it. For each row, every stack may keep it (shift its initial), give it
another role, or delete it, after any inserted turns; stacks with equal tops merge into the one of least (cost, audit), since
what may follow depends on the top alone. Of one row, two tops never have audits of which one begins the other, so their order
is kept as a rank and an audit is never compared as a whole. What led to each top is two bytes a row.

A conversation may hold a third of all rows. Rows are range-sorted by conversation and turn and written once; a task streams
its share and parses each stretch of one conversation in it (a segment). A segment at the edge of a share may be a part of a
conversation, so it is parsed from every top it may begin with; parts are then chained by their tops, a row for each. Only the
final digest of a conversation in several parts, which is one hash over its text, reads the parts one after the other, as a
stream. A task holds a segment of its share, never a conversation, and a result's audit is as long as its conversation.

Rows are taken by turn, null turns first, then by role and text, so repeated rows lie side by side. Null roles and texts are one
space. A null conversation id is a conversation of its own. A conversation without rows after damage has zeros and the hash of
the empty text. No rows, no result. Other columns have no part and may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lake.llm import sqltext
from listing_lake.llm.common import written

BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, LATE = 2, 3, 2, 1
#: The LR automaton: shifts by (state, initial), the symbols a complete rule takes off the stack, and where P then leads.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 5, (3, "u"): 6, (4, "u"): 6, (6, "a"): 7}
REDUCE = {5: 2, 7: 3}
GOTO = {0: 3, 1: 4}
#: Tops that may stand at the end: nothing read, or P complete.
ACCEPT = (0, 3, 4)
Node = tuple[int, "Node | None"]
START: Node = (0, None)
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
STATES = 8


@lru_cache(1024)
def shifted(node: Node, initial: str) -> Node | None:
    """The stack after an initial is read and complete rules are reduced; None where it can't come here."""
    state = SHIFT.get((node[0], initial))
    if state is None:
        return None
    node = (state, node)
    while node[0] in REDUCE:
        for _ in range(REDUCE[node[0]]):
            node = node[1]
        node = (GOTO[node[0]], node)
    return node


def tops() -> dict[int, Node]:
    """One stack of each top that may stand between two rows."""
    seen, new = {START}, [START]
    while new:
        new = [after for node in new for x in "sua" if (after := shifted(node, x)) and after not in seen]
        seen.update(new)
    return {node[0]: node for node in sorted(seen, key=str)}


def with_inserts(stacks: dict[int, tuple]) -> dict[int, tuple]:
    """Stacks after any inserted turns. A stack is (cost, rank, letters since the last row, top it came from, node)."""
    best, new = dict(stacks), list(stacks.values())
    while new:
        cost, rank, letters, came, node = new.pop()
        for initial in ROLES:
            if after := shifted(node, initial):
                one = (cost + INSERT, rank, letters + "I", came, after)
                if after[0] not in best or one[:3] < best[after[0]][:3]:
                    best[after[0]] = one
                    new.append(one)
    return best


def row_step(stacks: dict[int, tuple], initial: str, fault: int) -> dict[int, tuple]:
    """All stacks after one row, merged by top."""
    best: dict[int, tuple] = {}

    def offer(cost: int, rank: int, letters: str, came: int, node: Node | None) -> None:
        if node and (node[0] not in best or (cost, rank, letters) < best[node[0]][:3]):
            best[node[0]] = (cost, rank, letters, came, node)

    late = LATE * (fault == TRUNCATED)
    for cost, rank, letters, came, node in with_inserts(stacks).values():
        offer(cost + DELETE, rank, letters + "D", came, node)
        if fault not in (BLANK, DUPLICATE):
            offer(cost + late, rank, letters + "K", came, shifted(node, initial))
            for role in ROLES:
                offer(cost + REROLE + late, rank, letters + "R", came, shifted(node, role))
    return best


def ranked(stacks: dict[int, tuple]) -> dict[int, tuple]:
    """Stacks as the next row finds them: audits by rank alone."""
    order = sorted(stacks, key=lambda s: stacks[s][1:3])
    return {s: (stacks[s][0], k, "", s, stacks[s][4]) for k, s in enumerate(order)}


class Parse:
    """The parse of one segment from one top: the stacks behind it, and two bytes a row and top to walk back by."""

    def __init__(self, rows: list[tuple[str, int]], node: Node = START):
        self.stacks = {node[0]: (0, 0, "", node[0], node)}
        self.back = bytearray()
        for initial, fault in rows:
            stacks = row_step(self.stacks, initial, fault)
            entry = bytearray(2 * STATES)
            for state, (_, _, letters, came, _) in stacks.items():
                entry[2 * state], entry[2 * state + 1] = came, 4 * (len(letters) - 1) + "DKR".index(letters[-1])
            self.back += entry
            self.stacks = ranked(stacks)

    def audit(self, state: int) -> str:
        """The edits that lead to a top."""
        out = []
        for at in range(len(self.back) - 2 * STATES, -1, -2 * STATES):
            code = self.back[at + 2 * state + 1]
            out.append("I" * (code // 4) + "DKR"[code % 4])
            state = self.back[at + 2 * state]
        return "".join(reversed(out))


def ended(stacks: dict[int, tuple]) -> tuple[int, int, str, int, Node]:
    """The best stack that may stand at the end, after any inserted turns."""
    return min((x for s, x in with_inserts(stacks).items() if s in ACCEPT), key=lambda x: x[:3])


def edited(rows: list[tuple[str, str]], audit: str, node: Node) -> list[tuple[str, str, str]]:
    """Edit, role and text of every turn that stays, of (role, text) rows from a top on."""
    out, rest = [], iter(rows)
    for edit in audit:
        role, text = next(rest) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit != "K":
            role = next(ROLES[x] for x in ROLES if shifted(node, x))
        node = shifted(node, role[:1])
        out.append((edit, role, text))
    return out


def joined(turns: list[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in turns)


def damaged(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role`` and ``text`` with damage by a checksum of conversation and turn: rows dropped, emptied, cut short,
    repeated or given to the user."""
    blank = F.lit(" ")
    conv, turn = F.coalesce(F.col(conv_col).cast("string"), blank), F.coalesce(F.col(turn_col).cast("string"), blank)
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), blank), F.coalesce(F.col(text_col), blank)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def key_of(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def faulty(rows: DataFrame) -> DataFrame:
    """Adds ``key`` and ``fault`` (a row's first), to rows in order of conversation and turn, written once. A repeat is found by
    the first row of its conversation, role and text: counts combine before they are shuffled, and only texts that occur twice
    come back to the rows."""
    bare = F.btrim("text", F.lit(BLANKS))
    same = (F.xxhash64("role", "text"), F.xxhash64(F.lit(7), "text", "role"))
    rows = rows.withColumns({"key": key_of(F.col("conv")), "h": same[0], "h2": same[1], "salt": F.monotonically_increasing_id()})
    rows = written(rows, "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("there"), "turn", "salt")
    first = rows.groupBy("key", "h", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    rows = rows.join(first, ["key", "h", "h2"], "left")
    repeat = F.coalesce(F.col("salt") != F.col("first.salt"), F.lit(False))
    cut = ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    fault = F.when(bare == "", BLANK).when(repeat, DUPLICATE).when(cut, TRUNCATED).otherwise(0)
    rows = rows.select("key", F.col("turn").cast("long").alias("turn"), "role", "text", fault.alias("fault"), "salt")
    rows = written(rows, "repair-faults")
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text", "salt"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    return written(rows.withColumn("at", F.monotonically_increasing_id()), "repair-sorted")


NUMBERS = ("rows", "least", "most", "turns", "blank", "duplicate", "truncated", "illegal", "cost")
SEGMENT = "key string, at long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", first string, last string, low long, high long, audit string, sha string, chains string"
LEGAL = ("su", "ua", "au")


def summed(key: str, at: int, rows: list[tuple], edge: bool) -> tuple:
    """One segment's row: what it is if it is a whole conversation, and at an edge its parse from every top."""
    held = [(r[2][:1], r[4]) for r in rows]
    parse = Parse(held)
    cost, _, letters, came, _ = ended(parse.stacks)
    audit = parse.audit(came) + letters
    text = joined(edited([(r[2], r[3]) for r in rows], audit, START))
    turns = [r[1] for r in rows if r[1] is not None]
    count = [sum(f == k for _, f in held) for k in (BLANK, DUPLICATE, TRUNCATED)]
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(held, held[1:], strict=False))
    chains = None
    if edge:
        parts = ((s, Parse(held, node)) for s, node in tops().items())
        chains = json.dumps([(s, after, x[0], p.audit(after)) for s, p in parts for after, x in p.stacks.items()])
    numbers = (len(rows), min(turns, default=None), max(turns, default=None), len(set(turns)), *count, illegal, cost)
    ends = (turns[0] if turns else None, turns[-1] if turns else None)
    return (key, at, *numbers, held[0][0], held[-1][0], *ends, audit, sha256(text.encode()).hexdigest(), chains)


def segments(rows: DataFrame) -> DataFrame:
    """A row for each stretch of one conversation that one task reads in one go."""
    names = [x.split()[0] for x in SEGMENT.split(", ")]
    types = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in SEGMENT.split(", ")])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        edge, out = True, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[-1][0] or row[5] != held[-1][5] + 1):
                    breaks = row[5] != held[-1][5] + 1
                    out.append(summed(held[0][0], held[0][5], held, edge or breaks))
                    held, edge = [], breaks
                held.append(row)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, summed(held[0][0], held[0][5], held, True), strict=True))], schema)

    return rows.select("key", "turn", "role", "text", "fault", "at").mapInArrow(stream, SEGMENT)


CHAIN = SEGMENT + ", enter int, piece string, begins boolean"


def chained(parts: pd.DataFrame) -> pd.DataFrame:
    """The parts of one conversation as one: every part with the top it begins with and its edits, the first with the whole's
    numbers."""
    parts = parts.sort_values("at").reset_index(drop=True)
    stacks, back = {0: (0, 0, "", 0, START)}, []
    nodes = tops()
    for chains in parts["chains"]:
        best: dict[int, tuple] = {}
        for enter, after, cost, audit in json.loads(chains):
            if enter in stacks:
                one = (stacks[enter][0] + cost, stacks[enter][1], audit, enter, nodes[after])
                if after not in best or one[:3] < best[after][:3]:
                    best[after] = one
        back.append(best)
        stacks = ranked(best)
    cost, _, letters, state, _ = ended(stacks)
    enters, pieces = [], []
    for best in reversed(back):
        enters.append(best[state][3])
        pieces.append(best[state][2])
        state = best[state][3]
    parts["enter"], parts["piece"] = enters[::-1], pieces[::-1]
    parts.loc[len(parts) - 1, "piece"] += letters
    whole = parts.iloc[0].copy()
    for name in ("rows", "turns", "blank", "duplicate", "truncated", "illegal"):
        whole[name] = parts[name].sum()
    whole["least"], whole["most"], whole["cost"], whole["audit"] = parts["least"].min(), parts["most"].max(), cost, "".join(parts["piece"])
    ends = zip(parts["last"], parts["first"][1:], strict=False)
    whole["illegal"] += sum(a + b not in LEGAL for a, b in ends)
    for name in ("low", "high"):
        parts[name] = parts[name].astype("Int64")
    there = parts[parts["low"].notna()]
    whole["turns"] -= int((there["high"].to_numpy()[:-1] == there["low"].to_numpy()[1:]).sum()) if len(there) > 1 else 0
    parts["begins"] = False
    out = pd.concat([pd.DataFrame([whole]).assign(begins=True), parts], ignore_index=True)
    out["chains"] = None
    return out.astype({n: "Int64" for n in (*NUMBERS, "at", "low", "high")})


TURN = "key string, at long, k long, edit string, role string, text string"


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns of segments: ``rows`` of :func:`faulty`, ``found`` with ``key``, ``at``, ``rows``, ``enter`` and ``piece``."""
    names = [x.split()[0] for x in TURN.split(", ")]
    last = F.col("s.at") + F.col("rows") - 1
    parts = found.select("key", F.struct("at", "rows").alias("s")).withColumn("rows", F.col("s.rows"))
    inside = (F.col("r.key") == F.col("p.key")) & F.col("r.at").between(F.col("s.at"), last)
    dealt = rows.alias("r").join(parts.alias("p"), inside).select("r.key", F.col("s.at").alias("part"), "r.at", "role", "text")

    def edit(key: tuple, some: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("at")
        node = tops()[int(part["enter"].iloc[0])]
        turns = edited(list(zip(some["role"], some["text"], strict=True)), part["piece"].iloc[0], node)
        return pd.DataFrame([(key[0], key[1], k, *t) for k, t in enumerate(turns)], columns=names)

    told = found.select("key", F.col("at").alias("part"), "enter", "piece")
    return dealt.groupBy("key", "part").cogroup(told.groupBy("key", "part")).applyInPandas(edit, TURN)


def hashed(turns: DataFrame) -> DataFrame:
    """``key`` and the hash of its turns, one after the other."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for name, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if name != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = name, sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
        if state is not None:
            out.append((key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], pa.string()) for n in (0, 1)], ["key", "sha"])

    ordered = turns.repartition("key").sortWithinPartitions("key", "at", "k")
    return ordered.select("key", "role", "text").mapInArrow(stream, "key string, sha string")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conv``, ``turn``, ``role`` and ``text`` that has rows: ``key``, the counts, ``cost``, ``audit`` and
    ``sha``."""
    sorted_rows = faulty(rows)
    parts = written(segments(sorted_rows), "repair-segments")
    several = parts.groupBy("key").agg(F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    whole = parts.join(several, "key", "left_anti")
    # edge segments alone hold chains; there are two a task at most
    split = written(parts.join(several, "key").groupBy("key").applyInPandas(chained, CHAIN), "repair-chains")
    shas = hashed(repaired(sorted_rows, split.filter("not begins")))
    split = split.filter("begins").drop("sha", "enter", "piece", "begins").join(shas, "key", "left").withColumn("sha", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)))
    return whole.unionByName(split)


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = repair(damaged(conversations))
    every = conversations.select("conv_id").distinct().withColumn("key", key_of(F.col("conv_id")))
    out = every.join(found, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gaps = F.col("most") - F.col("least") + 1 - F.col("turns")
    return out.select(
        "conv_id", zero(gaps).alias("gaps"), *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def oracle() -> str:
    """The same in SQL: a conversation's rows one after the other, with the best edits for each state of the grammar."""
    put = lambda x, cost, edit, line: f"{{'c': {x}.c + {cost}, 'e': {x}.e || '{edit}', 't': CASE WHEN {x}.t = '' THEN {line} ELSE {x}.t || chr(10) || {line} END}}"
    drop = lambda x: f"{{'c': {x}.c + {DELETE}, 'e': {x}.e || 'D', 't': {x}.t}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    never = "{'c': 1000000000, 'e': '', 't': ''}"
    user = least("u", *(put(x, INSERT, "I", "'user:'") for x in ("s0", "s1", "a")))
    assistant = least("a", put("u1", INSERT, "I", "'assistant:'"))
    late, bad = f"{LATE} * (fault = {TRUNCATED})::INT", f"fault IN ({BLANK}, {DUPLICATE})"

    def taken(x: str, initial: str, name: str) -> str:
        return f"CASE WHEN {bad} THEN {never} WHEN r = '{initial}' THEN {put(x, late, 'K', 'line')} ELSE {put(x, f'{REROLE} + {late}', 'R', repr(name + ':') + ' || text')} END"

    kept_s = f"CASE WHEN {bad} OR r <> 's' THEN {never} ELSE {put('s0', late, 'K', 'line')} END"
    next_u = least(drop("u1"), *(taken(x, "u", "user") for x in ("s0", "s1", "a1")))
    return f"""
WITH RECURSIVE src AS (SELECT coalesce('=' || conv_id, '') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {sqltext.crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
hurt AS (SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM src),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY key, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM hurt),
faulty AS (SELECT key, turn, role || ':' || text AS line, text, i, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN {BLANK} WHEN again > 1 THEN {DUPLICATE}
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN {TRUNCATED} ELSE 0 END AS fault FROM placed),
walk AS (
  SELECT DISTINCT key, 0::BIGINT AS i, {{'c': 0, 'e': '', 't': ''}} AS s0, {never} AS s1, {never} AS u, {never} AS a FROM faulty
  UNION ALL
  SELECT key, i, {drop("s0")}, {least(drop("s1"), kept_s)}, {next_u}, {least(drop("a1"), taken("u1", "a", "assistant"))} FROM (
    SELECT *, {assistant} AS a1 FROM (SELECT f.*, s0, s1, u, a, {user} AS u1 FROM walk w JOIN faulty f ON f.key = w.key AND f.i = w.i + 1) x) y),
counts AS (SELECT key, max(i) AS i, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || r NOT IN {LEGAL}) AS illegal FROM (SELECT *, lag(r) OVER (PARTITION BY key ORDER BY i) AS before FROM faulty) z GROUP BY key),
ended AS (SELECT key, gaps, blank, duplicate, truncated, illegal, {least("s0", "a1")} AS best FROM (
  SELECT *, {assistant} AS a1 FROM (SELECT counts.*, s0, s1, u, a, {user} AS u1 FROM walk JOIN counts USING (key, i)) v) w)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended ON ended.key = coalesce('=' || o.conv_id, '')
"""
