"""What the rules read of an item's mods, a batch of rows at a time: each distinct text of a batch is read once, the rest is numpy."""

from __future__ import annotations

import re
from functools import lru_cache

from listing_lake.functions.rules import GEM_LEVEL, MOD_TAGS, MOD_TOKENS, NUMBER

#: Features by the words that name them, and what counts of a mod's numbers.
NUMERIC = {
    "spell_damage_pct": ((("spell", "damage", "increased"),), max), "cast_speed_pct": ((("cast speed",), ("casting speed",)), max),
    "spell_crit_pct": ((("critical", "spell", "chance"),), max), "life_flat": ((("maximum life",),), max), "resist_total": ((("resist",),), lambda xs: sum(x for x in xs if x > 0)),
}
GEMS = "plus_all_spell_gems"
FACTS = f"struct<tokens:array<string>,tags:array<string>,numeric:struct<{','.join(f'{n}:double' for n in (*NUMERIC, GEMS))}>,gem:double>"
TOKEN_NAMES, TAG_NAMES = [t for t, _ in MOD_TOKENS], [t for t, _ in MOD_TAGS]
_NUMBER, _GEM = re.compile(NUMBER, re.ASCII), re.compile(GEM_LEVEL.replace(".+?", r"[^\n\r\x85\u2028\u2029]+?"), re.ASCII)  # as in the JVM


def named(text: str, ways) -> bool:
    """All words of one of the ways are in the text."""
    return any(all(w in text for w in words) for words in ways)


@lru_cache(maxsize=1 << 15)
def read(mod: str | None) -> tuple[list[int], list[int], list[float]]:
    """Places of a mod's tokens and tags among all, its value for each feature, its gem level for spells and for any skill."""
    if mod is None:
        return [], [], [0.0] * (len(NUMERIC) + 2)
    text = mod.lower().replace("%", " percent ").replace("+", " ")
    numbers = [float(x) for x in _NUMBER.findall(mod)]
    values = [float(of(numbers)) if numbers and named(text, ways) else 0.0 for ways, of in NUMERIC.values()]
    found = _GEM.search(mod) if "skill" in text else None
    gem = float(found.group(1)) if found else 0.0
    tokens = [i for i, (_, ways) in enumerate(MOD_TOKENS) if named(text, ways)]
    return tokens, [i for i, (_, words) in enumerate(MOD_TAGS) if any(w in text for w in words)], [*values, gem if "spell" in text else 0.0, gem]


def facts(mods):
    """FACTS of each list of mods: tokens and tags with repeats in the order of the mods, sums of the features, highest gem levels.
    A null list has none, a null mod gives nothing."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(mods)
    sizes = pc.fill_null(pc.list_value_length(mods), 0).to_numpy(zero_copy_only=False)
    coded = mods.flatten().dictionary_encode()
    codes = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
    known = [read(m) for m in [*coded.dictionary.to_pylist(), None]]
    row = np.repeat(np.arange(n), sizes)
    values = np.array([v for _, _, v in known])[codes]

    def lists(which: int, names: list[str]):
        count = np.array([len(k[which]) for k in known])
        start, flat = np.cumsum(count) - count, np.array([i for k in known for i in k[which]], dtype=np.int64)
        each = count[codes]
        at = np.repeat(start[codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        ends = np.cumsum(np.bincount(row, weights=each, minlength=n).astype(np.int64))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(names).take(pa.array(flat[at])))

    def most(values):
        out, some = np.zeros(n), np.flatnonzero(values)
        np.maximum.at(out, row[some], values[some])
        return pa.array(out)

    sums = [pa.array(np.bincount(row, weights=values[:, k], minlength=n)) for k in range(len(NUMERIC))]
    numeric = pa.StructArray.from_arrays([*sums, most(values[:, -2])], [*NUMERIC, GEMS])
    return pa.StructArray.from_arrays([lists(0, TOKEN_NAMES), lists(1, TAG_NAMES), numeric, most(values[:, -1])], ["tokens", "tags", "numeric", "gem"], mask=mods.is_null())
