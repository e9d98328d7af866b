"""Token ids of whole texts by the tokenizers library, with a bounded memo for repeated pieces of text.

Both vocabularies split a text at white space before they merge, so what stands between two spaces has the same ids wherever
it stands. The memo holds the ids of such pieces as bytes, and a text's ids are their concatenation. A piece that is new is
cut into the vocabulary's own units (words, numbers, marks, line ends), each of which goes to its merge model once. Texts
with other white space than ASCII's or with the name of an added token, and pieces with characters beyond ``PLAIN_END``, go
through the library whole, and so does every text where the vocabulary's file says that it works in any other way."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np

#: White space, or what some engine takes for it, outside ASCII's usual six.
ODD_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")
#: White space that is more than one space between two words.
WIDE_PAIRS = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
WIDE_SPACE = re.compile(r"([ \t\n\r\x0b\x0c]{2,}|[\t\n\r\x0b\x0c])")
#: Below this character (Latin, Greek, Cyrillic) all engines agree on what is a letter or a number.
PLAIN_END = "\u0530"
#: Units of pieces below PLAIN_END; the superscripts and fractions are its only numbers beside ASCII's digits.
LETTERS, NUMBERS, MARKS = "[^\\W\\d_\u00b2\u00b3\u00b9\u00bc-\u00be]", "[\\d\u00b2\u00b3\u00b9\u00bc-\u00be]", r"(?:[^\s\w]|_)"
SHORTENED = "'(?:s|t|re|ve|m|ll|d)"
SPACED_UNITS = re.compile(rf"{SHORTENED}| ?{LETTERS}+| ?{NUMBERS}+| ?{MARKS}+|\s+(?!\S)|\s+")
LOWER_UNITS = re.compile(rf"{SHORTENED}|{LETTERS}+|{NUMBERS}|{MARKS}+")
#: The memo keeps two generations, each closed once it has so many pieces; pieces longer than MEMO_CHARS are not kept.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48

# What the two forms of vocabulary that the memo knows say of themselves; any other goes through the library whole. Fixed values.
_BPE = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_UNITS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPACED_FORM = json.dumps([None, _BYTES | {"use_regex": True}, _BPE | {"end_of_word_suffix": None}, []], sort_keys=True)
LOWERED_FORM = json.dumps(
    [
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _UNITS}, "behavior": "Removed", "invert": True}, _BYTES | {"use_regex": False}]},
        _BPE | {"end_of_word_suffix": "</w>"}, [],
    ],
    sort_keys=True,
)

_encoders: dict[tuple[str, int], Callable[[str], bytes]] = {}


def give_back() -> None:
    """Give memory that this worker process no longer uses back. Workers outlive stages, so a stage that needs much begins so."""
    import pyarrow as pa

    gc.collect()
    if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
        trim.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def forget() -> None:
    """Drop all memos of this worker process, for stages that encode nothing."""
    if _encoders:
        _encoders.clear()
        give_back()


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memo(dict):
    """Ids of pieces, found by ``fresh`` where they are in neither generation."""

    def __init__(self, fresh: Callable[[str, Memo], bytes], entries: int, old: dict[str, bytes] | None = None):
        super().__init__()
        self.fresh, self.entries, self.old = fresh, entries, old or {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.fresh(piece, self)
        if len(piece) <= MEMO_CHARS:
            self[piece] = ids
        return ids

    def bounded(self) -> Memo:
        """This memo, or the next generation if it is full."""
        if len(self) <= self.entries:
            return self
        self.old = {}
        return Memo(self.fresh, self.entries, self)


def encoder(path: str, memo_entries: int = MEMO_ENTRIES) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian uint32 bytes; one per worker process and file. Fewer entries of the
    memo take less memory and more time."""
    if (path, memo_entries) not in _encoders:
        _encoders.clear()
        give_back()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        way = {SPACED_FORM: spaced, LOWERED_FORM: lowered}.get(form(path))
        if way and hasattr(tok.model, "_resize_cache"):
            tok.model._resize_cache(0)  # the memo asks for every unit once
        _encoders[path, memo_entries] = named(tok, way(tok, memo_entries)) if way else lambda text: direct(tok, text)
    return _encoders[path, memo_entries]


def form(path: str) -> str:
    """How a vocabulary cuts and merges texts: all of its file but the vocabulary itself, as text."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    merges = {k: v for k, v in told["model"].items() if k not in ("vocab", "merges", "unk_token")}
    odd = [t for t in told.get("added_tokens") or () if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    return json.dumps([told["normalizer"], told["pre_tokenizer"], merges, odd], sort_keys=True)


def named(tok, encode: Callable[[str], bytes]) -> Callable[[str], bytes]:
    """Texts that name one of the vocabulary's added tokens go through the library whole: the name is that token's id."""
    names = [t.content for t in tok.get_added_tokens_decoder().values()]
    return lambda text: direct(tok, text) if any(n in text for n in names) else encode(text)


def direct(tok, text: str) -> bytes:
    return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()


def plain(piece: str) -> bool:
    """Letters alone, on which all engines agree."""
    return piece.isalpha() and (piece.isascii() or max(piece) < PLAIN_END)


def merger(tok) -> Callable[[str], bytes]:
    """Ids of one unit by the vocabulary's merges."""
    tokenize, letters = tok.model.tokenize, byte_letters()
    code = [n.to_bytes(4, "little") for n in range(max(tok.get_vocab().values()) + 1)]

    def merge(unit: str) -> bytes:
        if not unit.isascii() or not unit.isalpha():
            unit = unit.encode().decode("latin-1").translate(letters)
        return b"".join([code[t.id] for t in tokenize(unit)])

    return merge


def spaced(tok, entries: int) -> Callable[[str], bytes]:
    """For vocabularies that keep spaces: a piece's ids with the space before it."""
    merge = merger(tok)

    def units(run: str) -> bytes:
        if max(run) >= PLAIN_END:
            return direct(tok, run)
        parts = SPACED_UNITS.findall(run)
        if len(parts) == 1:
            return merge(run)
        return b"".join([memo[p[1:]] if p[0] == " " and len(p) > 1 else bare[p] for p in parts])

    def fresh(piece: str, memo: Memo) -> bytes:
        if not plain(core := piece.rstrip(".,")):
            return units(" " + piece)
        return merge(" " + piece) if core == piece else memo[core] + bare[piece[len(core) :]]

    bare, memo = Memo(lambda run, _: units(run) if run else b"", entries), Memo(fresh, entries)
    line_end = merge("\n")

    def encode(text: str) -> bytes:
        """A space belongs to the word behind it; of wider white space only the last character does, if it is a space."""
        nonlocal bare, memo
        if ODD_SPACE.search(text):
            return direct(tok, text)
        bare, memo = bare.bounded(), memo.bounded()
        out, led = [], False
        if not any(x in text for x in WIDE_PAIRS) and text[-1:] != "\n":
            for line in text.split("\n"):
                pieces = line.split(" ")
                out.append(bare[pieces[0]])
                del pieces[0]
                out.append(b"".join(map(memo.__getitem__, pieces)))
                out.append(line_end)
            del out[-1]
            return b"".join(out)
        parts = WIDE_SPACE.split(text)
        for k, part in enumerate(parts):
            if k % 2 and (k + 2 < len(parts) or parts[-1]):
                led = part[-1] == " "
                out += [bare[x] for x in (part[:-1], "" if led else part[-1])]
            elif k % 2:  # the text ends here
                out.append(bare[part])
            elif part:
                first, *rest = part.split(" ")
                out.append(memo[first] if led else bare[first])
                out += map(memo.__getitem__, rest)
        return b"".join(out)

    return encode


def lowered(tok, entries: int) -> Callable[[str], bytes]:
    """For vocabularies without case and spaces."""
    merge = merger(tok)

    def fresh(piece: str, memo: Memo) -> bytes:
        core = piece.rstrip(".,")
        if core != piece and plain(core) and "\u0130" not in core:  # its lower case ends in a mark
            return memo[core] + memo[piece[len(core) :]]
        low = piece.lower()
        if not piece.isascii():
            if max(piece) >= PLAIN_END or "\u0130" in piece or "\u03c2" in low or not unicodedata.is_normalized("NFC", piece):
                return direct(tok, piece)
        if low != piece:
            return memo[low]
        parts = [piece] if piece.isalpha() else LOWER_UNITS.findall(piece)
        return merge(piece) if len(parts) == 1 else b"".join([memo[p] for p in parts])

    memo = Memo(fresh, entries)

    def encode(text: str) -> bytes:
        nonlocal memo
        if ODD_SPACE.search(text):
            return direct(tok, text)
        memo = memo.bounded()
        return b"".join(map(memo.__getitem__, text.split()))

    return encode
