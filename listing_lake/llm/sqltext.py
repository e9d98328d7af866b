"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, by its eight steps for each (3988292384 is the usual polynomial, reversed)."""
    at = f"list_transform(range(1, 2 * strlen({text}) + 1, 2), lambda i: ('0x' || substr(hex({text}), i, 2))::BIGINT)"
    bit = "lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
    step = f"lambda c, b: list_reduce(range(8), {bit}, xor(c, b))"
    return f"xor(4294967295, list_reduce({at}, {step}, 4294967295::BIGINT))"
