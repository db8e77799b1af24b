"""Pieces of DuckDB SQL that several oracles of this folder share."""

from __future__ import annotations

#: A one-row CTE with the table of CRC-32, made from its polynomial.
CRC_TABLE = "crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) r(i)))"


def crc32(octets: str) -> str:
    """The unsigned CRC-32 of a list of octets, beside the table t of CRC_TABLE."""
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {octets}), lambda c, o: xor(c >> 8, t[1 + (xor(c, o) & 255)])))"


def latin_octets(text: str) -> str:
    """The UTF-8 octets of a text without code points above U+00FF."""
    return f"flatten([CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6)::BIGINT, 128 + (ord(x) & 63)::BIGINT] END FOR x IN string_split({text}, '')])"
