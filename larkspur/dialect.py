"""A text pre-pass from T-SQL to Spark SQL: identifiers, string prefixes, TOP and a few function names."""

from __future__ import annotations

import re

_STRINGS = re.compile(r"'(?:[^']|'')*'")
_WORDS = (
    (re.compile(r"\[([^\]\d][^\]]*)\]"), r"`\1`"), (re.compile(r"\bdbo\.", re.I), ""), (re.compile(r"\bGETDATE\(\)|\bSYSDATETIME\(\)", re.I), "localtimestamp()"),
    (re.compile(r"\bISNULL\(", re.I), "coalesce("), (re.compile(r"\bLEN\(", re.I), "char_length("), (re.compile(r"\bCHARINDEX\(", re.I), "locate("),
    (re.compile(r"\bNEWID\(\)", re.I), "uuid()"), (re.compile(r"^\s*SET\s+NOCOUNT\s+(ON|OFF)\s*;?\s*$", re.I | re.M), ""), (re.compile(r"^\s*GO\s*$", re.I | re.M), ""),
)
_TOP = re.compile(r"(?is)^(\s*SELECT\s+(?:DISTINCT\s+)?)TOP\s*\(?\s*(\d+)\s*\)?\s+(.*?);?\s*$")


def translate(text: str) -> str:
    """Strings are left as they are."""
    held: list[str] = []

    def keep(m: re.Match) -> str:
        held.append(m[0])
        return f"\0{len(held) - 1}\0"

    out = _STRINGS.sub(keep, text)
    out = re.sub(r"\bN(?=\0)", "", out)
    for pattern, new in _WORDS:
        out = pattern.sub(new, out)
    out = _TOP.sub(r"\1\3 LIMIT \2", out.strip())
    return re.sub("\0(\\d+)\0", lambda m: held[int(m[1])], out)
