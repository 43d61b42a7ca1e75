"""Regular expression functions. Flags: i, m, n (a dot matches line ends too)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.strings import substring

_FLAGS = {"i": "i", "m": "m", "n": "s", "c": ""}


def _with(pattern: str, flags: str) -> str:
    letters = "".join(_FLAGS[f] for f in flags)
    return f"(?{letters}){pattern}" if letters else pattern


def regexp_like(s: Column, pattern: str, flags: str = "") -> Column:
    return s.rlike(_with(pattern, flags)).cast("int")


def regexp_substr(s: Column, pattern: str, pos: int = 1, occurrence: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(substring(s, pos), F.lit(f"({pattern})"), 1), F.lit(occurrence))


def regexp_instr(s: Column, pattern: str, pos: int = 1, occurrence: int = 1, after: int = 0) -> Column:
    """1-based place of a match, or the one behind it; 0 if there is none."""
    rest = substring(s, pos)
    # The text up to the match is what is left once the match and all behind it are cut off.
    upto = F.regexp_replace(rest, f"(?s)^((?:.*?{pattern}){{{occurrence - 1}}}.*?){pattern}.*$", "$1")
    through = F.regexp_replace(rest, f"(?s)^((?:.*?{pattern}){{{occurrence}}}).*$", "$1")
    found = F.size(F.regexp_extract_all(rest, F.lit(f"({pattern})"), 1)) >= occurrence
    return F.when(found, F.char_length(through if after else upto) + pos).when(s.isNotNull(), 0).cast("int")


def regexp_replace(s: Column, pattern: str, new: str, pos: int = 1, occurrence: int = 0) -> Column:
    head, rest = F.left(s, F.lit(pos - 1)), substring(s, pos)
    if not occurrence:
        return F.concat(head, F.regexp_replace(rest, pattern, new))
    return F.concat(head, F.regexp_replace(rest, f"(?s)^((?:.*?{pattern}){{{occurrence - 1}}}.*?){pattern}", "$1" + new))
