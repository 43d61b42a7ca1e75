"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Every proposal starts from a prior for its kind. A validator (part ranges, digit counts, Luhn, mod-97) drops what
fails it. Words within ``CONTEXT`` characters before a span or ``BEHIND`` characters behind it raise its score; those
before it that speak of orders, versions and the like lower it. Spans of the four base kinds are always reported, with
their score; those of the added kinds only from ``THRESHOLD`` on.

A null text counts as empty and has no spans; the redacted form of null is null, of an empty text empty. Positions are
code points. The time is linear in the text's length, whatever it holds. Equal texts have equal spans, repeated rows
stay, an empty table gives an empty one, and a column that has the name of the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._store import read_table, ship

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + ADDED_KINDS
CONTEXT = 40
BEHIND = 20
THRESHOLD = 0.6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match begins at the start of a run of digits, so the search is linear: no start inside a run, no giving back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 "
    "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 "
    "SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*["']?([A-Za-z0-9_/+=-]{16,})""")
_NOT_DIGIT = re.compile(r"[^0-9]")

_HELPS = {
    "email": re.compile(r"(?i)mail|contact|write|kontakt|correo|courriel"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address|adresse"),
    "card": re.compile(r"(?i)card|visa|credit|karte|tarjeta|carte|payment"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|fax|anruf|llam|appel"),
    "iban": re.compile(r"(?i)iban|bank|account|konto|cuenta|compte"),
    "ssn": re.compile(r"(?i)ssn|social|security|tax"),
    "secret": re.compile(r"(?i)token|secret|password|key"),
}
_HURTS = re.compile(r"(?i)version|order|isbn|serial|invoice|build|release")
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.7}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _run_start(text: str, floor: int, at: int) -> int:
    while at > floor and text[at - 1] in _LOCAL_CHARS:
        at -= 1
    return at


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _email_spans(text: str) -> Iterator[tuple[int, int]]:
    # A match needs its "@", so looking at each one is the whole search: the run of local characters before it and
    # after the previous match, then the longest domain.
    last, at = 0, text.find("@")
    while at >= 0:
        if at >= last and (start := _run_start(text, last, at)) < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", at + 1)


def _iban_spans(text: str) -> Iterator[tuple[int, int]]:
    # A match runs on over the tokens behind, so the end at the country's length is tried first, then the whole. If
    # neither holds, an IBAN may still begin within it.
    at = 0
    while m := _IBAN.search(text, at):
        a, b = m.span()
        places = [i for i in range(a, b) if text[i] != " "]
        n = _IBAN_LENGTH.get(m[0][:2], len(places))
        ends = [places[n - 1] + 1] if n < len(places) and text[places[n - 1] + 1] == " " else []
        end = next((e for e in [*ends, b] if mod97(text[a:e])), None)
        if end:
            yield a, end
        at = end or a + 1


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _email_spans(text):
        yield "email", a, b
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for a, b in _iban_spans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()
    for m in _SECRET.finditer(text):
        if any(c.isdigit() for c in m[1]):
            yield "secret", *m.span(1)


def find_spans(text: str | None) -> list[Span]:
    """All spans of one text, by kind in the order of KINDS, then by start."""
    out = []
    for kind, a, b in _proposals(text or ""):
        near = text[max(0, a - CONTEXT) : a]
        helps = _HELPS[kind].search(near) or _HELPS[kind].search(text[b : b + BEHIND])
        score = _PRIOR[kind] + (0.25 if helps else 0) - (0.3 if _HURTS.search(near) else 0)
        score = round(min(1.0, max(0.0, score)), 3)
        if kind in BASE_KINDS or score >= THRESHOLD:
            out.append(Span(kind, a, b, score))
    return out


SPANS_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([[s._asdict() for s in find_spans(t.as_py())] for t in texts], _ARROW_SPANS)


def redact_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first to begin names the whole."""
    if text is None:
        return None
    parts, at, held = [], 0, None
    for s in sorted(find_spans(text), key=lambda s: (s.start, -s.end, s.kind)):
        if held and s.start < held[1]:
            held = (held[0], max(held[1], s.end), held[2])
            continue
        if held:
            parts += [text[at : held[0]], f"[{held[2].upper()}]"]
            at = held[1]
        held = (s.start, s.end, s.kind)
    if held:
        parts += [text[at : held[0]], f"[{held[2].upper()}]"]
        at = held[1]
    return "".join([*parts, text[at:]])


def _redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([redact_text(t.as_py()) for t in texts], pa.string())


def with_spans(docs: DataFrame, text_col: str = "text", out_col: str = "pii_spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end, score)."""
    ship(docs.sparkSession)
    return docs.withColumn(out_col, F.arrow_udf(_spans, SPANS_TYPE)(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind."""
    ship(docs.sparkSession)
    return docs.withColumn(text_col, F.arrow_udf(_redacted, "string")(F.col(text_col)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, out_col="found").select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    score = F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), score)
