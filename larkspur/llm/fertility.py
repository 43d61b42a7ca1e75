"""Quality rules by tokeniser fertility, with the plain word counts that they start from.

A public vocabulary with byte fallback measures each text: characters per token, the share of tokens that are byte
fallbacks, and the entropy of its tokens in bits, as a share of the largest that so many tokens can have. Bands of
accepted values are made for each language (for each script where the language is null) from all documents that
pass the base rules: the median plus or minus ``WIDTH`` robust deviations, never narrower than ``FLOOR``, and wider
for short texts by ``NOISE`` over the root of their tokens. The fewer documents a group has below ``LEAST``, the wider
its band, by the root of LEAST / n, so nothing jumps at LEAST. The quartiles of fewer than ``JUDGES`` documents span
them all; such a group's documents are judged by the band of their script, as much wider. Other scripts never judge.

A null text has no words and fails the base rules; so does an empty one. Nothing is dropped: every row of the input
has one of the output, repeated rows included, and extra columns stay as they are; only one that is called like the
result is replaced. Long texts are encoded in parts whose tokens are those of the whole. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm._store import read_table, save, ship
from larkspur.llm._text import SEPARATORS, raw_bytes, slices, window_hashes, word_hashes
from larkspur.llm.token_counts import marks_begin_pieces, safe_pieces, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
METRICS = ("chars_per_token", "fallback_share", "token_entropy")
#: Robust deviations on either side of the median that a band spans, the least half-width of each metric's band, and
#: the sampling error that is allowed for at one token.
WIDTH = {"chars_per_token": 3.5, "fallback_share": 8.0, "token_entropy": 6.0}
FLOOR = {"chars_per_token": 0.12, "fallback_share": 0.05, "token_entropy": 0.1}
NOISE = {"chars_per_token": 1.0, "fallback_share": 0.5, "token_entropy": 0.5}
LEAST = 50
JUDGES = 4
DIGITS = 3
_FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), ("chars_per_token", pa.float64()),
    ("fallback_share", pa.float64()), ("token_entropy", pa.float64()), ("script", pa.string()),
]
_TYPE = pa.struct(_FIELDS)
_DDL = "struct<" + ",".join(f"{n}:{ {'int64': 'bigint', 'double': 'double', 'string': 'string'}[str(t)] }" for n, t in _FIELDS) + ">"
#: First code points of blocks and the script they start; a rule of thumb by block, not the full Unicode table.
_BLOCKS = (
    (0x41, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Syriac"), (0x750, "Arabic"), (0x780, "Thaana"), (0x7C0, "Nko"),
    (0x800, "Other"), (0x8A0, "Arabic"), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"),
    (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"),
    (0x1400, "Syllabics"), (0x1680, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Yi"), (0xA4D0, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
)
_STARTS = np.array([b for b, _ in _BLOCKS])


@lru_cache(maxsize=2)
def _vocabulary(name: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
    fallback = np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(sp.get_piece_size())])
    return sp, fallback, marks_begin_pieces(sp)


def script_of(text: str) -> str:
    """The script of most letters of a text, by Unicode block."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    points = points[(points >= 0x41) & ~((points > 0x5A) & (points < 0x61)) & ~((points > 0x7A) & (points < 0xC0))]
    if not len(points):
        return "None"
    names = np.bincount(np.searchsorted(_STARTS, points, side="right") - 1, minlength=len(_BLOCKS))
    best: dict[str, int] = {}
    for (_, name), n in zip(_BLOCKS, names, strict=True):
        best[name] = best.get(name, 0) + int(n)
    return max(best, key=lambda k: (best[k], k))


def repeat_words(windows: np.ndarray, n_words: int) -> int:
    """Words that lie in 3-word windows found at least twice; windows: one hash for each."""
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    if not twice.any():
        return 0
    inside = np.zeros(n_words, bool)
    at = order[twice]
    for k in range(3):
        inside[at + k] = True
    return int(inside.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SEPARATORS)]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array, vocabulary: str = VOCABULARY) -> list[dict]:
    sp, fallback, cuts = _vocabulary(vocabulary)
    data, offsets = raw_bytes(texts)
    words, first = word_hashes(data, offsets, fold=False)
    windows, whole = window_hashes(words, 3), data.tobytes()
    out = []
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        raw = whole[offsets[i] : offsets[i + 1]]
        text = raw.decode("utf-8", "replace")
        ids = np.concatenate([np.array(sp.encode(piece), np.int64) for piece in (safe_pieces(text, space="drop") if cuts else (text,))])
        n, entropy = len(ids), 1.0
        if n > 1:
            c = np.bincount(ids)
            c = c[c > 0]
            entropy = float((np.log2(n) - (c * np.log2(c)).sum() / n) / np.log2(min(n, len(fallback))))
        out.append({
            "n_words": b - a,
            "word_chars": len(text) - (len(raw) - len(raw.translate(None, SEPARATORS))),
            "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
            "n_dup_lines": duplicate_lines(raw),
            "n_repeat_words": repeat_words(windows[a : max(a, b - 2)], b - a),
            "n_tokens": n,
            "chars_per_token": len(text) / n if n else 0.0,
            "fallback_share": float(fallback[ids].mean()) if n else 0.0,
            "token_entropy": entropy,
            "script": script_of(text),
        })
    return out


def fertility(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """A struct of the word counts and the fertility metrics of a text column."""

    @F.arrow_udf(_DDL)
    def metrics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([r for part in slices(texts) for r in measure(part, vocabulary)], _TYPE)

    return metrics(text)


def bands(good: DataFrame, by: str) -> DataFrame:
    """(key, n, wider, and mid and half of each metric): a row for each value of ``by``. The quartiles are exact ones of the
    metrics rounded to ``DIGITS``, from counts of each value, so they do not depend on how rows are dealt out. A group of n
    documents is to have its halves ``wider`` times."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, DIGITS).alias("value")) for m in METRICS]))
    values = good.select(F.col(by).alias("key"), each.alias("e")).groupBy("key", "e.metric", "e.value").agg(F.count("*").alias("many"))
    # Rounded metrics have some ten thousand values at most in a group, however many documents it has.
    upto = F.sum("many").over(W.partitionBy("key", "metric").orderBy("value"))
    values = values.withColumn("upto", upto).withColumn("n", F.sum("many").over(W.partitionBy("key", "metric")))
    low, mid, high = (F.min(F.when(F.col("upto") >= F.lit(q) * F.col("n"), F.col("value"))) for q in (0.25, 0.5, 0.75))
    rows = values.groupBy("key", "metric").agg(low.alias("low"), mid.alias("mid"), high.alias("high"), F.first("n").alias("n"))
    limits = []
    for m in METRICS:
        half = F.greatest(F.lit(FLOOR[m]), F.lit(WIDTH[m]) * (F.col("high") - F.col("low")) / F.lit(1.349))
        limits.append(F.max(F.when(F.col("metric") == m, F.struct(F.col("mid"), half.alias("half")))).alias(m))
    wider = F.sqrt(F.greatest(F.lit(LEAST) / F.col("n"), F.lit(1.0))).alias("wider")
    return rows.groupBy("key", "n").agg(*limits).select("key", "n", wider, *METRICS)


def with_verdict(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", vocabulary: str = VOCABULARY, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or those of its columns that are named) with a struct column ``fertility``: the metrics, ``base_failed``, the metrics' ``verdict`` (the first
    metric out of its band, or "ok") and ``kept``.

    The measured rows are written once to the shared folder, since the bands need all of them first.
    """
    spark = docs.sparkSession
    ship(spark)
    group = F.coalesce(F.col(lang_col) if lang_col else F.lit(None).cast("string"), F.concat(F.lit("script:"), F.col("fertility.script")))
    measured = docs.withColumn("fertility", fertility(F.col(text_col), vocabulary))
    failed = (F.col("fertility.n_words") < MIN_WORDS) | (100 * F.col("fertility.n_repeat_words") > 50 * F.col("fertility.n_words"))
    measured = measured.withColumn("fertility", F.struct("fertility.*", failed.alias("base_failed"), group.alias("band_of")))
    measured = save(measured.select(*([f"`{c}`" for c in docs.columns if c.lower() != "fertility"] if columns is None else columns), "fertility"), "fertility")
    good = measured.where(~F.col("fertility.base_failed")).select("fertility.*")
    own = save(bands(good, "band_of"), "bands")
    scripts = save(bands(good, "script").drop("wider"), "bands")
    # Joins, not broadcasts: Spark sends the tables of bands to every task only while they are small.
    joined = measured.join(own.select(F.col("key").alias("own_key"), F.col("n").alias("own_n"), F.col("wider").alias("own_wider"), F.struct(*METRICS).alias("own_bands")), F.col("fertility.band_of") == F.col("own_key"), "left")
    joined = joined.join(scripts.select(F.col("key").alias("script_key"), F.struct(*METRICS).alias("script_bands")), F.col("fertility.script") == F.col("script_key"), "left")
    by_own = F.coalesce(F.col("own_n"), F.lit(0)) >= JUDGES
    wider = F.coalesce("own_wider", F.sqrt(F.lit(float(LEAST))))
    verdict = F.lit("ok")
    for m in reversed(METRICS):
        band = F.when(by_own, F.col("own_bands")[m]).otherwise(F.col("script_bands")[m])
        half = band["half"] * wider
        value = F.col("fertility")[m]
        noise = F.lit(NOISE[m]) / F.sqrt(F.greatest(F.col("fertility.n_tokens"), F.lit(1)))
        out_of = (value > band["mid"] + half + noise) | ((value < band["mid"] - half - noise) & F.lit(m != "fallback_share"))
        verdict = F.when(F.coalesce(out_of, F.lit(False)), m).otherwise(verdict)
    ok = joined.withColumn("_verdict", verdict)
    kept = ~F.col("fertility.base_failed") & (F.col("_verdict") == "ok")
    return ok.withColumn("fertility", F.struct("fertility.*", F.col("_verdict").alias("verdict"), kept.alias("kept"))).drop("_verdict", "own_key", "own_n", "own_wider", "own_bands", "script_key", "script_bands")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The documents that no rule rejects, with their own columns, whatever their names."""
    own = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("own_row")
    rows = docs.select(F.col(text_col).alias("text"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("lang"), own)
    return with_verdict(rows, columns=["own_row"]).where("fertility.kept").select("own_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    f = [F.col(f"fertility.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "verdict", *METRICS)]
    return with_verdict(docs, columns=["doc_id"]).select("doc_id", *f)
