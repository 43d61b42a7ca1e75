"""Language ID by multilingual mixture inference.

Each language is a hashed byte-trigram model, counted over all labelled training texts. A text is a mixture: each of
its words is drawn from one language, with the words' likelihoods taken from the trigram models. Expectation
maximisation finds the proportions; the language set is the one with the best penalised likelihood among nested sets
in order of proportion, half a log of the number of words times ``PENALTY`` for each language after the first.

A null text and one without a letter are ``und`` with score 0; so is everything if there is nothing to learn from.
Equal texts get equal predictions, repeated rows stay, a tie goes to the first language by name, long texts are used
whole, an empty table gives an empty one, and other columns are not looked at. The model is sent to every task, 256 KB a
language; more than ``MOST_LANGUAGES`` values in the language column are an error, never a silent cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._counts import class_counts
from larkspur.llm._store import read_table, ship
from larkspur.llm._text import _SPACE, raw_bytes, slices

BUCKETS = 1 << 16
MOST_LANGUAGES = 1000
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 4.0
#: Letters and a few numerals that are no digits; ``has_letter`` tells them apart.
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[_SPACE] = 32


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of the trigram around each byte that is not white space, the first of them in each word, and the
    first word of each text (one more entry at the end of both)."""
    data, offsets = raw_bytes(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    b = _FOLD[data]
    before, after = np.empty(n, np.uint32), np.empty(n, np.uint32)
    before[1:], after[:-1] = b[:-1], b[1:]
    begins = offsets[:-1][np.diff(offsets) > 0]
    before[begins] = 32
    after[np.concatenate([begins[1:], [n]]) - 1] = 32
    code = (before << np.uint32(16)) | (b << np.uint32(8)) | after
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    inside = b != 32
    word_at = np.flatnonzero(inside & (before == 32))
    rank = np.concatenate([[0], np.cumsum(inside)])
    first = np.concatenate([rank[word_at], [rank[-1]]])
    return bucket[inside].astype(np.int64), first, np.searchsorted(word_at, offsets)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and, for each, the log probability of each bucket; from every row with a language and a text."""

    def index(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bucket, word, text = trigrams(texts)
        return bucket, word[text]

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col), F.col(text_col))
    many = rows.select(lang_col).distinct().limit(MOST_LANGUAGES + 1).count()
    if many > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values in {lang_col}: this is no column of languages")
    counts = class_counts(rows, BUCKETS, index)
    names = sorted(counts)
    model = np.array([np.log(counts[k] + SMOOTHING) - np.log(counts[k].sum() + SMOOTHING * BUCKETS) for k in names], np.float32)
    return names, model.reshape(len(names), BUCKETS)


def _expect(like: np.ndarray, first: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood (without the words' scale) of each text for the languages it may have."""
    n = np.maximum(np.diff(first), 1)[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        r = like * share[owner]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        share = np.add.reduceat(r, first[:-1]) / n
    fit = np.log(np.maximum((like * share[owner]).sum(1), 1e-300))
    return share, np.add.reduceat(fit, first[:-1])


def infer(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    """Language proportions of each text, a row of zeros for one without words."""
    bucket, word, text = trigrams(texts)
    out = np.zeros((len(texts), len(model)))
    words = len(word) - 1
    if not words or not len(model):
        return out
    log_like = np.empty((words, len(model)))
    for k, m in enumerate(model):
        log_like[:, k] = np.add.reduceat(m[bucket].astype(np.float64), word[:-1])
    like = np.exp(np.maximum(log_like - log_like.max(1, keepdims=True), -200))
    some = np.flatnonzero(np.diff(text) > 0)
    first = np.concatenate([text[some], [words]])
    n = np.diff(first)
    owner = np.repeat(np.arange(len(some)), n)
    share, _ = _expect(like, first, owner, np.ones((len(some), len(model))))
    order = np.argsort(-share, axis=1, kind="stable")
    single = np.add.reduceat(np.log(like), first[:-1])
    # Where another language explains the whole text better than the one with the largest share, start from that.
    best = single.argmax(1)
    swap = np.flatnonzero(single[np.arange(len(some)), best] > single[np.arange(len(some)), order[:, 0]])
    for i in swap:
        order[i] = np.concatenate([[best[i]], order[i][order[i] != best[i]]])
    chosen = np.zeros_like(share)
    chosen[np.arange(len(some)), order[:, 0]] = 1.0
    value = single[np.arange(len(some)), order[:, 0]]
    price = 0.5 * PENALTY * np.log(np.maximum(n, 2))
    live = np.arange(len(some))
    for size in range(2, len(model) + 1):
        if not len(live):
            break
        allowed = np.zeros((len(live), len(model)))
        np.put_along_axis(allowed, order[live, :size], 1.0, axis=1)
        mine = np.isin(owner, live)
        f = np.concatenate([[0], np.cumsum(n[live])])
        s, fit = _expect(like[mine], f, np.repeat(np.arange(len(live)), n[live]), allowed)
        better = fit - (size - 1) * price[live] > value[live]
        value[live[better]] = (fit - (size - 1) * price[live])[better]
        chosen[live[better]] = s[better]
        live = live[better]
    out[some] = chosen
    return out


def predict(docs: DataFrame, names: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, mixture): the language of the largest proportion, that proportion, and all
    proportions as ``name:share`` in falling order."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                shares = infer(part, held.value)
                lang, score, mixture = [], [], []
                for value, share in zip(part, shares, strict=True):
                    text = value.as_py()
                    if not text or not share.any() or not has_letter(text):
                        lang.append("und")
                        score.append(0.0)
                        mixture.append("")
                        continue
                    order = np.argsort(-share, kind="stable")
                    lang.append(names[order[0]])
                    score.append(min(1.0, float(share[order[0]])))
                    mixture.append(",".join(f"{names[k]}:{share[k]:.3f}" for k in order if share[k] >= 0.0005))
                yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array(lang), pa.array(score, pa.float64()), pa.array(mixture)], names=["doc_id", "lang_pred", "score", "mixture"])
                at += len(part)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, mixture string")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    names, model = learn(docs.where(~F.coalesce(held_out, F.lit(False))).select("lang", "text"))
    found = predict(docs.select("doc_id", "text"), names, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "mixture")
