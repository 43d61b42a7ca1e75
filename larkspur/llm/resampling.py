"""Quality classifier by importance resampling.

Two generative models over hashed word unigrams and bigrams are counted: one over target texts (labelled good), one
over all raw texts. A text's log weight is the log ratio of the two, as the mean over its n-grams, shrunk towards 0 for short
texts, times ``TEMPER``: the summed ratio of so many n-grams, so that long texts do not win by length. Gumbel noise drawn
from the doc_id and the seed is added and the k largest sums are kept, which is sampling k texts without replacement in
proportion to the weights. k is a parameter, a number of texts or a share of those with words. Left out, it is the
number of texts that the target could have produced: those whose ratio is no more than ``MARGIN`` below that of the
lowest ``TAIL`` of the target texts, which the model has seen, so their ratios lie a little higher than those of others.

The target model is fitted on at most ``TARGET_SAMPLE`` labelled documents, those with the smallest digests; the raw
model, the ratios, k and the selection cover all documents. A null text and one without words has no weight and is
never kept. Without target texts all weights are equal and, if k is left out, every text with words is kept. The noise is
drawn from the id and the ratio, so null or repeated ids draw for themselves unless their texts are equal too; such rows
share one fate, at the cut as well. An empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._counts import class_counts
from larkspur.llm._store import drop, read_table, save, ship
from larkspur.llm._text import raw_bytes, slices, uniform, window_hashes, word_hashes

BUCKETS = 1 << 16
TARGET_SAMPLE = 20_000
SMOOTHING = 1.0
SHRINK = 20
TEMPER = 60.0
TAIL = 0.005
MARGIN = 0.03
BINS = 4096
SORT_MOST = 100_000


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and the pairs of neighbours of each text, and the first of each text."""
    data, offsets = raw_bytes(texts)
    words, first = word_hashes(data, offsets, fold=True)
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    out = np.empty((n, 2), np.int64)
    out[:, 0] = words >> shift
    out[:-1, 1] = window_hashes(words, 2) >> shift
    keep = np.ones((n, 2), bool)
    ends = first[1:][np.diff(first) > 0] - 1
    keep[ends, 1] = False  # no pair goes over the end of a text
    return out[keep], np.concatenate([[0], np.cumsum(keep.sum(1))])[first]


def fit(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log ratio of each bucket. targets: ids of target texts; those beyond TARGET_SAMPLE are not used."""
    ids = targets.select(F.col(id_col).alias("target_id")).where("target_id is not null").distinct()
    ids = ids.orderBy(F.md5(F.col("target_id").cast("string")), "target_id").limit(TARGET_SAMPLE)
    # At most TARGET_SAMPLE ids: small enough to send to every task, at any size of the corpus.
    rows = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(ids), F.col(id_col) == F.col("target_id"), "left")
    counts = class_counts(rows.select(F.when(F.col("target_id").isNotNull(), "target").otherwise("rest").alias("name"), F.col(text_col)), BUCKETS, ngrams)
    nothing = np.zeros(BUCKETS, np.int64)
    target = counts.get("target", nothing)
    raw = counts.get("rest", nothing) + target
    if not target.sum():
        return np.zeros(BUCKETS)
    log = lambda c: np.log(c + SMOOTHING) - np.log(c.sum() + SMOOTHING * BUCKETS)
    return log(target) - log(raw)


def ratios(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_grams, log_ratio): the shrunk mean, null for a text without words."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                found, first = ngrams(part)
                total = np.concatenate([[0.0], np.cumsum(held.value[found])])
                n = np.diff(first)
                value = (total[first[1:]] - total[first[:-1]]) / (n + SHRINK)
                yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(np.round(value, 9), pa.float64(), mask=n == 0)], names=["doc_id", "n_grams", "log_ratio"])
                at += len(part)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_grams long, log_ratio double")


def _narrowed(rows: DataFrame, column: str, need: int, falling: bool) -> tuple[float | int, float | int, int, int]:
    """(low, high, need, n): a range of the column's values that holds the need-th, its place among the n rows in it. Each
    pass counts BINS parts of the range and goes on with the part that holds the place, until at most SORT_MOST rows or
    one value are left."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    while n > SORT_MOST and low < high:
        ahead = (F.lit(high) - F.col(column)) if falling else (F.col(column) - F.lit(low))
        part = F.least(F.floor(ahead / F.lit(high - low) * BINS), F.lit(BINS - 1)).alias("part")
        counted = rows.where(F.col(column).between(low, high)).groupBy(part).agg(F.count("*"), F.min(column), F.max(column)).orderBy("part").collect()  # BINS rows at most
        for _, n, low, high in counted:
            if need <= n:
                break
            need -= n
    return low, high, need, n


def keep_largest(rows: DataFrame, key: str, k: int, tie: str) -> DataFrame:
    """rows with ``kept``: whether the row is among the k largest by key, ties by the smaller ``tie``, null last; never
    where key is null. Rows that agree in both share one fate. The rows should be a written table: it is read a few times,
    and no task or driver ever holds more than SORT_MOST rows or BINS counts, however the keys are spread."""
    present = rows.where(F.col(key).isNotNull())
    if k <= 0 or k >= present.count():
        return rows.withColumn("kept", F.col(key).isNotNull() & F.lit(k > 0))
    low, high, need, n = _narrowed(present, key, k, True)
    inside = present.where(F.col(key).between(low, high))
    known = inside.where(F.col(tie).isNotNull())
    if n <= SORT_MOST:
        cut, last = inside.orderBy(F.col(key).desc(), F.col(tie).asc_nulls_last()).select(key, tie).offset(need - 1).first()
    elif need > known.count():
        cut, last = low, None
    else:
        first, end, need, _ = _narrowed(known, tie, need, False)
        cut, last = low, known.where(F.col(tie).between(first, end)).orderBy(tie).select(tie).limit(SORT_MOST).offset(need - 1).first()[0] if first < end else first
    level = F.lit(True) if last is None else F.coalesce(F.col(tie) <= F.lit(last), F.lit(False))
    return rows.withColumn("kept", F.coalesce((F.col(key) > F.lit(cut)) | ((F.col(key) == F.lit(cut)) & level), F.lit(False)))


def texts_like_targets(scored: DataFrame, targets: DataFrame, id_col: str = "doc_id") -> int:
    """The number of texts whose ratio is no more than MARGIN below that of the lowest TAIL of the target texts: an exact
    quantile, so k does not depend on how rows are dealt out."""
    goal = targets.select(F.col(id_col).alias("target_id")).distinct()
    present = scored.where(F.col("log_ratio").isNotNull())
    seen = save(present.join(goal, F.col("doc_id") == F.col("target_id"), "left_semi").select("log_ratio"), "target-ratios")
    n = seen.count()
    if n:
        low, high, need, _ = _narrowed(seen, "log_ratio", math.ceil(TAIL * n), False)
        floor = low if low == high else seen.where(F.col("log_ratio").between(low, high)).orderBy("log_ratio").offset(need - 1).first()[0]
        present = present.where(F.col("log_ratio") >= F.lit(floor - MARGIN))
    drop(seen)
    return present.count()


def resample(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "gumbel", k: int | float | None = None, temper: float = TEMPER) -> DataFrame:
    """(doc_id, n_grams, log_ratio, gumbel_key, kept), a row for each row of docs. k: how many texts to sample, or with a float
    which share of those with words."""
    ship(docs.sparkSession)
    scored = ratios(docs, fit(docs, targets, id_col, text_col), id_col, text_col)
    draw = uniform(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("log_ratio").cast("string")), seed)
    scored = save(scored.withColumn("gumbel_key", F.col("log_ratio") * temper - F.log(-F.log(draw))), "resampling")
    if k is None:
        k = texts_like_targets(scored, targets, id_col)
    elif isinstance(k, float):
        k = round(k * scored.where("log_ratio is not null").count())
    return keep_largest(scored, "gumbel_key", k, "doc_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return resample(docs, good).select("doc_id", "n_grams", "log_ratio", "gumbel_key", "kept")
