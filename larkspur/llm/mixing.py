"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only.

Targets. Sources in code point order, null last, weigh ``WEIGHTS`` in turn and share the corpus's words. No target is
above ``MOST`` times its source's words; what is above is shared out again by weight until none is.

Inclusion. Within a source a document of b bits of length (b = bit length of its word count) gets k / b copies on
average, at most ``MOST``, with the k at which the expected words are the target: long documents are repeated
somewhat less often. The whole part of that number is allocated for certain. The fractional part p is the
inclusion probability of one more copy: documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the first of them are taken up to the words that the source still lacks, to the
nearest document. u is a digest of doc_id and text, so reruns agree, and null or repeated ids draw for themselves.

Where the ranking is cut is found from partial sums over ``BINS`` equal parts of the rank's range and over as many of the
one in which the cut falls; only the one fine part of each source that holds it is sorted. What is joined to the documents has a row for each source and bit
length.

A null text has no words; such documents and empty ones are taken with whole copies only, which add nothing.
Rows that agree in doc_id, source and text share one fate, and are counted, not sorted, at the cut. An empty table
gives an empty mix. Extra columns stay in the mix, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm._store import read_table, save
from larkspur.llm._text import uniform

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 1 << 10
SEED = "mix"
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def draw(ident: Column, text: Column, seed: str = SEED) -> Column:
    return uniform(F.concat_ws(":", F.coalesce(ident.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))), seed)


def bit_length(size: Column) -> Column:
    return F.greatest(F.length(F.bin(size)), F.lit(1))


def fill(rows: DataFrame, keys: list[str], total: Column, amount: str, limit: str, out: str) -> DataFrame:
    """Water filling: shares of ``total`` in proportion to ``amount``, none above ``limit``, within each of ``keys``."""
    order = W.partitionBy(*keys).orderBy(F.try_divide(F.col(limit), F.col(amount)).asc_nulls_first(), F.col("fill_tie").asc_nulls_last())
    whole = W.partitionBy(*keys)
    before = F.coalesce(F.sum(limit).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(amount).over(order.rowsBetween(0, W.unboundedFollowing))
    full = (F.col(amount) <= 0) | ((total - before) * F.col(amount) >= F.col(limit) * rest)
    rows = rows.withColumn("fill_full", full)
    used = F.sum(F.when(F.col("fill_full"), F.col(limit)).otherwise(0.0)).over(whole)
    free = F.sum(F.when(F.col("fill_full"), 0.0).otherwise(F.col(amount))).over(whole)
    share = F.when(F.col("fill_full"), F.col(limit)).otherwise(F.try_divide(F.greatest(total - used, F.lit(0.0)) * F.col(amount), free))
    return rows.withColumn(out, share).drop("fill_full")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target), a row for each source; sized has (source, size)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The number of sources does not grow with the documents; ordering them is one small sort.
    rank = F.row_number().over(W.partitionBy("everything").orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("everything", F.lit(1)).withColumn("weight", weight).withColumn("fill_tie", F.col("source"))
    per = per.withColumn("limit", F.lit(float(MOST)) * F.col("source_size").cast("double"))
    total = F.sum(F.col("source_size").cast("double")).over(W.partitionBy("everything"))
    per = per.withColumn("words_of_all", total)
    return fill(per, ["everything"], F.col("words_of_all"), "weight", "limit", "target").select("source", "source_size", "target")


def plan(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sized: (doc_id, source, size, draw). Returns a table by (source, bits) with certain copies and inclusion
    probability, and one by source with the cut in the ranking."""
    bits = bit_length(F.col("size"))
    by_bits = sized.groupBy("source", bits.alias("bits")).agg(F.sum("size").cast("double").alias("words"))
    targets = source_targets(sized)
    same = F.col("source").eqNullSafe(F.col("t_source"))
    by_bits = by_bits.join(targets.withColumnRenamed("source", "t_source"), same).drop("t_source")
    by_bits = by_bits.withColumn("amount", F.col("words") / F.col("bits")).withColumn("limit", F.lit(float(MOST)) * F.col("words")).withColumn("fill_tie", F.col("bits"))
    by_bits = fill(by_bits, ["source"], F.col("target"), "amount", "limit", "share")
    copies = F.when(F.col("words") > 0, F.least(F.lit(float(MOST)), F.col("share") / F.col("words"))).otherwise(0.0)
    by_bits = by_bits.withColumn("copies", copies).withColumn("certain", F.floor("copies")).withColumn("chance", F.col("copies") - F.floor("copies"))
    lacks = F.sum(F.col("certain") * F.col("words")).over(W.partitionBy("source"))
    by_bits = by_bits.withColumn("lacks", F.col("target") - lacks)
    by_bits = save(by_bits.select("source", "bits", "source_size", "target", "certain", "chance", "lacks"), "mix-bits")
    ranked = rank(sized, by_bits).where("chance > 0 and size > 0")
    coarse = _in_cut(ranked.withColumn("before", F.lit(0.0)).withColumn("wide", F.floor(F.col("bin") / BINS)), "wide").drop("cut")
    inside = _in_cut(coarse, "bin").withColumnRenamed("cut", "cut_bin")
    inside = inside.groupBy("source", "place", "doc_id", "size", "before", "lacks", "cut_bin").agg(F.sum("size").alias("words"))
    order = W.partitionBy("source").orderBy("place", "doc_id", "size")
    earlier = F.col("before") + F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("fits", earlier + F.col("words") / 2 <= F.col("lacks"))
    last = F.max(F.when(F.col("fits"), _key())).alias("last")
    ends = inside.groupBy(F.col("source").alias("e_source")).agg(F.first("cut_bin").alias("cut_bin"), last)
    return by_bits, save(ends, "mix-cut")


def _in_cut(rows: DataFrame, part: str) -> DataFrame:
    """Of each source the rows in the part of the ranking at whose end the words, with those ``before`` it, go beyond what the
    source lacks; ``cut`` is that part and ``before`` the words ahead of it. A source has BINS parts at most."""
    sums = rows.groupBy("source", "lacks", "before", part).agg(F.sum("size").cast("double").alias("words"))
    upto = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy(part))
    over = sums.withColumn("upto", upto).where("upto > lacks")
    ends = over.groupBy(F.col("source").alias("c_source")).agg(F.min(part).alias("cut"), F.min_by(F.col("upto") - F.col("words"), part).alias("c_before"))
    return rows.join(ends, F.col("source").eqNullSafe(F.col("c_source")) & (F.col(part) == F.col("cut"))).withColumn("before", F.col("c_before")).drop("c_source", "c_before")


def _key() -> Column:
    return F.struct(F.col("place").alias("place"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))


def rank(sized: DataFrame, by_bits: DataFrame) -> DataFrame:
    """sized with what by_bits has and each row's place in the ranking, as odds over one plus odds."""
    b = by_bits.withColumnRenamed("source", "b_source").withColumnRenamed("bits", "b_bits")
    rows = sized.join(b, F.col("source").eqNullSafe(F.col("b_source")) & (bit_length(F.col("size")) == F.col("b_bits"))).drop("b_source", "b_bits")
    u, p = F.col("draw"), F.col("chance")
    odds = F.try_divide(u / (1 - u), p / (1 - p))
    place = F.when(p > 0, odds / (1 + odds))
    return rows.withColumn("place", place).withColumn("bin", F.floor(F.col("place") * BINS * BINS).cast("int"))


def _with_copies(rows: DataFrame, by_bits: DataFrame, ends: DataFrame) -> DataFrame:
    """A source without a row in ends takes all that has a chance."""
    rows = rank(rows, by_bits).join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    inside = F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))
    inside = inside | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(_key() <= F.col("last"), F.lit(False)))
    more = (F.col("chance") > 0) & (F.col("size") > 0) & F.coalesce(inside, F.lit(False))
    return rows.withColumn("copies", F.col("certain") + more.cast("long"))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row for each row of docs."""
    sized = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col)).alias("draw")), "mix-sizes")
    by_bits, ends = plan(sized)
    return _with_copies(sized, by_bits, ends).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its own columns only."""
    own = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("own_row")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw(F.col(id_col), F.col(text_col)).alias("draw"), own)
    by_bits, ends = plan(save(rows.select("doc_id", "source", "size", "draw"), "mix-sizes"))
    taken = _with_copies(rows, by_bits, ends).where("copies > 0")
    return taken.select("own_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("own_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
