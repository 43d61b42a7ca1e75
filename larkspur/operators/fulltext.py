"""Full-text search: tokens, posting lists, TF-IDF and boolean search, and the relevance of MATCH ... AGAINST."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The stopwords that results depend on. Pass another list as ``stopwords``.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "just", "don", "now",
)
MIN_LENGTH = 2


def tokens(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Runs of letters and digits in lower case, without short words and stopwords."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[\p{{L}}\p{{N}}]{{{MIN_LENGTH},}}+"), 0)
    return F.filter(words, lambda w: ~w.isin(*stopwords))  # a hash lookup for each word


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, length): the inverted index."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    return words.select("id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def occurrences(lower: Column, term: str) -> Column:
    """How often a token stands in lower-case text; what is around it is looked at only where its letters are."""
    return F.regexp_count(lower, F.lit(rf"{term}(?<![\p{{L}}\p{{N}}]{term})(?![\p{{L}}\p{{N}}])"))


def terms_of(spark: SparkSession, query: str) -> list[str]:
    """The distinct tokens of one query, in order."""
    return spark.range(1).select(F.array_distinct(tokens(F.lit(query)))).first()[0]


def search(docs: DataFrame, id_col: str, text_col: str, query: str, mode: str = "or", top: int | None = 100) -> DataFrame:
    """(id, score): sum over the query's terms of tf / length * ln(N / df). ``and`` needs all terms. Documents without a term
    are left out before anything is counted; the numbers of documents join as one row, and nothing else is shuffled."""
    wanted = terms_of(docs.sparkSession, query)
    if not wanted:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    lower = F.lower(F.col(text_col))
    held = docs.where(reduce(operator.or_, [lower.contains(t) for t in wanted])).select(F.col(id_col).alias("id"), lower.alias("text"))
    tf = held.select("id", "text", *[occurrences(F.col("text"), t).alias(f"tf_{i}") for i, t in enumerate(wanted)])
    counts = tf.agg(*[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(wanted))]).join(docs.agg(F.count("*").alias("n_docs")), F.lit(True))
    hit = [F.col(f"tf_{i}") > 0 for i in range(len(wanted))]
    tf = tf.where(reduce(operator.and_ if mode == "and" else operator.or_, hit))
    length = F.size(tokens(F.col("text")))
    rows = tf.withColumn("length", length).drop("text").join(counts, F.lit(True))
    parts = [F.when(hit[i], F.col(f"tf_{i}") / F.col("length") * F.ln(F.col("n_docs") / F.col(f"df_{i}"))).otherwise(0.0) for i in range(len(wanted))]
    out = rows.select("id", sum(parts[1:], parts[0]).alias("score"))
    return out.orderBy(F.col("score").desc(), "id").limit(top) if top else out


def expand(docs: DataFrame, id_col: str, text_col: str, query: str, first: int = 5, add: int = 5, top: int | None = 100) -> DataFrame:
    """Search WITH QUERY EXPANSION: the most frequent further tokens of the ``first`` best documents join the query."""
    best = search(docs, id_col, text_col, query, top=first).select(F.col("id").alias("best_id"))
    words = docs.join(best, F.col(id_col) == F.col("best_id"), "left_semi").select(F.explode(tokens(F.col(text_col))).alias("term"))
    known = terms_of(docs.sparkSession, query)
    more = words.where(~F.col("term").isin(known)).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(add)
    return search(docs, id_col, text_col, " ".join([*known, *(r["term"] for r in more.collect())]), top=top)  # ``add`` words


def match_against(text: Column, query_terms: list[str], boolean: bool = False) -> Column:
    """Sum over the terms of tf / length, divided by the number of terms; in boolean mode 0 unless all are there."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    counts = [occurrences(lower, t) for t in query_terms]
    some = reduce(operator.and_ if boolean else operator.or_, [n > 0 for n in counts])
    length = F.size(tokens(text))
    return F.when(some, sum(counts[1:], counts[0]) / F.greatest(length, F.lit(1)) / len(query_terms)).otherwise(0.0)
