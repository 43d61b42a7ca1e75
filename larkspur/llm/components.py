"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._store import drop, save

#: Parts that the nodes of one label are dealt out to.
SALTS = 32


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of some link with the smallest node that it reaches. Null ends and loops are ignored.

    Every round each node takes the smallest label around it, then the label of that label, so the rounds grow with
    the logarithm of the longest chain. Labels are written after each round; a node's links are pre-aggregated to
    a minimum before anything is joined, so a node with very many links is no hot spot.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    both = save(both.union(both.select("v", "u")).distinct(), "links")
    labels = save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"), "labels")
    while True:
        around = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(around, F.col("node") == F.col("u")).select("node", "root", F.least("root", "near").alias("next"))
        # A large component's nodes share one label, so its step goes to copies of the label's row, one for each salt.
        heads = step.select(F.col("next").alias("head")).distinct()
        moves = heads.join(step.select(F.col("node").alias("via"), F.col("next").alias("far")), F.col("head") == F.col("via")).where("far < head")
        moves = moves.select("head", "far", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        own = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
        to = F.coalesce("far", "next")
        new = step.join(moves, (F.col("next") == F.col("head")) & (own == F.col("salt")), "left").select("node", to.alias("root"), (to != F.col("root")).alias("changed"))
        new = save(new, "labels")
        changed = new.where("changed").limit(1).count()
        drop(labels)
        labels = new.drop("changed")
        if not changed:
            drop(both)
            return labels
