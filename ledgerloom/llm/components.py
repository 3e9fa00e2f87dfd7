"""Classes of linked keys, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage


def roots(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the edges whose root, the least node of its class, is another node.

    Each round links all neighbours of a node larger than itself, then all smaller ones, to the least of
    them, until every edge leads to a root; the number of rounds grows with the logarithm of the longest
    chain. Only edges are kept, cut off by a checkpoint each round. Self links and nulls are ignored,
    repeated edges count once, and no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = cut_lineage(e)
    seen = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (now["n"], now["h"])
        e = cut_lineage(_small(_large(e)))


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).where("u != v").distinct()
