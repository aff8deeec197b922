"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


#: Shuffle partitions a file: edges are few beside the rows they come from, and every round writes them anew.
PER_FILE = 8


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, str]:
    """``edges``: (a, b) with b < a. Minima are pre-aggregated and staged: joined back as a table of their own, so that
    Spark can split the key of a node with very many edges, which it cannot beside an aggregate."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least, least_at = common.staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "minima", per_file=PER_FILE)
    joined = both.join(least.hint("merge"), F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct(), least_at


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns a, b); root: the component's smallest node.

    Loops and repeated edges are allowed. Each round is written to the shared folder, so the lineage stays short.
    """
    spark = edges.sparkSession
    now, at = common.staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", per_file=PER_FILE)
    seen = _mark(now)
    while seen[0]:
        for large in (True, False):
            star, least_at = _star(now, large)
            new, new_at = common.staged(star, "edges", per_file=PER_FILE)
            common.remove(spark, at, least_at)
            now, at = new, new_at
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
