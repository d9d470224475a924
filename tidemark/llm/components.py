"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), all in joins.

Every step works on edges alone: neighbours are never gathered, minima are aggregated before their shuffle, and the least
neighbour of a node with very many edges reaches them by broadcast (`join_counted`), so that no task gets all of them.
Each round is written to the shared folder, which cuts the lineage; the rounds' tables are deleted at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import join_counted, settled, written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node in `edges` (longs a and b; loops are ignored).

    Nodes without an edge do not occur. Repeated edges and both directions of an edge may occur. Rounds go on until
    nothing changes.
    """
    return settled(spark, lambda: _components(spark, edges), "components")


def _components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = written(spark, e, "edges"), None
    now = _state(e)
    while now != seen:
        e, seen = _round(spark, e, now[0]), now
        now = _state(e)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(e: DataFrame) -> tuple:
    """Number of edges, and a sum that tells two sets of edges apart."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _round(spark: SparkSession, e: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step over `n` edges u > v. Minima are written down, so that each join is one of two
    tables, which adaptive execution can split."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("u", "m"))
    least = written(spark, least, "least", 2 * n)
    large = join_counted(both.filter("v > u"), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    large = written(spark, large, "large", n)
    low = written(spark, large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "low", n)
    small = join_counted(large, low, "u", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(spark, small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges", 2 * n)
