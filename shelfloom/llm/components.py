"""Connected components of an edge list, by alternating large and small stars.

Every step is a min per vertex and a join on that vertex, so a vertex with very
many edges is aggregated before the shuffle and split by the skew join; no
vertex's neighbours are gathered in one place. Rounds grow with the logarithm of
the longest path. The edges of each round are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # a table of its own, so that the join shuffles both sides alone and can split a hot vertex
    least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = scratch.table(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    over = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return over.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: bigint, either way round) to (node, component): the least vertex reachable.

    Vertices without an edge are absent; loops and nulls are ignored; repeated
    edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    with scratch.scope() as held:
        now = scratch.table(now, "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        with scratch.scope() as new:
            now = scratch.only(spark, lambda edges=now: _small(scratch.table(_large(edges), "stars")), "edges")
        scratch.drop(spark, held)
        held = new
    scratch.keep(held)
    least = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(least)
