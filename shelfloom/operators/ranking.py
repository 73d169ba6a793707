"""Rank fusion and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.sources import sinks

K = 60


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows; each partition keeps ``n``, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def with_rank(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Row numbers from 1 within ``by``; without ``by``, for a list that ``top`` has bounded."""
    window = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window))


def contributions(lists: DataFrame, k: int = K, rank: str = "rank", weight: Column | None = None) -> DataFrame:
    return lists.withColumn("part", (weight if weight is not None else F.lit(1.0)) / (k + F.col(rank)))


def fuse(lists: DataFrame, key: str, k: int = K, weight: Column | None = None) -> DataFrame:
    """Long rank lists (key, rank, ...) to (key, score): sum of weight / (k + rank), six digits."""
    return contributions(lists, k, weight=weight).groupBy(key).agg(F.round(F.sum("part"), 6).alias("score"))


def fuse_hybrid(a: DataFrame, b: DataFrame, key: str, k: int = K, absent: int = 999) -> DataFrame:
    """Two ranked sets (key, rank) to (key, rank_a, rank_b, score); a set's absent keys rank ``absent``."""
    left, right = a.select(key, F.col("rank").alias("rank_a")), b.select(key, F.col("rank").alias("rank_b"))
    both = left.join(right, key, "full_outer").fillna(absent, ["rank_a", "rank_b"])
    part = lambda rank: F.when(F.col(rank) == absent, 0.0).otherwise(1.0 / (k + F.col(rank)))
    return both.withColumn("score", F.round(part("rank_a") + part("rank_b"), 6))


def max_normal(scored: DataFrame, lists: int, k: int = K, floor: float = 65.0) -> DataFrame:
    """Score as a share of the best possible one in per cent, and whether it passes the floor."""
    share = F.round(F.col("score") / (lists / (k + 1)) * 100, 2)
    return scored.withColumn("pct", share).withColumn("passes", share >= floor)


def min_max_normal(scored: DataFrame, score: str = "score") -> DataFrame:
    """Scores scaled to 0-100 between the least and greatest of all; 100 if they are equal. One row of extremes is broadcast."""
    ends = scored.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    spread = F.col("__hi") - F.col("__lo")
    value = F.when(spread == 0, 100.0).otherwise(100 * (F.col(score) - F.col("__lo")) / (spread + 1e-9))
    return scored.crossJoin(F.broadcast(ends)).withColumn("normal", F.round(value, 2)).drop("__lo", "__hi")


def union_lists(lists: dict[str, DataFrame]) -> DataFrame:
    """Lists by name to one long list with a column ``list``."""
    return reduce(DataFrame.unionByName, [df.withColumn("list", F.lit(name)) for name, df in lists.items()])


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def numbered(df: DataFrame, order: Column, name: str = "number") -> DataFrame:
    """Row numbers from 1 over a whole table of any size, without gathering it: a written range sort, and the row counts of its partitions."""
    path = sinks.folder(df.sparkSession, "numbered")
    ids = df.withColumn("__order", order).repartitionByRange("__order").sortWithinPartitions("__order").withColumn("__id", F.monotonically_increasing_id())
    ids.drop("__order").write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumn("__part", F.shiftright("__id", 33))
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    # as many rows as the sort has partitions
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    at = F.coalesce("__before", F.lit(0)) + F.col("__id").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(before), "__part").withColumn(name, at).drop("__part", "__id", "__before")
