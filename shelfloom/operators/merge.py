"""Upserts, deletes and other table changes, as plans over (target, source).

A change gives the new state of the table; write it to a new folder and swap. A
key's rows meet in one aggregation or join on the key, both sides hashed alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (end it with a tie-break)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``source`` in place of those of ``target`` with their key; of several in ``source`` the first in ``order``."""
    new = latest(source, keys, order)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``target`` and the rows of ``source`` with a new key."""
    return target.unionByName(latest(source.join(target.select(*keys), keys, "left_anti"), keys, order))


def partial_update(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of ``target`` replaced where ``source`` has a value for the key (unique in ``source``)."""
    changed = [c for c in source.columns if c not in keys]
    new = source.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in changed])
    joined = target.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in changed else F.col(c) for c in target.columns])


def delete(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source.select(*keys), keys, "left_anti")


def replace_groups(target: DataFrame, source: DataFrame, group: str) -> DataFrame:
    """``source`` in place of all rows of ``target`` of the groups that it has."""
    return target.join(source.select(group).distinct(), group, "left_anti").unionByName(source)


def merge_cells(cells: DataFrame, key: str, column: str, value: str, order: str) -> DataFrame:
    """Writes (key, column, value, order) to (key, updates map): the last value of each cell."""
    last = cells.groupBy(key, column).agg(F.max_by(value, order).alias(value))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, value)))).alias("updates"))


def capped_history(df: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__n") <= keep).drop("__n")
