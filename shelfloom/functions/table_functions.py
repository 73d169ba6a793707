"""Table functions for SQL: rows of a partition in order to rows of another shape."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Sessionize:
    """``sessionize(TABLE(t), 'user', 'at', gap)``: (the user column, session_start, session_end, n): rows of a user less than ``gap`` apart.

    The table is partitioned by the user column and ordered by the time column, both
    named by constants and checked before the query runs; times are integers. The
    state is that of one session, however long a partition is. Null times are
    skipped; null users are one user.
    """

    def __init__(self) -> None:
        self.now: tuple[Any, int, int, int] | None = None

    @staticmethod
    def analyze(table: AnalyzeArgument, user: AnalyzeArgument, at: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or not isinstance(table.dataType, StructType):
            raise ValueError("the first argument is a table")
        for name in (user, at):
            if not name.isConstantExpression or name.value not in table.dataType.names:
                raise ValueError(f"no column {name.value}")
        if not gap.isConstantExpression or gap.value <= 0:
            raise ValueError("the gap is a constant above zero")
        counts = [StructField(n, LongType()) for n in ("session_start", "session_end", "n")]
        return AnalyzeResult(schema=StructType([table.dataType[user.value], *counts]), partitionBy=[PartitioningColumn(f"`{user.value}`")], orderBy=[OrderingColumn(f"`{at.value}`")])

    def eval(self, row: Row, user: str, at: str, gap: int) -> Iterator[tuple]:
        who, when = row[user], row[at]
        if when is None:
            return
        if self.now is not None and when - self.now[2] < gap:
            self.now = (who, self.now[1], when, self.now[3] + 1)
            return
        if self.now is not None:
            yield self.now
        self.now = (who, when, when, 1)

    def terminate(self) -> Iterator[tuple]:
        if self.now is not None:
            yield self.now


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("sessionize", udtf(Sessionize))

# Spark plans these in Python processes of the driver's that have no files of this package: classes go by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
