"""Writes to a sink that may fail, as a stream: a bounded batch each time, retries by key, dead letters.

What is still to be sent is a table in the shared folder. A micro-batch adds its rows
to it, takes at most ``most`` of them, oldest first, and hands those to ``send``, which
says for each key whether it went. Sent rows go to ``done``; a row that failed waits
in the queue with its count of attempts and joins the next batch; after ``attempts``
it goes to ``dead``. ``flush`` goes on until the queue is empty, as at a stop.

The outcome of a batch is written under its number before the queue moves on. A batch
that runs again after its outcome was written sends nothing, so a row is neither lost
nor sent twice; one that is lost between sending and writing is sent again with the
same keys and versions, by which an idempotent sink knows it.

With ``newest`` the queue is a write-behind cache: of several writes to one cell only
the newest is kept, and its attempts start again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfloom.operators import ranking
from shelfloom.sources import sinks, tables

Send = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Outbox:
    """Rows with a unique ``key`` that grows with their age in ``path``; ``send`` takes rows with ``attempts`` (this one included) and gives (key, ok)."""

    path: str
    key: str
    send: Send
    most: int = 100
    attempts: int = 3
    newest: tuple[str, ...] = ()

    def _states(self, spark: SparkSession, kind: str) -> list[tuple[int, int]]:
        """Numbers (batch, round of a flush) of the whole tables of a kind."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(at):
            return []
        names = [s.getPath().getName() for s in store.listStatus(at)]
        whole = [n for n in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS"))]
        return sorted(tuple(map(int, n.split("-"))) for n in whole)

    def _read(self, spark: SparkSession, kind: str, number: tuple[int, int], schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path}/{kind}/{number[0]}-{number[1]}")

    def _round(self, rows: DataFrame, number: tuple[int, int]) -> None:
        """One batch: ``rows`` join what is queued."""
        spark = rows.sparkSession
        fresh = rows.withColumn("attempts", F.lit(0))
        schema = fresh.schema
        before = [n for n in self._states(spark, "queue") if n < number]
        queue = fresh if not before else self._read(spark, "queue", before[-1], schema).unionByName(fresh)
        queue = queue.withColumn("attempts", F.coalesce("attempts", F.lit(0)))
        # a batch that runs again finds rows that it has queued before
        queue = queue.groupBy(self.key).agg(F.max_by(F.struct(*queue.columns), "attempts").alias("x")).select("x.*")
        if self.newest:
            w = Window.partitionBy(*self.newest).orderBy(F.desc(self.key))
            queue = queue.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
        place = f"{number[0]}-{number[1]}"
        if number not in self._states(spark, "outcome"):
            taken = ranking.top(queue, [F.asc(self.key)], self.most).withColumn("attempts", F.col("attempts") + 1)
            told = self.send(taken).select(F.col(self.key).alias("_key"), F.col("ok").alias("_ok"))
            said = taken.join(told, F.col(self.key) == F.col("_key"), "left").select(*taken.columns, F.coalesce("_ok", F.lit(False)).alias("ok"))
            said.write.mode("overwrite").parquet(f"{self.path}/outcome/{place}")
        said = spark.read.parquet(f"{self.path}/outcome/{place}")
        again = said.filter(~F.col("ok") & (F.col("attempts") < self.attempts)).drop("ok")
        left = queue.join(said.select(self.key), self.key, "left_anti").select(*schema.names).unionByName(again.select(*schema.names))
        left.write.mode("overwrite").parquet(f"{self.path}/queue/{place}")
        for old in before[:-1]:
            sinks.delete(spark, f"{self.path}/queue/{old[0]}-{old[1]}")

    def batch(self, rows: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        self._round(rows, (number, 0))

    def flush(self, spark: SparkSession) -> int:
        """Batches without new rows until the queue is empty; how many there were."""
        rounds = 0
        while (states := self._states(spark, "queue")) and not (queue := spark.read.parquet(f"{self.path}/queue/{states[-1][0]}-{states[-1][1]}")).isEmpty():
            self._round(queue.filter("false").drop("attempts"), (states[-1][0], states[-1][1] + 1))
            rounds += 1
        return rounds

    def queued(self, spark: SparkSession) -> DataFrame | None:
        """What is still to be sent; None before the first batch."""
        states = self._states(spark, "queue")
        return spark.read.parquet(f"{self.path}/queue/{states[-1][0]}-{states[-1][1]}") if states else None

    def outcomes(self, spark: SparkSession, schema: str) -> DataFrame:
        """Every attempt: the rows as they were sent, with attempts and ok."""
        whole = f"{schema}, attempts int, ok boolean"
        if not tables.is_folder(spark, f"{self.path}/outcome"):
            return spark.createDataFrame([], whole)
        return spark.read.schema(whole).option("recursiveFileLookup", "true").parquet(f"{self.path}/outcome")

    def done(self, spark: SparkSession, schema: str) -> DataFrame:
        return self.outcomes(spark, schema).filter("ok").drop("ok")

    def dead(self, spark: SparkSession, schema: str) -> DataFrame:
        """Rows that failed as often as they may."""
        return self.outcomes(spark, schema).filter(~F.col("ok") & (F.col("attempts") >= self.attempts)).drop("ok")


def run(stream: DataFrame, box: Outbox, checkpoint: str, flush: bool = True) -> None:
    """Send what has arrived in a stream, and all that is queued if ``flush``."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(box.batch).start()
    q.awaitTermination()
    if flush:
        box.flush(stream.sparkSession)
