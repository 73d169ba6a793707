"""Structured Streaming jobs on an event stream, each with a batch twin.

A job takes a streaming or batch DataFrame and gives one: the plan is the same,
so a batch run checks the stream. ``drain`` runs a stream over what has arrived,
with its checkpoint and its result in the folder that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfloom.sources import event_log, sinks, tables

LATE = "1 hour"


def event_stream(spark: SparkSession, directory: str, files: int = 1) -> DataFrame:
    """The events of a directory as a stream, with ``ts`` as an instant. The table is a file or a folder of parts."""
    path = f"{directory}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    # a stream reads a folder: the table's own, or its parent with all else filtered out
    found = reader.parquet(path) if tables.is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(directory)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def log_stream(spark: SparkSession, path: str, schema: str, **options: str | int) -> DataFrame:
    """The records of an append-only log as a stream, with ``ts`` (microseconds) as an instant."""
    return event_log.records(spark, path, schema, stream=True, **options).withColumn("ts", F.timestamp_micros("ts"))


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; late rows are dropped behind the watermark."""
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", LATE).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    w = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n")


def replay_then_tail(history: DataFrame, tail: DataFrame | None, last_id: int) -> DataFrame:
    """History after ``last_id`` and the tail, each event once. A log that is followed has both in one stream: no ``tail`` then."""
    kept = history.filter(F.col("event_id") > last_id)
    both = kept if tail is None else kept.unionByName(tail)
    return both.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"]) if both.isStreaming else both.dropDuplicates(["event_id"])


def delta_sync(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the last state of each key of a batch is written if its hash is new, rows before hashes.

    ``path/rows/<batch>`` has what a batch changed, ``path/known/<batch>`` the latest
    id and hash of every key after it: a batch reads the one before and no other, and
    the one before that goes. An event that comes late, with a lower id than what is
    known of its key, changes nothing. Folders are named by the batch and overwritten
    on a retry, so a batch that ran twice is there once.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("x"))
        hashed = last.select("user_id", "x.*").withColumn("hash", F.sha2(F.concat_ws("|", "event_type", F.col("value").cast("string")), 256))
        if number == 0:
            known = spark.createDataFrame([], "user_id bigint, old_id bigint, old string")
        else:
            known = spark.read.parquet(f"{path}/known/{number - 1}").select("user_id", F.col("event_id").alias("old_id"), F.col("hash").alias("old"))
        both = known.join(hashed, "user_id", "full_outer")
        newer = F.coalesce(F.col("event_id") >= F.coalesce("old_id", "event_id"), F.lit(False))
        changed = both.filter(newer & ~F.col("hash").eqNullSafe(F.col("old")))
        changed.select("user_id", "event_id", "event_type", "value", "hash").write.mode("overwrite").parquet(f"{path}/rows/{number}")
        now = both.select("user_id", F.when(newer, F.col("event_id")).otherwise(F.col("old_id")).alias("event_id"), F.when(newer, F.col("hash")).otherwise(F.col("old")).alias("hash"))
        now.write.mode("overwrite").parquet(f"{path}/known/{number}")
        if number > 1:
            sinks.delete(spark, f"{path}/known/{number - 2}")

    return run


def fan_out(sinks_by_name: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch is read once and goes to every sink, each with the number by which it knows a retry."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for write in sinks_by_name.values():
                write(batch, number)
        finally:
            batch.unpersist()

    return run


def numbered_folder(path: str, of: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A sink that writes what ``of`` makes of a batch under its number: a retried batch replaces itself, so at least once becomes once."""
    return lambda batch, number: of(batch).write.mode("overwrite").parquet(f"{path}/{number}")


def route(column: str, queues: dict[str, list[str]], default: str) -> Callable[[DataFrame], DataFrame]:
    """A batch with the queue of each row, by the values that a queue takes; all others go to ``default``."""

    def run(batch: DataFrame) -> DataFrame:
        queue = F.lit(None).cast("string")
        for name, values in queues.items():
            queue = F.coalesce(queue, F.when(F.col(column).isin(*values), F.lit(name)))
        return batch.withColumn("queue", F.coalesce(queue, F.lit(default)))

    return run


def drain(stream: DataFrame, label: str, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None, to: tuple[str, str] | None = None) -> DataFrame:
    """Run a stream over what has arrived and read back what it wrote: in update mode every version of a row, in complete mode the last result.

    ``to`` is (folder, checkpoint) of a run before, after which this one goes on. A
    stream in which nothing came gives no rows, with its schema.
    """
    spark = stream.sparkSession
    path, at = to or (sinks.folder(spark, label), sinks.folder(spark, label + "-checkpoint"))

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{n}")
        if mode == "complete" and n > 0:
            sinks.delete(spark, f"{path}/{n - 1}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(batch or write).start()
    q.awaitTermination()
    if not tables.is_folder(spark, path):
        spark.createDataFrame([], stream.schema).write.parquet(f"{path}/none")
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)
