"""Writers that give back what they wrote, read again from the store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "text")


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share. Where none is set, a temporary one becomes it on a local master; a cluster is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = given.get() if given.isDefined() else None
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="shelfloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/sinks/{label}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, **options) -> DataFrame:
    """``df`` written as ``kind`` and read back with its own schema."""
    if kind not in FORMATS:
        raise ValueError(f"no writer for {kind}")
    writer = df.write.options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(kind).save(path)
    return df.sparkSession.read.schema(df.schema).options(**options).format(kind).load(path)


def append(df: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """``df`` appended to what is under a path; all of it, read back with its schema."""
    df.write.format(kind).mode("append").save(path)
    return df.sparkSession.read.schema(df.schema).format(kind).load(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete what was written under a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def export_csv(df: DataFrame, path: str) -> DataFrame:
    """CSV with a header and doubled quotes, read back as text columns."""
    options = {"header": "true", "quote": '"', "escape": '"'}
    df.write.options(**options).csv(path)
    return df.sparkSession.read.options(**options).csv(path)
