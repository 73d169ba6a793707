"""Append-only logs as a source of Spark: a folder of text files that grow, read by byte ranges.

``spark.read.format("event_log").load(folder)`` gives the lines that are there,
``spark.readStream`` those that come. Columns: ``file`` (name), ``start`` (byte of the
line's first character), ``line``. A stream's offset is the count of bytes that were
taken of each file, always at the end of a line, so a stream that starts again goes
on there: nothing is lost or read twice, also where a file has grown meanwhile. A
last line without its line feed waits until it has one.

The bytes between two offsets are cut into ranges that executors read in parallel,
however long a file is: a line belongs to the range in which it begins. The driver
lists files and looks for the last line feed of those that grew; it reads no rows.

The folder is in a file system that ``pyarrow.fs`` opens (a mounted folder, HDFS,
an object store), as the workers read it themselves. Files whose names begin with "_"
or "." don't count. A file that is gone leaves the offset; one that has become
shorter than what was read of it is an error, as its bytes are other lines now.
"""

from __future__ import annotations

import fnmatch
import json
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "event_log"
SCHEMA = "file string, start bigint, line string"
_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("line", pa.string())])
_BLOCK = 1 << 20


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [low, high); the file is read up to ``end``."""

    file: str
    low: int
    high: int
    end: int


class _Folder:
    """The files of a log and their lines."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("an event log needs a path")
        # the options' keys come in any case
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.glob = low["path"], low.get("glob", "*")
        self.split = max(1, int(low.get("splitbytes", 32 << 20)))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def sizes(self, known: dict[str, int]) -> dict[str, int]:
        """File to the bytes of its whole lines; ``known`` has sizes found before, at which nothing is looked up again."""
        store, root = self._open()
        found = {}
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            name = os.path.basename(info.path)
            if info.type == fs.FileType.File and name[0] not in "_." and fnmatch.fnmatch(name, self.glob):
                found[name] = info.size if known.get(name) == info.size else self._whole(store, info.path, info.size)
        return found

    def _whole(self, store: fs.FileSystem, path: str, size: int) -> int:
        """Bytes up to the last line feed."""
        with store.open_input_file(path) as f:
            at = size
            while at > 0:
                low = max(0, at - _BLOCK)
                feed = f.read_at(at - low, low).rfind(b"\n")
                if feed >= 0:
                    return low + feed + 1
                at = low
        return 0

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        out = []
        for name, high in sorted(end.items()):
            low = start.get(name, 0)
            if high < low:
                raise ValueError(f"{name} was cut to {high} bytes after {low} had been read")
            out += [Range(name, at, min(at + self.split, high), high) for at in range(low, high, self.split)]
        return out

    def lines(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, root = self._open()
        with store.open_input_file(f"{root.rstrip('/')}/{part.file}") as f:
            # a line that began before goes with the range before
            at, held = part.low, b""
            skip = at > 0 and f.read_at(1, at - 1) != b"\n"
            place = at
            while place < part.high or held:
                block = f.read_at(min(_BLOCK, part.end - at), at)
                at += len(block)
                held += block
                cut = held.rfind(b"\n") + 1
                if not cut and block:
                    continue
                whole, held = held[:cut], held[cut:]
                rows: tuple[list, list] = ([], [])
                for line in whole.split(b"\n")[:-1]:
                    if skip:
                        skip = False
                    elif place < part.high:
                        rows[0].append(place)
                        rows[1].append(line.decode("utf-8", "replace"))
                    place += len(line) + 1
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([part.file] * len(rows[0])), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string())], schema=_ARROW)
                if not block or place >= part.high:
                    break


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Range]:
        return self.folder.ranges({}, self.folder.sizes({})) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, folder: _Folder):
        self.folder, self.known = folder, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.known = self.folder.sizes(self.known)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.folder.ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)


class EventLog(DataSource):
    """``path``, ``glob`` of the file names (all), ``splitBytes`` of a range (32 MB)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Folder(dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(_Folder(dict(self.options)))


def lines(spark: SparkSession, path: str, stream: bool = False, **options: str | int) -> DataFrame:
    """(file, start, line) of the log in a folder."""
    spark.dataSource.register(EventLog)
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(path)


def records(spark: SparkSession, path: str, schema: str, stream: bool = False, **options: str | int) -> DataFrame:
    """The lines of a log as JSON records of a schema; a line that is no object of it has nulls."""
    parsed = F.from_json("line", schema)
    return lines(spark, path, stream, **options).select(parsed.alias("x")).select("x.*")


def append(df: DataFrame, path: str) -> None:
    """Rows of ``df`` appended to a log as JSON lines, in files of their own. Instants go as microseconds."""
    instants = [f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz")]
    whole = df.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in instants}) if instants else df
    whole.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def offsets(text: str) -> dict[str, int]:
    """A stream's offset, as its checkpoint has it."""
    return {k: int(v) for k, v in json.loads(text).items()}

# Spark plans these in Python processes of the driver's that have no files of this package: classes go by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
