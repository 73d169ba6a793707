"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage, so an executor that is lost later costs a reread
and not a recomputation. The folder is the session's ``spark.checkpoint.dir``, or
the one given to ``setCheckpointDir``. Where neither is set, a temporary folder is
made on a local master (tests, a laptop), and a cluster is an error: its executors
would each write to a disk of their own.

A table belongs to the scope in which it is written, and what is deleted is deleted
by scope: each call that gives its tables up opens one (``scope``), and threads have
scopes of their own, so queries that run at once never delete each other's tables.
Tables that a returned DataFrame reads stay until ``clear``; those that only led to
another table go as soon as that one is written (``only``).
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


class Scope(list):
    """Paths of the tables that were written while it was the innermost one, in order, in a folder of their own."""

    def __init__(self) -> None:
        super().__init__()
        self.name = uuid.uuid4().hex
        with _lock:
            _scopes.append(self)


_lock = threading.Lock()
_scopes: list[Scope] = []
_current: ContextVar[Scope | None] = ContextVar("scope", default=None)


def _here() -> Scope:
    found = _current.get()
    if found is None:
        found = Scope()
        _current.set(found)
    return found


@contextmanager
def scope() -> Iterator[Scope]:
    """Tables written inside are those of the new scope; they stay when it closes, until it is dropped."""
    _here()
    new = Scope()
    token = _current.set(new)
    try:
        yield new
    finally:
        _current.reset(token)


def keep(inner: Scope) -> None:
    """The tables of a closed scope become the current one's."""
    _here().extend(inner)
    inner.clear()
    _forget(inner)


def _forget(gone: Scope) -> None:
    with _lock:
        _scopes[:] = [s for s in _scopes if s is not gone]


def root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shelfloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read again."""
    spark, own = df.sparkSession, _here()
    path = f"{root(spark)}/tables/{own.name}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def only(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, as a table; the tables that it has written on the way are deleted."""
    with scope() as own:
        made = make()
    out = table(made, label)
    drop(spark, own)
    return out


def written() -> list[str]:
    """The tables of the current scope, in the order in which they were written."""
    return list(_here())


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of which nothing is read any more: a scope, or some of the current one's."""
    for path in list(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        for own in (paths, _here()):
            if path in own:
                own.remove(path)
    if isinstance(paths, Scope) and paths is not _current.get():
        _forget(paths)


def clear(spark: SparkSession) -> None:
    """Delete the tables of all scopes: call it when no result that reads one is needed any more."""
    with _lock:
        found = list(_scopes)
    for own in found:
        drop(spark, own)
