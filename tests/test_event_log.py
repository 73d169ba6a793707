"""Logs as a source, and streams over tables of several parts."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfloom.plans import registry
from shelfloom.sources import event_log
from shelfloom.streaming import jobs

D = "/root/testdata/sf0.001"
SCHEMA = "event_id bigint, ts bigint, text string"


def put(path, name, rows, mode="a", end="\n"):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", mode, encoding="utf-8", newline="") as f:
        f.write("".join(json.dumps(r, ensure_ascii=False) + end for r in rows))


def rows(ids):
    return [{"event_id": i, "ts": i * 1_000_000, "text": f"é{'x' * (i % 50)}  {i}"} for i in ids]


@pytest.mark.parametrize("split", [1, 7, 100, 1 << 20])
def test_ranges_of_any_size_give_each_line_once(spark, tmp_path, split):
    path = str(tmp_path / "log")
    put(path, "a.log", rows(range(40)))
    put(path, "b.log", [])
    put(path, "_SUCCESS", rows([99]))
    with open(f"{path}/c.log", "w", newline="") as f:
        f.write("\n\nnot json\n" + "long" * 10_000 + "\n" + json.dumps({"event_id": 500}) + "\ncut off")
    got = event_log.lines(spark, path, splitBytes=split if split > 1 else 13).collect()
    for r in got:  # the place of a line is where it is
        with open(f"{path}/{r.file}", "rb") as f:
            f.seek(r.start)
            assert f.readline() == r.line.encode() + b"\n"
    assert sorted((r.file, r.line) for r in got) == sorted([("a.log", json.dumps(x, ensure_ascii=False)) for x in rows(range(40))] + [("c.log", x) for x in ("", "", "not json", "long" * 10_000, json.dumps({"event_id": 500}))])
    read = event_log.records(spark, path, SCHEMA)
    assert sorted(r.event_id for r in read.filter("event_id is not null").collect()) == [*range(40), 500]


def test_empty_and_missing_folders(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    for path in (str(tmp_path / "none"), str(tmp_path / "missing")):
        assert event_log.lines(spark, path).count() == 0
        assert jobs.drain(event_log.lines(spark, path, stream=True), "empty").count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format(event_log.FORMAT).load().count()


def test_stream_goes_on_after_a_stop_in_the_middle(spark, tmp_path):
    """A line that is half written, a batch that fails after it has been written, files that grow and files that are new."""
    path, to = str(tmp_path / "log"), (str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    stream = lambda: jobs.log_stream(spark, path, SCHEMA, splitBytes=64)
    ids = lambda df: sorted(r.event_id for r in df.collect())
    put(path, "part-0.log", rows(range(10)))
    put(path, "part-0.log", rows([10]), end="")
    assert ids(jobs.drain(stream(), "log", to=to)) == list(range(10))

    def stops(batch, number):
        batch.write.mode("overwrite").parquet(f"{to[0]}/{number}")
        raise RuntimeError("lost")

    with open(f"{path}/part-0.log", "a") as f:
        f.write("\n")
    put(path, "part-0.log", rows([11]))
    with pytest.raises(Exception, match="lost"):
        jobs.drain(stream(), "log", batch=stops, to=to)
    put(path, "part-1.log", rows(range(12, 40)))
    put(path, "part-0.log", rows([40]))
    jobs.drain(stream(), "log", to=to)
    assert ids(jobs.drain(stream(), "log", to=to)) == list(range(41))
    last = max(glob.glob(f"{to[1]}/offsets/*"), key=lambda p: int(os.path.basename(p)))
    with open(last) as f:
        assert event_log.offsets(f.read().splitlines()[-1]) == {n: os.path.getsize(f"{path}/{n}") for n in ("part-0.log", "part-1.log")}
    put(path, "part-1.log", rows([7]), mode="w")
    with pytest.raises(Exception, match="was cut"):
        jobs.drain(stream(), "log", to=to)


STREAMS = ["tumbling_stream", "delta_sync_stream", "breaker_stream", "telemetry_fan_out", "task_routing", "queue_scan", "replay_then_tail"]


@pytest.mark.parametrize("name", STREAMS)
def test_table_of_three_parts(spark, tmp_path, name):
    """A table that is a folder gives what a file gives."""
    spark.read.parquet(f"{D}/events.parquet").repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "events.parquet"))
    assert len(glob.glob(f"{tmp_path}/events.parquet/part-*")) == 3
    got = registry.queries()[name](spark, str(tmp_path)).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        want = registry.queries()[name](spark, D).toPandas()
        got, want = (x.groupby("user_id").size() for x in (got, want))
        assert set(got.index) == set(want.index)
        return
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{D}/events.parquet'")
    want = c.execute(sql).df()
    columns = sorted(want.columns)
    if name == "delta_sync_stream":  # a version for each batch that changed a key; the last one is the state
        got = got.sort_values("event_id").groupby("user_id").tail(1)
    plain = lambda df: sorted(map(tuple, df[columns].round(6).astype(str).values.tolist()))
    assert plain(got) == plain(want)


def test_complete_mode_over_batches_has_the_last_result(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).select(F.col("id").alias("event_id"), F.lit(1).alias("k")).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("event_id bigint, k int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got = jobs.drain(stream.groupBy("k").agg(F.count("*").alias("n")), "complete", "complete").collect()
    assert [tuple(r) for r in got] == [(1, 30)]
    empty = spark.readStream.schema("event_id bigint, k int").parquet(str(tmp_path / "t")).filter("false")
    assert jobs.drain(empty, "none").count() == 0


def test_delta_sync_keeps_the_newer_event(spark, tmp_path):
    """An event that comes in a later batch with a lower id changes nothing, then or for what follows."""
    make = lambda rows: spark.createDataFrame(rows, "user_id bigint, event_id bigint, event_type string, value double")
    run = jobs.delta_sync(str(tmp_path))
    run(make([(1, 10, "new", 1.0), (2, 5, "a", 1.0), (1, 9, "x", 1.0)]), 0)
    run(make([(1, 4, "old", 1.0), (2, 6, "a", 1.0), (3, 1, "c", None)]), 1)
    run(make([(1, 11, "old", 1.0), (2, 5, "b", 1.0)]), 2)
    wrote = lambda n: sorted((r.user_id, r.event_id) for r in spark.read.parquet(f"{tmp_path}/rows/{n}").collect())
    assert [wrote(n) for n in range(3)] == [[(1, 10), (2, 5)], [(3, 1)], [(1, 11)]]
    assert sorted((r.user_id, r.event_id) for r in spark.read.parquet(f"{tmp_path}/known/2").collect()) == [(1, 11), (2, 6), (3, 1)]


def test_classes_load_without_the_package(tmp_path):
    """Spark plans sources, processors and table functions in processes that have none of this package's files."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from shelfloom.functions import table_functions
    from shelfloom.streaming import keyed

    made = [event_log.EventLog, keyed.Breaker(2, 1.0, None), keyed.Blacklist(1.0), table_functions.Sessionize]
    (tmp_path / "p").write_bytes(cloudpickle.dumps(made))
    code = "import pickle, sys; assert len(pickle.load(open('p', 'rb'))) == 4; assert not any(m.startswith('shelfloom') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
