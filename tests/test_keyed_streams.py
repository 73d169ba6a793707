"""Keyed state with timers, and the outbox, over streams of several batches."""

import random

import pytest
from pyspark.sql import functions as F

from shelfloom.operators import stateful
from shelfloom.streaming import jobs, keyed, outbox

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, item bigint"


def events(n, seed=1, users=4, step=600):
    r, at, out = random.Random(seed), 1_700_000_000.0, []
    for i in range(n):
        at += r.random() * step
        out.append((i, at, r.randrange(users), r.choice(["error", "view", "view"]), r.randrange(3)))
    return out


def write(spark, path, rows):
    """One file, whose rows are in no order."""
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "event_id bigint, at double, user_id bigint, event_type string, item bigint")
    df.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint"))).select("event_id", "ts", "user_id", "event_type", "item").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return keyed.with_timers(spark).readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_breakers_of_several_batches_half_open_by_timer(spark, tmp_path):
    path, to, rows = str(tmp_path / "e"), (str(tmp_path / "out"), str(tmp_path / "at")), events(120)
    rows += [(500, rows[-1][1] + 1, 9, "error", 0), (501, rows[-1][1] + 2, 9, "error", 0), (502, rows[-1][1] + 3, 8, "view", 0)]
    last = rows[-1][1] + 50_000
    rows.append((503, last, 7, "view", 0))  # moves the watermark
    for low in range(0, len(rows), 40):
        write(spark, path, rows[low : low + 40])
        run = lambda: jobs.drain(keyed.breakers(stream(spark, path), "user_id", F.col("event_type") != "error", "1 minute", 2, 3000.0), "b", "update", to=to)
        seen = run()
    got = {r.key: (r.state, r.failures) for r in seen.groupBy("key").agg(F.max_by(F.struct("state", "failures"), "at").alias("x")).select("key", "x.*").collect()}
    want = {}
    for _, at, user, kind, _ in sorted(rows, key=lambda x: x[1]):
        want[user] = stateful.breaker_step(want.get(user, ("CLOSED", 0, 0.0)), kind != "error", at, 2, 3000.0)
    want = {u: ("HALF_OPEN" if s == "OPEN" and opened + 3000 <= last - 60 else s, n) for u, (s, n, opened) in want.items()}
    assert got == want and want[9][0] == "HALF_OPEN"
    # a breaker that is closed without a failure has no state
    kept = keyed.with_timers(spark).read.format("statestore").option("path", to[1]).option("stateVarName", "breaker").load()
    assert {r[0] for r in kept.select("key.key").collect()} == {u for u, (s, n) in want.items() if (s, n) != ("CLOSED", 0)}


def test_idle_breakers_are_forgotten(spark, tmp_path):
    path = str(tmp_path / "e")
    at = 1_700_000_000.0
    rows = [(1, at, 1, "error", 0), (2, at + 1, 1, "error", 0), (3, at + 10, 2, "error", 0), (4, at + 9_000, 3, "view", 0)]
    write(spark, path, rows)
    to = (str(tmp_path / "out"), str(tmp_path / "at"))
    seen = jobs.drain(keyed.breakers(stream(spark, path), "user_id", F.col("event_type") != "error", "1 minute", 2, 100.0, idle=5_000.0), "b", "update", to=to)
    got = {}
    for r in seen.orderBy("at").collect():
        got.setdefault(r.key, []).append(r.state)
    assert got == {1: ["OPEN", "CLOSED"], 2: ["CLOSED", "CLOSED"], 3: ["CLOSED"]}
    assert keyed.with_timers(spark).read.format("statestore").option("path", to[1]).option("stateVarName", "breaker").load().count() == 0


def test_blacklists_end_1800_seconds_after_the_last_rejection(spark, tmp_path):
    path, to, rows = str(tmp_path / "e"), (str(tmp_path / "out"), str(tmp_path / "at")), events(150, seed=4)
    at = rows[-1][1] + 10
    rows += [(900, at, 5, "error", 1), (901, at + 1799.5, 5, "view", 1), (902, at + 1800.0, 5, "view", 1), (903, at + 1801, 5, "error", 2), (904, at + 1802, 5, "view", 1), (905, at + 3600, 5, "view", 2)]
    for low in range(0, len(rows), 60):
        write(spark, path, rows[low : low + 60])
        seen = jobs.drain(keyed.blacklist(stream(spark, path), "user_id", F.col("item"), F.col("event_type") == "error", "1 minute"), "l", to=to)
    want, lists = {}, {}
    for i, at, user, kind, item in rows:
        items, until = lists.get(user, (set(), 0.0))
        if at >= until:
            items = set()
        if kind == "error":
            items, until = items | {item}, at + 1800
        lists[user] = (items, until)
        if kind != "error":
            want[i] = item in items
    assert {r.event_id: r.blocked for r in seen.collect()} == want and any(want.values()) and not want[902] and want[901]


def box(path, fails, **more):
    sent = []

    def send(rows):
        got = [(r.id, r.attempts) for r in rows.select("id", "attempts").collect()]
        sent.extend(got)
        assert len(got) <= more.get("most", 100)
        return rows.select("id", (~fails).alias("ok"))

    return outbox.Outbox(str(path), "id", send, **more), sent


def test_outbox_loses_and_doubles_none(spark, tmp_path):
    """Bounded batches, a key that fails twice, one that always fails, a batch that stops after its outcome was written and runs again."""
    b, sent = box(tmp_path / "box", (F.col("id") % 10 == 7) & (F.col("attempts") <= 2) | (F.col("id") == 13), most=8, attempts=3)
    rows = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id bigint, v string")
    b.batch(rows(range(20)), 0)
    assert [i for i, _ in sent] == list(range(8)) and b.queued(spark).count() == 13  # 7 failed and is back
    b.batch(rows(range(20, 24)), 1)
    n = len(sent)
    b.batch(rows(range(20, 24)), 1)  # again, as after a lost driver: the outcome is known
    assert len(sent) == n and b.queued(spark).count() == 11  # all but 0 to 6, 8 to 12 and 14
    rounds = b.flush(spark)
    assert rounds >= 2 and b.queued(spark).count() == 0 and b.flush(spark) == 0
    done = [(r.id, r.v, r.attempts) for r in b.done(spark, "id bigint, v string").collect()]
    assert sorted(done) == [(i, f"v{i}", 3 if i % 10 == 7 else 1) for i in range(24) if i != 13]
    assert [(r.id, r.attempts) for r in b.dead(spark, "id bigint, v string").collect()] == [(13, 3)]
    assert sorted(sent) == sorted([(i, 1) for i in range(24)] + [(i, k) for i in (7, 17, 13) for k in (2, 3)])
    b.batch(rows([30]), 2)  # goes on after a flush
    assert b.queued(spark).count() == 0 and b.done(spark, "id bigint, v string").count() == 24


def test_write_behind_sends_the_newest_write_only(spark, tmp_path):
    b, sent = box(tmp_path / "box", (F.col("id") == 3) & (F.col("attempts") == 1), newest=("cell",), most=2)
    rows = lambda xs: spark.createDataFrame(xs, "id bigint, cell string, v string")
    b.batch(rows([(1, "a", "old"), (2, "a", "new"), (3, "b", "x"), (4, "c", "y")]), 0)
    assert sorted(sent) == [(2, 1), (3, 1)]
    b.batch(rows([(5, "b", "newer")]), 1)  # takes the place of the write that failed
    b.flush(spark)
    assert sorted((r.cell, r.v) for r in b.done(spark, "id bigint, cell string, v string").collect()) == [("a", "new"), ("b", "newer"), ("c", "y")]


def test_outbox_over_a_stream_and_without_rows(spark, tmp_path):
    for low in (0, 10):
        spark.range(low, low + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    rows = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    b, sent = box(tmp_path / "box", F.lit(False), most=6)
    outbox.run(rows, b, str(tmp_path / "at"))
    outbox.run(rows, b, str(tmp_path / "at"))
    assert sorted(sent) == [(i, 1) for i in range(20)]
    none, _ = box(tmp_path / "none", F.lit(False))
    assert none.flush(spark) == 0 and none.queued(spark) is None and none.done(spark, "id bigint").count() == 0


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_outbox_of_odd_rows(spark, tmp_path, rows):
    b, _ = box(tmp_path / "box", F.lit(False))
    b.batch(spark.createDataFrame(rows, "id bigint, v string"), 0)
    assert b.done(spark, "id bigint, v string").count() == 0 == b.dead(spark, "id bigint, v string").count()
