"""Streams with state by key and timers on event time: circuit breakers and session blacklists.

A processor has the state of one key at a time. What follows from the passing of
time alone is done by timers when the watermark passes them: a breaker half-opens, a
blacklist ends, an idle key is forgotten, so state is kept for keys in use only. The
times in the state decide for each row, so the result doesn't depend on how late a
timer fires: a stream gives what a fold over the sorted rows gives.

Rows of a key are put in order within a micro-batch; rows behind the watermark are
dropped, as everywhere in Structured Streaming. The state store must be RocksDB
(``with_timers``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfloom.operators import stateful
from shelfloom.operators.stateful import breaker_step

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> SparkSession:
    """A session whose streams can have timers; tables and settings are those of the given one."""
    own = spark.newSession()
    own.conf.set(_STORE, _ROCKS)
    for name in ("spark.checkpoint.dir", "spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        if (value := spark.conf.get(name, None)) != own.conf.get(name, None):
            own.conf.set(name, value)
    return own


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    found = list(rows)
    batch = found[0] if len(found) == 1 else pd.concat(found, ignore_index=True)
    return batch.iloc[np.lexsort([batch[c].to_numpy() for c in reversed(by)])]


def _rewind(handle: StatefulProcessorHandle, at: float | None) -> None:
    """One timer a key: at ``at`` seconds, or none."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if at is not None:
        handle.registerTimer(int(at * 1000))


class Breaker(StatefulProcessor):
    """(state, failures, at) of a key's breaker after a micro-batch, and when a timer changes it.

    ``at`` is the time of the last row or of the timer. An open breaker half-opens
    ``cooldown`` seconds after it has opened. One that is closed without a failure
    has no state; ``idle`` seconds after its last row any other is forgotten, too.
    """

    def __init__(self, threshold: int, cooldown: float, idle: float | None):
        self.threshold, self.cooldown, self.idle = threshold, cooldown, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("breaker", "state string, failures int, opened double, seen double")

    def _keep(self, now: tuple, seen: float) -> None:
        if now[:2] == ("CLOSED", 0):
            self.state.clear()
            _rewind(self.handle, None)
            return
        self.state.update((*now, seen))
        ends = [now[2] + self.cooldown] if now[0] == "OPEN" else []
        ends += [seen + self.idle] if self.idle is not None else []
        _rewind(self.handle, min(ends, default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        kept = self.state.get() if self.state.exists() else None
        now, seen = (tuple(kept[:3]), kept[3]) if kept else (("CLOSED", 0, 0.0), None)
        batch = _in_order(rows, ["at", "event_id"])
        for ok, at in zip(batch["ok"].tolist(), batch["at"].tolist(), strict=True):
            if self.idle is not None and seen is not None and at - seen >= self.idle:
                now = ("CLOSED", 0, 0.0)
            now, seen = breaker_step(now, ok, at, self.threshold, self.cooldown), at
        self._keep(now, seen)
        yield pd.DataFrame({"key": [key[0]], "state": [now[0]], "failures": [now[1]], "at": [seen]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if not self.state.exists():
            return
        mode, failures, opened, seen = self.state.get()
        at, now = expiredTimerInfo.getExpiryTimeInMs() / 1000, timerValues.getCurrentWatermarkInMs() / 1000
        if self.idle is not None and now + 0.001 >= seen + self.idle:  # the watermark may have passed both times at once
            mode, failures, at = "CLOSED", 0, seen + self.idle
        elif mode == "OPEN" and at + 0.001 >= opened + self.cooldown:
            mode = "HALF_OPEN"
        self._keep((mode, failures, opened), seen)
        yield pd.DataFrame({"key": [key[0]], "state": [mode], "failures": [failures], "at": [at]})

    def close(self) -> None:
        pass


class Blacklist(StatefulProcessor):
    """For each row that is no rejection: whether its item has been rejected in its session.

    A rejection adds its item and makes the whole list last for ``ttl`` seconds from
    then. The list is a map state; in a micro-batch an item is looked up once and
    written once, however many rows name it. An ended list is cleared by its timer, or
    by the first row that comes later.
    """

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items, self.until = handle.getMapState("items", "item bigint", "at double"), handle.getValueState("until", "until double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        until, batch = (self.until.get()[0] if self.until.exists() else None), _in_order(rows, ["at", "event_id"])
        found, moved, ended, known, added = [], False, False, {}, {}
        for reject, item, at in zip(batch["rejects"].tolist(), batch["item"].tolist(), batch["at"].tolist(), strict=True):
            if until is not None and at >= until:
                until, moved, ended, known, added = None, True, True, {}, {}
            if reject:
                known[item], added[item] = True, at
                until, moved = at + self.ttl, True
            if until is not None and item not in known:
                known[item] = not ended and self.items.containsKey((item,))
            found.append(until is not None and known[item])
        if ended:
            self.items.clear()
        for item, at in added.items():
            self.items.updateValue((item,), (at,))
        if moved:
            if until is None:
                self.until.clear()
            else:
                self.until.update((until,))
            _rewind(self.handle, until)
        shown = batch[~batch["rejects"]]
        yield pd.DataFrame({"key": [key[0]] * len(shown), "event_id": shown["event_id"], "item": shown["item"], "blocked": pd.Series(found, index=batch.index, dtype=bool)[~batch["rejects"].to_numpy()]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.items.clear()
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def breakers(events: DataFrame, key: str, ok, late: str, threshold: int = 3, cooldown: float = 300.0, idle: float | None = None) -> DataFrame:
    """(key, state, failures, at) of ``Breaker`` over a stream with event_id and ts; ``ok`` is the condition of a success."""
    rows = events.withWatermark("ts", late).select(F.col(key).alias("key"), "event_id", "ts", ok.alias("ok"), (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(Breaker(threshold, cooldown, idle), "key bigint, state string, failures int, at double", "Update", "EventTime")


def blacklist(events: DataFrame, session: str, item, rejects, late: str, ttl: float = 1800.0) -> DataFrame:
    """(key, event_id, item, blocked) of ``Blacklist`` over a stream with event_id and ts; ``rejects`` is the condition of a rejection."""
    rows = events.withWatermark("ts", late).select(F.col(session).alias("key"), "event_id", "ts", item.cast("bigint").alias("item"), rejects.alias("rejects"), (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(Blacklist(ttl), "key bigint, event_id bigint, item bigint, blocked boolean", "Append", "EventTime")

# Spark plans these in Python processes of the driver's that have no files of this package: classes go by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(stateful)
