"""Ordered folds by key: health, rates and breakers that a window sum can't express.

Rows are sorted into partitions by key and folded as a stream; a task holds the
state of one key, not its rows. The same transition functions drive the streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

State = Any
_MISSING = object()
_ROWS = 5_000


def fold(df: DataFrame, key: str, order: list[str], start: State, step: Callable[[State, dict], tuple[State, tuple]], columns: list[str], schema: str) -> DataFrame:
    """For each row (key, *columns, what ``step`` returns): ``step`` takes the state and the row, by key and order.

    Rows with a null key are one sequence. Values are those of the table (a null is
    None, an integer beside a null stays one); ``columns`` pass through as they are.
    """
    made = [part.strip().split(" ") for part in schema.split(",")]
    arrow = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = _MISSING, start
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part, outs = batch.slice(low, _ROWS), []
                names = part.schema.names
                for values in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    row = dict(zip(names, values, strict=True))
                    if at is _MISSING or row[key] != at:
                        at, state = row[key], start
                    state, out = step(state, row)
                    outs.append(out)
                arrays = [part.column(c) for c in (key, *columns)] + [pa.array([o[i] for o in outs], type=arrow[kind]) for i, (_, kind) in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, *columns, *[name for name, _ in made]])

    kinds = dict(df.dtypes)
    full = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *columns)) + ", " + schema
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, full)


def health_step(state: float, ok: bool, gain: float = 5.0, loss: float = 20.0) -> float:
    """Health in 0..100 after a success or a failure."""
    return max(0.0, min(100.0, state + gain if ok else state - loss))


def router_step(state: tuple, provider: int, ok: bool) -> tuple:
    """(healths, failures in a row, current): switch when the best is 15 ahead, or the current one is ejected (two failures in a row or health under 30)."""
    health, runs, current = state
    health, runs = dict(health), dict(runs)
    health[provider] = health_step(health.get(provider, 100.0), ok)
    runs[provider] = 0 if ok else runs.get(provider, 0) + 1
    ejected = {p for p in health if runs.get(p, 0) >= 2 or health[p] < 30}
    able = sorted((p for p in health if p not in ejected), key=lambda p: (-health[p], p))
    if able and (current is None or current in ejected or health[able[0]] > health.get(current, 0.0) + 15):
        current = able[0]
    return health, runs, current


def rate_step(rate: float, ok: bool, low: float = 0.5, high: float = 8.0) -> float:
    """Additive increase by a quarter, multiplicative decrease by 0.6."""
    return min(high, rate + 0.25) if ok else max(low, rate * 0.6)


def breaker_step(state: tuple[str, int, float], ok: bool, at: float, threshold: int = 3, cooldown: float = 300.0) -> tuple[str, int, float]:
    """(CLOSED | OPEN | HALF_OPEN, failures, opened at) after an attempt at a time."""
    mode, failures, opened = state
    if mode == "OPEN" and at - opened >= cooldown:
        mode = "HALF_OPEN"
    if mode == "OPEN":
        return state
    if ok:
        return "CLOSED", 0, opened
    failures += 1
    if mode == "HALF_OPEN" or failures >= threshold:
        return "OPEN", failures, at
    return mode, failures, opened
