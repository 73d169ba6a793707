"""Arrow batches in Python workers.

Columns that pass through stay Arrow arrays: pandas would turn a nullable bigint
into floats, and an id above 2^53 beside a null into another id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def values(batch: pa.RecordBatch, *names: str) -> list[list]:
    """Columns as lists of Python values, a null as None."""
    return [batch.column(name).to_pylist() for name in names]


def made(columns: dict[str, tuple[Sequence, pa.DataType]]) -> pa.RecordBatch:
    """A batch of new columns: name to (values, type)."""
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def with_columns(batch: pa.RecordBatch, drop: Sequence[str], columns: dict[str, tuple[Sequence, pa.DataType]]) -> pa.RecordBatch:
    """The batch without some columns, and with new ones in the place of their namesakes or at the end."""
    names = [n for n in batch.schema.names if n not in drop]
    new = {n: pa.array(v, type=t) for n, (v, t) in columns.items()}
    arrays = [new[n] if n in new else batch.column(n) for n in names]
    more = [n for n in new if n not in names]
    return pa.RecordBatch.from_arrays(arrays + [new[n] for n in more], names=names + more)


def spare(columns: Sequence[str], name: str) -> str:
    """A name for a helper column that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
