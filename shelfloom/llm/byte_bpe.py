"""Byte-level BPE with the tiktoken library and a local rank file.

A text is encoded whole, as the library would. A long text is cut first where no
match of the pattern can cross: between a character that isn't white space and one
that is (white space starts a match or is the whole of it, and nothing looks
behind). A long run of white space is one match of its own up to its last
character, and goes to the merges directly: the library's pattern engine would
run out of stack on it. Decoding joins the bytes of the ids; it need not be UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import arrow

#: Characters of a text, or of a run of white space, from which it is cut.
LONG = 50_000
LONG_RUN = 2_000

# what the pattern's \s matches
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")
_EDGE = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")


class Codec:
    """Encodes and decodes by the ranks in ``path``; built once in each worker."""

    _built: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.digits = [str(i) for i in range(len(self.bytes_of))]

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._built:
            cls._built[path, pattern] = cls(path, pattern)
        return cls._built[path, pattern]

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_RUN:
            return self.encoding.encode_ordinary(text)
        ids, at = [], 0
        for run in _LONG_RUN.finditer(text):
            last = run.end() - (run.end() < len(text))  # the last one goes with what follows
            ids += self._between(text[at : run.start()])
            ids += self.encoding._encode_single_piece(run[0][: last - run.start()])
            at = last
        return ids + self._between(text[at:])

    def _between(self, text: str) -> list[int]:
        ids, at = [], 0
        while len(text) - at > LONG:
            edge = _EDGE.search(text, at + LONG - 1)
            if edge is None:
                break
            ids += self.encoding.encode_ordinary(text[at : edge.end()])
            at = edge.end()
        return ids + self.encoding.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


_IDS = pa.list_(pa.int32())


def _encode(path: str, pattern: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for part in arrow.parts(batches, 200):
            yield arrow.with_columns(part, [column], {"ids": ([codec.encode(t) for t in part.column(column).to_pylist()], _IDS)})

    return run


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``docs`` to (*keep, ids array<int>): the ids of each whole text, one row for each row.

    Null text is encoded as empty: no ids. Columns not in ``keep`` are left out,
    so a column named ids can't clash. An empty table gives no rows.
    """
    column = arrow.spare(keep, "text")
    rows = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(column))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column)
    return rows.mapInArrow(_encode(path, pattern, column), f"{schema}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, ids) to (*keep, ids, decoded binary): the bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for part in arrow.parts(batches, 200):
            yield arrow.with_columns(part, [], {"decoded": ([codec.decode(i) for i in part.column("ids").to_pylist()], pa.binary())})

    rows = encoded.select(*keep, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text and decodes the ids, without moving them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for part in arrow.parts(batches, 1_000):
            n, ids_sha, decoded_sha = [], [], []
            for text in part.column("text").to_pylist():
                ids = codec.encode(text)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([codec.digits[i] for i in ids]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield arrow.with_columns(part, ["text"], {"n_tokens": (n, pa.int64()), "ids_sha256": (ids_sha, pa.string()), "decoded_sha256": (decoded_sha, pa.string())})

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
