"""Removal of repeated passages by hashes of lines, paragraphs or sentences.

A text is cut into units, a unit is hashed in its normal form (lower case, runs of
blanks as one), and digests are grouped over all documents; of each, the occurrence
in the document with the least rank stays, at its first place, and the rest is
removed. What stays keeps its offsets in the original text. Units that repeat one
after another make a passage; ``passages`` says for each kind of unit how many words
one must have to go. By default these are lines, and every repeated one goes.

Passages that were pasted into the middle of a line are no lines. Sentences, a
further kind of unit, find those: one of fewer than ``UNIT_WORDS`` words repeats by
chance and makes one unit with the next, and after any longer one, two texts are in
step again. A sentence is compared without its end mark; what is left at the end of
a line isn't hashed, and goes with a passage that it is inside of.

Only digests, ranks and numbers of units are grouped, with a minimum and a count
taken before the shuffle; a unit on a third of all documents is joined back with
its skewed partition split. A text moves once, to meet the numbers of its units.
Equality of units is that of 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import arrow, scratch

#: Blocks in which units are joined, the pieces of a block without and with an end mark, and the least words of a unit.
UNITS = {"line": (r"[^\n]+", r"(.+)", 1), "paragraph": (r"(?:[^\n]|\n(?!\s*\n))+", r"(?s)(.+)", 1), "sentence": (r"[^\n]+", r"([^.!?]+)[.!?]*", 4)}
_COMPILED = {name: (re.compile(block), re.compile(piece), least) for name, (block, piece, least) in UNITS.items()}
#: Every repeated line.
PASSAGES = {"line": 1}
#: Two rows of one rank are told apart by their texts, by a hash of so many bits.
_ROW_BITS = 30

_SPANS = "array<struct<`start`:int,`end`:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def units(text: str, unit: str = "line") -> Iterator[tuple[int, int, int, int]]:
    """(start, end, words, hash) of the units that count, by place."""
    blocks, pieces, least = _COMPILED[unit]
    seed = list(UNITS).index(unit)
    for block in blocks.finditer(text):
        start, words = -1, []
        for m in pieces.finditer(text, block.start(), block.end()):
            start = m.start() if start < 0 else start
            words += m[1].lower().split()
            if len(words) >= least:
                yield start, m.end(), len(words), xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), seed=seed) - (1 << 63)
                start, words = -1, []


def passages(found: list[tuple[int, int, int, int]], repeated: list[int], min_words: int) -> list[tuple[int, int]]:
    """Spans of runs of repeated units, by their numbers, that have enough words."""
    spans, run = [], []
    for i in [*sorted(repeated), -1]:
        if run and i != run[-1] + 1:
            if sum(found[j][2] for j in run) >= min_words:
                spans.append((found[run[0]][0], found[run[-1]][1]))
            run = []
        run.append(i)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, by place."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def kept_spans(n: int, removed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    at, kept = 0, []
    for start, end in [*removed, (n, n)]:
        if start > at:
            kept.append((at, start))
        at = end
    return kept


def _units(kinds: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow.parts(batches, 300):
            row, number, again, digest = [], [], [], []
            for at, text in enumerate(part.column("text").to_pylist()):
                seen = set()
                for kind, name in enumerate(kinds):
                    for i, (_, _, _, h) in enumerate(units(text, name)):
                        row.append(at)
                        number.append(i * len(kinds) + kind)
                        again.append(h in seen)
                        digest.append(h)
                        seen.add(h)
            taken = part.select(["rank", "row_key"]).take(pa.array(row, pa.int32()))
            yield arrow.with_columns(taken, [], {"number": (number, pa.int32()), "again": (again, pa.bool_()), "hash": (digest, pa.int64())})

    return run


def _cut(column: str, numbers: str, least: dict[str, int]):
    def spans_of(text: str | None, repeated: list[int] | None) -> list[tuple[int, int]]:
        found: list[tuple[int, int]] = []
        for kind, (name, min_words) in enumerate(least.items()):
            own = [i // len(least) for i in repeated or () if i % len(least) == kind]
            if own:
                found += passages(list(units(text, name)), own, min_words)
        return merged(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow.parts(batches, 300):
            texts, gone, stay = [], [], []
            for text, repeated in zip(*arrow.values(part, column, numbers), strict=True):
                spans = spans_of(text, repeated)
                kept = kept_spans(len(text or ""), spans)
                texts.append("".join([text[a:b] for a, b in kept]) if spans else text)
                gone.append([{"start": a, "end": b} for a, b in spans])
                stay.append([{"start": a, "end": b} for a, b in kept])
            yield arrow.with_columns(part, [numbers], {column: (texts, pa.string()), "removed": (gone, _SPANS_ARROW), "kept": (stay, _SPANS_ARROW)})

    return run


def drop_repeats(docs: DataFrame, rank: str = "doc_id", text: str = "text", least: Mapping[str, int] = PASSAGES) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and removed, kept: spans in the original text.

    ``least``: kinds of units, and the words from which a run of repeated ones of
    the kind goes. One row for each row. Null or empty text, and rows without a
    rank, stay as they are. Of rows of one rank with different texts, the one with
    the least hash of its text comes first; rows that agree in both are one document
    said twice, and get the same result. An empty table gives no rows. Other columns
    are kept; ones that are named removed or kept are replaced.
    """
    docs = docs.drop("removed", "kept")
    own_key = F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(1 << _ROW_BITS)).cast("int")
    rows = docs.select(F.col(rank).cast("bigint").alias("rank"), own_key.alias("row_key"), F.col(text).cast("string").alias("text")).filter("text is not null and rank is not null")
    found = scratch.table(rows.mapInArrow(_units(list(least)), "rank bigint, row_key int, number int, again boolean, hash bigint"), "units")
    place = F.col("rank").cast("decimal(19,0)") * F.lit(1 << _ROW_BITS).cast("decimal(10,0)") + F.col("row_key").cast("decimal(10,0)")
    # a table of its own, so that the join shuffles both sides alone and can split a hot unit
    first = scratch.table(found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "first")
    r, k, numbers = (arrow.spare(docs.columns, "__" + name) for name in ("rank", "row_key", "numbers"))
    gone = found.join(first, "hash").filter(F.col("again") | (place != F.col("first"))).groupBy(F.col("rank").alias(r), F.col("row_key").alias(k)).agg(F.collect_set("number").alias(numbers))
    both = docs.join(gone, (F.col(rank).cast("bigint") == F.col(r)) & (own_key == F.col(k)), "left").select(*docs.columns, numbers)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return both.mapInArrow(_cut(text, numbers, dict(least)), f"{schema}, removed {_SPANS}, kept {_SPANS}")
