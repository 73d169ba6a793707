"""Brands in product names: the first brand of a table that a name holds.

A brand has synonyms (itself one of them). A synonym is found where it stands in the
name in any case: longer ones anywhere, those of one or two characters only as words
of their own. Of the brands that are found the first in the table's order counts.

A table of checked size is sent to the workers, which read each name once through a
multi-pattern automaton, whatever the number of synonyms. A larger one is joined: a
synonym's first three characters are a key, and a name has the keys of its places. A
frequent key is split by the skew join; each pair is verified. Neither way compares
all names with all synonyms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Synonyms and their characters up to which a table is sent to every worker.
MOST_SYNONYMS = 200_000
MOST_CHARS = 4_000_000
#: Synonyms of more characters count within words, too.
WORD_ONLY = 2
_KEY = 3
_WORD = r"[\p{L}\p{N}_]"


def synonyms(brands: DataFrame, brand: str = "brand", listed: str = "synonyms", order: str = "order") -> DataFrame:
    """(synonym, place, brand): each synonym once, trimmed and in lower case, with the first brand in ``order`` that has it. Blank ones go."""
    each = brands.select(F.col(brand).alias("brand"), F.col(order).alias("place"), F.explode(listed).alias("synonym"))
    each = each.withColumn("synonym", F.lower(F.trim("synonym"))).filter("synonym <> ''")
    first = each.groupBy("synonym").agg(F.min(F.struct("place", "brand")).alias("x"))
    return first.select("synonym", "x.place", "x.brand")


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _bounded(name: str, low: int, high: int) -> bool:
    """Whether a word begins or ends on either side of name[low:high]."""
    before = low > 0 and _word(name[low - 1])
    after = high < len(name) and _word(name[high])
    return before != _word(name[low]) and after != _word(name[high - 1])


class Automaton:
    """All synonyms in one pass over a name."""

    _made: dict[int, Automaton] = {}

    def __init__(self, rows: list[tuple[str, int]]):
        self.trie = ahocorasick.Automaton()
        for synonym, rank in rows:
            self.trie.add_word(synonym, (rank, len(synonym)))
        self.trie.make_automaton()
        self.some = bool(rows)

    @classmethod
    def of(cls, number: int, rows: list[tuple[str, int]]) -> Automaton:
        """The automaton of a sent table, built once in a worker."""
        if number not in cls._made:
            cls._made.clear()
            cls._made[number] = cls(rows)
        return cls._made[number]

    def first(self, name: str) -> int | None:
        """The least rank of a synonym that is found."""
        best = None
        if self.some:
            for end, (rank, size) in self.trie.iter(name):
                if (best is None or rank < best) and (size > WORD_ONLY or _bounded(name, end + 1 - size, end + 1)):
                    best = rank
        return best


def _sent(names: DataFrame, name: str, into: str, found: DataFrame) -> DataFrame:
    rows = sorted((r.place, r.brand, r.synonym) for r in found.collect())
    sent = names.sparkSession.sparkContext.broadcast(([(s, i) for i, (_, _, s) in enumerate(rows)], [b for _, b, _ in rows]))
    number = uuid.uuid4().int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, brands = sent.value
        automaton = Automaton.of(number, words)
        for batch in batches:
            ranks = [automaton.first(n) if n else None for n in batch.column("_name").to_pylist()]
            kept = [batch.column(c) for c in batch.schema.names if c != "_name"]
            labels = [c for c in batch.schema.names if c != "_name"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([None if r is None else brands[r] for r in ranks], pa.string())], names=[*labels, into])

    low = names.withColumn("_name", F.lower(F.trim(F.col(name).cast("string"))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema.fields) + f", `{into}` string"
    return low.mapInArrow(run, schema)


def _is_found(name: Column, synonym: Column) -> Column:
    """Whether a synonym of any length is in a name, both in lower case."""
    inside = lambda c: F.when(F.rlike(c, F.lit(_WORD)), F.lit(f"(?<!{_WORD})")).otherwise(F.lit(f"(?<={_WORD})"))
    after = lambda c: F.when(F.rlike(c, F.lit(_WORD)), F.lit(f"(?!{_WORD})")).otherwise(F.lit(f"(?={_WORD})"))
    quoted = F.concat(F.lit(r"\Q"), synonym, F.lit(r"\E"))
    as_word = F.rlike(name, F.concat(inside(F.substring(synonym, 1, 1)), quoted, after(F.substring(synonym, -1, 1))))
    return F.contains(name, synonym) & ((F.length(synonym) > WORD_ONLY) | as_word)


def _joined(names: DataFrame, name: str, into: str, found: DataFrame) -> DataFrame:
    low = F.lower(F.trim(F.col(name).cast("string")))
    keyed = found.withColumn("_key", F.substring("synonym", 1, _KEY))
    texts = names.select(low.alias("_name")).filter("_name <> ''").distinct()  # a name that many rows have is searched once
    places = F.sequence(F.lit(1), F.length("_name"))
    keys = F.flatten(F.transform(places, lambda i: F.array(*[F.substring("_name", i, F.lit(k)) for k in range(1, _KEY + 1)])))
    pairs = texts.select("_name", F.explode(F.array_distinct(keys)).alias("_key")).join(keyed, "_key").filter(_is_found(F.col("_name"), F.col("synonym")))
    best = pairs.groupBy(F.col("_name").alias("_of")).agg(F.min(F.struct("place", "brand", "synonym")).alias("_x"))
    return names.join(best, low == F.col("_of"), "left").select(*names.columns, F.col("_x.brand").alias(into))


def first_brand(names: DataFrame, brands: DataFrame, name: str = "name", into: str = "brand") -> DataFrame:
    """``names`` with the first brand that each name holds, null without one.

    ``brands`` has (brand, synonyms, order). A column that has the new name is
    replaced. Null and empty names have no brand; without brands none has one.
    """
    names, found = names.drop(into) if into != name else names, synonyms(brands)
    size = found.agg(F.count("*"), F.coalesce(F.sum(F.length("synonym")), F.lit(0))).first()
    way = _sent if size[0] <= MOST_SYNONYMS and size[1] <= MOST_CHARS else _joined
    return way(names, name, into, found)
