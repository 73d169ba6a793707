"""Benchmark items inside documents, by size-partitioned MinHash containment search.

A short item inside a document of thousands of words has a Jaccard similarity near
zero, so bands of a document's MinHash would need thousands of rows to find it.
The sketch is therefore of the item, by the containment that is asked for: items
are partitioned by the size of their shingle set, and each partition keeps the
bottom-k MinHash with k = u - ceil(c * u) + 1, u the largest size in it. An item
of which at least c is in a document can't have k of its shingles missing, so one
value of its sketch is among the document's shingles: nothing is missed. The
documents' shingles are looked up in the sketch index, and a candidate is verified
by exact containment of shingles, word by word.

There are two ways, with the same results. A benchmark whose size has been checked
(``MOST_ITEMS``, ``MOST_CHARS``) is sent to the workers, and a document is judged
where it is. A larger one never goes through the driver or to every worker: its
sketches and the documents' shingle hashes are joined, a shuffle of both, and the
candidates meet their two texts by further joins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import arrow, scratch
from shelfloom.llm.words import WordHashes, mix, plain_words, shingle_hashes

SIZE, PERCENT = 5, 80
#: Items, and characters of all items together, up to which a benchmark is sent to the workers.
MOST_ITEMS, MOST_CHARS = 20_000, 4_000_000


def sketch(words: list[str], size: int, percent: int, hashes: WordHashes) -> tuple[int, list[tuple], np.ndarray, np.ndarray]:
    """(shingle length, distinct shingles, their hashes, bottom-k MinHash) of an item that has words."""
    length = min(size, len(words))
    shingles = dict.fromkeys(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
    values = shingle_hashes(hashes.of([w for s in shingles for w in s]), length)[::length]
    u = 1 << (len(shingles) - 1).bit_length()  # sizes of a partition: up to a power of two
    return length, list(shingles), values, values[np.argsort(mix(values))[: u - -(-percent * u // 100) + 1]]


def shared_shingles(words: list[str], hashes: np.ndarray, order: np.ndarray, shingles: list[tuple], values: np.ndarray) -> int:
    """How many of an item's shingles are in the words; ``hashes`` are those of the words' shingles by ``order``."""
    length = len(shingles[0])
    lo, hi = np.searchsorted(hashes, values, "left"), np.searchsorted(hashes, values, "right")
    return sum(any(tuple(words[p : p + length]) == s for p in order[a:b]) for s, a, b in zip(shingles, lo, hi, strict=True))


class Items:
    """Items of a benchmark of checked size, with the sketch index of each shingle length (shorter for items of fewer words)."""

    def __init__(self, rows: list[tuple[int | None, str | None]], size: int = SIZE, percent: int = PERCENT):
        hashes = WordHashes()
        self.percent, self.items = percent, []
        index: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            words = plain_words(text)
            if not words:
                continue
            length, shingles, values, least = sketch(words, size, percent, hashes)
            for value in least:
                index[length][int(value)].append(len(self.items))
            self.items.append((item_id, shingles, values))
        self.index = {length: (np.array(sorted(found), dtype=np.uint64), dict(found)) for length, found in index.items()}

    def found(self, words: list[str], hashes: np.ndarray) -> Iterator[tuple[int | None, int, int]]:
        """(item_id, shingles of the item, how many of them are in the words) of items contained."""
        for length, (values, postings) in self.index.items():
            if len(words) < length:
                continue
            own = shingle_hashes(hashes, length)
            at = np.searchsorted(values, own)
            at[at == len(values)] = 0
            hit = np.unique(own[values[at] == own])
            if not len(hit):
                continue
            order = np.argsort(own, kind="stable")
            own = own[order]
            for i in sorted({i for value in hit for i in postings[int(value)]}):
                item_id, shingles, wanted = self.items[i]
                shared = shared_shingles(words, own, order, shingles, wanted)
                if 100 * shared >= self.percent * len(shingles):
                    yield item_id, len(shingles), shared


def _texts(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("item")).filter("item is not null")


def _sent(items: DataFrame, size: int, percent: int, most_items: int, most_chars: int):
    """The items as a broadcast variable, or None if they are too many or too long for one."""
    own = _texts(items)
    n, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.length("item").cast("bigint")), F.lit(0))).first()
    if n > most_items or chars > most_chars:
        return None
    return items.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in own.collect()], size, percent))


def _item_sketches(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in arrow.parts(batches, 500):
            keys, lengths, values = [], [], []
            for key, text in zip(*arrow.values(part, "item_key", "item"), strict=True):
                if words := plain_words(text):
                    length, _, _, least = sketch(words, size, percent, hashes)
                    keys += [key] * len(least)
                    lengths += [length] * len(least)
                    values.append(least.view(np.int64))
            yield arrow.made({"item_key": (keys, pa.string()), "length": (lengths, pa.int32()), "value": (np.concatenate(values) if values else [], pa.int64())})

    return run


def _shingles(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in arrow.parts(batches, 100):
            for at in range(part.num_rows):
                row = part.slice(at, 1)
                words = plain_words(row.column("text")[0].as_py())
                own = hashes.of(words)
                for length in lengths:
                    if len(words) >= length:
                        values = np.unique(shingle_hashes(own, length))
                        key = row.column("key").take(pa.array(np.zeros(len(values), np.int64)))
                        yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(values), length), pa.int32()), pa.array(values.view(np.int64))], names=["key", "length", "value"])

    return run


def _verified(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in arrow.parts(batches, 200):
            wanted, n, n_shared, last, words = [], [], [], None, []
            for text, item in zip(*arrow.values(part, "text", "item"), strict=True):
                if text != last:
                    last, words = text, plain_words(text)
                length, shingles, values, _ = sketch(plain_words(item), size, percent, hashes)
                own = shingle_hashes(hashes.of(words), length)
                order = np.argsort(own, kind="stable")
                shared = shared_shingles(words, own[order], order, shingles, values)
                wanted.append(100 * shared >= percent * len(shingles))
                n.append(len(shingles))
                n_shared.append(shared)
            yield arrow.with_columns(part, ["text", "item"], {"n_shingles": (n, pa.int64()), "n_shared": (n_shared, pa.int64())}).filter(pa.array(wanted))

    return run


def _joined(texts: DataFrame, items: DataFrame, size: int, percent: int) -> DataFrame:
    """``texts`` (key, text) and items to (key, item_key, n_shingles, n_shared), whatever the size of the benchmark; rows may be repeated."""
    named = _texts(items).select(F.sha2("item", 256).alias("item_key"), "item").dropDuplicates(["item_key"])
    sketches = scratch.table(named.mapInArrow(_item_sketches(size, percent), "item_key string, length int, value bigint"), "sketches")
    lengths = sorted(r[0] for r in sketches.select("length").distinct().collect())  # at most ``size`` of them
    key = f"key {texts.schema['key'].dataType.simpleString()}"
    hashes = texts.mapInArrow(_shingles(lengths), f"{key}, length int, value bigint")
    candidates = scratch.table(hashes.join(sketches.hint("merge"), ["length", "value"]).select("key", "item_key").distinct(), "candidates")
    both = candidates.join(texts.hint("merge"), "key").join(named.hint("merge"), "item_key").select("key", "item_key", "text", "item")
    return both.mapInArrow(_verified(size, percent), f"{key}, item_key string, n_shingles bigint, n_shared bigint")


def contained_items(docs: DataFrame, items: DataFrame, size: int = SIZE, percent: int = PERCENT, most_items: int = MOST_ITEMS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): items of which at least ``percent`` of the shingles are in a document.

    An item of fewer than ``size`` words is one shingle of all its words; items and
    documents without words match nothing, as do null texts. Repeated rows of
    documents or items give a pair once; an item without an id gives one with a
    null. Rows without a doc_id are left out. No documents or no items: no rows.
    Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    sent = _sent(items, size, percent, most_items, most_chars)
    if sent is None:
        texts = rows.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
        ids = _texts(items).select(F.sha2("item", 256).alias("item_key"), "item_id")
        out = _joined(texts, items, size, percent).join(ids, "item_key").select("key.doc_id", "item_id", "n_shingles", "n_shared")
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for part in arrow.parts(batches, 1_000):
                found = []
                for doc, text in zip(*arrow.values(part, "doc_id", "text"), strict=True):
                    words = plain_words(text)
                    found += [(doc, *x) for x in sent.value.found(words, hashes.of(words))]
                yield arrow.made({n: ([r[i] for r in found], pa.int64()) for i, n in enumerate(("doc_id", "item_id", "n_shingles", "n_shared"))})

        out = rows.mapInArrow(run, "doc_id bigint, item_id bigint, n_shingles bigint, n_shared bigint")
    return out.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_shared").alias("n_shared"))


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", size: int = SIZE, percent: int = PERCENT, most_items: int = MOST_ITEMS, most_chars: int = MOST_CHARS) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns as they are; a null text contains none.

    A benchmark that is sent to the workers takes no shuffle: each row is judged
    where it is. For a larger one, texts are known by their SHA-256.
    """
    sent = _sent(items, size, percent, most_items, most_chars)
    if sent is None:
        name = arrow.spare(docs.columns, "text_key")
        keyed = docs.withColumn(name, F.sha2(F.col(text).cast("string"), 256))
        texts = keyed.select(F.col(name).alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null")
        bad = scratch.table(_joined(texts, items, size, percent).select(F.col("key").alias(name)).distinct(), "contaminated")
        return keyed.join(bad, name, "left_anti").select(*docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in arrow.parts(batches, 1_000):
            clean = []
            for t in part.column(text).to_pylist():
                words = plain_words(t)
                clean.append(next(sent.value.found(words, hashes.of(words)), None) is None)
            yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
