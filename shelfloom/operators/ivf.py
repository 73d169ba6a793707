"""Nearest vectors over an inverted file: lists by centroid, residual codes, exact scores.

``fit`` takes a bounded sample to the driver, clusters it into centroids, and the
parts of what is left (residuals) into small codebooks. ``index`` gives every row its
list, its angle to the list's centroid and its codes: all rows are in the index,
whatever the sample. Searches are joins on the list; neither vectors nor queries go
through the driver.

``within`` finds all rows from a similarity up and is exact: a list whose widest
angle is known can hold such a row only if the query's angle to the centroid is at
most that angle and the asked one together. ``nearest`` takes the ``probes`` nearest
lists of a query, scores their rows by codes (a few bytes a row are shuffled, no
vectors), and scores the best ``shortlist`` of a query again by their vectors; its
recall is below one. ``all_pairs`` is the exact way without an index: blocks of rows
meet blocks of queries.

A list with many rows, or with many queries, is cut into blocks by hashes of the
keys, so a task has a bounded number of either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.functions import vectors

#: Rows, and queries, that meet in one task at most (about: blocks are by hash).
MOST_ROWS = 20_000
MOST_QUERIES = 2_000
#: Similarities that a task holds at once.
_HELD = 1_000_000
#: Angles are compared with so much to spare, as they are of rounded numbers.
_SPARE = 1e-5


@dataclass(frozen=True)
class Quantizer:
    """Centroids (lists, width) of unit length, codebooks (parts, entries, slice) of residuals, and how many lists a search should look into."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def width(self) -> int:
        return self.centroids.shape[1]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _clusters(points: np.ndarray, k: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """At most ``k`` means of the points."""
    centres = points[random.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        of = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        for j in np.unique(of):
            centres[j] = points[of == j].mean(axis=0)
    return centres


def _probes_for(points: np.ndarray, centroids: np.ndarray, coverage: float, queries: int = 500, k: int = 10) -> int:
    """Nearest lists that hold the share ``coverage`` of the ``k`` nearest of some points among all."""
    if len(points) < 2:
        return len(centroids)
    s = points[:queries] @ points.T
    s[np.arange(len(s)), np.arange(len(s))] = -9
    k = min(k, len(points) - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    rank = (-(points[:queries] @ centroids.T)).argsort(axis=1).argsort(axis=1)
    at = np.sort(np.take_along_axis(rank, (points @ centroids.T).argmax(axis=1)[best], axis=1), axis=None)
    return int(at[min(len(at) - 1, int(coverage * len(at)))]) + 1


def fit(df: DataFrame, key: str, vector: str, lists: int | None = None, parts: int = 32, entries: int = 16, sample: int = 20_000, most_lists: int = 4_096, coverage: float = 0.95, seed: int = 5) -> Quantizer:
    """Centroids and codebooks of a sample of about ``sample`` rows at most, by hash of the key; ``lists`` is the root of the number of rows unless given.

    How many lists a search should look into is measured on the sample: as many as
    hold the share ``coverage`` of its points' ten nearest. Well-parted data need few;
    where all directions are alike, as of noise, it is most of them.
    """
    rows = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull())
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    found = rows.select(vector).toArrow().column(vector).to_pylist()
    if not found:
        raise ValueError("no vectors to fit")
    random, points = np.random.default_rng(seed), _unit(np.array(found, dtype=np.float64))
    centroids = _unit(_clusters(points, min(lists or max(1, round(n**0.5)), most_lists, len(points)), random))
    rest = points - centroids[(points @ centroids.T).argmax(axis=1)]
    parts = max(p for p in range(1, parts + 1) if rest.shape[1] % p == 0)
    slices = np.split(rest, parts, axis=1)
    books = [_clusters(s, entries, random) for s in slices]
    return Quantizer(centroids, np.stack(books), _probes_for(points, centroids, coverage))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _sound(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(key, vector) of the rows that have both."""
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<float>").alias("vector")).filter(F.col("key").isNotNull() & (F.size("vector") == width))


def index(df: DataFrame, quantizer: Quantizer, key: str, vector: str) -> DataFrame:
    """(list, key, vector, angle, codes): one row for each row that has a key and a vector of the right length."""
    sent = df.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _unit(_matrix(batch.column("vector"), q.width))
            near = points @ q.centroids.T
            of = near.argmax(axis=1)
            rest = points - q.centroids[of]
            codes = np.stack([((b**2).sum(axis=1) - 2 * s @ b.T).argmin(axis=1) for s, b in zip(np.split(rest, len(q.books), axis=1), q.books, strict=True)], axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(of)), of], -1, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(of, pa.int32()), batch.column("key"), batch.column("vector"), pa.array(angle), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())], names=["list", "key", "vector", "angle", "codes"]
            )

    return _sound(df, key, vector, quantizer.width).mapInArrow(run, "list int, key bigint, vector array<float>, angle double, codes binary")


def _probes(queries: DataFrame, quantizer: Quantizer, key: str, vector: str, wanted: Callable[[np.ndarray], Iterator[np.ndarray]]) -> DataFrame:
    """(list, query, asked, near): the lists that ``wanted`` gives for each row of similarities to the centroids."""
    sent = queries.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            for part in (batch.slice(at, 1_000) for at in range(0, batch.num_rows, 1_000)):
                near = _unit(_matrix(part.column("vector"), q.width)) @ q.centroids.T
                lists = list(wanted(near))
                of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                to = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int32)
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(to), part.column("key").take(take), part.column("vector").take(take), pa.array(near[of, to])], names=["list", "query", "asked", "near"])

    return _sound(queries, key, vector, quantizer.width).mapInArrow(run, "list int, query bigint, asked array<float>, near double")


def _meet(rows: DataFrame, asked: DataFrame, counts: DataFrame, each: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``each`` of the rows and the queries of one list, by blocks of both. ``counts`` has (list, n) of the rows: as many rows as lists, so it is sent."""
    cut = lambda n, most: F.ceil(F.coalesce(n, F.lit(1)) / most).cast("int")
    # a query that asks for a list twice is a row of each
    wanted = asked.groupBy("list").agg(F.count("*").alias("m"))
    sizes = counts.join(wanted, "list").select("list", cut(F.col("n"), MOST_ROWS).alias("row_blocks"), cut(F.col("m"), MOST_QUERIES).alias("query_blocks"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = rows.join(sizes, "list").withColumn("r", F.pmod(F.xxhash64("key"), F.col("row_blocks")).cast("int")).withColumn("q", upto("query_blocks")).drop("row_blocks", "query_blocks")
    met = asked.join(sizes, "list").withColumn("q", F.pmod(F.xxhash64("query"), F.col("query_blocks")).cast("int")).withColumn("r", upto("row_blocks")).drop("row_blocks", "query_blocks")
    return own.groupBy("list", "r", "q").cogroup(met.groupBy("list", "r", "q")).applyInArrow(each, schema)


_HITS = "query bigint, first_hit bigint, best bigint, similarity double"


def _hits(least: float, digits: int, with_itself: bool = False) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each query the least key and the best of the other rows from ``least`` up, of one pair of blocks."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "first_hit": [], "best": [], "similarity": []}
        if rows.num_rows and asked.num_rows:
            width = len(rows.column("vector")[0])
            keys, points = rows.column("key").to_numpy(), _unit(_matrix(rows.column("vector"), width))
            ids, q = asked.column("query").to_numpy(), _unit(_matrix(asked.column("asked"), width))
            order = np.argsort(keys, kind="stable")  # the first of equals is the least key
            keys, points = keys[order], points[order]
            step = max(1, _HELD // len(keys))
            for at in range(0, len(ids), step):
                near = q[at : at + step] @ points.T
                for i, s in zip(ids[at : at + step], np.round(near, digits, out=near), strict=True):
                    if not with_itself:
                        s[keys == i] = -2.0
                    over = s >= least
                    if over.any():
                        best = int(s.argmax())
                        for name, value in zip(out, (int(i), int(keys[over.argmax()]), int(keys[best]), float(s[best])), strict=True):
                            out[name].append(value)
        return pa.table({n: pa.array(v, pa.float64() if n == "similarity" else pa.int64()) for n, v in out.items()})

    return run


def _of_all(found: DataFrame) -> DataFrame:
    top = F.max(F.struct("similarity", (-F.col("best")).alias("o")))
    return found.groupBy("query").agg(F.min("first_hit").alias("first_hit"), top.alias("t")).select("query", "first_hit", (-F.col("t.o")).alias("best"), F.col("t.similarity").alias("similarity"))


def best_hits(rows: DataFrame, asked: DataFrame, counts: DataFrame, least: float, digits: int = 10, with_itself: bool = False) -> DataFrame:
    """(query, first_hit, best, similarity) of rows (list, key, vector) and queries (list, query, asked) that share a list; ``counts`` has (list, n) of the rows."""
    return _of_all(_meet(rows, asked, counts, _hits(least, digits, with_itself), _HITS))


def within(indexed: DataFrame, quantizer: Quantizer, queries: DataFrame, key: str, vector: str, least: float, digits: int = 10) -> DataFrame:
    """(query, first_hit, best, similarity): for each query the least key and the best of the other rows from ``least`` cosine up. Exact.

    ``indexed`` should be a written table, as it is read twice. Similarities are
    rounded to ``digits`` before they are compared; of equal ones the least key is
    the best. Queries without a hit, without a key or without a vector have no row.
    """
    lists = indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle"))
    widest = np.full(len(quantizer.centroids), -1.0)
    for r in lists.select("list", "angle").collect():  # as many rows as lists
        widest[r[0]] = r[1]
    reach = np.arccos(np.clip(least, -1, 1)) + widest + _SPARE

    def wanted(near: np.ndarray) -> Iterator[np.ndarray]:
        angles = np.arccos(np.clip(near, -1, 1))
        return (np.flatnonzero((a <= reach) & (widest >= 0)) for a in angles)

    asked = _probes(queries, quantizer, key, vector, wanted).drop("near")
    return best_hits(indexed.select("list", "key", "vector"), asked, lists.select("list", "n"), least, digits)


def nearest(indexed: DataFrame, quantizer: Quantizer, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None, shortlist: int | None = None) -> DataFrame:
    """(query, rank, key, similarity): about the ``k`` nearest other rows of each query, by their true cosine; equal ones by key.

    Of the rows in a query's ``probes`` nearest lists (as the fit has measured, unless
    given) the best ``shortlist`` by codes (eight times k) are scored. ``indexed`` should be a written table.
    """
    short, books, centroids = shortlist or 8 * k, quantizer.books, quantizer.centroids
    sent = queries.sparkSession.sparkContext.broadcast((centroids, books))

    def wanted(near: np.ndarray) -> Iterator[np.ndarray]:
        n = min(probes or quantizer.probes, near.shape[1])
        return iter(np.argpartition(-near, n - 1, axis=1)[:, :n])

    def each(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and asked.num_rows:
            books = sent.value[1]
            parts = len(books)
            keys = rows.column("key").to_numpy()
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            q = _unit(_matrix(asked.column("asked"), books.shape[0] * books.shape[2]))
            table = np.einsum("npw,pew->npe", q.reshape(len(q), parts, -1), books)
            for i, near, lookup in zip(asked.column("query").to_pylist(), asked.column("near").to_pylist(), table, strict=True):
                s = near + lookup[np.arange(parts), codes].sum(axis=1)
                s[keys == i] = -9
                take = np.argpartition(-s, short - 1)[:short] if len(s) > short else np.arange(len(s))
                take = take[s[take] > -9]
                out[0].extend([i] * len(take))
                out[1].extend(keys[take].tolist())
                out[2].extend(s[take].tolist())
        return pa.table({"query": pa.array(out[0], pa.int64()), "key": pa.array(out[1], pa.int64()), "about": pa.array(out[2], pa.float64())})

    asked = _probes(queries, quantizer, key, vector, wanted)
    counts = indexed.groupBy("list").agg(F.count("*").alias("n"))
    found = _meet(indexed.select("list", "key", "codes"), asked, counts, each, "query bigint, key bigint, about double")
    by = lambda *order: Window.partitionBy("query").orderBy(*order)  # noqa: E731  at most blocks times shortlist rows each
    some = found.withColumn("n", F.row_number().over(by(F.desc("about"), "key"))).filter(F.col("n") <= short).select("query", "key")
    q = _sound(queries, key, vector, quantizer.width).select(F.col("key").alias("query"), F.col("vector").alias("asked"))
    scored = some.join(indexed.select("key", "vector"), "key").join(q, "query").select("query", "key", F.round(vectors.cosine(F.col("vector"), F.col("asked")), 6).alias("similarity"))
    return scored.withColumn("rank", F.row_number().over(by(F.desc("similarity"), "key"))).filter(F.col("rank") <= k).select("query", "rank", "key", "similarity")


def all_pairs(df: DataFrame, queries: DataFrame, key: str, vector: str, least: float, digits: int = 10) -> DataFrame:
    """``within`` without an index: every block of rows meets every block of queries. Work is rows times queries."""
    width = df.filter(F.col(vector).isNotNull()).agg(F.max(F.size(vector))).first()[0] or 0
    rows, asked = _sound(df, key, vector, width), _sound(queries, key, vector, width).select(F.col("key").alias("query"), F.col("vector").alias("asked"))
    counts = rows.groupBy(F.lit(0).alias("list")).agg(F.count("*").alias("n"))
    return best_hits(rows.withColumn("list", F.lit(0)), asked.withColumn("list", F.lit(0)), counts, least, digits)
