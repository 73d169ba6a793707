"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """Cosine similarity; null for a vector of length 0 unless there is an ``epsilon``."""
    return dot(a, b) / F.nullif(norm(a) * norm(b) + epsilon, F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 2 for a vector of length 0."""
    return F.coalesce(1 - cosine(a, b), F.lit(2.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def rocchio(query: Column, rejected: Column, alpha: float = 1.0, gamma: float = 0.45) -> Column:
    """The query moved away from a rejected vector, at unit length; the query itself where nothing is left."""
    moved = F.zip_with(doubles(query), doubles(rejected), lambda q, r: alpha * q - gamma * r)
    length = norm(moved)
    return F.when(length > 1e-12, F.transform(moved, lambda x: x / length)).otherwise(doubles(query))


def sign_bits(v: Column, first: int = 0, bits: int = 64) -> Column:
    """Bigint whose bit i says whether component ``first + i`` is positive."""
    part = F.transform(F.slice(v, first + 1, bits), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    one = lambda x: F.when(x["x"] > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), x["i"])).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(part, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(one(x)))


def product_codes(v: Column, books: Column, width: int) -> Column:
    """array<int>: for each slice of ``width`` the nearest entry of its codebook (array of arrays of arrays), the first of equals."""
    part = lambda j: F.slice(v, j * width + 1, F.lit(width))
    best = lambda book, j: F.array_min(F.transform(book, lambda c, i: F.struct(squared_distance(part(j), c).alias("d"), i.alias("i"))))["i"]
    return F.transform(books, lambda book, j: best(book, j))
