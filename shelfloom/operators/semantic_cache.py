"""Products answered from a cache of resolved ones: same brand, no conflicting word, the most alike vector.

A word of a fixed list that only one of two names has is a conflict, so names can
match only if they have the same ones: the set of words a name has, as bits, and its
brand are a key, and products meet by a join on it. Within a key vectors meet in
blocks of bounded size, as one matrix product each; a brand that a third of the
products have is many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.operators import ivf

#: Words of which both names have each or neither.
CONFLICTING = ("chocolate", "strawberry", "vanilla", "laban", "milk", "water", "juice", "atta", "flour", "oil", "rice", "sugar", "salt", "tea", "coffee", "yogurt")
LEAST = 0.92


def conflict_bits(name: Column) -> Column:
    """The words of the list that a name holds, in any case, as bits; none for null."""
    low = F.lower(F.coalesce(name.cast("string"), F.lit("")))
    return sum((F.when(low.contains(w), 1 << i).otherwise(0) for i, w in enumerate(CONFLICTING)), F.lit(0))


def match_key(name: Column, brand: Column) -> Column:
    """What two products must share: the words' bits and the brand, trimmed and in lower case (null is empty)."""
    return F.concat_ws("|", conflict_bits(name).cast("string"), F.lower(F.trim(F.coalesce(brand.cast("string"), F.lit("")))))


def cache_hits(cache: DataFrame, queries: DataFrame, key: str, name: str, brand: str, vector: str, least: float = LEAST, digits: int = 10) -> DataFrame:
    """(query, best, similarity): the cached product most alike each queried one, from ``least`` cosine up; of equal ones the least key.

    Products without a key or a vector, or with one of another length than the
    longest in the cache, match nothing. A product that is on both sides matches itself.
    """
    width = cache.agg(F.max(F.size(vector))).first()[0] or 0
    side = lambda df, a, b: df.select(match_key(F.col(name), F.col(brand)).alias("list"), F.col(key).cast("bigint").alias(a), F.col(vector).cast("array<float>").alias(b)).filter(F.col(a).isNotNull() & (F.size(b) == width))
    rows, asked = side(cache, "key", "vector"), side(queries, "query", "asked")
    counts = rows.groupBy("list").agg(F.count("*").alias("n"))
    return ivf.best_hits(rows, asked, counts, least, digits, with_itself=True).drop("first_hit")
