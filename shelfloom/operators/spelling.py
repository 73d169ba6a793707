"""Names corrected against a vocabulary table, without comparing all with all.

A word is near a name if their edit distance, in any case, is at most a share of the
longer one's length. Near pairs share a key, so they are found by a join on equality
and then verified:

* up to ``DELETED`` edits: what is left of either after deleting as many characters
  or fewer (a pair k edits apart has a common one);
* more edits, which only longer words may have: of k + 1 pieces of the word one is in
  the name unchanged, so a name's substrings of the pieces' lengths are keys.

Names that many rows have are looked up once. A frequent key is split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETED = 2


def edits(n: Column, most: float) -> Column:
    """Edits that are allowed to a word of length ``n`` and any of its near words, the longer ones too."""
    return F.floor((n * most + 1e-9) / (1 - most)).cast("int")


def _one_less(words: Column) -> Column:
    """An array of words to all that are left of them after deleting one character."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(F.length(w) > 0, less(w)).otherwise(F.array().cast("array<string>")))))


def _deletions(c: Column, k: Column) -> Column:
    left = [F.array(c)]
    for _ in range(DELETED):
        left.append(_one_less(left[-1]))
    some = [F.when(k >= i, x).otherwise(F.array().cast("array<string>")) for i, x in enumerate(left)]
    return F.array_distinct(F.concat(*some))


def _pieces(c: Column, k: Column) -> Column:
    """``k`` + 1 pieces, the longer ones first."""
    n = F.length(c)
    size, longer = F.floor(n / (k + 1)).cast("int"), F.pmod(n, k + 1)
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.substring(c, i * size + F.least(i, longer) + 1, size + (i < longer).cast("int")))


def _substrings(c: Column, low: Column, high: Column) -> Column:
    """All substrings of ``low`` to ``high`` characters."""
    of = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, size))
    return F.array_distinct(F.flatten(F.transform(F.sequence(low, high), of)))


def near_words(names: DataFrame, name: str, words: DataFrame, word: str, most: float = 0.15) -> DataFrame:
    """(name, word, distance): all pairs of distinct names and words within ``most`` edits a character of the longer one; both trimmed, compared in lower case."""
    low = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    a = names.select(low(name).alias("a")).filter("a <> ''").distinct().withColumn("k", edits(F.length("a"), most))
    b = words.select(low(word).alias("b")).filter("b <> ''").distinct().withColumn("k", edits(F.length("b"), most))
    short = a.select("a", F.explode(_deletions(F.col("a"), F.least("k", F.lit(DELETED)))).alias("key")).join(b.select("b", F.explode(_deletions(F.col("b"), F.least("k", F.lit(DELETED)))).alias("key")), "key")
    # a piece of a word of n characters has n / (k + 1) of them, rounded down or up, and n is within k of the name's length
    least = F.floor((F.length("a") - F.col("k")) / (F.col("k") + 2)).cast("int")
    longest = F.ceil((F.length("a") + F.col("k")) / F.greatest(F.col("k"), F.lit(1))).cast("int")
    long_a = a.filter(F.col("k") > DELETED).select("a", F.explode(_substrings(F.col("a"), F.greatest(least, F.lit(1)), F.least(longest, F.length("a")))).alias("key"))
    long_b = b.filter(F.col("k") > DELETED).select("b", F.explode(F.array_distinct(_pieces(F.col("b"), F.col("k")))).alias("key"))
    pairs = short.select("a", "b").union(long_a.join(long_b, "key").select("a", "b")).distinct()
    far = F.levenshtein("a", "b")
    return pairs.withColumn("distance", far).filter(F.col("distance") <= most * F.greatest(F.length("a"), F.length("b")) + 1e-9)


def corrected(names: DataFrame, name: str, words: DataFrame, word: str, order: str | None = None, into: str = "corrected", most: float = 0.15) -> DataFrame:
    """``names`` with the nearest word of the vocabulary in ``into``: the first by ``order`` (or the word itself) of equally near ones, the name as it is without one. Null stays null."""
    low = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    first = words.select(low(word).alias("_b"), F.struct(F.col(order or word).alias("order"), F.col(word).alias("word")).alias("_w")).groupBy("_b").agg(F.min("_w").alias("_w"))
    best = near_words(names, name, words, word, most).join(first, F.col("b") == F.col("_b")).groupBy(F.col("a").alias("_a")).agg(F.min(F.struct("distance", "_w")).alias("_x"))
    return names.drop(into).join(best, low(name) == F.col("_a"), "left").select(*[c for c in names.columns if c != into], F.coalesce("_x._w.word", F.col(name)).alias(into))
