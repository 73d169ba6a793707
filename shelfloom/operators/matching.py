"""Matching: vocabularies, linkage, set, bit and vector similarity joins, survivorship."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.functions import scoring, text

def closest_word(c: Column, vocabulary: list[str], most: float = 0.15) -> Column:
    """The word of a vocabulary within ``most`` edits a character, the nearest and then the first; the value itself without one."""
    low = F.lower(F.trim(c))
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(vocabulary)])
    scored = F.transform(words, lambda x: F.struct(F.levenshtein(low, F.lower(x["w"])).alias("d"), x["i"].alias("i"), x["w"].alias("w")))
    near = F.filter(scored, lambda x: x["d"] / F.greatest(F.length(low), F.length(x["w"])) <= most)
    return F.coalesce(F.array_min(near)["w"], c)


def closest_phrase(c: Column, vocabulary: list[str], least: float = 0.7) -> Column:
    """Exact in any case, else all words of one in the other, else the best sequence ratio from ``least`` up; null without one."""
    known = [(w, w.lower(), set(w.lower().split())) for w in vocabulary]

    def one(x: str | None) -> str | None:
        low = (x or "").strip().lower()
        if not low:
            return None
        words = set(low.split())
        for w, l, _ in known:
            if l == low:
                return w
        for w, _, s in known:
            if s <= words or words <= s:
                return w
        best = max(((difflib.SequenceMatcher(None, low, l).ratio(), -i, w) for i, (w, l, _) in enumerate(known)), default=(0.0, 0, None))
        return best[2] if best[0] >= least else None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict = {}
        for x in batches:
            yield x.map(lambda v: seen[v] if v in seen else seen.setdefault(v, one(v)))

    return run(c)


def resolve_entities(names: DataFrame, column: str, synonyms: dict[str, str], least: float = 0.85) -> DataFrame:
    """(column, entity, confidence): a synonym (1), else the canonical name of best Jaro-Winkler from ``least``, else itself in title case (0.5).

    Each distinct name is resolved against the given names alone, so the result
    doesn't depend on the order in which names arrive.
    """
    canonical = sorted(set(synonyms.values()))
    table = {k.lower(): v for k, v in synonyms.items()}

    @F.pandas_udf("entity string, confidence double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for name in x:
                low = (name or "").strip().lower()
                if low in table:
                    rows.append((table[low], 1.0))
                    continue
                score, best = max(((text.jaro_winkler_value(low, c), c) for c in canonical), key=lambda p: (p[0], -canonical.index(p[1])), default=(0.0, ""))
                rows.append((best, score) if score >= least else (low.title(), 0.5))
            yield pd.DataFrame(rows, columns=["entity", "confidence"])

    distinct = names.select(column).distinct().withColumn("x", run(F.col(column)))
    return distinct.select(column, "x.entity", "x.confidence")


def linkage(pairs: DataFrame, agreements: dict[str, Column]) -> DataFrame:
    """``pairs`` with the summed log weight of agreements and the decision."""
    weight = F.round(reduce(lambda a, b: a + b, [scoring.linkage_weight(f, c) for f, c in agreements.items()]), 4)
    return pairs.withColumn("weight", weight).withColumn("decision", scoring.linkage_decision(F.col("weight")))


def jaccard_pairs(df: DataFrame, key: str, tokens: str, percent: int) -> DataFrame:
    """(a, b, similarity): pairs of token sets with at least ``percent`` Jaccard similarity, by the prefix of the rarest tokens and the sizes that can be linked."""
    sets = df.select(F.col(key).alias("k"), F.array_distinct(tokens).alias("t")).filter(F.size("t") > 0)
    rare = sets.select(F.explode("t").alias("w")).groupBy("w").count()
    ranked = sets.select("k", "t", F.explode("t").alias("w")).join(rare, "w").groupBy("k").agg(F.first("t").alias("t"), F.transform(F.sort_array(F.collect_list(F.struct("count", "w"))), lambda x: x["w"]).alias("o"))
    prefix = F.size("o") - F.ceil(F.size("o") * percent / 100) + 1
    heads = ranked.select("k", F.size("o").alias("n"), F.explode(F.slice("o", F.lit(1), prefix.cast("int"))).alias("w"))
    sized = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    pairs = heads.alias("x").join(heads.alias("y"), (F.col("x.w") == F.col("y.w")) & (F.col("x.k") < F.col("y.k")) & sized).select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    shared, union = F.size(F.array_intersect("ta", "tb")), F.size(F.array_union("ta", "tb"))
    return both.filter(100 * shared >= percent * union).select("a", "b", F.round(shared / union, 6).alias("similarity"))


def hash_classes(df: DataFrame, key: str, bits: str) -> DataFrame:
    """(key, class_id): rows of equal hashes are one class, known by its least key; a hash of 0 is no hash."""
    some = df.filter(F.col(bits) != 0).select(key, bits)
    least = some.groupBy(bits).agg(F.min(key).alias("class_id"))
    return some.join(least, bits).select(key, "class_id")


def _masks(most: int, agree: int, width: int) -> list[int]:
    """Masks of each choice of ``agree`` of ``most + agree`` bands: hashes within ``most`` bits are equal under one at least."""
    n = most + agree
    edges = [round(i * width / n) for i in range(n + 1)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    bands = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(n)]
    return [signed(sum(chosen)) for chosen in combinations(bands, agree)]


def bands_that_agree(n: int, most: int, width: int = 64) -> int:
    """How many bands a key should have for ``n`` hashes: keys for each hash and expected rows under them are least. More bands are more keys, and a power fewer rows that share one."""
    able = [a for a in range(1, 5) if most + a <= width]
    return min(able, key=lambda a: comb(most + a, a) * (1 + n / 2 ** (a * width / (most + a))), default=1)


def _keyed(df: DataFrame, bits: str, masks: Column) -> DataFrame:
    """``df`` for each mask: (..., i, v) with the bits under it.

    Joins of these are by sort and merge: the optimizer takes the rows to be as few as
    those of ``df``, and would send hundreds of times as many through the driver.
    """
    names = df.columns
    return df.select(*names, F.posexplode(masks).alias("i", "m")).select(*names, "i", F.col(bits).bitwiseAND(F.col("m")).alias("v"))


def hamming_pairs(df: DataFrame, key: str, bits: str, most: int, width: int = 64, agree: int | None = None) -> DataFrame:
    """(a, b, n_a, n_b, distance): pairs of classes of equal hashes that differ in at most ``most`` bits, by their least keys and sizes.

    A hash is cut into ``most + agree`` bands, of which ``agree`` are equal in such a
    pair; each choice of so many bands is a key (``bands_that_agree`` of the number of
    classes unless given). A pair is given out by its first common key only, so
    nothing is made distinct. ``hash_classes`` has the members of a class; a hash of
    0 is no hash.
    """
    # names that no column has: of a column under its own name the optimizer drops the alias, and the two sides of the join then share it
    classes = df.filter(F.col(bits) != 0).select(F.col(bits).alias("_hash"), F.col(key).alias("_key")).groupBy("_hash").agg(F.min("_key").alias("k"), F.count("*").alias("n"))
    masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(most, agree or bands_that_agree(classes.count(), most, width), width)])
    keyed = _keyed(classes.select("_hash"), "_hash", masks)
    x, y = keyed.alias("x"), keyed.alias("y")
    off = F.col("x._hash").bitwiseXOR(F.col("y._hash"))
    first = F.array_position(F.transform(masks, lambda m: off.bitwiseAND(m) == 0), True) - 1
    met = x.join(y.hint("merge"), (F.col("x.i") == F.col("y.i")) & (F.col("x.v") == F.col("y.v")) & (F.col("x._hash") < F.col("y._hash")) & (F.bit_count(off) <= most) & (F.col("x.i") == first))
    pairs = met.select(F.col("x._hash").alias("_x"), F.col("y._hash").alias("_y"), F.bit_count(off).alias("distance"))
    # keys and sizes come back by the hash, so that they aren't sent with each mask
    end = lambda of: classes.select(F.col("_hash").alias("_" + of), F.struct("k", "n").alias(of))
    both = pairs.join(end("x"), "_x").join(end("y"), "_y")
    low, high = F.least("x", "y"), F.greatest("x", "y")
    return both.filter(low["k"] < high["k"]).select(low["k"].alias("a"), high["k"].alias("b"), low["n"].alias("n_a"), high["n"].alias("n_b"), "distance")


def hamming_near(df: DataFrame, listed: DataFrame, bits: str, most: int, width: int = 64) -> DataFrame:
    """(``bits``): the distinct hashes of ``df`` within ``most`` bits of a hash of ``listed``, by keys of bands; 0 is a hash here."""
    own, other = df.select(F.col(bits).alias("_own")).filter("_own is not null").distinct(), listed.select(F.col(bits).alias("_h")).filter("_h is not null").distinct()
    masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(most, bands_that_agree(other.count(), most, width), width)])
    met = _keyed(own, "_own", masks).join(_keyed(other, "_h", masks).withColumnsRenamed({"i": "_i", "v": "_v"}).hint("merge"), (F.col("i") == F.col("_i")) & (F.col("v") == F.col("_v")) & (F.bit_count(F.col("_own").bitwiseXOR(F.col("_h"))) <= most))
    return met.select(F.col("_own").alias(bits)).distinct()


def golden_records(df: DataFrame, group: str, key: str, order: list[Column], fields: list[str]) -> DataFrame:
    """(group, *fields of the first in ``order``, members): the surviving record of each group and the keys behind it."""
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("__n = 1").select(group, *fields)
    members = df.groupBy(group).agg(F.count("*").alias("n_members"), F.min(key).alias("first_member"))
    return first.join(members, group)


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(q): modularity of undirected weighted edges (u, v, w) under (node, community), from sums over edges alone."""
    a, b = communities.select(F.col("node").alias("u"), F.col("community").alias("cu")), communities.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    e = edges.join(a, "u").join(b, "v")
    inside = e.filter("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.sum("w").alias("w_in"))
    degree = e.select(F.col("cu").alias("c"), "w").union(e.select("cv", "w")).groupBy("c").agg(F.sum("w").alias("w_tot"))
    m = edges.agg(F.sum("w").alias("m"))
    parts = degree.join(inside, "c", "left").crossJoin(F.broadcast(m))
    return parts.agg(F.round(F.sum(F.coalesce("w_in", F.lit(0.0)) / F.col("m") - F.pow(F.col("w_tot") / (2 * F.col("m")), F.lit(2.0))), 4).alias("q"))
