"""Removal of boilerplate lines by the number of distinct sites that they spread over.

A line's spread is a HyperLogLog sketch of its sites, kept for each line hash;
partial sketches are made where the rows are and merge by aggregation, so a line
on a third of all pages costs a sketch for each task. Where the estimate is within
the sketch's error of the threshold, the distinct sites of the line are counted
exactly. SQL functions only.

A line is compared with A-Z and all other letters in lower case and runs of blanks
as one. Equality is that of 64-bit hashes of such lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import arrow, scratch

MIN_SITES, LG_K = 10, 10


def _hash(line: Column) -> Column:
    """Hash of a line; null for a blank one."""
    normal = F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))
    return F.when(normal != "", F.xxhash64(normal))


def _lines(text: Column) -> Column:
    return F.split(text.cast("string"), "\n", -1)


def line_hashes(docs: DataFrame, key: str, site: str, text: str = "text") -> DataFrame:
    """(key, text_hash, site, line_hash) for each distinct line of each row that isn't blank; written once, as it is needed more than once."""
    lines = F.array_distinct(F.filter(F.transform(_lines(F.col(text)), _hash), lambda h: h.isNotNull()))
    own = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(site).cast("string").alias("site"), F.explode(lines).alias("line_hash"))
    return scratch.table(own, "lines")


def boilerplate(hashes: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``line_hashes`` to (line_hash): lines on at least ``min_sites`` distinct sites. A null site is no site."""
    seen = hashes.select("site", "line_hash").filter("site is not null")
    spread = seen.groupBy("line_hash").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    error = 3 * 1.04 / math.sqrt(2**lg_k)
    low, high = min(min_sites * (1 - error), min_sites - 1), max(min_sites * (1 + error), min_sites + 1)
    judged = scratch.table(spread.select("line_hash", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= low), "spread")
    near = judged.filter(F.col("sites") <= high).select("line_hash")
    exact = seen.join(near, "line_hash").groupBy("line_hash").agg(F.countDistinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return judged.filter(F.col("sites") > high).select("line_hash").union(exact.select("line_hash"))


def remove_boilerplate(
    docs: DataFrame, site: str = "source", text: str = "text", key: str = "doc_id", min_sites: int = MIN_SITES, lg_k: int = LG_K, count_as: str = "n_lines_removed", whole_as: str = "all_boilerplate"
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, their number as ``count_as``, and ``whole_as``: one row for each row.

    Every line but a blank one counts, however short it is and whatever its share
    of the text. A text with no other line isn't a page with boilerplate but a
    copied page: it stays as it is and is flagged in ``whole_as``, for near-duplicate
    removal to judge. Null and empty texts stay as they are; a null site counts for
    no spread, but its lines are removed like others. Repeated rows are treated
    alike, and rows without a key by their own text. An empty table gives no rows.
    Other columns are kept; ones that are named as the two results are replaced.
    """
    docs = docs.drop(count_as, whole_as)
    hashes = line_hashes(docs, key, site, text)
    found = scratch.only(docs.sparkSession, lambda: boilerplate(hashes, min_sites, lg_k), "boilerplate")
    k, h, bad, lines, stay = (arrow.spare(docs.columns, "__" + name) for name in ("key", "text_hash", "bad", "lines", "stay"))
    has = hashes.select(F.col("key").alias(k), F.col("text_hash").alias(h), "line_hash").join(found, "line_hash").groupBy(k, h).agg(F.collect_set("line_hash").alias(bad))
    both = docs.join(has, docs[key].eqNullSafe(has[k]) & (F.xxhash64(docs[text].cast("string")) == has[h]), "left").withColumn(lines, _lines(F.col(text)))
    clean = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(bad, _hash(x)), F.lit(False)))
    both = both.withColumn(stay, F.when(F.col(bad).isNotNull(), clean))
    some = F.coalesce(F.exists(stay, lambda x: x.rlike(r"[^\x20\x09-\x0D]")), F.lit(False))
    new = {text: F.when(some, F.array_join(stay, "\n")).otherwise(F.col(text))}
    count = F.when(some, F.size(lines) - F.size(stay)).otherwise(0).cast("bigint")
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns], count.alias(count_as), (F.col(bad).isNotNull() & ~some).alias(whole_as))
