"""Small tables for the tests of the text operators."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """Rows (doc_id, text[, source]) as a documents table with a column of a clashing name."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
    clashing = ("hash", "family", "ids", "n_words", "kept", "removed", "base_failed", "n_lines_removed", "line_hash", "site", "blob", "findings", "entry", "component_id", "rank", "start", "item_id", "formatted")
    return spark.createDataFrame(full, SCHEMA).withColumns({c: F.lit(1) for c in clashing})


def words(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(ws, seed, edits):
    r, out = random.Random(seed), list(ws)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return out


#: Ids that a float can't hold, beside a null.
LARGE_IDS = [9_007_199_254_740_993, None, -9_007_199_254_740_995, 9_007_199_254_740_992]


def with_large_ids(spark, text):
    """A documents table in one partition, so that every batch has a null beside the large ids."""
    rows = [(i, text if k == 0 else f"{text} and {k}") for k, i in enumerate(LARGE_IDS)]
    return documents(spark, rows).withColumn("n_chars", F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))).coalesce(1)
