"""Search of products from end to end: brand, title, queries, engines, fusion, gates.

A product's brand is the typed one corrected against the table of brands, or the
first brand that its name holds, or its name's first word. Its cleaned title gives a
sequence of queries; each engine answers with its list for the first query that it
has anything for. The lists of a product are fused by reciprocal ranks, every
candidate is judged by the filter chain, and the accepted ones come first.

Every step is a join or an aggregate on the product, the query or the candidate, for
all products at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.functions import text
from shelfloom.operators import brands, catalog, ranking, spelling


def resolve_brands(products: DataFrame, table: DataFrame, name: str = "name", brand: str = "brand") -> DataFrame:
    """``products`` with the brand resolved, and ``brand_from``: ``typed``, ``name``, ``start`` or null without one. ``table`` has (brand, synonyms, order)."""
    words = table.select("brand", "order", F.explode("synonyms").alias("_word")).filter("trim(_word) <> ''")
    typed = products.withColumn("_typed", F.nullif(F.trim(F.col(brand)), F.lit("")))
    near = spelling.corrected(typed, "_typed", words.groupBy("_word").agg(F.min("order").alias("order")), "_word", "order", "_near")
    # a synonym stands for its brand
    named = words.groupBy(F.lower(F.trim("_word")).alias("_low")).agg(F.min_by("brand", F.struct("order", "brand")).alias("_brand"))
    known = near.join(named, F.lower(F.trim("_near")) == F.col("_low"), "left")
    held = brands.first_brand(known, table, name, "_held")
    first = F.nullif(F.split(F.trim(F.col(name)), r"\s+")[0], F.lit(""))
    found = F.coalesce("_brand", "_typed", "_held", first)
    source = F.when(F.col("_typed").isNotNull(), "typed").when(F.col("_held").isNotNull(), "name").when(first.isNotNull(), "start")
    return held.select(*[c for c in products.columns if c != brand], found.alias(brand), source.alias("brand_from"))


def query_sequence(name: Column, brand: Column) -> Column:
    """Queries in their order, each once, in lower case: brand and cleaned title, the title alone, the title with the word that fits its kind; none without a title."""
    title, own = F.lower(text.search_name(name)), F.lower(F.coalesce(brand, F.lit("")))
    bare = F.trim(F.regexp_replace(F.replace(title, F.when(own != "", own).otherwise(F.lit("\0"))), r"\s+", " "))
    sequence = F.array(F.trim(F.concat_ws(" ", own, bare)), bare, F.lower(text.fallback_query(name)))
    return F.when(title != "", F.array_distinct(F.filter(sequence, lambda q: q != ""))).otherwise(F.array().cast("array<string>"))


def search(products: DataFrame, results: DataFrame, table: DataFrame, weights: dict[str, float] | None = None, most: int = catalog.MOST_CANDIDATES) -> DataFrame:
    """Products (product_key, name, brand, competitors) and engine results (engine, query, rank, candidate, title, url, width, height) to the trail.

    Trail: product_key, brand, brand_from, candidate, query (the first one that an
    engine answered with it), n_engines, score, reject_reason, has_brand, relevance,
    place (1 is the image to take if its reject_reason is null). Products without any
    result have no row. ``weights`` are those of engines (1 without).
    """
    known = resolve_brands(products, table).withColumn("query", F.explode(query_sequence(F.col("name"), F.col("brand"))))
    asked = known.select("product_key", F.col("query").alias("_asked"), F.array_position(query_sequence(F.col("name"), F.col("brand")), F.col("query")).alias("step"))
    answered = asked.join(results.filter(F.col("rank") <= most), F.col("_asked") == F.col("query"))
    first = answered.groupBy("product_key", "engine").agg(F.min("step").alias("first"))
    lists = answered.join(first, ["product_key", "engine"]).filter("step = first")
    weight = F.lit(1.0)
    for engine, w in (weights or {}).items():
        weight = F.when(F.col("engine") == engine, w).otherwise(weight)
    shown = ["title", "url", "width", "height"]
    fused = lists.groupBy("product_key", "candidate").agg(
        F.round(F.sum(weight / (ranking.K + F.col("rank"))), 6).alias("score"), F.countDistinct("engine").alias("n_engines"), F.min_by("query", "step").alias("query"), *[F.first(c).alias(c) for c in shown]
    )
    own = known.select("product_key", "name", "brand", "brand_from", "competitors").distinct()
    joined = fused.join(own, "product_key").withColumns({"product": F.col("name"), "synonyms": F.array(F.lower("brand"))})
    trail = catalog.candidate_trail(joined)
    order = [F.col("reject_reason").isNotNull(), F.desc("relevance"), F.desc("score"), F.desc("resolution"), F.asc("candidate")]
    placed = ranking.with_rank(trail, order, ["product_key"], name="place")
    return placed.select("product_key", "brand", "brand_from", "candidate", "query", "n_engines", "score", "reject_reason", "has_brand", "relevance", "place")
