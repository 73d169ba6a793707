"""Matching, linkage, vectors and stateful folds over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfloom.functions import scoring, text, vectors
from shelfloom.operators import ivf, matching, merge, spelling, stateful, vector_models
from shelfloom.operators import semantic_cache as cache
from shelfloom.plans.registry import query
from shelfloom.sources import sinks
from shelfloom.sources.tables import table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _typos(spark, d):
    s, k = F.col("c_mktsegment"), F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, F.concat(F.expr("substring(c_mktsegment, 1, 3)"), F.expr("substring(c_mktsegment, 5)"))).when(k % 3 == 1, F.lower(s)).otherwise(F.concat(F.lit("x"), F.reverse(s))).alias("typed"))


@query(
    "brand_typo_correction",
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment[1:3] || c_mktsegment[5:] WHEN 1 THEN lower(c_mktsegment) ELSE 'x' || reverse(c_mktsegment) END AS typed FROM customer), v AS (SELECT DISTINCT c_mktsegment AS w FROM customer),
    m AS (SELECT c_custkey, typed, w, levenshtein(lower(typed), lower(w)) AS e FROM t, v WHERE levenshtein(lower(typed), lower(w))::DOUBLE / greatest(length(typed), length(w)) <= 0.15)
    SELECT t.c_custkey, coalesce(arg_min(m.w, (m.e, m.w)), any_value(t.typed)) AS corrected FROM t LEFT JOIN m ON t.c_custkey = m.c_custkey GROUP BY t.c_custkey""",
)
def brand_typo_correction(spark, d):
    """Typed segments against the table of segments."""
    words = table(spark, d, "customer").select("c_mktsegment").distinct()
    return spelling.corrected(_typos(spark, d), "typed", words, "c_mktsegment").select("c_custkey", "corrected")


@query(
    "spelling_by_vocabulary",
    """WITH v AS (SELECT p_name || ' ' || lower(p_type) || CASE WHEN length(p_name) > 9 THEN ' of the ' || p_name ELSE '' END AS w, min(p_partkey) AS o FROM part GROUP BY 1),
    t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(w) WHEN 1 THEN w[1:2] || w[4:] WHEN 2 THEN w[1:3] || 'xy' || w[4:] WHEN 3 THEN 'q' || w[2:5] || w[7:] || 'z' ELSE reverse(w) END AS typed
      FROM (SELECT p_partkey, p_name || ' ' || lower(p_type) || CASE WHEN length(p_name) > 9 THEN ' of the ' || p_name ELSE '' END AS w FROM part)),
    m AS (SELECT typed, w, o, levenshtein(lower(typed), w) AS e FROM (SELECT DISTINCT typed FROM t), v WHERE abs(length(typed) - length(w)) <= 6 AND levenshtein(lower(typed), w) <= 0.15 * greatest(length(typed), length(w)) + 1e-9)
    SELECT p_partkey, t.typed, coalesce(arg_min(w, (e, o)), t.typed) AS corrected FROM t LEFT JOIN m ON m.typed = t.typed GROUP BY p_partkey, t.typed""",
)
def spelling_by_vocabulary(spark, d):
    """Names with up to four edits against a table of names of 8 to 40 characters."""
    p = table(spark, d, "part")
    w = F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"), F.when(F.length("p_name") > 9, F.concat(F.lit(" of the "), F.col("p_name"))).otherwise(F.lit("")))
    said = p.select("p_partkey", w.alias("w"))
    part = lambda low, n=1000: F.substring("w", low, n)
    typed = [F.upper("w"), F.concat(part(1, 2), part(4)), F.concat(part(1, 3), F.lit("xy"), part(4)), F.concat(F.lit("q"), part(2, 4), part(7), F.lit("z")), F.reverse("w")]
    names = said.select("p_partkey", F.get(F.array(*typed), (F.col("p_partkey") % 5).cast("int")).alias("typed"))
    return spelling.corrected(names, "typed", said.groupBy("w").agg(F.min("p_partkey").alias("o")), "w", "o")


@query("fuzzy_best_match", None)
def fuzzy_best_match(spark, d):
    """Exact, then word subset, then sequence ratio; the ratio is beyond SQL."""
    return _typos(spark, d).withColumn("matched", matching.closest_phrase(F.col("typed"), SEGMENTS))


@query("entity_resolution", None)
def entity_resolution(spark, d):
    """Distinct typed names to entities with a confidence."""
    return matching.resolve_entities(_typos(spark, d), "typed", {s.lower(): s.title() for s in SEGMENTS})


_WEIGHT = lambda c, m, u: f"CASE WHEN {c} THEN round(log2({m}::DOUBLE / {u}::DOUBLE), 4) ELSE round(log2((1 - {m}::DOUBLE) / (1 - {u}::DOUBLE)), 4) END"


@query(
    "fellegi_sunter_linkage",
    f"""WITH c AS (SELECT p_name, p_size, p_brand, p_type, floor(p_retailprice)::BIGINT AS price, min(p_partkey) AS k, count(*) AS n FROM part GROUP BY ALL),
    m AS (SELECT a.k AS a, b.k AS b, a.n AS n_a, b.n AS n_b, a.price = b.price AS gtin, a.p_brand = b.p_brand AS brand, a.p_type = b.p_type AS cat FROM c a JOIN c b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.k < b.k AND (a.p_brand = b.p_brand OR a.price = b.price)),
    w AS (SELECT a, b, n_a, n_b, round({_WEIGHT("gtin", 0.99, 0.0001)} + {_WEIGHT("brand", 0.95, 0.02)} + {_WEIGHT("true", 0.9, 0.01)} + {_WEIGHT("true", 0.92, 0.05)} + {_WEIGHT("cat", 0.88, 0.1)}, 4)::DOUBLE AS weight FROM m)
    SELECT a, b, n_a, n_b, weight, CASE WHEN weight >= 8 THEN 'GOLD_MATCH' WHEN weight >= 4 THEN 'PROBABLE_MATCH' WHEN weight >= 1 THEN 'NEEDS_REVIEW' ELSE 'DECLINED' END AS decision FROM w""",
)
def fellegi_sunter_linkage(spark, d):
    """Pairs of record classes that share a name and a size, and a brand or a price to the unit, weighed over five features.

    Records alike in all features are one class (least key, number of records), so a
    frequent name adds classes and not pairs of records; a pair is found under its
    brand, or else under its price, and blocks are of three features.
    """
    same = lambda c: F.col(f"x.{c}") == F.col(f"y.{c}")
    p = table(spark, d, "part").select("p_name", "p_size", "p_brand", "p_type", F.floor("p_retailprice").alias("price"), "p_partkey")
    c = p.groupBy("p_name", "p_size", "p_brand", "p_type", "price").agg(F.min("p_partkey").alias("k"), F.count("*").alias("n"))
    x, y = c.alias("x"), c.alias("y")
    by_brand = x.join(y, same("p_name") & same("p_size") & same("p_brand") & (F.col("x.k") < F.col("y.k")))
    by_price = x.join(y, same("p_name") & same("p_size") & same("price") & (F.col("x.k") < F.col("y.k")) & (F.col("x.p_brand") != F.col("y.p_brand")))
    agree = {"gtin": same("price"), "brand": same("p_brand"), "product_name": same("p_name"), "weight_volume": same("p_size"), "category": same("p_type")}
    keep = [F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"), "weight", "decision"]
    return matching.linkage(by_brand, agree).select(*keep).union(matching.linkage(by_price, agree).select(*keep))


@query("sku_match", None)
def sku_match(spark, d):
    """Half title similarity, half the similarity of the images' vectors, between the first records of titles that share a name and a size; a match from 0.8."""
    p = table(spark, d, "part").groupBy("p_name", "p_size", F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("title")).agg(F.min("p_partkey").alias("k"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    p = p.join(e, "k", "left").withColumn("norm", vectors.norm(F.col("embedding")))
    x, y = p.alias("x"), p.alias("y")
    pairs = x.join(y, (F.col("x.p_name") == F.col("y.p_name")) & (F.col("x.p_size") == F.col("y.p_size")) & (F.col("x.k") < F.col("y.k")))
    cosine = vectors.dot(F.col("x.embedding"), F.col("y.embedding")) / F.nullif(F.col("x.norm") * F.col("y.norm"), F.lit(0.0))  # a vector's length once, not in each pair
    seen = F.coalesce(F.greatest(F.lit(0.0), cosine), F.lit(0.0))
    scored = pairs.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), text.jaro_winkler(F.col("x.title"), F.col("y.title")).alias("jw"), seen.alias("seen"))
    score = F.round(0.5 * F.col("jw") + 0.5 * F.col("seen"), 4)
    return scored.select("a", "b", score.alias("score"), (score >= 0.8).alias("matched"), scoring.arcface_loss(score).alias("loss"))


@query(
    "token_jaccard_join",
    """WITH s AS (SELECT p_name || ' ' || lower(p_type) AS t, min(p_partkey) AS k FROM part GROUP BY 1), x AS (SELECT k, string_split(t, ' ') AS t FROM s)
    SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(a.t || b.t)), 6) AS similarity FROM x a JOIN x b ON a.k < b.k WHERE 100 * len(list_intersect(a.t, b.t)) >= 50 * len(list_distinct(a.t || b.t))""",
)
def token_jaccard_join(spark, d):
    s = table(spark, d, "part").groupBy(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("t")).agg(F.min("p_partkey").alias("k"))
    return matching.jaccard_pairs(s.select("k", F.split("t", " ").alias("t")), "k", "t", 50)


_BITS = """h AS (SELECT vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0::HUGEINT END FOR i IN range(1, 65)])::HUGEINT AS bits FROM embeddings)"""


def _hashes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vectors.sign_bits(F.col("embedding")).alias("bits"))


@query("hamming_join", f"""WITH {_BITS}, c AS (SELECT bits, min(vec_id) AS k, count(*) AS n FROM h WHERE bits <> 0 GROUP BY bits)
    SELECT a.k AS a, b.k AS b, a.n AS n_a, b.n AS n_b, bit_count(xor(a.bits, b.bits))::INT AS distance FROM c a JOIN c b ON a.k < b.k WHERE bit_count(xor(a.bits, b.bits)) <= 8""")  # fmt: skip
def hamming_join(spark, d):
    """Classes of equal 64-bit hashes that differ in at most eight bits, by two of ten bands."""
    return matching.hamming_pairs(_hashes(spark, d), "vec_id", "bits", 8)


@query("hamming_classes", f"WITH {_BITS} SELECT vec_id, min(vec_id) OVER (PARTITION BY bits) AS class_id FROM h WHERE bits <> 0")
def hamming_classes(spark, d):
    """The class of equal hashes that each row is in."""
    return matching.hash_classes(_hashes(spark, d), "vec_id", "bits")


@query("hamming_hex", f"WITH {_BITS} SELECT a.vec_id AS a, bit_count(xor(a.bits, b.bits))::INT AS distance FROM h a JOIN h b ON b.vec_id = 0")
def hamming_hex(spark, d):
    """Distance of hexadecimal hashes to that of one row."""
    h = _hashes(spark, d).withColumn("x", F.lpad(F.hex("bits"), 16, "0"))
    one = h.filter("vec_id = 0").limit(1).select(F.col("x").alias("y"))
    return h.crossJoin(F.broadcast(one)).select(F.col("vec_id").alias("a"), text.hamming_hex(F.col("x"), F.col("y")).alias("distance"))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(
    "vector_first_and_best_hit",
    f"""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS hit, round({_COS}, 10) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT query, min(hit) AS first_hit, arg_max(hit, (s, -hit)) AS best, round(max(s), 6) AS similarity FROM s WHERE s >= 0.3 GROUP BY query""",
)
def vector_first_and_best_hit(spark, d):
    """For every twentieth vector the first and the best other vector over the threshold."""
    e = table(spark, d, "embeddings")
    return ivf.all_pairs(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 6))


def _indexed(spark, d):
    e = table(spark, d, "embeddings")
    quantizer = ivf.fit(e, "vec_id", "embedding")
    return e, quantizer, sinks.write(ivf.index(e, quantizer, "vec_id", "embedding"), sinks.folder(spark, "ivf"))


@query(
    "ivf_threshold_hits",
    f"""WITH s AS (SELECT a.vec_id AS query, b.vec_id AS hit, round({_COS}, 10) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT query, min(hit) AS first_hit, arg_max(hit, (s, -hit)) AS best, round(max(s), 6) AS similarity FROM s WHERE s >= 0.35 GROUP BY query""",
)
def ivf_threshold_hits(spark, d):
    """First and best hits from 0.35 up by the inverted file: only lists that can hold one are read, and none is missed."""
    e, quantizer, rows = _indexed(spark, d)
    return ivf.within(rows, quantizer, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 0.35).withColumn("similarity", F.round("similarity", 6))


@query("ivf_nearest", None)
def ivf_nearest(spark, d):
    """About the ten nearest of every twentieth vector, from as many lists as the fit finds needed; tests hold the recall against all rows."""
    e, quantizer, rows = _indexed(spark, d)
    return ivf.nearest(rows, quantizer, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10)


@query(
    "vector_category",
    f"""WITH c AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), b AS (SELECT c.label, e.vec_id, e.embedding FROM c JOIN embeddings e ON c.vec_id = e.vec_id),
    s AS (SELECT a.vec_id, b.label, b.vec_id AS o, round({_COS}, 10) AS s FROM embeddings a JOIN b ON a.vec_id <> b.vec_id)
    SELECT vec_id, arg_max(label, (s, -o)) AS category, round(max(s), 6) AS confidence FROM s GROUP BY vec_id""",
)
def vector_category(spark, d):
    """The category of the nearest category vector (the first vector of each label, but for itself), with the similarity as confidence."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    known = e.join(first.select("vec_id"), "vec_id", "left_semi")
    best = ivf.all_pairs(known, e, "vec_id", "embedding", -1.0)
    labels = known.select(F.col("vec_id").alias("best"), F.col("label").alias("category"))
    return best.join(labels, "best").select(F.col("query").alias("vec_id"), "category", F.round("similarity", 6).alias("confidence"))


@query(
    "semantic_cache",
    f"""WITH n AS (SELECT count(*) AS m FROM embeddings), p AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS cached, lower(p_brand) AS brand, p_name || [' Milk', ' juice', '', ' chocolate milk'][p_size % 4 + 1] AS name, e.embedding FROM part, n JOIN embeddings e ON e.vec_id = p_partkey % n.m),
    w AS (SELECT *, list_filter({["chocolate", "strawberry", "vanilla", "laban", "milk", "water", "juice", "atta", "flour", "oil", "rice", "sugar", "salt", "tea", "coffee", "yogurt"]}, lambda x: contains(lower(name), x)) AS words FROM p),
    s AS (SELECT a.k AS query, b.k AS hit, round({_COS}, 10) AS s FROM w a JOIN w b ON a.brand = b.brand AND a.words = b.words WHERE NOT a.cached AND b.cached)
    SELECT query, arg_max(hit, (s, -hit)) AS best, round(max(s), 6) AS similarity FROM s WHERE s >= 0.2 GROUP BY query""",
)
def semantic_cache(spark, d):
    """Products answered by a cached one of their brand and words; two thirds of the products ask a third."""
    e, p = table(spark, d, "embeddings"), table(spark, d, "part")
    said = F.get(F.array(*[F.lit(x) for x in (" Milk", " juice", "", " chocolate milk")]), F.col("p_size") % 4)
    n = e.agg(F.count("*").alias("n"))
    rows = p.join(F.broadcast(n)).select(F.col("p_partkey").alias("k"), F.concat("p_name", said).alias("name"), F.concat(F.lit(" "), F.upper("p_brand")).alias("brand"), (F.col("p_partkey") % F.col("n")).alias("vec_id"))
    rows = rows.join(e.select("vec_id", "embedding"), "vec_id")
    out = cache.cache_hits(rows.filter("k % 3 = 0"), rows.filter("k % 3 <> 0"), "k", "name", "brand", "embedding", 0.2)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    "blacklist_anti_join",
    f"""WITH {_BITS}, x AS (SELECT e.vec_id, e.embedding, h.bits FROM embeddings e JOIN h ON e.vec_id = h.vec_id), bl AS (SELECT * FROM x WHERE vec_id % 50 = 0)
    SELECT vec_id FROM x a WHERE NOT EXISTS (SELECT 1 FROM bl b WHERE a.vec_id = b.vec_id OR bit_count(xor(a.bits, b.bits)) <= 4 OR round(1 - {_COS}, 10) < 0.5)""",
)
def blacklist_anti_join(spark, d):
    """Candidates that are no blacklisted row, nor near one by hash or by vector: ids by equality, hashes by keys of bands, vectors in blocks."""
    e = table(spark, d, "embeddings")
    x = e.select("vec_id", "embedding", vectors.sign_bits(F.col("embedding")).alias("bits"))
    listed = x.filter("vec_id % 50 = 0")
    alike = ivf.all_pairs(listed, x, "vec_id", "embedding", 0.5 + 1e-10).select(F.col("query").alias("vec_id"))
    left = x.join(listed.select("vec_id"), "vec_id", "left_anti").join(matching.hamming_near(x, listed, "bits", 4), "bits", "left_anti")
    return left.join(alike, "vec_id", "left_anti").select("vec_id")


@query(
    "change_data_sync",
    """WITH last AS (SELECT p_partkey AS k, sha256(p_name || '|' || p_size) AS h FROM part), e AS (SELECT l_partkey AS k, arg_max(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS s FROM lineitem GROUP BY 1),
    n AS (SELECT p_partkey AS k, sha256(p_name || '|' || CASE WHEN s % 3 = 0 THEN p_size + 1 ELSE p_size END) AS h FROM part JOIN e ON k = p_partkey)
    SELECT n.k, n.h FROM n JOIN last ON n.k = last.k WHERE n.h <> last.h""",
)
def change_data_sync(spark, d):
    """The last event of each product whose state hash differs from the last known one."""
    hashed = lambda size: F.sha2(F.concat_ws("|", "p_name", size.cast("string")), 256)
    part = table(spark, d, "part")
    last = part.select(F.col("p_partkey").alias("k"), hashed(F.col("p_size")).alias("old"))
    e = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("s"))
    now = part.join(e, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_partkey").alias("k"), hashed(F.when(F.col("s") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).alias("h"))
    return now.join(last, "k", "left").filter(~F.col("h").eqNullSafe(F.col("old"))).select("k", "h")


@query(
    "dom_element_match",
    """WITH t AS (SELECT min(p_partkey) AS k, p_brand FROM part GROUP BY p_brand), c AS (SELECT t.k AS target, b.p_partkey AS candidate,
      round((1.5::DOUBLE * (a.p_type = b.p_type)::INT + 1.5::DOUBLE * (a.p_size = b.p_size)::INT + 1.5::DOUBLE * (a.p_name = b.p_name)::INT + 1.5::DOUBLE * round(1 - levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)), 4)
       + 1.5::DOUBLE * len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))::DOUBLE / len(list_distinct(string_split(a.p_name, ' ') || string_split(b.p_name, ' '))) + 0.5::DOUBLE * (a.p_brand = b.p_brand)::INT + 0.5::DOUBLE + 0.5::DOUBLE * greatest(0, 1 - abs(a.p_retailprice - b.p_retailprice) / 1000)) / 9, 4) AS score
      FROM t JOIN part a ON a.p_partkey = t.k JOIN part b ON b.p_brand = a.p_brand AND b.p_partkey <> a.p_partkey)
    SELECT target, arg_max(candidate, (score, -candidate)) AS best, max(score) AS score FROM c GROUP BY target HAVING max(score) >= 0.5""",
)
def dom_element_match(spark, d):
    """For each target element the most alike of its page by eight weighted features; the first of equals, none under a half."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    t = p.groupBy("p_brand").agg(F.min_by(F.struct("p_partkey", "p_name", "p_type", "p_size", "p_retailprice"), "p_partkey").alias("a"))
    c = p.join(t, "p_brand").filter("p_partkey <> a.p_partkey")
    words = lambda x: F.split(x, " ")
    a = lambda n: F.col(f"a.{n}")
    overlap = F.size(F.array_intersect(words(a("p_name")), words(F.col("p_name")))) / F.size(F.array_union(words(a("p_name")), words(F.col("p_name"))))
    eq = lambda n: (a(n) == F.col(n)).cast("double")
    far = F.greatest(F.lit(0.0), 1 - F.abs(a("p_retailprice") - F.col("p_retailprice")) / 1000)
    score = 1.5 * eq("p_type") + 1.5 * eq("p_size") + 1.5 * eq("p_name") + 1.5 * text.levenshtein_similarity(a("p_name"), F.col("p_name")) + 1.5 * overlap + 0.5 + 0.5 + 0.5 * far
    scored = c.select(a("p_partkey").alias("target"), F.col("p_partkey").alias("candidate"), F.round(score / 9, 4).alias("score"))
    best = scored.groupBy("target").agg(F.max_by("candidate", F.struct("score", -F.col("candidate"))).alias("best"), F.max("score").alias("score"))
    return best.filter("score >= 0.5")


@query(
    "best_text_box",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_size FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT *, round(1 - levenshtein(p_name, 'red widget')::DOUBLE / greatest(length(p_name), 10), 4) AS sim FROM b),
    r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY sim DESC, l_linenumber, l_partkey) = 1)
    SELECT l_orderkey, l_partkey, sim, sim >= 0.8 AND p_size >= 10 AS passes FROM r""",
)
def best_text_box(spark, d):
    """Of an image's text boxes the one most like the target, the first of equals."""
    b = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    s = b.select("l_orderkey", "l_linenumber", "l_partkey", "p_size", text.levenshtein_similarity(F.col("p_name"), F.lit("red widget")).alias("sim"))
    r = merge.latest(s, ["l_orderkey"], [F.desc("sim"), F.asc("l_linenumber"), F.asc("l_partkey")])
    return r.select("l_orderkey", "l_partkey", "sim", ((F.col("sim") >= 0.8) & (F.col("p_size") >= 10)).alias("passes"))


@query("synonym_enrichment", "SELECT p_brand, array_to_string(list_sort(list_distinct([p_brand, p_brand || ' co'] || list(DISTINCT p_type))), ',') AS synonyms FROM part GROUP BY p_brand")
def synonym_enrichment(spark, d):
    """Given and found synonyms of a brand, each once."""
    n = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("found"))
    given = F.array(F.col("p_brand"), F.concat(F.col("p_brand"), F.lit(" co")))
    return n.select("p_brand", F.array_join(F.array_sort(F.array_distinct(F.concat(given, "found"))), ",").alias("synonyms"))


@query(
    "golden_records",
    """WITH r AS (SELECT p_name, p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_name ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_size DESC, p_partkey) AS n FROM part), m AS (SELECT p_name, count(*) AS n_members, min(p_partkey) AS first_member FROM part GROUP BY 1)
    SELECT r.p_name, p_partkey, p_brand, n_members, first_member FROM r JOIN m ON r.p_name = m.p_name WHERE n = 1""",
)
def golden_records(spark, d):
    """The record that survives: by source, completeness and then key."""
    source = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2)
    return matching.golden_records(table(spark, d, "part"), "p_name", "p_partkey", [source, F.desc("p_size"), F.asc("p_partkey")], ["p_partkey", "p_brand"])


@query(
    "modularity",
    """WITH e AS (SELECT s_suppkey AS u, (s_suppkey * 7 + 1) % (SELECT count(*) FROM supplier) AS v, 1.0::DOUBLE AS w FROM supplier), c AS (SELECT s_suppkey AS node, s_nationkey AS community FROM supplier),
    j AS (SELECT e.w, a.community AS cu, b.community AS cv FROM e JOIN c a ON u = a.node JOIN c b ON v = b.node), i AS (SELECT cu AS c, sum(w) AS w_in FROM j WHERE cu = cv GROUP BY 1), t AS (SELECT c, sum(w) AS w_tot FROM (SELECT cu AS c, w FROM j UNION ALL SELECT cv, w FROM j) GROUP BY 1)
    SELECT round(sum(coalesce(w_in, 0) / m - pow(w_tot / (2 * m), 2)), 4) AS q FROM t LEFT JOIN i ON t.c = i.c, (SELECT sum(w) AS m FROM e)""",
)
def modularity(spark, d):
    s = table(spark, d, "supplier")
    n = s.agg(F.count("*").alias("n"))
    edges = s.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("u"), ((F.col("s_suppkey") * 7 + 1) % F.col("n")).alias("v"), F.lit(1.0).alias("w"))
    return matching.modularity(edges, s.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community")))


@query(
    "rocchio_drift",
    """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), m AS (SELECT vec_id, [q[i] - 0.45::DOUBLE * embedding[i]::DOUBLE FOR i IN range(1, 65)] AS v FROM embeddings, q WHERE vec_id > 0)
    SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first_component, 1.0::DOUBLE AS length FROM m""",
)
def rocchio_drift(spark, d):
    """The query moved away from each rejected vector, at unit length."""
    e = table(spark, d, "embeddings")
    one = e.filter("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))
    moved = e.filter("vec_id > 0").crossJoin(F.broadcast(one)).select("vec_id", vectors.rocchio(F.col("q"), F.col("embedding")).alias("v"))
    return moved.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first_component"), F.round(vectors.norm(F.col("v")), 4).alias("length"))


@query(
    "product_quantization",
    """WITH b AS (SELECT vec_id AS i, embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 16), p AS (SELECT v.vec_id, j, arg_min(b.i, (round(list_sum([pow(v.embedding[16 * j + k]::DOUBLE - b.e[16 * j + k], 2) FOR k IN range(1, 17)]), 12), b.i)) AS code FROM embeddings v, b, range(0, 4) t(j) GROUP BY ALL)
    SELECT vec_id, string_agg(code::VARCHAR, ',' ORDER BY j) AS codes, 16.0::DOUBLE AS ratio FROM p GROUP BY vec_id""",
)
def product_quantization(spark, d):
    """Codes by the nearest of the first sixteen slices, and the compression 4 D / m, with each code stored as a four-byte integer."""
    e = table(spark, d, "embeddings")
    books = vector_models.codebooks(e, "vec_id", "embedding", 4, 16)
    codes = vector_models.encode(e, "vec_id", "embedding", books)
    return codes.select("vec_id", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"), F.lit(4.0 * 64 / 16).alias("ratio"))


@query(
    "adc_search",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, e FROM v QUALIFY i < 16), q AS (SELECT e FROM v WHERE vec_id = 20),
    c AS (SELECT v.vec_id, j, arg_min(b.i, (round(list_sum([pow(v.e[16 * j + k] - b.e[16 * j + k], 2) FOR k IN range(1, 17)]), 12), b.i)) AS code FROM v, b, range(0, 4) t(j) GROUP BY ALL)
    SELECT c.vec_id, round(sqrt(sum(list_sum([pow(b.e[16 * j + k] - q.e[16 * j + k], 2) FOR k IN range(1, 17)]))), 4) AS distance FROM c JOIN b ON b.i = c.code, q GROUP BY c.vec_id ORDER BY distance, vec_id LIMIT 10""",
)
def adc_search(spark, d):
    """Distances of one vector to the coded ones, the nearest ten."""
    e = table(spark, d, "embeddings")
    books = vector_models.codebooks(e, "vec_id", "embedding", 4, 16)
    q = e.filter("vec_id = 20").first()["embedding"]
    return vector_models.adc_distances(vector_models.encode(e, "vec_id", "embedding", books), q, books).orderBy("distance", "vec_id").limit(10).select("vec_id", "distance")


@query("procrustes_alignment", None)
def procrustes_alignment(spark, d):
    """The rotation between two halves of the vectors, and what is left of each after it."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    q = vector_models.alignment(e, "x", "y", 32)
    left = vectors.squared_distance(vector_models.apply_matrix(F.col("x"), q), F.col("y"))
    return e.select("vec_id", F.round(F.sqrt(left), 4).alias("error"))


@query("logistic_recalibration", None)
def logistic_recalibration(spark, d):
    """Weights learned from labelled texts, and the probability of each."""
    t = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("symbols"))
    rows = t.join(table(spark, d, "labels"), "doc_id")
    fit = vector_models.logistic_fit(rows, ["n", "symbols"], "quality")
    if fit is None:
        return rows.select("doc_id", F.lit(0.5).alias("p"))
    weights, bias, means, scales = fit
    return rows.select("doc_id", F.round(scoring.sigmoid_probability([F.col("n"), F.col("symbols")], means, scales, weights, bias), 3).alias("p"))


_HEALTH = """e AS (SELECT user_id, event_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""


@query(
    "health_fold",
    f"""WITH RECURSIVE {_HEALTH}, h AS (SELECT user_id, event_id, n, greatest(0, least(100, 100 + CASE WHEN ok THEN 5 ELSE -20 END))::DOUBLE AS health FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.event_id, e.n, greatest(0, least(100, h.health + CASE WHEN e.ok THEN 5 ELSE -20 END))::DOUBLE FROM h JOIN e ON e.user_id = h.user_id AND e.n = h.n + 1)
    SELECT user_id, event_id, health FROM h""",
)
def health_fold(spark, d):
    """Health of a node after each event, clamped to 0..100."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    step = lambda s, r: ((h := stateful.health_step(s, r["event_type"] != "error")), (h,))
    return stateful.fold(e, "user_id", ["ts", "event_id"], 100.0, step, ["event_id"], "health double")


@query(
    "rate_fold",
    f"""WITH RECURSIVE {_HEALTH}, h AS (SELECT user_id, event_id, n, CASE WHEN ok THEN least(8.0, 1.0 + 0.25) ELSE greatest(0.5, 1.0 * 0.6) END::DOUBLE AS rate FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.ok THEN least(8.0::DOUBLE, h.rate + 0.25::DOUBLE) ELSE greatest(0.5::DOUBLE, h.rate * 0.6::DOUBLE) END FROM h JOIN e ON e.user_id = h.user_id AND e.n = h.n + 1)
    SELECT user_id, event_id, round(rate, 6) AS rate FROM h""",
)
def rate_fold(spark, d):
    """Request rate after each event: up by a quarter, down by 0.6."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    step = lambda s, r: ((x := stateful.rate_step(s, r["event_type"] != "error")), (x,))
    return stateful.fold(e, "user_id", ["ts", "event_id"], 1.0, step, ["event_id"], "rate double").withColumn("rate", F.round("rate", 6))


@query(
    "breaker_fold",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type NOT IN ('error', 'signup') AS ok, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    b AS (SELECT user_id, event_id, n, 'CLOSED' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failures, 0::DOUBLE AS opened FROM e WHERE n = 1
      UNION ALL SELECT user_id, event_id, n, CASE WHEN mode = 'OPEN' THEN mode WHEN ok THEN 'CLOSED' WHEN mode = 'HALF_OPEN' OR failures + 1 >= 2 THEN 'OPEN' ELSE mode END,
        CASE WHEN mode = 'OPEN' THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN mode <> 'OPEN' AND NOT ok AND (mode = 'HALF_OPEN' OR failures + 1 >= 2) THEN tm ELSE opened END
      FROM (SELECT e.*, b.failures, b.opened, CASE WHEN b.state = 'OPEN' AND e.tm - b.opened >= 86400 THEN 'HALF_OPEN' ELSE b.state END AS mode FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1))
    SELECT user_id, event_id, state, failures FROM b""",
)
def breaker_fold(spark, d):
    """State of each user's circuit breaker after each event."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    step = lambda s, r: ((x := stateful.breaker_step(s, r["event_type"] not in ("error", "signup"), r["at"], 2, 86400.0)), (x[0], x[1]))
    return stateful.fold(e, "user_id", ["ts", "event_id"], ("CLOSED", 0, 0.0), step, ["event_id"], "state string, failures int")


@query(
    "router_fold",
    """WITH RECURSIVE e AS (SELECT user_id % 10 AS router, event_id, user_id % 3 AS p, event_type NOT IN ('error', 'signup') AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT router, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS p, NULL::DOUBLE AS hp, [NULL, NULL, NULL]::DOUBLE[] AS h, [0, 0, 0]::INT[] AS f, NULL::BIGINT AS cur FROM (SELECT DISTINCT router FROM e)
      UNION ALL SELECT router, n, event_id, p, h[p + 1], h, f, CASE WHEN len(able) > 0 AND (cur IS NULL OR h[cur + 1] IS NOT NULL AND (f[cur + 1] >= 2 OR h[cur + 1] < 30) OR h[best + 1] > coalesce(h[cur + 1], 0) + 15) THEN best ELSE cur END
      FROM (SELECT *, list_sort([{'a': -h[i + 1], 'b': i} FOR i IN able])[1].b AS best FROM (SELECT *, [i FOR i IN [0, 1, 2]::BIGINT[] IF h[i + 1] IS NOT NULL AND f[i + 1] < 2 AND h[i + 1] >= 30] AS able FROM (
        SELECT e.router, e.n, e.event_id, e.p, s.cur,
          [CASE WHEN i <> e.p THEN s.h[i + 1] WHEN e.ok THEN least(100, coalesce(s.h[i + 1], 100) + 5) ELSE greatest(0, coalesce(s.h[i + 1], 100) - 20) END FOR i IN [0, 1, 2]::BIGINT[]]::DOUBLE[] AS h,
          [CASE WHEN i <> e.p THEN s.f[i + 1] WHEN e.ok THEN 0 ELSE s.f[i + 1] + 1 END FOR i IN [0, 1, 2]::BIGINT[]]::INT[] AS f
        FROM s JOIN e ON e.router = s.router AND e.n = s.n + 1))))
    SELECT router, event_id, hp AS health, coalesce(cur, -1)::INT AS current FROM s WHERE n > 0""",
)
def router_fold(spark, d):
    """The provider that each event type's router uses after each event."""
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("router"), "event_id", "event_type", "ts", (F.col("user_id") % 3).alias("provider"))

    def step(s, r):
        s = stateful.router_step(s, r["provider"], r["event_type"] not in ("error", "signup"))
        return s, (float(s[0][r["provider"]]), -1 if s[2] is None else int(s[2]))

    return stateful.fold(e, "router", ["ts", "event_id"], ({}, {}, None), step, ["event_id"], "health double, current int")


@query(
    "failure_runs",
    """WITH e AS (SELECT user_id, event_id, ts, event_type IN ('error', 'signup') AS failed, count(*) FILTER (event_type NOT IN ('error', 'signup')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
    SELECT user_id, event_id, CASE WHEN failed THEN count(*) FILTER (failed) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) ELSE 0 END AS run FROM e""",
)
def failure_runs(spark, d):
    """Failures in a row at each event: islands between successes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    failed = F.col("event_type").isin("error", "signup")
    e = table(spark, d, "events").select("user_id", "event_id", "ts", failed.alias("failed"), F.sum((~failed).cast("bigint")).over(w).alias("g"))
    v = Window.partitionBy("user_id", "g").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("user_id", "event_id", F.when(F.col("failed"), F.sum(F.col("failed").cast("bigint")).over(v)).otherwise(0).cast("bigint").alias("run"))
