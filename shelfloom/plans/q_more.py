"""Composite queries, lookups, predicates and image gates over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.functions import images, scoring, text, vectors
from shelfloom.operators import catalog, matching, merge, ranking, search
from shelfloom.plans.registry import query
from shelfloom.sources import sinks
from shelfloom.sources.tables import table


_DRAWN = "CASE WHEN p_type LIKE '%PROMO%' THEN 'vector art of ' WHEN p_size > 47 THEN 'start of ' ELSE '' END"
_HOST = "CASE WHEN p_size = 13 THEN 'i.pinimg.com' WHEN p_size = 14 THEN 'shop.example.ae' ELSE 'cdn.example.com' END"
_REASON = """CASE WHEN c.width < 300 OR c.height < 300 THEN 'smaller than 300x300: ' || c.width || 'x' || c.height WHEN contains(c.title, 'vector art') THEN 'excluded word: vector' WHEN contains(c.url, 'i.pinimg.com') THEN 'excluded domain: i.pinimg.com'
      WHEN contains(c.title, lower(p.rival)) THEN 'competitor: ' || lower(p.rival) WHEN greatest(p.ml, c.ml) > 1.2 * least(p.ml, c.ml) THEN 'another size or pack' END"""


@query(
    "product_search",
    f"""WITH i AS (SELECT p_name, p_partkey AS k, p_brand, {_DRAWN} || lower(p_brand) || ' ' || p_name || ' ' || p_size * 10 || 'ml' AS title, 'https://' || {_HOST} || '/' || p_partkey || '.jpg' AS url, p_size * 30 AS width, p_size * 25 AS height, p_size * 10 AS ml, p_partkey % 4 AS engine FROM part),
    p AS (SELECT p_partkey AS product, p_name, p_brand, p_size * 10 AS ml, 'Brand#' || (substr(p_brand, 7)::INT % 25 + 1) AS rival FROM (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS n FROM part) WHERE n = 1),
    r AS (SELECT p.product, p.p_brand, p.rival, p.ml AS p_ml, c.* EXCLUDE (p_brand, p_name), row_number() OVER (PARTITION BY p.product, c.engine ORDER BY c.k) AS rank FROM p JOIN i c ON c.p_name = p.p_name),
    c AS (SELECT * FROM r WHERE rank <= 15),
    t AS (SELECT c.product, c.k, c.engine, c.rank, {_REASON.replace("p.rival", "c.rival").replace("p.ml", "c.p_ml")} AS reason, contains(c.title, lower(c.p_brand)) AS brand, contains(c.title, c.p_ml || 'ml') AS sized, c.width * c.height AS resolution FROM c)
    SELECT product, k AS candidate, engine, rank::INT AS rank, reason, brand AS has_brand, row_number() OVER (PARTITION BY product ORDER BY reason IS NOT NULL, CASE WHEN reason IS NULL THEN 15 * brand::INT + 3 * sized::INT ELSE 0 END DESC, resolution DESC, k)::INT AS place FROM t""",
)
def product_search(spark, d):
    """Search of each product: its brand as typed is aligned to the vocabulary, engines give lists, the filter chain judges every candidate, and the best is in place 1.

    A product is the first record of a name and brand; an image is a record of the
    same name. Rejected candidates stay in the trail, behind the others.
    """
    part = table(spark, d, "part")
    k, size, brand = F.col("p_partkey"), F.col("p_size"), F.col("p_brand")
    drawn = F.when(F.col("p_type").contains("PROMO"), "vector art of ").when(size > 47, "start of ").otherwise("")
    host = F.when(size == 13, "i.pinimg.com").when(size == 14, "shop.example.ae").otherwise("cdn.example.com")
    # a list of an engine is the same for all products of a name: it is ranked and cut before it meets them
    listed = ranking.with_rank(part.withColumn("engine", k % 4), [F.asc("p_partkey")], ["p_name", "engine"]).filter(F.col("rank") <= catalog.MOST_CANDIDATES)
    images_of = listed.select(
        "p_name", "engine", "rank", k.alias("candidate"), F.concat(drawn, F.lower(brand), F.lit(" "), F.col("p_name"), F.lit(" "), (size * 10).cast("string"), F.lit("ml")).alias("title"),
        F.concat(F.lit("https://"), host, F.lit("/"), k.cast("string"), F.lit(".jpg")).alias("url"), (size * 30).alias("width"), (size * 25).alias("height"),
    )
    typed = F.when(k % 3 == 0, F.upper(brand)).when(k % 3 == 1, F.concat(F.lit("Brnd"), F.expr("substring(p_brand, 6)"))).otherwise(brand)
    first = part.groupBy("p_name", "p_brand").agg(F.min_by("p_size", "p_partkey").alias("p_size"), F.min("p_partkey").alias("p_partkey"))
    brands = [f"Brand#{i}" for i in range(1, 26)]
    rival = F.concat(F.lit("Brand#"), (F.expr("substring(brand, 7)").cast("int") % 25 + 1).cast("string"))
    products = first.select("p_name", k.alias("product_key"), matching.closest_word(typed, brands).alias("brand"), size.alias("size"))
    products = products.select("p_name", "product_key", "brand", F.concat(F.col("p_name"), F.lit(" "), (F.col("size") * 10).cast("string"), F.lit("ml")).alias("product"), F.array(rival).alias("competitors"), F.array(F.lower("brand")).alias("synonyms"))
    trail = catalog.candidate_trail(images_of.join(products, "p_name"))
    placed = ranking.with_rank(trail, catalog.trail_order(F.asc("candidate")), ["product_key"], name="place")
    return placed.select(F.col("product_key").alias("product"), "candidate", "engine", "rank", F.col("reject_reason").alias("reason"), "has_brand", "place")


@query(
    "search_end_to_end",
    f"""WITH v AS (SELECT p_brand AS brand, min(p_partkey) AS place FROM part GROUP BY 1),
    t AS (SELECT p_name, p_brand, min(p_partkey) AS k, arg_min(p_size, p_partkey) AS p_size FROM part GROUP BY ALL),
    p AS (SELECT k, p_name || CASE WHEN k % 4 = 2 THEN ' ' || p_brand ELSE '' END || ' ' || (p_size * 10) || 'ml (new)' AS name, p_name || CASE WHEN k % 4 = 2 THEN ' ' || lower(p_brand) ELSE '' END AS title,
      CASE k % 4 WHEN 0 THEN upper(p_brand) WHEN 1 THEN 'Brnd' || p_brand[6:] END AS typed, p_size * 10 AS ml, 'Brand#' || (p_brand[7:]::INT % 25 + 1) AS rival FROM t),
    y AS (SELECT k, arg_min(brand, (levenshtein(lower(typed), lower(brand)), place)) AS near FROM p, v WHERE levenshtein(lower(typed), lower(brand)) <= 0.15 * greatest(length(typed), length(brand)) + 1e-9 GROUP BY k),
    h AS (SELECT k, arg_min(brand, place) AS held FROM p, v WHERE contains(lower(name), lower(brand)) GROUP BY k),
    b AS (SELECT p.*, coalesce(near, typed, held, string_split(name, ' ')[1]) AS brand, CASE WHEN typed IS NOT NULL THEN 'typed' WHEN held IS NOT NULL THEN 'name' ELSE 'start' END AS brand_from FROM p LEFT JOIN y USING (k) LEFT JOIN h USING (k)),
    u AS (SELECT *, trim(regexp_replace(replace(title, lower(brand), ''), '\\s+', ' ', 'g')) AS bare FROM b),
    s AS (SELECT *, [trim(lower(brand) || ' ' || bare), bare, title || ' product'] AS qs FROM u),
    q AS (SELECT k, qs[i] AS query, i AS step FROM s, range(1, 4) r(i)),
    i AS (SELECT p_partkey AS candidate, p_partkey % 4 AS engine, CASE p_partkey % 4 WHEN 0 THEN lower(p_brand) || ' ' || p_name WHEN 3 THEN p_name || ' product' ELSE p_name END AS query, {_DRAWN} || lower(p_brand) || ' ' || p_name || ' ' || p_size * 10 || 'ml' AS title, 'https://' || {_HOST} || '/' || p_partkey || '.jpg' AS url, p_size * 30 AS width, p_size * 25 AS height, p_size * 10 AS ml FROM part),
    l AS (SELECT *, row_number() OVER (PARTITION BY engine, query ORDER BY candidate) AS rank FROM i QUALIFY rank <= 15),
    x AS (SELECT q.k, q.step, l.* FROM q JOIN l ON l.query = q.query QUALIFY step = min(step) OVER (PARTITION BY q.k, engine)),
    f AS (SELECT k, candidate, round(sum(CASE WHEN engine = 0 THEN 2.0::DOUBLE ELSE 1 END / (60 + rank)), 6) AS score, count(DISTINCT engine) AS n_engines, arg_min(query, step) AS query FROM x GROUP BY ALL),
    c AS (SELECT f.*, s.brand, s.brand_from, s.rival, s.name, s.ml AS p_ml, i.title, i.url, i.width, i.height, i.ml FROM f JOIN s ON s.k = f.k JOIN i ON i.candidate = f.candidate),
    j AS (SELECT c.*, {_REASON.replace("p.rival", "c.rival").replace("p.ml", "c.p_ml")} AS reason, contains(title, lower(brand)) OR contains(url, lower(brand)) AS has_brand,
      (list_sum([3 * (contains(url, w)::INT + contains(title, w)::INT) FOR w IN string_split(lower(name), ' ') IF length(w) > 1]) + 15 * (contains(title, lower(brand)) OR contains(url, lower(brand)))::INT)::INT AS points FROM c)
    SELECT k AS product_key, brand, brand_from, candidate, query, n_engines, score, reason AS reject_reason, has_brand, CASE WHEN reason IS NULL THEN points ELSE 0 END AS relevance,
      row_number() OVER (PARTITION BY k ORDER BY reason IS NOT NULL, CASE WHEN reason IS NULL THEN points ELSE 0 END DESC, score DESC, width * height DESC, candidate)::INT AS place FROM j""",
)
def search_end_to_end(spark, d):
    """Search of each product from its name as typed: brand corrected, found in the name or guessed, title cleaned, queries in sequence, four engines fused, candidates judged and placed."""
    part = table(spark, d, "part")
    k, size, brand = F.col("p_partkey"), F.col("p_size"), F.col("p_brand")
    drawn = F.when(F.col("p_type").contains("PROMO"), "vector art of ").when(size > 47, "start of ").otherwise("")
    host = F.when(size == 13, "i.pinimg.com").when(size == 14, "shop.example.ae").otherwise("cdn.example.com")
    asked = F.when(k % 4 == 0, F.concat_ws(" ", F.lower(brand), "p_name")).when(k % 4 == 3, F.concat(F.col("p_name"), F.lit(" product"))).otherwise(F.col("p_name"))
    images_of = part.select(
        k.alias("candidate"), (k % 4).alias("engine"), asked.alias("query"), F.concat(drawn, F.lower(brand), F.lit(" "), F.col("p_name"), F.lit(" "), (size * 10).cast("string"), F.lit("ml")).alias("title"),
        F.concat(F.lit("https://"), host, F.lit("/"), k.cast("string"), F.lit(".jpg")).alias("url"), (size * 30).alias("width"), (size * 25).alias("height"),
    )
    results = ranking.with_rank(images_of, [F.asc("candidate")], ["engine", "query"])
    first = part.groupBy("p_name", "p_brand").agg(F.min_by("p_size", "p_partkey").alias("p_size"), F.min("p_partkey").alias("p_partkey"))
    more = F.when(k % 4 == 2, F.concat(F.lit(" "), brand)).otherwise("")
    products = first.select(
        k.alias("product_key"), F.concat("p_name", more, F.lit(" "), (size * 10).cast("string"), F.lit("ml (new)")).alias("name"),
        F.when(k % 4 == 0, F.upper(brand)).when(k % 4 == 1, F.concat(F.lit("Brnd"), F.substring("p_brand", 6, 9))).alias("brand"),
        F.array(F.concat(F.lit("Brand#"), (F.substring("p_brand", 7, 9).cast("int") % 25 + 1).cast("string"))).alias("competitors"),
    )
    vocabulary = part.groupBy(brand.alias("brand"), F.array(brand).alias("synonyms")).agg(F.min(k).alias("order"))
    return search.search(products, results, vocabulary, {"0": 2.0})


@query("candidates_by_key", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_orderkey = 7 ORDER BY l_extendedprice DESC, l_partkey")
def candidates_by_key(spark, d):
    """The candidates of one row, best first; the key reaches the scan."""
    return table(spark, d, "lineitem").filter("l_orderkey = 7").select("l_orderkey", "l_partkey", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_partkey")


@query("cache_lookup", "SELECT p_partkey, p_name AS cached FROM part WHERE p_partkey = 42 AND p_size > 0")
def cache_lookup(spark, d):
    return table(spark, d, "part").filter("p_partkey = 42 and p_size > 0").select("p_partkey", F.col("p_name").alias("cached"))


@query("ttl_cache", "SELECT event_id, value FROM events WHERE event_type = 'view' AND ts > (SELECT max(ts) FROM events) - INTERVAL 3600 SECOND * 12")
def ttl_cache(spark, d):
    """Entries that are fresh at the time of the newest."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).filter((F.col("event_type") == "view") & (F.col("ts") > F.col("now") - F.expr("interval 43200 seconds"))).select("event_id", "value")


@query("ordered_listing", "SELECT event_id, ts::VARCHAR AS failed_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def ordered_listing(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "ts")
    return ranking.top(e, [F.desc("ts"), F.asc("event_id")], 50).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("failed_at")).withColumn("failed_at", F.regexp_replace("failed_at", r"\.?0+$", ""))


@query("status_update", "SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_acctbal IS NULL THEN o_orderstatus ELSE 'completed' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 = 0")
def status_update(spark, d):
    """Statuses set by a decision, where there is one."""
    done = table(spark, d, "customer").filter("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_acctbal") < 0, "failed").otherwise("completed").alias("new"))
    j = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(done, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", F.coalesce("new", "o_orderstatus").alias("status"))


@query("table_copy", "SELECT kind, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderstatus || o_orderpriority) AS labels FROM orders, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) k(kind) GROUP BY kind")
def table_copy(spark, d):
    """A table written in each format and read again, by its sums."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    copies = [sinks.write(rows, sinks.folder(spark, kind), kind).withColumn("kind", F.lit(kind)) for kind in ("parquet", "orc", "json", "csv")]
    sums = (F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.countDistinct(F.concat("o_orderstatus", "o_orderpriority")).alias("labels"))
    return reduce(DataFrame.unionByName, copies).groupBy("kind").agg(*sums)


@query("feedback_append", "SELECT l_orderkey, l_linenumber, l_partkey, '[\"' || l_returnflag || '\",\"' || l_linestatus || '\"]' AS reasons FROM lineitem WHERE l_quantity > 48")
def feedback_append(spark, d):
    """Feedback rows with their reasons as a JSON array, appended to what is there in two batches and read back."""
    rows = table(spark, d, "lineitem").filter("l_quantity > 48").select("l_orderkey", "l_linenumber", "l_partkey", F.to_json(F.array("l_returnflag", "l_linestatus")).alias("reasons"))
    path = sinks.folder(spark, "feedback")
    sinks.append(rows.filter("l_quantity <= 49"), path, "json")
    return sinks.append(rows.filter("l_quantity > 49"), path, "json")


@query("subset_tests", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('red', 'ring', 'bolt', 'old'))) = 0 AS inside, contains(' ' || p_name || ' ', ' ring ') AS around FROM part".replace("len(list_filter(string_split(p_name, ' '), lambda x: x NOT IN ('red', 'ring', 'bolt', 'old'))) = 0", "len([x FOR x IN string_split(p_name, ' ') IF x NOT IN ('red', 'ring', 'bolt', 'old')]) = 0"))
def subset_tests(spark, d):
    """Whether a name's words are within a set, and hold one."""
    known, ring, words = F.array(*[F.lit(w) for w in ("red", "ring", "bolt", "old")]), F.array(F.lit("ring")), F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", (F.size(F.array_except(words, known)) == 0).alias("inside"), (F.size(F.array_except(ring, words)) == 0).alias("around"))


@query("proxy_request", "SELECT page_id, 'https://10.0.0.' || (page_id % 250) || '/p/' || page_id AS pinned, 'host' || (page_id % 9) || '.example' AS host FROM pages")
def proxy_request(spark, d):
    """A URL with its host replaced by a pinned address, and the host for the header."""
    n = F.col("page_id").cast("string")
    url = F.concat(F.lit("https://host"), (F.col("page_id") % 9).cast("string"), F.lit(".example/p/"), n)
    rows = table(spark, d, "pages").select("page_id", url.alias("url"), F.concat(F.lit("10.0.0."), (F.col("page_id") % 250).cast("string")).alias("ip"))
    return rows.select("page_id", F.concat(F.parse_url("url", F.lit("PROTOCOL")), F.lit("://"), F.col("ip"), F.parse_url("url", F.lit("PATH"))).alias("pinned"), F.parse_url("url", F.lit("HOST")).alias("host"))


_KNOWN = "['lays', 'nestle', 'dove', 'kitkat']"


@query(
    "caption_conflict",
    f"""WITH t AS (SELECT p_partkey, {_KNOWN}[(p_size % 4)::INT + 1] AS brand, 'a pack of ' || {_KNOWN}[(p_partkey % 4)::INT + 1] || CASE WHEN p_name LIKE '%ring%' THEN ' zero' ELSE '' END AS caption, p_name || CASE WHEN p_type LIKE '%PROMO%' THEN ' diet' ELSE '' END AS title FROM part)
    SELECT p_partkey, NOT (brand <> 'kitkat' AND ((contains(caption, 'lays') AND brand <> 'lays') OR (contains(caption, 'nestle') AND brand <> 'nestle') OR (contains(caption, 'dove') AND brand <> 'dove'))) AS caption_agrees,
      NOT (contains(caption, 'nestle') AND brand <> 'nestle') AND contains(caption, 'zero') = contains(title, 'diet') AS package_agrees FROM t""",
)
def caption_conflict(spark, d):
    """A competitor in the caption, or in the words on the package, and a variant without sugar in only one of package and title."""
    known = F.array(*[F.lit(w) for w in ("lays", "nestle", "dove", "kitkat")])
    brand, seen = F.element_at(known, (F.col("p_size") % 4).cast("int") + 1), F.element_at(known, (F.col("p_partkey") % 4).cast("int") + 1)
    caption = F.concat(F.lit("a pack of "), seen, F.when(F.col("p_name").contains("ring"), " zero").otherwise(""))
    title = F.concat(F.col("p_name"), F.when(F.col("p_type").contains("PROMO"), " diet").otherwise(""))
    return table(spark, d, "part").select("p_partkey", text.caption_agrees(caption, brand).alias("caption_agrees"), text.variant_agrees(F.split(caption, " "), title, brand).alias("package_agrees"))


@query("back_projection", "SELECT p_partkey, round((p_size * 10 - 320) * 2.0::DOUBLE / 525, 2) AS x, round((p_size * 5 - 240) * 2.0::DOUBLE / 525, 2) AS y, 2.0::DOUBLE AS z FROM part")
def back_projection(spark, d):
    p = scoring.back_projection(F.col("p_size") * 10, F.col("p_size") * 5, F.lit(2.0))
    return table(spark, d, "part").select("p_partkey", p.alias("p")).select("p_partkey", "p.x", "p.y", "p.z")


def _pictures(spark, d):
    """Small images made of the vectors: 16 x 16 pixels of three channels, of all 64 components."""
    level = lambda x: F.chr((F.abs(x) * 1000 % 94 + 33).cast("int"))
    line = F.array_join(F.transform("embedding", level), "")
    return table(spark, d, "embeddings").select("vec_id", F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit(3).alias("channels"), F.encode(F.repeat(line, 12), "US-ASCII").alias("pixels"))


@query("unified_quality_score", None)
def unified_quality_score(spark, d):
    """Gates and weighted score of measured images; tests hold the formula against examples."""
    m = images.measure(_pictures(spark, d), "vec_id", ["sharpness", "mean_level", "bright_level", "burnt_share", "contrast", "blockiness", "fill", "perimeter_purity"], images.AUDIT)
    side = F.lit(640)
    failed = catalog.quality_gates(side, side, F.col("sharpness"), F.col("mean_level"), F.col("bright_level"), F.col("burnt_share"), F.col("contrast"), F.col("blockiness"))
    m = m.withColumn("failed", failed)
    s = catalog.unified_quality(side, side, F.col("sharpness"), F.col("perimeter_purity"), F.col("fill"), F.lit(20.0), F.col("blockiness"), F.size("failed") == 0)
    return m.select("vec_id", F.array_join("failed", ",").alias("failed"), s.alias("s")).select("vec_id", "failed", "s.score", "s.approved")


@query(
    "composite_image_score",
    """SELECT p_partkey, round(0.4::DOUBLE * greatest(0, least(1, (1 + p_size % 10 - 1) / 9.0::DOUBLE)) + 0.2::DOUBLE * greatest(0, least(1, log10(1 + p_partkey) / 4)) + 0.2::DOUBLE * greatest(0, least(1, p_size * 100 / 3840.0::DOUBLE)) + 0.2::DOUBLE * greatest(0, least(1, p_size / 50.0::DOUBLE)), 4) AS score FROM part""",
)
def composite_image_score(spark, d):
    s = scoring.composite_score(1 + F.col("p_size") % 10, F.col("p_partkey"), F.col("p_size") * 100, F.col("p_size") / 50.0)
    return table(spark, d, "part").select("p_partkey", s.alias("score"))


@query(
    "visual_audit_decision",
    """WITH o AS (SELECT o_orderkey, o_custkey % 40 * 40 AS w, 300 + o_orderkey % 9 * 60 AS h, CASE WHEN o_orderpriority LIKE '1%' THEN 'water 6 x 500' WHEN o_orderpriority LIKE '2%' THEN 'juice box' ELSE 'juice' END AS q,
      CASE WHEN o_orderstatus = 'F' THEN 0.96 WHEN o_orderstatus = 'O' THEN 0.92 ELSE 0.15 END::DOUBLE AS share, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.3 END::DOUBLE AS cdn, CASE WHEN o_orderpriority LIKE '3%' THEN 0.6 ELSE 1.0 END::DOUBLE AS full_ FROM orders),
    f AS (SELECT *, w >= 300 AND h >= 300 AND w / h::DOUBLE BETWEEN 0.5 AND 2.0 AS fits, w / h::DOUBLE AS ar, q <> 'juice' AS multi, round(0.4::DOUBLE * share + 0.4::DOUBLE * full_ + 0.2::DOUBLE * cdn, 3) AS authority FROM o),
    m AS (SELECT *, CASE WHEN multi AND NOT ar BETWEEN 0.85 AND 1.25 THEN 0.02 WHEN NOT multi AND ar BETWEEN 0.85 AND 1.25 THEN 0.05 WHEN multi THEN 1.7 ELSE 1.0 END::DOUBLE AS matching FROM f)
    SELECT o_orderkey, CASE WHEN fits AND matching * 0.6::DOUBLE + authority * 0.4::DOUBLE >= 0.65 THEN 'ACCEPT' ELSE 'REJECT' END AS decision, CASE WHEN fits THEN round(matching, 2) END AS matching, CASE WHEN fits THEN authority END AS authority, CASE WHEN fits THEN round(matching * 0.6::DOUBLE + authority * 0.4::DOUBLE, 2) END AS final FROM m""",
)
def visual_audit_decision(spark, d):
    """Size, intent of the query against the shape of the image, and authority of the merchant."""
    k, p, s = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    q = F.when(p.startswith("1"), "water 6 x 500").when(p.startswith("2"), "juice box").otherwise("juice")
    page = F.when(s == "F", "https://brand.myshopify.com/p").when(s == "O", "https://www.walmart.com/ip/1").otherwise("https://x.example/p")
    image = F.when(s == "F", "https://cdn.shopify.com/a.png").otherwise("https://x.example/a.png")
    audit = catalog.visual_audit(q, F.col("o_custkey") % 40 * 40, 300 + k % 9 * 60, page, image, F.when(p.startswith("3"), 0.6).otherwise(1.0))
    return table(spark, d, "orders").select("o_orderkey", audit.alias("a")).select("o_orderkey", "a.*")


@query("master_image_audit", None)
def master_image_audit(spark, d):
    """Looks and specification of measured images; tests hold the formula against examples."""
    m = images.measure(_pictures(spark, d), "vec_id", ["colourfulness", "sharpness", "packaging", "shadow"], images.AUDIT)
    a = catalog.master_audit(F.col("colourfulness"), F.col("sharpness"), F.col("packaging"), F.col("shadow") == 1, F.col("vec_id") % 2 == 0)
    return m.select("vec_id", F.round("packaging", 4).alias("packaging"), a.alias("a")).select("vec_id", "packaging", "a.*")


@query("background_gates", None)
def background_gates(spark, d):
    """The white-background gates over one image each, and the density of the package; tests hold them against examples."""
    names = [f"{n}_{x}" for n in images.BACKGROUND_GATES for x in ("purity", "passed") if f"{n}_{x}" in images.AUDIT]
    m = images.measure(_pictures(spark, d), "vec_id", [*names, "packaging"], images.AUDIT)
    return m.select("vec_id", *[F.round(n, 4).alias(n) for n in names], F.round("packaging", 4).alias("packaging"), (F.col("packaging") >= 0.45).alias("dense"))


_MASK = """c AS (SELECT vec_id, r, c, floor(abs(embedding[(r * 16 + c) % 64 + 1]::DOUBLE) * 10000 / (1 + r // 4))::BIGINT % 10 < 4 AS dark FROM embeddings, range(0, 16) a(r), range(0, 16) b(c)),
    w AS (SELECT vec_id, r, c FROM c WHERE NOT dark UNION ALL SELECT vec_id, x.r, x.c FROM (SELECT DISTINCT vec_id FROM c), (SELECT r, c FROM range(-1, 17) a(r), range(-1, 17) b(c) WHERE r IN (-1, 16) OR c IN (-1, 16)) x),
    o AS (SELECT vec_id, -1::BIGINT AS r, -1::BIGINT AS c FROM (SELECT DISTINCT vec_id FROM c) UNION SELECT w.vec_id, w.r, w.c FROM o JOIN w ON w.vec_id = o.vec_id AND abs(w.r - o.r) + abs(w.c - o.c) = 1),
    m AS (SELECT c.vec_id, c.r, c.c FROM c LEFT JOIN o ON o.vec_id = c.vec_id AND o.r = c.r AND o.c = c.c WHERE o.r IS NULL),
    l AS (SELECT vec_id, r, c, r * 16 + c AS label FROM m UNION SELECT m.vec_id, m.r, m.c, l.label FROM l JOIN m ON m.vec_id = l.vec_id AND greatest(abs(m.r - l.r), abs(m.c - l.c)) = 1 AND m.r * 16 + m.c > l.label),
    p AS (SELECT vec_id, r, c, min(label) AS label FROM l GROUP BY ALL),
    s AS (SELECT vec_id, label, count(*) AS k FROM (SELECT DISTINCT p.vec_id, p.label, p.r, p.c, p.r - i AS y, p.c - j AS x FROM p, range(0, 2) a(i), range(0, 2) b(j)) GROUP BY vec_id, label, y, x),
    b AS (SELECT vec_id, label, count(*) AS n, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM p GROUP BY ALL),
    a AS (SELECT vec_id, label, sum(CASE k WHEN 4 THEN 1 WHEN 3 THEN 0.5 ELSE 0 END)::DOUBLE AS area FROM s GROUP BY ALL),
    g AS (SELECT vec_id, count(*) AS n_objects, arg_max((r1 - r0 + 1) * (c1 - c0 + 1), (area, -b.label)) AS box FROM b JOIN a USING (vec_id, label) GROUP BY vec_id),
    t AS (SELECT vec_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, avg(r) AS cy, avg(c) AS cx FROM c WHERE dark GROUP BY vec_id)"""


@query(
    "image_objects",
    f"""WITH RECURSIVE {_MASK}
    SELECT e.vec_id, coalesce(n_objects, 0)::BIGINT AS n_objects, round(coalesce(box, 0) / 256.0::DOUBLE, 6) AS largest_fill, round(coalesce((r1 - r0 + 1) * (c1 - c0 + 1), 0) / 256.0::DOUBLE, 6) AS layout_fill,
      round(coalesce(greatest(abs(cx - 8), abs(cy - 8)) / 16, 1)::DOUBLE, 6) AS layout_offset, coalesce(abs(cx - 8) / 16 <= 0.1 AND abs(cy - 8) / 16 <= 0.1, false) AS centred
    FROM embeddings e LEFT JOIN g ON g.vec_id = e.vec_id LEFT JOIN t ON t.vec_id = e.vec_id""",
)
def image_objects(spark, d):
    """Objects of small pictures (dark spots on white, made of the vectors): how many, the box of the largest, the box and the centre of all."""
    level = lambda i: F.floor(F.abs(F.get("embedding", i % 64).cast("double")) * 10000 / (1 + F.floor(i / 64))) % 10 < 4
    line = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.when(level(i), F.lit("28")).otherwise(F.lit("FF")))
    pictures = table(spark, d, "embeddings").select("vec_id", F.lit(16).alias("height"), F.lit(16).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(line, "")).alias("pixels"))
    m = images.measure(pictures, "vec_id", ["n_objects", "largest_fill", "layout_fill", "layout_offset", "layout_centred"], images.AUDIT)
    rounded = [F.round(n, 6).alias(n) for n in ("largest_fill", "layout_fill", "layout_offset")]
    return m.select("vec_id", F.col("n_objects").cast("bigint").alias("n_objects"), *rounded, (F.col("layout_centred") == 1).alias("centred"))


_GOODS = ("Full cream milk", "Orange JUICE 1L", "Hair lotion", "Dish liquid", "Red apples", "Butter cookies with water", "Skin clean")


@query(
    "heuristic_category",
    f"""WITH t AS (SELECT p_partkey, p_name || ' ' || {list(_GOODS)}[(p_size % 7)::INT + 1] AS title FROM part), l AS (SELECT p_partkey, lower(title) AS t FROM t),
    c AS (SELECT p_partkey, CASE WHEN regexp_matches(t, 'milk|egg|eggs|cheese|yogurt|butter') THEN 'Fresh Food > Dairy & Eggs' WHEN regexp_matches(t, 'juice|soda|drink|cola|pepsi|fanta|water') THEN 'Beverages > Soft Drinks & Juices'
      WHEN regexp_matches(t, 'shampoo|hair|soap|cream|lotion|skin') THEN 'Health & Beauty > Skin Care & Soap' WHEN regexp_matches(t, 'clean|detergent|powder|spray|dish|liquid') THEN 'Household > Cleaning Supplies' END AS path FROM l)
    SELECT p_partkey, coalesce(path, 'Fresh Food > Vegetables & Fruits') AS path, CASE WHEN path IS NULL THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence FROM c""",
)
def heuristic_category(spark, d):
    """A category by families of words, with less confidence where none fits."""
    title = F.concat_ws(" ", "p_name", F.element_at(F.array(*[F.lit(g) for g in _GOODS]), (F.col("p_size") % 7).cast("int") + 1))
    return table(spark, d, "part").select("p_partkey", text.lexical_category(title).alias("c")).select("p_partkey", "c.path", "c.confidence")


@query(
    "interactive_re_search",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT [q.e[i] - 0.45::DOUBLE * r.e[i] FOR i IN range(1, 65)] AS m, r.e AS r FROM v q, v r WHERE q.vec_id = 0 AND r.vec_id = 20)
    SELECT vec_id, round(list_dot_product(e, m) / sqrt(list_dot_product(e, e) * list_dot_product(m, m)), 6) AS similarity FROM v, t
    WHERE vec_id <> 20 AND 1 - list_dot_product(e, r) / sqrt(list_dot_product(e, e) * list_dot_product(r, r)) >= 0.15 ORDER BY similarity DESC, vec_id LIMIT 10""",
)
def interactive_re_search(spark, d):
    """A rejection moves the query away, is blacklisted, and the rest is searched again: the nearest ten."""
    e = table(spark, d, "embeddings")
    two = e.filter("vec_id in (0, 20)").groupBy().agg(F.max(F.when(F.col("vec_id") == 0, F.col("embedding"))).alias("q"), F.max(F.when(F.col("vec_id") == 20, F.col("embedding"))).alias("r"))
    moved = e.crossJoin(F.broadcast(two)).filter((F.col("vec_id") != 20) & (vectors.cosine_distance(F.col("embedding"), F.col("r")) >= 0.15))
    s = F.round(vectors.cosine(F.col("embedding"), vectors.rocchio(F.col("q"), F.col("r"))), 6)
    return ranking.top(moved.select("vec_id", s.alias("similarity")), [F.desc("similarity"), F.asc("vec_id")], 10)


@query("rich_product_update", "SELECT p_partkey, p_type AS old_type, CASE WHEN p_partkey % 4 = 0 THEN 'edited' ELSE p_brand END AS brand FROM part")
def rich_product_update(spark, d):
    """Metadata as maps; an edit replaces its keys and leaves the others."""
    rows = table(spark, d, "part").select("p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("m"))
    edits = table(spark, d, "part").filter("p_partkey % 4 = 0").select("p_partkey", F.create_map(F.lit("brand"), F.lit("edited")).alias("n"))
    merged = F.when(F.col("n").isNull(), F.col("m")).otherwise(F.map_concat(F.map_filter("m", lambda k, v: F.try_element_at("n", k).isNull()), F.col("n")))
    return rows.join(edits, "p_partkey", "left").select("p_partkey", merged.alias("m")).select("p_partkey", F.col("m.type").alias("old_type"), F.col("m.brand").alias("brand"))


@query("image_gates", None)
def image_gates(spark, d):
    """Exposure, contrast, blocks, centring, content and the verdict of small images made of the vectors."""
    m = images.measure(_pictures(spark, d), "vec_id", list(images.GATES), images.GATES)
    score = scoring.clamp(0.3 * (1 - F.col("naturalness") / 100) + 0.3 * scoring.clamp(F.col("contrast") / 128) + 0.2 * F.col("centring") + 0.2 * (F.col("aesthetic") - 1) / 9)
    return m.select("vec_id", *[F.round(n, 4).alias(n) for n in images.GATES], F.round(score, 4).alias("score"), F.when(F.col("content") < 0.5, "NO_CONTENT").when(score < 0.35, "REJECT").otherwise("ACCEPT").alias("verdict"))


@query("image_measures", None)
def image_measures(spark, d):
    """Measures of small images made of the vectors."""
    m = images.measure(_pictures(spark, d), "vec_id")
    out = m.withColumn("verdict", images.verdict(F.col("colourfulness"), F.col("sharpness"), F.col("white_border")))
    return out.select("vec_id", *[F.round(n, 4).alias(n) for n in images.MEASURES], "phash", "verdict")


@query("keep_latest_failure", "SELECT barcode, max(event_id) AS event_id FROM (SELECT 'ERR_' || user_id || '_' || replace(event_type || ' x', ' ', '_') AS barcode, event_id FROM events WHERE event_type IN ('error', 'signup')) GROUP BY barcode")
def keep_latest_failure(spark, d):
    """A failure replaces the earlier one of its key, which is made where there is no barcode."""
    key = F.concat(F.lit("ERR_"), F.col("user_id").cast("string"), F.lit("_"), F.translate(F.concat(F.col("event_type"), F.lit(" x")), " ", "_"))
    f = table(spark, d, "events").filter("event_type in ('error', 'signup')").select(key.alias("barcode"), "event_id")
    return merge.latest(f, ["barcode"], [F.desc("event_id")])


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END AS version FROM embeddings")
def vector_upsert(spark, d):
    """New vectors in place of old ones of the same key."""
    old = table(spark, d, "embeddings").select("vec_id", F.lit(0).alias("version"))
    new = table(spark, d, "embeddings").filter("vec_id % 2 = 0").select("vec_id", F.lit(1).alias("version"))
    return merge.upsert(old, new, ["vec_id"], [F.desc("version")])


@query(
    "typed_names_known",
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment[1:3] || c_mktsegment[5:] WHEN 1 THEN lower(c_mktsegment) ELSE 'x' || reverse(c_mktsegment) END AS typed FROM customer), v AS (SELECT DISTINCT c_mktsegment AS w FROM customer),
    k AS (SELECT t.c_custkey, any_value(typed) AS typed, arg_min(w, (levenshtein(lower(typed), lower(w)), w)) FILTER (levenshtein(lower(typed), lower(w))::DOUBLE / greatest(length(typed), length(w)) <= 0.15) AS w FROM t, v GROUP BY t.c_custkey)
    SELECT coalesce(w, 'unknown') AS c_mktsegment, count(*) AS n, count(DISTINCT typed) AS spellings FROM k GROUP BY 1""",
)
def typed_names_known(spark, d):
    """Names as typed, resolved to a vocabulary and counted, with their spellings; what is near no name is unknown."""
    known = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    s, k = F.col("c_mktsegment"), F.col("c_custkey")
    typed = F.when(k % 3 == 0, F.concat(F.expr("substring(c_mktsegment, 1, 3)"), F.expr("substring(c_mktsegment, 5)"))).when(k % 3 == 1, F.lower(s)).otherwise(F.concat(F.lit("x"), F.reverse(s)))
    # a spelling is resolved once, however many rows have it
    spelt = table(spark, d, "customer").groupBy(typed.alias("typed")).agg(F.count("*").alias("n")).withColumn("w", matching.closest_word(F.col("typed"), known))
    return spelt.groupBy(F.when(F.col("w").isin(*known), F.col("w")).otherwise("unknown").alias("c_mktsegment")).agg(F.sum("n").alias("n"), F.count("*").alias("spellings"))


@query(
    "nearest_word_overlap",
    """WITH n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS name FROM part), w AS (SELECT name, unnest(string_split(name, ' ')) AS word FROM n),
    s AS (SELECT a.name, b.name AS other, count(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.name <> b.name GROUP BY ALL)
    SELECT name, arg_min(other, (-shared, other)) AS nearest, max(shared) AS shared FROM s GROUP BY name""",
)
def nearest_word_overlap(spark, d):
    """For each distinct name the other one that shares most words, the first of equals."""
    n = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")).distinct()
    w = n.select("name", F.explode(F.split("name", " ")).alias("word"))
    s = w.join(w.withColumnRenamed("name", "other"), "word").filter("name <> other").groupBy("name", "other").agg(F.count("*").alias("shared"))
    best = s.groupBy("name").agg(F.min(F.struct((-F.col("shared")).alias("o"), "other")).alias("x"))
    return best.select("name", F.col("x.other").alias("nearest"), (-F.col("x.o")).alias("shared"))


@query("safe_names", "SELECT page_id, 'products/fresh-food/x-' || (page_id % 5) AS folder, 'img_' || page_id || '.png' AS asset, chr((65 + page_id % 26)::INT) || (page_id + 1) AS cell FROM pages")
def safe_names(spark, d):
    """Folder, last URL segment without its query, and the cell of a sheet."""
    n = F.col("page_id")
    folder = F.concat_ws("/", F.lit("products"), text.slug(F.lit("Fresh  Food!")), text.slug(F.concat(F.lit("X "), (n % 5).cast("string"))))
    url = F.concat(F.lit("https://a.b/c/img_"), n.cast("string"), F.lit(".png?w=1"))
    asset = F.element_at(F.split(F.regexp_replace(url, r"\?.*$", ""), "/"), -1)
    return table(spark, d, "pages").select("page_id", folder.alias("folder"), asset.alias("asset"), F.concat(F.chr(65 + n % 26), (n + 1).cast("string")).alias("cell"))
