"""Rank fusion, top-k and paging over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfloom.functions import scoring, text, vectors
from shelfloom.operators import ranking
from shelfloom.plans.registry import query
from shelfloom.sources.tables import table


def _similar(spark, d, vec_id=0):
    v = table(spark, d, "embeddings")
    q = v.filter(F.col("vec_id") == vec_id).limit(1).select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(q)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q"), 1e-8), 10).alias("similarity"))


_SIM = """sim AS (SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) + 1e-8), 10) AS similarity
 FROM embeddings e, embeddings q WHERE q.vec_id = 0)"""


@query(
    "hybrid_rrf_search",
    f"""WITH {_SIM}, a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM sim QUALIFY rank <= 20),
    b AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS rank FROM part WHERE p_name LIKE '%widget%' QUALIFY rank <= 20),
    f AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.rank, 999) AS vector_rank, coalesce(b.rank, 999) AS keyword_rank,
      round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS score FROM a FULL OUTER JOIN b ON a.id = b.id)
    SELECT id, vector_rank, keyword_rank, score FROM f ORDER BY score DESC, id LIMIT 5""",
)
def hybrid_rrf_search(spark, d):
    """Vector and keyword lists of 20, fused; the best five."""
    a = ranking.top(_similar(spark, d), [F.desc("similarity"), F.asc("vec_id")], 20).withColumnRenamed("vec_id", "id")
    b = table(spark, d, "part").filter(F.col("p_name").contains("widget")).select(F.col("p_partkey").alias("id"))
    a = ranking.with_rank(a, [F.desc("similarity"), F.asc("id")])
    b = ranking.with_rank(ranking.top(b, [F.asc("id")], 20), [F.asc("id")])
    fused = ranking.fuse_hybrid(a, b, "id")
    return ranking.top(fused, [F.desc("score"), F.asc("id")], 5).select("id", F.col("rank_a").alias("vector_rank"), F.col("rank_b").alias("keyword_rank"), "score")


@query("vector_top_k", f"WITH {_SIM} SELECT vec_id, similarity FROM sim ORDER BY similarity DESC, vec_id LIMIT 10")
def vector_top_k(spark, d):
    return ranking.top(_similar(spark, d), [F.desc("similarity"), F.asc("vec_id")], 10)


@query(
    "keyword_top_k",
    """SELECT p_partkey, (CASE WHEN p_name LIKE '%ring%' THEN 1 ELSE 0 END + CASE WHEN lower(p_type) LIKE '%promo%' THEN 2 ELSE 0 END)::INT AS score
    FROM part WHERE p_name LIKE '%ring%' OR lower(p_type) LIKE '%promo%' ORDER BY score DESC, p_partkey LIMIT 20""",
)
def keyword_top_k(spark, d):
    """One point for the name, two for the code, above zero only."""
    score = F.when(F.col("p_name").contains("ring"), 1).otherwise(0) + F.when(F.lower("p_type").contains("promo"), 2).otherwise(0)
    return ranking.top(table(spark, d, "part").select("p_partkey", score.alias("score")).filter("score > 0"), [F.desc("score"), F.asc("p_partkey")], 20)


def _user_lists(spark, d, n=50):
    """The first ``n`` users of each event type by value: (user_id, list, rank, value)."""
    total = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 4).alias("value"))
    ranked = ranking.with_rank(total, [F.desc("value"), F.asc("user_id")], ["event_type"])
    return ranked.filter(F.col("rank") <= n).withColumnRenamed("event_type", "list")


_LISTS = """l AS (SELECT event_type AS list, user_id, round(sum(value), 4) AS value FROM events GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY value DESC, user_id) AS rank FROM l QUALIFY rank <= 50)"""


@query(
    "rrf_max_normalised",
    f"""WITH {_LISTS}, s AS (SELECT user_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r WHERE list IN ('view', 'click') GROUP BY user_id)
    SELECT user_id, score, round(score / (2::DOUBLE / 61) * 100, 2) AS pct, round(score / (2::DOUBLE / 61) * 100, 2) >= 65 AS passes, bool_or(round(score / (2::DOUBLE / 61) * 100, 2) >= 65) OVER () AS any_passes FROM s""",
)
def rrf_max_normalised(spark, d):
    """Two lists; the score as a share of the best possible one, a floor, and whether any passes it."""
    two = _user_lists(spark, d).filter(F.col("list").isin("view", "click"))
    out = ranking.max_normal(ranking.fuse(two, "user_id"), 2)
    some = out.agg(F.max("passes").alias("any_passes"))
    return out.crossJoin(F.broadcast(some))


@query(
    "rrf_first_metadata",
    f"""WITH {_LISTS} SELECT user_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, arg_min(value, list || lpad(rank::VARCHAR, 4, '0')) AS first_value, count(*) AS n_lists FROM r GROUP BY user_id""",
)
def rrf_first_metadata(spark, d):
    """Any number of lists; the metadata that was seen first stays."""
    lists = ranking.contributions(_user_lists(spark, d))
    return lists.groupBy("user_id").agg(F.round(F.sum("part"), 6).alias("score"), F.min_by("value", F.struct("list", "rank")).alias("first_value"), F.count("*").alias("n_lists"))


@query(
    "rrf_min_max_normalised",
    f"""WITH {_LISTS}, s AS (SELECT user_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r GROUP BY user_id)
    SELECT user_id, score, round(CASE WHEN max(score) OVER () = min(score) OVER () THEN 100 ELSE 100 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER () + 1e-9) END, 2) AS normal FROM s""",
)
def rrf_min_max_normalised(spark, d):
    return ranking.min_max_normal(ranking.fuse(_user_lists(spark, d), "user_id"))


@query(
    "rrf_weighted",
    f"""WITH {_LISTS} SELECT user_id, round(sum(CASE list WHEN 'view' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)), 6) AS score FROM r WHERE list IN ('view', 'purchase') GROUP BY user_id""",
)
def rrf_weighted(spark, d):
    two = _user_lists(spark, d).filter(F.col("list").isin("view", "purchase"))
    return ranking.fuse(two, "user_id", weight=F.when(F.col("list") == "view", 1.2).otherwise(1.0))


@query(
    "rrf_engines_by_authority",
    """WITH e AS (SELECT page_id, (page_id % 4)::INT AS engine, row_number() OVER (PARTITION BY page_id % 4 ORDER BY page_id) AS rank,
      CASE page_id % 7 WHEN 0 THEN 'https://www.amazon.com/' WHEN 1 THEN 'https://shutterstock.com/' WHEN 2 THEN 'https://ebay.com/' WHEN 3 THEN 'https://www.istockphoto.com/' WHEN 4 THEN 'https://img.pinterest.com/' ELSE 'https://shop.example/' END || (page_id // 4 % 9) AS url FROM pages),
    k AS (SELECT * FROM e WHERE NOT regexp_matches(url, '^https?://([a-zA-Z0-9-]+\\.)*(shutterstock|gettyimages|istockphoto|adobe|freepik|alamy|dreamstime|vectorstock|depositphotos|123rf)\\.[a-z]{2,6}/.*')),
    s AS (SELECT url, round(sum(CASE engine WHEN 0 THEN 1.3::DOUBLE WHEN 1 THEN 1.1::DOUBLE WHEN 2 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END / (60 + rank)), 6) AS score FROM k GROUP BY url)
    SELECT url, score, round(score * CASE WHEN url LIKE '%amazon.com/%' THEN 1.5 WHEN url LIKE '%ebay.com/%' THEN 1.1 WHEN url LIKE '%pinterest.com/%' THEN 0.2 ELSE 1.0 END, 8) AS final FROM s""".replace("\\\\", "\\"),
)
def rrf_engines_by_authority(spark, d):
    """Four engines with weights; blacklisted hosts take a rank and are dropped after, the score is multiplied by the host's authority."""
    hosts = F.create_map(*[F.lit(x) for kv in {0: "https://www.amazon.com/", 1: "https://shutterstock.com/", 2: "https://ebay.com/", 3: "https://www.istockphoto.com/", 4: "https://img.pinterest.com/"}.items() for x in kv])
    n = F.col("page_id")
    url = F.concat(F.coalesce(F.try_element_at(hosts, (n % 7).cast("int")), F.lit("https://shop.example/")), (F.floor(n / 4) % 9).cast("string"))
    found = table(spark, d, "pages").select("page_id", (n % 4).cast("int").alias("engine"), url.alias("url"))
    ranked = ranking.with_rank(found, [F.asc("page_id")], ["engine"]).filter(~F.col("url").rlike(text.STOCK_HOSTS))
    weight = F.element_at(F.array(*[F.lit(x) for x in (1.3, 1.1, 0.9, 0.7)]), F.col("engine") + 1)
    fused = ranking.fuse(ranked, "url", weight=weight).withColumn("by", text.domain_weight(F.col("url")))
    return fused.filter("by > 0").select("url", "score", F.round(F.col("score") * F.col("by"), 8).alias("final"))


@query(
    "top_k_per_group",
    "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 15",
)
def top_k_per_group(spark, d):
    """The first 15 of each group, before anything dear."""
    return ranking.with_rank(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_custkey"]).filter("rank <= 15")


@query("two_key_sort", "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 100")
def two_key_sort(spark, d):
    return ranking.top(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), [F.desc("p_size"), F.desc("p_retailprice"), F.asc("p_partkey")], 100)


@query("pagination", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def pagination(spark, d):
    """The third page of 20, newest first."""
    return ranking.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 20)


@query(
    "fifo_claim",
    "SELECT o_orderkey, 'processing' AS status, (o_orderkey % 3 + 1)::INT AS attempts FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1",
)
def fifo_claim(spark, d):
    """The oldest pending task, as it is once claimed."""
    pending = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return ranking.top(pending, [F.asc("o_orderkey")], 1).select("o_orderkey", F.lit("processing").alias("status"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("attempts"))


@query(
    "rerank_by_overlap",
    """WITH q AS (SELECT ['red', 'widget'] AS t), s AS (SELECT p_partkey, p_retailprice / 3000 AS base, len(list_intersect(string_split(p_name, ' '), t)) AS n FROM part, q)
    SELECT p_partkey, round(base + 0.2 * n / 2, 4) AS score FROM s ORDER BY score DESC, p_partkey LIMIT 50""",
)
def rerank_by_overlap(spark, d):
    """A score raised by the share of the query's words that the name holds."""
    wanted = F.array(F.lit("red"), F.lit("widget"))
    share = F.size(F.array_intersect(F.split("p_name", " "), wanted)) / F.size(wanted)
    return ranking.top(table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") / 3000 + 0.2 * share, 4).alias("score")), [F.desc("score"), F.asc("p_partkey")], 50)


@query(
    "uncertainty_top_n",
    """WITH e AS (SELECT vec_id, [abs(x) FOR x IN embedding::DOUBLE[]] AS a FROM embeddings), n AS (SELECT vec_id, [x / list_sum(a) FOR x IN a] AS p FROM e),
    u AS (SELECT vec_id, 1 - list_max(p) AS lc, 1 - (list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2]) AS margin, -list_sum([CASE WHEN x > 1e-12 THEN x * ln(x) ELSE 0 END FOR x IN p]) AS entropy FROM n)
    SELECT vec_id, round(0.4 * lc + 0.4 * margin + 0.2 * entropy, 4) AS priority FROM u ORDER BY priority DESC, vec_id LIMIT 50""",
)
def uncertainty_top_n(spark, d):
    """Rows whose class probabilities say least, for review."""
    a = F.transform(vectors.doubles(F.col("embedding")), F.abs)
    rows = table(spark, d, "embeddings").select("vec_id", a.alias("a")).withColumn("p", F.transform("a", lambda x: x / F.aggregate("a", F.lit(0.0), lambda acc, y: acc + y)))
    return ranking.top(rows.select("vec_id", scoring.uncertainty(F.col("p"))["priority"].alias("priority")), [F.desc("priority"), F.asc("vec_id")], 50)


@query(
    "least_latency",
    """WITH l AS (SELECT user_id, round(avg(value), 6) AS latency FROM events WHERE event_type <> 'error' GROUP BY user_id) SELECT user_id, latency FROM l ORDER BY latency, user_id LIMIT 1""",
)
def least_latency(spark, d):
    """The healthy node that answers fastest."""
    mean = table(spark, d, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("latency"))
    return ranking.top(mean, [F.asc("latency"), F.asc("user_id")], 1)


@query("argmax_first_wins", "SELECT l_orderkey, arg_min(l_linenumber, (-l_extendedprice, l_linenumber)) AS best_line, max(l_extendedprice) AS best_price FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice FROM lineitem) GROUP BY l_orderkey")
def argmax_first_wins(spark, d):
    """The greatest value of each key; of equals the first."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_extendedprice", -F.col("l_linenumber"))).alias("best_line"), F.max("l_extendedprice").alias("best_price"))


@query(
    "window_frames",
    """SELECT p_partkey, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)::INT AS quarter, round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume,
      first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS cheapest, last_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dearest,
      count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice)""",
)
def window_frames(spark, d):
    """Ranks, tiles, ends and a range frame of a brand's products."""
    w, total = Window.partitionBy("p_brand").orderBy("p_retailprice"), Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    whole, near = total.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-2, 2)
    return table(spark, d, "part").select(
        "p_partkey", F.dense_rank().over(w).alias("dense"), F.ntile(4).over(total).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pct"), F.round(F.cume_dist().over(w), 6).alias("cume"),
        F.first("p_partkey").over(total).alias("cheapest"), F.last("p_partkey").over(whole).alias("dearest"), F.count("*").over(near).alias("near"),
    )
