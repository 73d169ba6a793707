"""Lookups, roll-ups, filters and table changes over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfloom.functions import text
from shelfloom.operators import catalog, merge, ranking
from shelfloom.plans.registry import query
from shelfloom.sources import tables
from shelfloom.sources.tables import table

# A catalog made of the tables: parts are products; a few suppliers' keys stand for failures.
_FAIL = """f AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey * 3)::VARCHAR ELSE 'ERR_' || replace('Supplier part ' || s_suppkey || '_Brand#' || (s_suppkey % 25), ' ', '_') END AS barcode, 'error ' || s_suppkey AS message FROM supplier)"""


def _failures(spark, d):
    k = F.col("s_suppkey")
    alt = F.concat(F.lit("ERR_"), F.translate(F.concat(F.lit("Supplier part "), k.cast("string"), F.lit("_Brand#"), (k % 25).cast("string")), " ", "_"))
    return table(spark, d, "supplier").select(F.when(k % 2 == 0, (k * 3).cast("string")).otherwise(alt).alias("barcode"), F.concat(F.lit("error "), k.cast("string")).alias("message"))


@query(
    "join_with_fallback_key",
    f"""WITH {_FAIL}, p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR ELSE '' END AS barcode, 'ERR_' || replace('Supplier part ' || p_partkey || '_Brand#' || (p_partkey % 25), ' ', '_') AS alt FROM part)
    SELECT p_partkey, coalesce(a.barcode, b.barcode) IS NOT NULL AS has_error, coalesce(a.message, b.message, '') AS error_message
    FROM p LEFT JOIN f a ON p.barcode = a.barcode LEFT JOIN f b ON p.alt = b.barcode""",
)
def join_with_fallback_key(spark, d):
    """Products with their failures by barcode, else by the key made of name and brand."""
    k = F.col("p_partkey")
    alt = F.concat(F.lit("ERR_"), F.translate(F.concat(F.lit("Supplier part "), k.cast("string"), F.lit("_Brand#"), (k % 25).cast("string")), " ", "_"))
    p = table(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, k.cast("string")).otherwise("").alias("barcode"), alt.alias("alt"))
    f = _failures(spark, d)
    a, b = f.select(F.col("barcode"), F.col("message").alias("m1")), f.select(F.col("barcode").alias("alt"), F.col("message").alias("m2"))
    out = p.join(a, "barcode", "left").join(b, "alt", "left")
    found = F.coalesce("m1", "m2")
    return out.select("p_partkey", found.isNotNull().alias("has_error"), F.coalesce(found, F.lit("")).alias("error_message"))


@query(
    "left_join_last_wins",
    """WITH r AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY o_custkey)
    SELECT c_custkey, status, price FROM customer LEFT JOIN r ON c_custkey = o_custkey""",
)
def left_join_last_wins(spark, d):
    """Each customer with the last of their orders, or none."""
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return table(spark, d, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("x.o_orderstatus").alias("status"), F.col("x.o_totalprice").alias("price"))


@query(
    "nest_join",
    """WITH c AS (SELECT l_orderkey, count(*) AS n_candidates, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS candidates,
      coalesce(first(l_partkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) FILTER (WHERE l_returnflag = 'R'), first(l_partkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber)) AS selected FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, coalesce(n_candidates, 0) AS n_candidates, candidates, selected FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""",
)
def nest_join(spark, d):
    """Orders with their lines as one array, best first, and the selected one: the first flagged, else the first."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct((-F.col("l_extendedprice")).alias("o"), "l_partkey", "l_linenumber", "l_returnflag").alias("x"))
    nested = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    flagged = F.get(F.filter("xs", lambda x: x["l_returnflag"] == "R"), F.lit(0))["l_partkey"]
    out = table(spark, d, "orders").select("o_orderkey").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return out.select(
        "o_orderkey",
        F.coalesce(F.size("xs"), F.lit(0)).cast("bigint").alias("n_candidates"),
        F.when(F.col("xs").isNotNull(), F.array_join(F.transform("xs", lambda x: x["l_partkey"].cast("string")), ",")).alias("candidates"),
        F.coalesce(flagged, F.get("xs", F.lit(0))["l_partkey"]).alias("selected"),
    )


@query(
    "semi_join_two_keys",
    f"""WITH {_FAIL}, p AS (SELECT p_partkey, p_partkey::VARCHAR AS barcode, 'ERR_' || replace('Supplier part ' || p_partkey || '_Brand#' || (p_partkey % 25), ' ', '_') AS alt FROM part)
    SELECT p_partkey, 'pending' AS status, 0 AS attempts FROM p WHERE barcode IN (SELECT barcode FROM f) OR alt IN (SELECT barcode FROM f)""",
)
def semi_join_two_keys(spark, d):
    """Products that failed under either key, queued again."""
    k = F.col("p_partkey")
    alt = F.concat(F.lit("ERR_"), F.translate(F.concat(F.lit("Supplier part "), k.cast("string"), F.lit("_Brand#"), (k % 25).cast("string")), " ", "_"))
    keys = table(spark, d, "part").select("p_partkey", F.explode(F.array(k.cast("string"), alt)).alias("barcode"))
    return keys.join(_failures(spark, d), "barcode", "left_semi").select("p_partkey").distinct().select("p_partkey", F.lit("pending").alias("status"), F.lit(0).alias("attempts"))


@query(
    "cascading_lookup",
    """WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS barcode, lower(c_mktsegment) AS segment, c_nationkey FROM customer),
    a AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS hit FROM orders GROUP BY 1),
    b AS (SELECT lower(c_mktsegment) AS segment, c_nationkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS hit FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT q.c_custkey, coalesce(a.hit, b.hit) AS hit, CASE WHEN a.hit IS NOT NULL THEN 'barcode' WHEN b.hit IS NOT NULL THEN 'name' END AS found_by
    FROM q LEFT JOIN a ON q.barcode = a.o_custkey LEFT JOIN b ON q.segment = b.segment AND q.c_nationkey = b.c_nationkey""",
)
def cascading_lookup(spark, d):
    """By barcode, else by name and brand in any case; the newest of several."""
    customer = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("segment"), "c_nationkey")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    a = orders.groupBy(F.col("o_custkey").alias("barcode")).agg(newest.alias("hit_a"))
    b = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("segment", "c_nationkey").agg(newest.alias("hit_b"))
    q = customer.withColumn("barcode", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")))
    out = q.join(a, "barcode", "left").join(b, ["segment", "c_nationkey"], "left")
    return out.select("c_custkey", F.coalesce("hit_a", "hit_b").alias("hit"), F.when(F.col("hit_a").isNotNull(), "barcode").when(F.col("hit_b").isNotNull(), "name").alias("found_by"))


@query("count_by_status_pivot", "SELECT count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS processing, count(*) FILTER (o_orderstatus = 'F') AS completed, 0::BIGINT AS failed, count(*) AS total FROM orders")
def count_by_status_pivot(spark, d):
    """Counts under fixed names; the total has other statuses too."""
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").agg(n("O").alias("pending"), n("P").alias("processing"), n("F").alias("completed"), n("X").alias("failed"), F.count("*").alias("total"))


@query("filtered_count", "SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'")
def filtered_count(spark, d):
    return table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").agg(F.count("*").alias("n"))


@query(
    "catalog_kpis",
    """SELECT c_mktsegment, count(*) AS total, count(*) FILTER (c_acctbal > 0 AND c_custkey % 5 <> 0) AS linked, count(*) FILTER (c_custkey % 5 = 0) AS review, count(*) FILTER (c_acctbal < -500) AS errors,
      greatest(0, count(*) - count(*) FILTER (c_acctbal > 0 AND c_custkey % 5 <> 0) - count(*) FILTER (c_custkey % 5 = 0)) AS missing,
      round(100.0::DOUBLE * count(*) FILTER (c_acctbal > 0 AND c_custkey % 5 <> 0) / count(*), 4) AS pct FROM customer GROUP BY 1""",
)
def catalog_kpis(spark, d):
    """Totals, linked, in review, failed and missing by segment, in one pass."""
    review = F.col("c_custkey") % 5 == 0
    out = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("total"), F.count_if((F.col("c_acctbal") > 0) & ~review).alias("linked"), F.count_if(review).alias("review"), F.count_if(F.col("c_acctbal") < -500).alias("errors"))
    return out.withColumn("missing", F.greatest(F.lit(0), F.col("total") - F.col("linked") - F.col("review"))).withColumn("pct", F.round(100.0 * F.col("linked") / F.col("total"), 4))


@query(
    "cost_model",
    """WITH n AS (SELECT count(*) FILTER (o_orderstatus <> 'F') AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders)
    SELECT ok, failed, 2 * ok + failed AS calls, round((2 * ok + failed) * 0.0025::DOUBLE + ok * 0.02::DOUBLE + ok * 0.002::DOUBLE, 4) AS cost, round(0.3::DOUBLE * ok)::BIGINT AS savings FROM n""",
)
def cost_model(spark, d):
    n = table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") != "F").alias("ok"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))
    calls = 2 * F.col("ok") + F.col("failed")
    return n.select("ok", "failed", calls.alias("calls"), F.round(calls * 0.0025 + F.col("ok") * 0.02 + F.col("ok") * 0.002, 4).alias("cost"), F.round(0.3 * F.col("ok")).cast("bigint").alias("savings"))


_REASONS = """f AS (SELECT l_partkey % 25 AS brand, [CASE WHEN l_quantity < 20 THEN 'bad cropping' END, CASE WHEN l_discount > 0.05 THEN 'cluttered background' END, CASE WHEN l_tax > 0.06 THEN 'wide margins' END] AS r FROM lineitem WHERE l_returnflag = 'R')"""


def _feedback(spark, d):
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    reasons = F.array_compact(F.array(F.when(F.col("l_quantity") < 20, "bad cropping"), F.when(F.col("l_discount") > 0.05, "cluttered background"), F.when(F.col("l_tax") > 0.06, "wide margins")))
    return lines.select((F.col("l_partkey") % 25).alias("brand"), F.from_json(F.to_json(reasons), "array<string>").alias("reasons"))


@query(
    "feedback_reasons_by_brand",
    f"""WITH {_REASONS}, x AS (SELECT brand, unnest(r) AS reason FROM f), n AS (SELECT brand, count(*) FILTER (reason LIKE '%cropping%' OR reason LIKE '%margins%') AS crop, count(*) FILTER (reason LIKE '%clutter%' OR reason LIKE '%background%') AS clutter FROM x WHERE reason IS NOT NULL GROUP BY brand)
    SELECT brand, crop, clutter, CASE WHEN crop >= 4 THEN 0.70 WHEN crop >= 2 THEN 0.75 END::DOUBLE AS padding FROM n""",
)
def feedback_reasons_by_brand(spark, d):
    """Reasons are counted, not rows."""
    x = _feedback(spark, d).select("brand", F.explode("reasons").alias("reason"))
    n = x.groupBy("brand").agg(F.count_if(F.col("reason").rlike("cropping|margins")).alias("crop"), F.count_if(F.col("reason").rlike("clutter|background")).alias("clutter"))
    return n.withColumn("padding", F.when(F.col("crop") >= 4, 0.70).when(F.col("crop") >= 2, 0.75))


@query(
    "learned_padding_by_brand",
    f"""WITH {_REASONS}, n AS (SELECT brand, count(*) FILTER (len([x FOR x IN r IF x LIKE '%cropping%' OR x LIKE '%margins%']) > 0) AS crop_rows, count(*) FILTER (len([x FOR x IN r IF x LIKE '%background%']) > 0) AS clutter_rows FROM f GROUP BY brand)
    SELECT brand, crop_rows, CASE WHEN crop_rows >= 4 THEN 0.70 WHEN crop_rows >= 2 THEN 0.75 END::DOUBLE AS padding, clutter_rows >= 2 AS cluttered FROM n""",
)
def learned_padding_by_brand(spark, d):
    """Rows are counted, not reasons."""
    has = lambda pattern: F.count_if(F.exists("reasons", lambda x: x.rlike(pattern)))
    n = _feedback(spark, d).groupBy("brand").agg(has("cropping|margins").alias("crop_rows"), has("clutter|background").alias("clutter_rows"))
    return n.select("brand", "crop_rows", F.when(F.col("crop_rows") >= 4, 0.70).when(F.col("crop_rows") >= 2, 0.75).alias("padding"), (F.col("clutter_rows") >= 2).alias("cluttered"))


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, d):
    return merge.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query(
    "last_write_wins",
    """SELECT user_id, min(event_id) AS first_event, arg_max(value, event_id) AS value FROM events GROUP BY user_id""",
)
def last_write_wins(spark, d):
    """A key keeps its first place and its last value."""
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.max_by("value", "event_id").alias("value"))


@query("distinct_by_first_occurrence", "SELECT p_name, min(p_partkey) AS first_key, count(*) AS n FROM part GROUP BY p_name")
def distinct_by_first_occurrence(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("n"))


@query("row_range_filter", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 2 AND 50 OR o_orderkey = 99")
def row_range_filter(spark, d):
    """Rows "2-50,99"; the ranges reach the scan."""
    return table(spark, d, "orders").filter(tables.in_ranges(F.col("o_orderkey"), tables.row_ranges("2-50,99"))).select("o_orderkey")


@query("brand_contains_filter", "SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) LIKE '%brand#1%' OR p_brand = ''")
def brand_contains_filter(spark, d):
    """In any case; a blank brand passes."""
    brand = F.coalesce(F.col("p_brand"), F.lit(""))
    return table(spark, d, "part").filter(F.lower(brand).contains("BRAND#1".lower()) | (brand == "")).select("p_partkey", "p_brand")


@query("skip_linked_filter", "SELECT c_custkey FROM customer WHERE c_acctbal <= 0")
def skip_linked_filter(spark, d):
    return table(spark, d, "customer").filter("c_acctbal <= 0").select("c_custkey")


@query(
    "catalog_tab_filter",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'review' WHEN c_acctbal < -500 THEN 'errors' WHEN c_acctbal > 0 THEN 'linked' ELSE 'missing' END AS tab FROM customer WHERE lower(c_name) LIKE '%00001%' OR lower(c_mktsegment) LIKE '%build%'""",
)
def catalog_tab_filter(spark, d):
    tab = F.when(F.col("c_custkey") % 5 == 0, "review").when(F.col("c_acctbal") < -500, "errors").when(F.col("c_acctbal") > 0, "linked").otherwise("missing")
    return table(spark, d, "customer").filter(F.lower("c_name").contains("00001") | F.lower("c_mktsegment").contains("build")).select("c_custkey", tab.alias("tab"))


@query("score_band_filter", "SELECT p_partkey, CASE WHEN coalesce(s, 0) >= .95 THEN 'excellent' WHEN coalesce(s, 0) >= .90 THEN 'medium' ELSE 'weak' END AS band FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN (p_partkey % 100) / 100.0::DOUBLE END AS s FROM part)")
def score_band_filter(spark, d):
    s = F.coalesce(F.when(F.col("p_partkey") % 10 > 0, (F.col("p_partkey") % 100) / 100.0), F.lit(0.0))
    return table(spark, d, "part").select("p_partkey", F.when(s >= 0.95, "excellent").when(s >= 0.90, "medium").otherwise("weak").alias("band"))


@query("word_scan", "SELECT doc_id, [a FOR a IN ['license', 'apache', 'reserved', 'token', 'thing'] IF contains(lower(text), a)]::VARCHAR AS hits FROM documents WHERE len([a FOR a IN ['license', 'apache', 'reserved', 'token', 'thing'] IF contains(lower(text), a)]) > 0")
def word_scan(spark, d):
    """Texts that hold any of a list of words, with those that they hold."""
    words = F.array(*[F.lit(x) for x in ("license", "apache", "reserved", "token", "thing")])
    out = table(spark, d, "documents").select("doc_id", F.filter(words, lambda a: F.contains(F.lower("text"), a)).alias("hits"))
    return out.filter(F.size("hits") > 0).select("doc_id", F.concat(F.lit("["), F.array_join("hits", ", "), F.lit("]")).alias("hits"))


@query("json_metadata_filter", "SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE event_type = 'purchase' AND value >= 50 AND (props->>'$.k')::INT >= 80")
def json_metadata_filter(spark, d):
    """Category, score and a field of the JSON metadata."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").filter((F.col("event_type") == "purchase") & (F.col("value") >= 50) & (k >= 80)).select("event_id", k.alias("k"))


_MESSAGES = (
    "API key rejected", "Rate limit reached for the vision model", "PhotoRoom: no credit left", "BG removal failed", "No results in Bing", "product page not found", "disk full", "Gemini could not open the image",
)


@query(
    "error_category",
    f"""WITH m AS (SELECT event_id, {list(_MESSAGES)}[(event_id % 8)::INT + 1] AS message FROM events WHERE event_type = 'error'), l AS (SELECT event_id, lower(message) AS m FROM m),
    c AS (SELECT event_id, regexp_matches(m, 'gemini|vision|model|api key|rate limit') AS g, regexp_matches(m, 'photoroom|credit|bg removal|background|removal') AS p, regexp_matches(m, 'yandex|bing|search|no results|not found|image') AS s FROM l)
    SELECT event_id, CASE WHEN g OR p OR s THEN concat_ws(',', CASE WHEN g THEN 'gemini' END, CASE WHEN p THEN 'photoroom' END, CASE WHEN s THEN 'search' END) ELSE 'other' END AS categories FROM c""",
)
def error_category(spark, d):
    """Every category of an error message by its words."""
    m = F.element_at(F.array(*[F.lit(x) for x in _MESSAGES]), (F.col("event_id") % 8).cast("int") + 1)
    return table(spark, d, "events").filter("event_type = 'error'").select("event_id", F.array_join(text.error_categories(m), ",").alias("categories"))


_SIGNS = ("❌ stopped", "Error in row", "upload failed", "⚠️ slow", "a warning", "✅ done", "success", "تم بنجاح", "⚙️ set up", "System up", "row read", "an error")


@query(
    "log_severity",
    f"""WITH l AS (SELECT event_id, {list(_SIGNS)}[(event_id % 12)::INT + 1] || ' (' || event_type || ')' AS line FROM events)
    SELECT event_id, CASE WHEN contains(line, '❌') OR contains(line, 'Error') OR contains(line, 'failed') THEN 'error' WHEN contains(line, '⚠️') OR contains(line, 'warning') THEN 'warning'
      WHEN contains(line, '✅') OR contains(line, 'success') OR contains(line, 'تم بنجاح') THEN 'success' WHEN contains(line, '⚙️') OR contains(line, 'System') THEN 'system' ELSE 'default' END AS severity FROM l""",
)
def log_severity(spark, d):
    """The severity of log lines by their text."""
    line = F.concat(F.element_at(F.array(*[F.lit(x) for x in _SIGNS]), (F.col("event_id") % 12).cast("int") + 1), F.lit(" ("), F.col("event_type"), F.lit(")"))
    return table(spark, d, "events").select("event_id", text.log_severity(line).alias("severity"))


_WORDS = ("", " Clip-Art", " smart start", " toy", " pasta 500g", " pack of 6")


@query(
    "filter_with_reasons",
    f"""WITH c AS (SELECT p_partkey, p_name || {list(_WORDS)}[(p_partkey % 6)::INT + 1] AS title, 'https://' || CASE WHEN p_brand = 'Brand#3' THEN 'img.freepik.com' WHEN p_brand = 'Brand#4' THEN 'shop.ae' ELSE 'x.example' END || '/' || replace(p_name, ' ', '-') AS url, p_size * 20 AS w, p_size * 30 AS h, p_brand FROM part),
    r AS (SELECT *, CASE WHEN w < 300 OR h < 300 THEN 'smaller than 300x300: ' || w || 'x' || h WHEN contains(url, 'freepik.com') THEN 'excluded word: freepik' WHEN contains(title, 'Clip-Art') THEN 'excluded word: clip-art' WHEN contains(title, ' toy') THEN 'excluded word: toy'
      WHEN contains(title, 'gizmo') THEN 'competitor: gizmo' WHEN contains(title, '500g') OR contains(title, 'pack of 6') THEN 'another size or pack' END AS early, contains(title, 'widget') OR contains(url, 'widget') AS brand FROM c)
    SELECT p_partkey, CASE WHEN early IS NOT NULL THEN early WHEN NOT brand THEN 'brand is missing: acme' END AS reject_reason, CASE WHEN early IS NOT NULL THEN 0 ELSE CASE WHEN brand THEN 15 ELSE 0 END + CASE WHEN contains(title, 'red') THEN 6 ELSE 0 END END AS relevance, w::BIGINT * h AS resolution, contains(url, '.ae') AS is_local FROM r""",
)
def filter_with_reasons(spark, d):
    """The first reason for which a candidate is rejected, by the whole chain; rejected rows stay in the trail."""
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("p_partkey") % 6).cast("int") + 1)
    host = F.when(F.col("p_brand") == "Brand#3", "img.freepik.com").when(F.col("p_brand") == "Brand#4", "shop.ae").otherwise("x.example")
    rows = table(spark, d, "part").select(
        "p_partkey", F.lit("Red  250g pack of 2").alias("product"), F.lit("Acme").alias("brand"), F.concat("p_name", word).alias("title"), F.concat(F.lit("https://"), host, F.lit("/"), F.translate("p_name", " ", "-")).alias("url"),
        (F.col("p_size") * 20).alias("width"), (F.col("p_size") * 30).alias("height"), F.array(F.lit("Widget"), F.lit("")).alias("synonyms"), F.array(F.lit(" GIZMO ")).alias("competitors"),
    )
    return catalog.candidate_trail(rows, brand_required=True).select("p_partkey", "reject_reason", "relevance", "resolution", "is_local")


@query("brand_estimate_count", "SELECT count(*) AS n FROM part WHERE p_brand LIKE '%#1%'")
def brand_estimate_count(spark, d):
    return table(spark, d, "part").filter(F.col("p_brand").contains("#1")).agg(F.count("*").alias("n"))


@query(
    "blocked_networks",
    """WITH a AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS ip FROM events)
    SELECT event_id, ip BETWEEN 167772160 AND 184549375 OR ip BETWEEN 2886729728 AND 2887778303 OR ip BETWEEN 3232235520 AND 3232301055 OR ip BETWEEN 2130706432 AND 2147483647 OR ip BETWEEN 2851995648 AND 2852061183 OR ip BETWEEN 0 AND 16777215 AS blocked FROM a""",
)
def blocked_networks(spark, d):
    """Whether an address is inside a private, loopback or link-local network, by its range."""
    dotted = F.col("ip")
    parts = F.split(dotted, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x.cast("bigint"))
    n = F.col("event_id") * 2654435761 % 4294967296
    rows = table(spark, d, "events").select("event_id", F.concat_ws(".", *[(F.floor(n / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)]).alias("ip"))
    nets = ((167772160, 184549375), (2886729728, 2887778303), (3232235520, 3232301055), (2130706432, 2147483647), (2851995648, 2852061183), (0, 16777215))
    inside = tables.in_ranges(F.col("number"), list(nets))
    return rows.select("event_id", number.alias("number")).select("event_id", inside.alias("blocked"))


@query("sheet_bounds", "SELECT l_orderkey, l_linenumber, l_orderkey > 0 AND l_orderkey <= 2000 AND l_linenumber + 1 <= 5 AS in_bounds FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def sheet_bounds(spark, d):
    r, c = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("in_bounds", (r > 0) & (r <= 2000) & (c + 1 <= 5))


_UP = """s AS (SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1), t AS (SELECT c_custkey AS k, -1::BIGINT AS v FROM customer WHERE c_custkey % 2 = 0)"""


def _pair(spark, d):
    t = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("bigint").alias("v"))
    s = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return t, s


@query("upsert", f"WITH {_UP} SELECT k, v FROM s UNION ALL SELECT k, v FROM t WHERE k NOT IN (SELECT k FROM s)")
def upsert(spark, d):
    t, s = _pair(spark, d)
    return merge.upsert(t, s, ["k"], [F.desc("v")])


@query("insert_ignore", f"WITH {_UP} SELECT k, v FROM t UNION ALL SELECT k, v FROM s WHERE k NOT IN (SELECT k FROM t)")
def insert_ignore(spark, d):
    t, s = _pair(spark, d)
    return merge.insert_ignore(t, s, ["k"], [F.desc("v")])


@query("delete_by_key", f"WITH {_UP} SELECT k, v FROM t WHERE k NOT IN (SELECT k FROM s)")
def delete_by_key(spark, d):
    t, s = _pair(spark, d)
    return merge.delete(t, s, ["k"])


@query("delete_by_prefix", f"WITH {_FAIL} SELECT barcode, message FROM f WHERE NOT starts_with(barcode, 'ERR_Supplier_part_1')")
def delete_by_prefix(spark, d):
    """The prefix is literal; an underscore is no wildcard."""
    return _failures(spark, d).filter(~F.col("barcode").startswith("ERR_Supplier_part_1"))


@query("partial_update", f"WITH {_UP}, n AS (SELECT k, CASE WHEN v % 2 = 0 THEN v END AS v FROM s) SELECT t.k, coalesce(n.v, t.v) AS v FROM t LEFT JOIN n ON t.k = n.k")
def partial_update(spark, d):
    """Only what has a value changes."""
    t, s = _pair(spark, d)
    new = merge.latest(s, ["k"], [F.desc("v")]).withColumn("v", F.when(F.col("v") % 2 == 0, F.col("v")))
    return merge.partial_update(t, new, ["k"])


@query("replace_groups", "SELECT l_orderkey AS k, l_partkey AS v FROM lineitem WHERE l_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 = 3")
def replace_groups(spark, d):
    """The rows of a group are deleted and the new ones inserted."""
    old = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("v"))
    new = table(spark, d, "orders").filter("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    return merge.replace_groups(old, new, "k")


@query("exclusive_select", "SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1)::INT AS is_selected FROM lineitem")
def exclusive_select(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    best = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")) == 1
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", best.cast("int").alias("is_selected"))


@query(
    "write_behind_cells",
    """WITH c AS (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL)
    SELECT user_id, string_agg(event_type || '=' || value, ',' ORDER BY event_type) AS updates FROM c GROUP BY user_id""",
)
def write_behind_cells(spark, d):
    """The last value of each cell of a row, as one map."""
    cells = merge.merge_cells(table(spark, d, "events"), "user_id", "event_type", "value", "event_id")
    pairs = F.array_sort(F.map_entries("updates"))
    return cells.select("user_id", F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("updates"))


@query("fill_blank_cells", "SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END), ''), 'unset') AS priority FROM orders")
def fill_blank_cells(spark, d):
    old = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(text.blank_to_null(old), F.lit("unset")).alias("priority"))


@query("history_cap", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def history_cap(spark, d):
    """The last 20 events of each user."""
    return merge.capped_history(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query(
    "outbox_batch",
    """WITH p AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type IN ('signup', 'error') QUALIFY n <= 100)
    SELECT event_id, CASE WHEN user_id > 120 OR user_id < 1 THEN 'SKIPPED_OUT_OF_BOUNDS' WHEN event_id % 11 = 0 THEN 'FAILED' ELSE 'SYNCED' END AS sync_status FROM p""",
)
def outbox_batch(spark, d):
    """The first 100 cells to write and what becomes of each."""
    batch = ranking.top(table(spark, d, "events").filter("event_type in ('signup', 'error')").select("event_id", "user_id"), [F.asc("event_id")], 100)
    return batch.select("event_id", F.when((F.col("user_id") > 120) | (F.col("user_id") < 1), "SKIPPED_OUT_OF_BOUNDS").when(F.col("event_id") % 11 == 0, "FAILED").otherwise("SYNCED").alias("sync_status"))


@query("map_merge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'kept' AS b FROM events")
def map_merge(spark, d):
    """Metadata maps merged, the new one wins."""
    old, new = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept")), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: F.try_element_at(new, k).isNull()), new)
    return table(spark, d, "events").select("event_id", merged.alias("m")).select("event_id", F.col("m.a").alias("a"), F.col("m.b").alias("b"))


@query("union_of_ids", "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 400000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def union_of_ids(spark, d):
    a = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return a.union(table(spark, d, "customer").filter("c_acctbal > 9000").select("c_custkey")).distinct()


@query("bag_union", "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def bag_union(spark, d):
    a = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return a.union(table(spark, d, "customer").filter("c_acctbal > 9000").select("c_custkey"))


@query("difference_of_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def difference_of_ids(spark, d):
    """All queued events whose id is in the batch go."""
    done = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(done, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("row_set_from_ranges", "SELECT DISTINCT unnest(range(p_size, p_size + 4))::BIGINT AS row_number FROM part")
def row_set_from_ranges(spark, d):
    return table(spark, d, "part").select(F.explode(F.sequence(F.col("p_size").cast("bigint"), F.col("p_size").cast("bigint") + 3)).alias("row_number")).distinct()


@query("bounded_preview", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 5")
def bounded_preview(spark, d):
    return ranking.top(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), [F.asc("o_orderkey")], 5)


@query(
    "sheet_scan",
    """SELECT (p_partkey + 2)::INT AS row_number, p_partkey::VARCHAR AS barcode, p_name AS name, p_brand AS brand, p_name || ' ' || p_brand AS search_query,
      CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'http://x/' || p_partkey END AS link, p_partkey % 4 = 1 AS needs_review FROM part WHERE p_partkey % 7 <> 0""",
)
def sheet_scan(spark, d):
    """A sheet with headers in any case and flagged links."""
    k = F.col("p_partkey")
    link = F.concat(F.lit("http://x/"), k.cast("string"))
    raw = table(spark, d, "part").select(
        k, k.cast("string").alias("EAN"), F.when(k % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("Product Name"), F.col("p_brand").alias("Brand"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit(tables.REVIEW_PREFIX), link)).otherwise(link).alias("Image Link"),
    )
    return tables.sheet(raw, F.col("p_partkey"))


@query(
    "brand_mapping_scan",
    """SELECT lower(p_brand) AS key, p_brand AS brand, p_brand || ',' || p_brand || ' co,' || p_brand || ' ltd' AS synonyms, count(*) AS n FROM part GROUP BY ALL""",
)
def brand_mapping_scan(spark, d):
    brands = table(spark, d, "part").groupBy("p_brand").count().withColumn("syn", F.concat(F.col("p_brand"), F.lit(" co, "), F.col("p_brand"), F.lit(" ltd,"))).withColumn("none", F.lit(None).cast("string"))
    out = tables.brand_mappings(brands, "p_brand", "syn", "none")
    return out.join(brands.select(F.col("p_brand").alias("brand"), F.col("count").alias("n")), "brand").select("key", "brand", F.array_join("synonyms", ",").alias("synonyms"), "n")


@query("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark, d):
    """Extension: a cube."""
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))


@query(
    "range_join",
    """WITH b AS (SELECT p_size AS band, min(p_retailprice) AS low, min(p_retailprice) + 20 AS high FROM part WHERE p_size < 10 GROUP BY p_size)
    SELECT band, count(*) AS n FROM b JOIN part ON p_retailprice >= low AND p_retailprice < high GROUP BY band""",
)
def range_join(spark, d):
    """Extension: intervals meet points in buckets of their width, so the join is by equality."""
    part = table(spark, d, "part").select("p_size", "p_retailprice")
    b = part.filter("p_size < 10").groupBy(F.col("p_size").alias("band")).agg(F.min("p_retailprice").alias("low")).withColumn("high", F.col("low") + 20)
    cell = lambda c: F.floor(c / 20)
    b = b.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    p = part.withColumn("cell", cell(F.col("p_retailprice")))
    return b.join(p, "cell").filter("p_retailprice >= low and p_retailprice < high").groupBy("band").agg(F.count("*").alias("n"))


@query(
    "as_of_join",
    """SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'view'""",
)
def as_of_join(spark, d):
    """Extension: each view with the user's last purchase before it; one sort of both by user and time."""
    both = table(spark, d, "events").filter("event_type in ('view', 'purchase')").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "view").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return out.filter("event_type = 'view'").select("event_id", "last_purchase")


@query("approx_distinct", None)
def approx_distinct(spark, d):
    """Extension: HyperLogLog counts."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.approx_count_distinct("l_suppkey").alias("suppliers"))


@query("rollup_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_pricing_summary(spark, d):
    """Extension: a rollup over a pushed-down filter."""
    lines = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.expr("timestamp_ntz '2001-09-02 00:00:00'"))
    return lines.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
