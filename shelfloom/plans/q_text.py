"""Text functions over the tables. Oracle rows are ASCII where the other engine counts bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shelfloom.functions import images, ports, text
from shelfloom.operators import brands, ranking
from shelfloom.plans.registry import query
from shelfloom.sources.tables import table


def _names(spark, d):
    """The distinct part names."""
    return table(spark, d, "part").select("p_name").distinct()


@query(
    "levenshtein_similarity",
    """WITH n AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT a.a, b.a AS b FROM n a JOIN n b ON a.a < b.a AND string_split(a.a, ' ')[1] = string_split(b.a, ' ')[1])
    SELECT a, b, levenshtein(a, b)::INT AS distance, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 4) AS similarity FROM p""",
)
def levenshtein_similarity(spark, d):
    """Edit distance and similarity of names that share their first word."""
    n = _names(spark, d).withColumn("w", F.split("p_name", " ")[0])
    p = n.select("w", F.col("p_name").alias("a")).join(n.select("w", F.col("p_name").alias("b")), "w").filter("a < b")
    return p.select("a", "b", text.levenshtein(F.col("a"), F.col("b")).alias("distance"), text.levenshtein_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query("jaro_winkler_pairs", None)
def jaro_winkler_pairs(spark, d):
    """Jaro-Winkler of names that share their last word; the other engine's function differs, so tests hold it against goldens."""
    n = _names(spark, d).withColumn("w", F.split("p_name", " ")[1])
    p = n.select("w", F.col("p_name").alias("a")).join(n.select("w", F.col("p_name").alias("b")), "w").filter("a < b")
    j = text.jaro_winkler(F.col("a"), F.col("b"))
    return p.select("a", "b", j.alias("similarity")).withColumn("same_flat", F.col("similarity") >= 0.95).withColumn("same_curved", F.col("similarity") >= 0.88)


@query(
    "title_clean",
    r"""WITH t AS (SELECT p_partkey, '  ' || upper(p_name) || '® ' || (p_partkey % 900) || 'ml pack of ' || (p_partkey % 12) || ' #' || p_brand || ' 629104100' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS title FROM part)
    SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(replace(title, '®', ''))), '\b\d{12,13}\b', '', 'g'), '\b\d+(\.\d+)?\s*(g|oz|ml|l|kg|ounces|grams|fluid\s*oz|fl\.?\s*oz)\b', '', 'g'), '\b(pack\s*of|pk\s*of|box\s*of|case\s*of|qty|x)\s*(\d+)\b', '', 'g'), '[^a-z0-9_\s\-.,/]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM t""",
)
def title_clean(spark, d):
    k = F.col("p_partkey")
    title = F.concat(F.lit("  "), F.upper("p_name"), F.lit("® "), (k % 900).cast("string"), F.lit("ml pack of "), (k % 12).cast("string"), F.lit(" #"), F.col("p_brand"), F.lit(" 629104100"), F.lpad((k % 10000).cast("string"), 4, "0"))
    return table(spark, d, "part").select("p_partkey", text.clean_title(title).alias("cleaned"))


@query(
    "search_name_and_fallback",
    r"""WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' milk' WHEN 1 THEN ' flour' WHEN 2 THEN ' kefir' ELSE '' END || ' ' || (p_partkey % 500) || 'ml (new)' AS name FROM part),
    c AS (SELECT p_partkey, name, trim(regexp_replace(regexp_replace(regexp_replace(name, '(?i)\b\d+(?:\.\d+)?\s*(?:ml|l|g|kg|pcs|pack)\b', '', 'g'), '\s*[(\[].*?[)\]]', '', 'g'), '\s+', ' ', 'g')) AS cleaned FROM t)
    SELECT p_partkey, cleaned, cleaned || CASE WHEN cleaned LIKE '%milk%' THEN CASE WHEN name LIKE '%180ml%' OR name LIKE '%200ml%' OR name LIKE '%250ml%' THEN ' carton' ELSE ' bottle' END WHEN cleaned LIKE '%flour%' THEN ' bag' WHEN cleaned LIKE '%kefir%' THEN ' bottle' ELSE ' product' END AS fallback FROM c""",
)
def search_name_and_fallback(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, " milk").when(k % 4 == 1, " flour").when(k % 4 == 2, " kefir").otherwise("")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), kind, F.lit(" "), (k % 500).cast("string"), F.lit("ml (new)")).alias("name"))
    return rows.select("p_partkey", text.search_name(F.col("name")).alias("cleaned"), text.fallback_query(F.col("name")).alias("fallback"))


@query(
    "fallback_query_sequence",
    """SELECT p_partkey, list_distinct([p_brand || ' ' || p_name, p_brand || ' ' || p_type, lower(p_type) || ' ' || p_name]).list_sort().array_to_string('|') AS queries FROM part""",
)
def fallback_query_sequence(spark, d):
    """Brand and name, brand and category, category and name; each once."""
    qs = F.array(F.concat_ws(" ", "p_brand", "p_name"), F.concat_ws(" ", "p_brand", "p_type"), F.concat_ws(" ", F.lower("p_type"), F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(qs)), "|").alias("queries"))


@query(
    "search_text_normalise",
    """SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '([0-9]+)([a-zA-Z])', '\\1 \\2', 'g'), '([a-zA-Z])([0-9]+)', '\\1 \\2', 'g'), '[^\\p{L}\\p{N}\\p{M}_\\s]', '', 'g'), ' ')) AS normal FROM documents""".replace("\\\\", "\\"),
)
def search_text_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normal_search(F.col("text")), 256).alias("normal"))


_METRIC = """t AS (SELECT p_partkey, p_name || ' ' || CASE p_partkey % 5 WHEN 0 THEN (p_partkey % 900) || ' g' WHEN 1 THEN (p_partkey % 9) || '.5kg' WHEN 2 THEN (p_partkey % 700) || 'ml' WHEN 3 THEN (p_partkey % 8) || ' L bottle' ELSE 'loose' END AS title FROM part)"""


def _titles(spark, d):
    k = F.col("p_partkey")
    s = lambda n: (k % n).cast("string")
    size = F.when(k % 5 == 0, F.concat(s(900), F.lit(" g"))).when(k % 5 == 1, F.concat(s(9), F.lit(".5kg"))).when(k % 5 == 2, F.concat(s(700), F.lit("ml"))).when(k % 5 == 3, F.concat(s(8), F.lit(" L bottle"))).otherwise("loose")
    return table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), size).alias("title"))


@query(
    "metric_extract",
    f"""WITH {_METRIC} SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN (p_partkey % 900)::DOUBLE WHEN 1 THEN round((p_partkey % 9 + 0.5) * 1000, 4)::DOUBLE WHEN 2 THEN (p_partkey % 700)::DOUBLE WHEN 3 THEN (p_partkey % 8) * 1000.0::DOUBLE END AS value,
    CASE WHEN p_partkey % 5 < 2 THEN 'g' WHEN p_partkey % 5 < 4 THEN 'ml' END AS unit FROM t""",
)
def metric_extract(spark, d):
    rows = _titles(spark, d).withColumn("m", text.metric(F.col("title")))
    return rows.select("p_partkey", F.round("m.value", 4).alias("value"), F.col("m.unit").alias("unit"))


@query(
    "metric_compare",
    f"""WITH {_METRIC}, m AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN (p_partkey % 900)::DOUBLE WHEN 1 THEN (p_partkey % 9 + 0.5)::DOUBLE * 1000 WHEN 2 THEN (p_partkey % 700)::DOUBLE WHEN 3 THEN (p_partkey % 8) * 1000.0::DOUBLE END AS v, CASE WHEN p_partkey % 5 < 2 THEN 'g' WHEN p_partkey % 5 < 4 THEN 'ml' END AS u FROM t)
    SELECT a.p_partkey, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 0.5 WHEN a.u <> b.u THEN 0 WHEN greatest(a.v, b.v) = 0 OR abs(a.v - b.v) <= 0.02 * greatest(a.v, b.v) THEN 1 ELSE 0 END::DOUBLE AS score FROM m a JOIN m b ON b.p_partkey = a.p_partkey + 5""",
)
def metric_compare(spark, d):
    """Each title against that of the key five further on."""
    a = _titles(spark, d)
    b = a.select((F.col("p_partkey") - 5).alias("p_partkey"), F.col("title").alias("other"))
    return a.join(b, "p_partkey").select("p_partkey", text.metric_match(F.col("title"), F.col("other")).alias("score"))


@query(
    "volume_clash",
    f"""WITH {_METRIC}, m AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN (p_partkey % 900)::DOUBLE WHEN 1 THEN (p_partkey % 9 + 0.5)::DOUBLE * 1000 WHEN 2 THEN (p_partkey % 700)::DOUBLE WHEN 3 THEN (p_partkey % 8) * 1000.0::DOUBLE END AS v, CASE WHEN p_partkey % 5 < 2 THEN 'g' WHEN p_partkey % 5 < 4 THEN 'ml' END AS u FROM t)
    SELECT a.p_partkey, coalesce(a.u = b.u AND least(a.v, b.v) > 0 AND greatest(a.v, b.v) > 1.2 * least(a.v, b.v), false) AS clash FROM m a JOIN m b ON b.p_partkey = a.p_partkey + 5""",
)
def volume_clash(spark, d):
    a = _titles(spark, d)
    b = a.select((F.col("p_partkey") - 5).alias("p_partkey"), F.col("title").alias("other"))
    return a.join(b, "p_partkey").select("p_partkey", text.volume_clash(F.col("title"), F.col("other")).alias("clash"))


_INTENT = """t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'box of ' || p_name WHEN 1 THEN p_name || ' ' || (p_partkey % 24 + 1) || ' pcs' WHEN 2 THEN p_name || ' ' || (p_partkey % 9 + 1) || 'x330' ELSE p_name END AS q, p_partkey % 3 = 0 AS bundle, (p_partkey % 12)::INT AS units, 0.5 + (p_partkey % 10) / 10.0::DOUBLE AS ar FROM part),
 i AS (SELECT *, CASE WHEN p_partkey % 4 = 3 THEN 'SINGLE_UNIT' ELSE 'MULTI_PACK' END AS intent, CASE p_partkey % 4 WHEN 1 THEN p_partkey % 24 + 1 WHEN 2 THEN p_partkey % 9 + 1 ELSE 1 END::INT AS parsed FROM t)"""


@query(
    "query_intent_score",
    f"""WITH {_INTENT} SELECT p_partkey, intent, parsed, CASE WHEN intent = 'MULTI_PACK' AND NOT bundle THEN 0.02 WHEN intent = 'SINGLE_UNIT' AND bundle THEN 0.05
      ELSE round(least(2.0::DOUBLE, 1.0::DOUBLE + CASE WHEN intent = 'MULTI_PACK' THEN CASE WHEN parsed = units THEN 0.5 ELSE greatest(0, 0.3::DOUBLE - abs(parsed - units) * 0.05::DOUBLE) END ELSE 0 END + CASE WHEN bundle AND ar BETWEEN 0.8 AND 1.3 THEN 0.2 ELSE 0 END), 2) END::DOUBLE AS score FROM i""",
)
def query_intent_score(spark, d):
    k = F.col("p_partkey")
    q = F.when(k % 4 == 0, F.concat(F.lit("box of "), F.col("p_name"))).when(k % 4 == 1, F.concat(F.col("p_name"), F.lit(" "), (k % 24 + 1).cast("string"), F.lit(" pcs"))).when(k % 4 == 2, F.concat(F.col("p_name"), F.lit(" "), (k % 9 + 1).cast("string"), F.lit("x330"))).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", text.query_intent(q).alias("i"), (k % 3 == 0).alias("bundle"), (k % 12).cast("int").alias("units"), (0.5 + (k % 10) / 10.0).alias("ar"))
    return rows.select("p_partkey", F.col("i.intent").alias("intent"), F.col("i.units").alias("parsed"), text.intent_score(F.col("i.intent"), F.col("i.units"), F.col("bundle"), F.col("units"), F.col("ar")).alias("score"))


@query(
    "gtin13_check",
    """WITH c AS (SELECT p_partkey, '629104' || lpad(p_partkey::VARCHAR, 7, '0') AS code FROM part)
    SELECT p_partkey, code, (10 - list_sum([CASE WHEN i % 2 = 1 THEN code[i]::INT ELSE 3 * code[i]::INT END FOR i IN range(1, 13)]) % 10) % 10 = code[13]::INT AS valid FROM c""",
)
def gtin13_check(spark, d):
    code = F.concat(F.lit("629104"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    return table(spark, d, "part").select("p_partkey", code.alias("code")).withColumn("valid", text.gtin13_valid(F.col("code")))


@query(
    "gs1_digital_link",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN lpad(p_partkey::VARCHAR, 14, '0') END AS gtin, CASE WHEN p_partkey % 5 > 1 THEN 'B' || p_partkey END AS batch, CASE WHEN p_partkey % 5 > 2 THEN 'S-' || p_partkey END AS serial,
      CASE WHEN p_partkey % 5 > 0 THEN 'https://shop.example/01/' || lpad(p_partkey::VARCHAR, 14, '0') || CASE WHEN p_partkey % 5 > 1 THEN '/10/B' || p_partkey ELSE '' END || CASE WHEN p_partkey % 5 > 2 THEN '/21/S-' || p_partkey ELSE '' END END AS rebuilt FROM part""",
)
def gs1_digital_link(spark, d):
    """Links parsed and built again."""
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    uri = F.concat(F.when(k % 5 > 0, F.concat(F.lit(" /01/"), F.lpad(s, 14, "0"))).otherwise(" /x"), F.when(k % 5 > 1, F.concat(F.lit("/10/B"), s)).otherwise(""), F.when(k % 5 > 2, F.concat(F.lit("/21/S-"), s)).otherwise(""))
    rows = table(spark, d, "part").select("p_partkey", text.gs1_link(uri).alias("g"))
    rebuilt = F.when(F.col("g.gtin").isNotNull(), text.gs1_uri(F.lit("https://shop.example/"), F.col("g.gtin"), F.col("g.batch"), F.col("g.serial")))
    return rows.select("p_partkey", "g.gtin", "g.batch", "g.serial", rebuilt.alias("rebuilt"))


@query(
    "taxonomy_by_keyword",
    """WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' Milk' WHEN 1 THEN ' Chocolate milk' WHEN 2 THEN ' hand wash' WHEN 3 THEN ' boiled' ELSE '' END AS n FROM part)
    SELECT p_partkey, CASE WHEN lower(n) LIKE '%milk%' THEN '10000025' WHEN lower(n) LIKE '%chocolate%' THEN '10000043' WHEN lower(n) LIKE '%hand wash%' THEN '10000350' WHEN lower(n) LIKE '%oil%' THEN '10000150' ELSE '10000000' END AS brick,
      CASE WHEN lower(n) LIKE '%milk%' THEN '50131700' WHEN lower(n) LIKE '%chocolate%' THEN '50161813' WHEN lower(n) LIKE '%hand wash%' THEN '53131608' WHEN lower(n) LIKE '%oil%' THEN '50151500' ELSE '50000000' END AS commodity,
      CASE WHEN regexp_matches(lower(n), 'milk|chocolate|hand wash|oil') THEN 0.98 ELSE 0.75 END::DOUBLE AS confidence FROM t""",
)
def taxonomy_by_keyword(spark, d):
    k = F.col("p_partkey")
    n = F.concat(F.col("p_name"), F.when(k % 5 == 0, " Milk").when(k % 5 == 1, " Chocolate milk").when(k % 5 == 2, " hand wash").when(k % 5 == 3, " boiled").otherwise(""))
    return table(spark, d, "part").select("p_partkey", text.taxonomy(n).alias("t")).select("p_partkey", "t.brick", "t.commodity", "t.confidence")


@query(
    "json_ld_extract",
    """SELECT page_id, page_id % 4 <> 3 AS has_product, CASE WHEN page_id % 4 IN (0, 1) THEN '629' || page_id END AS gtin, CASE WHEN page_id % 4 = 0 THEN 'Acme' WHEN page_id % 4 = 1 THEN 'Plain' END AS brand, CASE WHEN page_id % 4 = 0 THEN 'SAR' WHEN page_id % 4 = 1 THEN 'EUR' END AS currency,
      CASE page_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.2 ELSE 0 END::DOUBLE AS completeness FROM pages""",
)
def json_ld_extract(spark, d):
    """Product data of objects and arrays, with nested and plain brands."""
    k = F.col("page_id").cast("string")
    a = F.concat(F.lit('{"@type":"Product","gtin":"629'), k, F.lit('","brand":{"name":"Acme"},"offers":{"priceCurrency":"SAR"},"name":"x","image":"y"}'))
    b = F.concat(F.lit('[{"@type":"Offer"},{"@type":"Product","gtin13":"629'), k, F.lit('","brand":"Plain","offers":[{"priceCurrency":"EUR"}],"name":"x"}]'))
    m = F.col("page_id") % 4
    doc = F.when(m == 0, a).when(m == 1, b).when(m == 2, '{"@type":"Product","name":"x"}').otherwise('{"@type":"Thing"}')
    return table(spark, d, "pages").select("page_id", text.json_ld(doc).alias("j")).select("page_id", "j.has_product", "j.gtin", "j.brand", "j.currency", "j.completeness")


@query(
    "merchant_authority",
    """WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 96 WHEN 1 THEN 97 WHEN 2 THEN 15 ELSE 96 END AS da, CASE page_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END AS cdn, (page_id % 6) / 5.0::DOUBLE AS c FROM pages)
    SELECT page_id, cdn AS cdn_tier, round(0.4::DOUBLE * greatest(0.1, least(1.0, da / 100.0)) + 0.4::DOUBLE * c + 0.2::DOUBLE * cdn, 3) AS authority FROM u""",
)
def merchant_authority(spark, d):
    n = F.col("page_id")
    page = F.when(n % 4 == 0, "https://www.shop.myshopify.com/p/1").when(n % 4 == 1, "https://adobe.com/x").when(n % 4 == 2, "https://example.org/").otherwise("http://AMAZON.com/dp")
    image = F.when(n % 3 == 0, "https://cdn.shopify.com/a.png").when(n % 3 == 1, "https://x.y/media/catalog/product/a.png").otherwise("https://x.y/a.png")
    return table(spark, d, "pages").select("page_id", text.cdn_tier(image).alias("cdn_tier"), text.merchant_authority(page, image, (n % 6) / 5.0).alias("authority"))


@query(
    "html_prune",
    r"""SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '(?is)<svg\b[^>]*>.*?</svg>', '', 'g'), '(?i)\sstyle="[^"]*"', '', 'g'))::INT AS n_chars FROM pages""",
)
def html_prune(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(text.pruned_html(F.col("html"))).alias("n_chars"))


@query("captcha_pages", "SELECT page_id, page_id % 3 <> 0 AND regexp_matches(lower(said), 'captcha|access denied|cloudflare|turnstile|verify you are human|security check') AS blocked FROM (SELECT page_id, html || CASE page_id % 7 WHEN 1 THEN '<p>Checked by CloudFlare</p>' WHEN 2 THEN '<p>Verify you are human</p>' WHEN 4 THEN '<div class=cf-TURNSTILE>' WHEN 5 THEN 'Security check' ELSE '' END AS said FROM pages)")
def captcha_pages(spark, d):
    """A page that was served, but asks for a proof."""
    k = F.col("page_id") % 7
    more = F.when(k == 1, "<p>Checked by CloudFlare</p>").when(k == 2, "<p>Verify you are human</p>").when(k == 4, '<div class=cf-TURNSTILE>').when(k == 5, "Security check").otherwise("")
    return table(spark, d, "pages").select("page_id", text.looks_like_captcha(F.when(F.col("page_id") % 3 == 0, 403).otherwise(200), F.concat("html", more)).alias("blocked"))


@query(
    "page_titles",
    r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INT AS n_links FROM pages""",
)
def page_titles(spark, d):
    """Fields taken out of crawled markup by pattern."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.size(links).alias("n_links"))


@query("tagged_text", "SELECT conv_id, turn, trim(text) AS query, trim(role) AS thought, true AS well_formed FROM conversations WHERE role = 'user'")
def tagged_text(spark, d):
    said = F.concat(F.lit("<think> "), F.col("role"), F.lit(" </think>\n<query>"), F.col("text"), F.lit("</query>"))
    rows = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", said.alias("t"))
    return rows.select("conv_id", "turn", text.tagged(F.col("t"), "query").alias("query"), text.tagged(F.col("t"), "think").alias("thought"), F.col("t").rlike(r"(?s)<think>.*</think>.*<query>.*</query>").alias("well_formed"))


@query("fenced_json", "SELECT conv_id, turn, turn::INT AS score, role AS verdict FROM conversations WHERE role <> 'system'")
def fenced_json(spark, d):
    """A model's JSON answer out of its Markdown fence, with defaults."""
    said = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("turn").cast("int").alias("score"), F.col("role").alias("verdict"))), F.lit("\n```"))
    rows = table(spark, d, "conversations").filter("role <> 'system'").select("conv_id", "turn", F.from_json(text.without_fences(said), "score int, verdict string").alias("j"))
    return rows.select("conv_id", "turn", F.coalesce("j.score", F.lit(1)).alias("score"), F.coalesce("j.verdict", F.lit("exact")).alias("verdict"))


@query("row_hash", "SELECT p_partkey, sha256(p_partkey || '|' || p_name || '|' || printf('%.4f', p_retailprice) || '|' || p_size) AS hash FROM part")
def row_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", text.row_hash(F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_retailprice"), F.col("p_size")).alias("hash"))


@query(
    "magic_mime",
    "SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/avif' END AS mime, CASE vec_id % 6 WHEN 1 THEN 600 WHEN 2 THEN 350 END::INT AS width, CASE vec_id % 6 WHEN 1 THEN 400 WHEN 2 THEN 350 END::INT AS height FROM embeddings",
)
def magic_mime(spark, d):
    """Kinds and sizes of images from their first bytes."""
    heads = ("FFD8FFE000104A46", "89504E470D0A1A0A0000000D494844520000025800000190", "4749463839615E015E01", "52494646000000005745425056503820", "0000001C6674797061766966", "3C68746D6C3E")
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("vec_id") % 6).cast("int") + 1))
    rows = table(spark, d, "embeddings").select("vec_id", head.alias("h"))
    size = text.image_dimensions(F.col("h"))
    return rows.select("vec_id", text.mime_by_magic(F.col("h")).alias("mime"), size["width"].alias("width"), size["height"].alias("height"))


@query("data_uris", "SELECT p_partkey, 'data:image/png;base64,' || base64(encode(p_name)) AS uri, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def data_uris(spark, d):
    return table(spark, d, "part").select("p_partkey", text.data_uri(F.lit("image/png"), F.encode("p_name", "UTF-8")).alias("uri"), text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("utf8_rows", "SELECT o_orderkey, o_orderkey || ',' || o_orderstatus || ',' || chr(39) || o_orderpriority AS row FROM orders")
def utf8_rows(spark, d):
    """Rows as lists of text, a value that could be a formula behind an apostrophe."""
    values = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.concat(F.lit("'"), F.col("o_orderpriority")))
    return table(spark, d, "orders").filter(F.is_valid_utf8("o_orderpriority")).select("o_orderkey", F.array_join(values, ",").alias("row"))


@query("trace_headers", "SELECT event_id, '00-' || md5(event_id::VARCHAR) || '-' || substr(md5('s' || event_id), 1, 16) || '-01' AS traceparent, 'user.id=' || user_id AS baggage FROM events")
def trace_headers(spark, d):
    """Trace and baggage headers; ids come from the key so that a retry has the same."""
    k = F.col("event_id").cast("string")
    return table(spark, d, "events").select("event_id", F.concat_ws("-", F.lit("00"), F.md5(k), F.substring(F.md5(F.concat(F.lit("s"), k)), 1, 16), F.lit("01")).alias("traceparent"), F.concat(F.lit("user.id="), F.col("user_id").cast("string")).alias("baggage"))


@query("metric_display", "SELECT p_partkey, printf('%.1f', p_size * 1.2) || CASE WHEN p_size % 2 = 0 THEN 'g' ELSE 'ml' END AS shown FROM part")
def metric_display(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.format_string("%.1f", F.col("p_size") * 1.2), F.when(F.col("p_size") % 2 == 0, "g").otherwise("ml")).alias("shown"))


@query(
    "turtle_lines",
    """SELECT n_nationkey, '<nation/' || n_nationkey || '> <name> "' || n_name || '" ; <in> <region/' || n_regionkey || '> .' AS line FROM nation""",
)
def turtle_lines(spark, d):
    """Graph nodes in Turtle."""
    return table(spark, d, "nation").select("n_nationkey", F.format_string('<nation/%d> <name> "%s" ; <in> <region/%d> .', "n_nationkey", "n_name", "n_regionkey").alias("line"))


@query(
    "hierarchy_path",
    """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN r_name WHEN n_nationkey % 3 = 1 THEN r_name ELSE 'unknown' END AS level1, CASE WHEN n_nationkey % 3 < 2 THEN n_name ELSE 'nation?' END AS level2 FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def hierarchy_path(spark, d):
    """Two levels: the first matched, else inferred from the second, else the input stays."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    k = F.col("n_nationkey")
    asked = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.when(k % 3 == 0, F.lower("r_name")).when(k % 3 == 1, "").otherwise("unknown").alias("l1"), F.when(k % 3 < 2, F.lower("n_name")).otherwise("nation?").alias("l2"))
    one = r.select(F.lower("r_name").alias("l1"), F.col("r_name").alias("found1"))
    two = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("n_name").alias("l2"), F.col("n_name").alias("found2"), F.col("r_name").alias("over2"))
    out = asked.join(one, "l1", "left").join(two, "l2", "left")
    return out.select("n_nationkey", F.coalesce("found1", "over2", "l1").alias("level1"), F.coalesce("found2", "l2").alias("level2"))


_NAMES = """b AS (SELECT p_name AS brand, min(p_partkey) AS place, string_split(p_name, ' ') AS w FROM part GROUP BY p_name),
    s AS (SELECT brand, place, trim(lower(x)) AS syn FROM b, unnest([upper(brand), ' ' || w[2] || ' ', brand[1:2], w[1] || '&' || w[2]]) u(x)),
    n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'Ear' || w[2] || 's for ' || w[1][1:2] WHEN 2 THEN w[1] || '-' || w[2] || 'X' WHEN 3 THEN 'set of ' || p_name[1:2] || '!' WHEN 4 THEN w[1] || '&' || upper(w[2]) ELSE 'A' || w[1] || ' b' END AS name
      FROM (SELECT *, string_split(p_name, ' ') AS w FROM part))"""


@query(
    "brand_in_name",
    f"""WITH {_NAMES},
    d AS (SELECT name, string_split(trim(regexp_replace(lower(name), '[^a-z0-9_]+', ' ', 'g')), ' ') AS words FROM (SELECT DISTINCT name FROM n)),
    f AS (SELECT name, arg_min(brand, (place, brand)) AS found FROM d JOIN s ON CASE WHEN length(syn) > 2 THEN contains(lower(name), syn) ELSE list_contains(words, syn) END GROUP BY name)
    SELECT n.p_partkey, n.name, found FROM n LEFT JOIN f ON f.name = n.name""",
)
def brand_in_name(spark, d):
    """The first brand of a table whose name, second word, joined words or (as a word of its own) first two letters a product name holds; names in other cases, with affixes and punctuation."""
    p = table(spark, d, "part").withColumn("w", F.split("p_name", " "))
    one, two, short = F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.substring("p_name", 1, 2)
    said = [F.upper("p_name"), F.concat(F.lit("Ear"), two, F.lit("s for "), F.substring(one, 1, 2)), F.concat(one, F.lit("-"), two, F.lit("X")), F.concat(F.lit("set of "), short, F.lit("!")), F.concat(one, F.lit("&"), F.upper(two)), F.concat(F.lit("A"), one, F.lit(" b"))]
    names = p.select("p_partkey", F.get(F.array(*said), (F.col("p_partkey") % 6).cast("int")).alias("name"))
    listed = F.array(F.upper("p_name"), F.concat(F.lit(" "), two, F.lit(" ")), short, F.concat(one, F.lit("&"), two))
    vocabulary = p.groupBy(F.col("p_name").alias("brand"), listed.alias("synonyms")).agg(F.min("p_partkey").alias("order"))
    return brands.first_brand(names, vocabulary, "name", "found")


@query("brand_from_start", "SELECT p_partkey, CASE WHEN string_split(p_name, ' ')[1] IN ('new', 'old') THEN string_split(p_name, ' ')[2] ELSE string_split(p_name, ' ')[1] END AS brand FROM part")
def brand_from_start(spark, d):
    """The first word that isn't to be skipped."""
    words = F.filter(F.split("p_name", " "), lambda w: ~w.isin("new", "old") & (F.length(w) > 2))
    return table(spark, d, "part").select("p_partkey", F.get(words, F.lit(0)).alias("brand"))


@query("first_mention_rank", "SELECT p_name, count(*) AS n, dense_rank() OVER (ORDER BY count(*) DESC) AS rank FROM part GROUP BY p_name")
def first_mention_rank(spark, d):
    """Extension: dense ranks of a count, from a numbering of its distinct values: no window without a partition."""
    n = table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    ranks = ranking.numbered(n.select("n").distinct(), -F.col("n"), "rank")
    return n.join(ranks, "n").select("p_name", "n", "rank")


@query(
    "image_heads",
    """WITH p AS (SELECT p_partkey, p_size * 31 AS w, p_size * 17 + 1 AS h, p_partkey % 4 AS k FROM part)
    SELECT p_partkey, CASE k WHEN 3 THEN NULL WHEN 2 THEN h ELSE w END::INT AS width, CASE k WHEN 3 THEN NULL WHEN 2 THEN w ELSE h END::INT AS height FROM p""",
)
def image_heads(spark, d):
    """Width and height from the first bytes of PNG and JPEG files, one of them turned by its orientation tag; nulls for others."""
    k, w, h = F.col("p_partkey") % 4, F.col("p_size") * 31, F.col("p_size") * 17 + 1
    two = lambda c: F.lpad(F.hex(c), 4, "0")
    frame = F.concat(F.lit("FFC0001108"), two(h), two(w), F.lit("03" + "00" * 9))
    exif = "45786966000049492A0008000000" + "0100" + "1201030001000000" + "06000000"
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(w), 8, "0"), F.lpad(F.hex(h), 8, "0"))
    digits = F.when(k == 0, png).when(k == 1, F.concat(F.lit("FFD8FFE00004AAAA"), frame)).when(k == 2, F.concat(F.lit(f"FFD8FFE1{len(exif) // 2 + 2:04X}{exif}"), frame)).otherwise(F.lit("00112233"))
    heads = table(spark, d, "part").select("p_partkey", F.unhex(digits).alias("c"))
    sizes = heads.select("p_partkey", text.image_dimensions(F.col("c")).alias("a"), images.jpeg_dimensions(F.col("c")).alias("b"))
    return sizes.select("p_partkey", F.coalesce("a.width", "b.width").alias("width"), F.coalesce("a.height", "b.height").alias("height"))


def _letters(texts: pd.Series) -> np.ndarray:
    """Counts of a to z in each text."""
    return np.array([[t.count(chr(97 + i)) for i in range(26)] for t in texts], dtype=float).reshape(-1, 26)


@query(
    "model_ports",
    """WITH m AS (SELECT regr_slope(p_retailprice, p_size) AS slope, regr_intercept(p_retailprice, p_size) AS base FROM part),
    t AS (SELECT p_partkey, p_size, p_retailprice, [length(p_name) - length(replace(p_name, chr(97 + i::INT), '')) FOR i IN range(0, 26)]::DOUBLE[] AS a, [length(p_type) - length(replace(lower(p_type), chr(97 + i::INT), '')) FOR i IN range(0, 26)]::DOUBLE[] AS b FROM part)
    SELECT p_partkey, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) AS visual, CASE WHEN p_size % 7 = 0 THEN 1 ELSE round(greatest(0, 1 - abs(p_retailprice - base - slope * p_size) / p_retailprice), 6) END::DOUBLE AS judge, 1::DOUBLE AS logo FROM t, m""",
)
def model_ports(spark, d):
    """Models behind ports: letters of two texts compared, and a price judged by a line that is fitted to the table; the judge has no answer for some sizes, and no model reads logos, so the ports' defaults stand."""
    part = table(spark, d, "part")
    slope, base = part.agg(F.regr_slope("p_retailprice", "p_size"), F.regr_intercept("p_retailprice", "p_size")).first()

    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = _letters(a), _letters(b.str.lower())
        return pd.Series((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))).round(6)

    def judged(price: pd.Series, size: pd.Series) -> pd.Series:
        score = (1 - (price - base - slope * size).abs() / price).clip(lower=0).round(6)
        return score.where(size % 7 != 0)

    models = {"visual_similarity": alike, "adjudicate": judged}
    for name, model in models.items():
        ports.register(name, model)
    try:
        visual, judge, logo = ports.call("visual_similarity", F.col("p_name"), F.col("p_type")), ports.call("adjudicate", F.col("p_retailprice"), F.col("p_size")), ports.call("detect_logo", F.col("p_name"))
    finally:
        for name in models:
            ports.register(name, None)
    return part.select("p_partkey", visual.alias("visual"), judge.alias("judge"), logo.alias("logo"))
