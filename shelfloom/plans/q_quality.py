"""Quality, freshness, trust, nutrition, prices and margins over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfloom.functions import scoring, text, vectors
from shelfloom.operators import catalog, pricing, quality
from shelfloom.plans.registry import query
from shelfloom.sources.tables import table


@query(
    "null_rate",
    """WITH r AS (SELECT CASE WHEN event_id % 7 <> 0 THEN value END AS a, CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN '' ELSE event_type END AS b, CASE WHEN event_id % 3 = 0 THEN [] ELSE [event_type] END AS c FROM events)
    SELECT round(100.0::DOUBLE * (count(*) FILTER (a IS NULL) + count(*) FILTER (b = '') + count(*) FILTER (len(c) = 0)) / (count(*) * 3), 2) AS null_rate FROM r""",
)
def null_rate(spark, d):
    """Nulls, empty texts and empty lists; blanks are values."""
    k = F.col("event_id")
    text = F.when(k % 5 == 0, " ").when(k % 5 == 1, "").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select(F.when(k % 7 != 0, F.col("value")).alias("a"), text.alias("b"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("c"))
    return quality.null_rate(rows, ["a", "b", "c"])


@query(
    "quality_audit",
    """WITH n AS (SELECT round(100.0::DOUBLE * (count(*) FILTER (value > 200) + count(*) FILTER (event_type = 'view')) / (2 * count(*)), 2) AS null_rate FROM events)
    SELECT null_rate, true AS drift, false AS captcha, false AS passed, CASE WHEN null_rate > 5 THEN 'null rate,' ELSE '' END || 'missing columns: barcode' AS reasons FROM n""",
)
def quality_audit(spark, d):
    """Blank cells over five per cent, expected columns that the data lacks, and a captcha in place of a page; each failure with its reason."""
    rows = table(spark, d, "events").select(F.when(F.col("value") <= 200, F.col("value")).alias("price"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("name"))
    return quality.audit(rows, ["price", "name"], ["price", "name", "barcode"], F.lit(200), F.lit("<html>a list of products</html>"))


@query("catalog_error_rates", "SELECT l_returnflag, round(100.0::DOUBLE * count(*) FILTER (l_quantity > 45) / count(*), 2) AS cer, round(100.0::DOUBLE * count(*) FILTER (l_tax > 0.07) / count(*), 2) AS e1 FROM lineitem GROUP BY 1")
def catalog_error_rates(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 45).alias("bad"), F.count_if(F.col("l_tax") > 0.07).alias("values"))
    return n.select("l_returnflag", quality.error_rate(F.col("bad"), F.col("n")).alias("cer"), quality.error_rate(F.col("values"), F.col("n")).alias("e1"))


@query("combined_loss", "SELECT o_custkey, round(1 - product(1 - greatest(0::DOUBLE, least(1::DOUBLE, o_totalprice / 5000000))), 4) AS loss FROM orders GROUP BY 1")
def combined_loss(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(quality.combined_loss(F.col("o_totalprice") / 5000000).alias("loss"))


@query(
    "purity_report",
    """WITH n AS (SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 48) AS bad, count(*) FILTER (p_size = 1) AS missing, count(*) FILTER (p_retailprice > 1090) AS norm, round(1 - product(1 - greatest(0::DOUBLE, least(1::DOUBLE, p_size / 10000.0::DOUBLE))), 4) AS loss FROM part GROUP BY 1)
    SELECT p_brand, round(100.0::DOUBLE * bad / n, 2) AS cer, round(100.0::DOUBLE * missing / greatest(1, n), 2) AS e2, round(100.0::DOUBLE * norm / greatest(1, n), 2) AS e3, loss, round(100 * (1 - loss), 2) AS purity,
      round(100.0::DOUBLE * bad / n, 2) <= 1.5 AND missing = 0 AND round(100.0::DOUBLE * norm / greatest(1, n), 2) <= 2 AS compliant FROM n""",
)
def purity_report(spark, d):
    n = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 48).alias("bad"), F.count_if(F.col("p_size") == 1).alias("missing"), F.count_if(F.col("p_retailprice") > 1090).alias("norm"), quality.combined_loss(F.col("p_size") / 10000.0).alias("loss"))
    rate = lambda c: quality.error_rate(F.col(c), F.col("n"))
    out = n.select("p_brand", rate("bad").alias("cer"), rate("missing").alias("e2"), rate("norm").alias("e3"), "loss", scoring.purity(F.col("loss")).alias("purity"))
    return out.withColumn("compliant", (F.col("cer") <= 1.5) & (F.col("e2") == 0) & (F.col("e3") <= 2))


@query("importance_score", "WITH n AS (SELECT p_brand, count(*) AS r, count(DISTINCT p_type) AS c, count(DISTINCT p_size) AS k FROM part GROUP BY 1) SELECT p_brand, round(200 * (r::DOUBLE / max(r) OVER ()) * c * 0.1::DOUBLE + 7 * 10 + 3 * k, 2) AS score FROM n")
def importance_score(spark, d):
    n = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("r"), F.countDistinct("p_type").alias("c"), F.countDistinct("p_size").alias("k"))
    top = n.agg(F.max("r").alias("most"))
    return n.crossJoin(F.broadcast(top)).select("p_brand", scoring.importance(F.col("r"), F.col("most"), F.col("c"), F.lit(10), F.col("k")).alias("score"))


@query(
    "freshness_sli",
    """WITH l AS (SELECT user_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6 AS lag_s FROM events)
    SELECT count(lag_s) AS n, round(100.0::DOUBLE * count(*) FILTER (lag_s <= 36000) / count(lag_s), 4) AS sli, round(100.0::DOUBLE * count(*) FILTER (lag_s <= 36000) / count(lag_s), 4) >= 99.95 AS meets_slo, round(avg(lag_s), 3) AS mean_lag FROM l""",
)
def freshness_sli(spark, d):
    """Share of gaps between a user's events within ten hours."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    lag = seconds - F.lag(seconds).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    x = table(spark, d, "events").select(lag.alias("lag_s"))
    n = x.agg(F.count("lag_s").alias("n"), F.count_if(F.col("lag_s") <= 36000).alias("good"), F.round(F.avg("lag_s"), 3).alias("mean_lag"))
    return n.withColumn("sli", F.round(F.when(F.col("n") > 0, 100.0 * F.col("good") / F.col("n")).otherwise(100.0), 4)).select("n", "sli", (F.col("sli") >= 99.95).alias("meets_slo"), "mean_lag")


@query("lag_decomposition", "SELECT event_id, round(greatest(0, value), 3) AS ingest, round(greatest(0, value * 2 - value), 3) AS process, round(greatest(0, user_id - value * 2), 3) AS publish FROM events")
def lag_decomposition(spark, d):
    """Four timestamps to three lags, none under zero."""
    t0, t1, t2, t3 = F.lit(0.0), F.col("value"), F.col("value") * 2, F.col("user_id").cast("double")
    gap = lambda a, b: F.round(F.greatest(F.lit(0.0), b - a), 3)
    return table(spark, d, "events").select("event_id", gap(t0, t1).alias("ingest"), gap(t1, t2).alias("process"), gap(t2, t3).alias("publish"))


@query(
    "failure_breaker",
    """WITH r AS (SELECT user_id, event_id, count(*) OVER w AS attempts, count(*) FILTER (event_type IN ('error', 'signup')) OVER w AS fails FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, min(event_id) AS tripped_at FROM r WHERE attempts >= 10 AND fails::DOUBLE / attempts >= 0.5 GROUP BY user_id""",
)
def failure_breaker(spark, d):
    """Where the running failure rate of at least ten attempts first reaches the limit."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, d, "events").select("user_id", "event_id", F.count("*").over(w).alias("attempts"), F.sum(F.col("event_type").isin("error", "signup").cast("int")).over(w).alias("fails"))
    return r.filter("attempts >= 10 and fails / attempts >= 0.5").groupBy("user_id").agg(F.min("event_id").alias("tripped_at"))


@query(
    "proxy_trust",
    """WITH n AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS s, count(*) FILTER (event_type = 'error') AS f, count(*) FILTER (event_type = 'error' AND value > 60) AS soft FROM events GROUP BY 1)
    SELECT user_id, round(greatest(0, least(1, (s + 2)::DOUBLE / (s + f + 3) - 0.25::DOUBLE * soft)), 4) AS trust, round(greatest(0, least(1, (s + 2)::DOUBLE / (s + f + 3) - 0.25::DOUBLE * soft)), 4) < 0.35 OR soft >= 3 AS quarantined FROM n""",
)
def proxy_trust(spark, d):
    failed = F.col("event_type") == "error"
    n = table(spark, d, "events").groupBy("user_id").agg(F.count_if(~failed).alias("s"), F.count_if(failed).alias("f"), F.count_if(failed & (F.col("value") > 60)).alias("soft"))
    out = n.withColumn("trust", quality.trust(F.col("s"), F.col("f"), F.col("soft")))
    return out.select("user_id", "trust", ((F.col("trust") < 0.35) | (F.col("soft") >= 3)).alias("quarantined"))


@query(
    "conformal_threshold",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, value AS threshold FROM r WHERE r = least(n, ceil(round(least(1, ceil(round(0.95::DOUBLE * (n + 1), 9)) / n) * n, 9)))""",
)
def conformal_threshold(spark, d):
    return quality.conformal_quantile(table(spark, d, "events").select("event_type", "value"), "value", ["event_type"], 0.05)


@query("bulk_change_failsafe", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS affected, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 6) AS share FROM orders")
def bulk_change_failsafe(spark, d):
    """The counts of a change that is let through; one over the limit raises."""
    n = table(spark, d, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("affected"))
    checked = n.withColumn("stop", quality.failsafe(F.col("affected"), F.col("total")))
    return checked.filter(F.col("stop").isNull()).select("total", "affected", F.round(F.col("affected") / F.col("total"), 6).alias("share"))


@query(
    "price_error_three_sigma",
    """WITH s AS (SELECT l_partkey, avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd, count(*) AS n, min(l_extendedprice) AS price FROM lineitem GROUP BY 1)
    SELECT l_partkey, n, n >= 3 AND sd > 0 AND price - mu < -3 * sd AS is_error FROM s""",
)
def price_error_three_sigma(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("mu"), F.stddev_pop("l_extendedprice").alias("sd"), F.count("*").alias("n"), F.min("l_extendedprice").alias("price"))
    return s.select("l_partkey", "n", pricing.three_sigma(F.col("price"), F.col("mu"), F.col("sd"), F.col("n")).alias("is_error"))


@query(
    "fake_promotions",
    """WITH p AS (SELECT l_partkey AS k, date_diff('day', l_shipdate::DATE, DATE '2003-01-01') AS days_ago, min(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY ALL),
    w AS (SELECT k, days_ago, price, lead(price, 1) OVER w AS p1, lead(price, 2) OVER w AS p2, lead(days_ago, 2) OVER w AS d2 FROM p WINDOW w AS (PARTITION BY k ORDER BY days_ago DESC, price))
    SELECT k, coalesce(bool_or(days_ago - d2 <= 14 AND p1 >= 1.25 * price AND p2 <= 1.05 * price), false) AS fake FROM w GROUP BY k""",
)
def fake_promotions(spark, d):
    days = F.datediff(F.lit("2003-01-01").cast("date"), F.col("l_shipdate").cast("date"))
    p = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k"), days.alias("days_ago")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return pricing.fake_promotions(p, "k", "days_ago", "price")


@query("pearson_by_supplier", "SELECT l_suppkey, CASE WHEN count(*) >= 3 THEN round(corr(l_extendedprice, l_quantity), 4) END AS r FROM lineitem GROUP BY 1")
def pearson_by_supplier(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(pricing.pearson("l_extendedprice", "l_quantity").alias("r"))


@query(
    "pricing_audit",
    """WITH h AS (SELECT l_partkey, date_diff('day', l_shipdate::DATE, DATE '2003-01-01') AS days_ago, min(l_extendedprice / l_quantity) AS price, avg(l_tax) AS peer FROM lineitem GROUP BY ALL),
    w AS (SELECT *, lead(price, 1) OVER o AS p1, lead(price, 2) OVER o AS p2, lead(days_ago, 2) OVER o AS d2, row_number() OVER (PARTITION BY l_partkey ORDER BY days_ago) AS k FROM h WINDOW o AS (PARTITION BY l_partkey ORDER BY days_ago DESC, price)),
    s AS (SELECT l_partkey, avg(price) FILTER (k > 1) AS mu, stddev_pop(price) FILTER (k > 1) AS sd, count(*) FILTER (k > 1) AS n, max(price) FILTER (k = 1) AS price, coalesce(bool_or(days_ago - d2 <= 14 AND p1 >= 1.25 * price AND p2 <= 1.05 * price), false) AS fake,
      CASE WHEN count(*) >= 3 THEN round(corr(price, peer), 4) END AS r FROM w GROUP BY 1)
    SELECT l_partkey, CASE WHEN s.price < 0.9::DOUBLE * p_retailprice THEN 'MAP_VIOLATION' WHEN n >= 3 AND sd > 0 AND s.price - mu < -3 * sd THEN 'PRICING_ERROR' WHEN fake THEN 'FAKE_PROMOTION' WHEN r >= 0.95 THEN 'COLLUSION' ELSE 'NORMAL' END AS verdict FROM s JOIN part ON p_partkey = l_partkey""",
)
def pricing_audit(spark, d):
    """The first that holds of a last price under the floor, an outlier of the history, a fake promotion and collusion."""
    days = F.datediff(F.lit("2003-01-01").cast("date"), F.col("l_shipdate").cast("date"))
    h = table(spark, d, "lineitem").groupBy("l_partkey", days.alias("days_ago")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.avg("l_tax").alias("peer"))
    s = pricing.audit(h, "l_partkey", "days_ago", "price", "peer")
    floor = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (0.9 * F.col("p_retailprice")).alias("floor"))
    return s.join(floor, "l_partkey").select("l_partkey", pricing.pricing_verdict(F.col("price") < F.col("floor"), F.col("sigma"), F.col("fake"), F.col("r")).alias("verdict"))


@query(
    "double_ml_effect",
    """WITH m AS (SELECT count(*) AS n, sum(l_extendedprice * l_tax) AS yx, sum(l_quantity * l_tax) AS tx, sum(l_tax * l_tax) AS xx, sum(l_extendedprice * l_quantity) AS yt, sum(l_quantity * l_quantity) AS tt FROM lineitem)
    SELECT n, round((yt - yx * tx / xx) / (tt - tx * tx / xx), 3) AS theta FROM m""",
)
def double_ml_effect(spark, d):
    return pricing.double_ml(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "l_tax").select("n", F.round("theta", 3).alias("theta"))


@query("demand_posterior", "SELECT l_quantity AS price, sum(l_linenumber) + 2 AS alpha, count(*) + 1 AS beta, round((sum(l_linenumber) + 2)::DOUBLE / (count(*) + 1), 6) AS mean FROM lineitem GROUP BY 1")
def demand_posterior(spark, d):
    return pricing.demand_posterior(table(spark, d, "lineitem"), "l_quantity", "l_linenumber").withColumnRenamed("l_quantity", "price")


@query(
    "price_pick",
    """WITH p AS (SELECT l_suppkey, 80 + 10 * (l_linenumber - 1) AS price, sum(l_quantity) + 2 AS a, count(*) + 1 AS b FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL),
    u AS (SELECT l_suppkey, price, (price - 50) * (0.5::DOUBLE * a / b + 0.5::DOUBLE * 100 * pow(1 - (price - 70) / 60.0::DOUBLE, 2)) AS gain FROM p),
    w AS (SELECT l_suppkey, arg_max(price, (round(gain, 6), -price)) AS pick FROM u GROUP BY 1)
    SELECT l_suppkey, pick, round(greatest(70, least(130, greatest(95::DOUBLE, least(105::DOUBLE, pick)))), 2) AS price FROM w""",
)
def price_pick(spark, d):
    """Margin times demand, the posterior mean in place of a draw; a step of at most 5 % from 100, inside floor and ceiling."""
    price = 80 + 10 * (F.col("l_linenumber") - 1)
    p = table(spark, d, "lineitem").filter("l_linenumber <= 5").groupBy("l_suppkey", price.alias("price")).agg((F.sum("l_quantity") + 2).alias("a"), (F.count("*") + 1).alias("b"))
    gain = (F.col("price") - 50) * (0.5 * F.col("a") / F.col("b") + 0.5 * 100 * F.pow(1 - (F.col("price") - 70) / 60.0, F.lit(2.0)))
    w = p.groupBy("l_suppkey").agg(F.max_by("price", F.struct(F.round(gain, 6), -F.col("price"))).alias("pick"))
    return w.select("l_suppkey", F.col("pick").cast("bigint").alias("pick"), F.round(F.greatest(F.lit(70.0), F.least(F.lit(130.0), F.greatest(F.lit(95.0), F.least(F.lit(105.0), F.col("pick").cast("double"))))), 2).alias("price"))


@query("landed_cost", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.01, round(l_extendedprice - floor(l_extendedprice * l_discount) - 5 + floor(l_tax * 1000), 2)) AS landed, l_quantity <= 2 AS defend FROM lineitem")
def landed_cost(spark, d):
    p = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scoring.landed_cost(p, F.floor(p * F.col("l_discount")), F.lit(5), F.floor(F.col("l_tax") * 1000)).alias("landed"), scoring.defend_price(F.col("l_quantity")).alias("defend"))


@query(
    "contribution_margins",
    """WITH s AS (SELECT p_type, round(sum(l_extendedprice), 2) AS r, round(sum(l_extendedprice * l_discount), 2) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT p_type, round((r - 0.4::DOUBLE * r - x) / r * 100, 2) AS cm1_pct, round((r - 0.4::DOUBLE * r - x - (0.05::DOUBLE * r + 100)) / r * 100, 2) AS cm2_pct, round((r - 0.4::DOUBLE * r - x - (0.05::DOUBLE * r + 100) - (0.1::DOUBLE * r + x)) / r * 100, 2) AS cm3_pct,
      (r - 0.4::DOUBLE * r - x - (0.05::DOUBLE * r + 100) - (0.1::DOUBLE * r + x)) / r * 100 >= 20 AS healthy FROM s""",
)
def contribution_margins(spark, d):
    """Three stages of margin by kind of product."""
    j = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice", "l_discount").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    s = j.groupBy("p_type").agg(F.round(F.sum("l_extendedprice"), 2).alias("r"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("x"))
    r, x = F.col("r"), F.col("x")
    m = scoring.margins(r, [0.4 * r, x], [0.05 * r, F.lit(100.0)], [0.1 * r, x], F.lit("default"))
    return s.select("p_type", m.alias("m")).select("p_type", "m.cm1_pct", "m.cm2_pct", "m.cm3_pct", "m.healthy")


@query(
    "package_drift",
    """WITH s AS (SELECT p_partkey, 0.70 + (p_partkey % 30) / 100.0::DOUBLE AS sim FROM part), t AS (SELECT *, round(greatest(0, least(1, 1 - sim)), 4) AS drift, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 'IMMEDIATE_ESCALATION' WHEN p_partkey % 7 = 0 THEN 'TECHNICAL_REVIEW_HOLD' WHEN 1 - sim >= 0.15 THEN 'SCHEDULED_QUEUE' ELSE 'NO_DRIFT' END AS risk FROM s)
    SELECT p_partkey, drift, risk, risk = 'IMMEDIATE_ESCALATION' AS rollback FROM t""",
)
def package_drift(spark, d):
    k = F.col("p_partkey")
    x = scoring.package_drift(0.70 + (k % 30) / 100.0, k % 11 == 0, k % 13 == 0, k % 7 == 0)
    return table(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.drift", "x.risk", "x.rollback")


@query(
    "nutrition_verify",
    """WITH n AS (SELECT p_partkey, (p_partkey % 12)::DOUBLE AS p, (p_partkey % 30)::DOUBLE AS c, (p_partkey % 5)::DOUBLE AS df, (p_partkey % 9)::DOUBLE AS f, (p_partkey % 40 * 10)::DOUBLE AS kcal FROM part), e AS (SELECT *, round(4 * p + 4 * greatest(0, c - df) + 9 * f + 2 * df, 2) AS est FROM n),
    v AS (SELECT *, CASE WHEN kcal > 0 THEN abs(kcal - est) / kcal * 100 WHEN est = 0 THEN 0 ELSE 100 END AS dev, p + c + f <= 30 * 1.02::DOUBLE AS mass FROM e),
    g AS (SELECT *, CASE WHEN kcal > 335 THEN 4 WHEN kcal > 167 THEN 2 ELSE 0 END + CASE WHEN c > 13.5 THEN 4 WHEN c > 4.5 THEN 2 ELSE 0 END + CASE WHEN f > 4 THEN 4 WHEN f > 1 THEN 2 ELSE 0 END - CASE WHEN p > 4.8 THEN 3 WHEN p > 1.6 THEN 1 ELSE 0 END - CASE WHEN df > 3.5 THEN 3 WHEN df > 0.9 THEN 1 ELSE 0 END AS pts FROM v)
    SELECT p_partkey, est AS estimated, round(dev, 2) AS deviation, mass AS mass_ok, dev <= 5 AND mass AS valid, CASE WHEN pts <= -1 THEN 'A' WHEN pts <= 2 THEN 'B' WHEN pts <= 10 THEN 'C' ELSE 'D' END AS grade FROM g""",
)
def nutrition_verify(spark, d):
    k = F.col("p_partkey")
    n = table(spark, d, "part").select("p_partkey", *[(k % m).cast("double").alias(c) for c, m in (("p", 12), ("c", 30), ("df", 5), ("f", 9))], (k % 40 * 10).cast("double").alias("kcal"))
    x = scoring.nutrition_check(F.col("kcal"), F.col("p"), F.col("c"), F.col("df"), F.col("f"), F.lit(0.0), F.lit(30.0), F.lit("g"))
    return n.withColumn("x", x).select("p_partkey", "x.estimated", "x.deviation", "x.mass_ok", "x.valid", scoring.nutri_score(F.col("kcal"), F.col("c"), F.col("f"), F.col("p"), F.col("df")).alias("grade"))


@query(
    "fusion_decision",
    """WITH s AS (SELECT vec_id, abs(embedding[1])::DOUBLE * 4 AS v, 0.6 + abs(embedding[2])::DOUBLE * 2 AS o, CASE WHEN vec_id % 5 = 0 THEN 0.7 ELSE 1.0 END::DOUBLE AS j FROM embeddings), f AS (SELECT vec_id, round((0.4::DOUBLE * least(1, v) + 0.6::DOUBLE * least(1, o)) * j, 4) AS score FROM s)
    SELECT vec_id, score, CASE WHEN score >= 0.88 THEN 'AUTO_APPROVE' WHEN score >= 0.65 THEN 'MANUAL_REVIEW' ELSE 'AUTO_REJECT' END AS decision FROM f""",
)
def fusion_decision(spark, d):
    e = lambda i: F.abs(F.element_at(vectors.doubles(F.col("embedding")), i))
    s = table(spark, d, "embeddings").select("vec_id", scoring.fusion(e(1) * 4, 0.6 + e(2) * 2, F.when(F.col("vec_id") % 5 == 0, 0.7).otherwise(1.0)).alias("score"))
    return s.withColumn("decision", scoring.fusion_decision(F.col("score")))


@query(
    "box_iou",
    """WITH b AS (SELECT p_partkey, p_size % 20 AS x, p_size % 15 AS y, 60 + p_size AS w, 80 AS h FROM part), i AS (SELECT *, greatest(0, least(10 + 100, x + w) - greatest(10, x)) * greatest(0, least(10 + 100, y + h) - greatest(10, y)) AS s FROM b)
    SELECT p_partkey, round(s::DOUBLE / (10000 + w * h - s), 4) AS iou FROM i""",
)
def box_iou(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", scoring.iou(F.array(*[F.lit(x) for x in (10, 10, 100, 100)]), F.array(s % 20, s % 15, 60 + s, F.lit(80))).alias("iou"))


@query(
    "volume_grounding",
    """WITH v AS (SELECT p_partkey, (5 + p_size)::DOUBLE AS l, (5 + p_size % 10)::DOUBLE AS w, 10.0::DOUBLE AS h, p_retailprice AS c FROM part) SELECT p_partkey, round(l * w * h * 0.88::DOUBLE, 2) AS measured, round(l * w * h * 0.88::DOUBLE / (c + 1e-8), 3) AS gamma, CASE WHEN l * w * h * 0.88::DOUBLE / (c + 1e-8) > 1.3 THEN 'MULTI_PACK' ELSE 'SINGLE_UNIT' END AS kind FROM v""",
)
def volume_grounding(spark, d):
    s = F.col("p_size")
    x = scoring.volume_grounding((5 + s).cast("double"), (5 + s % 10).cast("double"), F.lit(10.0), F.col("p_retailprice"))
    return table(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.measured", "x.gamma", "x.kind")


_LINEAR = "CASE WHEN {0} / 255 <= 0.04045::DOUBLE THEN {0} / 255 / 12.92::DOUBLE ELSE pow(({0} / 255 + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS {0}"
_ROOT = "CASE WHEN {0} > 0.008856::DOUBLE THEN pow({0}, 1::DOUBLE / 3) ELSE 7.787::DOUBLE * {0} + 16::DOUBLE / 116 END AS {0}"


@query(
    "nearest_colour",
    f"""WITH c AS (SELECT p_partkey, (p_partkey % 256)::DOUBLE AS r, (p_partkey * 7 % 256)::DOUBLE AS g, (p_partkey * 13 % 256)::DOUBLE AS b FROM part),
    n AS (SELECT p_partkey, {_LINEAR.format("r")}, {_LINEAR.format("g")}, {_LINEAR.format("b")} FROM c),
    m AS (SELECT p_partkey, (r * 0.4124564::DOUBLE + g * 0.3575761::DOUBLE + b * 0.1804375::DOUBLE) / 0.95047::DOUBLE AS x, r * 0.2126729::DOUBLE + g * 0.7151522::DOUBLE + b * 0.0721750::DOUBLE AS y, (r * 0.0193339::DOUBLE + g * 0.1191920::DOUBLE + b * 0.9503041::DOUBLE) / 1.08883::DOUBLE AS z FROM n),
    f AS (SELECT p_partkey, {_ROOT.format("x")}, {_ROOT.format("y")}, {_ROOT.format("z")} FROM m),
    p AS (SELECT p_partkey, round(greatest(0, 116 * y - 16), 3) AS l1, round(500 * (x - y), 3) AS a1, round(200 * (y - z), 3) AS b1 FROM f),
    t(target, l2, a2, b2) AS (VALUES (0, 50.0::DOUBLE, 20.0::DOUBLE, -10.0::DOUBLE), (1, 53.2::DOUBLE, 80.1::DOUBLE, 67.2::DOUBLE), (2, 87.7::DOUBLE, -86.2::DOUBLE, 83.2::DOUBLE)),
    s AS (SELECT *, pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) AS c7 FROM p, t),
    g AS (SELECT *, (1.5::DOUBLE - 0.5::DOUBLE * sqrt(c7 / (c7 + pow(25::DOUBLE, 7)))) * a1 AS u1, (1.5::DOUBLE - 0.5::DOUBLE * sqrt(c7 / (c7 + pow(25::DOUBLE, 7)))) * a2 AS u2 FROM s),
    h AS (SELECT *, sqrt(u1 * u1 + b1 * b1) AS c1, sqrt(u2 * u2 + b2 * b2) AS c2, (degrees(atan2(b1, u1)) + 360) % 360 AS h1, (degrees(atan2(b2, u2)) + 360) % 360 AS h2 FROM g),
    d AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS turn,
      CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh, (l1 + l2) / 2 AS ml, (c1 + c2) / 2 AS mc FROM h),
    w AS (SELECT *, (l2 - l1) / (1 + 0.015::DOUBLE * pow(ml - 50, 2) / sqrt(20 + pow(ml - 50, 2))) AS wl, (c2 - c1) / (1 + 0.045::DOUBLE * mc) AS wc,
      2 * sqrt(c1 * c2) * sin(radians(turn / 2)) / (1 + 0.015::DOUBLE * mc * (1 - 0.17::DOUBLE * cos(radians(mh - 30)) + 0.24::DOUBLE * cos(radians(2 * mh)) + 0.32::DOUBLE * cos(radians(3 * mh + 6)) - 0.20::DOUBLE * cos(radians(4 * mh - 63)))) AS wh,
      sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25::DOUBLE, 7))) AS rt FROM d),
    e AS (SELECT p_partkey, target, round(sqrt(greatest(0, wl * wl + wc * wc + wh * wh - rt * wc * wh)), 4) AS delta FROM w)
    SELECT p_partkey, arg_min(target, (delta, target)) AS target, min(delta) AS delta, CASE WHEN min(delta) <= 1 THEN 'EXACT' WHEN min(delta) <= 2 THEN 'CLOSE' ELSE 'OFF' END AS verdict FROM e GROUP BY p_partkey""",
)
def nearest_colour(spark, d):
    """Colours to Lab, and the nearest of three targets by CIEDE2000."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", scoring.lab((k % 256).cast("double"), (k * 7 % 256).cast("double"), (k * 13 % 256).cast("double")).alias("lab"))
    targets = [(50.0, 20.0, -10.0), (53.2, 80.1, 67.2), (87.7, -86.2, 83.2)]
    known = F.array(*[F.struct(F.struct(*[F.lit(v).alias(n) for n, v in zip("lab", t)]).alias("lab"), F.lit(i).alias("target")) for i, t in enumerate(targets)])
    each = rows.select("p_partkey", "lab", F.explode(known).alias("t")).select("p_partkey", scoring.ciede2000(F.col("lab"), F.col("t.lab")).alias("delta"), F.col("t.target").alias("target"))
    best = each.groupBy("p_partkey").agg(F.min(F.struct("delta", "target")).alias("b"))
    delta = F.col("b.delta")
    return best.select("p_partkey", F.col("b.target").alias("target"), delta.alias("delta"), F.when(delta <= 1, "EXACT").when(delta <= 2, "CLOSE").otherwise("OFF").alias("verdict"))


@query(
    "micro_classifier",
    """WITH z AS (SELECT p_partkey, (p_size - 25) / 10.0::DOUBLE * 0.8::DOUBLE + (p_retailprice - 1000) / 50 * -0.3::DOUBLE + 0.1::DOUBLE AS z FROM part) SELECT p_partkey, round(1 / (1 + exp(-z)), 6) AS p, round(1 / (1 + exp(-z)), 6) >= 0.5 AS approved FROM z""",
)
def micro_classifier(spark, d):
    p = F.round(scoring.sigmoid_probability([F.col("p_size"), F.col("p_retailprice")], [25.0, 1000.0], [10.0, 50.0], [0.8, -0.3], 0.1), 6)
    return table(spark, d, "part").select("p_partkey", p.alias("p"), (p >= 0.5).alias("approved"))


@query(
    "size_gates",
    """WITH s AS (SELECT p_partkey, (25 + p_size * 4) * 8 AS w, (50 + p_partkey % 112) * 8 AS h FROM part)
    SELECT p_partkey, w >= 300 AND h >= 300 AND w::DOUBLE / h BETWEEN 0.5 AND 2.0 AS commercial, CASE WHEN w < 300 OR h < 300 THEN 'TOO_SMALL' WHEN w::DOUBLE / h NOT BETWEEN 0.5 AND 2.0 THEN 'BAD_ASPECT' ELSE 'OK' END AS reason,
      CASE WHEN greatest(w, h) >= 1000 AND w::DOUBLE / h BETWEEN 0.8 AND 1.25 THEN round(least(1, greatest(w, h) / 1600.0::DOUBLE), 4) ELSE 0 END::DOUBLE AS score,
      concat_ws(' | ', CASE WHEN greatest(w, h) < 1000 THEN 'low resolution' END, CASE WHEN w::DOUBLE / h NOT BETWEEN 0.8 AND 1.25 THEN 'aspect ratio' END) AS reasons FROM s""",
)
def size_gates(spark, d):
    w, h = (25 + F.col("p_size") * 4) * 8, (50 + F.col("p_partkey") % 112) * 8
    a, b = scoring.size_gate(w, h), scoring.resolution_gate(w, h)
    return table(spark, d, "part").select("p_partkey", a["ok"].alias("commercial"), a["reason"].alias("reason"), b["score"].alias("score"), b["reasons"].alias("reasons"))


@query("expected_score", "WITH p AS (SELECT vec_id, [abs(x) FOR x IN embedding[1:10]::DOUBLE[]] AS p FROM embeddings) SELECT vec_id, round(list_sum([p[i] * i FOR i IN range(1, 11)]) / list_sum(p), 2) AS score FROM p")
def expected_score(spark, d):
    """Mean of a distribution over ten grades."""
    p = F.transform(F.slice(vectors.doubles(F.col("embedding")), 1, 10), F.abs)
    return table(spark, d, "embeddings").select("vec_id", scoring.nima(p).alias("score"))


@query("arcface", "WITH c AS (SELECT p_partkey, greatest(-1 + 1e-7, least(1 - 1e-7, (p_partkey % 100) / 100.0::DOUBLE)) AS c FROM part), l AS (SELECT p_partkey, 30 * cos(acos(c) + 0.5::DOUBLE) AS t, 30 * (1 - c) AS o FROM c) SELECT p_partkey, round(-ln(exp(t) / (exp(t) + exp(o))), 4) AS loss FROM l")
def arcface(spark, d):
    return table(spark, d, "part").select("p_partkey", scoring.arcface_loss((F.col("p_partkey") % 100) / 100.0).alias("loss"))


@query("group_advantages", "SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 4) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def group_advantages(spark, d):
    """Values against the mean and deviation of their group, aggregated and joined back."""
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    g = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.join(g, "user_id").select("event_id", F.round((F.col("value") - F.col("m")) / (F.col("s") + 1e-8), 4).alias("advantage"))


@query(
    "audit_counters",
    """SELECT count(*) AS attempted, count(*) FILTER (p_size >= 10) AS passed, count(*) FILTER (p_size < 10) AS failed, sum(greatest(0, 256000 - p_size * 6000)) AS bytes_saved FROM part""",
)
def audit_counters(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").agg(F.count("*").alias("attempted"), F.count_if(s >= 10).alias("passed"), F.count_if(s < 10).alias("failed"), F.sum(F.greatest(F.lit(0), 256000 - s * 6000)).alias("bytes_saved"))


@query("mean_of_last_five", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS latency FROM events")
def mean_of_last_five(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 4).alias("latency"))


@query(
    "decision_cascade",
    """WITH p AS (SELECT p_partkey, p_size * 60 AS w, p_size * 50 AS h, p_type = 'ECONOMY' AS dirty, p_brand = 'Brand#1' AS global, p_retailprice / 2000 AS logo, round(1 - levenshtein(lower(p_name), lower(p_type || ' ' || p_name))::DOUBLE / greatest(length(p_name), length(p_type || ' ' || p_name)), 4) AS ocr, CASE WHEN p_size % 2 = 0 THEN 0.97 END::DOUBLE AS visual FROM part),
    f AS (SELECT *, CASE WHEN greatest(w, h) < 1000 THEN 'RESOLUTION' WHEN dirty THEN 'BACKGROUND' WHEN global AND logo < 0.85 THEN 'LOGO' END AS failed, round((0.4::DOUBLE * coalesce(visual, 0.85) + 0.6::DOUBLE * least(1, 0.5::DOUBLE + 0.3::DOUBLE * ocr + 0.2::DOUBLE)) * 1.0::DOUBLE, 4) AS score FROM p)
    SELECT p_partkey, CASE WHEN failed IS NOT NULL THEN 'AUTO_REJECT' WHEN score >= 0.88 THEN 'AUTO_APPROVE' WHEN score >= 0.65 THEN 'MANUAL_REVIEW' ELSE 'AUTO_REJECT' END AS decision, CASE WHEN failed IS NULL THEN score ELSE 0 END AS fusion, failed FROM f""",
)
def decision_cascade(spark, d):
    """Gates one after another, then the fused score of what the models say, with their defaults."""
    s, name = F.col("p_size"), F.col("p_name")
    ocr = scoring.ocr_score(F.lit(1.0), text.levenshtein_similarity(name, F.concat_ws(" ", "p_type", "p_name")), F.lit(1.0), F.lit(False))
    v = catalog.verification(
        scoring.resolution_gate(s * 60, s * 50)["passed"], F.col("p_type") != "ECONOMY", F.lit(True), F.col("p_brand") == "Brand#1", F.col("p_retailprice") / 2000, F.when(s % 2 == 0, 0.97), ocr, F.lit(None).cast("double")
    )
    return table(spark, d, "part").select("p_partkey", v.alias("v")).select("p_partkey", "v.*")
