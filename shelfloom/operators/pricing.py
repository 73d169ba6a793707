"""Price series: anomalies, promotions, collusion, effects and posterior demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def three_sigma(price: Column, mean: Column, deviation: Column, n: Column) -> Column:
    """Whether a price is more than three deviations under the mean of at least three."""
    return F.coalesce((n >= 3) & (deviation > 0) & (price - mean < -3 * deviation), F.lit(False))


def fake_promotions(df: DataFrame, key: str, days_ago: str, price: str) -> DataFrame:
    """(key, fake): a rise by a quarter and a fall back within 14 days, among three prices in a row."""
    w = Window.partitionBy(key).orderBy(F.desc(days_ago), F.asc(price))
    p1, p2, d2 = F.lead(price, 1).over(w), F.lead(price, 2).over(w), F.lead(days_ago, 2).over(w)
    hit = (F.col(days_ago) - d2 <= 14) & (p1 >= 1.25 * F.col(price)) & (p2 <= 1.05 * F.col(price))
    return df.withColumn("hit", F.coalesce(hit, F.lit(False))).groupBy(key).agg(F.max("hit").alias("fake"))


def audit(df: DataFrame, key: str, days_ago: str, price: str, peer: str) -> DataFrame:
    """(key, price, sigma, fake, r): the last price, whether it is an outlier of the ones before, a fake promotion in the history, and its correlation with ``peer``.

    One shuffle and one sort: the history of a key is read once, from its oldest price on, and the last price is the one that nothing follows.
    """
    old = Window.partitionBy(key).orderBy(F.desc(days_ago), F.asc(price))
    p1, p2, d2 = F.lead(price, 1).over(old), F.lead(price, 2).over(old), F.lead(days_ago, 2).over(old)
    hit = (F.col(days_ago) - d2 <= 14) & (p1 >= 1.25 * F.col(price)) & (p2 <= 1.05 * F.col(price))
    rows = df.withColumn("__hit", F.coalesce(hit, F.lit(False))).withColumn("__last", F.lead(days_ago, 1).over(old).isNull())
    before, last = F.when(~F.col("__last"), F.col(price)), F.when(F.col("__last"), F.col(price))
    s = rows.groupBy(key).agg(F.max(last).alias("price"), F.avg(before).alias("__mean"), F.stddev_pop(before).alias("__sd"), F.count(before).alias("__n"), F.max("__hit").alias("fake"), pearson(price, peer).alias("r"))
    return s.select(key, "price", three_sigma(F.col("price"), F.col("__mean"), F.col("__sd"), F.col("__n")).alias("sigma"), "fake", "r")


def pearson(a: str, b: str) -> Column:
    """Aggregate: correlation of at least three pairs, four digits; null for a constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    # the built-in correlation is an error for a constant under ANSI rules
    r = F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when(F.count(x) >= 3, F.round(r, 4))


def pricing_verdict(below_map: Column, sigma: Column, fake: Column, correlation: Column) -> Column:
    return F.when(below_map, "MAP_VIOLATION").when(sigma, "PRICING_ERROR").when(fake, "FAKE_PROMOTION").when(F.coalesce(correlation >= 0.95, F.lit(False)), "COLLUSION").otherwise("NORMAL")


def double_ml(df: DataFrame, y: str, t: str, x: str) -> DataFrame:
    """(n, theta, standard_error): effect of ``t`` on ``y`` after taking ``x`` out of both, without an intercept.

    One pass of moments, however many rows: residuals of a single control are a
    combination of the sums of products.
    """
    yy, tt, xx = (F.col(c).cast("double") for c in (y, t, x))
    m = df.agg(F.count("*").alias("n"), F.sum(yy * xx).alias("yx"), F.sum(tt * xx).alias("tx"), F.sum(xx * xx).alias("xx"), F.sum(yy * tt).alias("yt"), F.sum(tt * tt).alias("tt"), F.sum(yy * yy).alias("yy"))
    rt = F.col("tt") - F.col("tx") * F.col("tx") / F.col("xx")
    ry = F.col("yt") - F.col("yx") * F.col("tx") / F.col("xx")
    theta = ry / rt
    rss = F.col("yy") - F.col("yx") * F.col("yx") / F.col("xx") - theta * ry
    few = F.col("n") < 10
    return m.select("n", F.when(few, 0.0).otherwise(F.round(theta, 6)).alias("theta"), F.when(few, 0.0).otherwise(F.round(F.sqrt(rss / F.col("n") / rt), 6)).alias("standard_error"))


def demand_posterior(df: DataFrame, price: str, demand: str) -> DataFrame:
    """(price, alpha, beta, mean): Gamma posterior of a Poisson demand, prior (2, 1)."""
    out = df.groupBy(price).agg((F.sum(demand) + 2).alias("alpha"), (F.count("*") + 1).alias("beta"))
    return out.withColumn("mean", F.round(F.col("alpha") / F.col("beta"), 6))
