"""Data quality, freshness and calibration measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.functions.text import looks_like_captcha


def null_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(null_rate): per cent of cells that are null, an empty text or an empty list (a blank is a value); 0 without cells."""
    kinds = dict(df.dtypes)
    none = lambda c: F.size(c) == 0 if kinds[c].startswith(("array", "map")) else F.col(c).cast("string") == ""
    empty = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull() | none(c), 1).otherwise(0) for c in columns])
    return df.agg(F.round(F.coalesce(F.sum(empty) / F.nullif(F.count("*") * len(columns), F.lit(0)) * 100, F.lit(0.0)), 2).alias("null_rate"))


def audit(df: DataFrame, essential: list[str], expected: list[str], status: Column, html: Column, most: float = 5.0) -> DataFrame:
    """(null_rate, drift, captcha, passed, reasons): blank cells of the essential columns, expected columns that are missing, and a page that is a captcha."""
    missing = sorted(set(expected) - set(df.columns))
    out = null_rate(df, essential).withColumns({"drift": F.lit(bool(missing)), "captcha": looks_like_captcha(status, html)})
    checks = F.array(F.when(F.col("null_rate") > most, "null rate"), F.when(F.col("drift"), f"missing columns: {' '.join(missing)}"), F.when(F.col("captcha"), "captcha page"))
    reasons = F.filter(checks, lambda x: x.isNotNull())
    return out.select("null_rate", "drift", "captcha", (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, ",").alias("reasons"))


def error_rate(bad: Column, total: Column) -> Column:
    return F.round(F.when(total > 0, 100.0 * bad / total).otherwise(0.0), 2)


def combined_loss(ratio: Column) -> Column:
    """Aggregate: 1 - product of (1 - ratio), each ratio clamped to 0..1."""
    return F.round(1 - F.product(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))), 4)


def conformal_quantile(df: DataFrame, score: str, by: list[str], alpha: float, empty: float = 0.88) -> DataFrame:
    """(*by, threshold): the score of rank min(n, ceil(q n)), q = ceil((1 - alpha)(n + 1)) / n, without gathering or sorting a group.

    A quantile sketch of each group (its size doesn't grow with the rows) brackets
    the wanted rank; exact counts below and inside the bracket then give the value,
    so only distinct values between two near quantiles are ranked.
    """
    some = df.filter(F.col(score).isNotNull()).select(*by, F.col(score).alias("__s"))
    probe = F.kll_sketch_agg_double(F.col("__s").cast("double"), F.lit(400)).alias("__sketch")
    n = some.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__s").alias("__min"), F.max("__s").alias("__max"), probe)
    q = F.least(F.lit(1.0), F.ceil(F.round((1 - alpha) * (F.col("__n") + 1), 9)) / F.col("__n"))
    k = F.greatest(F.lit(1), F.least(F.col("__n"), F.ceil(F.round(q * F.col("__n"), 9))))
    # many times the error of such a sketch on either side; the least and greatest value beyond the ends, and for few rows
    quantile = lambda p: F.kll_sketch_get_quantile_double("__sketch", F.lit(min(1.0, max(0.0, p))))
    few, end = F.col("__n") < 100, lambda c: F.col(c).cast("double")
    low = F.when(few | F.lit(alpha >= 0.95), end("__min")).otherwise(quantile(1 - alpha - 0.05))
    high = F.when(few | F.lit(alpha <= 0.07), end("__max")).otherwise(quantile(1 - alpha + 0.07))
    bracket = n.select(*by, k.alias("__k"), low.alias("__low"), high.alias("__high"))
    # one pass over the bracket, as a sketch that is made again may differ: values below it are one value, before all others
    value = F.when(F.col("__s") >= F.col("__low"), F.col("__s"))
    counts = some.join(bracket, by).filter(F.col("__s") <= F.col("__high")).groupBy(*by, "__k", value.alias("__s")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("__s")))
    found = counts.withColumn("__upto", upto).filter((F.col("__upto") >= F.col("__k")) & (F.col("__upto") - F.col("__c") < F.col("__k")))
    return found.select(*by, F.coalesce(F.col("__s"), F.lit(empty)).alias("threshold"))


def trust(successes: Column, failures: Column, soft_bans: Column) -> Column:
    """Beta mean with prior (2, 1) less a quarter for each soft ban, clamped."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (successes + 2) / (successes + failures + 3) - 0.25 * soft_bans)), 4)


def failsafe(affected: Column, total: Column, most: float = 0.5) -> Column:
    """Null, or an error that stops the job, if more than ``most`` of the total would change."""
    return F.when((total > 0) & (affected / total > most), F.raise_error(F.concat(F.lit("a change of "), affected.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" rows is frozen"))))
