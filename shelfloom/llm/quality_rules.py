"""Quality rules with thresholds that follow each language and source. SQL functions only.

``features`` counts what a text is made of. ``sketches`` keeps a KLL quantile
sketch of each measure for each language and source; sketches merge, so a hot
source is aggregated where its rows are, a day's sketches can be added to an
earlier table, and a group with few rows takes the merged sketch of its language
or of everything. ``thresholds`` draws a fence at a high (or low) quantile of the
group and a multiple of its distance from the median beyond, and ``judge`` joins
them back to the rows. How high the quantile is says what share of a group is taken
to be sound: four fifths where junk is common, 0.99 where any repeat is rare.

Words are ``[^\\x20\\x09-\\x0D]+``. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import arrow, scratch

WINDOW = 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Base cutoffs, and how the fences are drawn."""

    least_words: int = 20
    most_repeated: int = 30
    least_rows: int = 200
    sketch_k: int = 1000
    #: Groups of language and source up to which the fences are broadcast.
    broadcast_groups: int = 20_000


#: Measure, side of the fence, quantile that is sound, multiple of its distance from the median, tolerance where all are alike.
MEASURES = (
    ("symbol_share", "upper", 0.80, 2.0, 0.05),
    ("dup_line_share", "upper", 0.99, 1.0, 0.05),
    ("repeat_share", "upper", 0.99, 1.0, 0.03),
    ("word_length", "upper", 0.80, 8.0, 0.1),
    ("word_length", "lower", 0.05, 4.0, 0.1),
)
_QUANTILES = (0.5, *sorted({m[2] for m in MEASURES}))


def features(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines, all bigint; null text has none.

    ``prefix`` goes before the new names; columns of ``docs`` that have such a name are replaced.
    """
    docs = docs.drop(*[prefix + name for name in FEATURES])
    tmp = lambda name: arrow.spare([*docs.columns, *FEATURES], f"__{name}")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blank = F.translate(t, "\t\n\x0b\x0c\r", "     ")
    step = docs.withColumn(tmp("t"), t).withColumn(tmp("words"), F.array_remove(F.split(blank, " ", -1), ""))
    step = step.withColumn(tmp("lines"), F.filter(F.split(F.col(tmp("t")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    step = step.withColumn(tmp("h"), F.transform(tmp("words"), lambda w: F.xxhash64(w)))
    h = F.col(tmp("h"))
    window = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    no_window = F.array().cast("array<bigint>")
    step = step.withColumn(tmp("runs"), F.when(F.size(h) > WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), window)).otherwise(no_window))
    runs = F.col(tmp("runs"))
    some = F.size(F.array_distinct(runs)) < F.size(runs)
    step = step.withColumn(tmp("sorted"), F.when(some, F.array_sort(F.transform(runs, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    s = F.col(tmp("sorted"))
    again = F.filter(s, lambda x, i: F.get(s, i + 1)["h"].eqNullSafe(x["h"]) | (i > 0) & F.get(s, i - 1)["h"].eqNullSafe(x["h"]))
    step = step.withColumn(tmp("at"), F.array_sort(F.transform(again, lambda x: x["p"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("total"))
    covered = F.aggregate(
        tmp("at"), start, lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total")), lambda acc: acc["total"]
    )
    out = {
        "n_words": F.size(tmp("words")).cast("bigint"),
        "word_chars": F.length(F.translate(F.col(tmp("t")), " \t\n\x0b\x0c\r", "")).cast("bigint"),
        "n_symbols": (F.length(tmp("t")) - F.length(F.translate(F.col(tmp("t")), "#*$%&|<>", ""))).cast("bigint"),
        "n_lines": F.size(tmp("lines")).cast("bigint"),
        "n_dup_lines": (F.size(tmp("lines")) - F.size(F.array_distinct(tmp("lines")))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint")),
    }
    return step.select(*docs.columns, *[c.alias(prefix + k) for k, c in out.items()])


def _measures(prefix: str) -> dict[str, Column]:
    c = lambda n: F.col(prefix + n).cast("double")
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))
    return {"symbol_share": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words")}


def base_failed(rules: Rules, prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < rules.least_words) | (100 * F.col(prefix + "n_repeat_words") > rules.most_repeated * n)


def sketches(measured: DataFrame, rules: Rules, prefix: str = "") -> DataFrame:
    """One row for each (lang, source): n and a sketch of each measure, over the rows that pass the base rules. ``measured`` should be a written table, as each measure reads it."""
    sound = measured.filter(~base_failed(rules, prefix))
    return sound.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(c, F.lit(rules.sketch_k)).alias(m) for m, c in _measures(prefix).items()])


def thresholds(kept: DataFrame, rules: Rules, mark: str = "") -> DataFrame:
    """Sketches by (lang, source) to fences by (lang, source); ``mark`` goes before every name."""
    names = list(dict.fromkeys(m[0] for m in MEASURES))
    merged = lambda by: [F.sum("n").alias(f"n_{by}"), *[F.kll_merge_agg_double(m, F.lit(rules.sketch_k)).alias(f"{m}_{by}") for m in names]]
    by_lang = kept.groupBy(F.col("lang").alias("of_lang")).agg(*merged("lang"))
    of_all = kept.groupBy().agg(*merged("all"))
    wide = kept.join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang")), "left").join(F.broadcast(of_all))  # one row
    pick = lambda m: F.when(F.col("n") >= rules.least_rows, F.col(m)).when(F.col("n_lang") >= rules.least_rows, F.col(f"{m}_lang")).otherwise(F.col(f"{m}_all"))
    wide = wide.select("lang", "source", *[F.kll_sketch_get_quantile_double(pick(m), F.array(*[F.lit(q) for q in _QUANTILES])).alias(m) for m in names])
    fences = []
    for m, side, quantile, stretch, tolerance in MEASURES:
        mid, edge = F.element_at(m, 1), F.element_at(m, 1 + _QUANTILES.index(quantile, 1))
        fences.append((edge + stretch * (edge - mid) + F.lit(tolerance if side == "upper" else -tolerance)).alias(f"{mark}{m}_{side}"))
    return wide.select(F.col("lang").alias(mark + "lang"), F.col("source").alias(mark + "source"), *fences)


def judge(counted: DataFrame, rules: Rules = Rules(), prefix: str = "") -> DataFrame:
    """Rows with their features (``features``), lang and source, to the same with base_failed and kept: one row for each row.

    A row is kept when it passes the base rules and is inside every fence of its
    language and source (nulls are a group like any other). The rows are written
    once in the shared folder, as they are needed twice: select the columns you
    want first. Null and empty texts fail the base rules. Repeated rows are judged
    alike; an empty table gives no rows. Columns that have a name of the verdict's
    are replaced.
    """
    measured = scratch.table(counted.drop(prefix + "base_failed", prefix + "kept"), "features")
    kept = scratch.table(sketches(measured, rules, prefix), "sketches")
    mark = arrow.spare([c[: i + 1] for c in measured.columns for i in range(len(c))], "__")
    fences = scratch.table(thresholds(kept, rules, mark), "fences")
    if fences.count() <= rules.broadcast_groups:
        fences = F.broadcast(fences)
    joined = measured.join(fences, F.col("lang").eqNullSafe(F.col(mark + "lang")) & F.col("source").eqNullSafe(F.col(mark + "source")), "left")
    value, inside = _measures(prefix), F.lit(True)
    for m, side, *_ in MEASURES:
        fence = F.col(f"{mark}{m}_{side}")
        inside = inside & F.coalesce(value[m] <= fence if side == "upper" else value[m] >= fence, F.lit(True))
    failed = base_failed(rules, prefix)
    return joined.select(*measured.columns, failed.alias(prefix + "base_failed"), (~failed & inside).alias(prefix + "kept"))
