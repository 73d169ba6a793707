"""How filters interact: what each removes, finds already removed, or alone would catch. SQL functions only.

A document has a flag for each filter, true where it fails. The counts of joint
failures of all sets of filters are sums of products of flags, so one aggregate
with partial sums gives them for a part of the table, whatever its size (the empty
set counts all documents). Every figure of the report is an alternating sum of
them (Moebius inversion over subsets):

* kept after the filters of S: the sum over T in S of (-1)^|T| joint(T);
* removed by a filter after S: kept(S) less kept(S and the filter);
* redundant: joint(filter) less removed, as it fails there but was gone before;
* unique failures: removed by the filter after all others;
* Shapley value over all orders: the game "removed by S" has the Harsanyi dividends
  (-1)^(|T|+1) joint(T), of which each member of T gets an equal share.

Only the aggregate reads documents: the report is made from a row for each part.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Filters up to which all orders are listed: 5,040 of them.
MOST_FILTERS = 7


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1), "")


def text_failures(text: Column, least_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3, symbols: str = "#$%&*|") -> dict[str, Column]:
    """Failure conditions of four filters of one text (null: empty): few words (A), few distinct words (B), many capitals A-Z (C), any symbol (D)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    w = words(t)
    capitals = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(w) < least_words,
        "B": 100 * F.size(F.array_distinct(w)) < distinct_percent * F.size(w),
        "C": 100 * capitals > upper_percent * F.length(t),
        "D": F.length(t) > F.length(F.translate(t, symbols, "")),
    }


def first_of_text(rows: DataFrame, id: str, text: str, values: Sequence[str]) -> DataFrame:
    """(id, ``values``, count, again): rows that agree in all, and whether a smaller id has the same text (``text``, a digest).

    A text may be that of a third of all rows: its least id is a partial aggregate,
    and it is joined back to what is left of the rows after counting those that
    agree in text and values, apart from the one with the least id.
    """
    alike = rows.groupBy(text, *values, id).agg(F.count("*").alias("count"))
    # of each text and values: the least id, how often it is there, and the rows of all ids
    least = F.min(F.when(F.col(id).isNotNull(), F.struct(F.col(id).alias("id"), F.col("count").alias("n"))))
    by = alike.groupBy(text, *values).agg(least.alias("least"), F.sum("count").alias("n"), F.sum(F.when(F.col(id).isNull(), F.col("count"))).alias("unnamed"))
    first = by.groupBy(F.col(text).alias("same_text")).agg(F.min("least.id").alias("first"))
    met = by.join(first, F.col(text) == F.col("same_text"))
    alone = F.coalesce(F.when(F.col("least.id") == F.col("first"), F.col("least.n")), F.lit(0)) + F.coalesce("unnamed", F.lit(0))
    parts = F.explode(F.array(F.struct(F.lit(False).alias("again"), alone.alias("count")), F.struct(F.lit(True).alias("again"), (F.col("n") - alone).alias("count"))))
    return met.select(*values, parts.alias("x")).select(*values, "x.again", F.col("x.count").alias("count"))


def joint_failures(rows: DataFrame, filters: Sequence[str], part: str, groups: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """(part, joint, joint_<group>...): for each part an array of 2^n counts, at S (bit i for filter i) of the rows that fail all filters of S.

    ``filters`` and ``groups`` name boolean columns (null: false); a group's array
    counts its rows only. ``count`` names the column that has how many documents a
    row stands for (1 without one). One aggregate; a hot part is summed where its
    rows are.
    """
    each = F.lit(1).cast("bigint") if count is None else F.col(count).cast("bigint")
    flag = {f: F.coalesce(F.col(f), F.lit(False)).cast("bigint") for f in filters}
    sums = []
    for name, weight in [("joint", each), *[(f"joint_{g}", each * F.coalesce(F.col(g), F.lit(False)).cast("bigint")) for g in groups]]:
        for s in range(1 << len(filters)):
            product = weight
            for i, f in enumerate(filters):
                if s >> i & 1:
                    product = product * flag[f]
            sums.append(F.sum(product).alias(f"{name}_{s}"))
    found = rows.groupBy(part).agg(*sums)
    arrays = [F.array(*[F.col(f"{name}_{s}") for s in range(1 << len(filters))]).alias(name) for name in ["joint", *[f"joint_{g}" for g in groups]]]
    return found.select(part, *arrays)


def _kept(joint: Column, n: int) -> Column:
    """Joint failures to survivors, both by the set of filters: an alternating sum over subsets."""
    sets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    sign = lambda t: F.when(F.bit_count(t) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    term = lambda s, t: F.when(t.bitwiseAND(s) == t, sign(t) * F.get(joint, t)).otherwise(F.lit(0))
    return F.transform(sets, lambda s: F.aggregate(sets, F.lit(0).cast("bigint"), lambda total, t: total + term(s, t)))


def _shares(joint: Column, n: int) -> Column:
    """Shapley values times n!, by filter: shares of the Harsanyi dividends."""
    sets = F.sequence(F.lit(1), F.lit((1 << n) - 1))
    dividend = lambda t: F.when(F.bit_count(t) % 2 == 1, F.get(joint, t)).otherwise(-F.get(joint, t))
    share = lambda t: dividend(t) * (F.lit(factorial(n)) / F.bit_count(t)).cast("bigint")
    own = lambda i: F.filter(sets, lambda t: F.get(F.array(*[t.bitwiseAND(F.lit(1 << k)) for k in range(n)]), i) != 0)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(own(i), F.lit(0).cast("bigint"), lambda total, t: total + share(t)))


def report(joint: DataFrame, filters: Sequence[str], part: str, groups: Sequence[str] = ()) -> DataFrame:
    """``joint_failures`` to a row for each part, order of the filters and step.

    Columns: part, filter_order (names of one letter, joined), step (from 1), filter,
    kept, removed, redundant, unique_fails, <group>_lost for each group, shapley (the
    sum over all orders of what the filter removes). All counts are bigint.
    """
    n, names = len(filters), "".join(filters)
    if n > MOST_FILTERS or any(len(f) != 1 for f in filters):
        raise ValueError(f"at most {MOST_FILTERS} filters, with names of one letter")
    rows = joint.withColumn("_kept", _kept(F.col("joint"), n)).withColumn("_shares", _shares(F.col("joint"), n))
    for g in groups:
        rows = rows.withColumn(f"_kept_{g}", _kept(F.col(f"joint_{g}"), n))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    rows = rows.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    own = F.instr(F.lit(names), letter) - 1
    gone = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    before = sum((F.when(F.contains(gone, F.lit(f)), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(filters)), F.lit(0))
    rows = rows.withColumn("filter", letter).withColumn("_own", own).withColumn("_before", before)
    bit = F.get(F.array(*[F.lit(1 << i) for i in range(n)]), F.col("_own"))
    rows = rows.withColumn("_bit", bit).withColumn("_after", F.col("_before") + F.col("_bit"))
    left = lambda kept, at: F.get(F.col(kept), F.col(at))
    removed = left("_kept", "_before") - left("_kept", "_after")
    everything = F.lit((1 << n) - 1)
    unique = F.get(F.col("_kept"), everything - F.col("_bit")) - F.get(F.col("_kept"), everything)
    return rows.select(
        part, "filter_order", F.col("step").cast("int").alias("step"), "filter", left("_kept", "_after").alias("kept"), removed.alias("removed"),
        (F.get("joint", F.col("_bit")) - removed).alias("redundant"), unique.alias("unique_fails"),
        *[(left(f"_kept_{g}", "_before") - left(f"_kept_{g}", "_after")).alias(f"{g}_lost") for g in groups],
        F.get("_shares", F.col("_own")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The report of the four text filters and of exact copies (E) for each part of ``docs``.

    ``labels`` has (key, quality, toxic); a key that is there more than once is good
    or toxic if any of its rows is, one that isn't there is neither. Null text is
    empty; a null part is the empty string. A row is a copy (E) if a smaller key has
    the same text anywhere in the table, removed or not: rows with a null key are no
    copies, and rows that repeat the least key of a text aren't either. Other columns
    are ignored. An empty table gives no rows.
    """
    flags = text_failures(F.col(text))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), *[c.alias(f) for f, c in flags.items()]
    )
    marked = labels.groupBy(F.col(key).alias("labelled")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.join(marked, F.col("id") == F.col("labelled"), "left").select(*rows.columns, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    counted = first_of_text(known, "id", "digest", ["part", *flags, "good", "toxic"]).withColumnRenamed("again", "E")
    filters = [*flags, "E"]
    return report(joint_failures(counted, filters, "part", ("good", "toxic"), "count"), filters, "part", ("good", "toxic"))
