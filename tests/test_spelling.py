"""Near words by shared keys against comparing all with all."""

import random

import pytest

from shelfloom.operators import spelling


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def near(a, b, most):
    return distance(a, b) <= most * max(len(a), len(b)) + 1e-9


def edited(r, w, n):
    for _ in range(n):
        i, kind = r.randrange(len(w) + 1), r.randrange(3)
        w = w[:i] + r.choice("abé ") + w[i:] if kind == 0 else w[:i] + w[i + 1 :] if kind == 1 else w[:i] + r.choice("abé") + w[i + 1 :]
    return w


@pytest.mark.parametrize("most", [0.15, 0.3])
def test_all_near_pairs_are_found(spark, most):
    r = random.Random(7)
    words = ["".join(r.choice("abcdeé") for _ in range(n)) for n in (*range(1, 30), 34, 40, 48) for _ in range(3)]
    names = [edited(r, w, k) for w in words for k in (0, 1, 2, len(w) // 8, len(w) // 6)] + ["", "  ", None, "x" * 60]
    got = spelling.near_words(spark.createDataFrame([(n,) for n in names], "n string"), "n", spark.createDataFrame([(w,) for w in words], "w string"), "w", most)
    found = {(x.a, x.b): x.distance for x in got.collect()}
    lows = {n.strip(" ").lower() for n in names if n and n.strip(" ")}
    want = {(a, b): distance(a, b) for a in lows for b in set(words) if abs(len(a) - len(b)) <= most * max(len(a), len(b)) + 1e-9 and near(a, b, most)}
    assert found == want and len(want) > 300


def test_corrected(spark):
    words = spark.createDataFrame([("Al Marai Milk", 2), ("Al Marai Milks", 1), ("Nadec", 3), (None, 4), ("nadec", 0)], "w string, o int")
    typed = ["al marai mil", "AL MARAI MILK", " Nadec ", "nadek", "unknown", "", None, "Al Marai Milkss"]
    rows = spark.createDataFrame(list(enumerate(typed)) + [(0, typed[0])], "id int, t string")
    got = sorted((r.id, r.corrected) for r in spelling.corrected(rows, "t", words, "w", "o").collect())
    want = [(0, "Al Marai Milk"), (0, "Al Marai Milk"), (1, "Al Marai Milk"), (2, "nadec"), (3, "nadek"), (4, "unknown"), (5, ""), (6, None), (7, "Al Marai Milks")]
    assert got == want
    assert spelling.corrected(rows, "t", words.filter("false"), "w").filter("not corrected <=> t").count() == 0
    assert spelling.corrected(rows.filter("false"), "t", words, "w").count() == 0


def test_large_tables_without_a_cross_join(spark):
    """20,000 names against 20,000 words."""
    r = random.Random(1)
    words = list({"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(8, 25))) for _ in range(20_000)})
    names = [edited(r, w, 1) for w in words]
    a, b = spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(w,) for w in words], "w string")
    out = spelling.near_words(a, "n", b, "w")
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {(x.a, x.b) for x in out.collect()}
    assert {(n.strip(" ").lower(), w) for n, w in zip(names, words, strict=True) if near(n.strip(" ").lower(), w, 0.15)} <= found
