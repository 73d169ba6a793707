from itertools import permutations

import pytest
from pyspark.sql import functions as F

from shelfloom.llm import filter_audit as A
from tests.llm.helpers import documents, words

LONG = " ".join(words(3, 300))
ROWS = [
    (1, LONG), (2, LONG), (2, LONG), (None, LONG), (3, "one two"), (4, "one two"), (5, None), (6, ""), (7, "AB CD " * 150), (8, LONG + " #"), (9, LONG + " | ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 9), (10, "é ü " * 30_000),
    (3, "one two"), (11, " \t\x0b"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (7, None, 1), (None, 1, 1), (99, 1, 1), (9, 0, 0)]


def table(spark, rows=ROWS):
    return documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.lit("en")).when(F.col("doc_id") == 3, F.lit("")).when(F.col("doc_id") > 5, F.lit("de")))


def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("x"))


def brute(rows, marks):
    """One order and step after another over the rows themselves."""
    import re

    docs = []
    for i, lang, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows),
        }
        of = [m for m in marks if m[0] == i and i is not None]
        docs.append((lang or "", fails, any(m[1] == 1 for m in of), any(m[2] == 1 for m in of)))
    out = {}
    for part in {d[0] for d in docs}:
        own, removed = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                here = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                removed[f] += len(here)
                failing = [d for d in own if d[1][f]]
                out[part, order, k + 1] = [len(left), len(here), len(failing) - len(here), sum(sum(d[1].values()) == 1 for d in failing), sum(d[2] for d in here), sum(d[3] for d in here)]
        for key in out:
            if key[0] == part:
                out[key].append(removed[key[1][key[2] - 1]])
    return out


def test_against_brute_force(spark):
    docs = table(spark)
    got = A.audit(docs, labels(spark)).collect()
    want = brute([(r.doc_id, r.lang, r.text) for r in docs.collect()], LABELS)
    assert len(got) == len(want) == 3 * 600
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step], r
        assert r.filter == r.filter_order[r.step - 1]


def test_empty_tables(spark):
    assert A.audit(table(spark, []), labels(spark)).count() == 0
    got = A.audit(table(spark), labels(spark).filter("false"))
    assert got.count() == 1800 and got.filter("good_lost + toxic_lost > 0").count() == 0


def test_other_filters_and_counts(spark):
    """Two filters over weighted rows; a null flag is no failure."""
    rows = spark.createDataFrame([("x", True, False, 5), ("x", True, True, 2), ("x", None, True, 1), ("x", False, False, 4)], "p string, A boolean, B boolean, n bigint")
    joint = A.joint_failures(rows, ["A", "B"], "p", count="n")
    assert joint.first().joint == [12, 7, 3, 2]
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in A.report(joint, ["A", "B"], "p").collect()}
    assert got == {("AB", 1): (5, 7, 0, 5, 12), ("AB", 2): (4, 1, 2, 1, 4), ("BA", 1): (9, 3, 0, 1, 4), ("BA", 2): (4, 5, 2, 5, 12)}
    with pytest.raises(ValueError):
        A.report(joint, ["AA"], "p")


def test_plan_has_no_python(spark):
    plan = A.audit(table(spark), labels(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
