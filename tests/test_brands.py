"""Brands in names by an automaton, by a join, and by comparing all with all."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfloom.operators import brands


def brute(name, table):
    """Brands in order, their synonyms, a word or (over two characters) a part of one."""
    low = (name or "").lower().strip()
    for brand, listed, _ in sorted(table, key=lambda b: (b[2], b[0])):
        for s in ((x or "").lower().strip() for x in listed):
            if low and s and (re.search(rf"\b{re.escape(s)}\b", low) or (len(s) > 2 and s in low)):
                return brand
    return None


TABLE = [
    ("Al Marai", ["Al Marai", " almarai", "المراعي"], 1), ("GE", ["GE", "G.E"], 2), ("L&M", ["l&", "&M"], 3), ("Ring", ["Ring", "ring-bolt"], 4),
    ("3M", ["3m", ""], 5), ("A", ["a"], 6), ("Écru", ["ÉCRU", None], 7), ("Dup", ["ring", "dup"], 8), ("Odd", ["\\E.*", "(x"], 9),
]
NAMES = [
    "big ring", "Ring light", "ring-bolt set", "earrings", "orange", "GE lamp", "lamp (ge)", "G.E. lamp", "AL  MARAI milk", "al marai milk", "حليب المراعي", "l& m", "L&M", "x&m", "3M tape", "33m tape", "a", "banana", "_a_", "été a", "écru shirt",
    "dup", "", None, "  ", "odd \\e.* name", "f(x)", "a" * 70_000 + " ring", "ge", "éa", "aé", "٣a",
]


@pytest.mark.parametrize("most", [brands.MOST_SYNONYMS, 0])
def test_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(brands, "MOST_SYNONYMS", most)
    r = random.Random(3)
    table = TABLE + [(f"B{i}", [" ".join("".join(r.choice("abé&1 ") for _ in range(r.randrange(1, 5))) for _ in range(2))], 100 + i % 7) for i in range(60)]
    names = NAMES + ["".join(r.choice("aAbBéÉ&1 -") for _ in range(r.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(names)) + [(0, names[0])], "id bigint, name string").withColumns({c: F.lit(1) for c in ("brand", "place", "synonym")})
    vocabulary = spark.createDataFrame(table, "brand string, synonyms array<string>, order int")
    got = brands.first_brand(rows, vocabulary).collect()
    assert len(got) == len(names) + 1 and got[0].place == 1
    for x in got:
        assert x.brand == brute(names[x.id], table), (x.id, names[x.id][:40])


@pytest.mark.parametrize("most", [brands.MOST_SYNONYMS, 0])
def test_no_brands_and_no_names(spark, monkeypatch, most):
    monkeypatch.setattr(brands, "MOST_SYNONYMS", most)
    names, vocabulary = spark.createDataFrame([(1, "ring")], "id int, name string"), spark.createDataFrame(TABLE, "brand string, synonyms array<string>, order int")
    assert [r.brand for r in brands.first_brand(names, vocabulary.filter("false")).collect()] == [None]
    assert brands.first_brand(names.filter("false"), vocabulary).count() == 0


def test_no_nested_loop_in_the_plan(spark, monkeypatch):
    names, vocabulary = spark.createDataFrame([(1, "ring")], "id int, name string"), spark.createDataFrame(TABLE, "brand string, synonyms array<string>, order int")
    for most in (brands.MOST_SYNONYMS, 0):
        monkeypatch.setattr(brands, "MOST_SYNONYMS", most)
        plan = brands.first_brand(names, vocabulary)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
