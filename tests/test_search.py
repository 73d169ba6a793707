"""Brands of products, query sequences and the whole search on small tables."""

from pyspark.sql import functions as F

from shelfloom.operators import search

BRANDS = [("Al Marai", ["Al Marai", "المراعي"], 1), ("Nadec", ["Nadec", "nadek"], 2)]


def table(spark):
    return spark.createDataFrame(BRANDS, "brand string, synonyms array<string>, order int")


def products(spark, rows):
    return spark.createDataFrame(rows, "product_key bigint, name string, brand string, competitors array<string>")


def test_brands_are_typed_held_or_guessed(spark):
    rows = [(1, "Milk 1l", "AL MARAI", None), (2, "Milk", "Al Marrai", None), (3, "Milk", "المراعي", None), (4, "Nadek milk", None, None), (5, "fresh nadec juice", " ", None), (6, "Unknown juice", None, None), (7, "Milk", "Other", None), (8, None, None, None), (9, "", "", None)]
    got = {r.product_key: (r.brand, r.brand_from) for r in search.resolve_brands(products(spark, rows), table(spark)).collect()}
    assert got == {1: ("Al Marai", "typed"), 2: ("Al Marai", "typed"), 3: ("Al Marai", "typed"), 4: ("Nadec", "name"), 5: ("Nadec", "name"), 6: ("Unknown", "start"), 7: ("Other", "typed"), 8: (None, None), 9: (None, None)}
    assert search.resolve_brands(products(spark, rows), table(spark).filter("false")).count() == len(rows)


def test_query_sequence(spark):
    df = spark.createDataFrame([("Nadec Milk 200ml (new)", "Nadec"), ("Milk", None), ("Nadec", "Nadec"), (None, None)], "name string, brand string")
    got = [r[0] for r in df.select(search.query_sequence(F.col("name"), F.col("brand"))).collect()]
    assert got[0] == ["nadec milk", "milk", "nadec milk carton"] and got[1][0] == "milk" and got[2][0] == "nadec" and not got[3]


def test_each_engine_answers_the_first_query_that_it_knows(spark):
    results = spark.createDataFrame(
        [("a", "nadec milk", 1, 10, "nadec milk", "u/10", 600, 600), ("a", "milk", 1, 11, "milk", "u/11", 600, 600), ("b", "milk", 1, 10, "nadec milk", "u/10", 600, 600), ("b", "milk", 2, 12, "tiny", "u/12", 100, 100), ("b", "milk", 99, 13, "late", "u/13", 600, 600)],
        "engine string, query string, rank int, candidate bigint, title string, url string, width int, height int",
    )
    asked = products(spark, [(1, "Nadec Milk", "Nadec", ["rival"]), (2, "Nothing", None, None)])
    got = search.search(asked, results, table(spark), {"a": 2.0}).orderBy("product_key", "place").collect()
    assert [(r.product_key, r.candidate, r.place) for r in got] == [(1, 10, 1), (1, 12, 2)]
    assert got[0].query == "nadec milk" and got[0].n_engines == 2 and got[0].score == round(3 / 61, 6) and got[0].reject_reason is None and got[1].reject_reason.startswith("smaller")
    assert search.search(asked, results.filter("false"), table(spark)).count() == 0 == search.search(asked.filter("false"), results, table(spark)).count()
