"""Image files by name, size and head; the semantic cache; table functions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.functions import table_functions
from shelfloom.operators import ivf, quality, semantic_cache
from shelfloom.sources import image_files

PNG = bytes.fromhex("89504E470D0A1A0A0000000D494844520000025800000190")


def test_image_files(spark, tmp_path):
    """Each status, nested folders, sizes at the limits, names in any case, a JPEG whose size comes after a long segment."""
    long_jpeg = b"\xff\xd8" + b"\xff\xe1" + (30_002).to_bytes(2, "big") + b"x" * 30_000 + bytes.fromhex("FFC0001108003200640301")
    files = {
        "a.PNG": PNG + b"\0" * 100, "sub/b.jpg": long_jpeg, "c.gif": b"GIF89a" + b"\1" * 60, "noending": PNG, "d.png": PNG, "e.png": b"", "f.webp": b"RIFF" + b"\0" * 4 + b"WEBPVP8L" + b"\0" * 4 + b"\x2f\x57\xc2\x63\x00" + b"\0" * 30,
        "g.jpeg": b"<html>" + b"\0" * 60, "h.jpg": PNG + b"\0" * 60, "i.png": PNG[:20] + b"\0" * 40, "j.png": PNG + b"\0" * 50_000,
    }
    for name, raw in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.path.removeprefix(f"file:{tmp_path}/"): (r.mime, r.width, r.height, r.status) for r in image_files.scan(spark, str(tmp_path), 50, 40_000).collect()}
    ok, no = "VERIFICATION_SUCCESS", (None, None, None)
    assert got == {
        "a.PNG": ("image/png", 600, 400, ok), "sub/b.jpg": ("image/jpeg", 100, 50, ok), "c.gif": (*no, "UNSUPPORTED_MIME_TYPE_image/gif"), "noending": (*no, "UNSUPPORTED_MIME_TYPE_application/octet-stream"),
        "d.png": (*no, f"FILE_SIZE_BELOW_MINIMUM_{len(PNG)}"), "f.webp": ("image/webp", 600, 400, ok), "g.jpeg": (*no, "NOT_AN_IMAGE"), "h.jpg": ("image/png", 600, 400, ok),
        "i.png": ("image/png", 600, 0, "CORRUPT_HEADER"), "j.png": (*no, f"FILE_SIZE_EXCEEDS_LIMIT_{len(PNG) + 50_000}"),
    }
    plan = image_files.scan(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(length,10240)" in plan and "LessThanOrEqual(length,4194304)" in plan


def test_files_are_written_once(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a.png", bytearray(PNG)), ("b.png", bytearray(b"")), (None, bytearray(b"x")), ("c.png", None)], "n string, c binary")
    for _ in range(2):
        assert sorted(map(tuple, image_files.write(rows, path, "n", "c").collect())) == [("a.png", len(PNG)), ("b.png", 0)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.png", "b.png"] and (tmp_path / "out" / "a.png").read_bytes() == PNG


def brute(cache, queries, least):
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    out = {}
    for k, name, brand, v in queries:
        best = None
        for j, other, b, w in cache:
            if None in (k, j) or not v or not w or len(v) != 3 or len(w) != 3 or (brand or "").lower().strip() != (b or "").lower().strip():
                continue
            one, two = (name or "").lower(), (other or "").lower()
            if any((x in one) != (x in two) for x in semantic_cache.CONFLICTING):
                continue
            s = round(float(unit(v) @ unit(w)), 6)
            if s >= least and (best is None or (s, -j) > (best[1], -best[0])):
                best = (j, s)
        if best:
            out[k] = best
    return out


@pytest.mark.parametrize("most", [ivf.MOST_ROWS, 5])
def test_semantic_cache_against_all_pairs(spark, monkeypatch, most):
    """A brand with most products, in one block or in many; conflicting words, null names, brands and vectors, a product on both sides."""
    monkeypatch.setattr(ivf, "MOST_ROWS", most)
    monkeypatch.setattr(ivf, "MOST_QUERIES", most)
    r = random.Random(6)
    vector = lambda: [float(np.float32(r.gauss(0, 1))) for _ in range(3)]
    names = ["Fresh Milk", "fresh MILK 1l", "Chocolate milk", "Watermelon", "juice", None, "", "buttermilk"]
    make = lambda n, low: [(low + i, r.choice(names), "hot" if i % 3 else r.choice([" HOT", "b", None, ""]), vector()) for i in range(n)]
    cache = [*make(60, 0), (100, "juice", "b", None), (None, "juice", "b", vector()), (101, "juice", "b", [1.0]), (102, "juice", "b", [])]
    queries = [*make(60, 50), (200, "juice", "b", None), (None, "juice", "b", vector())]
    schema = "k bigint, name string, brand string, v array<float>"
    got = semantic_cache.cache_hits(spark.createDataFrame(cache, schema), spark.createDataFrame(queries, schema), "k", "name", "brand", "v", 0.5, 6)
    assert {r["query"]: (r.best, round(r.similarity, 6)) for r in got.collect()} == brute(cache, queries, 0.5)
    assert semantic_cache.cache_hits(spark.createDataFrame([], schema), spark.createDataFrame(queries, schema), "k", "name", "brand", "v").count() == 0


def test_sessionize(spark):
    table_functions.register(spark)
    rows = spark.createDataFrame([("a", 0), ("a", 9), ("a", 19), ("b", 5), (None, 1), (None, 30), ("a", None), ("b", 5)], "u string, t bigint").repartition(3)
    run = lambda df, user="u", at="t", gap=10: spark.sql(f"SELECT * FROM sessionize(TABLE({{df}}), '{user}', '{at}', {gap})", df=df)
    got = sorted((tuple(r) for r in run(rows).collect()), key=str)
    assert got == sorted([("a", 0, 9, 2), ("a", 19, 19, 1), ("b", 5, 5, 2), (None, 1, 1, 1), (None, 30, 30, 1)], key=str)
    assert run(rows).columns == ["u", "session_start", "session_end", "n"] and run(rows.filter("false")).count() == 0
    for bad in ({"user": "x"}, {"gap": 0}):
        with pytest.raises(Exception, match="no column|above zero"):
            run(rows, **bad).count()


def test_null_rate_counts_blanks_as_values(spark):
    df = spark.createDataFrame([(" ", [1]), ("", []), (None, None), ("x", [2])], "a string, b array<int>")
    assert quality.null_rate(df, ["a", "b"]).first()[0] == 50.0 and quality.null_rate(df.filter("false"), ["a"]).first()[0] == 0.0
    assert quality.null_rate(df.select(F.lit(1).alias("n")), ["n"]).first()[0] == 0.0
