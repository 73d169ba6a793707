"""The inverted file against brute force: recall of the nearest, exact thresholds, odd rows and hot lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.operators import ivf

D = "/root/testdata/sf0.1"


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{D}/embeddings.parquet")


def test_recall_against_all_rows(spark, table, tmp_path):
    """At least 0.9 of the ten nearest of every twentieth row, over the whole table, with an index fitted on a quarter of it."""
    q = ivf.fit(table, "vec_id", "embedding", sample=500)
    ivf.index(table, q, "vec_id", "embedding").write.parquet(str(tmp_path / "i"))
    indexed = spark.read.parquet(str(tmp_path / "i"))
    assert indexed.count() == table.count()
    got = ivf.nearest(indexed, q, table.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10).toPandas()
    rows = table.orderBy("vec_id").toPandas()
    points = unit(np.stack(rows["embedding"]).astype(float))
    hits = asked = 0
    for i, id in enumerate(rows["vec_id"]):
        if id % 20:
            continue
        s = points @ points[i]
        s[i] = -2
        best = set(rows["vec_id"].to_numpy()[np.argsort(-s)[:10]])
        own = got[got["query"] == id].sort_values("rank")
        assert len(own) == 10 and list(own["rank"]) == list(range(1, 11)) and own["similarity"].is_monotonic_decreasing
        hits, asked = hits + len(best & set(own["key"])), asked + 10
    assert hits / asked >= 0.9, hits / asked
    print("recall", hits / asked)


@pytest.mark.parametrize("least", [0.95, 0.5, -1.0])
def test_thresholds_are_exact(spark, tmp_path, monkeypatch, least):
    """A third of the rows in one list, rows and queries in many blocks, repeated rows and keys, nulls, wrong lengths and a zero."""
    monkeypatch.setattr(ivf, "MOST_ROWS", 40)
    monkeypatch.setattr(ivf, "MOST_QUERIES", 5)
    random = np.random.default_rng(1)
    points = np.concatenate([random.normal(size=(200, 8)), random.normal(size=8) + 0.01 * random.normal(size=(100, 8))]).astype(np.float32)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    odd = [(7, rows[7][1]), (900, rows[7][1]), (901, None), (None, rows[3][1]), (902, [1.0]), (903, [0.0] * 8), (904, [])]
    df = spark.createDataFrame(rows + odd, "k bigint, v array<float>").withColumns({c: F.lit(1) for c in ("list", "key", "angle", "n", "query")})
    q = ivf.fit(df.filter("size(v) = 8"), "k", "v", lists=12)
    ivf.index(df, q, "k", "v").write.parquet(str(tmp_path / "i"))
    indexed = spark.read.parquet(str(tmp_path / "i"))
    kept = [(k, np.array(v)) for k, v in rows + odd if k is not None and v is not None and len(v) == 8]
    assert indexed.count() == len(kept)
    keys = np.array([k for k, _ in kept])
    m = np.stack([v for _, v in kept]).astype(float)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    want = {}
    for k, p in zip(keys, m, strict=True):
        s = np.round(m @ p, 6)
        s[keys == k] = -2
        over = s >= least
        if over.any() and k % 3 == 0:
            want[int(k)] = (int(keys[over].min()), int(keys[s == s.max()].min()), float(s.max()))
    asked = df.filter("k % 3 = 0 or k is null")
    for found in (ivf.within(indexed, q, asked, "k", "v", least, 6), ivf.all_pairs(df.filter("size(v) = 8 or v is null"), asked, "k", "v", least, 6)):
        got = {r["query"]: (r.first_hit, r.best, round(r.similarity, 6)) for r in found.collect()}
        assert got == want


def test_parted_data_need_few_lists(spark):
    """Few lists for the nearest, and most lists can't hold a hit."""
    random = np.random.default_rng(2)
    centres = random.normal(size=(20, 16)) * 5
    rows = [(i, [float(x) for x in centres[i % 20] + random.normal(size=16)]) for i in range(600)]
    df = spark.createDataFrame(rows, "k bigint, v array<float>")
    q = ivf.fit(df, "k", "v", lists=20)
    assert q.probes <= 4
    widest = {r[0]: r[1] for r in ivf.index(df, q, "k", "v").groupBy("list").agg(F.max("angle")).collect()}
    reach = np.arccos(0.9) + np.array([widest.get(i, -9) for i in range(20)])
    assert (np.arccos(np.clip(unit(np.array([r[1] for r in rows])) @ q.centroids.T, -1, 1)) <= reach).mean() < 0.3


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k bigint, v array<float>")
    q = ivf.fit(df, "k", "v")
    none = df.filter("false")
    indexed = ivf.index(df, q, "k", "v")
    assert ivf.within(indexed, q, none, "k", "v", 0.1).count() == 0 == ivf.within(ivf.index(none, q, "k", "v"), q, df, "k", "v", -1.0).count()
    assert ivf.nearest(indexed, q, none, "k", "v", 3).count() == 0 == ivf.all_pairs(none, df, "k", "v", 0.1).count()
    assert [(r["query"], r.key) for r in ivf.nearest(indexed, q, df, "k", "v", 3).orderBy("query").collect()] == [(1, 2), (2, 1)]
    with pytest.raises(ValueError):
        ivf.fit(none, "k", "v")
