"""Worked examples, and expressions against plain formulas."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfloom.functions import images, scoring, text, vectors
from shelfloom.operators import matching, pricing, quality, stateful, vector_models
from shelfloom.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_jaro_winkler_examples():
    assert text.jaro_winkler_value("Pepsi Cola", "Pepsi Colz") >= 0.90
    assert text.jaro_winkler_value("MARTHA", "MARHTA") == 0.9611
    assert text.jaro_winkler_value("", "") == 1.0 and text.jaro_winkler_value("a", None) == 0.0
    assert text.jaro_winkler_value("abc", "xyz") == 0.0


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=8), st.text("abc ", max_size=8))
def test_jaro_winkler_is_bounded_and_symmetric(a, b):
    v = text.jaro_winkler_value(a, b)
    assert 0 <= v <= 1 and abs(v - text.jaro_winkler_value(b, a)) < 1e-3 or a.strip() != b.strip()


def test_levenshtein(spark):
    a, b = F.lit("American Garden"), F.lit("Amercan Gardn")
    assert one(spark, text.levenshtein(a, b)) == 2
    assert one(spark, text.levenshtein_similarity(a, b)) >= 0.85
    assert one(spark, text.levenshtein_similarity(F.lit(None).cast("string"), F.lit(" "))) == 1.0
    assert one(spark, text.levenshtein(F.lit("é"), F.lit("e"))) == 1


@pytest.mark.parametrize("t,want", [("٨٠٠ غرام", (800.0, "g")), ("0.8 kg bottle", (800.0, "g")), ("١.٥ لتر", (1500.0, "ml")), ("12 fl oz", (354.882, "ml")), ("none", None), ("", None), ("5 kgs 2 ml", (5000.0, "g"))])
def test_metric(spark, t, want):
    got = one(spark, text.metric(F.lit(t)))
    assert (None if got is None else (round(got["value"], 4), got["unit"])) == want


def test_metric_match(spark):
    m = lambda a, b: one(spark, text.metric_match(F.lit(a), F.lit(b)))
    assert (m("800 g", "0.8 kg"), m("1 g", "1 ml"), m("x", "1 ml"), m("0 g", "0 kg"), m("100 g", "103 g")) == (1.0, 0.0, 0.5, 1.0, 0.0)


def test_intent(spark):
    i = lambda t: tuple(one(spark, text.query_intent(F.lit(t))))
    assert i("كرتونة مياه صحية 12 حبة") == ("MULTI_PACK", 12) and i("bottle of water") == ("SINGLE_UNIT", 1) and i("6x330ml") == ("MULTI_PACK", 6) and i("unboxed") == ("SINGLE_UNIT", 1)
    s = lambda *a: one(spark, text.intent_score(*[F.lit(x) for x in a]))
    assert s("MULTI_PACK", 12, False, 12, 1.0) == 0.02 and s("MULTI_PACK", 12, True, 12, 1.0) == 1.7 and s("SINGLE_UNIT", 1, True, 1, 1.0) == 0.05


def test_gtin_and_links(spark):
    good = "629104100123"
    digit = (10 - sum(int(c) * (1, 3)[i % 2] for i, c in enumerate(good)) % 10) % 10
    v = lambda c: one(spark, text.gtin13_valid(F.lit(c)))
    assert v(good + str(digit)) and not v(good + str((digit + 1) % 10)) and not v("12a") and not v("")
    g = one(spark, text.gs1_link(F.lit("/01/06291001000142/10/BATCH2026A/21/SERIAL998")))
    assert (g.gtin, g.batch, g.serial, g.gln) == ("06291001000142", "BATCH2026A", "SERIAL998", None)
    assert one(spark, text.gs1_uri(F.lit("https://a.b/"), F.lit("6291"), F.lit(None).cast("string"), F.lit("S"))) == "https://a.b/01/00000000006291/21/S"


def test_row_hash(spark):
    got = one(spark, text.row_hash(F.lit("SKU-101"), F.lit("x"), F.lit(24.5), F.lit(100)))
    assert got == __import__("hashlib").sha256(b"SKU-101|x|24.5000|100").hexdigest()


def test_hashes_and_magic(spark):
    h = lambda a, b: one(spark, text.hamming_hex(F.lit(a), F.lit(b)))
    assert h("ffff0000ffff0000", "ffff0000ffff0001") == 1 and h("ffff0000ffff0000", "0000ffff0000ffff") == 64 and h("x", "ffff0000ffff0000") == 64
    m = lambda b: one(spark, text.mime_by_magic(F.lit(b)))
    assert m(b"\xff\xd8\xff\xe0" + b"0" * 20) == "image/jpeg" and m(b"RIFF\x00\x00\x00\x00WEBPVP8 ") == "image/webp" and m(b"") is None
    assert tuple(one(spark, text.image_dimensions(F.lit(b"GIF89a" + bytes([0x5E, 1, 0x5E, 1]))))) == (350, 350)


def test_titles_and_markup(spark):
    assert one(spark, text.clean_title(F.lit("Nido® Milk 400g Pack of 12 6291041001239!"))) == "nido milk"
    assert one(spark, text.clean_title(F.lit("ﬁne"), compose=True)) == "fine"
    assert one(spark, text.tagged(F.lit("<think>a</think><query> b </query>"), "query")) == "b"
    assert one(spark, text.without_fences(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    assert one(spark, text.normal_search(F.lit("500مل، إختبار"))) == "500 مل اختبار"
    assert one(spark, text.volume_clash(F.lit("milk 1l"), F.lit("milk 500ml"))) and not one(spark, text.volume_clash(F.lit("milk 1l"), F.lit("milk 1000 ml")))
    assert one(spark, text.volume_clash(F.lit("a 1l x6"), F.lit("a 1l x12")))
    j = one(spark, text.json_ld(F.lit("not json")))
    assert not j.has_product and j.completeness == 0


def test_money(spark):
    assert one(spark, scoring.landed_cost(*[F.lit(float(x)) for x in (100, 10, 5, 15)])) == 100.0
    m = one(spark, scoring.margins(F.lit(100.0), [F.lit(40.0), F.lit(10.0)], [F.lit(5.0), F.lit(3.0), F.lit(2.0)], [F.lit(10.0), F.lit(2.0), F.lit(3.0)], F.lit("grocery")))
    assert (m.cm1, m.cm2, m.cm3, m.healthy) == (50.0, 40.0, 25.0, True)
    assert one(spark, scoring.margins(F.lit(0.0), [F.lit(1.0)], [F.lit(1.0)], [F.lit(1.0)], F.lit("x")))["cm3"] == 0


def test_nutrition(spark):
    n = lambda kcal: one(spark, scoring.nutrition_check(*[F.lit(float(x)) for x in (kcal, 10, 20, 2, 5, 0, 100)], F.lit("g")))
    assert n(161).valid and n(161).estimated == 161.0 and not n(500).valid


def test_fusion_drift_linkage(spark):
    assert one(spark, scoring.fusion(F.lit(0.90), F.lit(0.95), F.lit(1.0))) == 0.93
    d = lambda s, a, c: one(spark, scoring.package_drift(F.lit(s), F.lit(a), F.lit(False), F.lit(c)))
    assert d(0.7, True, True).risk == "IMMEDIATE_ESCALATION" and d(0.8, False, True).risk == "TECHNICAL_REVIEW_HOLD" and d(0.82, False, False).risk == "SCHEDULED_QUEUE" and d(0.95, False, False).risk == "NO_DRIFT"
    total = sum((scoring.linkage_weight(f, F.lit(True)) for f in scoring.LINKAGE), F.lit(0.0))
    assert round(one(spark, total), 4) == 32.6741


def test_scores(spark):
    assert one(spark, scoring.iou(F.array(*map(F.lit, (10, 10, 100, 100))), F.array(*map(F.lit, (20, 20, 100, 100))))) == round(8100 / 11900, 4)
    assert one(spark, scoring.nima(F.array(*map(F.lit, (0.01, 0.02, 0.02, 0.05, 0.10, 0.20, 0.30, 0.20, 0.08, 0.02))))) == 6.63
    assert one(spark, scoring.nima(F.array(F.lit(1.0)))) == 5.5
    u = [one(spark, scoring.uncertainty(F.array(*map(F.lit, p))))["priority"] for p in ((0.95, 0.03, 0.02), (0.51, 0.49, 0.0), (0.34, 0.33, 0.33))]
    assert [round(x, 3) for x in u] == [0.098, 0.727, 0.880]
    assert one(spark, scoring.importance(*map(F.lit, (800, 1000, 25, 10, 5)))) == 485.0


def test_colours(spark):
    """Pairs of the published CIEDE2000 test data."""
    lab = lambda v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("lab", v)])
    for p, q, want in (((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644), ((50, 0, 0), (50, -1, 2), 2.3669), ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082)):
        assert one(spark, scoring.ciede2000(lab(p), lab(q))) == pytest.approx(want, abs=1e-4)
    red = one(spark, scoring.lab(F.lit(255.0), F.lit(0.0), F.lit(0.0)))
    assert (red.l, red.a, red.b) == pytest.approx((53.24, 80.09, 67.2), abs=0.02)


def test_quality(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "", 2.0), (3, "c", None)], "id int, name string, price double")
    assert quality.null_rate(df, df.columns).first()[0] == 22.22
    scores = spark.createDataFrame([(x,) for x in (0.01, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.33, 0.36, 0.40)], "s double").withColumn("g", F.lit(1))
    assert quality.conformal_quantile(scores, "s", ["g"], 0.05).first()["threshold"] == 0.40
    assert round(one(spark, quality.trust(F.lit(10), F.lit(0), F.lit(0))), 4) == 0.9231 and one(spark, quality.trust(F.lit(0), F.lit(4), F.lit(4))) == 0.0
    assert one(spark, quality.failsafe(F.lit(400), F.lit(1000))) is None
    with pytest.raises(Exception, match="frozen"):
        one(spark, quality.failsafe(F.lit(600), F.lit(1000)))
    assert spark.createDataFrame([(0.02,), (0.01,)], "r double").agg(quality.combined_loss(F.col("r"))).first()[0] == 0.0298


def test_promotions(spark):
    rows = [(1, 30, 100.0), (1, 25, 130.0), (1, 20, 101.0), (2, 30, 100.0), (2, 10, 130.0), (2, 1, 101.0), (3, 1, 5.0)]
    got = {r.k: r.fake for r in pricing.fake_promotions(spark.createDataFrame(rows, "k int, days_ago int, price double"), "k", "days_ago", "price").collect()}
    assert got == {1: True, 2: False, 3: False}


def test_double_ml_recovers_an_effect(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=500)
    t = x + r.normal(size=500)
    y = 3 * t + 2 * x + 0.1 * r.normal(size=500)
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(y, t, x)], "y double, t double, x double")
    got = pricing.double_ml(df, "y", "t", "x").first()
    assert got.n == 500 and abs(got.theta - 3) < 0.02
    assert pricing.double_ml(df.limit(5), "y", "t", "x").first().theta == 0


def test_vectors(spark):
    a, b = F.array(*map(F.lit, (1.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0)))
    assert one(spark, vectors.cosine_distance(a, b)) == 2.0 and one(spark, vectors.cosine_distance(a, a)) == 0.0
    assert one(spark, vectors.rocchio(a, F.array(F.lit(1 / 0.45), F.lit(0.0)))) == [1.0, 0.0]
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(4, 4)))[0]
    xs = r.normal(size=(50, 4))
    df = spark.createDataFrame([(x.tolist(), (q @ x).tolist()) for x in xs], "x array<double>, y array<double>")
    assert np.allclose(vector_models.alignment(df, "x", "y", 4), q, atol=1e-9)


def test_product_codes(spark):
    r = np.random.default_rng(2)
    m = r.normal(size=(40, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "k bigint, v array<double>")
    books = vector_models.codebooks(df, "k", "v", 2, 4)
    codes = {c.k: c.codes for c in vector_models.encode(df, "k", "v", books).collect()}
    for i, v in enumerate(m):
        want = [int(((books[j] - v[4 * j : 4 * j + 4]) ** 2).sum(axis=1).argmin()) for j in range(2)]
        assert codes[i] == want
    d = {c.k: c.distance for c in vector_models.adc_distances(vector_models.encode(df, "k", "v", books), m[5].tolist(), books).collect()}
    coded = np.concatenate([books[j, codes[7][j]] for j in range(2)])
    assert d[7] == round(float(np.linalg.norm(coded - m[5])), 4)


def test_matching(spark):
    vocabulary = ["Nido", "Almarai", "American Garden"]
    c = lambda t: one(spark, matching.closest_word(F.lit(t), vocabulary))
    assert c("almarei") == "Almarai" and c("zzz") == "zzz"
    p = lambda t: one(spark, matching.closest_phrase(F.lit(t), vocabulary))
    assert p("NIDO") == "Nido" and p("garden") == "American Garden" and p("Amercan Gardn") == "American Garden" and p("qq") is None and p("") is None
    e = {r.n: (r.entity, r.confidence) for r in matching.resolve_entities(spark.createDataFrame([("نيدو",), ("Nidoo",), ("brand new",)], "n string"), "n", {"نيدو": "Nido", "nido": "Nido"}).collect()}
    assert e["نيدو"] == ("Nido", 1.0) and e["Nidoo"][0] == "Nido" and e["brand new"] == ("Brand New", 0.5)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=2, max_size=12), st.integers(0, 5))
def test_hamming_pairs_miss_nothing(spark, hashes, most):
    spread = [h * 0x0101010101010101 % (1 << 63) for h in hashes]
    df = spark.createDataFrame(list(enumerate(spread)), "k bigint, h bigint")
    got = {(r.a, r.b, r.distance) for r in matching.hamming_pairs(df, "k", "h", most).collect()}
    first = {}
    for i, h in enumerate(spread):
        first.setdefault(h, i)
    want = {(i, j, (a ^ b).bit_count()) for a, i in first.items() for b, j in first.items() if i < j and a and b and (a ^ b).bit_count() <= most}
    assert got == want
    assert {(r.k, r.class_id) for r in matching.hash_classes(df, "k", "h").collect()} == {(i, first[h]) for i, h in enumerate(spread) if h}


def test_folds():
    s = ({}, {}, None)
    for ok in [True] * 5:
        s = stateful.router_step(s, 1, ok)
    for ok in [True] * 10:
        s = stateful.router_step(s, 2, ok)
    assert s[2] == 1
    s = stateful.router_step(stateful.router_step(s, 1, False), 1, False)
    assert s[2] == 2
    assert stateful.rate_step(1.0, True) == 1.25 and stateful.rate_step(1.25, False) == 0.75 and stateful.rate_step(8.0, True) == 8.0
    b = ("CLOSED", 0, 0.0)
    for at in (1.0, 2.0, 3.0):
        b = stateful.breaker_step(b, False, at)
    assert b[0] == "OPEN" and stateful.breaker_step(b, True, 10.0)[0] == "OPEN" and stateful.breaker_step(b, True, 400.0)[0] == "CLOSED" and stateful.breaker_step(b, False, 400.0)[0] == "OPEN"


def test_delta_sync_twice_writes_nothing(spark, tmp_path):
    from shelfloom.streaming import jobs

    df = spark.createDataFrame([(1, 1, "a", 1.0), (2, 1, "b", 2.0), (3, 2, "a", 1.0)], "event_id bigint, user_id bigint, event_type string, value double")
    sync = jobs.delta_sync(str(tmp_path))
    sync(df, 0)
    sync(df, 1)
    sync(df.withColumn("value", F.lit(9.0)).filter("user_id = 2"), 2)
    sync(df.withColumn("value", F.lit(9.0)).filter("user_id = 2"), 2)  # a retry of the batch
    sync(df.withColumn("value", F.lit(9.0)), 3)
    assert [spark.read.parquet(f"{tmp_path}/rows/{i}").count() for i in range(4)] == [2, 0, 1, 1]
    assert sorted(p.name for p in (tmp_path / "known").iterdir() if not p.name.startswith(".")) == ["2", "3"]  # no batch reads more than the one before


def test_folds_keep_null_keys_and_large_ids(spark):
    """Rows without a key are one sequence, and integers beside a null stay what they are."""
    big = 9_007_199_254_740_993
    rows = [(k, i, e, big if i else None) for k in (None, big, big + 1) for i, e in enumerate(["error"] * 4)]
    df = spark.createDataFrame(rows, "user_id bigint, n int, event_type string, other bigint").coalesce(1)
    step = lambda s, r: ((h := stateful.health_step(s, r["event_type"] != "error")), (h,))
    got = stateful.fold(df, "user_id", ["n"], 100.0, step, ["n", "other"], "health double").collect()
    assert {(r.user_id, r.n): (r.other, r.health) for r in got} == {(k, i): (big if i else None, 80.0 - 20 * i) for k in (None, big, big + 1) for i in range(4)}


def test_images():
    flat = np.full((20, 20, 3), 255.0)
    noisy = np.random.default_rng(0).integers(0, 255, (20, 20, 3)).astype(float)
    assert images.laplacian_variance(flat) == 0 < images.laplacian_variance(noisy)
    assert images.white_border(flat) == 1.0 and images.colourfulness(flat) == 0 and images.watermark_energy(flat) == 0 and images.colour_entropy(flat) == 0
    assert images.tenengrad(noisy) > images.tenengrad(flat) and images.brenner(flat) == 0 and 0 <= images.cavi(noisy) <= 10
    near = noisy.copy()
    near[0, 0] += 3
    assert (images.perceptual_hash(noisy) ^ images.perceptual_hash(near)).bit_count() <= 3
    square = np.zeros((100, 100))
    square[20:80, 20:80] = 1
    assert images.hull_ratio(square) == 0.9669 and images.hull_ratio(np.zeros((5, 5))) == 0.0  # 59 x 59 between the centres of 60 x 60 pixels


def test_sources():
    assert tables.row_ranges("2-5,9") == [(2, 5), (9, 9)] and tables.row_ranges("x") is None and tables.row_ranges(None) is None
    assert tables.header_fields(["ID", " Title ", "x", "Maker"]) == {"name": " Title ", "brand": "Maker"}


def test_log_tail_and_settings(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(f"line {i}" for i in range(300)))
    got = tables.log_tail(spark, str(tmp_path / "log"), 100).collect()
    assert [(r.line_number, r.line) for r in got] == [(i + 1, f"line {i}") for i in range(200, 300)]
    (tmp_path / "logs").mkdir()
    for name in ("a", "b"):
        (tmp_path / "logs" / name).write_text("".join(f"{name} {i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = tables.log_tail(spark, str(tmp_path / "logs"), 2100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_number, r.line) for r in got] == [(i + 1, f"a {i}") for i in range(1900, 2000)] + [(i + 1, f"b {i}") for i in range(2000)]
    assert tables.typed_settings({"a": "1, 2,", "b": "no", "c": "x", "d": "0.5"}, {"a": "list", "b": "bool", "c": "int", "d": "float", "e": "text"}) == {"a": ["1", "2"], "b": False, "d": 0.5}
    assert tables.settings(spark.createDataFrame([("a", "1")], "key string, value string")) == {"a": "1"}
    assert math.isclose(one(spark, scoring.sigmoid_probability([F.lit(2.0)], [1.0], [1.0], [0.0], 0.0)), 0.5)


def test_ports(spark):
    from shelfloom.functions import ports

    assert one(spark, ports.call("visual_similarity", F.lit("a"), F.lit("b"))) == 0.85
    ports.register("visual_similarity", lambda a, b: (a == b).astype(float))
    try:
        df = spark.createDataFrame([("a", "a"), ("a", "b")], "a string, b string")
        assert [r[0] for r in df.select(ports.call("visual_similarity", F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
    finally:
        ports.register("visual_similarity", None)
    with pytest.raises(KeyError):
        ports.register("nothing", None)


def test_image_gates():
    flat = np.full((24, 24, 3), 200.0)
    noisy = np.random.default_rng(0).integers(0, 255, (24, 24, 3)).astype(float)
    spot = np.full((24, 24, 3), 255.0)
    spot[10:14, 10:14] = 0
    assert images.has_content(flat) == 0 and images.has_content(noisy) == 1
    assert images.exposure(flat) == pytest.approx(200) and images.contrast(flat) == 0 and images.blockiness(flat) == 1.0
    assert images.centring(spot) == pytest.approx(1.0) and images.centring(np.roll(spot, 9, axis=0)) < 0.8
    assert images.naturalness(flat) == 100 and 1 <= images.aesthetic(noisy) <= 10 and images.projection_variance(spot) > images.projection_variance(flat)
    assert images.frequency_ratio(noisy) > images.frequency_ratio(spot)
    blocks = np.kron(np.random.default_rng(1).integers(0, 255, (3, 3)), np.ones((8, 8)))[..., None].repeat(3, axis=2) + np.random.default_rng(2).random((24, 24, 3))
    assert images.blockiness(blocks) > 10


def test_readers(spark, tmp_path):
    assert tables.key_values(["# c", "A=1", "B = 'x y'", "", "broken"]) == {"A": "1", "B": "x y"}
    (tmp_path / "f.json").write_text('[{"a": 1, "b": "x"}, {"a": null, "b": "y"}]')
    assert [tuple(r) for r in tables.json_records(spark, str(tmp_path / "f.json"), "a int, b string").collect()] == [(1, "x"), (None, "y")]
    e = spark.createDataFrame([(1, 5), (1, 9), (2, 7)], "k int, v int")
    assert [r.v for r in tables.candidates(e, "k", 1, [F.desc("v")]).collect()] == [9, 5]
    t = spark.sql("select timestamp '2024-01-01 00:00:00' as at union all select timestamp '2024-01-01 02:00:00'")
    assert tables.fresh(t, "at", F.expr("timestamp '2024-01-01 02:30:00'"), 3600).count() == 1


def test_jpeg_heads(spark):
    sof = b"\xff\xc0\x00\x11\x08" + (400).to_bytes(2, "big") + (600).to_bytes(2, "big") + b"\x03" + b"\0" * 9
    app = b"\xff\xe0\x00\x10JFIF\0" + b"\0" * 9
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"
    turned = b"\xff\xe1" + (len(exif) + 2).to_bytes(2, "big") + exif
    assert images.jpeg_size(b"\xff\xd8" + app + sof) == (600, 400) and images.jpeg_size(b"\xff\xd8" + turned + sof) == (400, 600)
    assert images.jpeg_size(b"GIF89a") is None and images.jpeg_size(b"\xff\xd8" + app) is None
    df = spark.createDataFrame([(b"\xff\xd8" + app + sof,), (b"x",), (None,)], "b binary")
    assert [r[0] and tuple(r[0]) for r in df.select(images.jpeg_dimensions(F.col("b"))).collect()] in ([(600, 400), (None, None), (None, None)], [(600, 400), None, None])


def test_contrastive_loss():
    r = np.random.default_rng(0)
    x = r.normal(size=(30, 16))
    assert vector_models.contrastive_loss(x, x) < 0.1 < vector_models.contrastive_loss(x, r.normal(size=(30, 16)))


def test_numbers_over_partitions(spark):
    from shelfloom.operators import ranking

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    got = ranking.numbered(df, -F.col("k")).collect()
    assert sorted((r.number, r.k) for r in got) == [(i + 1, 4999 - i) for i in range(5000)]
    assert ranking.numbered(df.filter("false"), F.col("k")).count() == 0


def test_sizes_in_both_scripts(spark):
    got = one(spark, text.sizes(F.lit("Milk 1L, 1.5 لتر and 250 g x2 12 حبة")))
    assert [(r.value, r.unit) for r in got] == [(1000.0, "ml"), (1500.0, "ml"), (250.0, "g")]
    assert one(spark, text.packs(F.lit("pack of 6 or x 12, 3pcs"))) == [6, 12, 3]


def test_sizes_need_no_latin_borders(spark):
    """Digits and letters of any script make words: a unit that goes on is no unit."""
    assert [(r.value, r.unit) for r in one(spark, text.sizes(F.lit("حليب ٢٥٠ مل، زيت 1.5لتر")))] == [(250.0, "ml"), (1500.0, "ml")]
    assert one(spark, text.sizes(F.lit("5 جرامات و 3 gé"))) == []
    assert one(spark, text.packs(F.lit("٦ حبات و 12 حبة"))) == [6, 12]
    assert one(spark, text.volume_clash(F.lit("حليب 1 لتر"), F.lit("حليب ٢ لتر"))) and not one(spark, text.volume_clash(F.lit("حليب 1 لتر"), F.lit("حليب 1000 مل")))


def test_messages_logs_and_captchas(spark):
    c = lambda m: one(spark, text.error_categories(F.lit(m)))
    assert c("Rate limit: image not found") == ["gemini", "search"] and c("Credit is low") == ["photoroom"] and c("disk full") == ["other"] and c(None) == ["other"]
    s = lambda m: one(spark, text.log_severity(F.lit(m)))
    assert [s(x) for x in ("an Error", "an error", "warning: failed", "⚠️", "success", "⚙️ go", None)] == ["error", "default", "error", "warning", "success", "system", "default"]
    p = lambda code, h: one(spark, text.looks_like_captcha(F.lit(code), F.lit(h)))
    assert p(200, "Please VERIFY YOU ARE HUMAN") and p(200, "<a>Cloudflare</a>") and p(200, "turnstile") and p(200, "Security Check")
    assert not p(403, "captcha") and not p(200, "") and not p(200, None) and not p(200, "unusual traffic")


def test_pricing_audit_of_a_history(spark):
    """Three deviations under the history before, and the fake promotion: a rise by a quarter that falls back within two weeks."""
    steady = [(1, 100 - 10 * i, 100.0 + (i % 2), 1.0) for i in range(10)] + [(1, 0, 60.0, 1.0)]
    fake = [(2, 40, 100.0, 1.0), (2, 34, 130.0, 2.0), (2, 28, 101.0, 1.0), (2, 0, 100.0, 3.0)]
    slow = [(3, 40, 100.0, 1.0), (3, 20, 130.0, 2.0), (3, 2, 101.0, 1.0)]
    df = spark.createDataFrame(steady + fake + slow + [(4, 0, 5.0, 1.0)], "k int, days_ago int, price double, peer double")
    got = {r.k: (r.price, r.sigma, r.fake) for r in pricing.audit(df, "k", "days_ago", "price", "peer").collect()}
    assert got == {1: (60.0, True, False), 2: (100.0, False, True), 3: (101.0, False, False), 4: (5.0, False, False)}


def test_conformal_quantile_is_exact(spark):
    """Groups beyond what a sketch holds, with repeats and nulls: the value of the very rank."""
    rows = [(g, (i * 7919 % 20011) / (1 if g == "a" else 100) if i % 50 else None) for g in ("a", "b") for i in range(20_000)] + [("c", 1.0)] * 3000
    df = spark.createDataFrame(rows, "g string, s double")
    for alpha in (0.05, 0.5, 0.97):
        got = {r.g: r.threshold for r in quality.conformal_quantile(df, "s", ["g"], alpha).collect()}
        for g in "abc":
            v = sorted(s for h, s in rows if h == g and s is not None)
            q = min(1.0, math.ceil(round((1 - alpha) * (len(v) + 1), 9)) / len(v))
            assert got[g] == v[max(1, math.ceil(round(q * len(v), 9))) - 1], (g, alpha)


def test_approximate_counts_are_near(spark):
    from shelfloom.plans import registry

    d = "/root/testdata/sf0.01"
    exact = {r[0]: r[1:] for r in spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").agg(F.countDistinct("l_partkey"), F.countDistinct("l_suppkey")).collect()}
    for r in registry.queries()["approx_distinct"](spark, d).collect():
        assert all(abs(a - b) <= 0.16 * b for a, b in zip((r.parts, r.suppliers), exact[r.l_returnflag]))


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace as N

    from shelfloom.sources import sinks

    nothing = N(isDefined=lambda: False)
    session = lambda master: N(conf=N(get=lambda *_: None, set=lambda *_: None), sparkContext=N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: nothing))))
    with pytest.raises(ValueError):
        sinks.folder(session("yarn"), "x")
    assert sinks.folder(session("local[2]"), "x").startswith("file://")
