"""The candidate filter chain, the audits and the gates against examples."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.functions import images
from shelfloom.operators import catalog

SCHEMA = "k int, product string, brand string, url string, title string, width int, height int, synonyms array<string>, competitors array<string>"


def row(k, **changed):
    base = {"product": "Nido Milk Powder 900g", "brand": "Nido", "url": "https://shop.ae/nido.jpg", "title": "NIDO milk powder 900g", "width": 800, "height": 600, "synonyms": ["نيدو"], "competitors": ["Anchor", ""]}
    return (k, *(base | changed).values())


def test_candidate_chain(spark):
    cases = [
        (row(0), None), (row(1, width=200), "smaller than 300x300: 200x600"), (row(2, title="Nido vector art"), "excluded word: vector"), (row(3, title="smart start of Nido"), None),
        (row(4, url="https://i.pinimg.com/nido.jpg"), "excluded domain: i.pinimg.com"), (row(5, title="Anchor and nido"), "competitor: anchor"), (row(6, title="Nido 400 g"), "another size or pack"),
        (row(7, url="https://x.com/1.jpg", title="milk powder"), "brand is missing: nido"), (row(8, url="https://x.com/1.jpg", title="نيدو"), None), (row(9, url=None, title=None), "brand is missing: nido"), (row(10, url="https://freepik.com/nido-clip-art"), "excluded word: freepik"),
        (row(11, brand=None, synonyms=None, competitors=None), None),
    ]
    df = spark.createDataFrame([r for r, _ in cases], SCHEMA)
    got = {r.k: r for r in catalog.candidate_trail(df, brand_required=True).collect()}
    assert {k: r.reject_reason for k, r in got.items()} == {r[0]: want for r, want in cases}
    assert got[0].relevance == 15 + 3 * 5 and got[1].relevance == 0 and got[0].is_local and not got[7].is_local and got[0].resolution == 480_000  # nido in both, three words in the title
    assert got[8].has_brand and not got[7].has_brand and not got[11].has_brand
    assert catalog.candidate_trail(df).filter("k = 7").first().reject_reason is None
    best = catalog.candidate_trail(df).orderBy(*catalog.trail_order(F.asc("k"))).first()
    assert best.k == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_verification_stops_at_the_first_gate(spark):
    def v(resolution=True, background=True, content=True, is_global=False, logo=None, visual=None, ocr=1.0, judge=None):
        number = lambda x: F.lit(x).cast("double")
        r = one(spark, catalog.verification(F.lit(resolution), F.lit(background), F.lit(content), F.lit(is_global), number(logo), number(visual), number(ocr), number(judge)))
        return r.decision, r.fusion, r.failed

    assert v(resolution=False, background=False) == ("AUTO_REJECT", 0.0, "RESOLUTION") and v(background=False) == ("AUTO_REJECT", 0.0, "BACKGROUND") and v(content=False)[2] == "CONTENT"
    assert v(is_global=True, logo=0.84) == ("AUTO_REJECT", 0.0, "LOGO") and v(is_global=True, logo=0.85)[0] == "AUTO_APPROVE" and v(is_global=True)[2] is None and v(logo=0.1)[2] is None
    assert v() == ("AUTO_APPROVE", 0.94, None) and v(ocr=0.6) == ("MANUAL_REVIEW", 0.7, None) and v(judge=0.5) == ("AUTO_REJECT", 0.47, None)


def test_visual_audit(spark):
    audit = lambda q, w, h, page="https://www.walmart.com/x", c=1.0: one(spark, catalog.visual_audit(F.lit(q), F.lit(w), F.lit(h), F.lit(page), F.lit("https://cdn.shopify.com/a.png"), F.lit(c)))
    assert audit("juice", 200, 400).decision == "REJECT" and audit("juice", 200, 400).final is None
    single = audit("juice", 600, 400)
    assert (single.decision, single.matching, single.authority, single.final) == ("ACCEPT", 1.0, 0.968, 0.99)
    assert audit("juice", 500, 500).matching == 0.05 and audit("juice", 500, 500).decision == "REJECT"
    assert audit("water 6 x 500", 500, 500).matching == 1.7 and audit("water 6 x 500", 900, 500).matching == 0.02


def test_master_audit_and_unified_score(spark):
    m = one(spark, catalog.master_audit(F.lit(50.0), F.lit(2400.0), F.lit(0.3), F.lit(True), F.lit(True)))
    assert (m.aesthetic, m.specification) == (15 + 40 + 6 + 10, 80.0)
    m = one(spark, catalog.master_audit(F.lit(50.0), F.lit(600.0), F.lit(0.5), F.lit(False), F.lit(True)))
    assert (m.aesthetic, m.specification) == (15 + 20 + 10, 100.0)
    u = lambda gates=True, blocks=1.0, sharp=500.0: one(spark, catalog.unified_quality(F.lit(800), F.lit(400), F.lit(sharp), F.lit(1.0), F.lit(0.8), F.lit(20.0), F.lit(blocks), F.lit(gates)))
    assert u().score == pytest.approx(0.1 + 0.3 + 0.2 + 0.2 + 0.05) and u().approved and (u(False).score, u(False).approved) == (0.0, False)
    assert u(blocks=3.0).score == pytest.approx(0.65) and not one(spark, catalog.unified_quality(F.lit(80), F.lit(40), F.lit(1.0), F.lit(0.1), F.lit(0.1), F.lit(0.0), F.lit(1.0), F.lit(True))).approved


def test_quality_gates(spark):
    g = lambda **x: one(spark, catalog.quality_gates(*[F.lit(v) for v in ({"w": 800, "h": 600, "sharp": 200.0, "mean": 120.0, "bright": 200.0, "burnt": 0.1, "contrast": 200.0, "blocks": 1.0} | x).values()]))
    assert g() == [] and g(w=400) == ["too small"] and g(w=3000, h=600) == ["aspect ratio"] and g(sharp=99.0) == ["blurred"] and g(mean=34.0) == g(bright=63.0) == ["underexposed"]
    assert g(mean=236.0) == g(burnt=0.21) == ["overexposed"] and g(contrast=38.0) == ["low contrast"] and g(blocks=2.5) == ["over-compressed"] and g(w=400, h=100, sharp=1.0) == ["too small", "aspect ratio", "blurred"]


def test_background_gates():
    """Each gate has its own border, level and shares."""
    image = np.full((420, 420, 3), 255.0)
    image[20:400, 20:400] = 90
    assert {n: images.background_gate(n, image)[2] for n in images.BACKGROUND_GATES} == {"strict": False, "perimeter": True, "original": True, "compliance": None}  # a fill of 0.82; the last has no verdict
    image[12:408, 12:408] = 90
    assert images.background_gate("strict", image)[2] and images.background_gate("strict", image)[1] == pytest.approx(396**2 / 420**2)
    image[0, :80] = 249
    assert [images.background_gate(n, image)[2] for n in ("perimeter", "original")] == [False, True]
    image[0, :80] = 100
    assert not images.background_gate("original", image)[2] and images.background_gate("compliance", image)[0] == pytest.approx(1 - 81 / 1680)  # the corner is in a row and in a column
    assert not images.background_gate("strict", image[:20, :20])[2] and not images.background_gate("original", image[:300, :300])[2]


def test_packaging():
    mask = np.zeros((20, 20), dtype=bool)
    mask[5:15, 5:15] = True
    assert images.hull_ratio(mask) == 0.81 and images.hull_ratio(mask[:6, :6]) == 0.0  # nine by nine between the centres, ten by ten pixels
    picture = np.where(mask, 30.0, 255.0)[..., None].repeat(3, axis=2)
    assert images.packaging_ratio(picture) == 0.81 and images.shadow(picture) == 0
    picture[15, 5:15] = 200
    assert images.shadow(picture) == 1 and images.fill_ratio(picture) == pytest.approx(110 / 400)


def png(image, filters):
    """A PNG file of an array (height, width, channels), each line by the next of the filters."""
    h, w, n = image.shape
    px, lines = image.astype(int), []
    at = lambda y, x: px[y, x] if y >= 0 and x >= 0 else np.zeros(n, int)
    for y in range(h):
        kind, line = filters[y % len(filters)], []
        for x in range(w):
            a, b, c = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
            paeth = [min((abs(int(i + j - k) - int(v)), o, int(v)) for o, v in enumerate((i, j, k)))[2] for i, j, k in zip(a, b, c)]
            guess = [np.zeros(n, int), a, b, (a + b) // 2, np.array(paeth)][kind]
            line += ((px[y, x] - guess) % 256).tolist()
        lines.append(bytes([kind, *line]))
    chunk = lambda name, data: len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")
    packed, head = zlib.compress(b"".join(lines)), w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")


def test_png_files(spark):
    """Every filter and kind of pixel comes back, and a file is measured as its pixels are."""
    for n in (1, 2, 3, 4):
        image = np.random.default_rng(n).integers(0, 256, (11, 7, n))
        h, w, c, raw = images.png_pixels(png(image, [0, 1, 2, 3, 4, 4, 3]))
        assert (h, w, c) == (11, 7, 1 if n == 2 else n) and (images.pixels(h, w, c, raw) == image[..., :c]).all()
    whole = png(np.full((3, 3, 3), 9), [0])
    assert images.png_pixels(None) is None and images.png_pixels(b"GIF89a") is None and images.png_pixels(whole[:50]) is None
    photo = np.random.default_rng(9).integers(0, 256, (16, 16, 3))
    files = spark.createDataFrame([(1, bytearray(png(photo, [4, 1]))), (9_007_199_254_740_993, bytearray(b"no image")), (None, None)], "k bigint, c binary")
    got = {r.k: r for r in images.measure(images.decoded(files, "k", "c"), "k", ["sharpness", "colourfulness"]).collect()}
    assert set(got) == {1, 9_007_199_254_740_993, None} and got[None].sharpness is None and got[9_007_199_254_740_993].phash is None
    assert got[1].sharpness == pytest.approx(images.laplacian_variance(photo.astype(float))) and got[1].colourfulness == images.colourfulness(photo.astype(float))
