"""Keys of bands by the number of hashes, and near hashes of two tables, against all pairs."""

import random

import pytest

from shelfloom.operators import matching


@pytest.mark.parametrize("agree", [None, 1, 3, 4])
def test_pairs_and_near_hashes_equal_all_pairs(spark, agree):
    r = random.Random(agree or 9)
    base = [r.getrandbits(64) for _ in range(40)]
    hashes = [0, 0, *base, *[h ^ sum(1 << b for b in r.sample(range(64), k)) for h in base for k in (0, 1, 5, 6, 7)]]
    signed = [h - (1 << 64) if h >= 1 << 63 else h for h in hashes]
    df = spark.createDataFrame(list(enumerate(signed)), "k bigint, h bigint")
    got = {(x.a, x.b): x.distance for x in matching.hamming_pairs(df, "k", "h", 6, agree=agree).collect()}
    least = {}
    for i, h in enumerate(hashes):
        if h:
            least.setdefault(h, i)
    rows = list(least.items())
    want = {tuple(sorted((i, j))): bin(x ^ y).count("1") for n, (x, i) in enumerate(rows) for y, j in rows[n + 1 :] if bin(x ^ y).count("1") <= 6}
    assert got == want
    listed = df.filter("k % 3 = 0")
    near = {x.h for x in matching.hamming_near(df, listed, "h", 4).collect()}
    assert near == {s for s, h in zip(signed, hashes, strict=True) if any(bin(h ^ hashes[j]).count("1") <= 4 for j in range(0, len(hashes), 3))}


def test_more_hashes_take_more_bands():
    chosen = [matching.bands_that_agree(n, 8) for n in (10, 2_000, 10**6, 10**9)]
    assert chosen == sorted(chosen) and chosen[0] == 1 and chosen[-1] == 4
