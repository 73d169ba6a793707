import re
from collections import Counter

from shelfloom.llm import quality_rules as Q
from shelfloom.llm import scratch
from tests.llm.helpers import documents, words

WS = "[^\x20\x09-\x0d]+"


def brute(text):
    t = text or ""
    ws = re.findall(WS, t)
    lines = [x for x in t.split("\n") if re.search(WS, x)]
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered |= set(range(i, i + 8))
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_features_against_brute_force(spark):
    p = " ".join(words(1, 12))
    texts = [None, "", "\n\n \t", "a", p, f"{p} {p}", f"{p}\n{p}\n{p}", "a " * 40, "é#ü\u00a0* $%|<>&\n\x0b\x0cx", " ".join(words(2, 9)) + " " + " ".join(words(2, 9)[:8]), "x\r\nx\r\nx", " ".join(words(5, 30_000, 300)), p[: len(p) // 2] + " " + p]
    df = Q.features(documents(spark, list(enumerate(texts))))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_verdict(spark):
    good = [(i, " ".join(words(i, 60)), f"s{i % 3}") for i in range(400)]
    noisy = [(1000 + i, " ".join(w + "###" for w in words(i, 60)), f"s{i % 3}") for i in range(12)]
    short = [(2000, "too short", "s0"), (2001, None, None), (2002, "a b " * 40, None), (2000, "too short", "s0")]
    df = documents(spark, good + noisy + short)
    out = Q.judge(Q.features(df)).collect()
    assert len(out) == len(good + noisy + short) and set(df.columns) <= set(out[0].asDict())
    kept = {r.doc_id for r in out if r.kept}
    assert kept == {g[0] for g in good}
    assert {r.doc_id for r in out if r.base_failed} == {2000, 2001, 2002}
    assert Q.judge(Q.features(df.filter("false"))).count() == 0


def test_thresholds_follow_the_group(spark):
    """What is usual in one source is an outlier in another; a small group takes the sketch of its language."""
    rows = [(i, " ".join(w + "#" for w in words(i, 60)), "code") for i in range(300)] + [(1000 + i, " ".join(words(i, 60)), "prose") for i in range(300)]
    rows += [(5000, " ".join(w + "#" for w in words(7, 60)), "prose"), (5001, " ".join(w + "#" for w in words(8, 60)), "code")]
    out = {r.doc_id: r.kept for r in Q.judge(Q.features(documents(spark, rows))).collect()}
    assert not out[5000] and out[5001] and all(out[i] for i in range(300))


def test_no_python_in_the_plan(spark):
    df = Q.judge(Q.features(documents(spark, [(1, "a b")])))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_fences_are_quantiles_of_the_group(spark):
    """Groups above the limit and above what a sketch holds exactly: each fence is that of a rank near the one asked for."""
    text = lambda i, base: " ".join(f"{(i * 31 + j * 17) % 9973:0{base + (i * 7 + j * (i % 23)) % 5}d}" for j in range(25))
    rows = [(i, text(i, base), source) for source, base in (("a", 4), ("b", 9)) for i in range(6000)]
    docs = documents(spark, rows)
    rules = Q.Rules(sketch_k=200)
    measured = scratch.table(Q.features(docs), "measured")
    fences = {r.source: r for r in Q.thresholds(scratch.table(Q.sketches(measured, rules), "sketches"), rules).collect()}
    values = {}
    for r in measured.select("source", "word_chars", "n_words").collect():
        values.setdefault(r.source, []).append(r.word_chars / r.n_words)
    assert set(fences) == {"a", "b"} and fences["a"].word_length_upper < fences["b"].word_length_upper and fences["a"].word_length_lower != fences["b"].word_length_lower
    for m, side, q, stretch, tolerance in Q.MEASURES:
        if m != "word_length":
            continue
        for source, v in values.items():
            v.sort()
            at = lambda p: v[min(len(v) - 1, max(0, round(p * len(v))))]
            ends = [at(x) + stretch * (at(x) - at(y)) + (tolerance if side == "upper" else -tolerance) for x in (q - 0.03, q + 0.03) for y in (0.47, 0.53)]
            assert min(ends) <= fences[source][f"{m}_{side}"] <= max(ends), (source, side)


def test_sources_have_fences_of_their_own(spark):
    """The share of repeats that is usual in one source rejects in another, both below the base rule."""
    again = " ".join(words(99, 9))
    rows = [(i, " ".join(words(i, 60)) + (f" {again} {again}" if i % 4 == 0 else ""), "forum") for i in range(300)] + [(1000 + i, " ".join(words(i, 60)), "press") for i in range(300)]
    rows += [(5000, rows[0][1], "press"), (5001, rows[0][1], "forum")]
    out = {r.doc_id: (r.base_failed, r.kept) for r in Q.judge(Q.features(documents(spark, rows))).collect()}
    assert out[5000] == (False, False) and out[5001] == (False, True) and all(out[i][1] for i in range(300))
