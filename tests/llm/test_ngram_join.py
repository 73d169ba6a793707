import random
from collections import defaultdict

import numpy as np
import pytest

from shelfloom.llm import ngram_join, scratch
from shelfloom.llm.components import components
from tests.llm.helpers import documents, edited, words


def shingles(text, size=4):
    ws = (text or "").encode().lower().split()
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)) if len(ws) >= size else frozenset([tuple(ws)])


def brute(rows, percent=85, size=4):
    sets = {d: shingles(t, size) for d, t, *_ in rows}
    ids = sorted(sets)
    linked = defaultdict(set)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                linked[a].add(b)
                linked[b].add(a)
    out = {}
    for a in ids:
        seen, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[a] = (len(sets[a]), min(seen), len(linked[a]))
    return out


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in df.collect()}


def corpus():
    rows, k = [], 0
    for seed in range(12):
        base = words(seed, [6, 12, 30, 80, 200, 600][seed % 6])
        for copy in range(6):
            rows.append((k, " ".join(edited(base, seed * 100 + copy, copy * len(base) // 80))))
            k += 1
    passage = " ".join(words(99, 60))
    rows += [(k + i, passage + " " + " ".join(words(1000 + i, 90))) for i in range(20)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "One Two"), (504, "one  two"), (505, "a b c d"), (506, "a b c d e"), (507, "é ü ß ñ"), (508, rows[3][1].upper())]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    assert result(ngram_join.jaccard_join(documents(spark, rows), 4, 85)) == brute(rows)


def test_blocks_of_a_large_family(spark):
    """A family over many blocks has the links of one block."""
    base = words(1, 60)
    rows = [(i, " ".join(edited(base, i, i % 4))) for i in range(60)]
    assert result(ngram_join.jaccard_join(documents(spark, rows), 4, 85, block_tokens=500)) == brute(rows)


def test_hot_signatures(spark):
    """Signatures that are taken for hot aren't shuffled; the links are the same, and so they are where only some are hot."""
    base = words(1, 60)
    rows = [(i, " ".join(edited(base, i, i % 4))) for i in range(50)] + corpus()[:40]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    for least in (1, 12):
        assert result(ngram_join.jaccard_join(documents(spark, rows), 4, 85, hot_rows=least)) == brute(rows)


def test_chain_of_links(spark):
    """Ends of a chain are one class without a link between them."""
    ws, rows = words(5, 120), []
    for i in range(12):
        rows.append((100 - i, " ".join(ws)))
        ws = [*ws[4:], *words(50 + i, 4)]
    got = result(ngram_join.jaccard_join(documents(spark, rows), 4, 85))
    assert got == brute(rows) and len({c for _, c, _ in got.values()}) == 1


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (3, None)]
    assert result(ngram_join.jaccard_join(documents(spark, rows), 4, 85)) == {1: (5, 1, 1), 2: (5, 1, 1), 3: (0, 3, 0)}
    assert ngram_join.jaccard_join(documents(spark, [])).count() == 0
    assert ngram_join.jaccard_join(documents(spark, [(None, "a b c d e")])).count() == 0


def test_very_long_text(spark):
    ws = words(3, 60_000, 10**9)
    rows = [(1, " ".join(ws)), (2, " ".join(edited(ws, 1, 200))), (3, " ".join(words(4, 60_000, 10**9)))]
    assert result(ngram_join.jaccard_join(documents(spark, rows), 4, 85)) == brute(rows)


def test_signatures_meet():
    """Any two sets at the threshold share a signature, and enough of them."""
    rule, r = ngram_join.Links(4, 85), random.Random(0)
    for n in [6, 7, 9, 13, 20, 41, 77, 150, 333, 900]:
        for _ in range(20):
            universe = np.array(r.sample(range(1 << 62), 2 * n + 10), dtype=np.uint64) * np.uint64(4)
            x = universe[:n]
            drop = r.randrange(0, n * 15 // 100 + 1)
            y = np.concatenate([x[drop:], universe[n : n + r.randrange(0, n * 18 // 100 + 1)]])
            shared = n - drop
            if 100 * shared < 85 * (n + len(y) - shared) or set(x.tolist()) == set(y.tolist()):
                continue
            a, bands_a, needs_a = rule.signatures(np.sort(x))
            b, bands_b, needs_b = rule.signatures(np.sort(y))
            common = set(a.tolist()) & set(b.tolist())
            ok = False
            for band, need in zip(bands_a, needs_a):
                if band in bands_b:
                    both = sum(1 for s in common if s & 63 == band)
                    ok |= both >= max(need, needs_b[bands_b.index(band)]) or both >= 1 and need == 1
            assert ok, (n, len(y))


def test_divide_skip_equals_counting():
    rule, r = ngram_join.Links(4, 85), random.Random(1)
    base = np.arange(1, 101, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.sample(base.tolist(), 92), [1000 + i * 7 + j for j in range(4)]]).astype(np.uint64)) for i in range(40)]
    for q, found in zip(sets, ngram_join.t_occurrence(rule, sets, sets)):
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))]
        assert found.tolist() == want


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 1)], {}), ([(1, 2), (3, 2), (9, 8), (2, 1)], {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}), ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)})])
def test_components(spark, edges, want):
    got = components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert {r.node: r.component for r in got.collect()} == want


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_bound_on_differing_shingles(percent):
    """The two largest sums of a band have the most differing shingles of all in it."""
    rule, most = ngram_join.Links(4, percent), 0
    for both in range(1, 4001):
        most = max(most, rule.differ(both))
        if both % 2 == 0 and both >= 14:
            assert max(rule.differ(both), rule.differ(both - 1)) == most


def test_a_common_passage_makes_no_family(spark, monkeypatch):
    """Texts that share a passage and no more are searched by nobody, and pairs beside them are found; so families don't grow with the number of documents."""
    r, tables = random.Random(3), {}
    word = lambda: f"w{r.randrange(10**9)}"
    passage = [word() for _ in range(30)]
    texts = [[word() for _ in range(460)] for _ in range(60)]
    texts = [t[:200] + passage + t[200:] for t in texts]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join(texts[i][:480])) for i in range(3)]
    write = scratch.table

    def table(df, label):
        tables[label] = write(df, label)
        return tables[label]

    monkeypatch.setattr(scratch, "table", table)
    got = {x.doc_id: (x.component_id, x.n_links) for x in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), size=5, percent=80).collect()}
    assert got == {i: (i % 100 if i % 100 < 3 else i, int(i % 100 < 3)) for i, _ in rows}
    assert {x.entry for x in tables["active"].select("entry").collect()} == {0, 1, 2, 100, 101, 102}
