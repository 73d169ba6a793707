from shelfloom.llm import decontaminate as D
from shelfloom.llm.words import plain_words
from tests.llm.helpers import documents, edited, words


def shingles(text, n):
    ws = plain_words(text)
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute(docs, items, size=5, percent=80):
    out = set()
    for i, t in items:
        n = min(size, len(plain_words(t)))
        if not n:
            continue
        wanted = shingles(t, n)
        for d, text, *_ in docs:
            shared = len(wanted & shingles(text, n))
            if 100 * shared >= percent * len(wanted):
                out.add((d, i, len(wanted), shared))
    return out


def case():
    items = [(i, " ".join(words(i, 14 + 3 * i))) for i in range(12)] + [(50, "Short one"), (51, ""), (52, None), (53, "a a a a a a a a")]
    docs = []
    for i in range(12):
        inside = edited(words(i, 14 + 3 * i), i, i % 3)
        docs.append((i, " ".join(words(900 + i, 300)) + ". " + " ".join(inside).upper() + "! " + " ".join(words(800 + i, 200))))
    docs += [(100, " ".join(words(0, 14)[:8])), (101, None), (102, ""), (103, "the short, one"), (104, "a " * 9), (0, docs[0][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = case()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (3, 20_000):
        got = {tuple(r) for r in D.contained_items(documents(spark, docs), table, most_items=most).select("doc_id", "item_id", "n_shingles", "n_shared").collect()}
        assert got == brute(docs, items) and len(got) > 8


def test_rows_without_items(spark):
    docs, items = case()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    bad = {d for d, *_ in brute(docs, items)}
    df = documents(spark, docs)
    for most in (100, 10**9):
        out = D.without_items(df, table, most_chars=most)
        assert out.columns == df.columns
        assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, *_ in docs if d not in bad)
    assert D.without_items(df, table.filter("false")).count() == len(docs)
    assert D.contained_items(df.filter("false"), table, most_items=0).count() == 0 and D.without_items(df.filter("false"), table, most_items=0).count() == 0
    assert D.contained_items(df, table.filter("false")).count() == 0
    assert D.contained_items(df.filter("false"), table).count() == 0


def test_sketch_misses_nothing():
    """An item of which just enough is left is found, whichever shingles are gone."""
    for n in (14, 21, 40, 59):
        ws = words(n, n)
        items = D.Items([(1, " ".join(ws))])
        total = n - 4
        for cut in range(total - -(-80 * total // 100) + 1):
            for left in (ws[cut:], ws[: n - cut]):
                found = list(items.found(left, D.WordHashes().of(left)))
                assert found == [(1, total, total - cut)]
