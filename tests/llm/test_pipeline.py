import os

import public_tokenizers

import corpus_pipeline as P
from shelfloom.llm import byte_bpe, decontaminate, quality_rules, scratch
from tests.llm.helpers import documents, edited, words
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import brute as boilerplate
from tests.llm.test_ngram_join import brute as classes

D = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        out = scratch.table(stage(spark, docs, D), "test")
        after = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == columns and out.count() == len(after)
        if name == "quality rules":
            judged = {r.doc_id for r in quality_rules.judge(quality_rules.features(docs)).filter("kept").collect()}
            assert set(after) == judged
        elif name == "line dedup":
            assert after == {d: t for d, t, *_ in boilerplate(before, 10)}
        elif name == "n-gram Jaccard join":
            assert set(after) == {d for d, (_, c, _) in classes([r[:2] for r in before], 80, 5).items() if c == d}
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {d for d, *_ in before} - {d for d, *_ in leaks(before, items)}
        docs = out
    last = P.STAGES[-1][1](spark, docs, D)
    assert last.count() == docs.count() < n and set(last.columns) == {"doc_id", "lang", "source", "ids", "n_tokens"}
    codec = byte_bpe.Codec.of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {r.doc_id: codec.encoding.encode_ordinary(r.text) for r in docs.collect()}
    assert {r.doc_id: (list(r.ids), r.n_tokens) for r in last.collect()} == {d: (ids, len(ids)) for d, ids in want.items()}
    assert P.run(spark, D).count() == last.count()


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, an empty table and a column with a name of our own."""
    good = " ".join(words(1, 60))
    rows = [(1, good), (1, good), (2, " ".join(edited(words(1, 60), 1, 1))), (None, " ".join(words(2, 60))), (3, None), (4, ""), (5, " ".join(words(3, 60)), None)]
    spark.createDataFrame([(1, "none of it")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, rows)
    empty = docs.filter("false")
    for _, stage in P.STAGES:
        docs, empty = scratch.table(stage(spark, docs, str(tmp_path)), "odd"), scratch.table(stage(spark, empty, str(tmp_path)), "odd")
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "5", "None"] and empty.count() == 0


def test_scratch_tables_of_the_stage_before_go(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    one = scratch.table(P.STAGES[0][1](spark, docs, D), "kept")
    there = lambda x: os.path.exists(x.removeprefix("file://"))
    mine = list(P._last.get())
    assert mine and all(map(there, mine))
    P.STAGES[3][1](spark, one, D)
    assert not any(map(there, mine))


def test_decontamination_is_the_operator(spark):
    assert decontaminate.PERCENT == 80 and [name for name, _ in P.STAGES][3] == "benchmark decontamination"


def test_near_duplicates_by_five_words_at_80(spark):
    """Brute force at the stage's own rule, with copies that four words at 0.85 would keep apart."""
    texts = {i: words(100 + i, 50) for i in range(0, 40, 4)}
    for i in list(texts):
        for k, n in ((1, 1), (2, 2), (3, 4)):
            copy = list(texts[i])
            for j in range(n):
                copy[9 + 10 * j] = f"new{k}{j}"
            texts[i + k] = copy
    sets = {d: [{tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for n in (4, 5)] for d, t in texts.items()}
    alike = lambda a, b, k: len(sets[a][k] & sets[b][k]) / len(sets[a][k] | sets[b][k])
    least = {d: d for d in texts}
    for _ in texts:
        least = {d: min(least[e] for e in texts if alike(d, e, 1) >= 0.8) for d in texts}
    assert alike(0, 1, 1) >= 0.8 and alike(0, 1, 0) < 0.85
    docs = documents(spark, [(d, " ".join(t)) for d, t in texts.items()])
    assert {r.doc_id for r in P.near_duplicates(spark, docs, D).collect()} == {d for d, first in least.items() if d == first}


def test_lines_of_any_length_and_share(spark):
    """Lines of one word go, and so does boilerplate that is most of a text; blank lines and texts of boilerplate alone stay."""
    own = {i: " ".join(words(i, 12)) for i in range(12)}
    rows = [(i, f"Login\n\n{own[i]}\nread  more", f"site{i}") for i in range(12)]
    long = " ".join(words(77, 60))
    rows += [(100 + i, f"{long}\n{own[i]}x", f"site{i}") for i in range(12)] + [(200, f"login\nRead more\n\n{long}", "site1"), (201, f"only here\nLOGIN\n{long}", None), (202, "ok\nnot boilerplate", "site2")]
    got = {r.doc_id: r.text for r in P.lines(spark, documents(spark, rows), D).collect()}
    want = {i: f"\n{own[i]}" for i in range(12)} | {100 + i: f"{own[i]}x" for i in range(12)} | {200: rows[24][1], 201: "only here", 202: "ok\nnot boilerplate"}
    assert got == want
