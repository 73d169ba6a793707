import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfloom.llm import queries
from shelfloom.llm import toxicity as T
from tests.llm.helpers import documents, with_large_ids, words


def made(n, seed=1):
    """Texts that are toxic where an insult meets the name of a group; either alone is not."""
    r, out = random.Random(seed), []
    for i in range(n):
        insult, group = r.random() < 0.4, r.random() < 0.4
        ws = words(seed * 10_000 + i, 30, 300) + ["insult"] * insult + ["grp"] * group
        r.shuffle(ws)
        out.append((i, " ".join(ws), int(insult and group)))
    return out


def test_learns_a_pair_that_a_linear_model_misses():
    """Toxic where exactly one of two words is there: no linear weights part them."""
    r, texts, labels = random.Random(5), [], []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(np.array(sorted({*(r.randrange(10, 200) for _ in range(8)), *([1] if a else []), *([2] if b else [])}), np.int32))
        labels.append(int(a != b))
    labels = np.array(labels, float)

    def accuracy(factors_on):
        s = T.Settings(space=256, epochs=60, balance=0.0)
        bias, terms, w, v = T.fit_arrays(texts[:1000], labels[:1000], s if factors_on else T.Settings(space=256, epochs=60, balance=0.0, factors=1))
        W, V = np.zeros(256), np.zeros((256, v.shape[1]))
        W[terms], V[terms] = w, v * factors_on
        rest = texts[1000:]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in rest])])
        m, _ = T.margins(np.concatenate(rest), starts, W, V, bias)
        return float(((m > 0) == (labels[1000:] > 0)).mean())

    assert accuracy(True) > 0.95 and accuracy(False) < 0.75


def test_held_out_accuracy_and_fold(spark, tmp_path):
    rows = made(1500)
    documents(spark, [(i, t) for i, t, _ in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    # labels of the held-out fifth are turned round: learning from them would show
    spark.createDataFrame([(i, 1, 1 - y if i in held else y) for i, _, y in rows], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 1500 and {i for i, r in got.items() if r.held_out} == held
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    right = [got[i].predicted == y for i, _, y in rows if i in held]
    assert sum(right) / len(right) > 0.95


def test_odd_rows(spark):
    docs = documents(spark, [(i, t) for i, t, _ in made(300)])
    labels = spark.createDataFrame([(i, y) for i, _, y in made(300)] + [(None, 1), (5, None), (0, 0), (0, 0)], "doc_id bigint, toxic int")
    model = T.fit(docs, labels)
    odd = documents(spark, [(1, None), (2, ""), (None, "insult grp"), (3, "insult grp"), (3, "insult grp"), (4, "grp " + " ".join(words(1, 60_000, 10**6)) + " insult")]).withColumns({"score": F.lit(9), "places": F.lit(9)})
    got = T.score(odd.select("doc_id", "text", "score", "places"), model).collect()
    by = [(r.doc_id, r.score) for r in got]
    assert len(got) == 6 and by[0][1] == by[1][1] and by[3] == by[4] and all(0 <= s <= 1 for _, s in by) and got[0].places == 9
    assert T.score(odd.filter("false").select("doc_id", "text"), model).count() == 0


def test_no_labels_and_no_documents(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    for labels in (none, none.filter("false")):
        model = T.fit(docs, labels)
        assert model.count() == 0 and [r.score for r in T.score(docs.select("doc_id", "text"), model).collect()] == [0.0, 0.0]
    assert T.fit(docs.filter("false"), none).count() == 0


def test_sample_is_bounded_and_the_same_each_time(spark):
    rows = made(400)
    docs, labels = documents(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    small = T.Settings(most_rows=200)
    a, b = (sorted(map(tuple, T.fit(d, labels, small).select("term", "w").collect())) for d in (docs, docs.repartition(7)))
    assert a == b and a != sorted(map(tuple, T.fit(docs, labels).select("term", "w").collect()))


def test_large_ids(spark):
    out = T.score(with_large_ids(spark, "a b").select("doc_id", "text"), spark.createDataFrame([(-1, 0.5, [0.0] * 4)], "term int, w double, v array<double>")).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted([9_007_199_254_740_993, None, -9_007_199_254_740_995, 9_007_199_254_740_992], key=str)
    assert {round(r.score, 6) for r in out} == {round(1 / (1 + np.exp(-0.5)), 6)}
