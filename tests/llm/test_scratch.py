import os
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace as N

import pytest

import corpus_pipeline
from shelfloom.llm import queries, scratch


def session(master, given=None, named=None):
    found = N(isDefined=lambda: given is not None, get=lambda: given)
    return N(conf=N(get=lambda key, default=None: named, set=lambda *_: None), sparkContext=N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: found))))


def test_a_cluster_must_name_its_shared_folder():
    """A folder of its own on each machine would lose rows: only a local master gets a temporary one."""
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            scratch.root(session(master))
        assert scratch.root(session(master, given="hdfs://a/b")) == "hdfs://a/b" and scratch.root(session(master, named="s3://c/")) == "s3://c"
    assert scratch.root(session("local[4]")).startswith("file://")


def test_tables_go_when_they_are_not_needed(spark):
    df = spark.range(3)
    kept = scratch.table(df, "kept")
    before = set(scratch.written())

    def make():
        return scratch.table(scratch.table(df, "one"), "two").union(df)

    out = scratch.only(spark, make, "out")
    assert out.count() == 6 and kept.count() == 3 and len(set(scratch.written()) - before) == 1
    scratch.drop(spark, [x for x in scratch.written() if x not in before])
    assert set(scratch.written()) == before


def test_queries_at_once_keep_their_tables(spark, tmp_path):
    """Threads with the queries that delete tables on their way give what they give one after another, and leave nothing behind in ``clear``."""
    d = "/root/testdata/sf0.001"
    runs = [queries.op2_ngram_jaccard_join, queries.op2_ngram_jaccard_join, queries.op5_line_dedup, corpus_pipeline.run]
    rows = lambda f: sorted(map(str, f(spark, d).collect()))
    there = lambda: {at for at, _, names in os.walk(f"{scratch.root(spark).removeprefix('file://')}/tables") if any(n.endswith(".parquet") for n in names)}
    scratch.clear(spark)
    before = there()
    alone = {f: rows(f) for f in runs[1:]}
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(rows, runs)) == [alone[f] for f in runs]
    scratch.clear(spark)
    assert scratch.written() == [] and there() == before
