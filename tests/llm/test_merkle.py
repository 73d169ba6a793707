import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from shelfloom.llm import merkle as M
from shelfloom.llm import queries
from tests.llm.helpers import documents, with_large_ids

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fan_in=3):
    """(root, proof of each node: levels of (before, after))."""
    own, proofs = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        up, kept = [], []
        for at in range(0, len(nodes), fan_in):
            run = nodes[at : at + fan_in]
            for k in range(len(run)):
                for i in own[at + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(H(*run))
            kept.append([i for group in own[at : at + fan_in] for i in group])
        nodes, own = up, kept
    return nodes[0], proofs


def brute(rows, fan_in=3):
    """(doc_id, source, lang, n_chars, text) rows to sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted(by[s], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])) for s in order}
    trees = {s: tree([x[0] for x in groups[s]], fan_in) for s in order}
    root, over = tree([trees[s][0] for s in order], fan_in)
    out = []
    for s, above in zip(order, over, strict=True):
        for (digest, r), proof in zip(groups[s], trees[s][1], strict=True):
            levels = proof + above
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            at = leaf((*r[:4], r[4].replace("\n", "") if hit and r[4] is not None else r[4]))
            for before, after in levels:
                at = H(before, at, after)
            out.append((r[0], digest, trees[s][0], root, H(*[b + a for b, a in levels]), at, at == root))
    return sorted(out, key=str)


def rows(sizes, repeats=()):
    out = []
    for s, n in sizes.items():
        out += [(i * 7 % 1000, s, "en" if i % 2 else None, None if i % 5 == 0 else i, None if i % 7 == 0 else f"line é\nof {s} {i}" * (i % 4)) for i in range(n)]
    return out + list(repeats)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, levels):
    """Sources of none to several blocks, null and empty ones, null and repeated ids, rows that agree in all."""
    some = rows({"a": 1, "b": 3, None: 4, "": 2, "é": 9, "z": 10, "hot": 101}, [(None, "a", None, None, None), (3, "hot", "en", 3, "x\ny"), (3, "hot", "en", 3, "x\ny"), (2, "long", "en", 1, "w\n" * 60_000)])
    documents(spark, []).unionByName(spark.createDataFrame(some, SCHEMA), allowMissingColumns=True).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(M.manifest, "__defaults__", (*M.manifest.__defaults__[:4], levels, None))
    got = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(some)


def test_other_fan_in_and_table(spark):
    """Ids in binary, other columns, names that clash with the helper columns."""
    names = ("tree", "at", "n", "digest", "_part", "_row", "_key", "proof", "root", "leaf", "node")
    docs = spark.createDataFrame([(f"id{i}", i % 2, 1) for i in range(37)], "k string, g int, v int").withColumns({c: F.lit(0) for c in names})
    out = M.manifest(docs, ["k", "v"], group="g", key="k", fan_in=2, levels=2).collect()
    groups = [sorted((f"id{i}" for i in range(37) if i % 2 == g), key=str.encode) for g in (0, 1)]
    trees = [tree([leaf((k, 1)) for k in ks], 2) for ks in groups]
    root = tree([t[0] for t in trees], 2)[0]
    assert {(r.k, r.leaf, r.subroot, r.root) for r in out} == {(k, leaf((k, 1)), t[0], root) for ks, t in zip(groups, trees, strict=True) for k in ks}
    for r in out:
        at = r.leaf
        for level in r.proof:
            at = H(level.before.hex(), at, level.after.hex())
        assert at == r.root


def test_changed_leaf_does_not_verify(spark):
    docs = documents(spark, [(i, f"text {i}", f"s{i % 3}") for i in range(20)])
    out = M.manifest(docs, keep={"other": F.lit(H("x"))})
    assert out.filter(M.fold(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 20
    assert out.filter(M.fold(F.col("other"), F.col("proof")) == F.col("root")).count() == 0
    changed = M.manifest(docs.withColumn("text", F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text"))))
    assert changed.first().root != out.first().root


def test_large_ids_and_empty_table(spark):
    ids = [r.doc_id for r in M.manifest(with_large_ids(spark, "one\ntwo")).collect()]
    assert sorted(ids, key=str) == sorted([9_007_199_254_740_993, None, -9_007_199_254_740_995, 9_007_199_254_740_992], key=str)
    assert M.manifest(documents(spark, [])).count() == 0
    one = M.manifest(documents(spark, [(1, None)])).first()
    assert one.leaf == one.subroot == one.root and one.proof == []
