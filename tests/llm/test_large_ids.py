"""Ids above 2^53 beside a null come through every operator as they are, and so do other bigint columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfloom.llm import byte_bpe, chat_format, decontaminate, license_scan, line_dedup, ngram_join, quality_rules, queries, secret_scan, substring_dedup, token_counts
from tests.llm.helpers import LARGE_IDS, documents, with_large_ids, words

RANKS, PIECES = public_tokenizers.path(queries.RANKS), public_tokenizers.path(queries.PIECES)
TEXT = "Released under the MIT License. token = abcdefgh " + " ".join(words(1, 60))
ITEMS = "item_id bigint, text string"

RUNS = {
    "encode": lambda s, d: byte_bpe.encode(d, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "n_chars")),
    "decode": lambda s, d: byte_bpe.decode(byte_bpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN),
    "digests": lambda s, d: byte_bpe.digests(d, RANKS, public_tokenizers.PATTERN),
    "pieces": lambda s, d: token_counts.count_pieces(d, PIECES),
    "licenses": lambda s, d: license_scan.scan_licenses(d),
    "repeats": lambda s, d: substring_dedup.drop_repeats(d),
    "lines": lambda s, d: line_dedup.remove_boilerplate(d),
    "quality": lambda s, d: quality_rules.judge(quality_rules.features(d)),
    "secrets": lambda s, d: secret_scan.scan_versions(d, secret_scan.empty_ledger(s))[0],
    "clean": lambda s, d: decontaminate.without_items(d, s.createDataFrame([(1, "none of it")], ITEMS)),
    "clean, joined": lambda s, d: decontaminate.without_items(d, s.createDataFrame([(1, "none of it")], ITEMS), most_items=0),
}


@pytest.mark.parametrize("name", RUNS)
def test_rows(spark, name):
    out = RUNS[name](spark, with_large_ids(spark, TEXT))
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(LARGE_IDS, key=str)
    if "n_chars" in out.columns:
        assert all(r.n_chars == r.doc_id for r in out.collect())


def test_ids_of_documents_and_items(spark):
    d, own = with_large_ids(spark, TEXT), {i for i in LARGE_IDS if i is not None}
    assert {r.doc_id for r in ngram_join.jaccard_join(d).collect()} == own
    items = spark.createDataFrame([(i, " ".join(words(1, 60))) for i in LARGE_IDS], ITEMS)
    for most in (0, 100):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(d, items, most_items=most).collect()}
        assert got == {(a, b) for a in own for b in LARGE_IDS}


def test_conversations(spark):
    rows = [(i, k, "user", f"text {k}") for i in LARGE_IDS for k in range(300)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1))
    got = out.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("n_turns").alias("turns")).collect()
    assert {r.conv_id: (r.n, r.turns) for r in got} == {i: (1, 300) if i is not None else (300, 300) for i in LARGE_IDS}


def test_helper_columns_have_names_of_their_own(spark):
    """Columns named as the operators' helper columns stay as they are."""
    names = ["__bad", "__lines", "__stay", "__key", "__text_hash", "__numbers", "__rank", "__row_key", "__t", "__words", "__h", "__runs", "__sorted", "__at", "__lang", "__source", "__word_length_upper", "text_key"]
    d = documents(spark, [(i, f"{TEXT} {i}\nsame line", f"s{i}") for i in range(12)]).withColumns({n: F.lit(n) for n in names})
    for run in ("lines", "repeats", "quality", "clean", "clean, joined"):
        out = RUNS[run](spark, d).collect()
        assert len(out) == 12 and all(r[n] == n for r in out for n in names), run
