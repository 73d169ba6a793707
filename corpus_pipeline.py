"""From raw documents to token ids, in five stages.

Quality rules, line dedup, n-gram Jaccard join, benchmark decontamination and
byte-level BPE, each over all that the stage before has kept. What a stage returns
is written as Parquet in the shared folder and reread before the next one, so a
stage first deletes the intermediate tables of the one before.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfloom.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality_rules, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scope of the last stage, by thread: a pipeline in another thread has its own.
_last: ContextVar[scratch.Scope | None] = ContextVar("last", default=None)


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.drop(spark, _last.get() or [])
        with scratch.scope() as used:
            out = f(spark, docs, sf_dir)
        _last.set(used)
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    rules, prefix = quality_rules.Rules(), "__quality_"
    judged = quality_rules.judge(quality_rules.features(docs, prefix=prefix), rules, prefix)
    return judged.filter(F.col(prefix + "kept")).select(*docs.columns)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are on ten or more sources, but for texts of nothing else; n_chars is that of the new text."""
    n = "__n_lines_removed"
    out = line_dedup.remove_boilerplate(docs, site="source", min_sites=10, count_as=n, whole_as="__all_boilerplate")
    new = {"n_chars": F.when(F.col(n) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class linked by 5-word shingles at 0.8; one row of each doc_id. Rows without a doc_id stay."""
    classes = ngram_join.jaccard_join(docs, size=5, percent=80).select(F.col("doc_id").alias("__id"), "component_id")
    stays = classes.filter(F.col("__id") == F.col("component_id")).select("__id")
    own = docs.filter("doc_id is not null").join(stays, F.col("doc_id") == F.col("__id"), "left_semi")
    first = own.withColumn("__row", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).filter("__row = 1")
    return first.select(*docs.columns).union(docs.filter("doc_id is null"))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (80 % of its 5-word shingles)."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=5, percent=80)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens): the token ids of every whole text."""
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    return out.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: Quantile sketches and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents`` of ``sf_dir``. The tables of a stage and what the one before returned go as soon as its own result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.Scope()
    for _, stage in STAGES:
        with scratch.scope() as used:
            out = stage.__wrapped__(spark, docs, sf_dir)
        with scratch.scope() as kept:
            docs = scratch.table(out, "stage")
        for gone in (used, before):
            scratch.drop(spark, gone)
        before = kept
    scratch.keep(before)
    return docs
