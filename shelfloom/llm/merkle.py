"""A manifest of a table as a hash tree, with a proof for every row.

Rows are leaves, in order, of a tree for each group (a source); the roots of the
groups, in order, are the leaves of one more tree, whose root stands for the table.
While a tree has more than one node, every ``fan_in`` consecutive ones (the last run
may be shorter, even one) become the digest of their concatenation.

A tree is cut into aligned blocks of ``fan_in ** levels`` leaves, each a group of
rows of bounded size. A task goes through a block recursively in postorder: a
subtree returns its digest, and while the recursion unwinds, the digests of its
siblings are appended to the proofs of all leaves that it contains. The roots of the
blocks are the leaves of the next, ``fan_in ** levels`` times smaller table, which
goes the same way; what a block root's proof has is appended to its leaves by a join
on the block. The hottest group is as many blocks as it needs.

Digests are SHA-256; digests are hashed as lowercase hexadecimal text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.llm import arrow, scratch

_PROOF = "array<struct<`before`:binary,`after`:binary>>"
_PROOF_ARROW = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: of each value "-" if null, else the count of its UTF-8 bytes, ":" and its text."""
    framed = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*framed), 256)


def _text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf (as text) and its proof lead to."""
    return F.aggregate(proof, start, lambda at, level: F.sha2(F.concat(_text(level["before"]), at, _text(level["after"])), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as text: level by level, left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(_text(level["before"]), _text(level["after"]))), "")


def _digest(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def block_tree(leaves: Sequence[bytes], fan_in: int, levels: int) -> tuple[bytes, list[list[dict]]]:
    """The node ``levels`` above the leaves of one block, and for each leaf its siblings of each level, from the leaf up."""
    proofs: list[list[dict]] = [[] for _ in leaves]

    def visit(level: int, first: int) -> bytes:
        """Of the subtree of ``level`` levels whose first leaf is ``first``."""
        if level == 0:
            return leaves[first]
        width = fan_in ** (level - 1)
        starts = range(first, min(first + fan_in * width, len(leaves)), width)
        children = [visit(level - 1, at) for at in starts]
        for k, at in enumerate(starts):
            own = {"before": b"".join(children[:k]), "after": b"".join(children[k + 1 :])}
            for proof in proofs[at : at + width]:
                proof.append(own)
        return _digest(children)

    return visit(levels, 0), proofs


def height(n: int, fan_in: int) -> int:
    """Levels from ``n`` nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan_in), levels + 1
    return levels


def _blocks(fan_in: int, levels: int):
    """Rows sorted by (tree, at) with whole blocks in a partition, to rows with the proof inside of their block and the block's node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, held, now = fan_in**levels, [], None

        def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            block = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            digests, n = block.column("digest").to_pylist(), block.column("n")[0].as_py()
            top, proofs = block_tree(digests, fan_in, min(levels, height(n, fan_in)))
            return arrow.with_columns(block, [], {"proof": (proofs, _PROOF_ARROW), "node": ([top] * len(digests), pa.binary())})

        for batch in batches:
            trees, places = arrow.values(batch, "tree", "at")
            starts = 0
            for i, key in enumerate(zip(trees, (at // size for at in places), strict=True)):
                if key != now:
                    if i > starts:
                        held.append(batch.slice(starts, i - starts))
                    if held:
                        yield done(held)
                    held, now, starts = [], key, i
            if batch.num_rows > starts:
                held.append(batch.slice(starts))
        if held:
            yield done(held)

    return run


def placed(rows: DataFrame, tree: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``at`` (place in its tree from 0) and ``n`` (rows of its tree).

    The rows are sorted by range into a written table, so that a hot tree is many
    partitions. A row's place is that in its partition, and what its tree has in
    the partitions before: a table with a row for each partition and tree in it.
    """
    names = [f"_order{i}" for i in range(len(order))]
    keyed = rows.select(*rows.columns, *[c.alias(n) for c, n in zip(order, names, strict=True)]).withColumn("_row", F.monotonically_increasing_id())
    by = [F.col(tree).asc(), *[F.col(n).asc_nulls_first() for n in names], F.col("_row").asc()]  # rows that agree in all are alike, but may be many
    sorted_rows = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop(*names, "_row")
    written = scratch.table(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "sorted")
    here = written.groupBy("_part", tree).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = here.select(F.col("_part").alias("_in"), F.col(tree).alias("_tree"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n"))
    met = written.join(starts, (F.col("_part") == F.col("_in")) & (F.col(tree) == F.col("_tree")))
    return met.select(*rows.columns, (F.col("_row") + F.col("_shift")).alias("at"), "n")


def climb(nodes: DataFrame, fan_in: int, levels: int, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(tree, at, n, digest, ...) to the same with proof, subroot and root.

    Goes up in one distributed traversal for every ``levels`` levels. ``above`` takes
    (tree, digest) of the roots and gives (tree, proof, root) of them in what is over
    the trees; without it a tree's root is the root.
    """
    size = fan_in**levels
    dealt = nodes.repartition("tree", F.floor(F.col("at") / size)).sortWithinPartitions("tree", "at")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in nodes.schema.fields)}, proof {_PROOF}, node binary"
    low = scratch.table(dealt.mapInArrow(_blocks(fan_in, levels), schema), "blocks")
    tops = low.filter(F.col("at") % size == 0).select("tree", F.floor(F.col("at") / size).alias("at"), F.ceil(F.col("n") / size).alias("n"), F.col("node").alias("digest"))
    if tops.filter("n > 1").limit(1).count():
        high = climb(tops, fan_in, levels, above)
    elif above is None:
        high = tops.select("tree", "at", F.array().cast(_PROOF).alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    else:
        over = above(tops.select("tree", "digest")).select(F.col("tree").alias("_of"), "proof", "root")
        high = tops.join(over, F.col("tree") == F.col("_of")).select("tree", "at", "proof", F.col("digest").alias("subroot"), "root")
    high = high.select(F.col("tree").alias("_tree"), F.col("at").alias("_block"), F.col("proof").alias("_more"), "subroot", "root")
    met = low.join(high, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("at") / size) == F.col("_block")))
    return met.select(*nodes.columns, F.concat("proof", "_more").alias("proof"), "subroot", "root")


def manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", key: str = "doc_id", fan_in: int = 3, levels: int = 7, keep: dict[str, Column] | None = None
) -> DataFrame:
    """(key, ``keep``..., leaf, subroot, root, proof): one row for each row of ``docs``, digests as lowercase text.

    ``proof`` has for each level, from the leaf over the group's root to the table's,
    the digests before and after the row's own node in its run, as bytes: ``fold``
    gives the root again. ``keep`` are further columns to carry. Leaves ascend by the
    key (null first), rows of one key by their leaf; rows that agree in all are leaves
    each. Groups ascend by their UTF-8 bytes, null first. Null values and empty texts
    have leaves of their own. Columns that aren't named are ignored. An empty table
    has no rows.
    """
    keep = keep or {}
    # a text that isn't null: "" for null, "-" before the others, so null goes first and the bytes keep their order
    tree = F.coalesce(F.concat(F.lit("-"), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(key).alias("_key"), F.unhex(leaf([F.col(c) for c in columns])).alias("digest"), *[c.alias(f"_keep{i}") for i, c in enumerate(keep.values())])

    def above(roots: DataFrame) -> DataFrame:
        one = roots.select(F.lit("").alias("tree"), F.col("tree").alias("_of_tree"), "digest")
        return climb(placed(one, "tree", [F.col("_of_tree")]), fan_in, levels).select(F.col("_of_tree").alias("tree"), "proof", "root")

    done = climb(placed(rows, "tree", [F.col("_key"), F.col("digest")]), fan_in, levels, above)
    digests = [_text(F.col(c)).alias(n) for c, n in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    return done.select(F.col("_key").alias(key), *[F.col(f"_keep{i}").alias(n) for i, n in enumerate(keep)], *digests, "proof")
