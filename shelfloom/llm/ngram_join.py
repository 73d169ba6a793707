"""Jaccard join on word n-grams by T-occurrence search.

1. ``signatures`` (Python, one pass over whole texts): the set of distinct
   shingles of each document, as 64-bit hashes, and signatures by which linked
   documents meet. Sets of sizes a and b with J >= t differ in at most
   d = (a + b) - 2 * ceil(t * (a + b) / (1 + t)) shingles, so of k = d + 1 + m
   ranges of hash values at least m + 1 hold the same shingles in both; a
   signature is the sum of the shingles in one range. A set with more than m
   empty ranges also gives the prefix of its sorted hashes, of which two linked
   sets share one. Nothing is missed, however frequent a shingle may be. A set that
   shares fewer than m + 1 ranges with all others together has no link: that takes
   out the documents that only share a passage.
2. Documents with equal sets are one entry. Entries that may be linked form
   ``families`` (connected components); all others have no link. Two entries may be
   linked if they share enough signatures that few have, counted by pairs, or a
   frequent one that isn't among the m most frequent ones of either (``_kept``): one
   signature in common is not enough, or families would grow faster than the input
   until most entries are in one. A signature is one
   of a band, the sizes that the larger set of a pair has, and so is a family: sets
   of other sizes aren't in it, and a pair is counted in the band of its larger set.
3. ``t_occurrence`` (Python, one task for each block pair of a family): inverted
   lists of one block, searched with each set of the other. By DivideSkip the
   longest lists are set aside, the short ones are merged by counting, and what
   reaches the overlap less the number of lists set aside is looked up in the long
   lists by binary search, unless merging a list costs less than its look-ups.
   The merge counts postings in an array and not on a heap: the same counts, without
   a Python step for each posting (for figures see the README).
4. Links go out as one row per entry and task (the least entry it is linked with
   in the task, and its number of links), never as pairs; ``components`` joins
   them into classes.

A family of m different near copies takes (tokens / block_tokens)^2 tasks of
bounded memory, and its tokens are sent as often as it has blocks. Equality of shingles is that of 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfloom.llm import arrow, scratch
from shelfloom.llm.components import components
from shelfloom.llm.words import WordHashes, blank_separated, mix, shingle_hashes

#: Sizes of a band: from one of these up to the next.
_BANDS = np.array(list(dict.fromkeys(int(7 * 1.5**i) for i in range(60))), dtype=np.int64)
#: Cost of one binary search in a list against one posting merged.
_PROBE = 40
#: DivideSkip's weight of the list length.
_MU = 0.0085
_SEEN = 200_000
#: Signatures that are taken for hot at most, the items that their sketch tracks in a task, and the rows from which one is hot.
_HOT, _TRACKED, HOT_ROWS = 512, 4096, 10_000
#: Rows of a signature up to which its pairs of sets are counted.
_FEW = 8


class Links:
    """The rule for a link: ``100 * |x & y| >= percent * |x | y|``, and what follows from it."""

    def __init__(self, size: int = 5, percent: int = 80):
        self.size, self.percent = size, percent

    @staticmethod
    def band(n):
        """The band of a size, or of an array of them."""
        return np.searchsorted(_BANDS, np.maximum(n, 7), side="right") - 1

    def shingles(self, text: str | None, hashes: WordHashes) -> np.ndarray:
        """The sorted set of a text."""
        words = blank_separated(text)
        if 0 < len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
        return np.unique(shingle_hashes(hashes.of(words), self.size))

    def differ(self, both: int) -> int:
        """Most shingles in only one of two linked sets with ``both`` shingles in all."""
        return both - 2 * -(-self.percent * both // (100 + self.percent))

    def least(self, n: int) -> int:
        """Least overlap of a set of ``n`` with anything it is linked to."""
        return -(-self.percent * n // 100)

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
        """(signatures, bands, how many of a band's signatures a linked set must share).

        A signature's low bits are its band: the sizes that the larger set of a pair has.
        """
        n, found, bands, needs = len(s), [], [], []
        largest = n * 100 // self.percent
        if largest < 7 or largest == n:
            return np.empty(0, np.uint64), bands, needs
        first, last = np.searchsorted(_BANDS, [max(n, 7), largest], side="right") - 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s))])
        for band in range(int(first), int(last) + 1):
            high = int(_BANDS[band + 1]) - 1
            d = max(self.differ(x) for x in (2 * high, 2 * high - 1))
            more = 1 + d // 8
            k = d + 1 + more
            step = np.uint64((1 << 64) // k)
            cuts = np.searchsorted(s, np.arange(1, k, dtype=np.uint64) * step)
            cuts = np.concatenate([[0], cuts, [n]])
            sums, full = total[cuts[1:]] - total[cuts[:-1]], cuts[1:] > cuts[:-1]
            own = mix(sums ^ mix(np.arange(k, dtype=np.uint64) + np.uint64(band << 40)))[full]
            need = more + 1 - (k - len(own))
            if need < 1:
                own = np.concatenate([own, mix(s[: n - self.least(n) + 1] ^ np.uint64((band << 40) + (1 << 39)))])
            found.append((own & ~np.uint64(63)) | np.uint64(band))
            bands.append(band)
            needs.append(max(need, 1))
        return np.concatenate(found), bands, needs


def _set_ids(s: np.ndarray) -> tuple[int, int]:
    raw = s.tobytes()
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63), xxhash.xxh64_intdigest(raw) - (1 << 63)


def _documents(rule: Links):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for part in arrow.parts(batches, 500):
            n, first, second, signs, bands, needs = [], [], [], [], [], []
            for text in part.column("text").to_pylist():
                s = rule.shingles(text, hashes)
                a, b = _set_ids(s)
                if len(seen) >= _SEEN:
                    seen.clear()
                # copies met in this task need not say it again
                own = ([], [], []) if a in seen else rule.signatures(s)
                seen.add(a)
                n.append(len(s))
                first.append(a)
                second.append(b)
                signs.append(np.asarray(own[0], np.uint64).view(np.int64))
                bands.append(own[1])
                needs.append(own[2])
            yield arrow.with_columns(part, ["text"], {
                "n_shingles": (n, pa.int64()), "set_a": (first, pa.int64()), "set_b": (second, pa.int64()),
                "signatures": (signs, pa.list_(pa.int64())), "bands": (bands, pa.list_(pa.int32())), "needs": (needs, pa.list_(pa.int32())),
            })

    return run


def t_occurrence(rule: Links, sets: list[np.ndarray], queries: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each query set the positions in ``sets`` of those it is linked with, by DivideSkip."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    m = len(sets)
    tokens = np.concatenate(sets) if m else np.empty(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    owner = np.repeat(np.arange(m, dtype=np.int64), sizes)[order]
    keys, begin, length = np.unique(tokens[order], return_index=True, return_counts=True)
    postings = np.repeat(np.arange(len(keys), dtype=np.int64), length) * m + owner
    longest = int(length.max()) if len(length) else 1
    for q in queries:
        n = len(q)
        at = np.searchsorted(keys, q)
        at[at == len(keys)] = 0
        at = at[keys[at] == q] if len(keys) else at[:0]
        need = rule.least(n)
        if n == 0 or len(at) < need:
            yield np.empty(0, np.int64)
            continue
        at = at[np.argsort(length[at], kind="stable")]
        aside = min(need - 1, int(need / (_MU * math.log2(max(2, longest)) + 1)), len(at) - 1)
        short, long = at[: len(at) - aside], at[len(at) - aside :]
        merge = [owner[begin[t] : begin[t] + length[t]] for t in short]
        count = np.bincount(np.concatenate(merge), minlength=m)
        fits = (100 * np.minimum(sizes, n) >= rule.percent * np.maximum(sizes, n)) & (sizes > 0)
        found = np.flatnonzero((count >= max(1, need - len(long))) & fits)
        if len(found) and len(long):
            dear = length[long] > _PROBE * len(found)
            cheap = long[~dear]
            if len(cheap):
                count = count + np.bincount(np.concatenate([owner[begin[t] : begin[t] + length[t]] for t in cheap]), minlength=m)
            if dear.any():
                wanted = (long[dear][:, None] * m + found[None, :]).ravel()
                hit = np.searchsorted(postings, wanted)
                hit[hit == len(postings)] = 0
                count[found] += (postings[hit] == wanted).reshape(-1, len(found)).sum(axis=0)
        overlap = count[found]
        yield found[100 * overlap >= rule.percent * (n + sizes[found] - overlap)]


def _search(rule: Links):
    """Rows sorted by (family, block_a, block_b) to (entry, least linked entry or itself, number of links)."""

    def group(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        band = rows[0][0] & 63
        rows = list({(r[3], r[4], r[6].tobytes()): r for r in rows}.values())  # a row may be repeated
        left = [r for r in rows if r[3] == r[1]]
        right = left if rows[0][1] == rows[0][2] else [r for r in rows if r[3] == r[2]]
        both = left if right is left else left + right
        entries, copies = (np.array([r[i] for r in both], dtype=np.int64) for i in (4, 5))
        sizes = np.array([len(r[6]) for r in both], dtype=np.int64)
        shift = 0 if right is left else len(left)
        label, links = np.arange(len(entries)), np.zeros(len(entries), np.int64)
        for i, found in enumerate(t_occurrence(rule, [r[6] for r in right], [r[6] for r in left])):
            found = found + shift
            found = found[(found != i) & (rule.band(np.maximum(sizes[found], sizes[i])) == band)]
            if not len(found):
                continue
            links[i] += copies[found].sum()
            if shift:
                links[found] += copies[i]
            labels = np.unique(np.append(label[found], label[i]))
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
        least = np.full(len(entries), np.iinfo(np.int64).max)
        np.minimum.at(least, label, entries)
        return entries, least[label], links

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return arrow.made({n: (np.concatenate([d[i] for d in done]), pa.int64()) for i, n in enumerate(("entry", "linked", "n_links"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, done, waiting = None, [], 0
        for part in arrow.parts(batches, 1_000):
            for r in zip(*arrow.values(part, "family", "block_a", "block_b", "block", "entry", "copies", "tokens"), strict=True):
                if r[:3] != key and rows:
                    done.append(group(rows))
                    waiting += len(rows)
                    rows = []
                    if waiting > 5000:
                        yield batch(done)
                        done, waiting = [], 0
                key = r[:3]
                rows.append((*r[:6], np.frombuffer(r[6], dtype=np.uint64)))
        if rows:
            done.append(group(rows))
        if done:
            yield batch(done)

    return run


def _tokens(rule: Links):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in arrow.parts(batches, 200):
            yield arrow.with_columns(part, ["text"], {"tokens": ([rule.shingles(t, hashes).tobytes() for t in part.column("text").to_pylist()], pa.binary())})

    return run


def _hot(signed: DataFrame, least_rows: int) -> DataFrame:
    """(signature): the most frequent ones, by a sketch of frequent items over all rows; at most ``_HOT`` of them.

    It decides how rows are dealt to tasks and nothing else, so it may be wrong.
    """
    top = signed.select(F.explode("signatures").alias("signature")).agg(F.expr(f"approx_top_k(signature, {_HOT}, {_TRACKED})").alias("top")).first()["top"]
    return signed.sparkSession.createDataFrame([(r["item"],) for r in top or [] if r["count"] >= least_rows], "signature bigint")


def _met(signed: DataFrame, hot_rows: int) -> DataFrame:
    """(set_a, signature, n) of signatures that more than one set has; ``n`` is the number of rows with one.

    Rows are shuffled once, to the others of their signature. Those of a hot signature
    aren't: its ends are aggregated where the rows are, and sent back to them.
    """
    rows, same = signed.select("set_a", F.explode("signatures").alias("signature")), Window.partitionBy("signature")
    ends = (F.min("set_a").alias("low"), F.max("set_a").alias("high"), F.count("*").alias("n"))
    hot = F.broadcast(_hot(signed, hot_rows))
    shared = rows.join(hot, "signature", "left_semi").groupBy("signature").agg(*ends).filter("low < high").select("signature", "n")
    often = rows.join(F.broadcast(shared), "signature").select("set_a", "signature", "n")  # as few as are hot
    others = rows.join(hot, "signature", "left_anti").select("set_a", "signature", F.min("set_a").over(same).alias("low"), F.max("set_a").over(same).alias("high"), F.count("*").over(same).alias("n"))
    return others.filter("low < high").select("set_a", "signature", "n").union(often).distinct()


def _kept(shared: DataFrame, signed: DataFrame) -> DataFrame:
    """(set_a, signature, few, least, inside): the shared signatures of sets that share enough of a band, by which they can meet.

    Signatures of up to ``_FEW`` rows are counted by pairs: two linked sets have
    ``need`` in common, so at least ``least`` of these, as the others are so many at
    most, or only others. Others meet by stars, without the ``need - 1`` most frequent
    ones of a set: all sets put them in the same order, and the first one that two
    linked sets share has all that they share behind it, so both keep it. A set is
    ``inside`` the band that its own size is in, as the larger one of a linked pair is.
    """
    band = F.col("signature").bitwiseAND(63).cast("int")
    needs = signed.select("set_a", _band_of(F.col("n_shingles")).alias("own"), F.explode(F.arrays_zip("bands", "needs")).alias("x"))
    needs = needs.select("set_a", F.col("x.bands").alias("band"), F.col("x.needs").alias("need"), (F.col("x.bands") == F.col("own")).alias("inside")).distinct()
    own, few = Window.partitionBy("set_a", "band"), F.col("n") <= _FEW
    ordered = shared.withColumn("band", band).join(needs, ["set_a", "band"]).withColumn("few", few).withColumns({
        "place": F.row_number().over(own.orderBy(F.desc("n"), "signature")), "all": F.count("*").over(own), "others": F.count_if(~F.col("few")).over(own),
    })
    some = ordered.filter((F.col("all") >= F.col("need")) & (F.col("few") | (F.col("place") >= F.col("need"))))
    return some.select("set_a", "signature", "few", F.greatest(F.col("need") - F.col("others"), F.lit(1)).cast("int").alias("least"), "inside")


def _edges(signed: DataFrame, hot_rows: int) -> DataFrame:
    """Edges (u, v) between sets that may be linked, as nodes of their band (``_node``): pairs that share enough rare signatures, and stars of frequent ones."""
    shared = scratch.table(_met(signed, hot_rows), "shared")
    kept = scratch.table(_kept(shared, signed), "kept")
    own = F.col("signature").bitwiseAND(63)
    rare = kept.filter("few").select("signature", "least", "inside", _node(F.col("set_a"), own).alias("node"))
    x, y = rare.alias("x"), rare.alias("y")
    pairs = x.join(y.hint("merge"), (F.col("x.signature") == F.col("y.signature")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.inside") | F.col("y.inside")))
    pairs = pairs.groupBy(F.col("x.node").alias("u"), F.col("y.node").alias("v")).agg(F.count("*").alias("n"), F.min(F.greatest("x.least", "y.least")).alias("least"))
    often = kept.filter("not few").select("set_a", "signature", "inside")
    # a table of its own, so that the join shuffles both sides alone and can split a hot signature
    least = scratch.table(often.groupBy("signature").agg(F.min("set_a").alias("v"), F.max("inside").alias("some")).filter("some").select("signature", "v"), "least")
    stars = often.join(least, "signature").select(_node(F.col("set_a"), own).alias("u"), _node(F.col("v"), own).alias("v")).filter("u <> v")
    return pairs.filter("n >= least").select("u", "v").union(stars).distinct()


def _node(set_a: Column, band: Column) -> Column:
    """A set in a band, as one bigint with the band in its low bits. Sets that agree in the high bits are one node, which makes a family larger and loses nothing."""
    return set_a.bitwiseAND(~63).bitwiseOR(band.cast("bigint"))


def _band_of(n: Column) -> Column:
    """``Links.band`` of a column."""
    return F.greatest(F.lit(0), F.size(F.filter(F.array(*[F.lit(int(b)) for b in _BANDS[:59]]), lambda b: b <= n)) - 1)


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, block_tokens: int = 2_000_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_shingles, component_id, n_links): one row per document.

    ``n_links``: other documents it is linked with, copies included. Null or
    wordless text: no shingles, no links, a class of its own. Repeated rows of
    one doc_id give one row (the one with the largest set decides its size; links
    of all of them count; texts that differ under one doc_id link as one document). Rows without a doc_id are left out. Other columns are
    ignored; an empty table gives no rows.
    """
    rule, spark = Links(size, percent), docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")

    signed = texts.mapInArrow(_documents(rule), "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signatures array<bigint>, bands array<int>, needs array<int>")
    signed = scratch.table(signed, "signed")
    sets = signed.select("doc_id", "n_shingles", "set_a", "set_b")
    entries = sets.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("entry"), F.countDistinct("doc_id").alias("copies"))
    entries = scratch.table(entries, "entries")
    family = scratch.only(spark, lambda: components(_edges(signed, hot_rows)), "families")
    # a family is named by its least node, whose low bits are its band; the sets of a node are found by the bands that a size may be in
    bands = F.sequence(_band_of(F.col("n_shingles")), _band_of(F.floor(F.col("n_shingles") * 100 / percent)))
    nodes = entries.withColumn("node", F.explode(F.transform(bands, lambda b: _node(F.col("set_a"), b))))
    active = nodes.join(family.withColumnRenamed("component", "family"), "node").drop("node")
    active = scratch.table(active, "active")

    # A text is read again where its entry is active, once for each entry. What is
    # active grows with the documents, so this join is never a broadcast.
    many = scratch.table(active.groupBy("family").agg(F.ceil(F.sum("n_shingles") / block_tokens).cast("int").alias("blocks")), "blocks")
    active = active.join(many, "family")
    own = texts.join(active.select(F.col("entry").alias("doc_id"), "family", "copies", "blocks", "n_shingles", "set_a").hint("merge"), "doc_id")
    tokens = own.mapInArrow(_tokens(rule), "doc_id bigint, family bigint, copies bigint, blocks int, n_shingles bigint, set_a bigint, tokens binary")
    tokens = (
        tokens.filter(F.length("tokens") == 8 * F.col("n_shingles"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block", F.col("doc_id").alias("entry"), "copies", "tokens")
    )
    found = tokens.repartition("family", "block_a", "block_b").sortWithinPartitions("family", "block_a", "block_b", "entry").mapInArrow(_search(rule), "entry bigint, linked bigint, n_links bigint")
    found = scratch.table(found, "found")

    linked = scratch.only(spark, lambda: components(found.select(F.col("entry").alias("u"), F.col("linked").alias("v"))), "linked")
    links = found.groupBy("entry").agg(F.sum("n_links").alias("n_links"))
    entries = (
        entries.join(links, "entry", "left")
        .join(linked.withColumnRenamed("node", "entry"), "entry", "left")
        .select("set_a", "set_b", "n_shingles", F.coalesce("component", "entry").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    out = sets.join(entries, ["set_a", "set_b", "n_shingles"], "left").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min(F.coalesce("component_id", "doc_id")).alias("component_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return out
