"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its lower-case words and the first letters of longer ones,
each once, hashed to ``space`` places. The score is the logistic function of

    bias + sum of w[i] + sum over pairs of <v[i], v[j]>,

so two terms can say together what neither says alone: an insult beside the name of
a group, or a word that is harmless until it meets another. A linear model has no
such term. The sum over pairs is half of (sum of v)^2 less the sum of v^2, so a text
costs as much as it has terms, whatever its length.

Fitting takes a bounded sample of the labelled rows: at most ``most_rows``, those of
the least hashes of their key. It runs in one task over arrays of term places:
AdaGrad steps on batches, with a soft threshold on w and on each v as a whole, so
that terms that say nothing are exactly zero and a long text is not the sum of its
noise. Terms that few texts have get no v: there is too little to learn pairs from.
The model is the mean over the last third of the epochs. What is fitted is at most ``space`` rows of 1 + ``factors`` numbers, so it can
be sent to every worker. Scoring goes over every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.llm import arrow, scratch

_WORD = re.compile(r"\w+")
_MODEL = "term int, w double, v array<double>"


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and of the model, and how it is fitted."""

    most_rows: int = 20_000
    space: int = 1 << 18
    factors: int = 4
    least_rows_of_term: int = 3
    prefix: int = 4
    epochs: int = 15
    batch: int = 128
    rate: float = 0.07
    threshold: float = 0.006
    #: Texts that have a term before it gets factors, and the soft threshold on them.
    least_rows_of_pair: int = 50
    pair_threshold: float = 0.006
    pair_start: float = 0.05
    #: How far the rarer label is weighed up: 0 not at all, 1 until both labels weigh alike.
    balance: float = 0.9
    seed: int = 7


class Terms(dict):
    """Places of a word and its prefix, kept for the words seen lately."""

    def __init__(self, settings: Settings, limit: int = 400_000):
        super().__init__()
        self.settings, self.limit = settings, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        s = self.settings
        found = (xxhash.xxh3_64_intdigest(word) % s.space,)
        if len(word) > s.prefix:
            found += (xxhash.xxh3_64_intdigest(word[: s.prefix] + "*") % s.space,)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        """The places of a whole text, each once, ascending; none for null."""
        return np.array(sorted({p for w in set(_WORD.findall((text or "").lower())) for p in self[w]}), dtype=np.int32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs between ``starts``; 0 for an empty one."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def margins(places: np.ndarray, starts: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of each text, and the sum of v over its terms."""
    own = v[places]
    total = _sums(own, starts)
    pairs = 0.5 * ((total**2).sum(1) - _sums((own**2).sum(1), starts))
    return bias + _sums(w[places], starts) + pairs, total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_arrays(texts: list[np.ndarray], labels: np.ndarray, settings: Settings) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Places of each text and its label to (bias, terms, w, v)."""
    s, random = settings, np.random.default_rng(settings.seed)
    counts = np.bincount(np.concatenate([*texts, np.zeros(0, np.int32)]), minlength=s.space)
    terms = np.flatnonzero(counts >= s.least_rows_of_term).astype(np.int32)
    dense = np.full(s.space, -1, np.int32)
    dense[terms] = np.arange(len(terms), dtype=np.int32)
    rows = [(d := dense[t])[d >= 0] for t in texts]
    often = counts[terms] >= s.least_rows_of_pair  # the others have too few partners to learn from
    w, v = np.zeros(len(terms)), random.normal(0, s.pair_start, (len(terms), s.factors)) * often[:, None]
    n, positive = len(labels), float(labels.sum())
    weight = np.where(labels > 0, ((n - positive + 0.5) / (positive + 0.5)) ** s.balance, 1.0)
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5))) * (1 - s.balance)
    sq_w, sq_v, sq_b = np.full(len(terms), 1e-6), np.full(len(terms), 1e-6), 1e-6
    kept, last = [], max(1, s.epochs // 3)
    for epoch in range(s.epochs if 0 < positive < n else 0):
        order = random.permutation(n)
        for at in range(0, n, s.batch):
            take = order[at : at + s.batch]
            own = [rows[i] for i in take]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            places = np.concatenate(own)
            margin, total = margins(places, starts, w, v, bias)
            slope = weight[take] * (_sigmoid(margin) - labels[take]) / len(take)
            of = np.repeat(np.arange(len(take)), np.diff(starts))
            seen, back = np.unique(places, return_inverse=True)
            g_w = np.bincount(back, slope[of], len(seen))
            per = slope[of][:, None] * (total[of] - v[places])
            g_v = np.stack([np.bincount(back, per[:, f], len(seen)) for f in range(s.factors)], axis=1)
            sq_b += slope.sum() ** 2
            bias -= s.rate * slope.sum() / np.sqrt(sq_b)
            sq_w[seen] += g_w**2
            step = s.rate / np.sqrt(sq_w[seen])
            moved = w[seen] - step * g_w
            w[seen] = np.sign(moved) * np.maximum(np.abs(moved) - step * s.threshold, 0)
            sq_v[seen] += (g_v**2).mean(1)
            step = (s.rate / np.sqrt(sq_v[seen]))[:, None]
            moved = v[seen] - step * g_v
            size = np.sqrt((moved**2).sum(1, keepdims=True))
            v[seen] = moved * np.maximum(1 - step * s.pair_threshold / np.maximum(size, 1e-12), 0) * often[seen][:, None]
        if epoch == s.epochs - last:
            kept = [bias, w.copy(), v.copy()]
        elif epoch > s.epochs - last:
            kept = [kept[0] + bias, kept[1] + w, kept[2] + v]
    if kept:
        bias, w, v = (x / last for x in kept)
    v[np.sqrt((v**2).sum(1)) < 1e-9] = 0
    return bias, terms, w, v


def _places(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(settings)
        for part in arrow.parts(batches, 500):
            found = [known.of(t) for t in part.column("text").to_pylist()]
            yield arrow.with_columns(part, ["text"], {"places": (found, pa.list_(pa.int32()))})

    return run


def _fit(settings: Settings, most_places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, labels, texts, held = [], [], [], 0
        for batch in batches:
            for at, label, places in zip(batch.column("at").to_pylist(), batch.column("label").to_pylist(), batch.column("places"), strict=True):
                if len(texts) == settings.most_rows or held + len(places) > most_places:
                    break
                order.append(at)
                labels.append(label)
                texts.append(places.values.to_numpy())
                held += len(places)
        if not any(labels):
            return
        bias, terms, w, v = fit_arrays(texts, np.array(labels, dtype=np.float64), settings)
        said = np.flatnonzero((w != 0) | (v != 0).any(axis=1))
        yield arrow.made({"term": ([-1], pa.int32()), "w": ([bias], pa.float64()), "v": ([[0.0] * settings.factors], pa.list_(pa.float64()))})
        for at in range(0, len(said), 10_000):
            take = said[at : at + 10_000]
            yield arrow.made({"term": (terms[take], pa.int32()), "w": (w[take], pa.float64()), "v": (list(v[take]), pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "toxic", most_places: int = 40_000_000) -> DataFrame:
    """(term, w, v), written in the shared folder; the bias is the row of term -1.

    ``labels`` has (key, label); null labels and keys count as no label, and a key
    that is there more than once is 1 if any of its rows is. The sample is that of
    the least hashes of the key: at most ``most_rows`` rows, and at most
    ``most_places`` terms in all. Without a row of label 1 the model is empty.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label) == 1).cast("int").alias("label"))
    known = known.withColumn("at", F.pmod(F.xxhash64("_key"), F.lit(1 << 40)))
    n = known.count()
    if n > settings.most_rows:
        # one and a quarter times the share, so that chance leaves no less; the fit takes the first most_rows
        known = known.filter(F.col("at") < int((1 << 40) * min(1.0, 1.25 * settings.most_rows / n)))
    rows = docs.select(F.col(key).alias("_of"), F.col(text).cast("string").alias("text")).join(known, F.col("_of") == F.col("_key"))
    places = rows.select("at", "label", "text").mapInArrow(_places(settings), "at bigint, label int, places array<int>")
    sample = scratch.table(places, "sample")
    one = sample.repartition(1).sortWithinPartitions("at", "label", F.xxhash64("places"))
    return scratch.table(one.mapInArrow(_fit(settings, most_places), _MODEL), "model")


def score(docs: DataFrame, model: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``docs`` without the text and with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 up): one row for each row.

    Every whole text counts. Null and empty texts have no term, so their score is
    that of the bias; an empty model gives 0 to all. Columns that have a new name are
    replaced. An empty table gives no rows.
    """
    found = model.toArrow()  # at most one row for each place
    bias, w, v = None, np.zeros(settings.space), np.zeros((settings.space, settings.factors))
    for term, a, b in zip(*(found.column(c).to_pylist() for c in ("term", "w", "v")), strict=True):
        if term < 0:
            bias = a
        else:
            w[term], v[term] = a, b
    sent = docs.sparkSession.sparkContext.broadcast((bias, w.astype(np.float32), v.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bias, w, v), known = sent.value, Terms(settings)
        for part in arrow.parts(batches, 500):
            texts = [known.of(t) for t in part.column(text).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(int)
            places = np.concatenate([*texts, np.zeros(0, np.int32)])
            chance = np.zeros(len(texts)) if bias is None else _sigmoid(margins(places, starts, w, v, bias)[0])
            yield arrow.with_columns(part, [text], {"score": (chance, pa.float64()), "predicted": ((chance >= 0.5).astype(np.int32), pa.int32())})

    kept = docs.drop("score", "predicted")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != text] + ["score double", "predicted int"])
    return kept.withColumn(text, F.col(text).cast("string")).mapInArrow(run, schema)
