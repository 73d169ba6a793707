"""Models of vectors whose state is small: product codes, alignment, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfloom.functions import vectors


def codebooks(df: DataFrame, key: str, vector: str, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): slices of the first ``entries`` vectors by key, zeros where there are fewer."""
    rows = df.orderBy(key).limit(entries).select(vector).collect()
    m = np.array([r[0] for r in rows], dtype=np.float64)
    width = m.shape[1] // parts
    out = np.zeros((parts, entries, width))
    out[:, : len(m)] = m[:, : parts * width].reshape(len(m), parts, width).transpose(1, 0, 2)
    return out


def book_literal(books: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in entry]) for entry in book]) for book in books])


def encode(df: DataFrame, key: str, vector: str, books: np.ndarray) -> DataFrame:
    """(key, codes): the nearest codebook entry of each slice."""
    return df.select(key, vectors.product_codes(F.col(vector), book_literal(books), books.shape[2]).alias("codes"))


def adc_distances(codes: DataFrame, query: list[float], books: np.ndarray) -> DataFrame:
    """``codes`` with the distance of a query to the coded vectors, from a table of slice distances."""
    q = np.array(query, dtype=np.float64)[: books.shape[0] * books.shape[2]].reshape(books.shape[0], 1, -1)
    table = ((books - q) ** 2).sum(axis=2)
    lookup = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table])
    total = F.aggregate(F.zip_with("codes", lookup, lambda c, row: F.get(row, c)), F.lit(0.0), lambda acc, x: acc + x)
    return codes.withColumn("distance", F.round(F.sqrt(total), 4))


def alignment(df: DataFrame, x: str, y: str, size: int) -> np.ndarray:
    """The orthogonal Q that brings ``x`` nearest to ``y``: the moment matrix is summed where the rows are, its SVD is done on the driver (size x size)."""
    a, b = vectors.doubles(F.col(x)), vectors.doubles(F.col(y))
    sums = df.agg(*[F.sum(F.element_at(b, i + 1) * F.element_at(a, j + 1)).alias(f"m{i}_{j}") for i in range(size) for j in range(size)]).first()
    m = np.array(list(sums), dtype=np.float64).reshape(size, size)
    u, _, v = np.linalg.svd(m)
    return u @ v


def apply_matrix(c: Column, q: np.ndarray) -> Column:
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in q])
    return F.transform(rows, lambda row: vectors.dot(row, c))


def logistic_fit(df: DataFrame, features: list[str], label: str, least_rows: int = 10):
    """(weights, bias, means, scales) of a balanced logistic regression on standardised features; None under ``least_rows``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = df.select(*features, F.col(label).cast("double").alias("label")).dropna()
    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    total = sum(n.values())
    if total < least_rows or len(n) < 2:
        return None
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0])))
    ready = VectorAssembler(inputCols=features, outputCol="raw").transform(weighted)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(ready)
    model = LogisticRegression(weightCol="weight", regParam=1.0 / total, elasticNetParam=0.0, standardization=False).fit(scaler.transform(ready))
    return [float(x) for x in model.coefficients], float(model.intercept), [float(x) for x in scaler.mean], [float(x) or 1.0 for x in scaler.std]


def contrastive_loss(x: np.ndarray, y: np.ndarray, temperature: float = 0.07) -> float:
    """Symmetric InfoNCE of a batch of aligned pairs, four digits."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    s = unit(x) @ unit(y).T / temperature

    def one(m: np.ndarray) -> float:
        top = m.max(axis=1, keepdims=True)
        return float((np.log(np.exp(m - top).sum(axis=1)) + top[:, 0] - np.diag(m)).mean())

    return round((one(s) + one(s.T)) / 2, 4)
