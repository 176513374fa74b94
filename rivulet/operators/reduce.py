"""Truncated SVD and PCA from a Gramian that Spark sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Projection:
    """Components as rows, a centre (zeros for SVD), and singular values."""

    components: np.ndarray
    center: np.ndarray
    singular: np.ndarray

    def transform(self, df: DataFrame, source: str = "features", name: str = "reduced") -> DataFrame:
        x = F.col(source)

        def dot(row: np.ndarray, shift: float):
            weights = F.array(*(F.lit(float(w)) for w in row))
            return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(-shift), lambda s, v: s + v)

        return df.withColumn(name, F.array(*(dot(c, float(c @ self.center)) for c in self.components)))


def gramian(df: DataFrame, column: str = "features") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, column sums and X'X.  A task emits one partial matrix, whose cells Spark sums."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            col = batch.column(0).drop_null()
            if not len(col):
                continue
            x = np.asarray(col.flatten(), float).reshape(len(col), -1)
            x = np.hstack([np.ones((len(x), 1)), x])
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["g"])

    cells = df.select(column).mapInArrow(partial, "g array<double>").select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    if cells.empty:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int(round(len(cells) ** 0.5))
    full = np.zeros(d * d)
    full[cells.i] = cells.v
    full = full.reshape(d, d)
    return int(round(full[0, 0])), full[0, 1:], full[1:, 1:]


def _signed(components: np.ndarray) -> np.ndarray:
    """Each component's largest loading is positive."""
    at = np.abs(components).argmax(1)
    return components * np.sign(components[np.arange(len(components)), at])[:, None]


def _projection(gram: np.ndarray, center: np.ndarray, k: int) -> Projection:
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1][:k]
    return Projection(_signed(vectors[:, order].T), center, np.sqrt(np.maximum(values[order], 0)))


def svd(train: DataFrame, k: int, column: str = "features") -> Projection | None:
    """Uncentred truncated SVD with at most min(n, d) - 1 components; None if that is under 1."""
    n, _, gram = gramian(train, column)
    k = min(k, n - 1, len(gram) - 1)
    return _projection(gram, np.zeros(len(gram)), k) if k >= 1 else None


def pca(train: DataFrame, k: int, column: str = "features") -> Projection | None:
    n, sums, gram = gramian(train, column)
    k = min(k, n - 1, len(gram) - 1)
    if k < 1:
        return None
    mean = sums / n
    return _projection(gram - n * np.outer(mean, mean), mean, k)
