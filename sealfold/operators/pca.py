"""Principal components from one fold of moments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealfold.functions.vectors import UNROLLED, as_array, dot, num_features, products, with_arrays
from sealfold.operators.linear import moments


@dataclass(frozen=True)
class PCAModel:
    """components (features, k), of arbitrary sign, and the share of the variance that each explains."""

    components: np.ndarray
    explained_variance: np.ndarray

    def predict(self, features) -> np.ndarray:
        """The projection of a vector, which is not centred."""
        x = np.asarray(features.toArray() if hasattr(features, "toArray") else features, np.float64)
        return self.components.T @ x

    def transform(self, df: DataFrame, column: str = "features", output: str = "projection") -> DataFrame:
        x = as_array(df, column)
        small = self.components.size <= UNROLLED
        return df.withColumn(output, F.array(*[dot(x, c) for c in self.components.T]) if small else products(x, self.components.T))


def covariance(n: float, x: np.ndarray, xx: np.ndarray) -> np.ndarray:
    if n <= 1:
        raise ValueError("a covariance needs more than one row")
    return (xx - np.outer(x, x) / n) / (n - 1)


@dataclass(frozen=True)
class PCA:
    session: object
    k: int

    def train(self, dataset, column: str = "features") -> PCAModel:
        rows = with_arrays(dataset.data, column)
        d = num_features(self.session, rows)
        if not 0 < self.k <= d:
            raise ValueError(f"k must be from 1 to the {d} features, not {self.k}")
        n, x, _, xx, _ = moments(self.session, rows, d, label=False)
        values, vectors = np.linalg.eigh(covariance(n, x, xx))
        order = np.argsort(values)[::-1]
        return PCAModel(vectors[:, order[: self.k]], values[order[: self.k]] / values.sum())
