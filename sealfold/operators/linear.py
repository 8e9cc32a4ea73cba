"""Linear and ridge regression by the normal equations over one fold of moments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealfold.functions.vectors import add_in_place, as_array, dot, matrix, num_features, numbers, with_arrays


@dataclass(frozen=True)
class LinearRegressionModel:
    weights: np.ndarray
    intercept: float

    def predict(self, features) -> float:
        x = np.asarray(features.toArray() if hasattr(features, "toArray") else features, np.float64)
        return float(self.intercept + x @ self.weights)

    def transform(self, df: DataFrame, column: str = "features", output: str = "prediction") -> DataFrame:
        return df.withColumn(output, F.lit(self.intercept) + dot(as_array(df, column), self.weights))


def moments(session, rows: DataFrame, d: int, label: bool = True) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    """(n, sum x, sum y, sum x x', sum x y); without a label y counts as 0."""

    def fold(total: np.ndarray, batch) -> np.ndarray:
        x = matrix(batch, d)
        y = numbers(batch, "label") if label else np.zeros(len(x))
        total += np.concatenate([[len(x)], x.sum(0), [y.sum()], (x.T @ x).ravel(), x.T @ y])
        return total

    s = session.statistic(rows, np.zeros(2 + 2 * d + d * d), fold, add_in_place, batches=True)
    return s[0], s[1 : d + 1], s[d + 1], s[d + 2 : d + 2 + d * d].reshape(d, d), s[d + 2 + d * d :]


def solve(n: float, x: np.ndarray, y: float, xx: np.ndarray, xy: np.ndarray, reg_param: float) -> LinearRegressionModel:
    """Least 1/(2n) |error|^2 + reg/2 |w|^2 with a free intercept; LinAlgError for collinear features without ridge."""
    mean, mean_y = x / n, y / n
    a = xx / n - np.outer(mean, mean) + reg_param * np.eye(len(x))
    w = np.linalg.solve(a, xy / n - mean * mean_y)
    return LinearRegressionModel(w, float(mean_y - w @ mean))


@dataclass(frozen=True)
class LinearRegression:
    session: object
    reg_param: float = 0.0

    def train(self, dataset, column: str = "features") -> LinearRegressionModel:
        rows = with_arrays(dataset.data, column, "label")
        d = num_features(self.session, rows)
        return solve(*moments(self.session, rows, d), self.reg_param)
