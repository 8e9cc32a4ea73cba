"""Binary logistic regression on the driver over distributed sums of loss, gradient and, up to some hundred features, curvature.

With curvature Newton's steps reach the optimum in a few jobs; with more features L-BFGS does without it. The loss is convex, so
both end at the same place; where Newton's step finds no way down, L-BFGS goes on from there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealfold.functions.lbfgs import minimize
from sealfold.functions.vectors import add_in_place, as_array, dot, matrix, num_features, numbers, sigmoid, with_arrays


@dataclass(frozen=True)
class LogisticRegressionModel:
    weights: np.ndarray
    intercept: float

    def probability(self, features) -> float:
        x = np.asarray(features.toArray() if hasattr(features, "toArray") else features, np.float64)
        m = float(x @ self.weights + self.intercept)
        return float(1 / (1 + np.exp(-m))) if m >= 0 else float(np.exp(m) / (1 + np.exp(m)))

    def predict(self, features) -> float:
        return 1.0 if self.probability(features) >= 0.5 else 0.0

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        p = sigmoid(dot(as_array(df, column), self.weights) + F.lit(self.intercept))
        return df.withColumn("probability", p).withColumn("prediction", F.when(F.col("probability") >= 0.5, 1.0).otherwise(0.0))


#: Features up to which a partition's statistic holds the curvature, a square of numbers.
MOST_CURVED = 256


def loss_and_gradient_sums(session, rows: DataFrame, coefficients: np.ndarray, curvature: bool = False) -> np.ndarray:
    """d gradients, the intercept's, the loss, the number of rows and, if wanted, the (d + 1)^2 second derivatives; rows has features (array) and label."""
    d = len(coefficients) - 1

    def fold(total: np.ndarray, batch) -> np.ndarray:
        x, y = matrix(batch, d), numbers(batch, "label")
        m = x @ coefficients[:-1] + coefficients[-1]
        e = np.exp(-np.abs(m))
        p = np.where(m >= 0, 1, e) / (1 + e)
        error = p - y
        total[:d] += x.T @ error
        total[d] += error.sum()
        total[d + 1] += (np.maximum(m, 0) + np.log1p(e) - y * m).sum()
        total[d + 2] += len(y)
        if curvature:
            z = np.column_stack([x, np.ones(len(y))])
            total[d + 3 :] += (z.T @ (z * (p * (1 - p))[:, None])).ravel()
        return total

    return session.statistic(rows, np.zeros(d + 3 + curvature * (d + 1) ** 2), fold, add_in_place, batches=True)


def newton(f, start: np.ndarray, max_iterations: int, tolerance: float) -> tuple[np.ndarray, bool]:
    """(point, whether it is the optimum) by Newton's steps, halved where they don't go down; f gives value, gradient and curvature."""
    x = start
    value, gradient, curvature = f(x)
    for _ in range(max_iterations):
        step = -np.linalg.lstsq(curvature + 1e-12 * max(1e-300, np.trace(curvature)) * np.eye(len(x)), gradient, rcond=None)[0]
        slope = float(gradient @ step)
        if not np.isfinite(slope) or slope > 0:
            return x, False
        if -slope <= 1e-4 * tolerance * max(1.0, abs(value)):
            return x, True
        for k in range(8):
            found = f(x + step / 2**k)
            if np.isfinite(found[0]) and found[0] <= value + 1e-4 * slope / 2**k:
                break
        else:
            return x, False
        x = x + step / 2**k
        value, gradient, curvature = found
    return x, True


@dataclass(frozen=True)
class LogisticRegression:
    """Labels are 0 or 1. The intercept isn't regularised."""

    session: object
    max_iterations: int = 100
    reg_param: float = 0.0
    tol: float = 1e-6

    def train(self, dataset, column: str = "features") -> LogisticRegressionModel:
        rows = with_arrays(dataset.data, column, "label").cache()
        try:
            d = num_features(self.session, rows)
            free = np.append(np.ones(d), 0)

            def f(c: np.ndarray, curved: bool = False) -> tuple:
                s = loss_and_gradient_sums(self.session, rows, c, curved)
                w = c * free
                out = s[d + 1] / s[d + 2] + self.reg_param / 2 * float(w @ w), s[: d + 1] / s[d + 2] + self.reg_param * w
                return (*out, s[d + 3 :].reshape(d + 1, d + 1) / s[d + 2] + self.reg_param * np.diag(free)) if curved else out

            c, done = newton(lambda c: f(c, True), np.zeros(d + 1), self.max_iterations, self.tol) if d <= MOST_CURVED else (np.zeros(d + 1), False)
            if not done:
                c = minimize(f, c, self.max_iterations, self.tol)
        finally:
            rows.unpersist()
        return LogisticRegressionModel(c[:-1], float(c[-1]))
