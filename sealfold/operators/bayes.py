"""Multinomial naive Bayes from one sum a class and feature."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealfold.functions.vectors import UNROLLED, as_array, dot, matrix, num_features, numbers, products, with_arrays


@dataclass(frozen=True)
class NaiveBayesModel:
    """pi (classes,) and theta (classes, features), logarithms both."""

    pi: np.ndarray
    theta: np.ndarray

    def predict(self, features) -> float:
        """The likeliest class, the least of equally likely ones."""
        x = np.asarray(features.toArray() if hasattr(features, "toArray") else features, np.float64)
        return float(np.argmax(self.pi + self.theta @ x))

    def transform(self, df: DataFrame, column: str = "features", output: str = "prediction") -> DataFrame:
        x = as_array(df, column)
        if self.theta.size > UNROLLED:
            most = products(x, self.theta)
            joint = F.transform(F.arrays_zip(most.alias("s"), F.lit(self.pi.tolist()).alias("p")), lambda v: v["s"] + v["p"])
            return df.withColumn("__joint", joint).withColumn(output, (F.array_position("__joint", F.array_max("__joint")) - 1).cast("double")).drop("__joint")
        # Likeliest first, then the least class: the least of (-likelihood, class).
        scores = [F.struct((-(F.lit(float(p)) + dot(x, t))).alias("less"), F.lit(float(c)).alias("class")) for c, (p, t) in enumerate(zip(self.pi, self.theta, strict=True))]
        return df.withColumn(output, F.array_min(F.array(*scores))["class"])


def merge_sums(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    for k, v in b.items():
        a[k] = a[k] + v if k in a else v
    return a


def class_sums(session, rows: DataFrame, d: int) -> dict[int, np.ndarray]:
    """label -> its rows, then the sums of its features; ValueError for labels or features that can't be counts."""

    def fold(total: dict[int, np.ndarray], batch) -> dict[int, np.ndarray]:
        x, y = matrix(batch, d), numbers(batch, "label")
        if (y < 0).any() or (y != np.floor(y)).any():
            raise ValueError("labels must be whole numbers, 0 or above")
        if (x < 0).any():
            raise ValueError("features must be 0 or above")
        for c in np.unique(y):
            own = x[y == c]
            merge_sums(total, {int(c): np.concatenate([[len(own)], own.sum(0)])})
        return total

    return session.statistic(rows, {}, fold, merge_sums, batches=True)


def model(sums: dict[int, np.ndarray], d: int, smoothing: float) -> NaiveBayesModel:
    """Classes run from 0 to the largest label; one without rows still has its smoothed prior."""
    if not sums:
        raise ValueError("empty training set")
    classes = max(sums) + 1
    table = np.array([sums.get(c, np.zeros(d + 1)) for c in range(classes)])
    n = table[:, 0].sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        pi = np.log(table[:, 0] + smoothing) - np.log(n + classes * smoothing)
        theta = np.log(table[:, 1:] + smoothing) - np.log(table[:, 1:].sum(1, keepdims=True) + d * smoothing)
    return NaiveBayesModel(pi, theta)


@dataclass(frozen=True)
class NaiveBayes:
    session: object
    smoothing: float = 1.0

    def train(self, dataset, column: str = "features") -> NaiveBayesModel:
        rows = with_arrays(dataset.data, column, "label")
        d = num_features(self.session, rows)
        return model(class_sums(self.session, rows, d), d, self.smoothing)
