"""K-Means by Lloyd's steps over per-partition sums, counts and cost."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealfold.functions.vectors import add_in_place, as_array, closest, matrix, nearest, num_features, with_arrays

#: Rows from which starting points are picked.
SAMPLE = 10_000


@dataclass(frozen=True)
class KMeansModel:
    centroids: np.ndarray
    k: int

    def predict(self, features) -> int:
        """The index of the nearest centroid, the least of equally near ones."""
        x = np.asarray(features.toArray() if hasattr(features, "toArray") else features, np.float64)
        return int(np.argmin(((self.centroids - x) ** 2).sum(1)))

    def transform(self, df: DataFrame, column: str = "features", output: str = "prediction") -> DataFrame:
        return df.withColumn(output, closest(as_array(df, column), self.centroids.tolist())["index"])

    def cost(self, df: DataFrame, column: str = "features") -> float:
        """The sum of squared distances to the nearest centroids."""
        return df.agg(F.sum(closest(as_array(df, column), self.centroids.tolist())["distance"])).first()[0] or 0.0


def seeds(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++: the first point by chance, each next with a chance in proportion to its squared distance from those before."""
    if len(points) < k:
        raise ValueError(f"{len(points)} points can't start {k} clusters")
    rng = np.random.default_rng(seed)
    chosen = [points[rng.integers(len(points))]]
    nearest = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        total = np.cumsum(nearest)
        # Where nothing is apart from the points chosen, the last one is taken again.
        at = min(int(np.searchsorted(total, rng.random() * total[-1], side="right")), len(points) - 1)
        chosen.append(points[at])
        nearest = np.minimum(nearest, ((points - points[at]) ** 2).sum(1))
    return np.array(chosen)


def sampled(points: DataFrame, seed: int, size: int = SAMPLE) -> np.ndarray:
    """So many rows by chance, or all where there are no more: repeated points count as often as they occur. The driver counts as enclave."""
    n = points.count()
    rows = points.select("features", F.rand(seed).alias("__chance"))
    if n > size:  # twice as many and a margin, so that fewer than wanted are a chance of nothing; then the least of them
        rows = rows.where(F.col("__chance") < (2 * size + 1000) / n)
    found = rows.orderBy("__chance").limit(size).collect()
    return np.array([r["features"] for r in found], np.float64)


def partial_sums(session, points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, float]:
    """(a row a cluster: the sums of its points and their number, cost)."""
    k, d = centroids.shape

    def fold(total: np.ndarray, batch) -> np.ndarray:
        x = matrix(batch, d)
        index, distance = nearest(x, centroids)
        order = np.argsort(index, kind="stable")
        found, first = np.unique(index[order], return_index=True)
        blocks = total[:-1].reshape(k, d + 1)
        blocks[found, :-1] += np.add.reduceat(x[order], first) if len(x) else 0.0
        blocks[found, -1] += np.diff(np.append(first, len(x)))
        total[-1] += distance.sum()
        return total

    total = session.statistic(points, np.zeros(k * (d + 1) + 1), fold, add_in_place, batches=True)
    return total[:-1].reshape(k, d + 1), float(total[-1])


def lloyd_step(session, points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, float]:
    """(new centroids, cost with the old ones). A cluster that no point is nearest to keeps its centroid."""
    blocks, cost = partial_sums(session, points, centroids)
    filled = blocks[:, -1] > 0
    new = centroids.copy()
    new[filled] = blocks[filled, :-1] / blocks[filled, -1:]
    return new, cost


@dataclass(frozen=True)
class KMeans:
    session: object
    k: int
    max_iterations: int = 100
    tol: float = 1e-4
    seed: int = 42

    def train(self, dataset, column: str = "features") -> KMeansModel:
        points = with_arrays(dataset.data, column).cache()
        try:
            num_features(self.session, points)
            centroids = seeds(sampled(points, self.seed), self.k, self.seed)
            for _ in range(self.max_iterations):
                new, _ = lloyd_step(self.session, points, centroids)
                moved = np.sqrt(((new - centroids) ** 2).sum(1))
                centroids = new
                if (moved < self.tol).all():
                    break
        finally:
            points.unpersist()
        return KMeansModel(centroids, self.k)
