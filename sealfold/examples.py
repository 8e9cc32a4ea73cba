"""All trainers on small made-up data, then a report of placements: ``python -m sealfold.examples``."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import SparkSession

from sealfold.operators import bayes, kmeans, linear, logistic, pca, wrappers
from sealfold.session import EncryptedDataset, Session, create_session


def _dataset(session: Session, x: np.ndarray, y=None) -> EncryptedDataset:
    rows = [(Vectors.dense(r), float(v)) for r, v in zip(np.asarray(x, float).tolist(), np.zeros(len(x)) if y is None else y, strict=True)]
    return EncryptedDataset(session.spark.createDataFrame(rows, ["features", "label"]), session.key_id)


def run(session: Session, seed: int = 1) -> dict[str, object]:
    """name -> what a trainer found, or a measure of it; ``placements`` counts stages audited for the untrusted zone."""
    rng = np.random.default_rng(seed)
    out: dict[str, object] = {}
    centers = np.array([[0, 0], [8, 8], [0, 8]])
    x = centers[rng.integers(0, 3, 1000)] + rng.standard_normal((1000, 2))
    out["kmeans"] = kmeans.KMeans(session, 3).train(_dataset(session, x)).centroids.round(1).tolist()
    x = rng.standard_normal((1000, 2))
    y = x[:, 0] > x[:, 1]
    m = logistic.LogisticRegression(session, 50, 0.01).train(_dataset(session, x, y))
    out["logistic accuracy"] = float(np.mean([(m.predict(r) == 1) == v for r, v in zip(x, y, strict=True)]))
    ratings = [(u, i, float(1 + 4 * rng.random())) for u in range(100) for i in range(50) if rng.random() < 0.3]
    frame = session.spark.createDataFrame(ratings, "user int, item int, rating float")
    out["als rank"] = wrappers.ALS(session, rank=5, max_iterations=3).train(EncryptedDataset(frame, session.key_id)).rank
    y = rng.integers(0, 2, 1000)
    x = rng.poisson(np.where(y[:, None] == 1, [4, 1, 1], [1, 1, 4]))
    m = bayes.NaiveBayes(session).train(_dataset(session, x, y))
    out["bayes accuracy"] = float(np.mean([m.predict(r) == v for r, v in zip(x, y, strict=True)]))
    x = rng.standard_normal((1000, 2))
    out["linear weights"] = linear.LinearRegression(session).train(_dataset(session, x, x @ [2, -1] + 3)).weights.round(3).tolist()
    out["trees"] = wrappers.GBT(session, max_iter=3).train(_dataset(session, x, (x**2).sum(1))).getNumTrees
    out["pca explained"] = pca.PCA(session, 2).train(_dataset(session, rng.standard_normal((1000, 10)) * np.arange(1, 11))).explained_variance.round(3).tolist()
    out["topics"] = wrappers.LDA(session, 3, max_iter=3).train(_dataset(session, rng.integers(0, 5, (100, 50)))).vocabSize()
    out["mode"], out["placements"] = session.mode.value, session.partitioner.untrusted_placements
    return out


if __name__ == "__main__":
    for name, value in run(create_session(SparkSession.builder.appName("examples").getOrCreate())).items():
        print(f"{name}: {value}")
