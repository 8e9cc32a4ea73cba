"""Spark ML trainers that run in the enclave zone only, since their stages are not statistics. They give Spark ML's own models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import clustering, recommendation, regression


@dataclass(frozen=True)
class ALS:
    """Explicit ratings of user, item, rating; users and items that training did not see are dropped from predictions."""

    session: object
    rank: int = 10
    max_iterations: int = 10
    reg_param: float = 0.1
    seed: int = 42

    def train(self, dataset) -> recommendation.ALSModel:
        als = recommendation.ALS(rank=self.rank, maxIter=self.max_iterations, regParam=self.reg_param, seed=self.seed, userCol="user", itemCol="item", ratingCol="rating", coldStartStrategy="drop")
        return als.fit(dataset.data)


@dataclass(frozen=True)
class GBT:
    """Gradient-boosted regression trees on features and label."""

    session: object
    max_iter: int = 20
    seed: int = 42

    def train(self, dataset) -> regression.GBTRegressionModel:
        return regression.GBTRegressor(featuresCol="features", labelCol="label", maxIter=self.max_iter, seed=self.seed).fit(dataset.data)


@dataclass(frozen=True)
class LDA:
    """Topics over word counts in features."""

    session: object
    k: int
    max_iter: int = 10
    seed: int = 42

    def train(self, dataset) -> clustering.LDAModel:
        return clustering.LDA(featuresCol="features", k=self.k, maxIter=self.max_iter, seed=self.seed).fit(dataset.data)
