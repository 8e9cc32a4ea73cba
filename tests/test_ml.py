"""Trainers against Spark ML, closed forms and small cases."""

import numpy as np
import pytest
from pyspark.ml import classification, clustering, feature, regression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sealfold.functions import vectors
from sealfold.functions.lbfgs import minimize
from sealfold.functions.vectors import nearest
from sealfold.operators import bayes, kmeans, linear, logistic, pca, wrappers
from sealfold.plans.modes import Mode
from sealfold.session import Config, EncryptedDataset, create_session


@pytest.fixture
def session(spark):
    return create_session(spark)


def _labelled(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(r), float(v)) for r, v in zip(np.asarray(x).tolist(), y, strict=True)], ["features", "label"]).repartition(5)


def _data(df):
    return EncryptedDataset(df, "k")


def test_kmeans_like_spark(spark, session):
    rng = np.random.default_rng(7)
    centers = np.array([[5, 5], [-5, 5], [0, -5]])
    x = centers[np.arange(300) % 3] + 0.5 * rng.standard_normal((300, 2))
    df = spark.createDataFrame([(Vectors.dense(r), i) for i, r in enumerate(x.tolist())], ["features", "id"]).repartition(4)
    m = kmeans.KMeans(session, 3).train(_data(df))
    assert all(((m.centroids - c) ** 2).sum(1).min() < 0.1 for c in centers)
    other = clustering.KMeans(k=3, seed=1).fit(df).summary.trainingCost
    assert m.cost(df) == pytest.approx(other, rel=0.01)
    assert {r["prediction"] == m.predict(r["features"]) for r in m.transform(df).collect()} == {True}


def test_kmeans_edges(spark, session):
    points = spark.createDataFrame([([0.0],), ([0.0],), ([4.0],)], "features array<double>")
    new, cost = kmeans.lloyd_step(session, points, np.array([[0.0], [0.0], [3.0], [99.0]]))
    assert new.ravel().tolist() == [0.0, 0.0, 4.0, 99.0] and cost == 1.0  # ties: the first; an empty cluster stays
    assert kmeans.seeds(np.zeros((3, 1)), 3, 1).tolist() == [[0.0]] * 3
    with pytest.raises(ValueError, match="can't start"):
        kmeans.KMeans(session, 4).train(_data(points))
    m = kmeans.KMeans(session, 2, max_iterations=0).train(_data(points))
    assert sorted(m.centroids.ravel().tolist()) == [0.0, 4.0]


def test_seeds_count_rows_not_values(spark, session):
    """Five places, each repeated far beyond the sample's size in all: every place must be in the sample, and gets a centroid."""
    places = [(0.0, 0.0), (10.0, 7.0), (20.0, 14.0), (30.0, 21.0), (40.0, 28.0)]
    df = spark.range(60_000, numPartitions=4).select(F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in places]), (F.col("id") % 5 + 1).cast("int")).alias("features"))
    sample = kmeans.sampled(df, 42)
    assert len(sample) == kmeans.SAMPLE
    assert min(np.unique(sample, axis=0, return_counts=True)[1]) > 1800
    model = kmeans.KMeans(session, 5).train(_data(df))
    assert sorted(map(tuple, model.centroids.tolist())) == places


def test_nearest_points_by_blocks():
    rng = np.random.default_rng(1)
    x, points = rng.normal(size=(500, 30)) + 1e6, rng.normal(size=(70, 30)) + 1e6  # far from the origin, where products lose digits
    points[5], points[9] = points[2], points[3]  # ties: the first
    want = ((x[:, None] - points) ** 2).sum(2)
    index, distance = nearest(x, points, block=300)
    assert index.tolist() == want.argmin(1).tolist() and np.allclose(distance, want.min(1))


def test_large_models_predict_as_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in rng.integers(0, 5, 6)]) for i in range(50)] + [(50, None), (51, [1.0]), (52, [1.0, None, 1.0, 1.0, 1.0, 1.0])], "id long, features array<double>")
    models = [
        kmeans.KMeansModel(rng.normal(size=(4, 6)), 4), pca.PCAModel(rng.normal(size=(6, 3)), np.ones(3)), linear.LinearRegressionModel(rng.normal(size=6), 0.5),
        logistic.LogisticRegressionModel(rng.normal(size=6), 0.1), bayes.NaiveBayesModel(np.log([0.5, 0.5]), np.log(rng.dirichlet(np.ones(6), 2))),
    ]
    whole = lambda m: [r.asDict() for r in m.transform(df).where("id < 50").orderBy("id").collect()]
    small = [whole(m) for m in models]
    monkeypatch.setattr(vectors, "UNROLLED", 0)
    monkeypatch.setattr(pca, "UNROLLED", 0)
    monkeypatch.setattr(bayes, "UNROLLED", 0)
    for m, want in zip(models, small, strict=True):
        for a, b in zip(whole(m), want, strict=True):
            assert a.keys() == b.keys() and all(a[k] == b[k] if isinstance(a[k], int) else np.allclose(a[k], b[k]) for k in a)
        assert m.transform(df).count() == 53


def test_logistic_like_spark(spark, session):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1000, 2))
    y = (rng.random(1000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - 2 * x[:, 1] + 0.5)))).astype(float)
    df = _labelled(spark, x, y)
    m = logistic.LogisticRegression(session, reg_param=0.1).train(_data(df))
    other = classification.LogisticRegression(regParam=0.1, standardization=False, tol=1e-10).fit(df)
    assert np.allclose(m.weights, other.coefficients.toArray(), atol=1e-4)
    assert m.intercept == pytest.approx(other.intercept, abs=1e-4)
    assert {r["prediction"] == m.predict(r["features"]) for r in m.transform(df).collect()} == {True}
    assert session.partitioner.untrusted_placements > 0


def test_lbfgs_on_a_curved_valley():
    def f(v):
        a, b = v
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    assert np.allclose(minimize(f, np.array([-1.2, 1.0]), 200, 1e-8), [1, 1], atol=1e-4)


def _line(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.standard_normal(500), 3 * rng.standard_normal(500) + 1])
    y = 2 * x[:, 0] + 3 * x[:, 1] - 1 + 0.1 * rng.standard_normal(500)
    return x, y, _labelled(spark, x, y)


def test_linear_like_spark(spark, session):
    _, _, df = _line(spark)
    m = linear.LinearRegression(session).train(_data(df))
    other = regression.LinearRegression(solver="normal").fit(df)
    assert np.allclose(m.weights, other.coefficients.toArray(), atol=1e-8)
    assert m.intercept == pytest.approx(other.intercept, abs=1e-8)
    assert {abs(r["prediction"] - m.predict(r["features"])) < 1e-9 for r in m.transform(df).collect()} == {True}


def test_ridge_by_its_formula(spark, session):
    x, y, df = _line(spark)
    m = linear.LinearRegression(session, 0.7).train(_data(df))
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc / 500 + 0.7 * np.eye(2), xc.T @ yc / 500)
    assert np.allclose(m.weights, w, atol=1e-9)
    assert np.linalg.norm(m.weights) < np.linalg.norm(linear.LinearRegression(session).train(_data(df)).weights)


def test_collinear_features_need_ridge(spark, session):
    df = spark.createDataFrame([([float(i), 2.0 * i], float(i)) for i in range(4)], "features array<double>, label double")
    with pytest.raises(np.linalg.LinAlgError):
        linear.LinearRegression(session).train(_data(df))
    linear.LinearRegression(session, 0.1).train(_data(df))


def test_bayes_like_spark(spark, session):
    rng = np.random.default_rng(9)
    y = np.arange(600) % 3
    x = rng.integers(0, 3, (600, 4))
    x[np.arange(600), y] = rng.integers(0, 8, 600)
    df = _labelled(spark, x.astype(float), y)
    m = bayes.NaiveBayes(session).train(_data(df))
    other = classification.NaiveBayes(smoothing=1.0).fit(df)
    assert np.allclose(m.pi, other.pi.toArray(), atol=1e-9) and np.allclose(m.theta, other.theta.toArray(), atol=1e-9)
    rows = m.transform(df).limit(50).collect()
    assert [r["prediction"] for r in rows] == [other.predict(r["features"]) for r in rows] == [m.predict(r["features"]) for r in rows]


def test_bayes_edges(spark, session):
    gap = spark.createDataFrame([([1.0, 0.0], 0.0), ([0.0, 2.0], 2.0)], "features array<double>, label double")
    m = bayes.NaiveBayes(session).train(_data(gap))
    assert np.allclose(np.exp(m.pi), [2 / 5, 1 / 5, 2 / 5]) and np.allclose(np.exp(m.theta[1]), [0.5, 0.5])
    plain = bayes.model({0: np.array([1.0, 1.0]), 2: np.array([1.0, 1.0])}, 1, 0.0)
    assert plain.pi[1] == -np.inf and np.isnan(plain.theta[1]).all()
    for x, y in (([-1.0], 0.0), ([1.0], 0.5), ([1.0], -1.0)):
        with pytest.raises(Exception, match="labels must|features must"):
            bayes.NaiveBayes(session).train(_data(spark.createDataFrame([(x, y)], "features array<double>, label double")))
    with pytest.raises(ValueError, match="empty training set"):
        bayes.NaiveBayes(session).train(_data(gap.limit(0)))


def test_pca_like_spark(spark, session):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((400, 5)) * [5, 3, 2, 1, 0.5] @ rng.standard_normal((5, 5))
    df = spark.createDataFrame([(Vectors.dense(r),) for r in x.tolist()], ["features"]).repartition(3)
    m = pca.PCA(session, 3).train(_data(df))
    other = feature.PCA(k=3, inputCol="features", outputCol="o").fit(df)
    assert np.allclose(m.explained_variance, other.explainedVariance.toArray(), atol=1e-9)
    assert np.allclose(np.abs(m.components), np.abs(other.pc.toArray()), atol=1e-6)
    row = m.transform(df).first()
    assert np.allclose(row["projection"], m.predict(row["features"]))


def test_pca_edges(spark, session):
    df = spark.createDataFrame([([1.0, 2.0],)], "features array<double>")
    with pytest.raises(ValueError, match="more than one row"):
        pca.PCA(session, 1).train(_data(df))
    with pytest.raises(ValueError, match="k must be"):
        pca.PCA(session, 3).train(_data(df))


def test_ragged_vectors_are_refused(spark, session):
    df = spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0], 0.0)], "features array<double>, label double")
    for trainer in (linear.LinearRegression(session), logistic.LogisticRegression(session), bayes.NaiveBayes(session), pca.PCA(session, 1)):
        with pytest.raises(Exception, match="must have 2 values"):
            trainer.train(_data(df))


def test_sparse_vectors_count_as_dense(spark, session):
    rows = [(Vectors.sparse(2, {0: 1.0}), 1.0), (Vectors.sparse(2, {1: 2.0}), 2.0), (Vectors.dense([1.0, 1.0]), 2.0), (Vectors.sparse(2, {}), 0.0)]
    m = linear.LinearRegression(session).train(_data(spark.createDataFrame(rows, ["features", "label"])))
    assert np.allclose(m.weights, [1, 1]) and m.intercept == pytest.approx(0, abs=1e-12)


def test_modes_train_alike(spark):
    _, _, df = _line(spark)
    models = [linear.LinearRegression(create_session(spark, Config(mode=m))).train(_data(df)) for m in Mode]
    assert np.array_equal(models[0].weights, models[1].weights)


def test_wrappers(spark, session):
    rng = np.random.default_rng(3)
    u, v = rng.standard_normal((40, 2)), rng.standard_normal((30, 2))
    ratings = [(i, j, float(3 + u[i] @ v[j])) for i in range(40) for j in range(30) if rng.random() < 0.6]
    df = spark.createDataFrame(ratings, "user int, item int, rating float")
    out = wrappers.ALS(session, rank=3).train(_data(df)).transform(df).collect()
    y = np.array([r["rating"] for r in out])
    assert np.sqrt(np.mean([(r["prediction"] - r["rating"]) ** 2 for r in out])) < 0.5 * y.std()
    x = rng.standard_normal((200, 2))
    assert wrappers.GBT(session, max_iter=5).train(_data(_labelled(spark, x, (x**2).sum(1)))).getNumTrees == 5
    counts = spark.createDataFrame([(Vectors.dense(rng.integers(0, 5, 20).astype(float).tolist()), i) for i in range(50)], ["features", "docId"])
    m = wrappers.LDA(session, 4, max_iter=3).train(_data(counts))
    assert m.vocabSize() == 20 and m.topicsMatrix().numCols == 4
    assert session.partitioner.untrusted_placements == 0
