"""Queries over the benchmark tables, one for each operator, and SQL with the same rows where SQL can express them.

Sums of floating-point numbers depend on their order in the last digits, so such results are rounded on both sides.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from sealfold.functions.vectors import as_array, num_features
from sealfold.operators import bayes, kmeans, linear, logistic, pca, wrappers
from sealfold.plans.audit import Frame, LeakageAuditor, LeakageError
from sealfold.plans.modes import Mode
from sealfold.session import Config, EncryptedDataset, Session
from sealfold.sources import cli, keystore

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession, mode: Mode | None = None) -> Session:
    """A session for public benchmark tables: any cluster will do, and its workers share this process's own key."""
    return Session(spark, Config(mode=mode, one_zone=True, lend_key=True))


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def dataset(df: DataFrame) -> EncryptedDataset:
    return EncryptedDataset(df, Config().key_id)


def shared_folder(spark: SparkSession) -> str:
    """Where a query's tables go: the cluster's shared folder, or a temporary one in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/sealfold-{os.urandom(8).hex()}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="sealfold-") + "/t"


# --- statistics ------------------------------------------------------------------------------------------------------


@query("SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM lineitem")
def stat_sum_count(spark, sf_dir):
    r = session(spark).statistic_agg(table(spark, sf_dir, "lineitem"), F.sum(F.col("l_quantity").cast("long")).alias("total"), F.count(F.lit(1)).alias("n"))
    return rows(spark, "total long, n long", (r["total"], r["n"]))


def _fold(value: np.ndarray, batch) -> np.ndarray:
    x = batch.column(0).to_numpy(zero_copy_only=False)
    return value + np.array([x.sum(), len(x)], np.int64)


@query("""SELECT m AS mode, total, n, p AS placements FROM
  (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM lineitem), (VALUES ('SML1', 0), ('SML2', 1)) v(m, p)""")
def stat_modes_equal(spark, sf_dir):
    out = []
    for mode in Mode:
        s = session(spark, mode)
        data = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("q"))
        total, n = s.statistic(data, np.zeros(2, np.int64), _fold, lambda a, b: a + b, batches=True)
        out.append((mode.value, int(total), int(n), s.partitioner.untrusted_placements))
    return rows(spark, "mode string, total long, n long, placements int", *out)


@query("SELECT CAST(max(len(embedding)) AS INTEGER) AS d FROM embeddings")
def num_features_max(spark, sf_dir):
    return rows(spark, "d int", (num_features(session(spark), table(spark, sf_dir, "embeddings"), "embedding"),))


# --- K-Means ---------------------------------------------------------------------------------------------------------

_CENTROIDS = "c AS (SELECT vec_id AS i, embedding AS c FROM embeddings WHERE vec_id < 3)"
_ASSIGNED = f"""{_CENTROIDS}, d AS (
  SELECT vec_id, embedding, i, list_sum(list_transform(range(1, len(embedding) + 1), lambda k: (embedding[k]::DOUBLE - c[k]::DOUBLE) * (embedding[k]::DOUBLE - c[k]::DOUBLE))) AS dist FROM embeddings, c
), a AS (SELECT vec_id, embedding, i, dist FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, i) = 1)"""


def _first_three(spark, sf_dir) -> kmeans.KMeansModel:
    """A model whose centroids are the three first vectors."""
    found = table(spark, sf_dir, "embeddings").where("vec_id < 3").orderBy("vec_id").select(F.col("embedding").cast("array<double>")).collect()
    return kmeans.KMeansModel(np.array([r[0] for r in found]), len(found))


@query(f"WITH {_ASSIGNED} SELECT vec_id, CAST(i AS INTEGER) AS prediction FROM a")
def kmeans_assign(spark, sf_dir):
    return _first_three(spark, sf_dir).transform(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "prediction")


@query(f"WITH {_ASSIGNED} SELECT CAST(i AS INTEGER) AS cluster, CAST(k AS INTEGER) AS pos, count(*) AS n, round(sum(embedding[k + 1]::DOUBLE), 4) AS total FROM a, range(64) t(k) GROUP BY ALL")
def kmeans_partials(spark, sf_dir):
    """The sums and counts that each of Lloyd's steps takes, of whole vectors."""
    sums, _ = kmeans.partial_sums(session(spark), _vectors(spark, sf_dir).select("features"), _first_three(spark, sf_dir).centroids)
    return rows(spark, "cluster int, pos int, n long, total double", *[(i, k, int(c[-1]), round(float(x), 4)) for i, c in enumerate(sums) if c[-1] for k, x in enumerate(c[:-1])])


@query(f"WITH {_ASSIGNED} SELECT round(sum(dist), 4) AS cost FROM a")
def kmeans_cost(spark, sf_dir):
    return rows(spark, "cost double", (round(_first_three(spark, sf_dir).cost(table(spark, sf_dir, "embeddings"), "embedding"), 4),))


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))


def _lloyd_sql(steps: int) -> str:
    distance = "list_sum(list_transform(range(1, 65), lambda k: (embedding[k]::DOUBLE - c[k]) * (embedding[k]::DOUBLE - c[k])))"
    ctes = ["c0 AS (SELECT vec_id AS i, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 3)"]
    for s in range(steps):
        ctes.append(f"n{s} AS (SELECT embedding, i FROM (SELECT vec_id, embedding, i, {distance} AS dist FROM embeddings, c{s}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, i) = 1)")
        ctes.append(f"m{s} AS (SELECT i, list(v ORDER BY k) AS v FROM (SELECT i, k, avg(embedding[k]::DOUBLE) AS v FROM n{s}, range(1, 65) t(k) GROUP BY i, k) GROUP BY i)")
        ctes.append(f"c{s + 1} AS (SELECT c{s}.i, coalesce(m{s}.v, c{s}.c) AS c FROM c{s} LEFT JOIN m{s} ON m{s}.i = c{s}.i)")
    return f"WITH {', '.join(ctes)} SELECT CAST(i AS INTEGER) AS cluster, CAST(k AS INTEGER) AS pos, round(c[k + 1], 6) + 0.0 AS value FROM c{steps}, range(64) t(k)"


@query(_lloyd_sql(2))
def kmeans_lloyd2(spark, sf_dir):
    """Two of Lloyd's steps over whole vectors."""
    s, points = session(spark), _vectors(spark, sf_dir)
    c = _first_three(spark, sf_dir).centroids
    for _ in range(2):
        c, _ = kmeans.lloyd_step(s, points.select("features"), c)
    return rows(spark, "cluster int, pos int, value double", *[(i, k, round(float(x), 6) + 0.0) for i, v in enumerate(c) for k, x in enumerate(v)])


@query()
def kmeans_train(spark, sf_dir):
    """Centroids of ten clusters of all embeddings; k-means++ picks by chance, so SQL has no counterpart."""
    m = kmeans.KMeans(session(spark), 10, max_iterations=20).train(dataset(table(spark, sf_dir, "embeddings")), "embedding")
    return rows(spark, "cluster int, centroid array<double>", *[(i, c.tolist()) for i, c in enumerate(m.centroids)])


# --- regression ------------------------------------------------------------------------------------------------------

_WEIGHTS, _INTERCEPT = (0.03, -2.0), 0.1
_MARGIN = f"(0.0 + l_quantity * {_WEIGHTS[0]} + l_discount * {_WEIGHTS[1]}) + {_INTERCEPT}"


def _flags(spark, sf_dir) -> DataFrame:
    """Returned or not, by quantity and discount."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount").alias("features"), (F.col("l_returnflag") == "R").cast("double").alias("label"))


@query(f"""WITH m AS (SELECT l_quantity AS a, l_discount AS b, (l_returnflag = 'R')::INT::DOUBLE AS y, {_MARGIN} AS m FROM lineitem), e AS (SELECT *, 1 / (1 + exp(-m)) - y AS e FROM m)
SELECT round(sum(e * a), 2) AS g0, round(sum(e * b), 3) AS g1, round(sum(e), 3) AS g_intercept, round(sum(CASE WHEN m > 0 THEN m + ln(1 + exp(-m)) ELSE ln(1 + exp(m)) END - y * m), 3) AS loss, count(*) AS n FROM e""")
def logreg_loss_grad(spark, sf_dir):
    """The sums that each of the trainer's steps takes."""
    g0, g1, intercept, loss, n = logistic.loss_and_gradient_sums(session(spark), _flags(spark, sf_dir).select("features", "label"), np.array([*_WEIGHTS, _INTERCEPT])).tolist()
    return rows(spark, "g0 double, g1 double, g_intercept double, loss double, n long", (round(g0, 2), round(g1, 3), round(intercept, 3), round(loss, 3), int(n)))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN 1 / (1 + exp(-({_MARGIN}))) >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM lineitem")
def logreg_predict(spark, sf_dir):
    m = logistic.LogisticRegressionModel(np.array(_WEIGHTS), _INTERCEPT)
    return m.transform(_flags(spark, sf_dir)).select("l_orderkey", "l_linenumber", "prediction")


@query()
def logreg_train(spark, sf_dir):
    """Fitted coefficients; SQL has no optimiser."""
    m = logistic.LogisticRegression(session(spark), 30, 0.01).train(dataset(_flags(spark, sf_dir)))
    return rows(spark, "w0 double, w1 double, intercept double", (float(m.weights[0]), float(m.weights[1]), m.intercept))


def _prices(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("features"), F.col("l_extendedprice").alias("label"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def linreg_ols(spark, sf_dir):
    m = linear.LinearRegression(session(spark)).train(dataset(_prices(spark, sf_dir)))
    return rows(spark, "slope double, intercept double", (round(float(m.weights[0]), 4), round(m.intercept, 3)))


@query("""WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) / (var_pop(l_quantity) + 0.5) AS w, avg(l_extendedprice) AS y, avg(l_quantity) AS x FROM lineitem)
SELECT round(w, 4) AS slope, round(y - w * x, 3) AS intercept FROM s""")
def linreg_ridge(spark, sf_dir):
    m = linear.LinearRegression(session(spark), 0.5).train(dataset(_prices(spark, sf_dir)))
    return rows(spark, "slope double, intercept double", (round(float(m.weights[0]), 4), round(m.intercept, 3)))


@query("""WITH m AS (SELECT covar_pop(l_extendedprice, l_quantity) AS xy, covar_pop(l_extendedprice, l_discount) AS zy, var_pop(l_quantity) AS xx, var_pop(l_discount) AS zz, covar_pop(l_quantity, l_discount) AS xz,
  avg(l_extendedprice) AS y, avg(l_quantity) AS x, avg(l_discount) AS z FROM lineitem), w AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b, x, y, z FROM m)
SELECT round(a, 3) AS w0, round(b, 2) AS w1, round(y - a * x - b * z, 2) AS intercept FROM w""")
def linreg_two(spark, sf_dir):
    data = table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_discount").alias("features"), F.col("l_extendedprice").alias("label"))
    m = linear.LinearRegression(session(spark)).train(dataset(data))
    return rows(spark, "w0 double, w1 double, intercept double", (round(float(m.weights[0]), 3), round(float(m.weights[1]), 2), round(m.intercept, 2)))


@query("SELECT l_orderkey, l_linenumber, round((100.0 + (0.0 + l_quantity * 1500.0)) + 0.0, 6) AS prediction FROM lineitem")
def linreg_predict(spark, sf_dir):
    data = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity").alias("features"))
    m = linear.LinearRegressionModel(np.array([1500.0]), 100.0)
    return m.transform(data).select("l_orderkey", "l_linenumber", F.round("prediction", 6).alias("prediction"))


# --- naive Bayes -----------------------------------------------------------------------------------------------------

#: Every word of a text counts, in the bucket that its hash names.
_TERMS = 16
_NB_ROWS = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM documents),
h AS (SELECT doc_id, strpos('0123456789abcdef', substr(md5(w), 1, 1)) AS b, count(*) AS c FROM w GROUP BY ALL),
r AS (SELECT d.doc_id, quality AS y, list(coalesce(c, 0)::DOUBLE ORDER BY k) AS x FROM documents d JOIN labels USING (doc_id) CROSS JOIN range(1, {_TERMS + 1}) t(k) LEFT JOIN h ON h.doc_id = d.doc_id AND h.b = k GROUP BY d.doc_id, quality)"""
_NB_MODEL = f"""t AS (SELECT y, k AS pos, sum(x[k + 1]) AS s, count(*) AS n FROM r, range({_TERMS}) q(k) GROUP BY ALL),
m AS (SELECT y, pos, ln(n + 1) - ln(sum(n) OVER (PARTITION BY pos) + 2) AS pi, ln(s + 1) - ln(sum(s) OVER (PARTITION BY y) + {_TERMS}) AS theta FROM t)"""


def _term_counts(spark, sf_dir) -> DataFrame:
    """Hashed word counts of whole texts, with their label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # A letter a word, its bucket's. Each bucket names the column once, so Spark computes it once a row and not once a bucket.
    docs = docs.withColumn("b", F.array_join(F.transform(words, lambda w: F.substring(F.md5(w), 1, 1)), ""))
    counts = F.array(*[(F.length("b") - F.length(F.replace("b", F.lit(digit), F.lit("")))).cast("double") for digit in "0123456789abcdef"])
    # Counted before the join, which then moves 16 numbers a document and no text.
    return docs.select("doc_id", counts.alias("features")).join(labels, "doc_id").select("doc_id", "features", F.col("quality").cast("double").alias("label"))


@query(f"WITH {_NB_ROWS} SELECT CAST(y AS INTEGER) AS label, CAST(k AS INTEGER) AS pos, count(*) AS n, CAST(sum(x[k + 1]) AS BIGINT) AS total FROM r, range(16) q(k) GROUP BY ALL")
def nb_counts(spark, sf_dir):
    sums = bayes.class_sums(session(spark), _term_counts(spark, sf_dir).drop("doc_id"), _TERMS)
    return rows(spark, "label int, pos int, n long, total long", *[(c, k, int(s[0]), int(s[k + 1])) for c, s in sums.items() for k in range(_TERMS)])


@query(f"WITH {_NB_ROWS}, {_NB_MODEL} SELECT CAST(y AS INTEGER) AS label, CAST(pos AS INTEGER) AS pos, round(pi, 9) AS pi, round(theta, 9) AS theta FROM m")
def nb_model(spark, sf_dir):
    m = bayes.NaiveBayes(session(spark)).train(dataset(_term_counts(spark, sf_dir)))
    return rows(spark, "label int, pos int, pi double, theta double", *[(c, k, round(float(m.pi[c]), 9), round(float(t), 9)) for c in range(len(m.pi)) for k, t in enumerate(m.theta[c])])


@query(f"""WITH {_NB_ROWS}, {_NB_MODEL}, s AS (SELECT doc_id, m.y, any_value(pi) + sum(theta * x[pos + 1]) AS s FROM r, m GROUP BY doc_id, m.y)
SELECT doc_id, y::DOUBLE AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, y) = 1""")
def nb_predict(spark, sf_dir):
    data = _term_counts(spark, sf_dir)
    m = bayes.NaiveBayes(session(spark)).train(dataset(data))
    return m.transform(data).select("doc_id", "prediction")


# --- PCA -------------------------------------------------------------------------------------------------------------


_COVARIANCE = "c AS (SELECT i, j, covar_samp(embedding[i + 1]::DOUBLE, embedding[j + 1]::DOUBLE) AS c FROM embeddings, range(64) a(i), range(64) b(j) GROUP BY ALL)"


@query(f"WITH {_COVARIANCE} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(c, 8) + 0.0 AS covariance FROM c")
def pca_covariance(spark, sf_dir):
    """The covariance of whole vectors."""
    n, x, _, xx, _ = linear.moments(session(spark), _vectors(spark, sf_dir).select("features"), 64, label=False)
    c = pca.covariance(n, x, xx)
    return rows(spark, "i int, j int, covariance double", *[(i, j, round(float(c[i, j]), 8) + 0.0) for i in range(64) for j in range(64)])


@query(f"""WITH {_COVARIANCE}, t AS (SELECT sum(c) AS t FROM c WHERE i = j), q AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY a.i, b.j),
p AS (SELECT 1 AS power, sum(c) AS s FROM c WHERE i = j UNION ALL SELECT 2, sum(c) FROM q WHERE i = j UNION ALL SELECT 3, sum(q.c * c.c) FROM q JOIN c ON q.j = c.i AND q.i = c.j)
SELECT CAST(power AS INTEGER) AS power, round(s / t ** power, 8) AS total FROM p, t""")
def pca_spectrum(spark, sf_dir):
    """Sums of powers of all components' explained variances: traces of the covariance's powers, which SQL has, where it has no eigenvectors."""
    explained = pca.PCA(session(spark), 64).train(dataset(_vectors(spark, sf_dir))).explained_variance
    return rows(spark, "power int, total double", *[(k, round(float((explained**k).sum()), 8)) for k in (1, 2, 3)])


_WAVES = 4
_WAVE_SQL = ", ".join(f"round(list_sum(list_transform(range(64), lambda k: embedding[k + 1]::DOUBLE * sqrt(2 / 64) * cos(pi() * (k + 0.5) * {j + 1} / 64))), 8) + 0.0 AS p{j}" for j in range(_WAVES))


@query(f"SELECT vec_id, {_WAVE_SQL} FROM embeddings")
def pca_project(spark, sf_dir):
    """Whole vectors on fixed orthonormal components, since trained ones have any sign."""
    waves = np.sqrt(2 / 64) * np.cos(np.pi * (np.arange(64)[:, None] + 0.5) * (np.arange(_WAVES) + 1) / 64)
    out = pca.PCAModel(waves, np.full(_WAVES, 1 / _WAVES)).transform(_vectors(spark, sf_dir))
    return out.select("vec_id", *[(F.round(F.get("projection", F.lit(k)), 8) + 0.0).alias(f"p{k}") for k in range(_WAVES)])


@query()
def pca_explained(spark, sf_dir):
    """Explained variance of each component of whole vectors; SQL has no eigenvectors."""
    m = pca.PCA(session(spark), 64).train(dataset(_vectors(spark, sf_dir)))
    return rows(spark, "component int, explained double", *[(i, float(v)) for i, v in enumerate(m.explained_variance)])


# --- trainers of Spark ML ---------------------------------------------------------------------------------------------


@query()
def als_factors(spark, sf_dir):
    """Item factors; ratings are quantities that customers bought of parts."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ratings = i.join(o, i.l_orderkey == o.o_orderkey).select(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item"), (F.col("l_quantity") / 10).cast("float").alias("rating"))
    return wrappers.ALS(session(spark), rank=4, max_iterations=3).train(dataset(ratings)).itemFactors


@query()
def gbt_predict(spark, sf_dir):
    data = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", array_to_vector(F.array("l_quantity", "l_discount")).alias("features"), F.col("l_extendedprice").alias("label"))
    m = wrappers.GBT(session(spark), max_iter=3).train(dataset(data))
    return m.transform(data).select("l_orderkey", "l_linenumber", "prediction")


@query()
def lda_topics(spark, sf_dir):
    counts = _term_counts(spark, sf_dir)
    data = counts.select(array_to_vector(as_array(counts)).alias("features"), F.col("doc_id").alias("docId"))
    return wrappers.LDA(session(spark), 3, max_iter=3).train(dataset(data)).describeTopics(4)


# --- storage and crypto ------------------------------------------------------------------------------------------------


@query("SELECT * FROM orders")
def enc_roundtrip(spark, sf_dir):
    s, path = session(spark), shared_folder(spark)
    s.save_encrypted(table(spark, sf_dir, "orders"), path)
    return s.load_encrypted(path).data


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_orderkey < 100")
def enc_pruned_read(spark, sf_dir):
    """Two columns and a filter over a table of sorted files: the scan reads only these columns and skips the row groups that the filter rules out."""
    s, path = session(spark), shared_folder(spark)
    s.save_encrypted(table(spark, sf_dir, "lineitem").sort("l_orderkey"), path)
    wanted = StructType([StructField("l_orderkey", LongType()), StructField("l_extendedprice", DoubleType())])
    return s.load_encrypted(path, wanted).data.where("l_orderkey < 100")


@query("SELECT * FROM nation")
def enc_plain_read(spark, sf_dir):
    return session(spark).load_encrypted(f"{sf_dir}/nation.parquet").data


@query("SELECT r_regionkey, r_name FROM region")
def csv_ingest(spark, sf_dir):
    s, folder = session(spark), shared_folder(spark)
    table(spark, sf_dir, "region").write.option("header", True).csv(f"{folder}-csv")
    cli.encrypt_table(s, cli.parse_args([f"{folder}-csv", folder, "--format", "csv"]))
    return s.load_encrypted(folder).data


@query("SELECT doc_id, text FROM documents")
def aes_roundtrip(spark, sf_dir):
    """The documents after AES-GCM and back in the JVM, with the id as associated data. The key is made for this query and shown in its plan."""
    key, aad = F.lit(os.urandom(16)), F.col("doc_id").cast("string")
    sealed = table(spark, sf_dir, "documents").select("doc_id", F.aes_encrypt(F.col("text").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad).alias("blob"))
    return sealed.select("doc_id", F.aes_decrypt("blob", key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string").alias("text"))


@query("""SELECT * FROM (VALUES ('map of raw', false), ('shuffle of raw', false), ('union of statistic and raw', false), ('statistic', true), ('map of public', true), ('raw put in place of a statistic', false),
('undeclared join', false), ('undeclared subquery', false), ('sums, counts and moments', true), ('list of values', false), ('greatest name', false)) t(name, allowed)""")
def audit_decisions(spark, sf_dir):
    auditor, raw = LeakageAuditor(), Frame(table(spark, sf_dir, "customer"))
    stat = auditor.register_statistic_exchange(raw.derive(lambda d: d.groupBy("c_nationkey").count(), "statistic"))
    public = auditor.declare_public(Frame(table(spark, sf_dir, "nation")))
    cases = {
        "map of raw": raw.derive(lambda d: d.select("c_name")),
        "shuffle of raw": raw.group("c_nationkey"),
        "union of statistic and raw": stat.union(raw.derive(lambda d: d.select("c_nationkey", F.lit(1).cast("long").alias("count")))),
        "statistic": stat.derive(lambda d: d.select("count")),
        "map of public": public.derive(lambda d: d.select("n_name")),
        "raw put in place of a statistic": stat.derive(lambda _: raw.df),
        "undeclared join": public.derive(lambda d: d.join(raw.df, d.n_nationkey == raw.df.c_nationkey)),
        "undeclared subquery": public.derive(lambda d: d.withColumn("x", raw.df.agg(F.max("c_name")).scalar())),
    }
    statistics = {
        "sums, counts and moments": (F.sum("c_acctbal"), F.count(F.lit(1)), F.stddev("c_acctbal")),
        "list of values": (F.collect_list("c_name"),),
        "greatest name": (F.max("c_name"),),
    }

    def allowed(check):
        try:
            check()
        except LeakageError:
            return False
        return True

    s = session(spark, Mode.SML2)
    found = [(n, allowed(lambda f=f: auditor.check_untrusted(f))) for n, f in cases.items()]
    found += [(n, allowed(lambda c=c: s.statistic_agg(raw, *c))) for n, c in statistics.items()]
    return rows(spark, "name string, allowed boolean", *found)


@query("SELECT * FROM (VALUES ('sml1', 'SML1'), (' SML-1 ', 'SML1'), ('Baseline', 'SML1'), ('SML2', 'SML2'), ('sml-2', 'SML2'), ('partitioned', 'SML2'), ('other', NULL)) t(text, mode)")
def mode_parse(spark, sf_dir):
    def parsed(text):
        try:
            return Mode.parse(text).value
        except ValueError:
            return None

    return rows(spark, "text string, mode string", *[(t, parsed(t)) for t in ("sml1", " SML-1 ", "Baseline", "SML2", "sml-2", "partitioned", "other")])


@query("SELECT * FROM (VALUES ('a:AAAAAAAAAAAAAAAAAAAAAA==', 'a=16'), ('a:AAAAAAAAAAAAAAAAAAAAAA==,b:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA=', 'a=16 b=32'), ('a:AAAAAAA=', NULL), ('no-separator', NULL)) t(text, keys)")
def key_parse(spark, sf_dir):
    def parsed(text):
        try:
            return " ".join(f"{n}={len(k)}" for n, k in keystore.parse(text).items())
        except ValueError:
            return None

    one, two = "a:" + "A" * 22 + "==", "b:" + "A" * 43 + "="
    return rows(spark, "text string, keys string", *[(t, parsed(t)) for t in (one, f"{one},{two}", "a:AAAAAAA=", "no-separator")])
