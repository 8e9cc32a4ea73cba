"""Every query with SQL has the SQL's rows, and the others give rows."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from sealfold import queries as own


def _rows(table, names):
    return sorted(map(repr, zip(*(table[n].to_pylist() for n in names), strict=True)))


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, sf_dir, database, name):
    got = own.QUERIES[name](spark, sf_dir).toArrow()
    assert got.num_rows
    if name in own.SQL:
        want = database.sql(own.SQL[name]).to_arrow_table()
        assert sorted(got.column_names) == sorted(want.column_names)
        assert _rows(got, sorted(got.column_names)) == _rows(want, sorted(got.column_names))


def test_whole_vectors(spark, sf_dir):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()], float)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = [r["explained"] for r in own.QUERIES["pca_explained"](spark, sf_dir).orderBy("component").collect()]
    assert got == pytest.approx((values / values.sum()).tolist(), abs=1e-9)
    c = x[:3]
    for _ in range(2):
        near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(3)])
    got = [r["value"] for r in own.QUERIES["kmeans_lloyd2"](spark, sf_dir).orderBy("cluster", "pos").collect()]
    assert np.allclose(got, c.ravel(), atol=1e-6)


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(own.QUERIES) <= set(__spark_entry__.queries())
