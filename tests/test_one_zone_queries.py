"""Every query that a finding named as failing on a cluster without an enclave resource, through a store that only Spark reads."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

from sealfold import queries as own
from sealfold.sources import keystore
from tests.test_one_zone import HERE, RUN

#: Queries and the rows that they give where SQL has no counterpart.
NAMES = {
    "audit_decisions": None,
    "kmeans_lloyd2": None,
    "gbt_predict": "(SELECT count(*) FROM lineitem)",
    "kmeans_partials": None,
    "kmeans_train": "10",
    "linreg_ridge": None,
    "linreg_ols": None,
    "linreg_two": None,
    "logreg_loss_grad": None,
    "logreg_train": "1",
    "num_features_max": None,
    "pca_covariance": None,
    "pca_explained": "64",
    "pca_spectrum": None,
}


@pytest.fixture(scope="module")
def found(tmp_path_factory):
    top = tmp_path_factory.mktemp("zone")
    env = {k: v for k, v in os.environ.items() if k not in (keystore.ENVIRONMENT, keystore.FILE, keystore.LENT)} | {"PYTHONPATH": HERE, "PYSPARK_PYTHON": sys.executable}
    env |= {"SPARK_LOCAL_DIRS": str(top / "local")}
    done = subprocess.run([sys.executable, "-c", RUN, str(top), *NAMES], cwd=top, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return json.loads(done.stdout.strip().splitlines()[-1])


@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_cluster_without_enclaves(found, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    if name not in own.SQL:
        assert len(found[name]) == con.sql(f"SELECT {NAMES[name]}").fetchall()[0][0]
        return
    want = json.loads(json.dumps(con.sql(own.SQL[name]).to_arrow_table().to_pylist(), default=str))
    order = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert order(found[name]) == order(want)
