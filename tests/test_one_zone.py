"""Queries on a cluster that has no enclave resource: one zone, workers that were given no key, inputs in a store that only Spark reads."""

import json
import os
import subprocess
import sys

import pytest

from sealfold import queries as own
from sealfold.plans import zones
from sealfold.plans.modes import Mode
from sealfold.plans.zones import Partitioner
from sealfold.session import Config, Session
from sealfold.sources import keystore
from tests.test_plans import _Cluster

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

RUN = """
import json, sys
from pyspark.sql import SparkSession

top, names = sys.argv[1], sys.argv[2:]
conf = {
    "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "640m", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{top}/shared",
    "spark.sql.warehouse.dir": f"{top}/warehouse", "spark.hadoop.fs.viewfs.mounttable.store.link./in": "file:///root/testdata",
}
spark = SparkSession.builder.master("local-cluster[2,1,1200]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__

print(json.dumps({n: __spark_entry__.queries()[n](spark, "viewfs://store/in/sf0.001").toArrow().to_pylist() for n in names}, default=str))
spark.stop()
"""


def test_a_cluster_without_enclaves_is_one_zone_if_asked_for():
    p = Partitioner(_Cluster(), Mode.SML2, one_zone=True)
    assert p.one_zone and not p.local
    with pytest.raises(ValueError, match="enclave"):
        Partitioner(_Cluster(), Mode.SML2)
    amounts = {k.replace(".", "_"): "1" for k in zones.ENCLAVE_AMOUNTS}
    assert not Partitioner(_Cluster(**amounts, spark_dynamicAllocation_enabled="true"), Mode.SML2, one_zone=True).one_zone
    with pytest.raises(ValueError, match="enclave"):  # half a declaration is a mistake
        Partitioner(_Cluster(**dict(list(amounts.items())[:1])), Mode.SML2, one_zone=True)


def test_keys_are_lent_only_if_asked_for(monkeypatch):
    for config, lent in ((Config(encryption_enabled=False, one_zone=True), False), (Config(encryption_enabled=False, one_zone=True, lend_key=True), True)):
        cluster = _Cluster()
        cluster.environment = {}
        Session(cluster, config)
        assert (keystore.LENT in cluster.environment) is lent
    monkeypatch.setenv(keystore.LENT, cluster.environment[keystore.LENT])
    here = keystore._registered.pop(config.key_id)
    try:
        assert keystore.get(config.key_id) == here  # what a worker sees
        monkeypatch.setenv(keystore.ENVIRONMENT, keystore.format_key(config.key_id, b"p" * 16))
        assert keystore.get(config.key_id) == b"p" * 16
        cluster = _Cluster()
        cluster.environment = {}
        Session(cluster, config)
        assert not cluster.environment  # workers have been provisioned with it
    finally:
        keystore.register(config.key_id, here)


def test_queries_on_a_cluster_without_enclaves(tmp_path, sf_dir):
    names = ["stat_sum_count", "enc_roundtrip", "enc_plain_read", "csv_ingest"]
    env = {k: v for k, v in os.environ.items() if k not in (keystore.ENVIRONMENT, keystore.FILE, keystore.LENT)} | {"PYTHONPATH": HERE, "PYSPARK_PYTHON": sys.executable}
    env |= {"SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    import duckdb

    found, con = json.loads(done.stdout.strip().splitlines()[-1]), duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    for name in names:
        want = json.loads(json.dumps(con.sql(own.SQL[name]).to_arrow_table().to_pylist(), default=str))
        order = lambda rows: sorted(json.dumps(r, sort_keys=True) for r in rows)
        assert order(found[name]) == order(want), name


def test_word_buckets_are_counted_once_a_row(spark, sf_dir):
    plan = own._term_counts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 1 and "filter(" not in plan
    assert plan.index("Join") < plan.index("md5")  # the join moves counts, not texts
