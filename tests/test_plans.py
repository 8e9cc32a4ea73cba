"""Modes, the leakage audit, placements and the statistic."""

from functools import reduce

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sealfold.functions.vectors import add_in_place, num_features
from sealfold.operators.statistic import partition_count
from sealfold.plans import zones
from sealfold.plans.audit import Frame, LeakageAuditor, LeakageError
from sealfold.plans.modes import Mode
from sealfold.plans.zones import Partitioner
from sealfold.session import Config, create_session


@pytest.mark.parametrize(("text", "mode"), [("sml1", Mode.SML1), (" SML-1", Mode.SML1), ("BaseLine", Mode.SML1), ("SML2", Mode.SML2), ("sml-2\n", Mode.SML2), ("partitioned", Mode.SML2)])
def test_mode_names(text, mode):
    assert Mode.parse(text) is mode


def test_unknown_mode():
    with pytest.raises(ValueError, match="unknown mode"):
        Mode.parse("SML3")


def test_mode_resolution(spark):
    assert create_session(spark).mode is Mode.SML2
    spark.conf.set("spark.sealfold.mode", "baseline")
    try:
        assert create_session(spark).mode is Mode.SML1
        assert create_session(spark, Config(mode=Mode.SML2)).mode is Mode.SML2
    finally:
        spark.conf.unset("spark.sealfold.mode")


def _add(total, row):
    total[0] += row["id"]
    total[1] += 1
    return total


def _merge(a, b):
    return [x + y for x, y in zip(a, b, strict=True)]


def test_mutable_zero_over_seven_partitions(spark):
    data = spark.range(1, 1001, numPartitions=7)
    zero = [0, 0]
    assert create_session(spark).statistic(data, zero, _add, _merge) == [500500, 1000]
    assert zero == [0, 0]


@pytest.mark.parametrize(("mode", "placed"), [(Mode.SML2, 1), (Mode.SML1, 0)])
def test_modes_agree_and_differ_in_placements(spark, mode, placed):
    s = create_session(spark, Config(mode=mode))
    assert s.statistic(spark.range(1, 101, numPartitions=4), 0, lambda v, r: v + r["id"], lambda a, b: a + b) == 5050
    assert s.partitioner.untrusted_placements == placed


def test_statistic_over_empty_partitions(spark):
    data = spark.range(1, 5, numPartitions=9).where("id > 2")
    assert create_session(spark).statistic(data, [0, 0], _add, _merge) == [7, 2]
    assert create_session(spark).statistic(data.where("id > 9"), [0, 0], _add, _merge) == [0, 0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1000, 1000), max_size=30), st.integers(1, 9))
def test_statistic_is_a_plain_fold(spark, values, parts):
    data = spark.createDataFrame([(v,) for v in values], "id long").repartition(parts)
    expected = reduce(lambda a, v: [a[0] + v, a[1] + 1], values, [0, 0])
    assert create_session(spark).statistic(data, [0, 0], _add, _merge) == expected


def _raw(spark):
    return Frame(spark.createDataFrame([("alice", 1.0), ("bob", 2.0)], "name string, value double"))


def _statistic(auditor, raw):
    return auditor.register_statistic_exchange(raw.derive(lambda d: d.groupBy("name").agg(F.sum("value").alias("value")), "statistic"))


def test_audit_rejects_raw_data(spark):
    p, raw = Partitioner(spark, Mode.SML2), _raw(spark)
    for frame in (raw, raw.df, raw.derive(lambda d: d.select("value")), raw.group("name"), _statistic(p.auditor, raw).union(raw)):
        with pytest.raises(LeakageError, match="raw data"):
            p.untrusted(frame)
    assert p.untrusted_placements == 0


def test_audit_accepts_statistics_and_public_frames(spark):
    p, raw = Partitioner(spark, Mode.SML2), _raw(spark)
    p.untrusted(_statistic(p.auditor, raw).derive(lambda d: d.select("value")))
    public = p.auditor.declare_public(Frame(spark.range(1, 11)))
    assert p.untrusted(public.derive(lambda d: d.select((F.col("id") * 2).alias("x")))).df.agg(F.sum("x")).first()[0] == 110
    assert p.untrusted_placements == 2


def test_plans_are_held_against_what_frames_name(spark):
    p, raw = Partitioner(spark, Mode.SML2), _raw(spark)
    stat = _statistic(p.auditor, raw)
    public = p.auditor.declare_public(Frame(spark.range(1, 11)))
    hidden = [
        stat.derive(lambda _: raw.df),
        public.derive(lambda d: d.crossJoin(raw.df)),
        public.derive(lambda d: d.withColumn("x", raw.df.agg(F.max("name")).scalar())),
        Frame(raw.df, "faked", (public,)),
        Frame(raw.df.select("name"), "faked", (stat, public)),
    ]
    for frame in hidden:
        with pytest.raises(LeakageError, match="besides what it derives from"):
            p.untrusted(frame)
    both = stat.derive(lambda d: d.join(public.df, d.value == public.df.id), others=[public])
    p.untrusted(both.derive(lambda d: d.groupBy("id").count()))
    p.untrusted(stat.derive(lambda d: d.alias("a").join(d.alias("b"), "name")))  # with itself


@pytest.mark.parametrize("column", ["collect_list(value)", "collect_set(name)", "max(name)", "first(value)", "max_by(value, value)", "array_agg(value)", "struct(sum(value), min(name))"])
def test_only_statistics_leave_as_aggregates(spark, column):
    column = F.expr(column)
    s = create_session(spark, Config(mode=Mode.SML2))
    with pytest.raises(LeakageError):
        s.statistic_agg(_raw(spark), column.alias("x"))
    assert s.partitioner.untrusted_placements == 0
    assert s.statistic_agg(_raw(spark), F.sum("value").alias("x"), (F.avg("value") * 2).alias("y")).asDict() == {"x": 3.0, "y": 3.0}
    create_session(spark, Config(mode=Mode.SML1)).statistic_agg(_raw(spark), column.alias("x"))  # nothing leaves the enclave zone


def test_a_statistic_of_one_auditor_is_none_of_another(spark):
    frame = _statistic(LeakageAuditor(), _raw(spark))
    with pytest.raises(LeakageError):
        LeakageAuditor().check_untrusted(frame)


def test_only_enclave_mode_skips_the_audit(spark):
    p = Partitioner(spark, Mode.SML1)
    assert p.untrusted(_raw(spark)).df.count() == 2
    assert p.untrusted_placements == 0


class _Cluster:
    """A SparkSession's configuration, without a cluster."""

    def __init__(self, **conf):
        self.sparkContext, self.master, self.conf = self, "spark://host:7077", conf

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.conf.get(key.replace(".", "_"), default)


def test_cluster_configuration_is_checked():
    amounts = {k.replace(".", "_"): "1" for k in zones.ENCLAVE_AMOUNTS}
    with pytest.raises(ValueError, match="enclave"):
        Partitioner(_Cluster(), Mode.SML1)
    Partitioner(_Cluster(**amounts), Mode.SML1)
    with pytest.raises(ValueError, match="dynamicAllocation"):
        Partitioner(_Cluster(**amounts), Mode.SML2)
    Partitioner(_Cluster(**amounts, spark_dynamicAllocation_enabled="true"), Mode.SML2)


def test_num_features(spark):
    s = create_session(spark)
    assert num_features(s, spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "features array<double>")) == 2
    for rows in ([], [([],)]):
        with pytest.raises(ValueError, match="empty training set"):
            num_features(s, spark.createDataFrame(rows, "features array<double>"))


def test_add_in_place():
    a = np.array([1.0, 2.0])
    assert add_in_place(a, np.array([3.0, 4.0])) is a
    assert a.tolist() == [4.0, 6.0]


def test_partition_count(spark):
    assert partition_count(spark.range(9, numPartitions=7)) == 7
    small = F.broadcast(spark.range(3, numPartitions=2).withColumnRenamed("id", "other"))
    assert partition_count(spark.range(9, numPartitions=7).join(small, F.col("id") == F.col("other"))) == 7  # a broadcast moves no rows
    assert partition_count(spark.range(9).groupBy("id").count()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
