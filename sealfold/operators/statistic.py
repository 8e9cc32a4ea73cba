"""``statistic``: a two-level distributed fold, and the only way out of the enclave zone.

Each partition folds its rows to exactly one value, partition i's value goes to group i mod f with f = ceil(sqrt(P)), each
group is combined, and the driver folds the f results. Where the fold is made of sums, counts, minima and maxima, use
``statistic_agg``: Spark's partial and final aggregates are that same tree and stay in the JVM.
"""

from __future__ import annotations

import copy
import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row

from sealfold.plans.audit import Frame, LeakageError, as_frame
from sealfold.plans.modes import Mode
from sealfold.plans.zones import Partitioner


def _rows(batch: pa.RecordBatch) -> Iterator[Row]:
    make = Row(*batch.schema.names)
    for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        yield make(*values)


def partition_count(df: DataFrame) -> int:
    """The partitions a frame will have. Behind a shuffle it is the configured number, for to ask Spark would run the stages before."""
    stack = [df._jdf.queryExecution().sparkPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name.startswith("InMemory"):
            continue  # stored partitions are known
        if name == "Exchange" or "SortMergeJoin" in name or "ShuffledHashJoin" in name or "Aggregate" in name or name == "Window":
            return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return df.rdd.getNumPartitions()


def statistic(partitioner: Partitioner, data: Frame | DataFrame, zero: Any, seq_op: Callable, comb_op: Callable, batches: bool = False) -> Any:
    """Fold rows: seq_op(value, row) in partitions, comb_op(value, value) between them.

    ``zero`` must be neutral for comb_op, which must be associative and commutative. Every partition starts from a copy of
    its own, so seq_op may change it. ``batches`` hands Arrow batches instead of rows to seq_op. Spark's own vectors come as
    structs in Arrow: turn them into arrays first.
    """
    frame = as_frame(data)
    source = frame.df
    fan_in = max(1, math.ceil(math.sqrt(partition_count(source))))
    frozen = pickle.dumps(zero)

    def fold(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = pickle.loads(frozen)
        for batch in found:
            if batches:
                value = seq_op(value, batch) if batch.num_rows else value
            else:
                for row in _rows(batch):
                    value = seq_op(value, row)
        key = TaskContext.get().partitionId() % fan_in
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([pickle.dumps(value)], pa.binary())], ["key", "value"])

    def combine(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = pickle.loads(frozen)
        for batch in found:
            for part in batch.column(1).to_pylist():
                value = comb_op(value, pickle.loads(part))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(value)], pa.binary())], ["value"])

    partials = frame.derive(lambda d: d.mapInArrow(fold, "key int, value binary").repartition(fan_in, "key"), "statistic")
    placed = partitioner.untrusted(partitioner.auditor.register_statistic_exchange(partials))
    out = placed.df.mapInArrow(combine, "value binary")
    result = copy.deepcopy(zero)
    for row in out.collect():  # fan_in values
        result = comb_op(result, pickle.loads(row["value"]))
    return result


#: Aggregates that give a number of bounded size, whatever the rows. Fixed values.
STATISTICS = frozenset("Sum Count Min Max Average StddevSamp StddevPop VarianceSamp VariancePop Skewness Kurtosis Corr CovPopulation CovSample CentralMomentAgg TrySum TryAverage".split())


def _check_statistics(df: DataFrame) -> None:
    """LeakageError unless the frame's own aggregate is made of sums, counts, extremes, means and moments of numbers."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() == "Project" and plan.children().size() == 1:
        plan = plan.children().apply(0)
    if plan.nodeName() != "Aggregate" or plan.groupingExpressions().size():
        raise LeakageError(f"{plan.nodeName()} is no statistic")
    stack = [plan.aggregateExpressions().apply(i) for i in range(plan.aggregateExpressions().size())]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AggregateExpression":
            function = node.aggregateFunction()
            name, kind = function.getClass().getSimpleName(), function.dataType().typeName()
            if name not in STATISTICS or kind in ("string", "binary", "array", "map", "struct"):
                raise LeakageError(f"{function.prettyName()} gives {kind} out of rows: sums, counts, extremes, means and moments of numbers are statistics")
            continue
        stack += [node.children().apply(i) for i in range(node.children().size())]


def statistic_agg(partitioner: Partitioner, data: Frame | DataFrame, *columns: Column) -> Row:
    """One row of built-in aggregates that are statistics; LeakageError for others, such as lists of values.

    Their exchange carries one partial row a partition, so it counts as a statistic, and the final aggregate is what is placed.
    """
    frame = as_frame(data)
    if partitioner.mode is Mode.SML2:
        _check_statistics(frame.df.agg(*columns))
    out = partitioner.auditor.register_statistic_exchange(frame.derive(lambda d: d.agg(*columns), "statistic"))
    return partitioner.untrusted(out).df.first()

