"""Feature columns: Spark's vectors or arrays of numbers, as arrays, matrices and column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_array(df: DataFrame, column: str = "features") -> Column:
    """The column as array<double>, whether it is a vector (dense or sparse) or an array."""
    return vector_to_array(F.col(column)) if isinstance(df.schema[column].dataType, VectorUDT) else F.col(column).cast("array<double>")


def with_arrays(df: DataFrame, column: str = "features", *others: str) -> DataFrame:
    """Only the feature column, as ``features`` array<double>, and the others."""
    return df.select(as_array(df, column).alias("features"), *others)


def num_features(session, df: DataFrame, column: str = "features") -> int:
    """The largest size of a feature vector; ValueError if there is none above 0."""
    row = session.statistic_agg(with_arrays(df, column), F.max(F.size("features")).alias("d"))
    if row["d"] is None or row["d"] <= 0:
        raise ValueError("empty training set")
    return row["d"]


def matrix(batch: pa.RecordBatch, d: int, column: str = "features") -> np.ndarray:
    """A batch's features as rows of d numbers; ValueError if a row is null or has another size."""
    a = batch.column(batch.schema.get_field_index(column))
    sizes = np.diff(a.offsets.to_numpy())
    if a.null_count or (sizes != d).any():
        raise ValueError(f"every feature vector must have {d} values")
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), d)


def numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.float64)


def add_in_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a, with b added to it element by element."""
    a += b
    return a


#: Terms that an expression may spell out, for generated code to hold them; models with more go through Arrow as matrix products.
UNROLLED = 64


def _rows(a: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of d numbers, whether each row is whole). Rows that are null or of another size, or hold a null, have no numbers."""
    a = a.cast(pa.list_(pa.float64()))
    whole = pc.fill_null(pc.equal(pc.list_value_length(a), d), False).to_numpy(zero_copy_only=False)
    x = a.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    full = np.full((len(a), d), np.nan)
    full[whole] = x
    return full, whole & ~np.isnan(full).any(axis=1)


def products(features: Column, weights: np.ndarray) -> Column:
    """The inner products of an array column with each row of weights, as array<double>; null for rows of another size."""
    weights = np.asarray(weights, np.float64)

    @F.arrow_udf("array<double>")
    def product(column: pa.Array) -> pa.Array:
        x, whole = _rows(column, weights.shape[1])
        out = x @ weights.T
        at = pa.array(np.arange(0, out.size + 1, len(weights)).astype(np.int32))
        return pa.ListArray.from_arrays(at, pa.array(out.ravel()), mask=pa.array(~whole))

    return product(features)


def dot(features: Column, weights: Sequence[float]) -> Column:
    """The inner product of an array column with fixed weights, one term after another."""
    if len(weights) > UNROLLED:
        return products(features, np.asarray(weights)[None])[0]
    terms = [F.get(features, i) * F.lit(float(w)) for i, w in enumerate(weights)]
    return reduce(lambda x, y: x + y, terms, F.lit(0.0))


def squared_distance(features: Column, point: Sequence[float]) -> Column:
    terms = [(F.get(features, i) - F.lit(float(p))) * (F.get(features, i) - F.lit(float(p))) for i, p in enumerate(point)]
    return reduce(lambda x, y: x + y, terms, F.lit(0.0))


def nearest(x: np.ndarray, points: np.ndarray, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest point, squared distance to it) of each row; of equally near ones the least index.

    A matrix product tells which points can be the nearest; where more than one can within rounding, differences decide.
    At most ``block`` numbers are held at once.
    """
    index, distance = np.zeros(len(x), np.int64), np.zeros(len(x))
    squares = (points**2).sum(1)
    step = max(1, block // max(1, len(points)))
    for first in range(0, len(x), step):
        part = x[first : first + step]
        own = (part**2).sum(1)
        rough = own[:, None] - 2 * (part @ points.T) + squares
        best = rough.argmin(1)
        slack = 1e-9 * (own + squares.max())
        for i in np.flatnonzero((rough <= (rough.min(1) + slack)[:, None]).sum(1) > 1):
            near = np.flatnonzero(rough[i] <= rough[i].min() + slack[i])
            best[i] = near[((points[near] - part[i]) ** 2).sum(1).argmin()]
        index[first : first + step] = best
        distance[first : first + step] = ((part - points[best]) ** 2).sum(1)
    return index, distance


def closest(features: Column, points: Sequence[Sequence[float]]) -> Column:
    """struct(distance, index) of the nearest point; of equally near ones the one with the least index."""
    table = np.asarray(points, np.float64)
    if table.size <= UNROLLED:
        return F.array_min(F.array(*[F.struct(squared_distance(features, p).alias("distance"), F.lit(i).alias("index")) for i, p in enumerate(table.tolist())]))

    @F.arrow_udf("distance double, index int")
    def found(column: pa.Array) -> pa.Array:
        x, whole = _rows(column, table.shape[1])
        index, distance = nearest(np.where(whole[:, None], x, 0.0), table)
        return pa.StructArray.from_arrays([pa.array(distance), pa.array(index.astype(np.int32))], ["distance", "index"], mask=pa.array(~whole))

    return found(features)


def sigmoid(m: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-m))


def softplus(m: Column) -> Column:
    """log(1 + exp(m)) without overflow."""
    return F.when(m > 0, m + F.log1p(F.exp(-m))).otherwise(F.log1p(F.exp(m)))
