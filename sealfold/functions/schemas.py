"""Schemas of the records that trainers take, for ``session.load_encrypted(path, schema)``."""

from pyspark.ml.linalg import VectorUDT
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructField, StructType


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


CLASSIFICATION = REGRESSION = TRAINING = _schema(features=VectorUDT(), label=DoubleType())
CLUSTERING = PCA = _schema(features=VectorUDT(), id=LongType())
TOPICS = _schema(features=VectorUDT(), docId=LongType())
RECOMMENDATION = _schema(user=IntegerType(), item=IntegerType(), rating=FloatType())
