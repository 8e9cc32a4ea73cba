"""The session: a SparkSession with a placement mode, a master key and encrypted tables."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql.types import ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType

from sealfold.operators.statistic import statistic, statistic_agg
from sealfold.plans.audit import Frame
from sealfold.plans.modes import Mode
from sealfold.plans.zones import PREFIX, Partitioner
from sealfold.sources import aead, encrypted, keystore

log = logging.getLogger(__name__)
SAVE_MODES = ("errorifexists", "error", "overwrite", "append", "ignore")
_WIDER = [ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType]


@dataclass(frozen=True)
class Config:
    """mode None: what ``spark.sealfold.mode`` says, else SML2. one_zone: a cluster without an enclave resource will do.

    lend_key: a key that only this process has goes to the Python workers of this application in their environment, which
    Spark sends them with their tasks; without it a cluster's workers have only the keys they were provisioned with.
    """

    mode: Mode | None = None
    encryption_enabled: bool = True
    key_size: int = 128
    key_id: str = "sealfold-master"
    require_provisioned_key: bool = False
    one_zone: bool = False
    lend_key: bool = False


@dataclass(frozen=True)
class EncryptedDataset:
    """A frame that decrypts as it is read, and the id (never the bytes) of the session's master key."""

    data: DataFrame
    key_id: str


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns by name, upcast where that loses nothing; ValueError for missing or other columns."""

    def fits(have: DataType, want: DataType) -> bool:
        if have == want:
            return True
        kinds = [next((i for i, t in enumerate(_WIDER) if isinstance(x, t)), None) for x in (have, want)]
        # A long doesn't fit a float, nor an int.
        return None not in kinds and kinds[0] < kinds[1] and not (kinds[0] in (2, 3) and kinds[1] == 4) and not (kinds[0] == 3 and kinds[1] == 5)

    have = {f.name: f.dataType for f in df.schema}
    for f in schema:
        if f.name not in have:
            raise ValueError(f"no column {f.name!r} among {sorted(have)}")
        if not fits(have[f.name], f.dataType):
            raise ValueError(f"column {f.name!r} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df.select(*[df[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in schema])


class Session:
    """Wraps a SparkSession, which stays reachable as ``spark``."""

    def __init__(self, spark: SparkSession, config: Config | None = None, owned: bool = False):
        self.spark, self.config, self._owned = spark, config or Config(), owned
        self.mode = self.config.mode or Mode.parse(spark.conf.get(f"{PREFIX}.mode", "SML2"))
        self.partitioner = Partitioner(spark, self.mode, self.config.one_zone)
        self.key_id = self.config.key_id
        self._resolve_key()
        if self.config.lend_key and not self.partitioner.local and not keystore.provisioned(self.key_id):
            self._lend_key()
        if self.config.encryption_enabled:
            encrypted.register(spark)

    def _resolve_key(self) -> None:
        if keystore.get(self.key_id) is not None:
            return
        if self.config.require_provisioned_key:
            raise PermissionError(f"no master key {self.key_id!r}: set {keystore.ENVIRONMENT} or {keystore.FILE}")
        log.warning("no master key %s: using one that ends with this process", self.key_id)
        keystore.register(self.key_id, aead.generate_key(self.config.key_size))

    def _lend_key(self) -> None:
        env = self.spark.sparkContext.environment
        lent = keystore.parse(env.get(keystore.LENT, "")) | {self.key_id: keystore.get(self.key_id)}
        env[keystore.LENT] = ",".join(keystore.format_key(n, k) for n, k in lent.items())

    def _key_file(self) -> dict[str, str]:
        """Workers of a local master read registered keys from a file of this user; clusters provision their own."""
        return {"key_file": keystore.export_file()} if self.partitioner.local else {}

    def load_encrypted(self, path: str, schema: StructType | None = None) -> EncryptedDataset:
        """A table, encrypted or plain, with the schema's columns if one is given: only these are read."""
        path = encrypted.qualified(self.spark, path)
        if encrypted.is_encrypted(path, self.spark):
            options = self._key_file()
            stored = encrypted.stored_schema(path, options.get("key_file"))
            wanted = StructType([f for f in stored if schema is None or f.name in schema.names])
            df = self.spark.read.format(encrypted.NAME).schema(wanted).options(**options).load(path)
        else:
            df = self.spark.read.parquet(path)
        return EncryptedDataset(conform(df, schema) if schema else df, self.key_id)

    def save_encrypted(self, df: DataFrame, path: str, mode: str = "errorifexists") -> None:
        """Write a table, encrypted unless the configuration says otherwise."""
        mode = mode.lower()
        if mode not in SAVE_MODES:
            raise ValueError(f"unknown save mode {mode!r}: one of {', '.join(SAVE_MODES)}")
        if not self.config.encryption_enabled:
            df.write.mode(mode).parquet(path)
            return
        path = encrypted.qualified(self.spark, path)
        if mode in ("errorifexists", "error", "ignore"):
            fs, root = encrypted.filesystem(path)
            if fs.get_file_info(root).type != encrypted.pafs.FileType.NotFound:
                if mode == "ignore":
                    return
                raise FileExistsError(f"{path} exists")
            mode = "append"
        df.write.format(encrypted.NAME).mode(mode).option("key_id", self.key_id).options(**self._key_file()).save(path)

    def statistic(self, data: Frame | DataFrame, zero: Any, seq_op: Callable, comb_op: Callable, batches: bool = False) -> Any:
        return statistic(self.partitioner, data, zero, seq_op, comb_op, batches)

    def statistic_agg(self, data: Frame | DataFrame, *columns: Column) -> Row:
        return statistic_agg(self.partitioner, data, *columns)

    def close(self) -> None:
        """Stop Spark if this session started it."""
        if self._owned:
            self.spark.stop()


def create_session(spark: SparkSession | None = None, config: Config | None = None, app_name: str = "sealfold") -> Session:
    """A session on the given SparkSession, or on one it gets or creates with adaptive execution."""
    if spark is not None:
        return Session(spark, config)
    builder = SparkSession.builder.appName(app_name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    owned = SparkSession.getActiveSession() is None
    return Session(builder.getOrCreate(), config, owned)
