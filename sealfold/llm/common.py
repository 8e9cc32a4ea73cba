"""Helpers shared by the training-data operators: shared storage, row packing and text normalisation."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The ASCII white space that separates words.
SPACE = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares. ``spark.checkpoint.dir`` names it; only a local master may lack it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():  # the setting itself can't be changed once Spark runs
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(dir="/tmp/checkpoints"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write a frame to the shared folder, in a folder for each value of ``by``, and read it back: lineage ends at files that outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    trim(df.sparkSession)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    for made in _collected:
        made.append(stored)
    return stored


_collected: list[list[DataFrame]] = []


@contextlib.contextmanager
def leftovers() -> Iterator[list[DataFrame]]:
    """The tables that materialize() writes meanwhile, for the caller to discard once what it wanted of them is stored."""
    made: list[DataFrame] = []
    _collected.append(made)
    try:
        yield made
    finally:
        _collected[:] = [x for x in _collected if x is not made]


def discard(*stored: DataFrame) -> None:
    """Delete tables that materialize() wrote and nothing reads any more: what followed from them is stored itself."""
    for df in stored:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows and bytes an Arrow batch may hold. Texts are long, and both the JVM and Python hold whole batches.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small; a session that asks for still smaller ones keeps them.

    Spark reads these settings when a plan runs, not when it is made, so they stay set in the caller's session.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))


def give_back() -> None:
    """Return memory that this Python process has freed to the machine: workers live on, and wait with what a task once needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, after which the worker gives back the memory that the task has freed."""

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(tidy, schema)


def trim(spark: SparkSession) -> bool:
    """Return memory that the driver's JVM has freed outside its heap to the machine; False for a JVM that can't.

    Compilers and hundreds of Spark's threads allocate there, each from an arena of the C library, which keeps what was freed.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        values = array(jvm.Object, 4)  # by reflection on the interface: the server's own class is not open to callers
        values[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        values[1], values[2], values[3] = "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0)
        found = [m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"]
        found[0].invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # an older JVM, or another one
        return False
    return True


def drop_garbage(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files, broadcasts and generated classes of finished steps: it does so when the driver's JVM collects."""
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that columns an operator adds can't clash with columns it carries."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def with_rows(df: DataFrame) -> DataFrame:
    """One column ``row`` with all columns of df, text as a string: a text goes to Python once, inside its row."""
    return df.withColumn("text", F.col("text").cast("string")).select(packed(df).alias("row"))


def row_texts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.StructArray, list[str]]]:
    """Slices of with_rows() and their texts (null: empty), a few rows at a time to bound Python's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.column(0).slice(at, rows)
            yield part, [x or "" for x in part.field("text").to_pylist()]


def replaced(part: pa.StructArray, **new: pa.Array) -> pa.StructArray:
    """Rows with other values in some of their fields."""
    kinds = [part.type.field(i) for i in range(part.type.num_fields)]
    return pa.StructArray.from_arrays([new.get(k.name, part.field(i)) for i, k in enumerate(kinds)], fields=kinds)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Where all is ASCII, lower() does just that and is faster than translate()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Keys a word of 64 bits is meant for, and words a shard of a Bloom table may have: what is broadcast at once is bounded by these.
WORD_KEYS, SHARD_WORDS = 4, 2**21
#: Folders that rows are dealt to by their shards, and shards that are probed by one job.
FOLDERS, SHARDS_A_JOB = 64, 16


@dataclass(frozen=True)
class Bloom:
    """A blocked Bloom table in shards by hash: a key has one word of its shard and two bits in it. The number of shards grows with the keys."""

    words: DataFrame
    shards: int
    size: int

    def place(self, key: Column) -> tuple[Column, Column, Column, Column]:
        """shard, word and the two bits of a key."""
        h = F.xxhash64(key)
        shard = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(self.shards)).cast("int")
        return shard, h.bitwiseAND(F.lit(self.size - 1)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)), F.shiftrightunsigned(h, 46).bitwiseAND(F.lit(63))

    def maybe(self, rows: DataFrame, column: str) -> DataFrame:
        """rows with ``maybe``: whether both bits of the key in ``column`` are set. Each shard is broadcast on its own, so no row is shuffled.

        Rows of several shards are dealt to folders first, by a write without a shuffle; each job reads its shards' folders.
        """
        shard, word, one, two = self.place(F.col(column))
        mask = "shiftleft(1L, cast(__one as int)) | shiftleft(1L, cast(__two as int))"
        placed = rows.withColumns({"__shard": shard, "__word": word, "__one": one, "__two": two})
        extra = ["__shard", "__word", "__one", "__two", "__w", "__bits"]

        def probed(part: DataFrame, words: DataFrame) -> DataFrame:
            table = F.broadcast(words.select(F.col("word").alias("__w"), F.col("bits").alias("__bits")))
            return part.join(table, F.col("__word") == F.col("__w"), "left").withColumn("maybe", F.expr(f"coalesce((__bits & ({mask})) = ({mask}), false)")).drop(*extra)

        if self.shards == 1:
            return probed(placed, self.words)
        dealt = materialize(placed.withColumn("__folder", F.col("__shard") % FOLDERS), "dealt", by="__folder")
        jobs = []
        for first in range(0, self.shards, SHARDS_A_JOB):
            own = range(first, min(first + SHARDS_A_JOB, self.shards))
            parts = [probed(dealt.where((F.col("__folder") == s % FOLDERS) & (F.col("__shard") == s)).drop("__folder"), self.words.where(F.col("shard") == s)) for s in own]
            jobs.append(materialize(functools.reduce(DataFrame.unionByName, parts), "probed"))
        discard(dealt)
        return rows.sparkSession.read.schema(jobs[0].schema).parquet(*[j._stored_at for j in jobs])


def bloom(keys: DataFrame, column: str, n: int, times: int = 1) -> Bloom:
    """The table of the keys in ``column``, n rows, or of those whose word and bits at least so many rows share. A row is one number in the shuffle."""
    words, size = max(1, n // WORD_KEYS), 2**10
    while size < min(words, SHARD_WORDS):
        size *= 2
    table = Bloom(keys, max(1, -(-words // SHARD_WORDS)), size)
    shard, word, one, two = table.place(F.col(column))
    slot = keys.select(F.shiftleft(shard.cast("long"), 40).bitwiseOR(F.shiftleft(word, 12)).bitwiseOR(F.shiftleft(one, 6)).bitwiseOR(two).alias("slot"))
    if times > 1:
        slot = slot.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)
    bits = F.expr("shiftleft(1L, cast((slot >> 6) & 63 as int)) | shiftleft(1L, cast(slot & 63 as int))")
    of = slot.select(F.shiftright("slot", 40).cast("int").alias("shard"), F.shiftright("slot", 12).bitwiseAND(F.lit(2**28 - 1)).alias("word"), bits.alias("bits"))
    found = of.groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    return Bloom(materialize(found, "bloom"), table.shards, table.size)
