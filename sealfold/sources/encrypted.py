"""Encrypted Parquet as a Spark data source, read and written by Arrow in the workers.

Every file is encrypted as a whole: footer, columns and page headers under one data key of its own, which the master key
wraps. Options carry the master key's id and, in local mode, the path of a key file; never a key. The Spark schema travels
in the footer, so Spark's own vectors come back as such.

A table is what its manifests list: each write commits by one manifest, which appears at once and names the new files and
the manifests it replaces; so a reader sees a table before or after a write, and appends at the same time both count. A
folder without manifests is what it holds. Files are read in splits of whole row groups, only the columns of the schema
asked for, and row groups whose statistics rule out a filter are skipped (Spark still applies the filter to rows).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sealfold.sources import kms

NAME, SCHEMA_KEY = "sealfold", b"sealfold.spark.schema"
PLAIN_MAGIC, ENCRYPTED_MAGIC = b"PAR1", b"PARE"


#: Bytes of a file that one task reads, and rows of a row group.
SPLIT_BYTES, GROUP_ROWS = 128 << 20, 1 << 20
MANIFEST = "_files-"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that Spark's default file system gives it, for workers to see the same place."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(made).toString()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def data_files(path: str) -> list[str]:
    """The table's Parquet files; hidden and unfinished ones are none."""
    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [root]
    if info.type == pafs.FileType.NotFound:
        return []
    found = {f.base_name: f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File}
    listed = manifests(path)
    gone = {n for m in listed.values() for n in m["replaces"]}
    names = [n for k, m in listed.items() if k not in gone for n in m["files"]] if listed else [n for n in found if not n.startswith(("_", "."))]
    return sorted(found[n] if n in found else f"{root.rstrip('/')}/{n}" for n in names)


def manifests(path: str) -> dict[str, dict[str, list[str]]]:
    """name -> manifest of each write: the files it added and the manifests it replaces."""
    fs, root = filesystem(path)
    info = fs.get_file_info(root)
    if info.type != pafs.FileType.Directory:
        return {}
    out = {}
    for f in fs.get_file_info(pafs.FileSelector(root)):
        if f.base_name.startswith(MANIFEST):
            with fs.open_input_file(f.path) as stream:
                out[f.base_name] = json.loads(stream.read())
    return out


def _magic(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a table's first file, by Spark's own file systems: some stores only Spark reads."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.listFiles(root, True)
    while found.hasNext():
        file = found.next().getPath()
        name = file.getName()
        if name.startswith("_part-") or not name.startswith(("_", ".")):
            stream = fs.open(file)
            try:
                return bytes(max(stream.read(), 0) for _ in range(4))
            finally:
                stream.close()
    return b""


def is_encrypted(path: str, spark: SparkSession | None = None) -> bool:
    """Whether a table's first file is encrypted, by its magic bytes. With ``spark``, paths that Arrow can't open are looked at by Spark's file systems."""
    try:
        fs, _ = filesystem(path)
    except (pa.ArrowInvalid, OSError):
        if spark is None or _magic(spark, path) == ENCRYPTED_MAGIC:  # workers read encrypted files by Arrow
            raise
        return False
    files = data_files(path)
    if not files:
        return False
    with fs.open_input_file(files[0]) as f:
        return f.read(4) == ENCRYPTED_MAGIC


def _open(fs: pafs.FileSystem, name: str, key_file: str | None, crypto=None) -> pq.ParquetFile:
    crypto = crypto or kms.factory()
    return pq.ParquetFile(fs.open_input_file(name), decryption_properties=crypto.file_decryption_properties(kms.connection(key_file)))


def stored_schema(path: str, key_file: str | None = None) -> StructType:
    """The Spark schema in the first file's footer; its key must be at hand."""
    fs, _ = filesystem(path)
    files = data_files(path)
    if not files:
        raise FileNotFoundError(f"{path} has no Parquet files")
    text = (_open(fs, files[0], key_file).schema_arrow.metadata or {}).get(SCHEMA_KEY)
    if text is None:
        raise ValueError(f"{path} was not written by this library: its footer has no Spark schema")
    return StructType.fromJson(json.loads(text))


@dataclass
class FilePartition(InputPartition):
    """The row groups of a file that begin in a range of its bytes."""

    name: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class EncryptedSource(DataSource):
    """Options: path, key_id (to write), key_file (local mode), overwrite by Spark's save mode."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return stored_schema(self.options["path"], self.options.get("key_file"))

    def reader(self, schema: StructType) -> EncryptedReader:
        return EncryptedReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> EncryptedWriter:
        return EncryptedWriter(schema, dict(self.options), overwrite)


#: Comparisons that a row group's statistics can rule out: (least, greatest, value) -> may some row hold it?
_MAY_HOLD = {
    EqualTo: lambda low, high, v: low <= v <= high,
    GreaterThan: lambda low, high, v: high > v,
    GreaterThanOrEqual: lambda low, high, v: high >= v,
    LessThan: lambda low, high, v: low < v,
    LessThanOrEqual: lambda low, high, v: low <= v,
    In: lambda low, high, v: any(low <= x <= high for x in v if x is not None),
}


def may_hold(group, columns: dict[str, int], filters: list[Filter]) -> bool:
    """Whether a row group's statistics leave room for rows that pass all filters; what can't be told is room."""
    for f in filters:
        test, at = _MAY_HOLD.get(type(f)), columns.get(".".join(f.attribute)) if hasattr(f, "attribute") else None
        if test is None or at is None:
            continue
        found = group.column(at).statistics
        if found is None or not found.has_min_max:
            continue
        try:
            if not test(found.min, found.max, f.value):
                return False
        except TypeError:  # values that don't compare with the stored ones
            continue
    return True


class EncryptedReader(DataSourceReader):
    """A task reads some row groups of a file, one batch after another."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.key_file = schema, options["path"], options.get("key_file")
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Row groups are skipped by filters; rows are not, so Spark keeps all of them."""
        self.filters = [f for f in filters if type(f) in _MAY_HOLD]
        return filters

    def partitions(self) -> list[FilePartition]:
        fs, _ = filesystem(self.path)
        files = data_files(self.path)
        sizes = [f.size for f in fs.get_file_info(files)] if files else []
        return [FilePartition(f, at, min(at + SPLIT_BYTES, size)) for f, size in zip(files, sizes, strict=True) for at in range(0, size, SPLIT_BYTES)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        target = to_arrow_schema(self.schema)
        file = _open(fs, partition.name, self.key_file)
        columns = {file.metadata.schema.column(i).path: i for i in range(file.metadata.num_columns)}
        groups, at = [], 4
        for i in range(file.num_row_groups):
            group = file.metadata.row_group(i)
            if partition.start <= at < partition.end and may_hold(group, columns, self.filters):
                groups.append(i)
            at += sum(group.column(c).total_compressed_size for c in range(group.num_columns))
        for batch in file.iter_batches(row_groups=groups, columns=self.schema.names) if groups else ():
            found = pa.Table.from_batches([batch]).select(target.names).cast(target)
            yield from found.to_batches()


class EncryptedWriter(DataSourceArrowWriter):
    """Tasks write files of names of their own into the table's folder; nothing reads them until commit lists them in a manifest. Abort drops them."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.path, self.overwrite = schema, options["path"], overwrite
        self.key_id, self.key_file = options["key_id"], options.get("key_file")
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        fs, root = filesystem(self.path)
        return fs, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = self._folder()
        fs.create_dir(folder, recursive=True)
        name = f"_part-{self.job}-{uuid.uuid4().hex}.parquet"  # hidden from listings: the manifest shows it
        schema = to_arrow_schema(self.schema).with_metadata({SCHEMA_KEY: self.schema.json().encode()})
        crypto = kms.factory()
        properties = crypto.file_encryption_properties(kms.connection(self.key_file), kms.write_options(self.key_id))
        with fs.open_output_stream(f"{folder}/{name}") as out, pq.ParquetWriter(out, schema, encryption_properties=properties) as file:
            held: list[pa.RecordBatch] = []
            for batch in iterator:
                held.append(batch)
                if sum(b.num_rows for b in held) >= GROUP_ROWS or sum(b.nbytes for b in held) >= SPLIT_BYTES:
                    file.write_table(pa.Table.from_batches(held).cast(schema))
                    held = []
            if held:
                file.write_table(pa.Table.from_batches(held).cast(schema))
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self._folder()
        fs.create_dir(root, recursive=True)
        names = [n for m in messages if m for n in m.names]
        before, held = manifests(self.path), data_files(self.path)
        replaced = list(before) if self.overwrite else []  # also those that others have replaced: none may come back
        unlisted = [] if before or self.overwrite else [f.rsplit("/", 1)[1] for f in held]
        old = held if self.overwrite else []
        made = f"{root}/.{MANIFEST}{self.job}"
        with fs.open_output_stream(made) as out:
            out.write(json.dumps({"files": [*unlisted, *names], "replaces": replaced}).encode())
        fs.move(made, f"{root}/{MANIFEST}{self.job}")  # from here on the write is there
        for name in [*old, *(f"{root}/{n}" for n in replaced)]:
            fs.delete_file(name)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = self._folder()
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(root)):
                if f.base_name.startswith(f"_part-{self.job}-"):
                    fs.delete_file(f.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EncryptedSource)
    spark.conf.set(PUSHDOWN, "true")  # Spark refuses readers that take filters without it
