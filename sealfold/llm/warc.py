"""WARC archives and Merkle fixity audits of their replicas.

Pages become WARC/1.0 resource records; records of one archive file stand in the order of their ids, and their offsets
follow from their lengths. A leaf hashes a record's offset, length and digest; a node hashes its at most 16 children in
order; above the files' trees the same goes on to one root. Both replicas' trees are built side by side, by the same numbers
of records and files, so they have one shape whatever either lacks; a branch that one of them lacks differs. An audit compares
roots and descends, level by level, only into branches whose hashes differ, so what it reads of the lower levels depends on the
damage and not on the archive.
Leaves of a stored replica are hashed from its bytes, by the ranges of the archive's index; archive files are rows of a
table (file, content) in the shared folder.

Defined results: a null url or html counts as empty; null ids go to files of their own, as many as they need, first; records
that repeat an id stand in one file, in the order of their digests; pages of any length are one record; a record that only one replica has is missing or extra in the other (what follows it in
its file has moved, so it is damaged too); an empty table gives an empty archive without a root; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealfold.llm.common import discard, drop_garbage, in_arrow, materialize

FILE_RECORDS, FAN_OUT = 1024, 16
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC record as text."""
    lines = [
        F.lit("WARC/1.0"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url), F.lit(f"WARC-Date: {DATE}"), F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), html, F.lit(_END))


#: Files of pages without an id have the numbers from here on.
NO_ID = -(2**62)


def records(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """page_id, file, n (place in the file), offset, length, record_sha256 and record of all pages."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    page_id = F.col("page_id").cast("long")
    spread = max(1, -(-pages.where(page_id.isNull()).count() // file_records))
    rows = pages.select(page_id.alias("page_id"), text("url").alias("url"), text("html").alias("html"))
    rows = rows.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    # Ordered by digest, not by content: where only the index is wanted, no content is shuffled.
    rows = rows.withColumns({"length": F.octet_length("record").cast("long"), "record_sha256": F.sha2(F.col("record").cast("binary"), 256)})
    without = F.lit(NO_ID) + F.pmod(F.xxhash64("record_sha256"), F.lit(spread))
    rows = rows.withColumn("file", F.coalesce(F.floor(F.col("page_id") / file_records), without).cast("long"))
    order = Window.partitionBy("file").orderBy("page_id", "record_sha256")
    rows = rows.withColumn("n", F.row_number().over(order).cast("long") - 1)
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.withColumn("offset", before).select("page_id", "file", "n", "offset", "length", "record_sha256", "record")


#: What an archive file's index says of each of its records.
_RANGE = "array<struct<n:bigint,offset:bigint,length:bigint,page_id:bigint>>"


def archive(found: DataFrame) -> DataFrame:
    """file, content (binary) and ranges: the archive files themselves, each of a bounded number of records, with their index beside them."""
    parts = found.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("n", "record", "offset", "length", "page_id"))).alias("parts"))
    ranges = F.transform("parts", lambda x: F.struct(x["n"].alias("n"), x["offset"].alias("offset"), x["length"].alias("length"), x["page_id"].alias("page_id")))
    return parts.select("file", F.array_join(F.transform("parts", lambda x: x["record"]), "").cast("binary").alias("content"), ranges.alias("ranges"))


def _with_ranges(files: DataFrame, index: DataFrame | None) -> DataFrame:
    """file, content and ranges: the ranges stored beside the files, or those of an index (see records()), which costs a shuffle of the contents."""
    if index is None:
        return files.select("file", "content", F.col("ranges").cast(_RANGE).alias("ranges"))
    ranges = index.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "length", "page_id"))).alias("ranges"))
    return files.select("file", "content").join(ranges, "file", "left").select("file", "content", F.col("ranges").cast(_RANGE).alias("ranges"))


_LENGTH = re.compile(rb"^content-length:\s*([0-9]+)\s*$", re.IGNORECASE | re.MULTILINE)
_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.MULTILINE)


def parse(content: bytes) -> list[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in lower case, body) of each record of an archive file."""
    at, out = 0, []
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at offset {at}")
        head = content[at:end]
        size = _LENGTH.search(head)
        if not size:
            raise ValueError(f"a record without Content-Length at offset {at}")
        body = content[end + 4 : end + 4 + int(size[1])]
        after = end + 4 + int(size[1]) + 4
        if len(body) < int(size[1]) or content[after - 4 : after] != b"\r\n\r\n":
            raise ValueError(f"a record cut short at offset {at}")
        out.append((at, after - at, {k.decode().lower(): v.decode() for k, v in _HEADER.findall(head)}, body))
        at = after
    return out


def read(files: DataFrame) -> DataFrame:
    """file, offset, length, type, uri and body (binary) of the records in archive files (file, content)."""
    names = ["file", "offset", "length", "type", "uri", "body"]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, at, n, head.get("warc-type"), head.get("warc-target-uri"), body) for at, n, head, body in parse(content or b"")]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return in_arrow(files.select("file", "content"), run, "file long, offset long, length long, type string, uri string, body binary")


# --- Merkle trees ----------------------------------------------------------------------------------------------------


def leaves(found: DataFrame) -> DataFrame:
    """file, node (place), hash of each record."""
    data = F.concat_ws(":", F.lit("leaf"), F.col("offset"), F.col("length"), F.col("record_sha256"))
    return found.select("file", F.col("n").alias("node"), F.sha2(data.cast("binary"), 256).alias("hash"))


def _above(nodes: DataFrame, at: str) -> DataFrame:
    """The nodes above, numbered by ``at``: each hashes its at most FAN_OUT children in order."""
    key = [c for c in nodes.columns if c not in (at, "hash")]
    children = F.sort_array(F.collect_list(F.struct(at, "hash")))
    hashed = F.sha2(F.concat(F.lit("node:"), F.array_join(F.transform("children", lambda x: F.concat(x[at].cast("string"), F.lit("="), x["hash"])), ",")).cast("binary"), 256)
    return nodes.withColumn("up", F.floor(F.col(at) / FAN_OUT)).groupBy(*key, "up").agg(children.alias("children")).select(*key, F.col("up").alias(at), hashed.alias("hash"))


def trees(replicas: list[DataFrame]) -> tuple[list[DataFrame], Column]:
    """(The levels of the replicas' trees, leaves first, each stored: replica, file, node (within a file) and hash, the last one with the roots; a file's own number).

    Above the files' roots, files are numbered from the least of all replicas on, those without ids before them; every level has both replicas' nodes.
    """
    found = [leaves(r).withColumn("replica", F.lit(i)) for i, r in enumerate(replicas)]
    levels = [materialize(functools.reduce(DataFrame.unionByName, found).select("replica", "file", "node", "hash"), "leaves")]
    numbered = F.col("file") > NO_ID // 2
    low, high, spare, top = levels[0].agg(F.min(F.when(numbered, F.col("file"))), F.max(F.when(numbered, F.col("file"))), F.max(F.when(~numbered, F.col("file") - NO_ID + 1)), F.max("node")).first()
    if top is None:
        return levels, F.col("file")
    low, high, spare = low or 0, high or low or 0, spare or 0
    while top:
        levels.append(materialize(_above(levels[-1], "node"), "nodes"))
        top //= FAN_OUT
    place = F.when(numbered, F.col("file") - low + spare).otherwise(F.col("file") - NO_ID)
    levels.append(levels[-1].select("replica", place.cast("long").alias("file"), "hash"))
    span = high - low + spare
    while span:
        levels.append(materialize(_above(levels[-1], "file"), "nodes"))
        span //= FAN_OUT
    return levels, F.when(F.col("file") >= spare, F.col("file") + low - spare).otherwise(F.col("file") + NO_ID).cast("long")


def _children(at: str):
    return F.explode(F.sequence(F.col(at) * FAN_OUT, F.col(at) * FAN_OUT + FAN_OUT - 1))


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """file, n, status of the records (see records()) that differ: changed, missing (in the other) or extra (there)."""
    levels, file_of = trees([one, other])
    side = lambda i: F.max(F.when(F.col("replica") == i, F.col("hash")))
    suspects = None
    for i in range(len(levels) - 1, -1, -1):
        level = levels[i]
        keys = [c for c in ("file", "node") if c in level.columns]
        both = (level if suspects is None else level.join(suspects, keys, "left_semi")).groupBy(*keys).agg(side(0).alias("ha"), side(1).alias("hb")).where("not (ha <=> hb)")
        if not i:
            break
        if "node" in keys:
            suspects = both.select("file", _children("node").alias("node"))
        elif "node" in levels[i - 1].columns:  # the files' own roots, which stand in the level below under the files' own numbers
            suspects = both.select(file_of.alias("file"), F.lit(0).cast("long").alias("node"))
        else:
            suspects = both.select(_children("file").alias("file"))
        suspects = materialize(suspects, "suspects")
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("changed")
    return both.select("file", F.col("node").alias("n"), status.alias("status"))


def stored(files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """file, n, offset, length, record_sha256 of a replica (file, content), hashed from its bytes by the ranges of an index (see records()) or those beside it.

    Headers are not looked at, so no damage is an error: what ends early has another length, and a range beyond the end
    has no record. Bytes after the last range, or in a file without any, count as one record more.
    """
    names = ["file", "n", "offset", "length", "record_sha256"]

    def run(batches):
        for batch in batches:
            for file, content, found in zip(*batch.columns, strict=True):
                data = memoryview(content.as_buffer() or b"")
                cuts = [(r["n"], r["offset"], r["length"]) for r in found.as_py() or ()]
                n, at = (cuts[-1][0] + 1, cuts[-1][1] + cuts[-1][2]) if cuts else (0, 0)
                parts = [(k, o, data[o : o + size]) for k, o, size in [*cuts, (n, at, len(data))] if o < len(data)]
                rows = [(file.as_py(), k, o, len(x), hashlib.sha256(x).hexdigest()) for k, o, x in parts]
                kinds = [pa.int64()] * 4 + [pa.string()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return in_arrow(_with_ranges(files, index), run, "file long, n long, offset long, length long, record_sha256 string")


def rotten(files: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """A replica (file, content, ranges) in which one byte of every 97th page's body is flipped where it lies: what the query's audit has to find."""
    rows = _with_ranges(files, index)

    def run(batches):
        for batch in batches:
            out = []
            for content, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = bytearray(content)
                for r in found or ():
                    if r["page_id"] is None or r["page_id"] % 97 != 5:
                        continue
                    at = content.index(b"\r\n\r\n", r["offset"]) + 4
                    size = r["offset"] + r["length"] - 4 - at
                    if size > 0:
                        data[at + r["page_id"] % size] ^= 1
                out.append(bytes(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["file", "content", "ranges"])

    return in_arrow(rows, run, f"file long, content binary, ranges {_RANGE}")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the pages' archive, and whether the audit of two stored replicas, read back byte by byte, finds the second one's damaged."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = materialize(records(pages).drop("record"), "records")
    first = materialize(archive(records(pages)), "warc")
    # Files of up to FILE_RECORDS pages are single values: Arrow gets few at a time.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        one = materialize(stored(first), "stored")
        # The shuffled contents, which are larger than a stored archive, go before the second one is stored. Spark holds on to those of its last job, so not before this one.
        drop_garbage(spark)
        second = materialize(rotten(first), "warc")
        discard(first)
        other = materialize(stored(second), "stored")
        discard(second)
    finally:
        spark.conf.set(key, before)
    found = audit(one, other).select("file", "n", F.lit(True).alias("damaged"))
    return index.join(found, ["file", "n"], "left").select("page_id", "file", "n", F.col("offset").alias("record_offset"), "length", "record_sha256", F.coalesce("damaged", F.lit(False)).alias("damaged"))


OP9_SQL = f"""
WITH p AS (SELECT page_id, page_id // {FILE_RECORDS} AS file, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
e AS (SELECT chr(13) || chr(10) AS nl),
w AS (
  SELECT page_id, file, html, 'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl || 'WARC-Target-URI: ' || url || nl
    || 'WARC-Date: {DATE}' || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' || octet_length(encode(html)) || nl || nl || html || nl || nl AS record
  FROM p, e
)
SELECT page_id, file, row_number() OVER f - 1 AS n,
  CAST(coalesce(sum(octet_length(encode(record))) OVER (PARTITION BY file ORDER BY page_id, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
  CAST(octet_length(encode(record)) AS BIGINT) AS length, sha256(record) AS record_sha256, page_id % 97 = 5 AND length(html) > 0 AS damaged
FROM w WINDOW f AS (PARTITION BY file ORDER BY page_id, sha256(record))
"""
