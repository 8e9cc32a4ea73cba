"""Exact deduplication by two Bloom passes, in DataFrame operations only.

Pass 1 hashes every normalised text and keeps, of a table of words with two bits a row, those that two or more rows share.
Pass 2 probes that table: a row whose bits are not repeated has a text of its own and passes straight through; only the
others are shuffled to their group. A false positive costs a shuffle of a digest, never a wrong result. The table has
about 16 bits a row at every size; beyond one shard's words it is probed shard by shard, each broadcast on its own.

Defined results: a null text counts as empty; a null id never wins against another; in ``deduplicate`` rows that
repeat both id and text leave one row; texts of any length are hashed whole; an empty table gives an empty table; other
columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealfold.llm.common import ascii_lower, bloom, discard, documents, drop_garbage, materialize, packed

#: A group is hot above this share of the rows; so there are at most 1 / HOT_SHARE hot groups, and they may be broadcast.
HOT_SHARE = 0.001


def digest(text):
    """SHA-256 of a text after lower-casing A-Z, as binary."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _joined_to_groups(rows: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """Rows with their group's columns by ``h``. Groups above the hot share are few and broadcast, so no task gets one whole."""
    most = max(1000, int(n * HOT_SHARE))
    hot = F.broadcast(groups.where(F.col("group_size") > most))
    rest = groups.where(F.col("group_size") <= most)
    return rows.join(hot, "h").unionByName(rows.join(hot.select("h"), "h", "left_anti").join(rest, "h"))


def group_rows(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of docs, dropped ones too."""
    base = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("h")), "digests")
    n = base.count()
    table = bloom(base, "h", n, times=2)
    probed = materialize(table.maybe(base, "h"), "probed")
    discard(base, table.words)
    maybe = probed.where("maybe").drop("maybe")
    groups = materialize(maybe.groupBy("h").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    repeated = _joined_to_groups(maybe, groups, n).select("doc_id", "keep_id", "group_size", "h")
    single = probed.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "h")
    return single.unionByName(repeated).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("h")).alias("text_sha256")
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Texts that can't be repeated are never shuffled."""
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("h"))
    base = materialize(rows.select("doc_id", "h"), "digests")
    drop_garbage(docs.sparkSession)
    table = bloom(base, "h", base.count(), times=2)
    found = (
        table.maybe(base, "h").where("maybe").groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("h").agg(F.max(F.struct("doc_id", "n")).alias("top"), F.sum("n").alias("group_size"))
        .select("h", F.col("top.doc_id").alias("doc_id"), F.col("top.n").alias("n_top"), "group_size")
    )
    # Rows are probed by the table of the texts that are known to be repeated, which is smaller and has no false positives of its own.
    groups = materialize(found.where("group_size > 1"), "groups")
    discard(base, table.words)
    drop_garbage(docs.sparkSession)
    probed = bloom(groups, "h", groups.count()).maybe(rows, "h")
    single = probed.where("not maybe").select("row")
    # Both sides are plain exchanges, so adaptive execution splits the rows of a hot group. What has no group is a false positive.
    known = groups.select("h", F.col("doc_id").alias("keep_id"), "n_top")
    stay = probed.where("maybe").join(known, "h", "left").where(F.col("n_top").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    again = F.coalesce(F.col("n_top") > 1, F.lit(False))
    return single.unionByName(stay.where(~again).select("row")).unionByName(stay.where(again).dropDuplicates(["h"]).select("row")).select("row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_rows(documents(spark, sf_dir))


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
