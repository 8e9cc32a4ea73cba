"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A text is lower-cased and cut at ASCII white space; its shingles are its runs of five words (a shorter text is one
shingle, a text without words has none). The sketch is the k smallest distinct 64-bit hashes, ascending. Sketches of
parts merge by union, and k of them suffice to estimate resemblance, containment and the number of distinct shingles.

Defined results: a null text counts as empty; two empty sketches resemble each other with 1.0, an empty and another
with 0.0; rows that repeat a doc_id follow each other by descending text; a null doc_id comes last; an empty table
gives an empty table; one row is its own next row; texts of any length are sketched whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealfold.llm.common import SPACE, SPACE_PATTERN, documents, materialize

K, WORDS = 128, 5
#: Rows a bucket of neighbouring ids is meant to hold, and quantiles that one group of a range partition gives.
BUCKET_ROWS, QUANTILES = 1024, 64


def bound(value: Column, use) -> Column:
    """use(value) with value computed once: inside a lambda Spark would compute it again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k smallest distinct shingle hashes of a text, ascending, as array<bigint>."""

    def hashes(w: Column) -> Column:
        # The hash of an array is that of its elements in turn, without the array that slice() would build for each shingle.
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        return F.when(F.element_at(w, 1) == "", F.array().cast("array<bigint>")).when(F.size(w) < words, F.array(F.xxhash64(w))).otherwise(runs)

    clean = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE))
    return F.slice(F.sort_array(F.array_distinct(bound(F.split(clean, SPACE_PATTERN), hashes))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the merged sketch that both sides hold."""
    shared = lambda both: F.size(F.array_intersect(both, F.array_intersect(a, b))).cast("double") / F.greatest(F.size(both), F.lit(1)).cast("double")
    return F.when(a == b, F.lit(1.0)).otherwise(bound(merge(a, b, k), shared))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    j = resemblance(a, b, k)
    shared = j * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def to_text(a: Column) -> Column:
    """A sketch as 16 hexadecimal digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """docs with ``fingerprint``, its sketch as text, and ``n_distinct``, the estimate of its distinct shingles."""
    return docs.withColumn("__sketch", sketch(F.col("text"), k)).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("fingerprint", "n_distinct")], to_text(F.col("__sketch")).alias("fingerprint"), distinct_count(F.col("__sketch"), k).alias("n_distinct")
    )


def _steps(values: DataFrame, column: str) -> DataFrame:
    """One row: the distinct values of a column, descending, as ``steps`` (lists of about the square root of their number) and ``tops`` (the first of each)."""
    one = values.agg(F.sort_array(F.collect_set(column), False).alias("all"))
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("all"))).cast("int"))
    one = one.select("all", width.alias("width")).where("size(all) > 0")
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / F.col("width")).cast("int")), lambda i: F.slice("all", i * F.col("width") + 1, F.col("width")))
    return one.select("width", F.size("all").alias("filled"), steps.alias("steps")).withColumn("tops", F.transform("steps", lambda x: x[0]))


def _with_steps(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows with the one row of _steps(), as a scalar subquery that runs once."""
    value = steps.select(F.struct(*steps.columns)).scalar()
    return rows.withColumn("__steps", value).withColumns({c: F.col(f"__steps.{c}") for c in steps.columns}).drop("__steps")


def _bucket(key: Column) -> Column:
    """How many of the values in _steps() a key is not above, less one: two searches over short lists, whatever their number."""
    block = F.greatest(F.size(F.filter("tops", lambda t: t >= key)) - 1, F.lit(0))
    return block * F.col("width") + F.size(F.filter(F.element_at("steps", block + 1), lambda e: e >= key)) - 1


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, sketch and, of the next row by descending doc_id (of the first after the last), next_text and next_sketch.

    Ids are cut into buckets at approximate quantiles (any edges give the same result), so no window sees all rows; the
    first row of each bucket is also sent, as a copy, to the end of the bucket before. Each text is shuffled once. The
    edges, one number for every BUCKET_ROWS rows, are a single row that a scalar subquery reads; nothing is gathered on the driver.
    """
    least = -(2**63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("key"))
    wanted = max(1, -(-ids.count() // BUCKET_ROWS))
    ranges, marks = -(-wanted // QUANTILES), min(wanted, QUANTILES)
    shares = F.array(*[F.lit((i + 1) / marks) for i in range(marks)])
    parts = ids.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.percentile_approx("key", shares, 20 * marks).alias("marks"))
    rough = _steps(parts.select(F.explode("marks").alias("key")), "key")
    # The greatest id of each bucket; buckets are cut at these, so that none is empty and each one's first row is known.
    heads = _with_steps(ids, rough).groupBy(_bucket(F.col("key")).alias("b")).agg(F.max("key").alias("key"))
    edges = materialize(_steps(heads, "key"), "edges")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("key"))
    rows = _with_steps(rows, edges).withColumn("b", _bucket(F.col("key")))
    block = F.floor(F.col("b") / F.col("width")).cast("int")
    is_head = F.element_at(F.element_at("steps", block + 1), (F.col("b") - block * F.col("width") + 1).cast("int")) == F.col("key")
    own = F.struct(F.col("b"), F.lit(False).alias("copy"))
    copy = F.struct(F.pmod(F.col("b") - 1, F.col("filled")).alias("b"), F.lit(True).alias("copy"))
    rows = rows.withColumn("at", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own)))).select("doc_id", "key", "text", "at.b", "at.copy")
    rows = rows.repartition("b").withColumn("sketch", sketch(F.col("text"), k))
    order = Window.partitionBy("b").orderBy(F.col("copy"), F.col("key").desc(), F.col("text").desc())
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return rows.where("not copy").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited(text: Column, other: Column) -> Column:
    """The text with its last third of code points replaced by the first as many (or all) of another."""
    n = F.char_length(text)
    m = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - m), F.substring(other, F.lit(1), m))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(documents(spark, sf_dir)).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        to_text(F.col("sketch")).alias("fingerprint"),
        to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
