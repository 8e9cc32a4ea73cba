"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams, one model a language.

The model is trained on trusted text: all documents labelled good, but for a fifth that is held out. Documents travel in
compressed blocks. Each block gives its trusted n-gram counts and the n-grams it has; counts are summed and joined as
tables sharded by language and n-gram, never gathered; each block gets back the probabilities of its own n-grams and
scores its documents. A document is kept if its perplexity lies between two quantiles of its language's held-out trusted
documents. A language's quantiles are drawn towards those of all languages together as if by POOLED documents more, so their
weight falls smoothly as the language grows; a language without held-out trusted documents takes the common ones.

Defined results: a null or empty text is the end of text alone; a language (or null language) without trusted text is
scored by the uniform model; without held-out trusted text at all everything is kept; labels of null or unknown documents
are ignored, and of several labels for one id the least counts; rows that repeat an id are scored each; texts of any length are
counted and scored whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealfold.llm.common import documents, in_arrow, materialize
from sealfold.llm.token_counts import texts

ORDER = 4
#: Documents a block is meant to hold, and bytes of text that are compressed together.
BLOCK_ROWS, BLOB_BYTES = 8000, 1 << 18
QUANTILES = (0.0005, 0.995)
#: The weight of all languages' quantiles in a language's own, in held-out trusted documents.
POOLED = 10
#: Languages whose discounts are broadcast.
MOST_BROADCAST = 10_000
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_END = 10


def text_grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts, number of them in each text): each byte and the end mark, in their contexts."""
    front, end = bytes([_END]) * (ORDER - 1), bytes([_END])
    data = _LOWER[np.frombuffer(b"".join(x for t in found for x in (front, t, end)), np.uint8)]
    sizes = np.array([len(t) + 1 for t in found], np.int64)
    last = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(found) + 1) * (ORDER - 1), sizes)
    run = np.zeros(len(last), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        run = run << np.uint64(8) | data[last - k]
    return run.view(np.int64), sizes


def blobs(docs: DataFrame, blocks: int) -> DataFrame:
    """block and blob: documents as compressed lists of (doc_id, lang, text), dealt to blocks by a hash of their id."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        open_rows, sizes = defaultdict(list), defaultdict(int)

        def row(block):
            blob = pack.compress(pickle.dumps(open_rows.pop(block), protocol=5))
            sizes.pop(block)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([blob], pa.binary())], ["block", "blob"])

        for part, found in texts(batches):
            for i, block, lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), found, strict=True):
                open_rows[block].append((i, lang, t.encode()))
                sizes[block] += len(t)
                if sizes[block] > BLOB_BYTES:
                    yield row(block)
        for block in list(open_rows):
            yield row(block)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "block int, blob binary")


def _unpacked(blob: bytes) -> list[tuple[int | None, str | None, bytes]]:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _by_block(small: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of both by block, those of ``small`` first, for a task that streams over them."""
    rows = small.withColumn("kind", F.lit(0)).unionByName(large.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", "kind")


def _rows(batches):
    """(is the block new, column name -> value) of each blob, and arrays of the rows before it."""
    for batch in batches:
        names = batch.schema.names
        kinds = np.asarray(batch.column(names.index("kind")))
        blocks = np.asarray(batch.column(names.index("block")))
        cuts = np.flatnonzero(np.concatenate([[True], (kinds[1:] != kinds[:-1]) | (blocks[1:] != blocks[:-1])])) if len(kinds) else []
        for s, e in zip(cuts, [*cuts[1:], len(kinds)], strict=True):
            yield int(blocks[s]), int(kinds[s]), batch.slice(s, e - s)


def counted(docs: DataFrame, trusted: DataFrame, blocks: int) -> DataFrame:
    """block, lang, gram, c: the n-grams of each block's documents by language, and how often its trusted documents have them."""

    def run(batches):
        ids: set[int] = set()
        seen: dict = {}
        now = None

        def add(lang, found, weight):
            g, n = np.unique(text_grams(found)[0], return_counts=True)
            seen.setdefault(lang, []).append((g, n * weight))
            if sum(len(x[0]) for x in seen[lang]) > 1_000_000:
                seen[lang] = [merged(seen[lang])]

        def merged(parts):
            g, where = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            return g, np.bincount(where, weights=np.concatenate([x[1] for x in parts]), minlength=len(g)).astype(np.int64)

        def flush():
            for lang, parts in seen.items():
                g, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), now, np.int32)), pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["block", "lang", "gram", "c"])

        for block, kind, part in _rows(batches):
            if block != now:
                if now is not None:
                    yield from flush()
                now, ids, seen = block, set(), {}
            if kind == 0:
                ids.update(part.column(part.schema.get_field_index("doc_id")).to_pylist())
                continue
            for blob in part.column(part.schema.get_field_index("blob")).to_pylist():
                groups: dict = defaultdict(list)
                for i, lang, t in _unpacked(blob):
                    groups[lang, i in ids].append(t)
                for (lang, good), found in groups.items():
                    add(lang, found, int(good))
        if now is not None:
            yield from flush()

    own = trusted.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id")
    return in_arrow(_by_block(own, blobs(docs, blocks)).select("block", "kind", "doc_id", "blob"), run, "block int, lang string, gram long, c long")


def probabilities(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """lang, gram, p for the n-grams in ``wanted`` under the model that ``counts`` (lang, gram, c > 0) trains."""
    suffix = lambda k: F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
    table, tables = counts, {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # how many letters go before: continuation counts
        table = tables[k] = table.groupBy("lang", suffix(k).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    # Discounts are a row a language; beyond so many languages they are joined by a shuffle.
    few = F.broadcast if counts.select("lang").distinct().count() <= MOST_BROADCAST else (lambda x: x)
    ask, found, weights = wanted.select("lang", "gram"), {}, {}
    for k in range(1, ORDER + 1):
        many = lambda n: F.sum((F.col("c") == n).cast("double"))  # noqa: B023, E731
        rate = tables[k].groupBy("lang").agg(*[many(i).alias(f"n{i}") for i in range(1, 5)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # Chen and Goodman's discounts; counts of counts that are 0 in small texts leave the plain ones.
        raw = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0) & (F.col("n1") > 0), i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))) for i in (1, 2, 3)]
        cut = [F.least(F.greatest(F.coalesce(d, F.lit(0.5 * i)), F.lit(0.05)), F.lit(i - 0.05)) for i, d in zip((1, 2, 3), raw, strict=True)]
        rate = rate.where("n1 + 2 * n2 > 0").select("lang", *[c.alias(f"d{i}") for i, c in enumerate(cut, 1)])
        with_d = tables[k].join(few(rate), "lang", "left").na.fill({"d1": 0.5, "d2": 1.0, "d3": 1.5})
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        with_d = with_d.select("lang", "gram", "c", F.shiftright("gram", 8).alias("h"), d.alias("d"))
        weights[k] = with_d.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
        found[k] = with_d.select("lang", F.col("gram").alias(f"g{k}"), (F.col("c") - F.col("d")).alias(f"x{k}"))
    out = ask
    p = F.lit(1 / 256)
    for k in range(1, ORDER + 1):
        out = out.withColumn(f"g{k}", suffix(k)).withColumn(f"h{k}", F.shiftright(f"g{k}", 8))
        out = out.join(found[k].withColumn("__l", F.col("lang")).drop("lang"), (F.col("__l").eqNullSafe(F.col("lang"))) & (found[k][f"g{k}"] == out[f"g{k}"]), "left").drop("__l", found[k][f"g{k}"])
        w = weights[k].select(F.col("lang").alias("__l"), F.col("h").alias("__h"), F.col("total").alias(f"t{k}"), F.col("mass").alias(f"m{k}"))
        out = out.join(w, F.col("__l").eqNullSafe(F.col("lang")) & (F.col("__h") == F.col(f"h{k}")), "left").drop("__l", "__h")
        p = F.when(F.col(f"t{k}").isNull(), p).otherwise((F.coalesce(F.col(f"x{k}"), F.lit(0.0)) + F.col(f"m{k}") * p) / F.col(f"t{k}"))
    return out.select("lang", "gram", p.alias("p"))


def scored(docs: DataFrame, own: DataFrame, blocks: int) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity of each document; ``own`` has block, lang, gram and p."""

    def run(batches):
        parts, table, now = [], {}, None
        for block, kind, part in _rows(batches):
            if block != now:
                now, parts, table = block, [], {}
            if kind == 0:
                parts.append(part.select(["lang", "gram", "p"]))
                continue
            if parts:
                whole, parts = pa.Table.from_batches(parts), []
                for lang in whole["lang"].unique().to_pylist():
                    mask = pa.compute.equal(whole["lang"], lang) if lang is not None else whole["lang"].is_null()
                    mine = whole.filter(mask)
                    g, p = mine["gram"].to_numpy(), mine["p"].to_numpy()
                    order = np.argsort(g)
                    table[lang] = g[order], np.log(p[order])
            for blob in part.column(part.schema.get_field_index("blob")).to_pylist():
                groups: dict = defaultdict(list)
                for row in _unpacked(blob):
                    groups[row[1]].append(row)
                for lang, rows in groups.items():
                    run_, sizes = text_grams([r[2] for r in rows])
                    g, logp = table[lang]
                    sums = np.add.reduceat(logp[np.searchsorted(g, run_)], np.cumsum(sizes) - sizes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.int64()), pa.array([lang] * len(rows), pa.string()), pa.array(sizes - 1), pa.array(np.exp(-sums / sizes))],
                        ["doc_id", "lang", "n_bytes", "perplexity"],
                    )

    import pyarrow.compute  # noqa: F401

    rows = _by_block(own, blobs(docs, blocks)).select("block", "kind", "lang", "gram", "p", "blob")
    return in_arrow(rows, run, "doc_id long, lang string, n_bytes long, perplexity double")


def held_out(doc_id):
    """The fifth of the trusted documents on which thresholds are set."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, low, high, kept, and counted (whether the model has the document's own counts) for each document."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    blocks = max(1, docs.select("doc_id").count() // BLOCK_ROWS)
    counts = materialize(counted(docs, good.where(~held_out(F.col("doc_id"))), blocks), "counts")
    total = materialize(counts.groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")
    known = materialize(probabilities(total.where("c > 0"), total), "probabilities")
    named = known.select(F.col("lang").alias("__l"), F.col("gram").alias("__g"), "p")
    own = counts.join(named, F.col("__l").eqNullSafe(F.col("lang")) & (F.col("__g") == F.col("gram"))).select("block", "lang", "gram", "p")
    found = materialize(scored(docs, own, blocks), "perplexities")
    held = found.join(good.where(held_out(F.col("doc_id"))), "doc_id")
    marks = F.percentile_approx("perplexity", list(QUANTILES), 10000).alias("marks")
    every = held.agg(marks).first()["marks"] or [0.0, float("inf")]
    each = held.groupBy(F.col("lang").alias("__l")).agg(marks, (F.count(F.lit(1)) / (F.count(F.lit(1)) + POOLED)).alias("share"))  # a row a language
    bound = lambda i: F.coalesce(F.lit(float(every[i])) + F.col("share") * (F.col("marks")[i] - F.lit(float(every[i]))), F.lit(float(every[i])))
    out = found.join(F.broadcast(each), F.col("__l").eqNullSafe(F.col("lang")), "left").withColumns({"low": bound(0), "high": bound(1)}).drop("__l", "marks", "share")
    own_counts = good.where(~held_out(F.col("doc_id"))).withColumn("counted", F.lit(True))
    out = out.join(own_counts, "doc_id", "left").withColumn("counted", F.coalesce("counted", F.lit(False)))
    return out.withColumn("kept", F.col("perplexity").between(F.col("low"), F.col("high")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
