"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling; in numpy.

Words are runs of letters and digits, lower-cased. A word's embedding is the sum of those of two hash buckets, its own and
that of its first letters, so that rare forms of a word are known by their stem. Filters over one, two and three
words are pooled by their maximum over the whole text, so a text of any length gives the same few values; a logistic layer
turns them into a score. Training sees a bounded sample of the labelled rows of three folds; thresholds by language are
calibrated on the scores of all labelled rows of a fourth, which the model has not seen, and the fifth is held out.

Defined results: a null or empty text has the score of no words; rows are scored independently, so ties, repeated rows
and other columns don't matter; labels of null or of unknown documents are ignored; without labels of both kinds every
score is 0; a language without labels has the threshold of all languages together; texts of any length are scored whole; an
empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sealfold.llm import wordhash
from sealfold.llm.common import bounded_batches, documents, in_arrow, materialize, row_texts, with_rows
from sealfold.llm.token_counts import texts

BUCKETS, DIM, WIDTHS, FILTERS = 2**17, 8, (1, 2, 3), 16
#: Bytes of a word's beginning that have an embedding of their own.
HEAD = 5
#: The most labelled rows of either kind that training uses, picked by a hash of their id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: The most words of a row that training uses; longer texts are scored like all others, but teach nothing.
SAMPLE_WORDS = 20_000
EPOCHS, BATCH, RATE, SEED = 4, 32, 0.3, 7
#: The share of clean labelled rows of a language that its threshold may reject.
FALSE_ALARMS = 0.002
#: Bytes of text that are scored at once.
SCORED_BYTES = 1 << 18
_WIDE = max(WIDTHS)
_SPACE = np.ones(256, bool)
_SPACE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_ids(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """((words, 2) buckets of all words, two rows of padding behind each text; offsets of the texts in them)."""
    h, heads, doc = wordhash.words_and_heads(found, HEAD, space=_SPACE)
    count = np.bincount(doc, minlength=len(found))
    at = np.concatenate([[0], np.cumsum(count + _WIDE - 1)])
    out = np.full((at[-1], 2), BUCKETS, np.int32)
    place = np.arange(len(h)) + doc * (_WIDE - 1)
    out[place, 0] = h & np.uint64(BUCKETS - 1)
    out[place, 1] = wordhash.mix(heads, 1) & np.uint64(BUCKETS - 1)
    return out, at


@dataclass
class Model:
    """words (BUCKETS + 1, DIM), the last row for padding; filters (3 DIM, 48) with bias; out (48,) with bias."""

    words: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @classmethod
    def start(cls) -> Model:
        rng = np.random.default_rng(SEED)
        words = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        words[-1] = 0
        filters = rng.normal(0, 0.3, (_WIDE * DIM, FILTERS * len(WIDTHS))).astype(np.float32)
        filters[::DIM] += 1.0  # the embeddings' first value starts as the words' surprise
        return cls(words, filters * cls.mask(), np.zeros(filters.shape[1], np.float32), np.full(filters.shape[1], 0.15, np.float32), -3.0)

    @staticmethod
    def mask() -> np.ndarray:
        """Where filters of a width have weights."""
        return np.concatenate([np.repeat(np.arange(_WIDE) < w, DIM)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)

    @staticmethod
    def begins(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a window may begin: at words, not in the padding behind a text, from which it would reach into the next text."""
        own = np.ones(len(ids), bool)
        for k in range(1, _WIDE):
            own[at[1:] - k] = False
        return own

    def windows(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        padded = np.concatenate([self.words[ids[:, 0]] + self.words[ids[:, 1]], np.zeros((_WIDE - 1, DIM), np.float32)])
        return np.concatenate([padded[k : k + len(ids)] for k in range(_WIDE)], axis=1) * self.begins(ids, at)[:, None]

    def logits(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros(len(at) - 1, np.float32)
        pooled = np.maximum(np.maximum.reduceat(self.windows(ids, at).astype(np.float64) @ self.filters, at[:-1]) + self.filter_bias, 0)
        return pooled @ self.out + self.out_bias

    def scores(self, found: list[bytes]) -> np.ndarray:
        """A score for each text. Sums in double precision and rounded: a product's last digits depend on what other texts stand beside."""
        return (1 / (1 + np.exp(-self.logits(*word_ids(found)).astype(np.float64)))).clip(0, 1).round(9)


def surprise(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Where training starts from: for each bucket how much oftener toxic texts hold it than its frequency lets expect.

    Under max pooling only the peaks learn; from random embeddings the peaks are rare words that tell one text from another.
    """
    count = np.zeros((2, BUCKETS + 1), np.float32)
    for ids, toxic in zip(docs, labels, strict=True):
        count[int(toxic), np.unique(ids)] += 1
    expected = count.sum(0) * labels.mean()
    z = np.clip(((count[1] - expected) / np.sqrt(expected + 1) - 1) / 5, -0.2, 1)
    z[-1] = 0
    return z


def train(docs: list[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    """Fit by Adagrad on texts' word ids. ``prior`` is the share of toxic rows among all, for scores that mean it."""
    model = Model.start()
    model.words[:, 0] = surprise(docs, labels)
    rng = np.random.default_rng(SEED)
    mask = model.mask()
    squares = [np.full_like(x, 0.01) for x in (model.words, model.filters, model.filter_bias, model.out)]
    bias_square = 0.01
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / (EPOCHS + 1))
        order = rng.permutation(len(docs))
        for first in range(0, len(order), BATCH):
            pick = order[first : first + BATCH]
            ids = np.concatenate([docs[i] for i in pick])
            at = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
            drop = rng.random(len(ids)) < 0.1  # dropped words keep a text from being told by one of them
            ids = np.where(drop[:, None], BUCKETS, ids)
            windows, begins = model.windows(ids, at), model.begins(ids, at)
            conv = windows @ model.filters
            peak = np.stack([conv[s:e].argmax(0) + s for s, e in zip(at[:-1], at[1:], strict=True)])
            raw = np.take_along_axis(conv, peak, 0) + model.filter_bias
            pooled = np.maximum(raw, 0)
            p = 1 / (1 + np.exp(-(pooled @ model.out + model.out_bias)))
            error = ((p - labels[pick]) / len(pick)).astype(np.float32)
            back = error[:, None] * model.out * (raw > 0)
            seen = windows[peak]
            grads = [None, np.einsum("bf,bfk->kf", back, seen) * mask, back.sum(0), pooled.T @ error + 1e-4 * model.out]
            to_words = (back[:, :, None] * model.filters.T * begins[peak][:, :, None]).reshape(-1, DIM)
            touched = np.minimum(peak[:, :, None] + np.arange(_WIDE), len(ids) - 1)
            rows, where = np.unique(ids[touched.ravel()], return_inverse=True)
            grad = np.zeros((len(rows), DIM), np.float32)
            np.add.at(grad, where.reshape(-1, 2), to_words[:, None, :])
            grad[rows == BUCKETS] = 0
            squares[0][rows] += grad**2
            model.words[rows] -= rate * grad / np.sqrt(squares[0][rows])
            for x, g, s in zip((model.filters, model.filter_bias, model.out), grads[1:], squares[1:], strict=True):
                s += g**2
                x -= rate * g / np.sqrt(s)
            bias_square += float(error.sum()) ** 2
            model.out_bias -= rate * float(error.sum()) / bias_square**0.5
    share = labels.mean()
    model.out_bias += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return model


#: The folds whose labels are never learnt from, and those that set thresholds; the others train.
HELD_OUT, CALIBRATION = 0, 1


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id):
    """The fifth of the documents whose labels are never learnt from."""
    return fold(doc_id) == HELD_OUT


def usable_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (0 or 1), one row a document, of all folds but the one held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return rows.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of a bounded sample of labelled rows; None without labels of both kinds."""
    bounded_batches(docs.sparkSession)
    known = usable_labels(labels).where(fold(F.col("doc_id")) != CALIBRATION)
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    pick = lambda kind, n: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, SAMPLE_TOXIC).union(pick(0, SAMPLE_CLEAN))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches):
        for part, found in texts(batches):
            ids, at = word_ids([t.encode() for t in found])
            words = pa.array([ids[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
            short = pa.array(np.diff(at) <= SAMPLE_WORDS)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)).filter(short) for c in ("doc_id", "toxic")] + [words.filter(short)], ["doc_id", "toxic", "words"])

    prior = totals[1] / (totals[0] + totals[1])

    def learn(batches):
        # The order of rows in files and tasks must not change the model.
        order = sorted(x for b in batches for x in zip(*(b.column(i).to_pylist() for i in (0, 2, 1)), strict=True))
        y = np.array([x[2] for x in order], np.float32)
        if len(set(y.tolist())) == 2:
            model = train([np.frombuffer(x[1], np.int32).reshape(-1, 2) for x in order], y, prior)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # The sample is bounded, so one task can learn from it; the driver gets the model alone.
    made = in_arrow(in_arrow(rows, run, "doc_id long, toxic int, words binary").repartition(1), learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """row (all columns of docs) and score."""
    rows = with_rows(docs)
    if model is None:
        return rows.select("row", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS * DIM floats

    def run(batches):
        for part, found in row_texts(batches):
            got = [shared.value.scores(chunk) for _, chunk in wordhash.chunks([t.encode() for t in found], SCORED_BYTES)]
            yield pa.RecordBatch.from_arrays([part, pa.array(np.concatenate(got), pa.float64())], ["row", "score"])

    return in_arrow(rows, run, StructType([*rows.schema, StructField("score", DoubleType())]))


def thresholds(scores: DataFrame, labels: DataFrame) -> dict[str | None, float]:
    """A threshold for each language of scores (doc_id, lang, score), and under None the one of all languages.

    It is the least of the thousandths above 0 at which at most FALSE_ALARMS of the clean labelled rows are rejected, yet
    no more than 1. Only counts by language and thousandth are gathered.
    """
    calibrated = usable_labels(labels).where(fold(F.col("doc_id")) == CALIBRATION)
    bins = scores.join(calibrated, "doc_id").where("toxic = 0").groupBy("lang", F.floor(F.col("score") * 1000).cast("int").alias("bin")).count()
    both = bins.select("lang", "bin", "count", F.lit(False).alias("total")).union(bins.select(F.lit(None).cast("string"), "bin", "count", F.lit(True)))
    both = both.groupBy("lang", "total", "bin").agg(F.sum("count").alias("count"))
    down = Window.partitionBy("lang", "total").orderBy(F.desc("bin"))
    ranked = both.withColumn("above", F.sum("count").over(down)).withColumn("n", F.sum("count").over(Window.partitionBy("lang", "total")))
    # The lowest bin from which on no more than the share is rejected; the threshold is its lower edge.
    found = ranked.groupBy("lang", "total").agg(F.max(F.when(F.col("above") > FALSE_ALARMS * F.col("n"), F.col("bin"))).alias("last"))
    rows = found.where("total or lang is not null").collect()
    edge = lambda r: min(1.0, ((r["last"] if r["last"] is not None else 0) + 1) / 1000)
    out = {r["lang"]: edge(r) for r in rows if not r["total"]}
    return out | {None: next((edge(r) for r in rows if r["total"]), 1.0)}


def rejected(limits: dict[str | None, float]):
    """Whether a row with columns lang and score is above its language's threshold."""
    table = F.create_map(*[F.lit(x) for k, v in limits.items() if k is not None for x in (k, v)]) if len(limits) > 1 else F.create_map(F.lit(""), F.lit(limits[None]))
    return F.col("score") >= F.coalesce(F.try_element_at(table, F.coalesce("lang", F.lit("\0"))), F.lit(limits[None]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row (all columns of docs), score and rejected, for docs with columns doc_id, text and lang."""
    scored = materialize(score(docs, fit(docs, labels)), "scores")
    flat = scored.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.lang").alias("lang"), "score")
    limits = thresholds(flat, labels)
    return scored.withColumn("lang", F.col("row.lang")).withColumn("rejected", rejected(limits)).drop("lang")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = score(docs.select("doc_id", "text", "lang"), fit(docs, labels)).select("row.doc_id", "row.lang", "score")
    scored = materialize(ids, "scores")
    limits = thresholds(scored, labels)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), rejected(limits).alias("rejected")
    )
