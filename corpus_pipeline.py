"""A training corpus from raw documents, in five stages; each works on all that the stage before it kept.

Toxic documents go, of equal and of nearly equal texts one document stays, personal data is replaced, and what remains is
packed into sequences. Every stage's result is a table of files, so a lost executor costs the tasks it ran and no more; what
a stage stored on its way is deleted once its result is there.

Defined results: a null text counts as empty (one document without text stays of all, and takes part in packing as one end
token); it stays null until then. A null id is a document like others where texts are compared, but is linked with nothing
as a near-duplicate; rows that repeat id and text leave one row. Of equal texts the largest id stays, of linked ones the
least. A null or unknown language has the threshold of all languages together. Labels of null or unknown documents are
ignored; without labels of both kinds no document is toxic. Texts of any length are handled whole. An empty table gives an
empty table, and further columns, whatever their names, are carried up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sealfold.llm import exact_dedup, minhash, packing, pii, toxicity
from sealfold.llm.common import bounded_batches, discard, documents, leftovers, materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, with its language's threshold, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.classify(docs, labels).where("not rejected").select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles the one with the least id."""
    return minhash.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    bounded_batches(spark)
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("near-duplicates", without_near_copies),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: A classifier and a tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with leftovers() as made:
            result = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before, *[table for table in made if table is not result])
        docs, before = result, [result]
    return STAGES[-1][1](spark, docs, sf_dir)
