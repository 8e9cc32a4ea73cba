"""The corpus pipeline's stages, each against brute force, and the registry."""

from collections import Counter

import pytest

import corpus_pipeline
from sealfold.llm import common, exact_dedup, pii, registry
from sealfold.llm.common import documents

from .test_bulk import FOLD, brute_components


def test_registry():
    names = sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = {r["doc_id"]: r for r in docs.collect()}
    (_, toxic), (_, exact), (_, near), (_, private), (_, pack) = corpus_pipeline.STAGES
    after = toxic(spark, docs, sf_dir).cache()
    assert after.columns == docs.columns
    clean = {r["doc_id"] for r in after.collect()}
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(i in clean for i, t in known.items() if not t) >= 0.9 * sum(not t for t in known.values())
    left = exact(spark, after, sf_dir).cache()
    best = {}
    for i in clean:
        key = rows[i]["text"].translate(FOLD)
        best[key] = max(i, best.get(key, -1))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(best.values())
    apart = near(spark, left, sf_dir).cache()
    want = brute_components([(i, rows[i]["text"]) for i in best.values()], 5, 80)
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted({c for _, c in want.values()})
    public = private(spark, apart, sf_dir).cache()
    assert public.dtypes == docs.dtypes and public.count() == apart.count()
    for r in public.collect():
        base, added = pii.spans(rows[r["doc_id"]]["text"])
        assert r["text"] == pii.redacted(rows[r["doc_id"]]["text"], base + added) and r["n_chars"] == len(r["text"])
        assert not pii.base_spans(r["text"])
    placed = pack(spark, public, sf_dir).collect()
    assert {r["doc_id"] for r in placed} == {c for _, c in want.values()}
    filled = Counter()
    for r in placed:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) * 1.1 + 1


def test_same_dedup_either_way(spark, sf_dir):
    docs = documents(spark, sf_dir)
    kept = {r["doc_id"] for r in exact_dedup.group_rows(docs).where("kept").collect()}
    assert kept == {r["doc_id"] for r in exact_dedup.deduplicate(docs).collect()}


def test_awkward_rows(spark, sf_dir, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with the operators' own names."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [
        (1, "one text of some words in a row", "en"), (1, "one text of some words in a row", "en"), (2, "ONE text of some words in a row", None), (3, None, "en"), (4, "", "xx"), (5, None, None),
        (None, "no id at all but some words", "en"), (None, None, None), (7, long, "en"), (8, long + " more", "en"), (9, "call +1 988 555 2485 or mail a@b.cd", "en"),
    ]
    clash = ["row", "score", "h", "maybe", "b", "key", "rep", "__shard", "bits", "piece", "length"]
    docs = spark.createDataFrame([(*r, "src", None, *["x"] * len(clash)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.dtypes == docs.dtypes
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.count() == len(left) == 5 and set(left) == {2, 5, None, 7, 9}
    assert left[5] is None and left[7] == long and left[9] == "call <PHONE> or mail <EMAIL>" and left[None] == "no id at all but some words"
    placed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    assert {r["doc_id"] for r in placed} == set(left) and sum(r["length"] for r in placed if r["doc_id"] == 5) == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run_leaves_only_what_its_result_reads(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() and sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["personal-data", "pieces"]


class _Session:
    """As much of a session as shared_dir() asks: a setting that can't be changed, and a context."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf, self.master, self.folder, self.made = self, self, master, folder, None

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def setCheckpointDir(self, path):
        self.made = path + "/own"

    def getCheckpointDir(self):
        return self.made


def test_shared_folder():
    assert common.shared_dir(_Session("spark://host:7077", "hdfs://name/dir/")) == "hdfs://name/dir"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(_Session("spark://host:7077"))
    local = _Session("local[4]")
    assert common.shared_dir(local) == common.shared_dir(local) == local.made
