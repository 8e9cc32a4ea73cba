"""Every registered query over the benchmark tables, against brute force in plain Python or the libraries it answers for."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from sealfold.llm import nbest, registry
from sealfold.llm.token_counts import tokenizer_path
from tests.llm.test_bulk import brute_components
from tests.llm.test_text import naive_spans


def texts_of(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    return texts_of(spark, sf_dir)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_personal_data(spark, sf_dir, found):
    kinds = ("email", "ip", "card", "phone")
    out = by_id(registry.QUERIES["op1_pii"](spark, sf_dir))
    assert out.keys() == found.keys()
    for i, text in found.items():
        base = naive_spans(text)
        assert [out[i][f"n_{k}"] for k in kinds] == [sum(k == j for _, k, _ in base) for j in range(4)]
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(base))
        assert out[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(out[i]["spans"].split(","))
        assert out[i]["n_disguised"] == len(list(filter(None, out[i]["spans"].split(",")))) - len(base)


def test_token_counts(spark, sf_dir, found):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out = by_id(registry.QUERIES["op2_token_counts"](spark, sf_dir))
    assert out.keys() == found.keys()
    for i, text in found.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len(text.encode()), n, n > 512)


def test_packing(spark, sf_dir, found):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = registry.QUERIES["op3_packing"](spark, sf_dir).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert own.keys() == found.keys()
    for i, text in found.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(own[i], key=lambda r: r["piece"])
        want = [(k, at, len(p := ids[at : at + 2048]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in parts] == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1


def test_segmentations(spark, sf_dir, found):
    model = nbest.lattice(tokenizer_path("piece_bpe_32k.model"))
    out = by_id(registry.QUERIES["op4_nbest"](spark, sf_dir))
    assert out.keys() == found.keys() and all(r["round_trip"] for r in out.values())
    for i in sorted(found)[::10]:
        normal = model.normalize(found[i])
        best = [0.0]  # plain Viterbi over the whole text
        for end in range(1, len(normal) + 1):
            steps = [best[at] + model.scores[normal[at:end]][1] for at in range(max(0, end - model.longest), end) if normal[at:end] in model.scores]
            if normal[end - 1] not in model.scores:
                steps.append(best[-1] + model.penalty)
            best.append(max(steps))
        segmented = model.segmentations(found[i], 4)
        assert out[i]["score"] == best[-1] == segmented[0][0]
        assert [out[i]["ids_crc32"], *out[i]["others_crc32"]] == [zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in segmented]
        assert len({tuple(ids) for _, ids in segmented}) == len(segmented) and {model.decode(ids) for _, ids in segmented} == {normal}


def test_quality(spark, sf_dir):
    folder = f"{os.path.dirname(sf_dir)}/sf0.01"
    found = texts_of(spark, folder)
    out = by_id(registry.QUERIES["op5_quality"](spark, folder))
    assert out.keys() == found.keys()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for i, r in out.items():
        assert r["n_bytes"] == len(found[i].encode()) and r["kept"] == (r["low"] <= r["perplexity"] <= r["high"])
        assert r["counted"] == (labels.get(i) == 1 and zlib.crc32(str(i).encode()) % 5 != 0)
    share = lambda q: np.mean([r["kept"] for i, r in out.items() if labels.get(i) == q and zlib.crc32(str(i).encode()) % 5 == 0])
    assert share(1) > 0.9 and share(0) < 0.4


def test_toxicity(spark, sf_dir, found):
    out = by_id(registry.QUERIES["op6_toxicity"](spark, sf_dir))
    assert out.keys() == found.keys()
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    scores = defaultdict(set)
    for i, text in found.items():
        scores[text].add(out[i]["score"])
    assert all(len(s) == 1 for s in scores.values())


def test_fingerprints(spark, sf_dir, found):
    out = by_id(registry.QUERIES["op7_fingerprints"](spark, sf_dir))
    assert out.keys() == found.keys()
    order = sorted(found, reverse=True)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    shingles = lambda t: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := words(t)) >= 5 else {tuple(w)} - {()}
    errors = []
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        text, m = found[i], len(found[i]) // 3
        edited = text[: len(text) - m] + found[after][:m]
        assert out[i]["n_chars"] == len(text) and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", found[after])):
            a, b = shingles(text), shingles(other)
            errors.append(abs(out[i][name] - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(errors) < 0.03 and max(errors) < 0.25
    prints = defaultdict(set)
    for i, text in found.items():
        prints[text].add(out[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_near_duplicates(spark, sf_dir):
    """All links of a thousand documents, found by brute force over their shingles: recall and precision are 1."""
    folder = f"{os.path.dirname(sf_dir)}/sf0.01"
    found = texts_of(spark, folder)
    out = by_id(registry.QUERIES["op10_minhash"](spark, folder))
    want = brute_components(list(found.items()), 4, 80)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())
    assert sum(i != c for i, (_, c) in want.items()) > 20


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{table}'")
    got, want = registry.QUERIES[name](spark, sf_dir).toArrow(), con.sql(registry.SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t[n].to_pylist() for n in names), strict=True)))
    assert names == sorted(want.column_names) and rows(got) == rows(want)
