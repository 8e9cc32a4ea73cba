"""Dedup, fingerprints, near-duplicates, components and packing against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sealfold.llm import common, components, exact_dedup, fingerprints, minhash, packing, wordhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, keep_id int, kept string, row string"


def docs(spark, *rows):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1, "x", "y") for i, t in rows], SCHEMA).repartition(3)


AWKWARD = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "É"), (6, "é"), (7, " "), (8, "x" * 200_000), (9, "X" * 200_000), (3, "A b"), (None, "a b"), (None, "null")]


def test_equal_texts(spark):
    rows = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.group_rows(docs(spark, *AWKWARD)).collect()}
    by = defaultdict(list)
    for i, t in AWKWARD:
        by[hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()].append(i)
    assert len(rows) == len(set((i, (t or "").translate(FOLD)) for i, t in AWKWARD))
    for (i, sha), r in rows.items():
        best = max((x for x in by[sha] if x is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (best, len(by[sha]), i == best)


def test_dedup_keeps_one_row_of_each_text_and_all_columns(spark):
    d = docs(spark, *AWKWARD)
    out = exact_dedup.deduplicate(d)
    assert out.dtypes == d.dtypes
    kept = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert kept == Counter([(2, ""), (4, "a B"), (5, "É"), (6, "é"), (7, " "), (9, "X" * 200_000), (None, "null")])
    again = exact_dedup.deduplicate(docs(spark, (3, "q"), (3, "q"), (3, "Q"), (1, "q"))).collect()
    assert len(again) == 1 and again[0]["doc_id"] == 3


def test_a_hot_group_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 1e-9)
    d = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.group_rows(d).where("group_size > 1").groupBy("keep_id", "group_size").count().collect()
    assert [tuple(r) for r in out] == [(4998, 1667, 1667)]


def test_bloom_tables_in_shards(spark, monkeypatch):
    """Far more rows than a shard holds: many shards, and still nearly every row without a copy passes straight through."""
    monkeypatch.setattr(common, "SHARD_WORDS", 64)
    monkeypatch.setattr(common, "SHARDS_A_JOB", 3)
    keys = spark.range(3000, numPartitions=3).selectExpr("if(id < 2700, id, id - 300) AS k", "'x' AS maybe_not")
    table = common.bloom(keys, "k", 3000, times=2)
    assert table.shards == 12
    out = {}
    for r in table.maybe(keys, "k").collect():
        out.setdefault(r["k"], []).append(r["maybe"])
    assert sum(map(len, out.values())) == 3000 and set(table.maybe(keys, "k").columns) == {"k", "maybe_not", "maybe"}
    assert all(out[k] == [True, True] for k in range(2400, 2700))
    assert sum(out[k] == [False] for k in range(2400)) > 0.95 * 2400
    rows = [(i, f"text {i % 40}") for i in range(90)] + [(200, None), (201, "")]
    d = docs(spark, *rows)
    kept = {r["doc_id"] for r in exact_dedup.deduplicate(d).collect()}
    assert kept == {max(j for j, u in rows if (u or "") == (t or "")) for _, t in rows} == {r["doc_id"] for r in exact_dedup.group_rows(d).where("kept").collect()}


def test_empty_tables(spark):
    d = docs(spark, (1, "a")).limit(0)
    assert exact_dedup.group_rows(d).count() == exact_dedup.deduplicate(d).count() == 0
    assert minhash.near_duplicates(d).count() == minhash.deduplicate(d).count() == 0
    assert fingerprints.with_next(d).count() == packing.pack(d).count() == 0


# --- fingerprints ----------------------------------------------------------------------------------------------------


def test_next_documents_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    rng = random.Random(4)
    ids = rng.sample(range(-50, 10**12, 7_777_777), 20) + [-5, -4, 0]
    d = docs(spark, *[(i, f"text {i}") for i in ids])
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(d).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"text {order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_next_of_few_and_awkward_rows(spark):
    assert [(r["doc_id"], r["next_text"]) for r in fingerprints.with_next(docs(spark, (7, "only"))).collect()] == [(7, "only")]
    got = Counter((r["doc_id"], r["text"], r["next_text"]) for r in fingerprints.with_next(docs(spark, (2, "b"), (2, "a"), (None, None), (5, "z"))).collect())
    assert got == Counter([(5, "z", "b"), (2, "b", "a"), (2, "a", ""), (None, "", "z")])


@pytest.mark.parametrize(("text", "other", "want"), [("abcdefg", "XYZ", "abcdeXY"), ("abcdef", "X", "abcdX"), ("ab", "X", "ab"), ("", "X", ""), ("äöü😀😀😀", "é😀", "äöü😀é😀")])
def test_edited_texts(spark, text, other, want):
    df = spark.createDataFrame([(text, other)], "a string, b string")
    assert df.select(fingerprints.edited(F.col("a"), F.col("b"))).first()[0] == want


def test_sketches_estimate(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    a = " ".join(words)
    b = " ".join(words[:2000] + [f"v{i}" for i in range(1000)])
    rows = spark.createDataFrame([(a, b, a.upper(), "", "one two", None)], "a string, b string, c string, e string, s string, n string")
    s = {c: fingerprints.sketch(F.col(c)) for c in rows.columns}
    named = rows.select(*[v.alias(k) for k, v in s.items()])
    out = named.select(
        fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("b")), fingerprints.distinct_count(F.col("a")), F.col("a") == F.col("c"), F.size("e"), F.size("s"),
        fingerprints.resemblance(F.col("e"), F.col("n")), fingerprints.resemblance(F.col("e"), F.col("s")), fingerprints.merge(F.col("a"), F.col("a")) == F.col("a"),
    ).first()
    assert abs(out[0] - 0.5) < 0.15 and abs(out[1] - 2 / 3) < 0.2 and abs(out[2] - 2996) < 900
    assert list(out[3:]) == [True, 0, 1, 1.0, 0.0, True]
    del rng


def test_sketches_of_parts_merge(spark):
    df = spark.createDataFrame([("a b c d e f g", "e f g h i j k l", "a b c d e f g h i j k l")], "x string, y string, z string")
    # Shingles that run over the cut are the only ones that the parts lack.
    got = df.select(fingerprints.merge(fingerprints.sketch(F.col("x")), fingerprints.sketch(F.col("y"))).alias("m"), fingerprints.sketch(F.col("z")).alias("z")).first()
    assert set(got["m"]) <= set(got["z"]) and len(got["z"]) - len(got["m"]) == 1


# --- shingles and near-duplicates ------------------------------------------------------------------------------------


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉ \t\n\x00\x1c ", max_size=40), max_size=8), st.integers(1, 5))
def test_shingle_hashes_are_shingles(found, size):
    hashes, at = wordhash.shingles([t.encode() for t in found], size) if found else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
    seen = {}
    for k, t in enumerate(found):
        own, want = set(hashes[at[k] : at[k + 1]].tolist()), shingle_set(t, size)
        assert len(own) == len(want) == at[k + 1] - at[k]
        for other, (s, w) in seen.items():
            assert len(own & s) == len(want & w), (t, other)
        seen[t] = own, want


def brute_components(rows, size, percent):
    sets = {i: shingle_set(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups, copies, length=60):
    """Texts of a few groups: copies of copies, each with some words changed, so that links chain and many pairs just miss."""
    rng = random.Random(seed)
    rows, n = [], 0
    for g in range(groups):
        pool = [[f"g{g}w{i}" for i in range(length)]]
        for _ in range(copies):
            w = list(rng.choice(pool[:4]))
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            pool.append(w)
            rows.append((n, " ".join(w)))
            n += 1
    return rows


def test_near_duplicates_against_all_pairs(spark):
    rows = near_copies(3, 3, 90) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "one two"), (1004, "ONE two"), (1005, "two one"), (1006, "w " * 30_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, *rows), 4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_rare_shingle_join_finds_every_link(spark):
    rows = near_copies(5, 2, 70, 40)
    df = docs(spark, *rows).select("doc_id", "text").withColumn("outside", F.lit(True)).withColumn("c", F.col("doc_id"))
    found = {(r["a"], r["b"]) for r in minhash._sharing_rare(df, 4, 80).collect()}
    sets = {i: shingle_set(t, 4) for i, t in rows}
    links = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert links and links <= found


def test_near_dedup_keeps_one_of_each_group(spark):
    rows = near_copies(8, 2, 20) + [(None, "a b c"), (None, "a b c"), (500, "alone"), (501, "p q r s t"), (501, "p q r s t")]
    d = docs(spark, *rows)
    out = minhash.deduplicate(d, 4)
    assert out.dtypes == d.dtypes
    want = brute_components([r for r in rows if r[0] is not None], 4, 80)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter([None, None, *{c for _, c in want.values()}])


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components(edges):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: c for x, c in up.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_a_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components.components(edges).collect()} == {0}


# --- packing ---------------------------------------------------------------------------------------------------------


def best_fit_gaps(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - n)
    return sorted(gaps)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=120))))
def test_plan_is_sequential_best_fit(case):
    capacity, lengths = case
    steps = packing.plan(Counter(lengths), capacity)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    used = defaultdict(list)
    for i, (length, first, sequence, each, offset) in enumerate(steps.tolist()):
        last = steps[i + 1][1] if i + 1 < len(steps) and steps[i + 1][0] == length else Counter(lengths)[length]
        for rank in range(first, last):
            used[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(map(len, used.values())) == len(lengths)
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == best_fit_gaps(lengths, capacity)


def _library(texts):
    from tokenizers import Tokenizer

    from sealfold.llm.token_counts import tokenizer_path

    return [e.ids for e in Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False)]


def test_packed_sequences_round_trip(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_ROWS", 5)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Hello", "world", "naïve", "x1"]) for _ in range(rng.choice([0, 1, 1, 1, 5, 9, 40]))) for _ in range(60)] + [None, "", "it's <|endoftext|> ok", "中文 É"]
    d = docs(spark, *enumerate(texts))
    placed = packing.pack(d, 16).collect()
    whole = {i: [*ids, 0] for i, ids in enumerate(_library([t or "" for t in texts]))}
    sequences = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(d, spark.createDataFrame(placed), 16).collect()}
    found = defaultdict(list)
    for r in placed:
        ids = sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        found[r["doc_id"]].append((r["piece"], r["start"], ids))
    assert {i: [t for _, _, ids in sorted(p) for t in ids] for i, p in found.items()} == whole
    assert all([s for _, s, _ in sorted(p)] == list(range(0, len(whole[i]), 16)) for i, p in found.items())
    assert all(len(s) <= 16 for s in sequences.values())
    assert len(sequences) == len(best_fit_gaps([r["length"] for r in placed], 16))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "\n", "a", "The", "'", "'Re", "É", "ß", "İ", "1", "23", "!", "<|endoftext|>", "<|", "\xa0", "\x1c", "\x85", "中", "Σ", "é", "_", "²", "ŉ", "\x00"]), max_size=12).map("".join), max_size=5))
def test_encoder_is_the_library(found):
    from sealfold.llm.token_counts import tokenizer_path

    encode = packing.encoder(tokenizer_path("word_bpe_49k.json"), True)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(found)] == (_library(found) if found else [])
