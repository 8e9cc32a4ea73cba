"""Token counts, personal data, segmentation, perplexity, toxicity and archives."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sealfold.llm import nbest, perplexity, pii, token_counts, toxicity, warc
from sealfold.llm.token_counts import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, score double, row string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, "en", 0.5, "y") for i, t in rows], SCHEMA).repartition(3)


PARTS = [" ", "  ", "\n", "a", "the", "'", "'re", "'ll", "'s", "é", "ß", "1", "23", "!", "<|endoftext|>", "<|", "\xa0", "\x1c", "\x85", "中", "𝄞", "\t", "ing", "_", "-", "​", "²", "Ⅷ"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), st.integers(0, 6))
def test_counts_of_every_prefix(library, text, limit):
    count = token_counts.counter(tokenizer_path("byte_bpe_50k.json"))
    want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert count.prefix_counts(text).tolist() == want
    fit = len(text) if want[-1] <= limit else max(i for i, n in enumerate(want) if n <= limit)
    assert count.count_and_fit(text, limit) == (want[-1], fit)


def test_count_operators(spark, library):
    long = "word " * 50_000 + "x" * 20_000
    rows = [(1, None), (2, ""), (3, "Hello, world"), (3, "Hello, world"), (None, "é"), (4, long)]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs(spark, *rows)).collect()), key=str)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t or ""), n(t or "") > 512) for i, t in rows), key=str)
    each = {r["doc_id"]: r["counts"] for r in token_counts.prefix_counts(docs(spark, (1, "a b"), (2, None))).collect()}
    assert each == {1: [0, 1, 2, 2], 2: [0]}
    assert token_counts.count_tokens(docs(spark, (1, "")).limit(0)).count() == 0


# --- personal data ---------------------------------------------------------------------------------------------------

NAIVE = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def naive_spans(text):
    out = []
    for kind, pattern in enumerate(NAIVE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ ()4", max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == naive_spans(text)
    assert pii.spans(text)[0] == naive_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("write jane at corp dot example dot org", "email", "jane at corp dot example dot org"),
        ("an аdmin@exаmple.com of sorts", "email", "аdmin@exаmple.com"),
        ("call plus one nine eight eight five five five two four eight five", "phone", "plus one nine eight eight five five five two four eight five"),
        ("card ４１１１ 1111 1111 1111!", "card", "４１１１ 1111 1111 1111"),
        ("host one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("＋1 (988) 555‑2485", "phone", "＋1 (988) 555‑2485"),
        ("an jose [arroba] ejemplo [punto] com si", "email", "jose [arroba] ejemplo [punto] com"),
        ("an hans at beispiel punkt de mit", "email", "hans at beispiel punkt de"),
        ("ring +49 one five one 2345678 up", "phone", "+49 one five one 2345678"),
        ("to joe@ban\u212a.com then", "email", "joe@ban\u212a.com"),
        ("ruf null eins sieben plus vier neun eins sieben null eins zwei drei vier fünf an", "phone", "plus vier neun eins sieben null eins zwei drei vier fünf"),
    ],
)
def test_disguises_are_mapped_back(text, kind, part):
    base, added = pii.spans(text)
    assert base == naive_spans(text)
    assert (text.index(part), pii.KINDS.index(kind), text.index(part) + len(part)) in added
    assert pii.may_be_disguised([text, "plain prose at home"]) == [True, False]


@pytest.mark.parametrize("text", ["look at example.com dot", "one two three", "a dot b", "un punto de vista", "on two three occasions", "der punkt am ende", "at this point in time", "meet me at nine", "point one two", "«a»", "1 2 3"])
def test_prose_is_left_alone(text):
    assert pii.spans(text)[1] == []


def test_redaction(spark):
    long = "1" * 100_000 + " " + "a@b." * 2
    rows = [(1, "a a@b.cd b 10.0.0.1"), (2, None), (3, ""), (4, long), (4, long)]
    d = docs(spark, *rows).withColumn("n_chars", F.length("text"))
    out = pii.redact(d)
    assert out.columns == d.columns and out.dtypes == d.dtypes
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["row"]) for r in out.collect()}
    assert got[1] == ("a <EMAIL> b <IP>", 16, "y") and got[2] == (None, None, "y") and got[3] == ("", 0, "y")
    assert out.count() == 5 and pii.redact(d.limit(0)).count() == 0
    found = {r["row"]["doc_id"]: r["pii"] for r in pii.find_pii(d.where("doc_id < 3")).collect()}
    assert [(x["kind"], x["start"], x["end"], x["disguised"]) for x in found[1]] == [("email", 2, 8, False), ("ip", 11, 19, False)] and found[2] == []


def test_overlapping_spans_go_together():
    text = "+1 4111 1111 1111 1111"
    spans = [(0, 3, 12), (3, 2, 22)]
    assert pii.redacted(text, spans) == "<PHONE>" and pii.redacted("ab", []) == "ab"


# --- segmentation ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return nbest.lattice(tokenizer_path("piece_bpe_32k.model"))


def every_segmentation(model, word):
    """All segmentations of a short word by brute force over the model's scores, best first; ties by ids from the end."""
    out = []

    def back(at, ids, score):
        if at == 0:
            out.append((-score, tuple(ids)))
        for start in range(max(0, at - model.longest), at):
            if found := model.scores.get(word[start:at]):
                back(start, [*ids, found[0]], score + found[1])
            elif start == at - 1:
                back(start, [*ids, *(model.bytes[b] for b in reversed(word[start:at].encode()))], score + model.penalty)

    back(len(word), [], 0.0)
    return [(-s, ids[::-1]) for s, ids in sorted(out)]


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="▁thean𝄞é,", min_size=1, max_size=7), st.integers(1, 6))
def test_best_segmentations_of_a_unit(model, word, n):
    assert model.search(word, n) == every_segmentation(model, word)[:n]


def test_long_units_are_searched_alike(model, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(nbest, "SHORT", 0)
    for _ in range(150):
        word = "".join(rng.choice("▁thean𝄞é,aa") for _ in range(rng.randint(1, 8)))
        assert model.search(word, 5) == every_segmentation(model, word)[:5]


@pytest.mark.parametrize("n", [1, 2, 4])
def test_many_texts_at_once(n):
    """Texts, repeated and empty ones too, against brute force over whole texts: scores, order and distinct segmentations."""
    model = nbest.Lattice(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(4)
    found = ["".join(rng.choice("the an𝄞é,") for _ in range(rng.randint(0, 8))) for _ in range(120)] + [""]
    normal = [model.normalize(t) for t in found + found[:5]]
    for text, got in zip(normal, model.nbest(normal, n), strict=True):
        want = every_segmentation(model, text)
        assert [s for s, _ in got] == [s for s, _ in want[:n]]
        assert len({tuple(i) for _, i in got}) == len(got) and all((s, tuple(i)) in want and model.decode(i) == text for s, i in got)


def test_very_long_runs(model):
    """A million letters without a gap, of one letter, of random letters and of letters no piece covers: whole, exact, within linear memory."""
    rng = random.Random(5)
    runs = ["a" * 1_000_000, "".join(rng.choice("abcdefgh") for _ in range(200_000)), "𝄞" * 100_000, "ab" * 50_000 + "," + "x" * 50_000]
    for run in runs:
        found = model.segmentations(run, 4)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and len({tuple(i) for _, i in found}) == len(found)
        assert all(model.decode(ids) == model.normalize(run) for _, ids in found)
    run = model.normalize("a" * 300 + "banana" * 50)
    best = [0.0]
    for end in range(1, len(run) + 1):
        best.append(max(best[at] + model.scores[run[at:end]][1] for at in range(max(0, end - model.longest), end) if run[at:end] in model.scores))
    assert model.nbest([run], 1)[0][0][0] == best[-1]


def test_encode_operator(spark, model):
    rows = [(1, None), (2, ""), (3, "ab  é𝄞\n<s>"), (4, "q" * 3000)]
    out = nbest.encode(docs(spark, *rows), 3).collect()
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append(r)
    assert [(len(got[i]), got[i][0]["ids"]) for i in (1, 2)] == [(1, []), (1, [])]
    for i, t in rows[2:]:
        assert len(got[i]) == 3 and {r["text"] for r in got[i]} == {model.normalize(t)}
        scores = [r["score"] for r in sorted(got[i], key=lambda r: r["rank"])]
        assert scores == sorted(scores, reverse=True)
    assert not nbest.encode(docs(spark, *rows).limit(0)).count() and not nbest.digests(docs(spark, *rows).limit(0)).count()


def test_digests_are_of_all_segmentations(spark, model, monkeypatch):
    rows = [(1, None), (2, ""), (3, "ab  é𝄞\n<s>"), (4, "q" * 300), (5, "on the hut, then")]
    want = defaultdict(list)
    for r in sorted(nbest.encode(docs(spark, *rows)).collect(), key=lambda r: r["rank"]):
        want[r["doc_id"]].append((zlib.crc32(np.array(r["ids"], "<u4").tobytes()), r["score"], len(r["ids"])))
    for r in nbest.digests(docs(spark, *rows)).collect():
        assert [r["ids_crc32"], *r["others_crc32"]] == [c for c, _, _ in want[r["doc_id"]]] and r["round_trip"]
        assert [r["score"], *(r["score"] - x for x in r["losses"])] == pytest.approx([s for _, s, _ in want[r["doc_id"]]])
        assert [r["n_pieces"], *r["others_pieces"]] == [k for _, _, k in want[r["doc_id"]]]
    assert {len(want[i]) for i in (3, 4, 5)} == {nbest.N}
    # A wrong alternative of the last rank is seen.
    joint = model.joint
    monkeypatch.setattr(model, "joint", lambda *a: [*(found := joint(*a))[:-1], (found[-1][0], ((0, (model.scores["x"][0],)),))])
    normal = [model.normalize("on the hut")]
    decoded = model.decode_all([ids for _, ids in model.nbest(normal, 4)[0]])
    assert [x == normal[0].encode() for x in decoded] == [True, True, True, False]


# --- perplexity ------------------------------------------------------------------------------------------------------


def brute_model(trained):
    """Interpolated modified Kneser-Ney over bytes, by the book: p(letter, what goes before)."""
    n = perplexity.ORDER
    counts = {n: defaultdict(int)}
    for t in trained:
        data = b"\n" * (n - 1) + t.lower() + b"\n"
        for i in range(len(data) - n + 1):
            counts[n][data[i : i + n]] += 1
    for k in range(n - 1, 0, -1):
        counts[k] = defaultdict(int)
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1

    def cuts(k):
        m = [0] + [sum(c == i for c in counts[k].values()) for i in range(1, 5)]
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else 0
        out = []
        for i in (1, 2, 3):
            d = i - (i + 1) * y * m[i + 1] / m[i] if m[i] and m[i + 1] and m[1] else 0.5 * i
            out.append(min(max(d, 0.05), i - 0.05))
        return out

    rate = {k: cuts(k) for k in counts}

    def p(gram, k=n):
        if k == 0:
            return 1 / 256
        own = gram[-k:]
        heirs = {g: c for g, c in counts[k].items() if g[:-1] == own[:-1]}
        lower = p(gram, k - 1)
        if not heirs:
            return lower
        cut = lambda c: rate[k][min(c, 3) - 1]
        return (max(heirs[own] - cut(heirs[own]), 0) if own in heirs else 0) / sum(heirs.values()) + sum(map(cut, heirs.values())) / sum(heirs.values()) * lower

    return p


def test_perplexities_by_the_book(spark):
    rng = random.Random(6)
    texts = {i: " ".join(rng.choice(["the", "then", "he", "hat", "Tea"]) for _ in range(rng.randint(0, 12))) for i in range(40)}
    texts |= {100: None, 101: "zzz ### qqq", 102: "É"}
    d = docs(spark, *texts.items()).withColumn("lang", F.when(F.col("doc_id") == 102, None).otherwise("en"))
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(50)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    import zlib

    trained = [texts[i].encode() for i in range(30) if zlib.crc32(str(i).encode()) % 5]
    p = brute_model(trained)
    got = {r["doc_id"]: r for r in perplexity.quality(d, labels).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        data = b"\n" * (perplexity.ORDER - 1) + (t or "").lower().encode() + b"\n"
        steps = [data[k : k + perplexity.ORDER] for k in range(len(data) - perplexity.ORDER + 1)]
        want = 256.0 if i == 102 else math.exp(-sum(math.log(p(g)) for g in steps) / len(steps))
        assert got[i]["perplexity"] == pytest.approx(want, rel=1e-9), (i, t)
    assert got[101]["kept"] is False and sum(r["kept"] for r in got.values()) > 15


def test_perplexity_without_trusted_text(spark):
    d = docs(spark, (1, "a"), (2, None))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = perplexity.quality(d, labels).collect()
    assert [(r["perplexity"], r["kept"]) for r in out] == [(pytest.approx(256.0), True)] * 2
    assert perplexity.quality(d.limit(0), labels).count() == 0


def test_small_languages_have_thresholds_of_their_own(spark):
    rng = random.Random(8)
    common = lambda words: " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, common(["the", "then", "hat"]), "en") for i in range(900)] + [(i, common([f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]), "xx") for i in range(1000, 1150)]
    rows += [(2000, "the hat", "yy"), (2001, "qqq", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] < 2000], "doc_id long, quality int, toxic int")
    got = perplexity.quality(d, labels).collect()
    bounds = {lang: {(r["low"], r["high"]) for r in got if r["lang"] == lang} for lang in ("en", "xx", "yy", None)}
    assert all(len(b) == 1 for b in bounds.values()) and bounds["yy"] == bounds[None]
    import zlib

    for lang in ("en", "xx"):
        held = [r["perplexity"] for r in got if r["lang"] == lang and not zlib.crc32(str(r["doc_id"]).encode()) % 5]
        w = len(held) / (len(held) + perplexity.POOLED)
        for mine, common_, own in zip(next(iter(bounds[lang])), next(iter(bounds["yy"])), (min(held), max(held)), strict=True):
            assert mine == pytest.approx(common_ + w * (own - common_), rel=1e-9)
    assert bounds["xx"] != bounds["yy"]


# --- toxicity --------------------------------------------------------------------------------------------------------


def toxic_corpus(spark, n=700):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["vile", "Vermin,", "filth!"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs(spark, *rows, (n, None), (n + 1, "")), spark.createDataFrame([*labels, (None, 1, 1), (10**6, 1, 1)], "doc_id long, quality int, toxic int")


def test_held_out_toxicity(spark):
    d, labels = toxic_corpus(spark)
    rows = toxicity.classify(d, labels).select("row.doc_id", "score", "rejected", toxicity.held_out(F.col("row.doc_id")).alias("held")).collect()
    test = [r for r in rows if r["held"] and r["doc_id"] < 700]
    assert len(rows) == 702 and all(0 <= r["score"] <= 1 for r in rows)
    right = np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in test])
    assert right > 0.95
    assert np.mean([r["rejected"] for r in test if r["doc_id"] % 4 == 0]) > 0.8
    assert not [r for r in rows if r["doc_id"] >= 700 and r["rejected"]]


def test_toxicity_without_labels(spark):
    d, labels = toxic_corpus(spark, 20)
    for known in (labels.limit(0), labels.where("toxic = 0")):
        out = toxicity.classify(d, known).collect()
        assert {r["score"] for r in out} == {0.0} and not any(r["rejected"] for r in out)
    assert toxicity.classify(d.limit(0), labels).count() == 0


def test_scores_look_at_text_alone(spark):
    d, labels = toxic_corpus(spark, 200)
    m = toxicity.fit(d, labels)
    one = m.scores([b"w1 vile w2", b"", b"w1 vile w2", ("w3 " * 50_000).encode()])
    assert one[0] == one[2] and np.isfinite(one).all()
    # Neither a text's place nor its neighbours matter, however toxic they are.
    rng = random.Random(2)
    found = [" ".join(rng.choice(["vile", "w1", "w2", "w3"]) for _ in range(rng.randint(0, 60))).encode() for _ in range(200)] + [b"", b"vile vile"]
    assert m.scores(found).tolist() == [float(m.scores([t])[0]) for t in found]
    assert m.scores([b"w1 w2", b"vile vile"])[0] == m.scores([b"w1 w2", b"w1"])[0]


# --- archives --------------------------------------------------------------------------------------------------------


def pages(spark, n=90, **changed):
    return spark.createDataFrame([(i, f"http://h/{i}", changed.get(f"p{i}", f"<p>{i} é</p>\r\n\r\n" * (i % 4))) for i in range(n)], "page_id long, url string, html string").repartition(3)


def test_archives_round_trip(spark):
    p = pages(spark).unionByName(spark.createDataFrame([(None, None, None), (5, "http://again", "x")], "page_id long, url string, html string"))
    found = warc.records(p, 32)
    back = {(r["file"], r["offset"]): (r["length"], r["uri"], r["body"].decode()) for r in warc.read(warc.archive(found)).collect()}
    index = found.collect()
    assert {(r["file"], r["offset"]): r["length"] for r in index} == {k: v[0] for k, v in back.items()}
    assert sorted((u, b) for _, u, b in back.values()) == sorted((r["url"] or "", r["html"] or "") for r in p.collect())
    for content in (b"junk", warc.archive(found).first()["content"][:-3]):
        with pytest.raises(ValueError):
            warc.parse(content)


def test_audit_finds_the_damage_and_nothing_else(spark):
    one = warc.records(pages(spark), 32).drop("record").cache()
    assert warc.audit(one, warc.records(pages(spark), 32)).count() == 0
    bad = warc.records(pages(spark, p3="<p>3 !!</p>\r\n\r\n" * 3, p70="<p>70 ??</p>\r\n\r\n" * 2), 32)
    assert {(r["file"], r["n"], r["status"]) for r in warc.audit(one, bad).collect()} == {(0, 3, "changed"), (2, 6, "changed")}
    fewer = warc.records(pages(spark, 89), 32)
    assert {(r["file"], r["n"], r["status"]) for r in warc.audit(one, fewer).collect()} == {(2, 25, "missing")}
    assert {(r["file"], r["n"], r["status"]) for r in warc.audit(fewer, one).collect()} == {(2, 25, "extra")}


def test_audit_of_stored_bytes(spark):
    found = warc.records(pages(spark), 32).cache()
    whole = {r["file"]: bytes(r["content"]) for r in warc.archive(found).collect()}
    at = {(r["file"], r["n"]): (r["offset"], r["length"]) for r in found.collect()}
    stored = lambda files: warc.stored(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "file long, content binary"), found)
    one = stored(whole).cache()
    index = {(r["file"], r["n"]): (r["offset"], r["length"], r["record_sha256"]) for r in found.collect()}
    assert {(r["file"], r["n"]): (r["offset"], r["length"], r["record_sha256"]) for r in one.collect()} == index

    def bad(files):
        return {(r["file"], r["n"], r["status"]) for r in warc.audit(one, stored(files)).collect()}

    assert bad(whole) == set()
    flipped = {k: bytearray(v) for k, v in whole.items()}
    flipped[0][at[0, 0][0]] ^= 1  # the word WARC
    flipped[0][flipped[0].index(b"Content-Length: ", at[0, 7][0]) + 16] ^= 1
    flipped[2][sum(at[2, 5]) - 1] ^= 1  # the separator
    assert bad(flipped) == {(0, 0, "changed"), (0, 7, "changed"), (2, 5, "changed")}
    cut = whole | {1: whole[1][: at[1, 30][0] + 3], 2: whole[2] + b"more"}
    assert bad(cut) == {(1, 30, "changed"), (1, 31, "missing"), (2, 26, "extra")}
    assert bad({k: v for k, v in whole.items() if k != 2}) == {(2, i, "missing") for i in range(26)}
    assert bad({k: v for k, v in whole.items() if k}) == {(0, i, "missing") for i in range(32)}  # the first file
    rotten = warc.rotten(warc.archive(found), found)
    assert {(r["file"], r["n"]) for r in warc.audit(one, warc.stored(rotten, found)).collect()} == {(0, 5)}


def test_audit_reads_only_damaged_branches(spark, monkeypatch):
    """A replica that lost its first file: below the root, only that file's branch is looked at."""
    one = warc.records(pages(spark), 4).drop("record").cache()
    read, original = [], warc.materialize

    def watched(df, name, *rest):
        out = original(df, name, *rest)
        if name == "suspects":
            read.append(out.columns + [out.count()])
        return out

    monkeypatch.setattr(warc, "materialize", watched)
    found = {(r["file"], r["n"], r["status"]) for r in warc.audit(one, one.where("file > 0")).collect()}
    assert found == {(0, i, "missing") for i in range(4)}
    assert read == [["file", 16], ["file", 16], ["file", "node", 1], ["file", "node", 16]] or read[-2:] == [["file", "node", 1], ["file", "node", 16]]


def test_pages_without_ids_fill_files_of_bounded_size(spark):
    p = spark.range(300).selectExpr("cast(if(id % 3 = 0, id, null) AS long) AS page_id", "cast(id AS string) AS url", "repeat('x', cast(id AS int)) AS html", "id AS file", "'clash' AS n", "1 AS offset")
    one = warc.records(p, 32).cache()
    sizes = {r["file"]: r["count"] for r in one.groupBy("file").count().collect()}
    assert sum(n for f, n in sizes.items() if f < 0) == 200 and max(sizes.values()) < 64 and sum(f < 0 for f in sizes) == 7
    assert warc.audit(one, one).count() == 0
    assert {(r["file"] < 0, r["status"]) for r in warc.audit(one, one.where("not (file < 0 and n = 3)")).collect()} == {(True, "missing")}
    long = spark.createDataFrame([(1, "u", "y" * 3_000_000), (2, "u", "z")], "page_id long, url string, html string")
    back = {r["offset"]: len(r["body"]) for r in warc.read(warc.archive(warc.records(long))).collect()}
    assert sorted(back.values()) == [1, 3_000_000]


def test_empty_archive(spark):
    none = warc.records(pages(spark).limit(0))
    assert warc.audit(none, none).count() == 0 and warc.archive(none).count() == 0
    assert warc.audit(warc.records(pages(spark, 2)), none).count() == 2
