"""Best-fit packing of token sequences in bulk-synchronous steps.

Documents become pieces of at most ``capacity`` tokens. Pieces in order of length, and gaps in order of size, form at
most ``capacity`` runs of equal values each, so the range-sorted order of all rows is known from one count a length.
Each step takes one run of equal pieces, the longest left, and sweeps it over its successors: the smallest gap that
fits takes the first pieces by rank, then the next larger gap, and new sequences take what is left. Pieces that want
one gap are told apart by their rank alone; then the gaps are updated and the next step begins. This is exactly
sequential best-fit decreasing, yet what the steps handle has a size that depends on the capacity and not on the data.
Only one pass handles rows: it ranks them within their length, in buckets of bounded size, and looks up their place.

Defined results: a null or empty text is one piece that holds the end token alone; rows that repeat a doc_id are packed
each (which of them takes which place is open); a text of any length is encoded whole and cut into pieces; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sealfold.llm import wordhash
from sealfold.llm.common import documents, in_arrow, materialize
from sealfold.llm.token_counts import texts, tokenizer_path

CAPACITY, END = 2048, 0
#: Rows of one length that are ranked in one task.
RANKED_ROWS = 200_000
#: Words, and ids of words, that a worker keeps; beyond that it starts over. Bounds on memory only.
KEPT_WORDS, KEPT_IDS = 250_000, 2_000_000
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d"
ASCII_WORDS = re.compile(rf"{_WORDS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
LATIN_WORDS = regex.compile(rf"{_WORDS}|[\p{{L}}]+|[\p{{N}}]|[^\p{{White_Space}}\p{{L}}\p{{N}}]+")
#: Below U+0250 there is nothing to compose, and lower-casing looks at one letter at a time.
NOT_LATIN = re.compile("[^\x00-ɏ]")


#: What bytes are to the word pattern, for lower-cased text: white space, letters (all beyond ASCII), digits, others.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(9, 14), 32]] = 0
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2
#: Texts in which bytes don't tell the words: contractions, special tokens, letters beyond U+024F, and signs from U+0080 on.
_NOT_PLAIN_ASCII = re.compile("'[stmdrvl]|<\\|")
_NOT_PLAIN = re.compile("'[stmdrvl]|<\\||[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers, by a file of the tokenizers library.

    With ``words_alone`` the file is the lower-casing word vocabulary, whose words are encoded independently: each
    distinct word is encoded once, and texts are put together from its ids by array operations over their bytes. Texts
    whose words bytes don't tell are cut by the pattern, and those with letters that need composing, or with special
    tokens, go to the library whole.
    """

    def __init__(self, path: str, words_alone: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.words_alone = Tokenizer.from_file(path), words_alone
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """No words yet: their hashes, ascending; of each, where its ids begin and how many there are; the ids."""
        self.hashes, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 14, "<u4"), 0

    def _whole(self, found: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(found, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of them in each). Many words go as one text, which is cut again where tokens end a word."""
        ids = np.concatenate(self._whole([" ".join(words[i : i + 512]) for i in range(0, len(words), 512)]))
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) == len(words) and ends[-1] == len(ids) - 1:
            return ids, np.diff(ends, prepend=-1)
        each = self._whole(words)
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids, sizes = self._words(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.hashes, hashes)
        self.begins = np.insert(self.begins, at, self.used + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.used += len(ids)

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of hashes among the known, whether they are known)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def _plain(self, found: list[bytes]) -> list[bytes]:
        """Ids of lower-cased texts whose words are runs of one class of bytes, digits one by one."""
        data = np.frombuffer(b" ".join(found), np.uint8)
        kind = _CLASS[data]
        cut = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2), [True]])
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        word = kind[starts] != 0 if len(data) else np.zeros(0, bool)
        starts, ends = starts[word], ends[word]
        distinct, first, which = np.unique(wordhash.spans(data, starts, ends), return_index=True, return_inverse=True)
        place, known = self._known(distinct)
        if not known.all():
            if len(self.hashes) > KEPT_WORDS or self.used > KEPT_IDS:
                self._forget()
                known[:] = False
            new, raw = np.flatnonzero(~known), data.tobytes()
            self._learn(distinct[new], [raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            place, _ = self._known(distinct)
        begin, size = self.begins[place][which], self.sizes[place][which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
        at = np.cumsum([0, *(len(t) + 1 for t in found)])
        text_ends = total[np.searchsorted(starts, at)]
        return [ids[s:e].tobytes() for s, e in zip(text_ends[:-1], text_ends[1:], strict=True)]

    def _cut(self, text: str) -> bytes:
        words = (ASCII_WORDS if text.isascii() else LATIN_WORDS).findall(text)
        return b"".join(x.tobytes() for x in self._whole(words)) if words else b""

    def __call__(self, found: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(found)
        low = [t.lower() for t in found]
        plain = [i for i, t in enumerate(low) if self.words_alone and not (_NOT_PLAIN_ASCII if t.isascii() else _NOT_PLAIN).search(t)]
        for first, chunk in wordhash.chunks([low[i].encode() for i in plain]):
            for i, ids in zip(plain[first : first + len(chunk)], self._plain(chunk), strict=True):
                out[i] = ids
        taken = set(plain)
        rest = [i for i in range(len(found)) if i not in taken]
        cut = [i for i in rest if self.words_alone and "<|" not in found[i] and not NOT_LATIN.search(found[i])]
        for i in cut:
            out[i] = self._cut(low[i])
        taken.update(cut)
        whole = [i for i in rest if i not in taken]
        for i, ids in zip(whole, self._whole([found[i] for i in whole]), strict=True):
            out[i] = ids.tobytes()
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, words_alone: bool) -> Encoder:
    """One encoder a process and file."""
    if (path, words_alone) not in _ENCODERS:
        _ENCODERS[path, words_alone] = Encoder(path, words_alone)
    return _ENCODERS[path, words_alone]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = END, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids (little-endian unsigned 32-bit) for each piece of each document."""
    words_alone = path is None
    path = path or tokenizer_path("word_bpe_49k.json")
    last = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, words_alone)
        for part, found in texts(batches, 256):
            rows: list[tuple] = []
            for doc, ids in zip(part.column(0).to_pylist(), encode(found), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, k, k * capacity, len(own) // 4, zlib.crc32(own), own))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: len(names)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit steps over counts of lengths: rows (length, first rank, first sequence, pieces a sequence, first offset).

    Pieces of a length from a row's first rank up to the next row's go to its sequences, so many to each, one behind the other.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    sizes: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            if full:
                out.append((length, rank, first, each, capacity - gap))
            if rest:
                out.append((length, rank + full * each, first + full, rest, capacity - gap))
            put(gap - each * length, first, full)
            put(gap - rest * length, first + full, 1 if rest else 0)
            put(gap, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + full * each + rest, left - full * each - rest
    return np.array(out, np.int64).reshape(-1, 5)


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. ``found`` is read three times: pass a stored table."""
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most capacity rows
    steps = plan(counts, capacity)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    keys = steps[:, 0] << 48 | steps[:, 1]
    split = F.lit([1 + counts.get(n, 0) // RANKED_ROWS for n in range(capacity + 1)])
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(split, F.col("length").cast("int") + 1)).cast("int"))
    # One row for each length and RANKED_ROWS rows: capacity + rows / RANKED_ROWS of them.
    sizes = sorted((r["length"], r["bucket"], r["count"]) for r in dealt.groupBy("length", "bucket").count().collect())
    counted = np.array(sizes, np.int64).reshape(-1, 3)
    dealt_keys = counted[:, 0] << 32 | counted[:, 1]
    total = np.cumsum(counted[:, 2]) - counted[:, 2]  # pieces of lesser lengths and buckets; less those of lesser lengths
    before = total - total[np.searchsorted(counted[:, 0], counted[:, 0])]
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")))
    names = [c for c in found.columns if c not in ("sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, bucket, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "bucket", "rank"))
            rank = rank - 1 + before[np.searchsorted(dealt_keys, length << 32 | bucket)]
            row = steps[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes if c in names)
    return in_arrow(ranked, run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs."""
    return place(materialize(pieces(docs, capacity, path, end, with_ids=False), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = END) -> DataFrame:
    """sequence_id and ids (binary) of the packed sequences, from the documents and their pieces' places. doc_id must be unique."""
    rows = pieces(docs, capacity, path, end).select("doc_id", "piece", "ids").join(placed, ["doc_id", "piece"])
    parts = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # capacity tokens at most
    return parts.select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
