"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

Byte-pair encoding has a prefix property: of all ways to end the encoding of a prefix, exactly one last token is
compatible with the last token of what stands before it (two tokens are compatible when encoding their joined bytes
gives just those two). So the last token and the count of each prefix follow from shorter prefixes, and one pass over a
text answers every truncation and budget question about it without encoding again. Texts are cut by the tokenizer's
own pattern first; the dynamic programme runs over each distinct piece and its result is kept for the next occurrence.

Defined results: a null text counts as empty and has 0 tokens; rows are independent, so ties, repeated rows and
other columns don't matter; texts of any length are counted whole; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealfold.llm.common import documents, in_arrow

LIMIT = 512
#: Pieces whose counts a worker keeps; beyond that it starts over. A bound on memory only.
KEPT_PIECES = 1_000_000
_WS = r"\p{White_Space}"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_S = r"\t-\r "
ASCII_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{_S}A-Za-z0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class PrefixCounter:
    """Counts tokens of every prefix of texts for one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(token): i for token, i in model["model"]["vocab"].items()}
        self.bytes = {i: token for token, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["model"]["merges"]):
            x, y = raw(a), raw(b)
            self.merges[self.ids[x], self.ids[y]] = (rank, self.ids[x + y])
        self.longest = max(map(len, self.ids))
        self.specials = [x["content"] for x in model["added_tokens"] if x["special"]]
        self.special_pattern = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._counts = _Counts(self)

    def _merge(self, ids: list[int]) -> list[int]:
        """Plain byte-pair merging, for the few bytes of one or two tokens."""
        while len(ids) > 1:
            found = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
            if not found:
                break
            i = min(found)[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def _compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > KEPT_PIECES:
                self._pairs.clear()
            known = self._pairs[key] = self._merge([self.ids[bytes([x])] for x in self.bytes[a] + self.bytes[b]]) == [a, b]
        return known

    def _stands_alone(self, a: int) -> bool:
        if (known := self._whole.get(a)) is None:
            known = self._whole[a] = self._merge([self.ids[bytes([x])] for x in self.bytes[a]]) == [a]
        return known

    def piece(self, data: bytes) -> list[int]:
        """Token counts of every byte prefix of one piece, the empty one first."""
        ids, longest, last, counts = self.ids, self.longest, [-1], [0]
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(data[start:end])
                if token is not None and (self._compatible(last[start], token) if start else self._stands_alone(token)):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
        return counts

    @staticmethod
    def split(text: str) -> list[str]:
        return ASCII_PATTERN.findall(text) if text.isascii() else PATTERN.findall(text)

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return sum(map(self._counts.__getitem__, self.pieces(text)))

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text; a special token's string is a piece of its own."""
        if not any(s in text for s in self.specials):
            return self.split(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [*self.split(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.split(text[at:])

    def _within(self, piece: str) -> list[int]:
        """Counts of the prefixes of a piece that end after each of its code points, as the text cut there would have them."""
        counts, at, out = self.piece(piece.encode()), 0, []
        for c in piece:
            at += len(c.encode())
            out.append(counts[at])
        if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
            out[1] = self._counts["'"] + self._counts[piece[1]]
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of text[:i] for i from 0 to its length."""
        return self._from(self.pieces(text), 0)

    def _from(self, pieces: list[str], base: int) -> np.ndarray:
        out = [base]
        before, before_base = "", base
        for p in pieces:
            if p in self.specials:
                # Up to its last letter a special token is ordinary text, which may join the piece before it.
                part = [before_base + sum(self._counts[x] for x in self.split(before + p[:i])) for i in range(1, len(p))] + [base + 1]
                after = base + 1
            else:
                part = [base + x for x in self._within(p)]
                after = part[-1]
                if before.isspace() and p[0].isspace() and before not in self.specials:
                    # A run of white space gives its last letter to the next word only once that word begins.
                    part[0] = before_base + self._counts[before + p[0]]
            out += part
            before, before_base, base = p if p not in self.specials else "", base if p not in self.specials else after, after
        return np.array(out, np.int32)

    def count_and_fit(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of a text, and the code points of its longest prefix of at most limit tokens."""
        pieces = self.pieces(text)
        each = list(map(self._counts.__getitem__, pieces))
        total = sum(each)
        if total <= limit:
            return total, len(text)
        ends = np.cumsum(each)
        k = int(np.searchsorted(ends, limit, side="right"))  # the first piece that ends beyond the limit
        first = max(0, k - 2)  # what a cut changes reaches one piece back
        base = int(ends[first - 1]) if first else 0
        counts = self._from(pieces[first : k + 1], base)
        return total, sum(map(len, pieces[:first])) + int(np.flatnonzero(counts <= limit)[-1])


class _Counts(dict):
    """piece -> its tokens, filled as pieces are met."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        if len(self) > KEPT_PIECES:
            self.clear()
        n = 1 if piece in self.counter.specials else self.counter.piece(piece.encode())[-1]
        if len(piece) <= 64:
            self[piece] = n
        return n


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a process and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def texts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with their texts (null: empty), a few rows at a time to bound Python's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, [x or "" for x in part.column(part.schema.get_field_index("text")).to_pylist()]


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars: the code points of the longest prefix within the limit."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        count = counter(path)
        for part, found in texts(batches):
            got = [count.count_and_fit(t, limit) for t in found]
            n = pa.array([x[0] for x in got], pa.int64())
            fit = pa.array([x[1] for x in got], pa.int64())
            size = pa.array([len(t.encode()) for t in found], pa.int64())
            over = pa.array([x[0] > limit for x in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), size, n, over, fit], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and counts array<int>: the tokens of text[:i] at position i, for every i."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        count = counter(path)
        for part, found in texts(batches, 64):
            counts = pa.array([count.prefix_counts(t) for t in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), counts], ["doc_id", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, counts array<int>")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
