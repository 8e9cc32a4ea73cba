"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A text is normalised as the model prescribes and cut into units between letters that no piece has side by side, so every
segmentation is one of each unit. In a unit's lattice a forward Viterbi pass gives the best score of reaching each
position; these scores are exact heuristics for an A* search from the end backwards, which so meets the segmentations in
order of their scores. What A* would open one by one along a best completion is walked at once, and of the branches that
leave the walk only as many are kept as segmentations are still wanted: time and memory grow with the length of a unit and
no faster. The units' alternatives are joined in the same way, best first, into the N best segmentations of the whole text.
A letter that no piece covers is written as its bytes, for a penalty below every piece's score.

Scores are sums of the model's piece scores, which are whole numbers in these models, so ties are exact; of equal scores
the one whose pieces, compared as ids from the unit's end backwards, come first is better (bytes have the least ids), and of
equal changes to a text those of earlier units. Decoding gives the normalised text back, whichever segmentation is taken.

The model file is one of byte-pair merges, whose scores are ranks of merges. The segmentations here are the best by those
scores; the model's own library replays merges instead, and mostly ends at another segmentation of the same text.

Defined results: a null text counts as empty and has no pieces and one segmentation, the empty one; rows are
independent, so ties, repeated rows and other columns don't matter; an empty table gives an empty table; a text of any
length is segmented whole, and one unbroken run of a million letters takes some seconds and some hundred bytes a letter.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealfold.llm import wordhash
from sealfold.llm.common import documents, in_arrow
from sealfold.llm.token_counts import texts, tokenizer_path

MARK = "▁"
N = 4
#: Added to the least piece score for a letter that is written as bytes.
PENALTY = -10.0
#: Units and ids whose segmentations a worker keeps; beyond that it starts over. Bounds on memory only.
KEPT_UNITS, KEPT_IDS = 400_000, 4_000_000
#: Units up to this length are searched many at a time.
SHORT = 64
#: Letters of normalised text that are segmented together; a longer text is still segmented whole.
BATCH_LETTERS = 1 << 18
#: Letters below this have a row and a column in the table of neighbours, and so has the mark; others are never cut apart.
_TABLE = 0x250
_BASE = 0x9E3779B97F4A7C55

Segmentation = tuple[float, tuple[int, ...]]


class Lattice:
    """The pieces of a SentencePiece model and the search over them."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        apart = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i) for i in range(n)]
        self.pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.scores = {self.pieces[i]: (i, float(self.model.get_score(i))) for i in range(n) if not apart[i]}
        self.penalty = min(s for _, s in self.scores.values() if s > -1e6) + PENALTY
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.model.is_byte(i)}
        raw = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.encode() for i, p in enumerate(self.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.array([len(x) for x in raw], np.int64)
        self.raw_begins = np.cumsum(self.raw_sizes) - self.raw_sizes
        self.longest = max(map(len, self.scores))
        self.side_by_side = self._neighbours()
        #: By length in letters: hashes of the pieces, ascending, with their ids and scores.
        self.tables = []
        for size in range(1, self.longest + 1):
            found = sorted((self._hash(p), i, s) for p, (i, s) in self.scores.items() if len(p) == size)
            self.tables.append((np.array([x[0] for x in found], np.uint64), np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found])))
        self._forget()

    def _neighbours(self) -> np.ndarray:
        """Whether some piece has two letters side by side, by their places in the table."""
        out = np.ones((_TABLE + 2, _TABLE + 2), bool)
        out[: _TABLE + 1, : _TABLE + 1] = False
        for p in self.scores:
            at = self._places(np.array([ord(c) for c in p], np.uint32))
            out[at[:-1], at[1:]] = True
        return out

    @staticmethod
    def _places(letters: np.ndarray) -> np.ndarray:
        return np.where(letters == ord(MARK), _TABLE, np.where(letters < _TABLE, letters, _TABLE + 1)).astype(np.int64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c)) % 2**64
        return h

    # --- one unit ---------------------------------------------------------------------------------------------------

    def edges(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """For each end position, the (start, piece, score) of the pieces that end there. A letter written as bytes is -1 minus its code."""
        out: list[list[tuple[int, int, float]]] = [[]]
        for end in range(1, len(unit) + 1):
            here = [(s, *found) for s in range(max(0, end - self.longest), end) if (found := self.scores.get(unit[s:end]))]
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, -1 - ord(unit[end - 1]), self.penalty))
            out.append(here)
        return out

    def _arrays(self, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """edges() of a long unit as arrays: starts, pieces and scores by end, and where each end's begin."""
        letters = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size, run = len(letters), np.zeros(len(letters), np.uint64)
        starts, ends, pieces, scores = [], [], [], []
        for k in range(1, min(size, self.longest) + 1):
            run = run[: size - k + 1] * np.uint64(_BASE) + letters[k - 1 :]
            hashes, own, score = self.tables[k - 1]
            at = np.minimum(np.searchsorted(hashes, run), len(hashes) - 1) if len(hashes) else np.zeros(0, np.int64)
            hit = np.flatnonzero(hashes[at] == run) if len(hashes) else at
            starts.append(hit)
            ends.append(hit + k)
            pieces.append(own[at[hit]])
            scores.append(score[at[hit]])
            if k == 1:
                bare = np.ones(size, bool)
                bare[hit] = False
                bare = np.flatnonzero(bare)
                starts.append(bare)
                ends.append(bare + 1)
                pieces.append(-1 - letters[bare].astype(np.int64))
                scores.append(np.full(len(bare), self.penalty))
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=size + 1))])
        return np.concatenate(starts)[order], np.concatenate(pieces)[order], np.concatenate(scores)[order], first

    def search(self, unit: str, n: int) -> list[Segmentation]:
        """The n best segmentations of one unit, best first, as (score, ids)."""
        size = len(unit)
        if size > SHORT:
            start, piece, score, first = self._arrays(unit)
            last = np.repeat(np.arange(size + 1), np.diff(first))
            ahead, chosen = self._forward(start, piece, score, first)
            less = np.array(ahead)[last] - np.array(ahead)[start] - score
        else:
            found = self.edges(unit)
            first = [0]
            for here in found:
                first.append(first[-1] + len(here))
            flat = [e for here in found for e in here]
            start, piece, score = [e[0] for e in flat], [e[1] for e in flat], [e[2] for e in flat]
            ahead, chosen = self._forward(start, piece, score, first)
            less = [ahead[end] - ahead[s] - x for end, here in enumerate(found) for s, _, x in here]
        # A state is what it loses against the best, its pieces from the end, and its position; what is left costs ahead[position], exactly.
        states: list[tuple[float, list[int], int]] = [(0.0, [], size)]
        out: list[Segmentation] = []
        while states and len(out) < n:
            loss, back, at = heapq.heappop(states)
            began, visited = len(back), []
            while at:
                visited.append(at)
                e = chosen[at]
                back.append(int(piece[e]))
                at = int(start[e])
            out.append((ahead[size] - loss, tuple(self._written(back))))
            for more, _, depth, x, e in heapq.nsmallest(n - len(out), self._branches(first, piece, less, chosen, visited, back, began)):
                heapq.heappush(states, (loss + more, [*back[: abs(depth)], x], int(start[e])))
        return out

    @staticmethod
    def _branches(first, piece, less, chosen, visited, back, began) -> Iterator[tuple[float, int, int, int, int]]:
        """(loss, group, place, piece, edge) of what leaves a walk, ordered as the paths are: lesser pieces first where the walk begins, greater ones last."""
        for depth, at in enumerate(visited, began):
            own, taken = chosen[at], back[depth]
            for e in range(first[at], first[at + 1]):
                if e != own:
                    x = int(piece[e])
                    yield (float(less[e]), 0, depth, x, e) if x < taken else (float(less[e]), 1, -depth, x, e)

    @staticmethod
    def _forward(start, piece, score, first, window: int = 1 << 16) -> tuple[list[float], list[int]]:
        """The best score of reaching each position, and the edge it comes by: of equally good ones the one of the least piece."""
        ahead, chosen = [0.0], [0]
        listed = isinstance(start, list)
        for low in range(1, len(first) - 1, window):
            high = min(low + window, len(first) - 1)
            base = int(first[low])
            s, p, x = (a[base : int(first[high])] if listed else a[base : int(first[high])].tolist() for a in (start, piece, score))
            at = 0
            for end in range(low, high):
                top, edge = -np.inf, -1
                for e in range(at, int(first[end + 1]) - base):
                    total = ahead[s[e]] + x[e]
                    if total > top or total == top and p[e] < p[edge]:
                        top, edge = total, e
                at = int(first[end + 1]) - base
                ahead.append(top)
                chosen.append(base + edge)
        return ahead, chosen

    def _written(self, back: list[int]) -> Iterator[int]:
        """The ids of pieces from the end, in order; letters written as bytes become their bytes'."""
        for x in reversed(back):
            if x < 0:
                yield from (self.bytes[b] for b in chr(-1 - x).encode())
            else:
                yield x

    # --- many units -------------------------------------------------------------------------------------------------

    def _forget(self) -> None:
        """No units yet: their hashes, ascending; of each, the best segmentation's score, how much worse the second is, where its ids begin and how many there are; the ids."""
        self._hashes, self._score, self._loss = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        self._begin, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._ids, self._used = np.zeros(1 << 14, np.int32), 0
        self._others: dict[tuple[str, int], list[Segmentation]] = {}

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self._hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        return at, self._hashes[at] == hashes

    def learn(self, hashes: np.ndarray, units: list[str]) -> None:
        """Find the best segmentations of units that are not known yet, all units of a length at once."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        score, loss, count = np.zeros(len(units)), np.zeros(len(units)), np.zeros(len(units), np.int64)
        ids: list[tuple[int, ...]] = [()] * len(units)
        for size in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == size)
            for at in range(0, len(same), 4096):
                pick = same[at : at + 4096]
                if size <= SHORT:
                    found = self._learn_length([units[i] for i in pick.tolist()], size)
                else:
                    best = [self.others(units[i], 2) for i in pick.tolist()]
                    found = [(b[0][0], b[0][1], b[0][0] - b[1][0] if len(b) > 1 else np.inf) for b in best]
                for i, (total, own, less) in zip(pick.tolist(), found, strict=True):
                    score[i], loss[i], ids[i] = total, less, own
        count[:] = [len(x) for x in ids]
        flat = np.fromiter((t for x in ids for t in x), np.int32, int(count.sum()))
        while self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + len(flat)] = flat
        at = np.searchsorted(self._hashes, hashes)
        for name, values in (("_begin", self._used + np.cumsum(count) - count), ("_size", count), ("_score", score), ("_loss", loss), ("_hashes", hashes)):
            setattr(self, name, np.insert(getattr(self, name), at, values))
        self._used += len(flat)

    def _learn_length(self, units: list[str], size: int) -> list[tuple[float, tuple[int, ...], float]]:
        """(score, ids, how much worse the second is) of units of one length: rows are units, columns positions."""
        letters = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), size).astype(np.uint64)
        most, n = min(size, self.longest), len(units)
        scores, ids = [], []  # by length of piece, at its start
        run = np.zeros((n, size), np.uint64)
        for k in range(1, most + 1):
            run = run[:, : size - k + 1] * np.uint64(_BASE) + letters[:, k - 1 :]
            hashes, own, score = self.tables[k - 1]
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, run.ravel()), len(hashes) - 1)
                hit = hashes[at] == run.ravel()
                scores.append(np.where(hit, score[at], -np.inf).reshape(run.shape))
                ids.append(np.where(hit, own[at], 1 << 40).reshape(run.shape))
            else:
                scores.append(np.full(run.shape, -np.inf))
                ids.append(np.full(run.shape, 1 << 40))
        bare = np.isinf(scores[0])
        scores[0][bare], ids[0][bare] = self.penalty, 0  # as bytes; they have the least ids
        ahead = np.zeros((n, size + 1))
        length = np.zeros((n, size + 1), np.int64)
        for end in range(1, size + 1):
            reach = range(1, min(end, most) + 1)
            total = np.stack([ahead[:, end - k] + scores[k - 1][:, end - k] for k in reach])
            top = total.max(0)
            ahead[:, end] = top
            length[:, end] = np.where(total == top, np.stack([ids[k - 1][:, end - k] for k in reach]), 1 << 41).argmin(0) + 1
        back = np.full((n, size + 1), -np.inf)
        back[:, size] = 0
        for start in range(size - 1, -1, -1):
            back[:, start] = np.stack([scores[k - 1][:, start] + back[:, start + k] for k in range(1, min(size - start, most) + 1)]).max(0)
        at, row = np.full(n, size), np.arange(n)
        on_path = np.zeros((most + 1, n, size), bool)
        steps = []
        while (left := at > 0).any():
            k = np.where(left, length[row, at], 1)
            start = np.where(left, at - k, 0)
            on_path[k[left], row[left], start[left]] = True
            taken = np.full(n, -1, np.int64)
            for size_k in np.unique(k[left]):
                mine = left & (k == size_k)
                taken[mine] = ids[size_k - 1][row[mine], start[mine]]
            steps.append((taken, start))
            at = np.where(left, start, 0)
        second = np.full(n, -np.inf)
        for k in range(1, most + 1):
            through = ahead[:, : size - k + 1] + scores[k - 1] + back[:, k:]
            second = np.maximum(second, np.where(on_path[k][:, : size - k + 1], -np.inf, through).max(1))
        loss = ahead[:, size] - second
        taken, starts = np.array([x[0] for x in steps]).T[:, ::-1].tolist(), np.array([x[1] for x in steps]).T[:, ::-1].tolist()
        out = []
        for w, t, s, total, less in zip(units, taken, starts, ahead[:, size].tolist(), loss.tolist(), strict=True):
            if 0 in t:
                flat = tuple(b for i, at_ in zip(t, s, strict=True) if i >= 0 for b in ((i,) if i else tuple(self.bytes[x] for x in w[at_].encode())))
            else:
                flat = tuple(i for i in t if i >= 0)
            out.append((total, flat, less))
        return out

    def others(self, unit: str, n: int) -> list[Segmentation]:
        """search(), kept for the next occurrence of the unit."""
        if (found := self._others.get((unit, n))) is None:
            found = self._others[unit, n] = self.search(unit, n)
        return found

    # --- texts ------------------------------------------------------------------------------------------------------

    def normalize(self, text: str) -> str:
        """The model's normalisation, with word marks."""
        return self.model.normalize(text) if text else ""

    def split(self, normal: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters of all texts, edges of their units, edges of the texts among the units)."""
        letters = np.frombuffer("".join(normal).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.cumsum([0, *map(len, normal)])
        place = self._places(letters)
        cut = np.zeros(len(letters) + 1, bool)
        if len(letters):
            cut[1:-1] = ~self.side_by_side[place[:-1], place[1:]]
        cut[at] = True
        edges = np.flatnonzero(cut)
        return letters, edges, np.searchsorted(edges, at)

    def units(self, normal: str) -> list[str]:
        """The units of one normalised text."""
        _, edges, _ = self.split([normal])
        return [normal[s:e] for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def nbest(self, normal: list[str], n: int = N) -> list[list[tuple[float, np.ndarray]]]:
        """For each normalised text its n best segmentations, best first, as (score, ids)."""
        out: list[list[tuple[float, np.ndarray]]] = []
        at, size = 0, 0
        for i, t in enumerate(normal):
            if i > at and size + len(t) > BATCH_LETTERS:
                out += self._nbest(normal[at:i], n)
                at, size = i, 0
            size += len(t)
        return out + self._nbest(normal[at:], n)

    def _nbest(self, normal: list[str], n: int) -> list[list[tuple[float, np.ndarray]]]:
        letters, edges, text_edges = self.split(normal)
        starts, ends = edges[:-1], edges[1:]
        hashes = wordhash.spans(letters, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place, known = self._known(distinct)
        whole = "".join(normal)
        if not known.all():
            if len(self._hashes) > KEPT_UNITS or self._used > KEPT_IDS:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            self.learn(distinct[new], [whole[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            place, _ = self._known(distinct)
        if len(self._others) > KEPT_UNITS // 8:
            self._others.clear()
        place = place[which]
        begin, size, loss = self._begin[place], self._size[place], self._loss[place]
        tokens = np.concatenate([[0], np.cumsum(size)])
        ids = self._ids[np.arange(tokens[-1]) + np.repeat(begin - tokens[:-1], size)]
        scores = np.concatenate([[0.0], np.cumsum(self._score[place])])
        out = []
        for a, b in zip(text_edges[:-1].tolist(), text_edges[1:].tolist(), strict=True):
            own, base, total = ids[tokens[a] : tokens[b]], tokens[a], float(scores[b] - scores[a])
            found = []
            for less, changes in self.joint(lambda i, a=a: whole[starts[a + i] : ends[a + i]], loss[a:b], n):
                parts, done = [], 0
                for i, other in changes:
                    parts += [own[done : tokens[a + i] - base], np.array(other, np.int32)]
                    done = tokens[a + i + 1] - base
                found.append((total - less, np.concatenate([*parts, own[done:]]) if changes else own))
            out.append(found)
        # A long run's alternatives are of no use to other texts.
        for key in [k for k in self._others if len(k[0]) > SHORT]:
            del self._others[key]
        return out

    def joint(self, unit, losses: np.ndarray, n: int) -> list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]]:
        """The n best choices of a segmentation for each unit(i), as (loss against the best, ((i, ids), ...)).

        Only the n units that lose least by their second best segmentation can be changed by any of them, earlier units
        first among equals; so only these are searched for more.
        """
        least = np.argsort(losses, kind="stable")[:n].tolist() if n > 1 else []
        states: list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]] = [(0.0, ())]
        for i in sorted(i for i in least if losses[i] < np.inf):
            found = self.others(unit(i), n)
            states = heapq.nsmallest(n, ((loss + found[0][0] - score, (*changes, (i, ids)) if k else changes) for loss, changes in states for k, (score, ids) in enumerate(found)))
        return states

    def segmentations(self, text: str, n: int = N) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text, best first, as (score, ids)."""
        return [(score, ids.tolist()) for score, ids in self.nbest([self.normalize(text)], n)[0]]

    def decode(self, ids) -> str:
        """The normalised text, with word marks, that ids stand for."""
        return self.decode_all([np.asarray(ids, np.int64)])[0].decode()

    def decode_all(self, found: list[np.ndarray]) -> list[bytes]:
        """decode() of many segmentations, as bytes."""
        ids = np.concatenate([np.zeros(0, np.int64), *found])
        sizes = self.raw_sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.raw[np.arange(ends[-1]) + np.repeat(self.raw_begins[ids] - ends[:-1], sizes)]
        at = ends[np.cumsum([0, *map(len, found)])].tolist()
        return [data[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]


@lru_cache(1)
def lattice(path: str) -> Lattice:
    """One lattice a process; another model replaces it."""
    return Lattice(path)


def _found(batches, path: str, n: int):
    """(ids of documents, their normalised texts, their n best segmentations, what these decode to as bytes), some documents at a time."""
    model = lattice(path)
    for part, own in texts(batches, 256):
        normal = [model.normalize(t) for t in own]
        at, size = 0, 0
        for i in range(len(normal) + 1):
            if i == len(normal) or i > at and size + len(normal[i]) > BATCH_LETTERS:
                got = model.nbest(normal[at:i], n)
                flat = iter(model.decode_all([ids for one in got for _, ids in one]))
                yield part.column(0).slice(at, i - at), normal[at:i], got, [[next(flat) for _ in one] for one in got]
                at, size = i, 0
            size += len(normal[i]) if i < len(normal) else 0


def encode(docs: DataFrame, n: int = N, path: str | None = None) -> DataFrame:
    """doc_id, rank (1: the best), score, ids array<int> and text (decoded, with word marks) of the n best segmentations of each text."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    names = ["doc_id", "rank", "score", "ids", "text"]

    def run(batches):
        for docs_, _, got, decoded in _found(batches, path, n):
            rows = [(d, k, score, ids, text) for d, one, out in zip(docs_.to_pylist(), got, decoded, strict=True) for k, ((score, ids), text) in enumerate(zip(one, out, strict=True), 1)]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id long, rank int, score double, ids array<int>, text string")


def digests(docs: DataFrame, n: int = N, path: str | None = None) -> DataFrame:
    """encode(), a row a document: the pieces, score and CRC of the best segmentation, losses, pieces and CRCs of the following ones, and whether all decode to the text."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    schema = ["doc_id long", "n_pieces long", "score double", "ids_crc32 long", "losses array<double>", "others_pieces array<long>", "others_crc32 array<long>", "round_trip boolean"]

    def run(batches):
        for docs_, normal, got, decoded in _found(batches, path, n):
            crcs = [[zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in one] for one in got]
            columns = [
                docs_, pa.array([len(one[0][1]) for one in got], pa.int64()), pa.array([one[0][0] for one in got], pa.float64()), pa.array([c[0] for c in crcs], pa.int64()),
                pa.array([[one[0][0] - s for s, _ in one[1:]] for one in got], pa.list_(pa.float64())), pa.array([[len(ids) for _, ids in one[1:]] for one in got], pa.list_(pa.int64())),
                pa.array([c[1:] for c in crcs], pa.list_(pa.int64())), pa.array([all(x == t.encode() for x in out) for t, out in zip(normal, decoded, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, run, ", ".join(schema))


def op4_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its four best segmentations, as digests() gives them: pieces, scores and CRCs of all four, and whether each decodes to the text."""
    return digests(documents(spark, sf_dir))
