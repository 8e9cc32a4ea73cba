"""Hashes of the words and shingles of many texts at once, over their UTF-8 bytes.

A word's hash is a polynomial in an odd base modulo 2**64, taken from one running sum over all bytes and then mixed; so
the cost is a few array operations a byte, whatever the words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE, _STEP, _SALT = 0x9E3779B97F4A7C55, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9
#: Bytes handled at once; a longer text is still handled whole.
CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n of each. Those of very long texts aren't kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 2**64))]
    if n <= 2 * CHUNK:
        _powers[:] = made
    return made[0], made[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h + np.uint64((salt * _BASE + _SALT) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """The hash of each span of bytes (or code points); ``fold`` maps bytes first."""
    n = len(data)
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((data if fold is None else fold[data]).astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[bytes], space: np.ndarray = _SPACE, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text). Words are runs of bytes outside ``space``; ``fold`` maps bytes first."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    gap = np.concatenate([[True], space[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    h = spans(data, starts, ends, fold)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(at, starts, side="right") - 1


def words_and_heads(texts: list[bytes], head: int, space: np.ndarray = _SPACE, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash of its first ``head`` bytes, index of its text)."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    gap = np.concatenate([[True], space[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return spans(data, starts, ends, fold), spans(data, starts, np.minimum(ends, starts + head), fold), np.searchsorted(at, starts, side="right") - 1


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each distinct shingle of each text, offsets of the texts in it), ascending within a text.

    Shingles are runs of ``size`` words; a shorter text is one shingle, a text without words has none.
    """
    h, doc = words(texts)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    whole = len(h) - size + 1
    if whole > 0:
        run = np.zeros(whole, np.uint64)
        for k in range(size):
            run = run * np.uint64(_STEP) + h[k : k + whole]
        same = doc[:whole] == doc[size - 1 :]
        run, of = mix(run[same], size), doc[:whole][same]
    else:
        run, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        own = []
        for i in short:
            x = 0
            for w in h[first[i] : first[i] + count[i]].tolist():
                x = (x * _STEP + w) % 2**64
            own.append(int(mix(np.array([x], np.uint64), int(count[i]))[0]))
        run, of = np.concatenate([run, np.array(own, np.uint64)]), np.concatenate([of, short])
    order = np.lexsort((run, of))
    run, of = run[order], of[order]
    if len(run):
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (of[1:] != of[:-1])])
        run, of = run[new], of[new]
    return run, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int64)


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of runs of texts of about so many bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]
