"""Word shingles of many texts at once, and their weights, by array arithmetic."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one.
_LONG = 512
_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[128:] = _IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = True
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of ASCII letters and digits and of other bytes than ASCII, A-Z as a-z), and the number of each text's.

    A word's bytes, eight at a time, are mixed one after another, so that no sums of powers can cancel out.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    padded = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = ends - starts
    hashes = mix((eight[starts] & _LOW_BYTES[np.minimum(size, 8)]) ^ mix(size.astype(np.uint64)))
    left, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(left):
        hashes[left] = mix(hashes[left] * _ODD ^ (eight[starts[left] + at] & _LOW_BYTES[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > _LONG).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(padded[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    borders = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, borders), prepend=0)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, one text after the other; how often each stands in it; each text's number.

    A text of fewer than five words has one shingle of all of them, one without words none.
    """
    words, counts = word_hashes(texts)
    many = np.maximum(counts - WORDS + 1, (counts > 0).astype(counts.dtype))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    left = np.repeat(first + counts, many)
    total = np.zeros(len(at), np.uint64)
    for k, factor in enumerate(_FACTORS):
        place = at + k
        there = place < left
        total += np.where(there, words[np.minimum(place, max(len(words) - 1, 0))] if len(words) else 0, np.uint64(k + 1)) * factor
    hashes = mix(total)
    ends = np.cumsum(many)
    for a, b in zip((ends - many).tolist(), ends.tolist()):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[(ends - many)[many > 0]] = True
    places = np.flatnonzero(new)
    times = np.diff(np.append(places, len(hashes)))
    upto = np.cumsum(np.concatenate([[0], new]))[np.concatenate([[0], ends])]
    return hashes[places], times, np.diff(upto)


def parts(texts: list[str], most: int = _BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes, in runs of about `most` bytes, with the place of each run's first."""
    run: list[bytes] = []
    size = at = 0
    for k, text in enumerate(texts):
        raw = text.encode()
        if run and size + len(raw) > most:
            yield at, run
            run, size, at = [], 0, k
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield at, run


class Weights:
    """TF-IDF weights of shingles, the document frequency taken from a count-min sketch of two rows.

    The inverse document frequency is scaled to 1 (one document) down to 1/2 (all of them), so that shared
    passages count less but copies in a large group of near copies still resemble each other.
    """

    ROWS, WIDTH = 2, 1 << 18

    def __init__(self, counts: np.ndarray, documents: int):
        counts = counts.reshape(self.ROWS, self.WIDTH).astype(np.float64)
        noise = np.median(counts, axis=1, keepdims=True)  # other shingles' share of a cell
        frequency = np.clip(counts - noise, 1, max(documents, 1))
        self.idf = (1 - 0.5 * np.log(frequency) / max(np.log(documents + 1), 1)).astype(np.float32)

    @classmethod
    def cells(cls, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> np.uint64(46)).astype(np.int64), (hashes >> np.uint64(28) & np.uint64(cls.WIDTH - 1)).astype(np.int64)

    def of(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        one, two = self.cells(hashes)
        return times.astype(np.float32) * np.maximum(self.idf[0][one], self.idf[1][two])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted arrays of hashes with weights; 1 for two empty ones."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    if total == 0:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    return common / (total - common)
