"""Elias-Fano code of a non-decreasing sequence: near-minimal space, any elements by select."""

from __future__ import annotations

import struct

import numpy as np

_HEADER = struct.Struct("<QQBxxxxxxx")
_EVERY = 64
#: Where the one number j of a byte stands.
_PLACE = np.array([[*[k for k in range(8) if byte >> k & 1], *[0] * 8][:8] for byte in range(256)], np.int64)


class EliasFano:
    """n values in 0..universe take about n * (2.5 + log2(universe / n)) bits.

    Each value's low bits are packed side by side; its high bits are written in unary, so that value i is
    (select1(i) - i) << low | low bits i. The place of every 64th one bit is stored too, which makes select a
    short local scan; nothing is decoded ahead of it. An empty sequence is valid. ValueError for values that
    decrease or are negative, or 2^30 of them.
    """

    def __init__(self, n: int, universe: int, low: int, samples: np.ndarray, lows: np.ndarray, highs: np.ndarray):
        self.n, self.universe, self.low, self.samples, self.lows, self.highs = n, universe, low, samples, lows, highs
        padded = np.concatenate([lows, np.zeros(16, np.uint8)])
        self._eight, self._ninth = np.ndarray(len(lows) + 8, "<u8", padded, strides=(1,)), padded[8:]

    @classmethod
    def of(cls, values) -> EliasFano:
        v = np.asarray(values, dtype=np.int64)
        if len(v) and (v[0] < 0 or (np.diff(v) < 0).any()) or len(v) >= 1 << 30:
            raise ValueError("values must not decrease or be negative, nor be 2^30")
        n, universe = len(v), int(v[-1]) if len(v) else 0
        low = max(0, int(universe // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low)) & 1 if low else np.zeros((n, 0), np.int64)
        lows = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        unary = np.zeros((n + (universe >> low) + 1) if n else 0, np.uint8)
        places = (v >> low) + np.arange(n)
        unary[places] = 1
        return cls(n, universe, low, places[::_EVERY].astype("<u4"), lows, np.packbits(unary, bitorder="little"))

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_many(np.array([i]))[0])

    def select_many(self, at: np.ndarray) -> np.ndarray:
        """Values at these places, all at once: from the sample before each, bytes are passed until its one is in the next."""
        at = np.asarray(at, np.int64)
        sample = self.samples[at // _EVERY].astype(np.int64)
        byte, left = sample >> 3, at % _EVERY
        bits = self.highs[byte] & (np.uint8(255) << (sample & 7).astype(np.uint8))
        ones = np.bitwise_count(bits).astype(np.int64)
        todo = np.flatnonzero(ones <= left)
        while len(todo):
            left[todo] -= ones[todo]
            byte[todo] += 1
            bits[todo] = self.highs[byte[todo]]
            ones[todo] = np.bitwise_count(bits[todo])
            todo = todo[ones[todo] <= left[todo]]
        high = byte * 8 + _PLACE[bits, left] - at
        if not self.low:
            return high
        first = at * self.low
        shift = (first & 7).astype(np.uint64)
        raw = self._eight[first >> 3] >> shift | self._ninth[first >> 3].astype(np.uint64) << np.uint64(1) << (np.uint64(63) - shift)
        return high << self.low | (raw & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def to_bytes(self) -> bytes:
        return _HEADER.pack(self.n, self.universe, self.low) + self.samples.tobytes() + self.lows.tobytes() + self.highs.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, universe, low = _HEADER.unpack_from(data)
        samples, lows = -(-n // _EVERY), (n * low + 7) // 8
        body = np.frombuffer(data, np.uint8, offset=_HEADER.size + 4 * samples)
        return cls(n, universe, low, np.frombuffer(data, "<u4", samples, _HEADER.size), body[:lows], body[lows:])
