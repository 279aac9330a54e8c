"""Elias-Fano coding of non-decreasing integers, with sampled positions for select."""

from __future__ import annotations

import struct

import numpy as np

#: Every so many ones of the upper bits a position is kept, in 4 bytes where that does: a sixteenth of a bit for each integer.
SAMPLE = 512
_HEAD = struct.Struct("<QBQQQ")


class EliasFano:
    """``n`` integers below ``universe`` in about ``2 + log2(universe / n)`` bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if bits else np.zeros((n, 0), np.uint8)
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
        marks[place] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(marks, bitorder="little"), place[::SAMPLE].astype(cls._kind((int(place[-1]) >> 3) + 1 if n else 0)))

    @staticmethod
    def _kind(high_bytes: int) -> str:
        return "<u4" if high_bytes < 1 << 29 else "<u8"

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int = 0) -> tuple[EliasFano, int]:
        """The code at ``at`` and the place behind it."""
        n, bits, a, b, c = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, cls._kind(b), c, at + a + b)
        return cls(n, bits, low, high, samples), at + a + b + samples.nbytes

    def _low_of(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        i, j = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[i >> 3 : (j + 7) >> 3], bitorder="little")[i & 7 :][: j - i].reshape(-1, self.low_bits)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, k: int) -> int:
        """The k-th integer, from the nearest sample on."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        place, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte = place >> 3
        while left:
            ones = byte * 8 + np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little"))
            ones = ones[ones > place]
            if len(ones) >= left:
                place, left = int(ones[left - 1]), 0
            else:
                left -= len(ones)
                byte += 64
                place = byte * 8 - 1
        return (place - k) << self.low_bits | int(self._low_of(k, k + 1)[0])

    def select_range(self, first: int, last: int) -> np.ndarray:
        """The integers first to last - 1, sample by sample."""
        out = [np.zeros(0, np.int64)]
        for s in range(first // SAMPLE, -(-last // SAMPLE)):
            low = int(self.samples[s])
            high = int(self.samples[s + 1]) if s + 1 < len(self.samples) else 8 * len(self.high)
            ones = (low >> 3 << 3) + np.flatnonzero(np.unpackbits(self.high[low >> 3 : (high + 7) >> 3], bitorder="little"))
            ones = ones[np.searchsorted(ones, low) :]
            i, j = max(first - s * SAMPLE, 0), min(last - s * SAMPLE, SAMPLE)
            out.append(ones[i:j] - np.arange(s * SAMPLE + i, s * SAMPLE + j))
        upper = np.concatenate(out).astype(np.uint64)
        return upper << np.uint64(self.low_bits) | self._low_of(first, last) if last > first else upper
