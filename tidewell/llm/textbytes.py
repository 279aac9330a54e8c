"""Whole columns of text as byte arrays: normalised words, shingles and n-grams without a Python loop over characters."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: The modulus of word hashes, a prime.
PRIME = (1 << 61) - 1
#: A longer word is digested by blake2b, as the sums over its bytes would not fit.
LONG_WORD = 1 << 22
#: Bytes handled at once; bounds the temporary arrays at about 60 times this.
CHUNK = 1 << 20


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] = _LOWER[97:123]


def secret() -> int:
    """A base for word hashes that nobody knows beforehand: with it two given words have one hash in fewer than length / 2**61 cases."""
    return secrets.randbelow(PRIME - 2**40) + 2**40


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def _times(x: np.ndarray, y: int) -> np.ndarray:
    """x * y modulo PRIME, of numbers below it."""
    low, high = np.uint64(0x7FFFFFFF), np.uint64(31)
    y0, y1 = np.uint64(y & 0x7FFFFFFF), np.uint64(y >> 31)
    x0, x1 = x & low, x >> high
    middle = _folded(x1 * y0 + x0 * y1)  # below 2**62
    return _folded(_folded(x1 * y1 * np.uint64(2)) + _folded(x0 * y0) + (middle >> np.uint64(30)) + ((middle & np.uint64(0x3FFFFFFF)) << high))


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The low 31 and the high 30 bits of the base's powers; ``size`` is a power of two."""
    out = np.array([1], np.uint64)
    while len(out) < size:
        out = np.concatenate([out, _times(out, pow(base, len(out), PRIME))])
    return out & np.uint64(0x7FFFFFFF), out >> np.uint64(31)


def _spans(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about CHUNK bytes that fall on rows' ends or on spaces; a longer word is not cut."""
    i, end = int(at[0]), int(at[-1])
    while i < end:
        j = i + CHUNK
        if j >= end:
            yield i, end
            return
        k = int(np.searchsorted(at, j, "right"))
        low = int(at[k - 1])
        if low > i and j - low < CHUNK // 2:
            j = low
        else:
            stop = int(at[k])
            while j < stop:
                found = np.flatnonzero(SPACE[raw[j : min(j + 4096, stop)]])
                if found.size:
                    j += int(found[0])
                    break
                j = min(j + 4096, stop)
        yield i, j
        i = j


def word_hashes(raw: np.ndarray, at: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, in order, and each row's offsets among the words.

    Words are what lies between bytes 32 and 9 to 13; A-Z count as a-z. A hash is the polynomial of a word's bytes at ``base``,
    modulo a prime: unlike one modulo a power of two, it has no words that collide whatever the base is.
    """
    hashes, starts = [], []
    edges = at[:-1]
    for i, j in _spans(raw, at):
        part = raw[i:j]
        word = ~SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = edges[np.searchsorted(edges, i) : np.searchsorted(edges, j)] - i  # a row's start begins a word
        first[inner[word[inner]]] = True
        begin = np.flatnonzero(first)
        if not begin.size:
            continue
        length = np.diff(np.append(begin, j - i))
        place = np.arange(begin[0], j - i) - np.repeat(begin, length)
        body = part[begin[0] :]
        longest = int(length.max())
        low, high = _powers(base, 1 << max(6, min(longest, LONG_WORD) - 1).bit_length())
        value = _LOWER[body]
        value[~word[begin[0] :]] = 0
        if longest > LONG_WORD:
            place = np.minimum(place, LONG_WORD - 1)
        edge = begin - begin[0]
        chars = np.add.reduceat(word[begin[0] :].astype(np.int64), edge)
        sums = _folded(np.add.reduceat(value * low[place], edge))
        sums = _folded(sums + _times(_folded(np.add.reduceat(value * high[place], edge)), 1 << 31))
        if longest > LONG_WORD:
            for k in np.flatnonzero(chars > LONG_WORD).tolist():
                text = _LOWER[body[edge[k] : edge[k] + chars[k]]].astype(np.uint8).tobytes()
                sums[k] = int.from_bytes(hashlib.blake2b(text, digest_size=8, key=base.to_bytes(8, "little")).digest(), "little")
        hashes.append(mixed(sums + chars.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        starts.append(begin + i)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    h, s = np.concatenate(hashes), np.concatenate(starts)
    return h, np.searchsorted(s, at).astype(np.int64)


def shingle_sets(column: pa.Array, width: int, base: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles.

    A row of fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    words, at = word_hashes(*as_bytes(column), base)
    n = len(words)
    runs = np.zeros(0, np.uint64)
    if n >= width:
        runs = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            runs = mixed(runs * np.uint64(0xA0761D6478BD642F) + words[k : n - width + 1 + k] + np.uint64(k + 1))
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= width:
            yield np.unique(runs[i : j - width + 1])
        elif j > i:
            h = np.zeros(1, np.uint64)
            for w in words[i:j]:
                h = mixed(h * np.uint64(0xE7037ED1A0B428DB) + w + np.uint64(width))
            yield mixed(h + np.uint64(j - i))
        else:
            yield runs[:0]
