"""Vectorised hashing of words, shared by the operators that look at word sequences."""

from __future__ import annotations

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """P**0 .. P**(n-1) modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, P, np.uint64))])
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and where each word (a run of bytes other than 0x20, 0x09-0x0D) starts and ends."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], gap, [True]]).view(np.int8))
    return raw, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def rolling(values: np.ndarray) -> np.ndarray:
    """Sums s with s[j] - s[i] = sum of values[k] * P**k over i <= k < j, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [start, end); equal sequences hash alike wherever they stand."""
    n = len(sums) - 1
    # P**(n - start) moves every range to one common power
    return mix((sums[end] - sums[start]) * powers(n + 1)[n - start] * _inverse_power(n))


_INV = np.uint64(pow(int(P), -1, 1 << 64))


def _inverse_power(n: int) -> np.uint64:
    return np.uint64(pow(int(_INV), n, 1 << 64))


def word_sums(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, given the rolling sums of the bytes and where words start and end."""
    return mix(between(sums, start, end) + (end - start).astype(np.uint64) * P)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    raw, start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    return word_sums(rolling(raw.astype(np.uint64) + np.uint64(1)), start, end)


class HashTable:
    """64-bit keys to their order of arrival, by open addressing; all steps act on whole arrays.

    Words stand for themselves by a 64-bit hash: that a given new word is taken for one of a
    million known ones has probability 5e-14."""

    def __init__(self, most: int):
        self.mask = (1 << int(4 * most - 1).bit_length()) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.codes = np.zeros(self.mask + 1, np.int32)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Codes of keys (none of which is 0), -1 for unknown ones."""
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.codes[slot], np.int32(-1)).astype(np.int64)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        at = slot[open_]
        while len(open_):
            at = (at + 1) & self.mask
            there, want = self.keys[at], keys[open_]
            hit = there == want
            out[open_[hit]] = self.codes[at[hit]]
            on = ~hit & (there != 0)
            open_, at = open_[on], at[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct unknown keys, coded in their order."""
        codes = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            won = self.keys[at] == keys
            self.codes[at[won]] = codes[won]
            keys, codes, at = keys[~won], codes[~won], (at[~won] + 1) & self.mask
