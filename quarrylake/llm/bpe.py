"""Byte-pair merges of many words at once, on arrays."""

from __future__ import annotations

import numpy as np

from .textops import HashTable, mix


class Merges:
    """The merges of a byte-level BPE model, given as its vocabulary and its list of pairs.

    ``words`` merges, in each round and in each word, the pair of least rank that stands farthest
    left, as the model itself does, until no word has a pair that merges."""

    NONE = 1 << 30

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], shown: dict[int, str], suffix: str = ""):
        """shown: the printable stand-in of each byte; suffix: what a word's last piece ends with."""
        self.inner, self.last = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        for b, c in shown.items():
            self.inner[b], self.last[b] = vocabulary.get(c, -1), vocabulary.get(c + suffix, -1)
        rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            rank[vocabulary[a], vocabulary[b]] = (k, vocabulary[a + b])
        pairs = np.array(list(rank), np.int64).reshape(-1, 2)
        self.table = HashTable(max(1, len(rank)))
        self.table.add(self._keys(pairs[:, 0], pairs[:, 1]))
        found = np.array(list(rank.values()), np.int64).reshape(-1, 2)
        # one more place for -1, a pair that does not merge
        self.rank, self.new = np.append(found[:, 0], self.NONE), np.append(found[:, 1], -1)

    @staticmethod
    def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        # a bijection, so that pairs are told apart; only the pair (0, 0) could give 0, and ids of pairs are not both 0
        return mix((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1))

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each) of non-empty words."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size) - 1
        ids = self.inner[raw]
        ids[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), size)
        done_ids, done_word = [], []
        # what pair k of symbols k, k + 1 is; -1 across words
        pair = np.full(len(ids), -1, np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        pair[inside] = self.table.find(self._keys(ids[inside], ids[inside + 1]))
        while len(ids):
            rank = self.rank[pair]
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, begin)
            live = least < self.NONE
            count = np.diff(np.append(begin, len(ids)))
            if not live.all():
                stop = np.repeat(~live, count)
                done_ids.append(ids[stop])
                done_word.append(word[stop])
                ids, word, pair, rank = ids[~stop], word[~stop], pair[~stop], rank[~stop]
                least, count = least[live], count[live]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # the leftmost of each word
            ids[hit] = self.new[pair[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols stand once the others are gone
            ids, word, pair = ids[stay], word[stay], pair[stay]
            pair[at] = -1
            n = len(ids)
            for left in (at, at - 1):
                left = left[(left >= 0) & (left + 1 < n)]
                left = left[word[left] == word[left + 1]]
                pair[left] = self.table.find(self._keys(ids[left], ids[left + 1]))
        flat, of = np.concatenate([*done_ids, ids]), np.concatenate([*done_word, word])
        order = np.argsort(of, kind="stable")
        return flat[order].astype(np.uint32), np.bincount(of, minlength=len(words))
