"""Segmentation into pieces of a SentencePiece vocabulary: N-best encoding, and decoding.

The lattice of a text has a node between any two characters and an edge for each piece. Forward
Viterbi gives every node the best score from the start. Backward A* starts at the end with that
score as its heuristic, which is exact, so the k-th hypothesis to reach the start is the k-th best.

No piece has the space mark behind another character, so the lattice is a chain of units, each
the marks before a word and the word. A worker solves each distinct unit once: its best, and what
its second best costs more. The N best of a text deviate from its best in the N-1 units where that
is least, and only those units are searched for their own N best.
"""

from __future__ import annotations

import heapq
import math
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package
from .caches import claim
from .textops import HashTable, rolling, word_sums
from .wordmemo import vocabulary_path

NBEST = 4
MARK = "▁"
_UNIT = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Vocabulary:
    """Pieces with scores, and what is known of the units seen so far; all of it bounded."""

    LIMIT = 400_000

    def __init__(self, path: str | None, nbest: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(path, "piece_bpe_32k.model"))
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {model.id_to_piece(i): i for i in normal}
        # a score below -1e8 marks a piece that no merge makes: it ranks behind all others, as bytes do
        known = [model.get_score(i) for i in normal if model.get_score(i) > -1e8]
        self.floor = min(known) - 10.0
        self.score = {p: max(model.get_score(i), self.floor) for p, i in self.id.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        text = {i: p.replace(MARK, " ").encode() for p, i in self.id.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        shown = [text.get(i, b"") for i in range(model.get_piece_size())]
        self.text_bytes, self.text_length = np.frombuffer(b"".join(shown), np.uint8), np.array(list(map(len, shown)), np.int64)
        self.text_start = np.cumsum(self.text_length) - self.text_length
        if any(MARK in p[1:].lstrip(MARK) or (p.strip(MARK) and p.startswith(MARK * 2)) or "\n" in p for p in self.id):
            raise ValueError("a piece has a mark or a newline inside, so words are not segmented apart with this vocabulary")
        if len(self.byte) < 256:
            raise ValueError("the vocabulary lacks pieces for bytes")
        self.begins = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        # every beginning of a piece; what is no piece itself stands for nothing
        self.table = {p: (self.score[p], (self.id[p],)) if p in self.id else () for p in self.begins}
        self.inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        # the trie of the pieces, as sorted (node, character) keys; node 0 is the root
        node = {"": 0} | {p: k for k, p in enumerate(sorted(self.begins), 1)}
        steps = sorted((node[p[:-1]] << 21 | ord(p[-1]), node[p]) for p in node if p)
        self.step_key, self.step_node = (np.array(x, np.int64) for x in zip(*steps))
        self.node_id, self.node_score = np.full(len(node), -1, np.int64), np.zeros(len(node))
        for p, i in self.id.items():
            self.node_id[node[p]], self.node_score[node[p]] = i, self.score[p]
        self.nbest = nbest
        self.parts: dict[str, tuple[float, float, tuple[int, ...]]] = {}
        self.lists: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.held = 0  # ids in lists
        self.clear()

    def clear(self) -> None:
        self.code, self.names = HashTable(self.LIMIT), []
        self.best = self.gap = np.zeros(0)
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lattice(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """(start, score, ids) of the edges into each node. A character without a piece is its bytes."""
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(unit) + 1)]
        for start in range(len(unit)):
            end = start + 1
            while end <= len(unit) and (p := unit[start:end]) in self.begins:
                if (i := self.id.get(p)) is not None:
                    into[end].append((start, self.score[p], (i,)))
                end += 1
            if not into[start + 1] or into[start + 1][-1][0] != start:
                into[start + 1].append((start, self.floor, tuple(self.byte[b] for b in unit[start].encode("utf-8", "replace"))))
        return into

    @staticmethod
    def forward(into) -> list[float]:
        best = [0.0]
        for edges in into[1:]:
            best.append(max([best[start] + score for start, score, _ in edges]))
        return best

    def search(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a unit, best first. Backward A* with exact heuristics."""
        into = self.lattice(unit)
        best = self.forward(into)
        out: list[tuple[float, tuple[int, ...]]] = []
        # of equal totals the newest goes first, so the first path found is that of part(); a path is
        # its first piece and the rest of it, shared by all that end alike
        heap, turn = [(-best[-1], 0, len(unit), 0.0, None)], 0
        while heap and len(out) < n:
            total, _, at, behind, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((-total, tuple(ids)))
                continue
            for start, score, piece in into[at]:
                turn -= 1
                heapq.heappush(heap, (-(best[start] + score + behind), turn, start, score + behind, (piece, path)))
        return out

    def joined(self, parts: list[str]) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of parts that no piece connects, best first, from those of each, as encode joins units."""
        solved, n = [self.part(p) for p in parts], self.nbest
        base = sum(p[0] for p in solved)
        near = heapq.nsmallest(n - 1, ((p[1], k) for k, p in enumerate(solved) if math.isfinite(p[1])))
        best: list[tuple[float, int, dict[int, tuple[int, ...]]]] = [(0.0, 0, {})]
        for _, k in near:
            choices = self.list_of(parts[k])
            top, pieces = choices[0][0], len(choices[0][1])
            found = ((c + top - s, m + len(i) - pieces, {**w, k: i} if j else w) for c, m, w in best for j, (s, i) in enumerate(choices))
            best = heapq.nsmallest(n, found, key=lambda x: x[:2])
        return [(base - c, tuple(chain.from_iterable(w.get(k, p[2]) for k, p in enumerate(solved)))) for c, _, w in best]

    def part(self, unit: str) -> tuple[float, float, tuple[int, ...]]:
        """(score of the best, what the second best costs more, ids of the best).

        The second best has an edge off the best path; the best path through an edge is known
        from Viterbi scores in both directions."""
        found = self.parts.get(unit)
        if found is not None:
            return found
        n, table = len(unit), self.table
        best, via, edges = [0.0] + [-math.inf] * n, [0] * (n + 1), []
        # edges come in the order of their start, whose score is final by then
        for start in range(n):
            b, end, alone = best[start], start + 1, True
            while end <= n:
                e = table.get(unit[start:end])
                if e is None:
                    break
                if e:
                    x = b + e[0]
                    if x >= best[end]:
                        best[end], via[end] = x, len(edges)
                    edges.append((start, end, e[0], e[1]))
                    alone = alone and end > start + 1
                end += 1
            if alone:
                x = b + self.floor
                if x >= best[start + 1]:
                    best[start + 1], via[start + 1] = x, len(edges)
                edges.append((start, start + 1, self.floor, tuple(self.byte[c] for c in unit[start].encode("utf-8", "replace"))))
        back = [-math.inf] * n + [0.0]
        for start, end, score, _ in reversed(edges):
            x = score + back[end]
            if x > back[start]:
                back[start] = x
        path, at, own = [], n, set()
        while at:
            own.add(via[at])
            path.append(edges[via[at]][3])
            at = edges[via[at]][0]
        off = [best[e[0]] + e[2] + back[e[1]] for k, e in enumerate(edges) if k not in own]
        found = best[n], best[n] - max(off) if off else math.inf, tuple(chain.from_iterable(reversed(path)))
        if len(self.parts) >= self.LIMIT:
            self.parts.clear()
        self.parts[unit] = found
        return found

    def solve(self, words: list[str]):
        """part() of many words at once: (which words it holds for, best, gap, ids one after the other, numbers of ids).

        Words with a character that is no piece are left out of the last four."""
        if not words:
            return np.zeros(0, bool), np.zeros(0), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64)
        # a word's nodes are its characters' places and the place of the mark after it
        char = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1
        word = np.repeat(np.arange(len(words)), size + 1)
        at = np.flatnonzero(char)
        node, length, found = np.zeros(len(at), np.int64), 0, []
        while len(at):
            key = node << 21 | char[at + length]
            step = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
            on = self.step_key[step] == key
            at, node, length = at[on], self.step_node[step[on]], length + 1
            piece = self.node_id[node] >= 0
            found.append((at[piece], at[piece] + length, node[piece]))
        start, end, node = (np.concatenate(x) for x in zip(*found))
        alone = np.ones(len(char), bool)
        alone[found[0][0]] = alone[begin + size] = False
        whole = np.bincount(word[alone], minlength=len(words)) == 0
        order = np.lexsort((end, start - begin[word[start]]))
        order = order[whole[word[start[order]]]]
        start, end, node = start[order], end[order], node[order]
        score = self.node_score[node]
        offset = start - begin[word[start]]
        bounds = np.searchsorted(offset, np.arange(size.max() + 1))
        best, via = np.full(len(char), -np.inf), np.zeros(len(char), np.int64)
        best[begin] = 0.0
        for lo, hi in zip(bounds, bounds[1:]):  # edges of one offset end in different nodes
            x, e = best[start[lo:hi]] + score[lo:hi], end[lo:hi]
            up = x >= best[e]
            best[e[up]], via[e[up]] = x[up], np.flatnonzero(up) + lo
        back = np.full(len(char), -np.inf)
        back[begin + size] = 0.0
        for lo, hi in zip(bounds[-2::-1], bounds[:0:-1]):
            np.maximum.at(back, start[lo:hi], score[lo:hi] + back[end[lo:hi]])
        own, now = np.zeros(len(start), bool), (begin + size)[whole]
        while len(now):
            own[via[now]] = True
            now = start[via[now]]
            now = now[now > begin[word[now]]]
        second = np.full(len(words), -np.inf)
        np.maximum.at(second, word[start[~own]], (best[start] + score + back[end])[~own])
        path = np.flatnonzero(own)
        path = path[np.argsort(start[path])]
        length = np.bincount(word[start[path]], minlength=len(words))[whole]
        top = best[begin + size][whole]
        return whole, top, top - second[whole], self.node_id[node[path]].astype(np.int32), length

    def cut(self, unit: str) -> list[str]:
        """unit in parts, cut where no piece has the two characters side by side."""
        at = [k for k in range(1, len(unit)) if unit[k - 1 : k + 1] not in self.inside]
        return [unit[i:j] for i, j in zip([0, *at], [*at, len(unit)])]

    def _learn(self, new: list[str], keys: np.ndarray) -> None:
        # long units go one by one, as all would wait for them
        short = np.array([len(u) <= 64 for u in new])
        few = np.flatnonzero(short)
        whole, best, gap, flat, length = self.solve([new[k] for k in few])
        order = np.concatenate([few[whole], np.flatnonzero(~short), few[~whole]])
        rest = [new[k] for k in order[whole.sum() :]]
        found = [[self.part(p) for p in self.cut(u)] for u in rest]
        ids = [[i for p in f for i in p[2]] for f in found]
        self.code.add(keys[order])
        self.names += [new[k] for k in order]
        self.best = np.concatenate([self.best, best, [sum(p[0] for p in f) for f in found]])
        self.gap = np.concatenate([self.gap, gap, [min(p[1] for p in f) for f in found]])
        length = np.append(length, np.array(list(map(len, ids)), np.int64))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.flat = np.concatenate([self.flat, flat, np.fromiter(chain.from_iterable(ids), np.int32)])

    def codes(self, keys: np.ndarray, name) -> np.ndarray:
        """Codes of units by their keys; name(k) is the k-th unit. Units that are new are learned. Codes
        hold until more are asked for: with LIMIT units known, all are forgotten first."""
        if self.code.n > self.LIMIT:
            self.clear()
        found = self.code.find(keys)
        lacking = np.flatnonzero(found < 0)
        if len(lacking):
            new, first = np.unique(keys[lacking], return_index=True)
            if self.code.n + len(new) > 3 * self.LIMIT:  # a batch of very many new units
                self.clear()
                new, first = np.unique(keys, return_index=True)
                lacking, self.code = np.arange(len(keys)), HashTable(max(self.LIMIT, len(new)))
            self._learn([name(k) for k in lacking[first].tolist()], new)
            found = self.code.find(keys)
        return found

    def codes_of(self, units: list[str]) -> np.ndarray:
        """Codes of units, in which the first mark counts apart from the rest."""
        marked = np.array([u.startswith(MARK) for u in units], bool)
        body = [(u[1:] if m else u).encode("utf-8", "replace") for u, m in zip(units, marked)]
        ends = np.cumsum(np.fromiter(map(len, body), np.int64, len(body)))
        sums = rolling(np.frombuffer(b"".join(body), np.uint8).astype(np.uint64) + np.uint64(1))
        return self.codes(unit_keys(sums, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, marked), units.__getitem__)

    def codes_of_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Codes of the units of each text. Where each mark is one space before a word, units are found on bytes."""
        out: list = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if t and not (t[-1] == " " or MARK in t or "  " in t or t[0] in " \n" or " \n" in t)]
        slow = [k for k, t in enumerate(texts) if t and k not in set(plain)] if len(plain) < len(texts) else []
        units = [units_of(texts[k]) for k in slow]
        data = b" " + b" ".join([texts[k].encode("utf-8", "replace") for k in plain])
        raw = np.frombuffer(data, np.uint8)
        line = raw == 10
        gap = line | (raw == 32)
        begin, end = line.copy(), line.copy()
        begin[1:] |= ~gap[1:] & gap[:-1]
        end[:-1] |= ~gap[:-1] & gap[1:]
        end[-1] |= ~gap[-1]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        marked = raw[begin - 1] == 32
        keys = unit_keys(rolling(raw.astype(np.uint64) + np.uint64(1)), begin, end, marked)
        flat = [u for us in units for u in us]
        more = np.array([u.startswith(MARK) for u in flat], bool)
        body = [(u[1:] if m else u).encode("utf-8", "replace") for u, m in zip(flat, more)]
        ends = np.cumsum(np.fromiter(map(len, body), np.int64, len(body)))
        sums = rolling(np.frombuffer(b"".join(body), np.uint8).astype(np.uint64) + np.uint64(1))
        keys = np.concatenate([keys, unit_keys(sums, np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], ends, more)])

        def name(k: int) -> str:
            return (MARK if marked[k] else "") + data[begin[k] : end[k]].decode() if k < len(begin) else flat[k - len(begin)]

        codes = self.codes(keys, name)
        sizes = np.cumsum([1 + len(texts[k].encode("utf-8", "replace")) for k in plain]) + 1 if plain else np.zeros(0, np.int64)
        for k, c in zip(plain, np.split(codes[: len(begin)], np.searchsorted(begin, sizes)[:-1])):
            out[k] = c
        for k, c in zip(slow, np.split(codes[len(begin) :], np.cumsum([len(u) for u in units])[:-1]) if slow else []):
            out[k] = c
        return [np.zeros(0, np.int64) if c is None else c for c in out]

    def list_of(self, unit: str) -> list[tuple[float, tuple[int, ...]]]:
        found = self.lists.get(unit)
        if found is None:
            parts = self.cut(unit)
            found = self.joined(parts) if len(parts) > 1 else self.search(unit, self.nbest)
            self.held += sum(len(ids) for _, ids in found)
            if len(self.lists) >= self.LIMIT // 10 or self.held > 10 * self.LIMIT:
                self.lists.clear()
                self.held = 0
            self.lists[unit] = found
        return found

    def encode(self, codes: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
        """Ids of the N best segmentations of a text, given its units' codes, best first, and their scores.

        A hypothesis that deviates in a unit outside the N-1 of smallest gaps is beaten by the
        best one and by deviating in each of those, so they alone are looked at."""
        if not len(codes):
            return [np.zeros(0, np.int32)], [0.0]
        length = self.length[codes]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.start[codes] - (ends - length), length) + np.arange(ends[-1])]
        gaps, n = self.gap[codes], self.nbest
        near = np.argpartition(gaps, n - 1)[: n - 1] if len(gaps) > n else np.arange(len(gaps))
        near = [int(k) for k in near[np.lexsort((near, gaps[near]))][: n - 1] if math.isfinite(gaps[k])]
        best: list[tuple[float, int, tuple[tuple[int, int], ...]]] = [(0.0, len(ids), ())]
        for k in near:
            choices = self.list_of(self.names[codes[k]])
            top, pieces = choices[0][0], len(choices[0][1])
            # at most n prefixes survive a unit, so n * n sums are looked at
            best = heapq.nsmallest(
                n, ((c + top - s, m + len(i) - pieces, (*w, (k, j)) if j else w) for c, m, w in best for j, (s, i) in enumerate(choices))
            )
        base = float(self.best[codes].sum())
        out = []
        for _, _, changes in best:
            parts, at = [], 0
            for k, j in sorted(changes):
                parts += [ids[at : ends[k] - length[k]], np.array(self.list_of(self.names[codes[k]])[j][1], np.int32)]
                at = ends[k]
            out.append(np.concatenate([*parts, ids[at:]]) if parts else ids)
        return out, [base - c for c, _, _ in best]


_MARKED = np.uint64(0xC2B2AE3D27D4EB4F)


def unit_keys(sums: np.ndarray, start: np.ndarray, end: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """64-bit hashes of units, none 0, given the rolling sums of the bytes behind their first mark."""
    return np.maximum(word_sums(sums, start, end) ^ (marked * _MARKED), np.uint64(1))


_vocabularies: dict[tuple[str | None, int], Vocabulary] = {}


def vocabulary(path: str | None = None, nbest: int = NBEST) -> Vocabulary:
    claim("pieces", _vocabularies.clear)
    if (path, nbest) not in _vocabularies:
        _vocabularies[path, nbest] = Vocabulary(path, nbest)
    return _vocabularies[path, nbest]


def units_of(text: str) -> list[str]:
    """The text with a mark before it and for each space, cut before each run of marks and around newlines."""
    if not text:
        return []
    words = text.split(" ")
    if "" in words or MARK in text:
        words = [w for u in _UNIT.findall(MARK + text.replace(" ", MARK)) for w in _lines(u)]
    else:
        words = [w for u in words for w in _lines(MARK + u)] if "\n" in text else [MARK + u for u in words]
    return words


def _lines(unit: str) -> list[str]:
    return [unit] if "\n" not in unit else [p for p in re.split("(\n)", unit) if p]


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of ids: bytes are joined, marks are spaces, the first space is dropped."""
    length = v.text_length[ids]
    ends = np.cumsum(length)
    at = np.repeat(v.text_start[ids] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    text = v.text_bytes[at].tobytes().decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode_documents(docs: DataFrame, nbest: int = NBEST, path: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, nbest_ids, nbest_scores, n_pieces, decoded, a row for each row.

    nbest_ids are the ids of the N best segmentations, best first, and nbest_scores their scores;
    n_pieces and decoded are the number of ids and the text of the best. A null text gives nulls,
    an empty one no ids and one hypothesis of score 0. A literal mark U+2581 in a text decodes to a space, as in
    the library. Repeated rows and null doc_ids are rows like others. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        v = vocabulary(path, nbest)
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = part.column("text").to_pylist()
                codes = v.codes_of_texts([t or "" for t in texts])
                lists, scores, sizes, decoded = [], [], [], []
                for t, u in zip(texts, codes):
                    ids, best = v.encode(u) if t is not None else ([], [])
                    lists += ids
                    scores += best
                    sizes.append(len(ids))
                    decoded.append(None if t is None else decode(ids[0], v))
                null = np.array([t is None for t in texts], bool)
                each = np.fromiter(map(len, lists), np.int32, len(lists))
                outer = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                inner = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
                flat = pa.array(np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32))
                mask = pa.array(null)
                ids = pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), flat), mask=mask)
                n = pa.array(np.append(each, 0)[np.minimum(outer[:-1], len(each))].astype(np.int64), mask=null)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), ids, pa.ListArray.from_arrays(pa.array(outer), pa.array(scores, pa.float64()), mask=mask), n, pa.array(decoded, pa.string())],
                    ["doc_id", "nbest_ids", "nbest_scores", "n_pieces", "decoded"],
                )

    return docs.mapInArrow(run, "doc_id long, nbest_ids array<array<int>>, nbest_scores array<double>, n_pieces long, decoded string")


def decode_ids(rows: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """rows with decoded, the text of the ids in a column of arrays; null for null or where an id is no piece or null.

    All rows and columns stay; an old column decoded is replaced."""
    ship_package(rows.sparkSession)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        v = vocabulary(path)
        most = len(v.text_length)

        def one(x):
            if x is None or any(i is None or not 0 <= i < most for i in x):
                return None
            return decode(np.asarray(x, np.int64), v)

        return column.map(one)

    return rows.withColumn("decoded", text(F.col(ids)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: digests of their N best id lists and of the text that the best decodes to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs).select(
        "doc_id", "n_pieces", F.xxhash64("nbest_ids").alias("nbest_ids_hash"), "nbest_scores", F.sha2("decoded", 256).alias("decoded_sha256")
    )


ORACLE = None
