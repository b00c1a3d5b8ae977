"""Work done once per distinct word: codes for words, and values kept by code."""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain
from pathlib import Path

import numpy as np

from .bpe import Merges
from .caches import claim
from .textops import HashTable, rolling, word_spans, word_sums

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(ord("a"), ord("z") + 1)]] = 1
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = 2


def spread(data: bytes) -> bytes:
    """data with a space between an ASCII letter and ASCII punctuation other than the apostrophe.

    No token of a word-level BPE crosses such a place, so the tokens of the parts are those of
    the whole, and the parts repeat far more often."""
    kind = _CLASS[np.frombuffer(data, np.uint8)]
    both = kind[1:] + kind[:-1] * 3
    where = np.flatnonzero((both == 5) | (both == 7)) + 1  # letter and punctuation, punctuation and letter
    if not len(where):
        return data
    out = np.full(len(data) + len(where), 0x20, np.uint8)
    stay = np.ones(len(out), bool)
    stay[where + np.arange(len(where))] = False
    out[stay] = np.frombuffer(data, np.uint8)
    return out.tobytes()


def word_keys(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of data, none 0, and where each starts and ends."""
    raw, start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    return np.maximum(word_sums(rolling(raw.astype(np.uint64) + np.uint64(1)), start, end), np.uint64(1)), start, end


class WordMemo:
    """Lists of ids per word. Bounded: a batch that begins with LIMIT words known, or eight ids
    for each of so many, begins by forgetting them; a batch adds at most as many as it has words."""

    LIMIT = 400_000

    def __init__(self, encode):
        """encode: list of words -> (ids one after the other, number of ids of each)."""
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.code = HashTable(self.LIMIT)
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        ids, length = self.encode(words)
        start = len(self.flat) + np.cumsum(length) - length
        self.flat = np.concatenate([self.flat, ids])
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, whose words are runs of bytes other than white space."""
        data = b"\n".join(texts)
        keys, start, end = word_keys(data)
        if self.code.n > self.LIMIT or len(self.flat) > 8 * self.LIMIT:
            self.clear()
        codes = self.code.find(keys)
        lacking = np.flatnonzero(codes < 0)
        if len(lacking):
            new, first = np.unique(keys[lacking], return_index=True)
            if self.code.n + len(new) > 3 * self.LIMIT:  # a batch of very many new words
                self.clear()
                new, lacking = np.unique(keys, return_index=True)
                first = np.arange(len(new))
                self.code = HashTable(max(self.LIMIT, len(new)))
            at = lacking[first]
            self._learn([data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
            self.code.add(new)
            codes = self.code.find(keys)
        ids, count = self._expand(codes)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, ends)]
        return np.split(ids, upto[:-1]) if texts else []

    def _expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[codes]
        shift = self.start[codes] - (np.cumsum(length) - length)
        return self.flat[np.repeat(shift, length) + np.arange(int(length.sum()))], length


_tokenizers: dict[str, WordMemo] = {}


def vocabulary_path(path: str | None, name: str) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def word_tokenizer(path: str | None = None) -> WordMemo:
    """The word-level BPE tokenizer in path, kept by each Python worker.

    A word that is all letters once normalised is one pre-token, so its merges alone make its ids."""
    path = vocabulary_path(path, "word_bpe_49k.json")
    claim("words", _tokenizers.clear)
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        t = Tokenizer.from_file(path)
        # the printable stand-in of each byte of UTF-8, by one character for each leading byte
        leading = [*range(0x800), *range(0x800, 0x10000, 0x400), *range(0x10000, 0x110000, 0x10000)]
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        stand_in = {b: x for c in leading if not 0xD800 <= c < 0xE000 for b, x in zip(chr(c).encode(), shown(chr(c))[0][0])}
        model = json.loads(Path(path).read_text("utf-8"))["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = Merges(model["vocab"], pairs, stand_in, model.get("end_of_word_suffix") or "")

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            letters, rest, order, others = [], [], [], []
            for k, w in enumerate(words):
                if w.isalpha():  # ASCII letters; case is lowered unless the text holds a special token
                    plain = w.lower()
                else:
                    plain = unicodedata.normalize("NFC", w.decode()).lower()
                    plain = plain.encode() if plain.isalpha() and "Σ".encode() not in w and "<|".encode() not in w else b""
                if 0 < len(plain) <= 64:
                    letters.append(plain)
                    order.append(k)
                else:
                    rest.append(w.decode())
                    others.append(k)
            flat, count = merges.words(letters) if letters else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            alone = [x.ids for x in t.encode_batch_fast(rest, add_special_tokens=False)]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(alone), np.uint32)])
            count = np.concatenate([count, np.fromiter(map(len, alone), np.int64, len(alone))])
            # back in the order of words
            start, back = np.cumsum(count) - count, np.argsort(np.array(order + others, np.int64))
            length = count[back]
            shift = start[back] - (np.cumsum(length) - length)
            return flat[np.repeat(shift, length) + np.arange(int(length.sum()))], length

        _tokenizers[path] = WordMemo(encode)
    return _tokenizers[path]


def vocabulary_size(path: str | None = None) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(path, "word_bpe_49k.json")).get_vocab_size()


def plain_parts(text: str | None) -> bytes:
    """The text as bytes whose words' tokens, one after the other, are those of the text.

    The tokenizer drops white space and lower-cases. Special tokens are matched before that, with
    their case, so a text that may hold one keeps its letters."""
    data = (text or "").encode("utf-8", "replace")
    return data if b"<|" in data else spread(data.lower())


def token_batches(texts: list[str | None], path: str | None = None, chars: int = 1_000_000):
    """Token id arrays of texts, in order; about chars characters are looked up at once."""
    memo = word_tokenizer(path)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= chars):
            size += len(texts[hi] or "")
            hi += 1
        yield from memo.ids_of([plain_parts(t) for t in texts[lo:hi]])
        lo = hi
