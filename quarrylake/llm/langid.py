"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of whole texts, blanks and punctuation included, in windows of
CONTEXT bytes, in both directions, and labels every position: a probability for each language and
one for no language. A document's probabilities are the means over all its positions. Training is
plain numpy: backpropagation through time with Adam, on windows of a bounded sample of labelled
documents; what "no language" looks like is learned from the same windows with their bytes shuffled.

Gates and candidates use x / (1 + |x|) in place of the exponential functions, which halves the
time of a step. Arrays have one row per unit and one column per window.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship_package
from .caches import claim

#: Training reads, of each of the MAX_LANGS most frequent languages, at most MAX_DOCS labelled documents
#: (by hash of doc_id), and of each of these at most MAX_CHARS characters.
MAX_LANGS, MAX_DOCS, MAX_CHARS = 256, 600, 4000
#: Bytes of a window when predicting and when training, units of a direction, steps, windows of a step.
CONTEXT, TRAIN_CONTEXT, HIDDEN, STEPS, BATCH = 128, 64, 8, 400, 256
#: Windows that are read at once.
WINDOWS = 1024
UNDETERMINED = "und"
#: The pipeline rejects documents without a letter and those whose best language has less than a third of the probability.
MIN_SCORE = 1 / 3
_LETTER = re.compile(r"[^\W\d_]")


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


class GRU:
    """One direction. Input weights are a table by byte: an embedding and its product in one."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.p = {
            "w": rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32),
            "u": rng.normal(0, hidden**-0.5, (2 * hidden, hidden)).astype(np.float32),
            "v": rng.normal(0, hidden**-0.5, (hidden, hidden)).astype(np.float32),
            "b": np.zeros((3 * hidden, 1), np.float32),
        }

    def forward(self, x: np.ndarray, keep: bool = False):
        """x (T, n) bytes -> states (T, h, n), and with keep what backward needs."""
        k, (t, n) = self.h, x.shape
        h, out, cache = np.zeros((k, n), np.float32), np.empty((t, k, n), np.float32), []
        table = np.ascontiguousarray(self.p["w"] + self.p["b"])
        g = np.empty((3 * k, n), np.float32)
        for i in range(t):
            np.take(table, x[i], axis=1, out=g, mode="clip")
            a = self.p["u"] @ h
            a += g[: 2 * k]
            s = _soft(a)
            gate = (s + 1) * np.float32(0.5)
            z, r = gate[:k], gate[k:]
            c = self.p["v"] @ (r * h)
            c += g[2 * k :]
            c = _soft(c)
            if keep:
                cache.append((h, s, gate, c))
            h = c + z * (h - c)
            out[i] = h
        return (out, cache) if keep else out

    def backward(self, x: np.ndarray, cache, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all weights, given those of the states (T, h, n), back through time."""
        k = self.h
        out = {n: np.zeros_like(w) for n, w in self.p.items()}
        each = np.empty((len(x), 3 * k, x.shape[1]), np.float32)
        dh = np.zeros_like(grad[0])
        for i in range(len(x) - 1, -1, -1):
            h, s, gate, c = cache[i]
            z, r = gate[:k], gate[k:]
            dh = dh + grad[i]
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            drh = self.p["v"].T @ dc
            dgate = np.concatenate([dh * (h - c), drh * h]) * np.float32(0.5) * (1 - np.abs(s)) ** 2
            out["v"] += dc @ (r * h).T
            out["u"] += dgate @ h.T
            each[i, : 2 * k], each[i, 2 * k :] = dgate, dc
            dh = dh * z + drh * r + self.p["u"].T @ dgate
        flat = each.transpose(1, 0, 2).reshape(3 * k, -1)
        for j in range(3 * k):
            out["w"][j] = np.bincount(x.ravel(), flat[j], 256)
        out["b"] = flat.sum(1, keepdims=True)
        return out


class Labeller:
    """Two GRUs and a softmax at every position; the last class is no language."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.fore, self.back = GRU(rng, hidden), GRU(rng, hidden)
        self.out = {"w": rng.normal(0, 0.1, (len(langs) + 1, 2 * hidden)).astype(np.float32), "b": np.zeros((len(langs) + 1, 1), np.float32)}

    def positions(self, x: np.ndarray, keep: bool = False):
        """x (T, n) bytes -> probabilities (T, classes, n)."""
        f, b = self.fore.forward(x, keep), self.back.forward(x[::-1], keep)
        (f, fc), (b, bc) = (f, b) if keep else ((f, None), (b, None))
        h = np.concatenate([f, b[::-1]], 1)
        o = self.out["w"] @ h
        o += self.out["b"]
        o -= o.max(1, keepdims=True)
        np.exp(o, out=o)
        o /= o.sum(1, keepdims=True)
        return (o, h, fc, bc) if keep else o

    def texts(self, texts: list[bytes], context: int = CONTEXT) -> np.ndarray:
        """(n, classes): means over all positions of non-empty texts."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        windows = -(-size // context)
        sums = np.zeros((int(windows.sum()), len(self.langs) + 1))
        data = np.zeros((len(sums), context), np.uint8)
        real = np.arange(context) < np.minimum(context, np.repeat(size, windows) - context * (np.arange(len(sums)) - np.repeat(np.cumsum(windows) - windows, windows)))[:, None]
        data[real] = np.frombuffer(b"".join(texts), np.uint8)
        for lo in range(0, len(sums), WINDOWS):
            x = np.ascontiguousarray(data[lo : lo + WINDOWS].T)
            o = self.positions(x.astype(np.intp))
            o *= np.ascontiguousarray(real[lo : lo + WINDOWS].T)[:, None, :]
            sums[lo : lo + WINDOWS] = o.sum(0, dtype=np.float64).T
        return np.add.reduceat(sums, np.cumsum(windows) - windows) / size[:, None]

    def train(self, texts: list[bytes], lang: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 11) -> None:
        """Cross-entropy at every position; each language is drawn equally often, and no language once for each two of them."""
        rng = np.random.default_rng(seed)
        k, t = len(self.langs), TRAIN_CONTEXT
        by = []
        for i in range(k):
            own = [np.frombuffer(x, np.uint8) for x, j in zip(texts, lang) if j == i]
            flat = np.concatenate(own)
            begin = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            by.append((flat, begin))
        params = [self.fore.p, self.back.p, self.out]
        m1, m2 = ([{n: np.zeros_like(w) for n, w in p.items()} for p in params] for _ in range(2))
        each = max(1, batch // (k + max(1, k // 2)))
        for step in range(1, steps + 1):
            rows, want = [], []
            for i, (flat, begin) in enumerate(by):
                at = rng.integers(0, len(flat), each)
                end = begin[np.searchsorted(begin, at, "right")]
                place = at[:, None] + np.arange(t)
                rows.append(np.where(place < end[:, None], flat[np.minimum(place, len(flat) - 1)], 0))
                want += [i] * each
            noise = np.concatenate(rows)[rng.permutation(each * k)[: each * max(1, k // 2)]]
            rows.append(rng.permuted(noise, axis=1))
            want += [k] * len(noise)
            x = np.concatenate(rows)
            mask = (x != 0).T
            x, want = np.ascontiguousarray(x.T).astype(np.intp), np.array(want)
            o, h, fc, bc = self.positions(x, keep=True)
            o[:, want, np.arange(len(want))] -= 1
            o *= (mask / max(1, mask.sum())).astype(np.float32)[:, None, :]
            dh = self.out["w"].T @ o
            n = self.fore.h
            grads = [
                self.fore.backward(x, fc, np.ascontiguousarray(dh[:, :n])),
                self.back.backward(x[::-1], bc, np.ascontiguousarray(dh[::-1, n:])),
                {"w": np.einsum("tcn,thn->ch", o, h, optimize=True), "b": o.sum((0, 2))[:, None]},
            ]
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, a, b in zip(params, grads, m1, m2):
                for name in p:
                    a[name] += 0.1 * (g[name] - a[name])
                    b[name] += 0.001 * (g[name] ** 2 - b[name])
                    p[name] -= now * (a[name] / (1 - 0.9**step)) / (np.sqrt(b[name] / (1 - 0.999**step)) + 1e-8)


def encoded(text: str | None) -> bytes:
    """The bytes that the network reads; none for a text without a letter. 0 stands for what follows an end."""
    return text.encode("utf-8", "replace").replace(b"\0", b" ") if text and _LETTER.search(text) else b""


def held_out(doc_id):
    """Whether crc32 of doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> list:
    """Rows lang, text of labelled documents with letters that are not held out: each language's own, max_docs at most.

    What is sorted of a language is twice max_docs on average, however many documents it has."""
    own = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), "text")
    own = own.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")) & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return []
    h = F.xxhash64("id")
    parts = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // (2 * max_docs)))])
    some = own.filter(F.col("lang").isin(*counts)).filter(F.pmod(h, F.try_element_at(parts, "lang")) == 0)
    some = some.withColumns({"text": F.substring("text", 1, max_chars), "h": h})
    some = some.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "id", "text"))).filter(F.col("k") <= max_docs)
    return some.select("lang", "text", "k").orderBy("lang", "k").collect()


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, steps: int = STEPS) -> Labeller:
    """Train on documents with text, doc_id and lang that are not held out. A label of which no text has a
    letter cannot be learned and keeps no other from it; without any label nothing is trained, and all is undetermined."""
    rows = [(r["lang"], encoded(r["text"])) for r in sample(docs, max_docs, max_chars)]
    rows = [r for r in rows if r[1]]
    langs = sorted({lang for lang, _ in rows})
    model = Labeller(langs)
    if langs:
        model.train([t for _, t in rows], np.array([langs.index(lang) for lang, _ in rows]), steps)
    return model


def judge(texts: list[str | None], model: Labeller, bytes_at_once: int = 500_000) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out, data, lo = [(UNDETERMINED, 0.0)] * len(texts), [encoded(t) for t in texts], 0
    own = [k for k, d in enumerate(data) if d] if model.langs else []
    while lo < len(own):
        hi, size = lo, 0
        while hi < len(own) and (hi == lo or size + len(data[own[hi]]) <= bytes_at_once):
            size += len(data[own[hi]])
            hi += 1
        found = model.texts([data[k] for k in own[lo:hi]])[:, :-1]
        best = found.argmax(1)
        for k, j, p in zip(own[lo:hi], best.tolist(), found[np.arange(len(best)), best].tolist()):
            out[k] = model.langs[j], min(1.0, p)
        lo = hi
    return out


_models: dict[str, Labeller] = {}


def predict(docs: DataFrame, model: Labeller) -> DataFrame:
    """docs -> all its rows and columns with lang_pred and score; lang, source and doc_id are not looked at.

    A null text, an empty one and one without a letter are "und" with score 0. Else lang_pred is the
    language of greatest mean probability over all bytes of the whole text, and score that mean: it
    is low where languages mix and where the text is like none. Repeated rows get equal results.
    Old columns of the two names are replaced. Very long texts are read some thousand windows at a time.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # some thousand weights
    run = uuid.uuid4().hex
    old = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def work(batches):
        claim("language", _models.clear)
        if run not in _models:
            _models.clear()
            _models[run] = sent.value
        for b in batches:
            # the text is the last column, whatever the others are called
            found = judge(b.column(b.num_columns - 1).to_pylist(), _models[run])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                [*old, "lang_pred", "score"],
            )

    mine = docs.select(*[F.col(f"`{c}`") for c in old])
    schema = mine.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(old)], F.col("text").alias("t")).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; the model is trained on those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs)
    slim = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(slim, model).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang is filled in where it is null.

    Rejected are texts that are null, empty or without a letter, and those of which the best language
    has less than MIN_SCORE of the probability. Repeated rows share a fate; no documents give none."""
    found = predict(docs, fit(docs))
    found = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    lang = F.coalesce(F.col("lang"), F.col("lang_pred")).alias("lang")
    return found.select(*[lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


ORACLE = None
