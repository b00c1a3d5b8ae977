"""Packing of documents into sequences of bounded length.

Documents are cut at whole windows; what is left over has a length below the window. Lengths are
counted in at most BINS bins of equal width, rounded up, so that bins that fill a window fit it. Combinations of up to DEPTH bins that fill a window exactly are enumerated,
non-negative least squares solves how often to repeat each so that together they use up the
histogram, and the rounded-down repeats are taken. A greedy pass over the histogram packs the
residual, largest first. Only the histogram, of fixed size, comes to the driver; the plan tells
each piece its place by its rank among the pieces of its bin.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch
from .wordmemo import token_batches

WINDOW, DEPTH, BINS = 2048, 3, 256
END_ID = 1
#: Pieces that are ranked together, about; a bin of more is ranked in parts, however many it takes.
RANKED = 200_000


def combinations(bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Non-increasing tuples of 2 to depth bin sizes that sum to bins."""
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(prefix)
        elif len(prefix) < depth:
            for b in range(min(left, most), 0, -1):
                if left <= b * (depth - len(prefix)):
                    grow((*prefix, b), left - b, b)

    grow((), bins, bins - 1)
    return out


def nnls(a: np.ndarray, h: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """argmin |a x - h| over x >= 0, by the active-set method of Lawson and Hanson."""
    gram, rhs = a.T @ a if a.shape[1] <= 512 else None, a.T @ h
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(6 * a.shape[0]):
        w = rhs - a.T @ (a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tolerance:
            break
        active[j] = True
        while True:
            own = np.flatnonzero(active)
            m = a[:, own]
            g = gram[np.ix_(own, own)] if gram is not None else m.T @ m
            z = np.linalg.solve(g + 1e-10 * np.eye(len(own)), m.T @ h)
            if (z > 0).all():
                x[:] = 0
                x[own] = z
                break
            bad = z <= 0
            step = np.min(x[own][bad] / np.maximum(x[own][bad] - z[bad], 1e-300))
            x[own] += step * (z - x[own])
            active[own[x[own] <= 1e-12]] = False
            x[~active] = 0
    return x


def plan(counts: np.ndarray, depth: int = DEPTH) -> list[tuple[dict[int, int], int]]:
    """counts[b] pieces of bin b (1..bins) -> (bin -> how many in a sequence, repeats): uses up all counts."""
    bins = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    if left[bins]:
        out.append(({bins: 1}, int(left[bins])))
        left[bins] = 0
    if left.any():
        combos = combinations(bins, depth)
        a = np.zeros((bins, len(combos)))
        for k, c in enumerate(combos):
            for b in c:
                a[b - 1, k] += 1
        x = nnls(a, left[1:] / left.sum()) * left.sum()
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 1:
                break
            mix = {b: combos[k].count(b) for b in combos[k]}
            repeats = min(int(x[k]), *(int(left[b]) // m for b, m in mix.items()))
            if repeats:
                out.append((mix, repeats))
                for b, m in mix.items():
                    left[b] -= m * repeats
    while left.any():
        room, mix = bins, {}
        for b in np.flatnonzero(left)[::-1].tolist():
            if m := min(room // b, int(left[b])):
                mix[b] = m
                room -= m * b
        repeats = min(int(left[b]) // m for b, m in mix.items())
        out.append((mix, repeats))
        for b, m in mix.items():
            left[b] -= m * repeats
    return out


def _pieces(window: int, path: str | None):
    def run(batches):
        for b in batches:
            cols: list[list[int]] = [[] for _ in range(5)]
            for i, ids in zip(b.column("id").to_pylist(), token_batches(b.column("text").to_pylist(), path)):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                for s in range(0, len(ids), window):
                    part = ids[s : s + window]
                    for c, x in zip(cols, (i, s, len(part), zlib.crc32(part), len(ids))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "start", "length", "crc", "tokens"])

    return run


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its tokens and END_ID, so a null, empty or blank text is one piece of
    one id. Rows that repeat a doc_id and null ones are packed each by itself. Ties are ordered by
    all columns, so a task that runs again gives the same places. Pieces stand in a sequence
    without gaps; a sequence is at most window ids long, and what is missing is padding at its
    end. No documents give no piece. Other columns are not read. path is the tokenizer file.

    Only counts of pieces by bin and part come to the driver: two numbers for each RANKED pieces and each bin.
    """
    if window < 2:
        raise ValueError("a window has two ids at least")
    s = scratch or Scratch(docs.sparkSession, "packing")
    width = -(-window // BINS)
    bins = window // width
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    pieces = s.keep(docs.mapInArrow(_pieces(window, path), "id long, start long, length long, crc long, tokens long"), "pieces", arrow_rows=500)
    # what is longer than all bins together, by less than a bin, fills a window alone
    pieces = pieces.withColumn("bin", F.least(F.ceil(F.col("length") / width), F.lit(bins)).cast("int"))
    sizes = np.zeros(bins + 1, np.int64)
    for r in pieces.groupBy("bin").count().toPandas().itertuples(index=False):
        sizes[r[0]] = r[1]
    parts = 1 + sizes // RANKED
    first = np.cumsum(parts) - parts
    salts = F.get(F.array(*[F.lit(int(p)) for p in parts]), F.col("bin"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start", "crc"), salts).cast("int"))
    table = np.zeros(int(parts.sum()), np.int64)
    for r in pieces.groupBy("bin", "salt").count().toPandas().itertuples(index=False):
        table[first[r[0]] + r[1]] = r[2]
    before = np.cumsum(table) - table
    before -= np.repeat(before[first], parts)
    keys, base, per, slot = _segments(plan(sizes))

    def place(batches):
        for b in batches:
            at = b.column("bin").to_numpy()
            rank = b.column("rank").to_numpy() - 1 + before[first[at] + b.column("salt").to_numpy()]
            k = np.searchsorted(keys[:, 0] * (1 << 44) + keys[:, 1], at.astype(np.int64) * (1 << 44) + rank, "right") - 1
            j = rank - keys[k, 1]
            cols = [b.column(c) for c in ("id", "start", "length", "crc", "tokens")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(base[k] + j // per[k]), pa.array(slot[k] + j % per[k])], ["id", "start", "length", "crc", "tokens", "seq", "slot"]
            )

    rank = F.row_number().over(W.partitionBy("bin", "salt").orderBy("id", "start", "crc", "tokens"))
    placed = pieces.withColumn("rank", rank.cast("long")).mapInArrow(
        place, "id long, start long, length long, crc long, tokens long, seq long, slot long"
    )
    ahead = W.partitionBy("seq").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"),
    )


def _segments(steps: list[tuple[dict[int, int], int]]):
    """Arrays by (bin, first rank): first sequence, pieces of the bin in each, first slot."""
    rows, used, seq = [], {}, 0
    for mix, repeats in steps:
        slot = 0
        for b, m in mix.items():
            rows.append((b, used.get(b, 0), seq, m, slot))
            used[b] = used.get(b, 0) + m * repeats
            slot += m
        seq += repeats
    t = np.array(sorted(rows) or [(0, 0, 0, 1, 0)], np.int64)
    return t[:, :2], t[:, 2], t[:, 3], t[:, 4]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of WINDOW ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' sequences; nulls, empty and very long texts, repeated rows and names are as in pack."""
    return pack(docs)


ORACLE = None
