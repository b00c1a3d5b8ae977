"""Substring dedup: windows of words that stand elsewhere, found by doubling lengths.

A window of TARGET words can repeat only if every shorter window in it does. Lengths double from
a quarter of the target to the target: 9, 18, 35. At the first length a window is judged by its
minimiser, the shorter window of least hash in it, which equal windows share; neighbours with one
minimiser form a run. Runs whose minimiser repeats are extended to twice that length, on either
side of it; runs that survive are extended to the target. There a run that occurs twice as a
whole settles all its windows; only the windows of other runs are counted one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .caches import claim
from .scratch import Scratch, inner_names
from .textops import between, rolling, word_hashes

TARGET = 35


def _windows(text: str | None, target: int):
    """Word count, rolling sums, hashes of the target windows."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    return len(words), rolling(words)


def _spans(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    return between(sums, starts, starts + length)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each window of width values."""
    # sliding minimum by doubling; the position rides along
    n = len(values) - width + 1
    best, at, span = values.copy(), np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        m = len(best) - step
        later = best[step:] < best[:m]
        at = np.where(later, at[step:], at[:m])
        best = np.where(later, best[step:], best[:m])
        span += step
    return at[:n]


def runs(text: str | None, target: int = TARGET):
    """Arrays start, count, short, left, right, whole of the runs of a text.

    A run is the windows start .. start+count-1. short is the hash of their minimiser; left and
    right those of the double-length windows that end and begin with it (0 where the text ends
    before); whole is the hash of all the words that the run covers.
    """
    short, double = -(-target // 4), -(-target // 2)
    n, sums = _windows(text, target)
    if n < target:
        return None
    hashes = _spans(sums, np.arange(n - short + 1), short)
    at = _least(hashes, target - short + 1)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(start, len(at)))
    q = at[start]
    lead = q + short - double
    left = np.where(lead >= 0, _spans(sums, np.maximum(lead, 0), double), np.uint64(0))
    right = np.where(q + double <= n, _spans(sums, np.minimum(q, n - double), double), np.uint64(0))
    whole = between(sums, start, start + count + target - 1)
    return start, count, hashes[q], left, right, whole


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


_RUNS = "id long, v long, start long, count long, short long, left long, right long, whole long"


def _run_rows(target: int):
    def work(batches):
        claim("windows", lambda: None)
        for b in batches:
            parts = [[] for _ in range(8)]
            for i, v, t in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), b.column("text")):
                got = runs(t.as_py(), target)
                if got is None:
                    continue
                m = len(got[0])
                for p, x in zip(parts, [pa.array([i], pa.int64()).take(pa.array(np.zeros(m, np.int8))), pa.array(np.full(m, v, np.int64)), *map(_long, got)]):
                    p.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(p) for p in parts], [c.split()[0] for c in _RUNS.split(", ")])

    return work


def _window_rows(target: int):
    """Rows (short, window, id, v, start) for the windows of the runs in columns starts, counts and shorts."""

    def work(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for i, v, t, rs in zip(*[b.column(c).to_pylist() for c in ("id", "v", "text", "runs")]):
                n, sums = _windows(t, target)
                first, count, short = np.array([[r["start"], r["count"], r["short"]] for r in rs], np.int64).T
                at, own = np.unique(np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum()), return_index=True)
                out[0].append(np.repeat(short, count)[own])
                out[1].append(_spans(sums, at, target))
                out[2] += [i] * len(at)
                out[3].append(np.full(len(at), v, np.int64))
                out[4].append(at)
            if out[1]:
                short, window, v, at = (np.concatenate(out[k]) for k in (0, 1, 3, 4))
                yield pa.RecordBatch.from_arrays(
                    [_long(short), _long(window), pa.array(out[2], pa.int64()), pa.array(v), _long(at)], ["short", "window", "id", "v", "start"]
                )

    return work


def kept_words(text: str | None, starts, counts, target: int = TARGET) -> tuple[list[bytes], int]:
    """The words not covered by the windows start .. start+count-1, and the number of all words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not starts:
        return words, len(words)
    step = np.zeros(len(words) + 1, np.int64)
    first = np.asarray(starts, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + np.asarray(counts, np.int64) + target - 1, -1)
    stay = np.cumsum(step)[:-1] == 0
    return [w for w, s in zip(words, stay.tolist()) if s], len(words)


def repeated_windows(docs: DataFrame, target: int, s: Scratch) -> DataFrame:
    """docs (id, v, text) -> id, v, starts, counts: the windows that also start elsewhere, a row for each document that has some."""
    doc = ["id", "v"]
    found = s.keep(docs.mapInArrow(_run_rows(target), _RUNS), "runs", arrow_rows=500)

    def repeated(df: DataFrame, name: str, *columns: str) -> DataFrame:
        twice = df.groupBy(*columns).agg(F.count("*").alias("c")).filter("c > 1").select(*columns)
        return s.keep(twice, name)

    again = found.join(repeated(found, "short", "short"), "short")
    first = s.keep(again, "survivors")
    s.drop(found)
    sides = first.select(F.explode(F.array("left", "right")).alias("double")).filter("double <> 0")
    sides = repeated(sides, "double", "double")
    # a run stays if the double-length window on one side of its minimiser repeats
    one = first.join(sides.withColumnRenamed("double", "right"), "right", "left_semi")
    other = first.join(sides.withColumnRenamed("double", "left"), "left", "left_semi")
    second = one.unionByName(other).select(*doc, "start", "count", "short", "whole").distinct()
    second = s.keep(second, "doubled")
    s.drop(first)
    wholes = second.groupBy("short", "whole", "count").agg(F.count("*").alias("c"), F.min(F.struct(*doc, "start")).alias("one"))
    wholes = s.keep(wholes, "wholes")
    single = wholes.filter("c = 1").select("short").distinct()
    single = s.keep(single, "single")
    settled = s.keep(wholes.filter("c > 1").select("short", "whole"), "settled")
    sure = second.join(settled, ["short", "whole"], "left_semi").select(*doc, "start", "count")
    # a run of its own, and one copy of each other run around the same minimiser, window by window
    open_runs = wholes.join(single, "short", "left_semi").select("one.*", "count", "short")
    open_runs = s.keep(open_runs, "open")
    lists = open_runs.groupBy(*doc).agg(F.collect_list(F.struct("start", "count", "short")).alias("runs"))
    lists = s.keep(lists, "lists")
    windows = _with_text(docs, lists).mapInArrow(_window_rows(target), "short long, window long, id long, v long, start long")
    windows = s.keep(windows, "windows", arrow_rows=500)
    s.drop(open_runs, lists)
    # equal windows have one minimiser, so both hashes have to repeat together
    twice = repeated(windows, "window", "short", "window")
    # a window of one open run that stands in a settled run's copy repeats there too
    rest = windows.join(twice, ["short", "window"], "left_semi").select(*doc, "start", F.lit(1).cast("long").alias("count"))
    ranges = s.keep(sure.unionByName(rest), "ranges")
    s.drop(windows, second, wholes)
    out = ranges.groupBy(*doc).agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))
    return s.keep(out, "found")


def _with_text(docs: DataFrame, lists: DataFrame, how: str = "inner", id: str = "id", v: str = "v", rid: str = "__rid", rv: str = "__rv") -> DataFrame:
    right = lists.withColumnsRenamed({"id": rid, "v": rv})
    # sorted at any size: a broadcast of what is found would not hold on a large corpus
    return docs.join(right.hint("merge"), F.expr(f"{id} <=> {rid} and {v} = {rv}"), how).drop(rid, rv)


def dedup_substrings(docs: DataFrame, target: int = TARGET, keep_text: bool = True) -> DataFrame:
    """docs -> all its rows and columns, with n_words, n_removed and kept_text (kept_sha256 without keep_text).

    Words are maximal runs of bytes other than space and 0x09-0x0D. A word goes if a window of
    target words that covers it also starts elsewhere, in the same document or another; all
    windows are judged on the input. kept_text joins the other words by one space. A null text
    has no words and kept_text null; texts under target words lose nothing but their white space
    is normalised. Rows that repeat a doc_id and text are copies of each other; a null doc_id is
    like any other. Old columns of the new names are replaced.

    Rows are dealt by hashes of windows, never by document groups; counts are summed before they
    move, and joins read written tables, so a passage of very many documents is split. Windows are
    taken for equal where the 64-bit hashes of their words and of their minimiser's words both are,
    which share nothing but the hashes of the words: of 1e12 different windows some 1e-7 pairs that
    have no minimiser in common would be, and those that have one are few.
    """
    s = Scratch(docs.sparkSession, "substrings")
    names = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    old = [c for c in docs.columns if c not in names]
    id, v, txt, starts, counts, rid, rv = inner_names(docs.columns, "__id", "__v", "__text", "__starts", "__counts", "__rid", "__rv")
    mine = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("v"), "text")
    found = repeated_windows(mine, target, s)
    last = "kept_text" if keep_text else "kept_sha256"

    def work(batches):
        for b in batches:
            cols = [[], [], []]
            for t, ss, cs in zip(*[b.column(c).to_pylist() for c in (txt, starts, counts)]):
                words, n = kept_words(t, ss, cs, target)
                kept = b" ".join(words)
                cols[0].append(n)
                cols[1].append(n - len(words))
                cols[2].append((None if t is None else kept.decode("utf-8", "surrogatepass")) if keep_text else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in old], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                [*old, "n_words", "n_removed", last],
            )

    schema = docs.select(*[F.col(f"`{c}`") for c in old]).withColumns(
        {"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), last: F.lit(None).cast("string")}
    ).schema
    full = docs.select(*[F.col(f"`{c}`") for c in old], F.col("doc_id").cast("long").alias(id), F.xxhash64("text").alias(v), F.col("text").alias(txt))
    if not keep_text:
        full = full.withColumn("text", F.lit(None).cast("string"))
    found = found.withColumnsRenamed({"starts": starts, "counts": counts})
    return _with_text(full, found, "left", id, v, rid, rv).drop(id, v).mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated windows, the kept words as a SHA-256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; texts without one stay as they are, and documents that lost all words go.
    Nulls, empty texts, repeated rows and names are as in dedup_substrings; no documents give none."""
    out = dedup_substrings(docs).filter("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*docs.columns)


ORACLE = f"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + {TARGET - 1}], ' ')) AS g FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - {TARGET - 2})) AS p FROM words)),
twice AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
hit AS (SELECT doc_id, list(p) AS ps FROM windows JOIN twice USING (g) GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + {TARGET})))) AS gs FROM hit),
flat AS (SELECT doc_id, unnest(gs) AS q FROM gone),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY q) AS t FROM each ANTI JOIN flat USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
