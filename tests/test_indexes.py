"""Trigram postings, vector cells and latency sketches, against scanning everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.operators import cells, metrics, tables, trigrams, vector


def _texts(n, seed):
    rng = random.Random(seed)
    words = ["Lock", "wal", "SQLite", "Éclair", "日本語", "a%b", "under_score", "x", "panic!", "deploy"]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(12))), rng.choice(["t", None, "Title"])) for k in range(n)]


def _found(df):
    return sorted((r["needle"], r["id"]) for r in df.collect())


def test_postings_find_what_a_scan_finds(spark, tmp_path):
    rows = [*_texts(120, 1), (500, None, None), (501, "", ""), (502, "ab", None), (503, "a", "zz"), (None, "lock", "t")]
    df = spark.createDataFrame(rows, "id long, text string, title string")
    index = trigrams.TrigramIndex(spark, f"file://{tmp_path}/a")
    index.build(df, "id", ["text", "title"])
    needles = ["lock", "LOCK wal", "éclair", "本", "日本語 x", "a%b", "r_s", "a", "ab", "zz", "not there", "title", "", None, "k w", "!", "%"]
    asked = spark.createDataFrame([(x,) for x in needles], "needle string")

    def scan(rows):
        return sorted((x, i) for x in needles if x for i, t, h in rows if i is not None and any(x.lower() in (v or "").lower() for v in (t, h)))

    assert _found(index.search(df, asked, "id", ["text", "title"])) == scan(rows)
    # changed, new and deleted rows: postings of the changed ones are appended, the rest is as it was
    changed = [(3, "wholly new words lock", None), (900, "SQLITE again", "Title"), (4, "", None)]
    now = [r for r in rows if r[0] not in (3, 4, 7, 8)] + changed
    index.append(spark.createDataFrame(changed, df.schema), "id", ["text", "title"])
    df2 = spark.createDataFrame(now, df.schema)
    assert index.layers() == 2 and _found(index.search(df2, asked, "id", ["text", "title"])) == scan(now)
    small = index.compact(df2, "id", ["text", "title"], f"file://{tmp_path}/b")
    assert small.layers() == 1 and _found(small.search(df2, asked, "id", ["text", "title"])) == scan(now) and small.rows().count() < index.rows().count()
    one = small.search_one(df2, "sqlite", "id", ["text"], ["id"], 5)
    assert one.columns == df2.columns and one.collect() == vector.text_search(df2.filter("id is not null"), "sqlite", ["text"], ["id"], 5).collect()


def test_few_texts_are_read(spark, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, "".join(rng.choice("abcdefghij ") for _ in range(60)) + (" needle" if k % 50 == 0 else "")) for k in range(2000)], "id long, text string")
    index = trigrams.TrigramIndex(spark, f"file://{tmp_path}")
    index.build(df, "id", ["text"])
    asked = spark.createDataFrame([("needle",)], "needle string")
    assert index.candidates(asked).count() == 40 == index.search(df, asked, "id", ["text"]).count()


def test_postings_are_lists_that_meet_in_parts(spark, tmp_path, monkeypatch):
    rows = _texts(300, 5)
    df = spark.createDataFrame(rows, "id long, text string, title string")
    index = trigrams.TrigramIndex(spark, f"file://{tmp_path}/a")
    index.build(df, "id", ["text"])
    # a row for each text and gram, as there was, is some ten thousand here
    assert 10 * index._lists().count() < index.rows().count() == index.rows().distinct().count()
    monkeypatch.setattr(trigrams, "TOGETHER", 3)
    # pairs and single characters are looked up, not searched for among all grams
    asked = ["é", "É", "日本", "wa", "L", "wal sq", "lock lock", "%", "b_", "no"]
    got = _found(index.search(df, spark.createDataFrame([(x,) for x in asked], "needle string"), "id", ["text"]))
    assert got == sorted((x, i) for x in asked for i, t, _ in rows if x.lower() in t.lower())


def test_pieces_of_texts():
    rng = random.Random(8)
    for letters in ("ab", "aé日😀\0", [chr(0x4E00 + k) for k in range(3000)]) * 3:
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(50)]
        row = np.array(sorted(rng.randrange(20) for _ in texts)) * rng.choice([1, 10**9])
        got = [(p, int(r)) for pieces, ends, rows in trigrams._cut(texts, row) for p, s, e in zip(pieces, np.append(0, ends), ends) for r in rows[s:e]]
        assert len(got) == len(set(got))
        assert set(got) == {(t[k : k + w], int(r)) for t, r in zip(texts, row) for w in (1, 2, 3) for k in range(len(t) - w + 1)}


def _near(got):
    out = {}
    for r in got.collect():
        out.setdefault(r["qid"], []).append((r["rank"], r["id"], round(r["distance"], 9)))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("k", [1, 7, 500])
def test_cells_answer_as_all_vectors_do(spark, tmp_path, k):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16)) * 8
    x = np.concatenate([centers[rng.integers(0, 12, 400)] + rng.normal(size=(400, 16)), np.zeros((5, 16))])
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [1.0, 2.0]), (902, [float("nan")] * 16), (903, [None] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [(i, rows[i][1]) for i in range(0, 405, 20)] + [(-1, [100.0] * 16), (-2, None), (-3, [1.0])]
    q = spark.createDataFrame(asked, "qid long, q array<float>")
    index = cells.VectorCells(spark, f"file://{tmp_path}")
    index.build(v)
    f32 = {i: np.array(e, np.float32).astype(float) for i, e in rows[:405]}
    want = {}
    for i, e in asked:
        if e is not None and len(e) == 16:
            e = np.array(e, np.float32).astype(float)
            best = sorted((float(np.sqrt(((e - f) ** 2).sum())), j) for j, f in f32.items())[:k]
            want[i] = [(r + 1, j, round(d, 9)) for r, (d, j) in enumerate(best)]
    assert _near(index.knn(q, k)) == want
    read = index.read_cells(q.filter("qid >= 0"), k).agg(F.sum("read"), F.sum("cells")).first()
    assert read[0] < 0.5 * read[1] or k == 500


def test_cells_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = cells.VectorCells(spark, f"file://{tmp_path}")
    index.build(none)
    assert index.knn(spark.createDataFrame([(1, [1.0])], "qid long, q array<float>")).count() == 0


def test_sketches_merge_and_keep_their_error(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.choice([rng.lognormvariate(2, 3), rng.random(), 0.0, -rng.random() * 5, 1e-300, 1e300])) for _ in range(3000)] + [("a", None), ("a", float("nan")), ("one", 7.0)]
    calls = spark.createDataFrame(rows, "tool string, latency_ms double")
    whole = metrics.sketch(calls, ["tool"])
    half = [spark.createDataFrame(rows[k::2], calls.schema) for k in (0, 1)]
    both = metrics.merged_sketch(metrics.sketch(half[0], ["tool"]), metrics.sketch(half[1], ["tool"]), ["tool"])
    as_rows = lambda s: sorted(map(tuple, s.select("tool", "bucket", "n").collect()), key=repr)
    assert as_rows(both) == as_rows(whole)
    quantiles = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["tool"]: r for r in metrics.sketch_quantiles(both, ["tool"], quantiles).collect()}
    for tool in ("a", "b", "one"):
        own = sorted(x for t, x in rows if t == tool and x is not None and x == x)
        for name, q in quantiles.items():
            exact = own[max(1, int(np.ceil(len(own) * q))) - 1]
            assert abs(got[tool][name] - exact) <= metrics.ERROR * abs(exact) * (1 + 1e-6), (tool, name)
    # stored: each batch once, whatever is run again
    c = tables.Catalog(spark, f"file://{tmp_path}")
    assert [metrics.record_latency(c, half[k], ["tool"], "calls", n) for k, n in ((0, 0), (0, 0), (1, 1), (1, 1), (0, 0))] == [True, False, True, False, False]
    assert as_rows(c.read("latency")) == as_rows(whole)
    assert metrics.sketch_quantiles(whole.limit(0), ["tool"], quantiles).count() == 0
