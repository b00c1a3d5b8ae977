"""Catalog commits that die or race, batches applied once, graphs loaded and saved, outcomes in order, levels of expansion."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quarrylake.operators import graph, indexing, tables
from quarrylake.streaming import changes
from tests.test_streams import NOW, _forget_last_commit, _lines


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_dead_writer_blocks_nobody(spark, tmp_path, monkeypatch):
    c = tables.Catalog(spark, f"file://{tmp_path}")
    one, two = (spark.createDataFrame([(k,)], "x int") for k in (1, 2))
    assert c.commit({"t": one, "u": one}, "s", 0)

    def dies(self, state):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(tables.Catalog, "_publish", dies)
        with pytest.raises(OSError):
            c.commit({"t": two}, "s", 1)
    assert c.versions() == {"t": 0, "u": 0} and c.applied("s") == 0 and _rows(c.read("t")) == [(1,)]
    assert c.commit({"t": two}, "s", 1) and not c.commit({"t": one}, "s", 1) and not c.commit({"t": one}, "s", 0)
    assert c.versions() == {"t": 1, "u": 0} and _rows(c.read("t")) == [(2,)] and _rows(c.read("u")) == [(1,)]
    c.replace("t", one)
    assert c.clean(keep=1) == 3 and c.clean(keep=1) == 0  # a dead writer's folder and two old ones
    assert _rows(c.read("t")) == [(1,)] and _rows(c.read("u")) == [(1,)] and c.versions() == {"t": 2, "u": 0}


def test_of_two_writers_one_commits(spark, tmp_path):
    c = tables.Catalog(spark, f"file://{tmp_path}")
    c.replace("t", spark.createDataFrame([(1,)], "x int"))
    late = c.state() | {"number": 1}
    c.replace("t", spark.createDataFrame([(2,)], "x int"))
    with pytest.raises(tables.CommitConflict):
        c._publish(late)
    assert _rows(c.read("t")) == [(2,)] and c.state()["number"] == 1
    assert not [p for p in (tmp_path / "_commits").iterdir() if p.name.startswith("_")]


FILES = "path string, mtime long, size long, hash string, language string, content string"


def _index(spark, tmp_path):
    """One run of the index stream over what lies in the folder; files have the content that their change carries."""
    c = tables.Catalog(spark, f"file://{tmp_path}/index")
    schema = "seq long, op string, path string, to string"
    store = json.loads((tmp_path / "store.json").read_text())
    files = spark.createDataFrame([(p, m, len(t), str(hash((p, t))), "python", t) for p, (m, t) in store.items()], FILES)
    s = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    q = changes.index_into(s, c, lambda ch: files.join(ch.select("path"), "path", "left_semi"), f"{tmp_path}/check", NOW)
    try:
        q.awaitTermination(120)
    except StreamingQueryException:
        pass
    return c, q


def test_a_batch_is_indexed_once(spark, tmp_path, monkeypatch):
    store = {"a.py": (1, "def f():\n    g()\n"), "b.py": (1, "x = 1\n")}
    (tmp_path / "store.json").write_text(json.dumps(store))
    _lines(tmp_path / "in", "0.json", [{"seq": 1, "op": "modified", "path": "a.py"}, {"seq": 2, "op": "modified", "path": "b.py"}])
    c, q = _index(spark, tmp_path)
    assert q.exception() is None and c.applied("index") == 0
    whole = {k: _rows(v) for k, v in indexing.load(c).items()}
    assert len(whole["ledger"]) == 2 and len(whole["chunks"]) == 2
    # killed between the commit and the checkpoint: the batch runs again and changes nothing
    _forget_last_commit(tmp_path / "check")
    c, q = _index(spark, tmp_path)
    assert q.exception() is None and {k: _rows(v) for k, v in indexing.load(c).items()} == whole and c.versions()["chunks"] == 0
    # killed between the tables and their marker: the batch is lost, then applied by the next run
    store["a.py"] = (2, "def h():\n    pass\n")
    (tmp_path / "store.json").write_text(json.dumps(store))
    _lines(tmp_path / "in", "1.json", [{"seq": 3, "op": "renamed", "path": "b.py", "to": "a.py"}])
    with monkeypatch.context() as m:
        m.setattr(tables.Catalog, "_publish", lambda self, state: 1 / 0)
        c, q = _index(spark, tmp_path)
        assert q.exception() is not None and {k: _rows(v) for k, v in indexing.load(c).items()} == whole
    c, q = _index(spark, tmp_path)
    assert q.exception() is None and c.applied("index") == 1
    state = indexing.load(c)
    assert [r["path"] for r in state["ledger"].collect()] == ["a.py"] and {r["symbol_name"] for r in state["symbols"].collect()} >= {"h"}
    assert "f" not in {r["symbol_name"] for r in state["symbols"].collect()}


def test_daemon_ingests_once_and_syncs_again(spark, tmp_path):
    c = tables.Catalog(spark, f"file://{tmp_path}/c")
    synced = []

    def ingest(batch, catalog):
        new = batch.groupBy("file").agg(F.count("*").alias("n"))
        old = catalog.read("seen") if "seen" in catalog.versions() else new.limit(0)
        return {"seen": old.unionByName(new).groupBy("file").agg(F.sum("n").alias("n"))}

    def run():
        s = changes.session_stream(spark, f"{tmp_path}/in").select("value", F.element_at(F.split("file", "/"), -1).alias("file"))
        q = changes.daemon(s, c, ingest, lambda files, catalog, i: synced.append((i, [r[0] for r in files.collect()], _rows(catalog.read("seen")))), f"{tmp_path}/check", NOW)
        assert q.awaitTermination(120) and q.exception() is None

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("{}\n{}\n")
    run()
    _forget_last_commit(tmp_path / "check")
    run()  # the restart runs the batch again: counted once, synced again
    (tmp_path / "in/b.jsonl").write_text("{}\n")
    run()
    assert synced == [(0, ["a.jsonl"], [("a.jsonl", 2)])] * 2 + [(1, ["b.jsonl"], [("a.jsonl", 2), ("b.jsonl", 1)])]


def test_a_touched_file_is_not_read_again(spark):
    row = ("a.py", 1, 5, "h", "python", "x = 1\n")
    f = lambda *rows: spark.createDataFrame(list(rows), FILES)
    state, _ = indexing.diff_index(indexing.empty(spark), f(row))
    touched = f(("a.py", 9, 5, "h", "python", "not read\n"))
    state, report = indexing.diff_index(state, touched)
    assert report.first() == (0, 1, 0, 0) and state["ledger"].collect() == [("a.py", 9, 5, "h")]
    state, report = indexing.diff_index(state, touched)
    assert report.first() == (0, 0, 1, 0) and [r["content"] for r in state["chunks"].collect()] == ["x = 1\n"]


NODES = "id string, entity_type string, label string, record_id string, metadata string, access_count int"
EDGES = "id string, from_node string, to_node string, relationship string, confidence double, provisional boolean, access_count int, success_count int, failure_count int"


def test_graph_is_loaded_and_saved(spark, tmp_path):
    c = tables.Catalog(spark, f"file://{tmp_path}")
    n = spark.createDataFrame([("a", "Tool", "A", None, '{"k": 1}', 2), ("b", "odd", "B", "r", "{broken", None), ("c", None, "C", None, None, -1)], NODES)
    e = spark.createDataFrame([
        ("1", "a", "b", "used", 0.5, True, 1, 2, 3), ("2", "a", "gone", "used", 0.9, True, 1, 1, 1), ("3", "b", "c", "strange", 0.1, False, None, -4, None), ("4", None, "a", "used", 1.0, True, 0, 0, 0),
    ], EDGES)
    graph.save_graph(c, n, e)
    nodes, edges = graph.load_graph(c)
    assert _rows(nodes) == [("a", "tool", "A", None, '{"k": 1}', 2), ("b", "concept", "B", "r", None, 0), ("c", "concept", "C", None, None, 0)]
    assert _rows(edges) == [("1", "a", "b", "used", 0.5, True, 1, 2, 3), ("3", "b", "c", "related_to", 0.1, False, 0, 0, 0)]
    assert [r[0] for r in _rows(graph.load_graph(c, 0.3)[1])] == ["1"]
    graph.save_graph(c, n.limit(0), e.filter("id = '1'").withColumn("confidence", F.lit(0.75)))
    assert c.versions() == {"nodes": 1, "edges": 1} and {r["id"]: r["confidence"] for r in c.read("edges").collect()} == {"1": 0.75, "2": 0.9, "3": 0.1, "4": 1.0}
    part = tables.Catalog(spark, f"file://{tmp_path}/part")
    graph.save_subset(part, nodes, edges, spark.createDataFrame([("b",), ("c",), ("c",), (None,), ("none",)], "id string"))
    assert [r[0] for r in _rows(part.read("nodes"))] == ["b", "c"] and [r[0] for r in _rows(part.read("edges"))] == ["3"]


def test_all_outcomes_of_an_edge_count_in_their_order(spark):
    rng = random.Random(1)
    kinds = ["success", "failure", "partial", "other", None]
    outcomes = [(f"e{rng.randrange(6)}", rng.choice(kinds), k) for k in range(300)]
    rng.shuffle(outcomes)
    edges = [(f"e{k}", k / 8, 0, 1, True) for k in range(8)]
    want = {}
    for i, c, s, f, p in edges:
        for _, o, _ in sorted((x for x in outcomes if x[0] == i), key=lambda x: x[2]):
            c = min(1.0, c + 0.2) if o == "success" else max(0.0, c - 0.15) if o == "failure" else min(1.0, c + 0.05) if o == "partial" else c
            s, f = s + (o == "success"), f + (o == "failure")
        want[i] = (round(c, 9), s, f, p and s < 2)
    e = spark.createDataFrame(edges, "id string, confidence double, success_count int, failure_count int, provisional boolean")
    o = spark.createDataFrame([*outcomes, (None, "success", 1)], "id string, outcome string, at long")
    for span in (1, 7, 10_000):
        got = graph.apply_outcome(e, o, span)
        assert got.columns == e.columns and {r["id"]: (round(r["confidence"], 9), *tuple(r)[2:]) for r in got.collect()} == want


def test_expansion_holds_one_level_in_its_plan(spark):
    e = spark.createDataFrame([(f"{k}", f"n{k}", f"n{k + 1}", "next", 0.5) for k in range(8)], "id string, from_node string, to_node string, relationship string, confidence double")
    out = graph.expand(e, spark.createDataFrame([("n0",)], "node string"), 6, "outgoing")
    assert {(r["node"], r["depth"], len(r["path"])) for r in out.collect()} == {(f"n{k}", k, k) for k in range(1, 7)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3
