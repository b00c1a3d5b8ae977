"""The functions that SQL can call, against the operators that they stand for."""

import pytest
from pyspark.sql import functions as F

from quarrylake import sql
from quarrylake.functions.kernels import chunk_lines, jaro_winkler
from quarrylake.operators import graph


@pytest.fixture(scope="module")
def session(spark):
    assert set(sql.register(spark)) >= {"line_chunks", "text_runs", "jaro_winkler"}
    return spark


def test_line_chunks_from_sql(session):
    texts = ["one\ntwo", None, "", "\n".join(f"line {k}" for k in range(230))]
    session.createDataFrame([(k, t, [k], {"a": k}) for k, t in enumerate(texts)], "doc int, Body string, tags array<int>, extra map<string, int>").createOrReplaceTempView("texts")
    got = session.sql("SELECT * FROM line_chunks(TABLE(texts), 'body') ORDER BY doc, chunk_index")
    assert got.columns == ["doc", "Body", "tags", "extra", "chunk_index", "start_line", "end_line", "chunk"]
    want = [(k, c["chunk_index"], c["start_line"], c["end_line"], c["content"]) for k, t in enumerate(texts) if t for c in chunk_lines(t)]
    assert [(r["doc"], r["chunk_index"], r["start_line"], r["end_line"], r["chunk"]) for r in got.collect()] == want
    assert got.first()["tags"] == [0] and got.first()["extra"] == {"a": 0}
    small = session.sql("SELECT count(*) FROM line_chunks(TABLE(SELECT * FROM texts WHERE doc = 3), 'Body', 10, 20, 0)").first()[0]
    assert small == len(chunk_lines(texts[3], 10, 20, 0)) > len(chunk_lines(texts[3]))
    assert session.sql("SELECT * FROM line_chunks(TABLE(SELECT * FROM texts WHERE doc > 9), 'Body')").count() == 0


@pytest.mark.parametrize("call, says", [
    ("line_chunks(TABLE(texts), 'nope')", "no string column"), ("line_chunks(TABLE(texts), 'doc')", "no string column"), ("line_chunks(TABLE(texts), 'Body', 5, 4, 0)", "overlap"),
    ("line_chunks(TABLE(SELECT Body, 1 AS chunk FROM texts), 'Body')", "columns that the function adds"), ("text_runs(TABLE(texts), 'doc', 'none', 'Body')", "no column"),
])
def test_wrong_arguments_are_told(session, call, says):
    with pytest.raises(Exception, match=says):
        session.sql(f"SELECT * FROM {call}").collect()


def test_runs_from_sql(session):
    said = {"a": ["read file x", "read file y", "read file z", "other", "deploy", "deploy", None, None, None], "b": ["m", "m", "m", "m"], "c": ["q"]}
    rows = [(s, n, t) for s, texts in said.items() for n, t in enumerate(texts)]
    session.createDataFrame(rows[::-1], "session string, n int, text string").repartition(3).createOrReplaceTempView("said")
    got = session.sql("SELECT * FROM text_runs(TABLE(said), 'session', 'n', 'text') ORDER BY key, first").collect()
    assert [tuple(r) for r in got] == [("a", 0, 2, 3), ("b", 0, 3, 4)]
    two = session.sql("SELECT key, first, last, rows FROM text_runs(TABLE(said), 'session', 'n', 'text', 0.99D, 2) ORDER BY key, first").collect()
    assert [tuple(r) for r in two] == [("a", 4, 5, 2), ("b", 0, 3, 4)]


def test_scalars_from_sql(session):
    row = session.sql("SELECT distance_score(0.5D), decayed(0.8D, 60D), severity_rank('warning'), l2_distance(array(0D, 3D), array(4D, 0D)), jaro_winkler('martha', 'marhta'), jaro_winkler(NULL, 'x')").first()
    assert row[:4] == (0.75, 0.2, 2, 5.0) and abs(row[4] - jaro_winkler("martha", "marhta")) < 1e-12 and row[5] is None


def test_expand_from_sql(session):
    edges = session.createDataFrame([("1", "a", "b", "r", 0.9), ("2", "b", "c", "r", 0.9), ("3", "c", "d", "r", 0.2), ("4", "e", "a", "r", 0.5), ("5", "c", "a", "r", 0.4), ("6", "c", "f", "r", 0.4)], "id string, from_node string, to_node string, relationship string, confidence double")
    edges.createOrReplaceTempView("graph_edges")
    sql.register_graph(session, "graph_edges")
    for start, depth, least in (("a", 2, 0.3), ("a", 3, 0.0), ("d", 1, 0.1), ("none", 2, 0.0), ("b", 2, 0.45)):
        want = {(r["node"], r["depth"]) for r in graph.expand(edges, session.createDataFrame([(start,)], "node string"), depth, min_confidence=least).collect()}
        got = {(r["node"], r["depth"]) for r in session.sql(f"SELECT * FROM expand('{start}', {depth}, {least}D)").collect()}
        assert got - {(start, d) for d in range(9)} == want, (start, depth)
    assert session.createDataFrame([(1,)], "x int").select(F.lit(1)).count() == 1
