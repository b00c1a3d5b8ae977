"""Small fixtures with hand-made results."""

import json

from pyspark.sql import functions as F

from quarrylake.functions import kernels, text
from quarrylake.operators import graph, memory, structure, tables, transcripts
from quarrylake.sources import files
from quarrylake.streaming import changes


def _graph(spark):
    nodes = spark.createDataFrame([("a1", "helper"), ("t1", "cargo"), ("c1", "rust"), ("p1", "build_error")], "id string, label string")
    edges = spark.createDataFrame(
        [("e1", "a1", "t1", "used", 0.8), ("e2", "t1", "c1", "related_to", 0.6), ("e3", "a1", "p1", "solved", 0.9), ("e4", "c1", "p1", "related_to", 0.1)],
        "id string, from_node string, to_node string, relationship string, confidence double",
    )
    return nodes, edges


def test_expand(spark):
    nodes, edges = _graph(spark)
    start = spark.createDataFrame([("a1",)], "node string")
    one = graph.expand(edges, start, 1, "outgoing")
    assert {r["node"] for r in one.collect()} == {"t1", "p1"}
    two = {r["node"]: (r["depth"], r["path"]) for r in graph.expand(edges, start, 2, "outgoing").collect()}
    assert two["c1"] == (2, ["e1", "e2"]) and len(two) == 3


def test_outcome_and_garbage(spark):
    nodes, edges = _graph(spark)
    e = edges.withColumns({"provisional": F.lit(True), "success_count": F.lit(1), "failure_count": F.lit(0)})
    o = spark.createDataFrame([("e1", "success"), ("e3", "failure"), ("zz", "success")], "id string, outcome string")
    got = {r["id"]: r for r in graph.apply_outcome(e, o).collect()}
    assert round(got["e1"]["confidence"], 6) == 1.0 and not got["e1"]["provisional"]
    assert round(got["e3"]["confidence"], 6) == 0.75 and got["e2"]["confidence"] == 0.6
    kept, left = graph.collect_garbage(nodes.withColumn("created_at", F.lit(0)), edges.filter("id in ('e1', 'e4')"), F.lit(10), 0.5)
    assert {r["id"] for r in kept.collect()} == {"a1", "t1"} and left.count() == 1


def test_resolve(spark):
    labels = spark.createDataFrame([(1, "Build Error"), (2, "database"), (3, "graphs")], "id long, label string")
    probes = spark.createDataFrame([("the build error",), ("databases",), ("grapes",), ("zzz",)], "probe string")
    got = {r["probe"]: (r["id"], r["tier"]) for r in graph.resolve(probes, labels).collect()}
    assert got == {"the build error": (1, 1), "databases": (2, 2), "grapes": (3, 3)}


def test_jaro_winkler():
    assert round(kernels.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert kernels.jaro_winkler("", "") == 1.0 and kernels.jaro_winkler("a", "b") == 0.0


def test_chunks():
    assert kernels.chunk_lines("") == [] and len(kernels.chunk_lines("a\nb")) == 1
    parts = kernels.chunk_lines("\n".join(f"x{i}" for i in range(250)))
    assert [(p["start_line"], p["end_line"]) for p in parts[:2]] == [(1, 50), (46, 95)] and parts[-1]["end_line"] == 250


def test_python_structure(spark):
    source = "import os\nclass A:\n    def m(self):\n        return helper(1)\ndef helper(x):\n    return x\ndef test_helper():\n    helper(2)\n"
    rows = [(k, "a.py", r["symbol_name"], r["symbol_kind"], "python", r["start_line"], r["scope"]) for k, r in enumerate(kernels.symbols(source, "python"))]
    s = spark.createDataFrame(rows, "id long, file_path string, symbol_name string, symbol_kind string, language string, start_line int, scope string")
    edges = structure.call_edges(s)
    names = spark.createDataFrame([("helper",)], "name string")
    assert {r["symbol_name"] for r in structure.callers(s, edges, names).collect()} == {"m", "test_helper"}
    assert [r["test"] for r in structure.tests_of(s).collect()] == ["test_helper"]
    assert structure.query_structure(s, edges, "contains", "A").first()["symbol_name"] == "m"


def test_transcripts(spark):
    def line(k, kind, content):
        return json.dumps({"uuid": str(k), "type": kind, "timestamp": "2024-01-01T00:00:00Z", "sessionId": "s", "message": {"role": kind, "content": content}})

    lines = [
        line(0, "user", "please build"), line(1, "assistant", [{"type": "tool_use", "id": "t", "name": "Bash", "input": {}}]),
        line(2, "user", [{"type": "tool_result", "tool_use_id": "t", "is_error": True}]), "not json", line(4, "assistant", "done"),
        line(5, "user", "No, that is wrong"),
    ]
    e = transcripts.parse(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))
    assert [r["kind"] for r in e.orderBy("n").collect()] == ["user", "tool_use", "tool_result", "assistant", "user"]
    assert [r["n"] for r in transcripts.corrections(e).collect()] == [5]
    assert transcripts.failures(e).first()["tool_name"] == "Bash"


def test_memory(spark):
    n = spark.createDataFrame([("a", "Use locks", "always lock", "info", 1, 1), ("b", "Use lock", "always lock!", "critical", 2, 1), ("c", "Other", "zzz", "info", 3, 1)], "id string, title string, content string, severity string, updated_at long, g int")
    g = memory.groups(memory.similar_pairs(n, ["g"]))
    got = {r["id"]: r["members"] for r in memory.merged(n, g).collect()}
    assert got == {"b": 2, "c": 1}
    raw = spark.createDataFrame([("n", "d", "user", "body")], "n string, d string, t string, c string").select(memory.memory_file(*map(F.col, "ndtc")).alias("raw"))
    assert raw.select(*[c.alias(k) for k, c in memory.parse_memory(F.col("raw")).items()]).first() == ("n", "d", "user", "body")
    assert kernels.budget_pick([(1.0, 800, True), (0.9, 80, False), (0.5, 10, False)], 12) == [0, 1, 2]


def test_tables(spark, tmp_path):
    c = tables.Catalog(spark, str(tmp_path))
    c.merge("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), ["id"])
    c.merge("t", spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"])
    assert sorted(map(tuple, c.read("t").collect())) == [(1, "a"), (2, "c"), (3, "d")] and c.version("t") == 1


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for p in ("src/a.py", "node_modules/b.js", "src/c.txt"):
        (tmp_path / p).write_text("x = 1\n")
    got = files.scan(spark, f"file://{tmp_path}").collect()
    assert [(r["path"], r["language"], r["content"]) for r in got] == [("src/a.py", "python", "x = 1\n")]


def test_changes(spark, tmp_path):
    e = spark.createDataFrame([(1, "modified", "a", None), (2, "deleted", "a", None), (3, "renamed", "b", "c")], "seq long, op string, path string, to string")
    assert {tuple(r) for r in changes.coalesce_changes(e).collect()} == {("a", "deleted"), ("b", "deleted"), ("c", "modified")}
    (tmp_path / "in").mkdir()
    spark.range(6).selectExpr("timestamp_seconds(id * 200) AS at", "'k' AS k").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, k string").parquet(str(tmp_path / "in"))
    q = changes.rate_limited(stream, "k", "at").writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    # every 200 s from the epoch on, whose own row is as late as the first watermark: 200, then those 300 s behind the last let through
    assert {int(r["at"].timestamp()) for r in spark.table("limited").collect()} == {200, 600, 1000}


def test_text(spark):
    row = spark.range(1).select(
        text.language_of(F.lit("a/B.RS")).alias("l"), text.excluded(F.lit("x/target/a.rs")).alias("e"), text.slug(F.lit("A b!")).alias("s"),
        text.duration_seconds(F.lit("2h")).alias("d"), text.day_of(F.lit(0)).alias("t"), text.epoch_of(F.lit("1970-01-01T00:01:00Z")).alias("i"),
        text.normal_label(F.lit(" The Cat")).alias("n"), text.first_line(F.lit("one two three\nx"), 9).alias("f"),
    ).first()
    assert row == ("rust", True, "a_b", 7200, "1970-01-01", 60, "cat", "one two...")


def test_groups_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int")
    assert {r["group"] for r in memory.groups(pairs).collect()} == {0}
