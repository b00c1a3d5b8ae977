"""Writers, the index of files, renderings, streams and joins on hand-made fixtures."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from quarrylake.functions import kernels, text
from quarrylake.operators import graph, indexing, joins, knowledge, lookup, memory, metrics, structure, tables, transcripts, vector
from quarrylake.sources import files
from quarrylake.streaming import changes


def test_ignore_lines():
    import re

    cases = [
        ("*.log", "a/b.log", True), ("*.log", "a/b.logs", False), ("/a", "a/x", True), ("/a", "b/a", False), ("out/", "out", False), ("out/", "x/out/y", True),
        ("a/*.py", "a/x.py", True), ("a/*.py", "a/b/x.py", False), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("**/t", "q/t/u", True), ("d/**", "d/e", True),
        ("x?z", "xyz", True), ("x[ab]z", "xbz", True), ("x[!ab]z", "xbz", False), ("\\#a", "#a", True),
    ]
    for line, path, want in cases:
        again, regex = files.ignore_regex(line)
        assert not again and bool(re.search(regex, path)) == want, (line, path)
    assert files.ignore_regex("# x") is None and files.ignore_regex("  ") is None and files.ignore_regex("!a")[0]


def test_scan_heeds_ignore_files(spark, tmp_path):
    def put(p, content="x = 1\n"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(content)

    for p in ("src/a.py", "src/B.RS", "src/gen/c.py", "src/gen/keep.py", ".hidden/d.py", "src/.e.py", "notes.txt", "doc/f.md", "target/g.py", "sub/h.go", "sub/i.go"):
        put(p)
    put(".gitignore", "**/gen/*\n!keep.py\n")
    put("sub/.gitignore", "/i.go\n")
    put("src/big.py", "x" * 300)
    got = {r["path"]: r["language"] for r in files.scan(spark, f"file://{tmp_path}", max_bytes=200).collect()}
    assert got == {"src/a.py": "python", "src/B.RS": "rust", "src/gen/keep.py": "python", "doc/f.md": "markdown", "sub/h.go": "go"}
    assert files.scan_report(spark, f"file://{tmp_path}", 200).first() == (9, 5, 4)  # ignore files are found, not taken


def test_logs_and_seeds(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("one\ntwo\nthree\n")
    (tmp_path / "b.txt").write_text("no")
    assert [(r["line_no"], r["value"]) for r in files.session_logs(spark, str(tmp_path)).orderBy("line_no").collect()] == [(0, "one"), (1, "two"), (2, "three")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/x.md").write_text('---\ntitle: "Use locks"\nseverity: warning\ntags: [a, "b", ]\ntools: []\nproblem: races\n---\n\nBody\n')
    seed = files.seeds(spark, str(tmp_path / "s"))
    assert seed.select("title", "severity", "tags", "tools", "problem", "content").first() == ("Use locks", "warning", ["a", "b"], [], "races", "Body")
    old = spark.createDataFrame([("Use locks", "old"), ("Other", "o")], "title string, content string")
    assert {r["content"] for r in files.import_seeds(old, seed).collect()} == {"old", "o"} and {r["content"] for r in files.import_seeds(old, seed, True).collect()} == {"Body", "o"}
    facts = {(r["relationship"], r["to_label"]) for r in knowledge.seed_facts(seed.withColumn("tools", F.array(F.lit("mutex")))).collect()}
    assert facts == {("used", "mutex"), ("solved", "races")}
    assert files.known_names(spark, str(tmp_path / "nowhere")).count() == 0


def test_index_of_files(spark):
    def listing(rows):
        return spark.createDataFrame(rows, "path string, mtime long, size long, hash string, language string, content string")

    a = ("a/x.py", 1, 9, "h1", "python", "def f():\n    return g()\n\ndef g():\n    return 1\n")
    b = ("a/y.rs", 1, 9, "h2", "rust", "fn top() {\n    low();\n}\nfn low() {}\n")
    state, report = indexing.index_repo(indexing.empty(spark), listing([a, b]))
    state = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in state.items()}
    assert report.first() == (2, 0, 0, 0) and state["chunks"].count() == 2 and state["ledger"].count() == 2
    assert {(r["symbol_name"], r["symbol_kind"]) for r in state["symbols"].filter("symbol_kind <> 'call_site'").collect()} == {("f", "function"), ("g", "function"), ("top", "function"), ("low", "function")}
    assert {r["symbol_name"] for r in structure.callers(state["symbols"], state["edges"], spark.createDataFrame([("low",), ("g",)], "name string")).collect()} == {"top", "f"}
    newer = (*a[:1], 2, 9, "h3", "python", "def only():\n    pass\n")
    again, report = indexing.diff_index(state, listing([newer]))
    assert report.first() == (0, 1, 0, 1)
    assert [r["path"] for r in again["ledger"].collect()] == ["a/x.py"] and {r["symbol_name"] for r in again["symbols"].collect()} == {"only", "top", "low"}
    assert {r["path"] for r in again["chunks"].collect()} == {"a/x.py"} and len(again["chunks"].first()["embedding"]) == 384
    full = indexing.full_reindex(state, listing([a]), "a")
    assert [r["path"] for r in full["ledger"].collect()] == ["a/x.py"] and full["symbols"].filter("language = 'rust'").count() == 0
    assert indexing.trigger_reindex(state)["ledger"].count() == 0 and indexing.trigger_reindex(state, path="a/x.py")["chunks"].count() == 1


def test_brace_languages():
    rust = "use a::b;\nstruct S { x: i32 }\nimpl S {\n    pub fn go(&self) -> i32 {\n        self.step(\"}\")\n    }\n}\ntrait T {}\n#[test]\nfn works() {\n    go();\n}\n"
    got = [(s["symbol_name"], s["symbol_kind"], s["start_line"], s["end_line"], s["scope"]) for s in kernels.symbols(rust, "rust")]
    assert got == [
        ("a::b", "import", 0, 0, None), ("S", "class", 1, 1, None), ("go", "method", 3, 5, "S"), ("step", "call_site", 4, 4, "S.go"), ("T", "interface", 7, 7, None),
        ("works", "test", 9, 11, None), ("go", "call_site", 10, 10, "works"),
    ]
    go = 'import (\n  "fmt"\n)\ntype T struct {\n}\nfunc (t *T) Run() {\n  add(1)\n}\nfunc TestRun(x int) { Run() }\n'
    got = [(s["symbol_name"], s["symbol_kind"], s["scope"]) for s in kernels.symbols(go, "go")]
    assert got == [("fmt", "import", None), ("T", "class", None), ("Run", "method", "T"), ("add", "call_site", "T.Run"), ("TestRun", "test", None), ("Run", "call_site", "TestRun")]
    ts = 'import x from "y";\nexport class B {\n  run(a: number): void {\n    foo(a);\n  }\n}\nconst f = (x) => { return bar(x); }\ntest("it adds", () => { f(1); });\n'
    got = [(s["symbol_name"], s["symbol_kind"], s["scope"]) for s in kernels.symbols(ts, "typescript")]
    assert got == [("y", "import", None), ("B", "class", None), ("run", "method", "B"), ("foo", "call_site", "B.run"), ("f", "function", None), ("bar", "call_site", "f"), ("it adds", "test", None), ("f", "call_site", "it adds")]


def test_resolve_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 12, 400)]
    labels, probes = list(dict.fromkeys(words[:250])), list(dict.fromkeys(words[250:]))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for p in probes:
        best = None
        for k, w in enumerate(labels):
            ratio = min(len(p), len(w)) / max(len(p), len(w))
            tier = 1 if p == w else 2 if (p in w or w in p) and ratio > 0.5 else 3 if edits(p, w) <= 2 else None
            if tier:
                score = 1.0 if tier == 1 else ratio if tier == 2 else 1 - edits(p, w) / max(len(p), len(w))
                best = min(best or (9,), (tier, -score, k))
        if best:
            want[p] = (best[2], best[0])
    got = graph.resolve(spark.createDataFrame([(p,) for p in [*probes, None, ""]], "probe string"), spark.createDataFrame(list(enumerate(labels)) + [(9999, None)], "id long, label string"))
    assert {r["probe"]: (r["id"], r["tier"]) for r in got.collect()} == want


def test_selection_against_one_pass(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[k % 2], k, float(rng.integers(0, 6)), int(rng.choice([10, 90, 400, 900, 9000])), bool(rng.random() < 0.1)) for k in range(600)]
    got = memory.select_within(spark.createDataFrame(rows, "g string, id long, score double, chars long, critical boolean"), 60, ["g"]).collect()
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        want = {own[k][1] for k in kernels.budget_pick([r[2:] for r in own], 60)}
        assert {r["id"] for r in got if r["g"] == g} == want


def test_neighbours_of_many_with_ties(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(0, 3, (300, 4)).astype(float).tolist()
    v = spark.createDataFrame([*enumerate(vectors), (1000, None), (1001, [1.0])], "vec_id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(k, vectors[k]) for k in range(0, 300, 50)] + [(999, None)], "qid long, q array<float>")
    got = {}
    for r in vector.knn_batch(v, q, 5, block=4).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["vec_id"]
    for k in range(0, 300, 50):
        near = sorted(range(300), key=lambda j: (np.sqrt(((np.array(vectors[j]) - vectors[k]) ** 2).sum()), j))[:5]
        assert [got[k][r] for r in range(1, 6)] == near
    assert set(got) == set(range(0, 300, 50))


def test_entities_and_edges(spark):
    nodes = spark.createDataFrame([("n1", "concept", "Databases", None, 3), ("n2", "tool", "cargo", None, 0)], knowledge.NODES)
    want = spark.createDataFrame([("concept", "the databases"), ("concept", "databasse"), ("tool", "database"), ("tool", " "), ("tool", None)], "entity_type string, label string")
    strict, found = knowledge.ensure_entities(nodes, want)
    assert strict.count() == 4 and {r["label"]: r["id"] for r in found.collect()}["the databases"] == "n1"
    near, found = knowledge.ensure_entities(nodes, want, fuzzy=True)
    assert near.count() == 3 and {(r["entity_type"], r["label"]): r["id"] for r in found.collect()}["concept", "databasse"] == "n1"
    assert near.filter("id = 'n1'").first()["access_count"] == 5
    empty = spark.createDataFrame([], knowledge.EDGES)
    one = knowledge.ensure_edges(empty, spark.createDataFrame([("n1", "n2", "uses"), ("n1", "n2", "uses"), (None, "n2", "uses")], "from_node string, to_node string, relationship string"))
    assert one.count() == 1 and one.first()["provisional"] and knowledge.ensure_edges(one, one).count() == 1
    facts = spark.createDataFrame([("s", "solution", "p", "solved"), ("s", "solution", "p", "failed_for"), ("s", "solution", "q", "solved")], "from_label string, from_type string, to_label string, relationship string")
    assert [tuple(r) for r in knowledge.contradictions(facts).collect()] == [("s", "p")]
    left, edges = graph.remove_nodes(nodes, one, spark.createDataFrame([("n2",)], "id string"))
    assert left.count() == 1 and edges.count() == 0
    starts = graph.start_nodes(nodes.withColumn("record_id", F.lit("r")), "CARGO", record="r")
    assert sorted(r["node"] for r in starts.collect()) == ["n1", "n2"]


def test_memory_renderings(spark, tmp_path):
    lines = spark.createDataFrame(list(enumerate(["# mine", "- [Old](old.md) - was", "- [Gone](gone.md) - x", "text"])), "k int, value string")
    entries = spark.createDataFrame([("old.md", "- [Old](old.md) - is"), ("new.md", "- [New](new.md) - n")], "file string, line string")
    active = spark.createDataFrame([("old.md",), ("new.md",)], "file string")
    got = [r["value"] for r in memory.update_index(lines, entries, active).orderBy("k").collect()]
    assert got == ["# mine", "- [Old](old.md) - is", "text", "- [New](new.md) - n"]
    assert memory.update_index(lines, entries, active, 2).count() == 2
    memory.write_files(spark.createDataFrame([("a.md", "A"), ("b.md", "é")], "file string, text string"), f"file://{tmp_path}/out")
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.md": "A", "b.md": "é"}
    stale = memory.stale_files(spark.createDataFrame([("r-12345678.md",), ("r-87654321.md",), ("x.md",)], "file string"), spark.createDataFrame([("lesson_12345678ab",)], "id string"), "r-")
    assert [r["file"] for r in stale.collect()] == ["r-87654321.md"]
    rule = spark.createDataFrame([(["*.rs", "b"], "critical", "T", "C")], "g array<string>, s string, t string, c string").select(memory.rule_file(*map(F.col, "gstc")).alias("r")).first()["r"]
    assert rule == '---\nglobs: ["*.rs", "b"]\n---\n\n## [critical] T\n\nC\n'
    table = {(r["tag"], r["glob"]) for r in memory.tag_globs(spark, {"Rust": ["x"]}).collect()}
    assert ("rust", "x") in table and ("rust", "*.rs") not in table and ("toml", "**/*.toml") in table


def test_injection(spark):
    def packed(rows, chars=2000):
        return memory.packed_injection(spark.createDataFrame(rows, "title string, content string, score double"), chars).first()

    head = '---\nglobs: ["*"]\n---\n\n'
    assert packed([]) == ("", 0)
    assert packed([("b", "B", 0.5), ("a", "A", 0.9)]) == (head + "## [info] a\n\nA\n\n## [info] b\n\nB\n\n", 2)
    text_, n = packed([("a", "line\n" * 100, 0.9), ("b", "B", 0.5)], 200)
    assert n == 1 and text_.endswith("line...\n\n") and len(text_) <= 200 + 3


def test_new_against_known_and_novel(spark):
    new = spark.createDataFrame([("n1", "Use Locks", "x", 1), ("n2", "other", "always hold the lock", 1), ("n3", "none", "zzz", 1), ("n4", "use locks", "x", 2)], "id string, title string, content string, g int")
    known = spark.createDataFrame([("k1", "use locks", "q", 1), ("k2", "w", "always hold the locks", 1)], "id string, title string, content string, g int")
    assert {(r["id"], r["known_id"]) for r in memory.new_against_known(new, known, ["g"]).collect()} == {("n1", "k1"), ("n2", "k2")}
    hits = spark.createDataFrame([("A", "see Locks", 0.9), ("B", "free", 0.8), ("C", "free", 0.1)], "title string, content string, score double")
    assert [r["title"] for r in vector.novel(hits, spark.createDataFrame([("locks",)], "name string"), 0.5, 5).collect()] == ["B"]


def test_sessions_teach(spark):
    rows = [
        ("s", 0, "user", "please build", None, None, False), ("s", 1, "tool_use", "", "Bash", "t1", False), ("s", 2, "tool_result", "ok\nerror[E01]: bad", None, "t1", True),
        ("s", 3, "tool_use", "", "Edit", "t2", False), ("s", 4, "tool_result", "fine", None, "t2", False), ("s", 5, "user", "No, that is wrong", None, None, False),
        ("s", 6, "assistant", "yes", None, None, False), ("s", 7, "user", "No, that is wrong", None, None, False), ("s", 8, "user", "remember this", None, None, False),
        ("t", 0, "tool_use", "", "Read", "t3", False), ("t", 1, "tool_result", "FAILED", None, "t3", False), ("t", 2, "user", "remember this", None, None, False),
    ]
    e = spark.createDataFrame(rows, "session_id string, n long, kind string, text string, tool_name string, tool_use_id string, is_error boolean")
    build = transcripts.build_failures(e).collect()
    assert [(r["session_id"], r["n"], r["snippet"], r["severity"], r["fix"]) for r in build] == [("s", 2, "error[E01]: bad", "critical", "Edit")]
    taught = [(r["session_id"], r["n"], r["rule"]) for r in transcripts.extract_all(e).orderBy("session_id", "rule", "n").collect()]
    assert taught == [("s", 7, 1), ("s", 2, 2), ("s", 8, 3), ("s", 2, 5), ("t", 2, 3)]
    fresh, report = transcripts.ingest(e, spark.createDataFrame([("x",)], "title string"))
    assert {r["session_id"]: (r["found"], r["stored"]) for r in report.collect()} == {"s": (4, 4), "t": (1, 0)} and fresh.count() == 4
    assert transcripts.ingest(e, spark.createDataFrame([("REMEMBER THIS",)], "title string"), True)[0].count() == 0
    assert metrics.ingest_totals(report).first() == (2, 5, 4, 0)


def test_catalog_and_nulls(spark, tmp_path):
    c = tables.Catalog(spark, str(tmp_path))
    assert c.version("t") == -1
    c.commit({"t": spark.createDataFrame([(1, "a"), (None, "n")], "id int, v string"), "u": spark.createDataFrame([(1,)], "x int")})
    c.merge("t", spark.createDataFrame([(None, "m"), (2, "b")], "id int, v string"), ["id"])
    assert c.versions() == {"t": 1, "u": 0} and sorted(map(tuple, c.read("t").collect()), key=repr) == sorted([(1, "a"), (None, "m"), (2, "b")], key=repr)
    c.migrate("u", "x long, y string")
    assert c.verify("u", "x long, y string") and not c.verify("u", "x int") and c.read("u").first() == (1, None)


def test_streams(spark, tmp_path):
    at = "timestamp_seconds(id)"
    spark.createDataFrame([(k + 1000, g) for k, g in ((0, "a"), (299, "a"), (300, "a"), (301, "b"), (310, "b"), (602, "a"))], "id long, k string").selectExpr(f"{at} AS at", "k").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("at timestamp, k string").parquet(f"{tmp_path}/in")
    for name, made in (("let_through", changes.rate_limited(stream(), "k", "at")), ("bursts", changes.debounced(stream(), "k", "at", "20 seconds", "1 second"))):
        q = made.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r["k"], int(r["at"].timestamp())) for r in spark.table("let_through").collect()) == [("a", 1000), ("a", 1300), ("a", 1602), ("b", 1301)]
    assert ("b", 2) in {(r["k"], r["n"]) for r in spark.table("bursts").collect()}
    now = F.timestamp_seconds(F.lit(1600))
    assert changes.settled(spark.read.parquet(f"{tmp_path}/in"), "at", now).count() == 5


def test_range_join(spark):
    rng = np.random.default_rng(6)
    ranges = [(k, int(a), int(a + w)) for k, (a, w) in enumerate(zip(rng.integers(-50, 50, 60), rng.integers(-2, 30, 60)))]
    points = [(k, int(p)) for k, p in enumerate(rng.integers(-60, 90, 80))]
    got = joins.range_join(spark.createDataFrame(ranges, "r long, lo long, hi long"), spark.createDataFrame(points, "p long, at long"), "lo", "hi", "at", [], 10)
    assert sorted((x["r"], x["p"]) for x in got.collect()) == sorted((r, p) for (r, lo, hi), (p, at) in itertools.product(ranges, points) if lo <= at < hi)


def test_text_functions(spark):
    row = spark.range(1).select(
        text.title_cut(F.lit(" a\nb "), 9).alias("a"), text.title_cut(F.lit("abcdef"), 3).alias("b"), text.time_ago(F.lit(3600)).alias("c"), text.time_ago(F.lit(1)).alias("d"),
        text.string_list(F.lit('{"k":[1,"x"]}'), "k").alias("e"), text.string_list(F.lit("nonsense"), "k").alias("f"), text.residual(F.lit('{"a":1}'), ("a",)).alias("g"), text.bullets(F.array(F.lit("x"), F.lit("y"))).alias("h"),
        text.error_snippet(F.lit("ok\nFAILED here"), ("FAILED",)).alias("i"), text.pooled(F.array(F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(1))).alias("j"), text.agent_of(F.lit(None).cast("string")).alias("k"),
    ).first()
    assert tuple(row) == ("a b", "abc...", "1 hour ago", "1 seconds ago", ["x"], [], None, "- x\n- y", "FAILED here", [0.6, 0.8], "unknown")
    ids = spark.range(1).select(text.new_id("l", F.lit("a")).alias("x"), text.new_id("l", F.lit("a")).alias("y")).first()
    assert ids["x"] == ids["y"] and ids["x"].startswith("l_") and lookup.options(None, 3.0) == (10, 1.0)
