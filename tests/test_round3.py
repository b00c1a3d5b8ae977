"""What the findings of round 3 named, on tables made for them."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import quarrylake.plans.indexes  # noqa: F401  adds queries
import quarrylake.plans.more  # noqa: F401  adds queries
import quarrylake.plans.rows  # noqa: F401  adds queries
from quarrylake.functions import text
from quarrylake.functions.kernels import chunk_lines, jaro_winkler, tool_runs
from quarrylake.operators import cells, graph, indexing, knowledge, transcripts, vector
from quarrylake.plans import queries
from quarrylake.plans.queries import ORACLES, QUERIES


def _agrees(spark, folder, name, **tables):
    """The rows of a query on these tables, sorted, once they are those of its SQL."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    out = QUERIES[name](spark, str(folder))
    got = sorted(tuple(r) for r in out.collect())
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in out.columns)} FROM ({ORACLES[name]})").fetchall()
    assert got == sorted(want)
    return got


REGION = ([(0, "r")], "r_regionkey long, r_name string")


def test_postings_search_finds_sharp_s_by_its_capital(spark, tmp_path):
    docs = [(1, "erßie im Wald"), (2, "ersie"), (3, "ERẞIE"), (4, "erssie"), (5, None), (6, "ŉa ŉa")]
    items = [(0, "erßie oder"), (1, "ŉa b"), (2, "")]
    got = _agrees(spark, tmp_path, "postings_search", region=REGION, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    assert [r for r in got if r[0] == "ERẞIE"] == [("ERẞIE", 1), ("ERẞIE", 3)]


def test_scalars_have_days_as_the_sql_says_them(spark, tmp_path):
    users = [0, 1, 59, 60, 61, 119, 120, 3599, 3600, 7199, 7200, 86399, 86400, 172799, 172800, 90 * 86400]
    got = _agrees(spark, tmp_path, "scalars", events=([(k, u, "click") for k, u in enumerate(users)], "event_id long, user_id long, event_type string"))
    assert [r[1] for r in got][-5:-2] == ["23 hours ago", "1 days ago", "1 days ago"]
    one = spark.range(1).select(text.time_ago(F.lit(86400)))  # the operator itself has a singular, as the reference does
    assert one.first()[0] == "1 day ago"


def test_note_pairs_compare_bytes_as_the_sql_does(spark, tmp_path):
    words = ["ción ñez la", "cion nez la", "ñañaña", "ñaxaya", "nanana", "ßöüä", "ßöüa", "aañóñó", "aaáéíú", "a" * 199 + "ñb", "a" * 150 + "ñ" * 60]
    items = [(k, w) for k, w in enumerate([*words, "ción ñez la"])]
    got = _agrees(spark, tmp_path, "note_pairs", benchmark=(items, "item_id long, text string"))
    apart = [(x, y) for k, (x, a) in enumerate(items) for y, b in items[k + 1 :] if jaro_winkler(a[:200], b[:200]) >= 0.7]
    assert (0, 11) in got and (7, 8) in got and (7, 8) not in apart


def _expanded(edges, starts, depth):
    """start, node, depth, path by plain loops."""
    out = []
    for s in starts:
        seen, front = {s}, {s: ()}
        for d in range(1, depth + 1):
            found = {}
            for i, a, b, c in edges:
                for x, y in ((a, b), (b, a)):
                    if x in front and y not in seen:
                        found[y] = min(found.get(y, (9,)), (-c, i, front[x]))
            front = {y: (*p, i) for y, (_, i, p) in found.items()}
            seen |= set(front)
            out += [(s, y, d, list(p)) for y, p in front.items()]
    return sorted(out)


def test_expansion_of_starts_that_share_nodes(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(f"h{k}", f"c{k}", f"n{k % 3}", rng.randrange(3, 10) / 10) for k in range(60)]
    # edges that share an id, both ways and to themselves
    edges += [(f"e{rng.randrange(12)}", f"v{rng.randrange(25)}", f"v{rng.randrange(25)}", rng.choice([0.5, 0.9])) for _ in range(60)] + [("x", "v1", "c1", 0.5)]
    df = spark.createDataFrame([(*e, "r") for e in edges], "id string, from_node string, to_node string, confidence double, relationship string")
    starts = [f"c{k}" for k in range(60)] + ["v1", "v2", "n0", "nowhere"]
    sizes, put = [], graph.written
    monkeypatch.setattr(graph, "written", lambda d, name: (t := put(d, name), sizes.append((name, t.count())))[0])
    got = graph.expand(df, spark.createDataFrame([(s,) for s in starts + ["c1"]], "node string"), 3)
    assert sorted((r["start"], r["node"], r["depth"], r["path"]) for r in got.collect()) == _expanded(edges, starts, 3)
    # the second level has 20 nodes for each of three hubs, not for each of 60 starts
    assert [n for name, n in sizes if name == "reached"][1] < 250


def test_neighbours_among_copies_in_bounded_memory(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(900, 6)) * 3, 1)
    x[100:500], x[500:640] = x[0], x[1]  # two large groups of copies
    x = x[rng.permutation(900)].astype(np.float32).astype(float)
    v = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 4 = 0").selectExpr("vec_id as qid", "embedding as q")
    want = {}
    for k in range(0, 900, 4):
        d = np.sqrt(((x - x[k]) ** 2).sum(1))
        want[k] = [(j, round(float(d[j]), 9)) for j in np.lexsort((np.arange(900), d))[:7]]
    index = cells.VectorCells(spark, f"file://{tmp_path}")
    index.build(v)
    for name in ("QUERY_BLOCK", "BLOCK_VALUES", "AT_ONCE"):  # blocks of ten queries, a few distances at once
        monkeypatch.setattr(vector, name, 64)
    for out in (vector.knn_batch(v, q, 7), index.knn(q, 7).withColumnRenamed("id", "vec_id")):
        # queries and vectors meet in the tasks and are not joined pair by pair
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {}
        for r in out.orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["vec_id"], round(r["distance"], 9)))
        assert got == want
    best = vector.Nearest(x[:50], 5)
    for s in range(0, 900, 90):
        best.add(np.arange(s, s + 90), x[s : s + 90])
        assert best.held <= max(1 << 18, 4 * 5 * 50) + 64


def test_ingest_brings_each_session_together_twice(spark):
    rng, rows = random.Random(8), []
    for s in range(30):
        for n in range(rng.randrange(1, 60)):
            tool = rng.choice(["Bash"] * 6 + ["Edit", None])
            rows.append((f"s{s}", n, "tool_use" if tool else "user", rng.choice(["cargo test", "cargo tests", "cargo test", "ls", "no, stop", "", None]), tool, f"u{n}", not tool and rng.random() < 0.2))
    e = spark.createDataFrame(rows, "session_id string, n long, kind string, text string, tool_name string, tool_use_id string, is_error boolean")
    want = []
    for s in {r[0] for r in rows}:
        uses, own = [], sorted((r for r in rows if r[0] == s and r[4]), key=lambda r: r[1])
        for r in own:
            if uses and uses[-1][1] != r[4]:
                want += [(s, *f) for f in tool_runs(uses)]
                uses = []
            uses.append((r[1], r[4], r[3] or ""))
        want += [(s, *f) for f in tool_runs(uses)]
    assert len(want) > 10 and sorted(tuple(r) for r in transcripts.repeated_tools(e).collect()) == sorted(want)
    plan = transcripts.extract_all(e)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(session_id") <= 4 and "FlatMapGroups" not in plan
    # one title in every session: no window over it
    fresh, report = transcripts.ingest(e, spark.createDataFrame([], "title string"))
    assert "Window" not in fresh._jdf.queryExecution().optimizedPlan().toString()
    titles = [(r["title"] or "").lower() for r in fresh.collect()]
    assert len(titles) == len(set(titles)) == sum(r["stored"] for r in report.collect())


def test_edge_feed_keeps_a_large_limit_in_ranges(spark, monkeypatch):
    symbols = spark.createDataFrame([(k, f"f{k}", "import" if k == 7 else "function") for k in range(40)], "id long, symbol_name string, symbol_kind string")
    kinds = ["inherits", "other", "calls", "imports"]
    edges = spark.createDataFrame([(e, e * 7 % 40, f"g{e}", kinds[e % 4]) for e in range(900)], "id long, source_symbol_id long, target_symbol_name string, edge_kind string")
    place = {"calls": 0, "inherits": 1, "imports": 2, "other": 3}
    want = [f"g{e}" for _, e in sorted((place[kinds[e % 4]], e) for e in range(900) if e * 7 % 40 != 7)]
    monkeypatch.setattr(knowledge, "ONE_TASK", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for limit in (5, 11, 333, 5000):
            out = knowledge.edge_feed(symbols, edges, limit)
            assert [r["target"] for r in out.collect()] == want[:limit]
            assert limit == 5 or "Limit" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert knowledge.edge_feed(symbols, edges.limit(0), 50).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("frequent", [3, 1000])
def test_facts_of_frequent_labels(spark, monkeypatch, frequent):
    rows = [("solution", f"s{k % 30}", "related_to", "concept", ["Red", "red", " blue", "rare" + str(k), ""][k % 5]) for k in range(60)] + [("agent", "a", "used", "tool", f"t{k}") for k in range(9)]
    facts = spark.createDataFrame(rows, "from_type string, from_label string, relationship string, to_type string, to_label string")
    nodes, edges = spark.createDataFrame([("old", "concept", "RED", None, 1)], knowledge.NODES), spark.createDataFrame([], knowledge.EDGES)
    monkeypatch.setattr(knowledge, "FREQUENT", frequent, raising=False)
    made, linked = knowledge.write_facts(nodes, edges, facts)
    label = {r["id"]: (r["entity_type"], r["label"].strip().lower()) for r in made.collect()}
    got = sorted((*label[r["from_node"]], r["relationship"], *label[r["to_node"]]) for r in linked.collect())
    assert got == sorted({(a, b.lower(), r, c, d.strip().lower()) for a, b, r, c, d in rows if d.strip()})
    assert sum(r["to_node"] == "old" for r in linked.collect()) == len({r[1] for r in rows if r[4].lower() == "red"})
    # frequent labels are looked up by a join that sends them to the facts, on either end
    assert linked._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 2


def test_chunks_of_a_large_batch_are_passed_on_in_parts(spark, monkeypatch):
    texts = ["\n".join(f"line {n} of {k}" for n in range(k * 7)) for k in range(60)] + ["", None]
    monkeypatch.setattr(indexing, "PASSED_ON", 20_000, raising=False)
    batch = pa.RecordBatch.from_pydict({"path": [f"p{k}" for k in range(61)], "content": texts[:61]})
    out = list(indexing._chunk_batches(iter([batch])))
    assert len(out) > 5 and max(sum(map(len, b.column("content").to_pylist())) for b in out) < 20_000 + max(len(t) for t in texts[:61]) * 1.2
    want = sorted((f"p{k}", *c.values()) for k, t in enumerate(texts[:61]) for c in chunk_lines(t))
    assert sorted(tuple(r.values()) for b in out for r in b.to_pylist()) == want
    files = spark.createDataFrame([(f"p{k}", t) for k, t in enumerate(texts)], "path string, content string")
    got = indexing.chunked(files)
    assert sorted(tuple(r)[:5] for r in got.collect()) == want and got.select("path")._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 0


def test_structural_facts_are_dealt_by_the_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "TASK_ROWS", 40, raising=False)
    rng = random.Random(2)
    part = [(k, f"b{k % 3}", f"t{k % 2}", k) for k in range(30)]
    lines = [(rng.randrange(40), rng.randrange(5), rng.randrange(30)) for _ in range(300)]
    _agrees(spark, tmp_path, "structural_facts", part=(part, "p_partkey long, p_brand string, p_type string, p_size int"), supplier=([(k,) for k in range(40)], "s_suppkey long"), lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long"))
    plan = QUERIES["structural_facts"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", 8") == 3  # both sides of the join of rows, and the facts
