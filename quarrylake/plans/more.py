"""More operators bound to the driver's tables: writers, graph facts, roll-ups, set operations, renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import kernels, text
from ..operators import graph, indexing, joins, knowledge, lookup, memory, metrics, structure, tables, transcripts, vector
from .queries import _CALLS, _CODE, _EDGES, _L2, _call_edges, _calls, _edges, _entries, _parts, _query, _symbols


# -- counts, lookups, set operations


@_query("distinct_sources", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def _(t):
    return lookup.distinct_values(t("documents"), "source")


@_query("greatest_or", "SELECT coalesce(max(n_chars), 0) AS value FROM documents")
def _(t):
    return lookup.greatest_or(t("documents"), "n_chars")


@_query("exists_row", "SELECT count(*) > 0 AS found FROM labels WHERE toxic = 1")
def _(t):
    return lookup.exists(t("labels").filter("toxic = 1"))


@_query("with_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def _(t):
    return lookup.with_counts(t("customer").select("c_custkey"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@_query("exact_or_like", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'anvil') ORDER BY p_name, p_partkey LIMIT 10")
def _(t):
    p = t("part").withColumn("key", F.concat_ws(" ", "p_name", F.lpad(F.col("p_partkey").cast("string"), 12, "0")))
    return lookup.exact_or_like(p, "key", ["no such name"], "ANVIL").select("p_partkey", "p_name")


@_query("indexed_with_hash", "SELECT page_id::VARCHAR AS path, page_id % 3 <> 0 AS indexed FROM pages")
def _(t):
    p = t("pages").select(F.col("page_id").cast("string").alias("path"), F.md5("url").alias("hash"), "page_id")
    ledger = p.withColumn("hash", F.when(F.col("page_id") % 3 == 0, F.lit("old")).otherwise(F.col("hash")))
    return lookup.indexed_with_hash(ledger, p.select("path", "hash")).select("path", "indexed")


@_query("dashboard", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labels, '1' AS version, 5 AS uptime, 9 AS bytes")
def _(t):
    return lookup.dashboard({"documents": t("documents"), "labels": t("labels")}, "1", 10, 15, 9)


@_query("severity_union", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 1 THEN 'warning' ELSE 'info' END AS severity FROM labels WHERE toxic = 1 OR quality = 1 ORDER BY toxic DESC, doc_id DESC LIMIT 40")
def _(t):
    own = t("labels").select("doc_id", F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 1, "warning").otherwise("info").alias("severity"))
    return lookup.by_severities(own, ["critical", "warning"], [F.desc("doc_id")], 40)


@_query("latest_of_recent", "SELECT user_id, arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 20")
def _(t):
    return lookup.latest_of_recent(t("events"), "user_id", "ts", "event_id", 20).select("user_id", "event_id")


@_query("set_operations", """
SELECT 'both' AS k, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'all', count(*) FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)""")
def _(t):
    a, b = t("documents").select("doc_id"), t("labels").select("doc_id")
    parts = {"both": a.intersect(b), "only": a.subtract(b), "all": a.unionAll(b)}
    return lookup.counts(parts).select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("n")) for k in parts])))


@_query("grouping_sets", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    o = t("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_custkey")
    return o.cube("status", "priority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@_query("rankings", """
SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0) AS before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)""")
def _(t):
    from pyspark.sql import Window as W

    w, u = W.partitionBy("o_custkey").orderBy("o_orderdate"), W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(u).cast("long").alias("q"), F.coalesce(F.lag("o_orderkey").over(u), F.lit(0)).alias("before"))


@_query("range_join", "SELECT b.event_id AS a, e.event_id AS b FROM events b JOIN events e ON b.user_id = e.user_id AND b.event_type = 'purchase' AND e.event_type = 'view' AND e.ts >= b.ts - INTERVAL 6 HOUR AND e.ts < b.ts")
def _(t):
    e = t("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a"), (F.col("at") - 6 * 3600 * 10**6).alias("lo"), F.col("at").alias("hi"))
    right = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("b"), "at")
    return joins.range_join(left, right, "lo", "hi", "at", ["user_id"], 6 * 3600 * 10**6).select("a", "b")


@_query("outer_join", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS has_text, l.doc_id IS NOT NULL AS has_label FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    d, l = t("documents").select("doc_id", F.lit(True).alias("d")), t("labels").select("doc_id", F.lit(True).alias("l"))
    return d.join(l, "doc_id", "full_outer").select("doc_id", F.coalesce("d", F.lit(False)).alias("has_text"), F.coalesce("l", F.lit(False)).alias("has_label"))


# -- graph


def _nodes(t):
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("entity_type"), F.col("c_name").alias("label"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("entity_type"), F.col("n_name").alias("label"))
    r = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("region").alias("entity_type"), F.col("r_name").alias("label"))
    return c.unionByName(n).unionByName(r).withColumns({"record_id": F.lit(None).cast("string"), "access_count": F.lit(0).cast("long")})


_NODES = """nodes AS (SELECT 'c' || c_custkey AS id, 'customer' AS entity_type, c_name AS label FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'region', r_name FROM region)"""


@_query("like_label", f"WITH {_NODES} SELECT id, label FROM nodes WHERE contains(lower(label), 'ation')")
def _(t):
    return graph.like_label(_nodes(t), "ATION").select("id", "label")


@_query("graph_entities", f"WITH {_NODES} SELECT id, label, entity_type, 0 AS depth FROM nodes WHERE entity_type = 'nation' ORDER BY id LIMIT 50")
def _(t):
    return graph.query_graph(_nodes(t), _edges(t), kind="nation")


@_query("query_graph", f"""
WITH {_EDGES}, {_NODES}, b AS (SELECT s, d FROM edges WHERE conf >= 0.3 UNION SELECT d, s FROM edges WHERE conf >= 0.3),
starts AS (SELECT id FROM nodes WHERE contains(lower(label), 'asia')),
one AS (SELECT id AS start, d AS node, 1 AS depth FROM starts JOIN b ON s = id),
two AS (SELECT start, b.d AS node, 2 AS depth FROM one JOIN b ON one.node = b.s WHERE b.d <> start),
near AS (SELECT node, min(depth) AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY node)
SELECT id, label, entity_type, depth FROM near JOIN nodes ON id = node ORDER BY depth, id LIMIT 50""")
def _(t):
    return graph.query_graph(_nodes(t), _edges(t), "Asia", depth=2)


@_query("graph_paths", f"""
WITH {_EDGES}, b AS (SELECT s, d, conf, s || '>' || d AS e FROM edges WHERE conf >= 0.3 UNION ALL SELECT d, s, conf, s || '>' || d FROM edges WHERE conf >= 0.3),
c1 AS (SELECT s AS start, d AS node, -conf AS c, e, e AS path FROM b WHERE s IN ('c11', 'c23', 'r2')),
one AS (SELECT start, node, path FROM c1 QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY c, e) = 1),
c2 AS (SELECT start, b.d AS node, -conf AS c, e, path AS p, path || ' ' || e AS path FROM one JOIN b ON node = s WHERE b.d <> start AND (start, b.d) NOT IN (SELECT (start, node) FROM one)),
two AS (SELECT start, node, path FROM c2 QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY c, e, p) = 1)
SELECT * FROM one UNION ALL SELECT * FROM two""")
def _(t):
    s = t("customer").limit(1).select(F.explode(F.array(F.lit("c11"), F.lit("c23"), F.lit("r2"))).alias("node"))
    return graph.expand(_edges(t), s, 2).select("start", "node", F.array_join("path", " ").alias("path"))


@_query("with_endpoints", f"WITH {_EDGES}, {_NODES} SELECT s || '>' || d AS id, x.label AS from_label, y.label AS to_label FROM edges JOIN nodes x ON s = x.id JOIN nodes y ON d = y.id")
def _(t):
    return graph.with_endpoints(_edges(t), _nodes(t)).select("id", "from_label", "to_label")


@_query("remove_nodes", f"WITH {_EDGES} SELECT s || '>' || d AS id FROM edges WHERE s NOT IN ('n1', 'n7') AND d NOT IN ('n1', 'n7')")
def _(t):
    gone = t("nation").filter("n_nationkey in (1, 7)").select(F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return graph.remove_nodes(_nodes(t), _edges(t), gone)[1].select("id")


@_query("graph_view", f"WITH {_EDGES} SELECT s AS from_node, d AS to_node, r AS relationship, conf AS weight FROM edges")
def _(t):
    return graph.view(_nodes(t), _edges(t))[1]


@_query("ensure_entities", """
WITH want AS (SELECT 'nation' AS entity_type, upper(n_name) AS label FROM nation UNION ALL SELECT 'word', unnest(string_split(p_name, ' ')) FROM part)
SELECT entity_type, count(DISTINCT lower(label)) AS n, sum(CASE WHEN entity_type = 'nation' THEN 1 ELSE 0 END)::BIGINT AS hits FROM want GROUP BY entity_type
UNION ALL SELECT 'customer', count(*), 0 FROM customer UNION ALL SELECT 'region', count(*), 0 FROM region""")
def _(t):
    want = t("nation").select(F.lit("nation").alias("entity_type"), F.upper("n_name").alias("label"))
    want = want.unionByName(t("part").select(F.lit("word").alias("entity_type"), F.explode(F.split("p_name", " ")).alias("label")))
    nodes, _found = knowledge.ensure_entities(_nodes(t), want)
    return nodes.groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("access_count").alias("hits"))


@_query("ensure_edges", f"WITH {_EDGES}, w AS (SELECT s, d, r FROM edges UNION SELECT d, s, r FROM edges) SELECT r AS relationship, count(*) AS n FROM w GROUP BY r")
def _(t):
    e = _edges(t).withColumns({"provisional": F.lit(False), "success_count": F.lit(0), "failure_count": F.lit(0)}).select("id", "from_node", "to_node", "relationship", "confidence", "provisional", "success_count", "failure_count")
    turned = e.select(F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"), "relationship").unionByName(e.select("from_node", "to_node", "relationship"))
    return knowledge.ensure_edges(e, turned).groupBy("relationship").agg(F.count("*").alias("n"))


def _lessons(t):
    sev = F.when(F.col("p_size") % 3 == 0, "critical").when(F.col("p_size") % 3 == 1, "warning").otherwise("info")
    return t("part").select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), F.concat_ws(" ", F.lit("#"), "p_type", "p_brand").alias("content"), sev.alias("severity"), F.split("p_name", " ").alias("tags"))


_LESSONS = """lessons AS (SELECT p_partkey::VARCHAR AS id, p_name || ' ' || p_partkey AS title, '# ' || p_type || ' ' || p_brand AS content,
  CASE p_size % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, string_split(p_name, ' ') AS tags FROM part)"""


@_query("lesson_facts", f"""
WITH {_LESSONS} SELECT 'solution' AS from_type, title AS from_label, 'related_to' AS relationship, 'concept' AS to_type, trim(unnest(tags)) AS to_label FROM lessons
UNION ALL SELECT 'solution', title, 'solved', 'problem', '[' || severity || '] ' || title FROM lessons WHERE severity <> 'info'""")
def _(t):
    return knowledge.lesson_facts(_lessons(t))


@_query("checkpoint_facts", """
WITH c AS (SELECT role AS agent, text AS w FROM conversations)
SELECT 'agent' AS from_type, agent AS from_label, 'related_to' AS relationship, 'chunk' AS to_type, w AS to_label FROM c
UNION ALL SELECT 'chunk', w, 'related_to', 'concept', unnest(list_filter(list_transform(regexp_split_to_array(w, '[,;:|]'), lambda x: trim(x)), lambda x: length(x) > 2)[1:5]) FROM c""")
def _(t):
    return knowledge.checkpoint_facts(t("conversations").select(F.col("role").alias("agent"), F.col("text").alias("working_on")))


@_query("outcome_facts", """
WITH s AS (SELECT s_suppkey::VARCHAR AS w, 'a' || s_suppkey % 5 AS agent, s_suppkey % 2 = 0 AS bad FROM supplier)
SELECT 'agent' AS from_type, agent AS from_label, 'used' AS relationship, 'tool' AS to_type, 'hammer' AS to_label FROM s
UNION ALL SELECT 'chunk', w, 'related_to', 'problem', 'p' || agent FROM s UNION ALL SELECT 'chunk', w, 'solved', 'solution', unnest(['x', 'y']) FROM s
UNION ALL SELECT 'solution', unnest(['x', 'y']), 'failed_for', 'problem', 'p' || agent FROM s WHERE bad""")
def _(t):
    agent = F.concat(F.lit("a"), (F.col("s_suppkey") % 5).cast("string"))
    c = t("supplier").select(agent.alias("agent"), F.col("s_suppkey").cast("string").alias("working_on"), F.array(F.lit("hammer")).alias("tools"), F.array(F.concat(F.lit("p"), agent)).alias("problems"), F.array(F.lit("x"), F.lit("y")).alias("solutions"), F.when(F.col("s_suppkey") % 2 == 0, "failure").otherwise("success").alias("outcome"))
    return knowledge.outcome_facts(c)


@_query("bootstrap_edges", f"""
WITH {_LESSONS}, f AS (SELECT title AS a, 'related_to' AS r, unnest(tags) AS b FROM lessons UNION SELECT title, 'solved', '[' || severity || '] ' || title FROM lessons WHERE severity <> 'info')
SELECT r AS relationship, count(DISTINCT (lower(a), lower(b))) AS n, 0.3::DOUBLE AS confidence FROM f GROUP BY r""")
def _(t):
    s = t("part").sparkSession
    nodes, edges = s.createDataFrame([], knowledge.NODES), s.createDataFrame([], knowledge.EDGES)
    none = t("conversations").limit(0).select(F.col("role").alias("agent"), F.col("text").alias("working_on"))
    return knowledge.bootstrap(nodes, edges, _lessons(t), none)[1].groupBy("relationship").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def _tested(t):
    tests = t("supplier").select((F.col("s_suppkey") + 10**9).alias("id"), F.lit("tests.py").alias("file_path"), F.concat(F.lit("test_f"), "s_suppkey").alias("symbol_name"), F.lit("test").alias("symbol_kind"), F.lit("python").alias("language"), F.lit(0).alias("start_line"), F.lit(None).cast("string").alias("scope"))
    own = _symbols(t)
    return own.unionByName(tests.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in own.schema]))


@_query("review_context_tests", f"""
WITH {_CODE}, own AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#12')
SELECT (SELECT count(*) FROM own) AS n_symbols, (SELECT count(*) FROM e JOIN own ON d = p_partkey) AS n_callers, (SELECT count(*) FROM supplier JOIN own ON s_suppkey = p_partkey) AS n_tests,
  (SELECT count(*) FROM own WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier)) AS n_untested""")
def _(t):
    return structure.review_context(_tested(t), _call_edges(t), t("part").filter("p_brand = 'Brand#12'").select(F.col("p_brand").alias("file_path")))


@_query("structural_facts", f"""
WITH {_CODE}, f AS (
  SELECT DISTINCT p_brand AS a, 'contains' AS r, p_brand || ':f' || p_partkey AS b FROM part UNION SELECT DISTINCT p_brand || ':' || p_type, 'contains', p_brand || ':f' || p_partkey FROM part
  UNION SELECT 'tests.py', 'contains', 'tests.py:test_f' || s_suppkey FROM supplier
  UNION SELECT 'tests.py:test_f' || s_suppkey, 'tests', p_brand || ':f' || p_partkey FROM supplier JOIN part ON s_suppkey = p_partkey
  UNION SELECT x.p_brand || ':f' || s, 'calls', y.p_brand || ':f' || d FROM e JOIN part x ON s = x.p_partkey JOIN part y ON d = y.p_partkey)
SELECT a AS from_label, r AS relationship, b AS to_label FROM f""")
def _(t):
    return knowledge.structural_facts(_tested(t), _call_edges(t), _parts(t("lineitem"))).select("from_label", "relationship", "to_label")


@_query("edge_feed", f"WITH {_CODE} SELECT 'f' || s AS source, 'f' || d AS target, 'calls' AS edge_kind FROM e JOIN part ON s = p_partkey")
def _(t):
    e = _call_edges(t).withColumn("id", F.col("source_symbol_id"))
    return knowledge.edge_feed(_symbols(t), e, 1 << 30)


# -- notes, renderings, sessions


@_query("rules", f"""
WITH {_LESSONS}, g(tag, globs) AS (VALUES ('red', ['a/*.x', 'b/*']), ('anvil', ['b/*'])),
e AS (SELECT id, unnest(tags) AS tag, unnest(range(1, len(tags) + 1)) AS i FROM lessons WHERE severity <> 'info'),
w AS (SELECT id, i, unnest(coalesce(globs, ['**/*' || lower(e.tag) || '*'])) AS gl, unnest(range(1, coalesce(len(globs), 1) + 1)) AS k FROM e LEFT JOIN g ON g.tag = e.tag),
u AS (SELECT id, gl, i, k FROM w QUALIFY row_number() OVER (PARTITION BY id, gl ORDER BY i, k) = 1)
SELECT id, string_agg(gl, ' ' ORDER BY i, k) AS globs FROM u GROUP BY id""")
def _(t):
    globs = t("part").sparkSession.createDataFrame([("red", 0, "a/*.x"), ("red", 1, "b/*"), ("anvil", 0, "b/*")], "tag string, k int, glob string")
    return memory.rules(_lessons(t), globs).select("id", F.array_join("globs", " ").alias("globs"))


@_query("note_memory", f"""
WITH {_LESSONS} SELECT id, title AS name, substr(content, 3) AS description, CASE WHEN severity = 'info' THEN 'project' ELSE 'feedback' END AS type,
  '**[' || upper(severity) || ']**' || chr(10) || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || chr(10) || content AS content, replace(title, ' ', '_') || '.md' AS file FROM lessons""")
def _(t):
    return memory.note_memory(_lessons(t)).drop("line")


@_query("entry_summaries", """
WITH c AS (SELECT conv_id::VARCHAR AS session_id, turn AS n, trim(replace(text, chr(10), ' ')) AS x FROM conversations)
SELECT session_id, n, CASE WHEN length(x) <= 120 THEN x ELSE substr(x, 1, 120) || '...' END AS summary FROM c""")
def _(t):
    e = _entries(t).withColumns({"tool_name": F.lit(None).cast("string"), "is_error": F.lit(False)}).withColumn("kind", F.when(F.col("kind") == "system", "user").otherwise(F.col("kind")))
    return transcripts.summaries(e)


@_query("scalars", """
SELECT event_id, CASE WHEN user_id >= 86400 THEN (user_id // 86400) || ' days ago' WHEN user_id >= 7200 THEN (user_id // 3600) || ' hours ago' WHEN user_id >= 3600 THEN '1 hour ago'
  WHEN user_id >= 120 THEN (user_id // 60) || ' minutes ago' WHEN user_id >= 60 THEN '1 minute ago' ELSE user_id || ' seconds ago' END AS ago,
  replace('a/' || event_type, '/', '-') AS name, CASE WHEN user_id % 2 = 0 THEN 'unknown' ELSE event_type END AS agent, CASE WHEN event_type = 'test' THEN 'test' ELSE 'function' END AS kind FROM events""")
def _(t):
    e = t("events")
    # this SQL has no singular of days; the operator has one
    return e.select("event_id", text.time_ago(F.col("user_id"), ("minute", "hour")).alias("ago"), text.path_name(F.concat(F.lit("a/"), "event_type")).alias("name"), text.agent_of(F.when(F.col("user_id") % 2 == 1, F.col("event_type")).otherwise(" ")).alias("agent"), text.symbol_kind(F.col("event_type")).alias("kind"))


@_query("json_lists", """
SELECT c_custkey, 'a; ' || c_custkey AS plain, 'k: ' || c_custkey AS named, '' AS lacking, CASE WHEN c_custkey % 2 = 0 THEN '{"z":' || c_custkey || '}' END AS rest FROM customer""")
def _(t):
    key = F.col("c_custkey").cast("string")
    j = F.concat(F.lit('{"l":["a",1,"'), key, F.lit('"],"m":{"k":"'), key, F.lit('","n":5}'), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(',"z":'), key)).otherwise(""), F.lit("}"))
    lists = [F.array_join(text.string_list(F.col("j"), k), "; ").alias(n) for k, n in (("l", "plain"), ("m", "named"), ("o", "lacking"))]
    return t("customer").select("c_custkey", j.alias("j")).select("c_custkey", *lists, text.residual(F.col("j"), ("l", "m")).alias("rest"))


@_query("pooled", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, list_transform(range(1, len(e) + 1), lambda i: e[i] + e[len(e) + 1 - i]) AS x FROM v)
SELECT vec_id, round(x[1] / sqrt(list_sum(list_transform(x, lambda a: a * a))), 6) AS first, round(x[2] / sqrt(list_sum(list_transform(x, lambda a: a * a))), 6) AS second FROM s""")
def _(t):
    e = F.col("embedding").cast("array<double>")
    p = text.pooled(F.array(e, F.reverse(e), F.transform(e, lambda x: x + 7)), F.array(F.lit(1), F.lit(1), F.lit(0)))
    return t("embeddings").select("vec_id", p.alias("p")).select("vec_id", F.round(F.get("p", 0), 6).alias("first"), F.round(F.get("p", 1), 6).alias("second"))


@_query("vector_blobs", "SELECT vec_id, len(embedding) * 4 AS bytes, true AS same FROM embeddings")
def _(t):
    b = t("embeddings").withColumn("b", kernels.to_blob("embedding"))
    return b.select("vec_id", F.octet_length("b").cast("long").alias("bytes"), (kernels.from_blob("b") == F.col("embedding").cast("array<float>")).alias("same"))


@_query("vector_records", f"""
WITH c AS (SELECT vec_id, embedding AS x, (SELECT embedding FROM embeddings WHERE vec_id = 0) AS q FROM embeddings),
d AS (SELECT vec_id, {_L2} AS dist FROM c ORDER BY 2, 1 LIMIT 10) SELECT vec_id, p_name FROM d JOIN part ON p_partkey = vec_id""")
def _(t):
    q = t("embeddings").filter("vec_id = 0").first()["embedding"]  # the one query vector
    return vector.with_records(vector.knn(t("embeddings"), q), t("part"), "vec_id", "p_partkey", ["p_name"]).select("vec_id", "p_name")


@_query("novel", """
WITH top AS (SELECT item_id, text FROM benchmark WHERE item_id % 10 >= 3 ORDER BY item_id % 10 DESC, 'item ' || lpad(item_id::VARCHAR, 9, '0') LIMIT 60)
SELECT item_id FROM top WHERE NOT EXISTS (SELECT 1 FROM nation WHERE contains(lower(text), lower(substr(n_name, 1, 2))))""")
def _(t):
    hits = t("benchmark").select("item_id", F.concat(F.lit("item "), F.lpad(F.col("item_id").cast("string"), 9, "0")).alias("title"), F.col("text").alias("content"), ((F.col("item_id") % 10) / 10).alias("score"))
    return vector.novel(hits, t("nation").select(F.substring("n_name", 1, 2).alias("name")), 0.3, 60).select("item_id")


def _tools(t):
    """A session for each user: calls of a tool named after the event, with results of which errors say so."""
    e = t("events").select(F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") * 2).alias("n"), "event_type", F.col("event_id").cast("string").alias("id"))
    use = e.select("session_id", "n", F.lit("tool_use").alias("kind"), F.col("event_type").alias("text"), F.col("event_type").alias("tool_name"), F.col("id").alias("tool_use_id"), F.lit(False).alias("is_error"))
    bad = F.col("event_type") == "error"
    out = e.select("session_id", (F.col("n") + 1).alias("n"), F.lit("tool_result").alias("kind"), F.when(bad, "it broke").otherwise("fine").alias("text"), F.lit(None).cast("string").alias("tool_name"), F.col("id").alias("tool_use_id"), bad.alias("is_error"))
    return use.unionByName(out)


@_query("tool_failures", "SELECT user_id::VARCHAR AS session_id, event_id * 2 + 1 AS n, event_type AS tool_name, 'it broke' AS snippet FROM events WHERE event_type = 'error'")
def _(t):
    return transcripts.failures(_tools(t))


@_query("repeated_tools", """
WITH r AS (SELECT user_id, event_id, event_type, event_id - 0 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events)
SELECT user_id::VARCHAR AS session_id, min(event_id) * 2 AS n, count(*)::INTEGER AS length, event_type AS tool_name FROM r GROUP BY user_id, event_type, island HAVING count(*) >= 3""")
def _(t):
    return transcripts.repeated_tools(_tools(t))


@_query("ingest", """
WITH e AS (SELECT user_id, event_id, event_type FROM events), bad AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'error'),
r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM e),
runs AS (SELECT DISTINCT user_id, 'Repeated ' || event_type || ' ' || c AS title FROM (SELECT user_id, event_type, count(*) AS c FROM r GROUP BY user_id, event_type, island HAVING count(*) >= 3)),
f AS (SELECT user_id, 'error failed: it broke' AS title FROM bad UNION ALL SELECT * FROM runs),
s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY title ORDER BY user_id::VARCHAR) = 1)
SELECT user_id::VARCHAR AS session_id, count(*) AS found, (SELECT count(*) FROM s WHERE s.user_id = f.user_id) AS stored FROM f GROUP BY user_id""")
def _(t):
    known = t("events").limit(0).select(F.lit("").alias("title"))
    return transcripts.ingest(_tools(t), known)[1]


@_query("record_calls", f"WITH {_CALLS} SELECT tool, 2 * count(*) AS invocations, 2 * count(*) FILTER (NOT ok) AS errors, (2 * sum(b))::BIGINT AS bytes, 2 * coalesce(sum(b) FILTER (ok), 0) * 0.25::DOUBLE AS tokens FROM calls GROUP BY tool")
def _(t):
    c = _calls(t)
    return metrics.record(metrics.roll_up(c, ["tool"]), c, ["tool"])


@_query("exposition", f"WITH {_CALLS} SELECT '# TYPE calls counter' AS line UNION ALL SELECT 'calls{{tool=\"' || tool || '\"}} ' || count(*) FROM calls GROUP BY tool")
def _(t):
    return metrics.exposition(metrics.roll_up(_calls(t), ["tool"]), "calls", "counter", ["tool"], "invocations")


# -- the index of files: pages as files, of which a ledger knows most, some of them in an older state


def _files(t):
    return t("pages").select(F.concat(F.lit("site/"), "page_id", F.lit(".html")).alias("path"), (F.col("page_id") + 100).alias("mtime"), F.length("html").cast("long").alias("size"), F.md5("html").alias("hash"), F.lit("html").alias("language"), F.col("html").alias("content"), "page_id")


def _state(t):
    f = _files(t)
    old = f.filter("page_id % 5 <> 0").withColumn("hash", F.when(F.col("page_id") % 3 == 0, "old").otherwise(F.col("hash"))).withColumn("mtime", F.when(F.col("page_id") % 3 == 0, 0).otherwise(F.col("mtime")))
    gone = f.withColumn("path", F.concat(F.lit("gone/"), "page_id"))
    ledger = old.unionByName(gone).select("path", "mtime", "size", "hash")
    return indexing.empty(t("pages").sparkSession) | {"ledger": ledger}


_FILES = """f AS (SELECT page_id, html, 'site/' || page_id || '.html' AS path, page_id % 5 <> 0 AS known, page_id % 3 = 0 AS old FROM pages WHERE html IS NOT NULL)"""


@_query("index_repo", f"WITH {_FILES} SELECT count(*) FILTER (NOT known) AS new, count(*) FILTER (known AND old) AS changed, count(*) FILTER (known AND NOT old) AS unchanged, count(*) AS deleted FROM f")
def _(t):
    return indexing.index_repo(_state(t), _files(t))[1]


@_query("diff_index", f"WITH {_FILES} SELECT path, md5(html) AS hash, NOT known OR old AS read FROM f")
def _(t):
    state, _report = indexing.diff_index(_state(t), _files(t))
    read = state["chunks"].select("path").distinct().withColumn("read", F.lit(True))
    return state["ledger"].join(read, "path", "left").select("path", "hash", F.coalesce("read", F.lit(False)).alias("read"))


@_query("full_reindex", f"WITH {_FILES} SELECT path, 1::BIGINT AS rows FROM f UNION ALL SELECT 'gone/' || page_id, 1 FROM f")
def _(t):
    return indexing.full_reindex(_state(t), _files(t), "site")["ledger"].groupBy("path").agg(F.count("*").alias("rows"))


@_query("trigger_reindex", f"WITH {_FILES} SELECT path FROM f WHERE known AND path <> 'site/1.html' UNION ALL SELECT 'gone/' || page_id FROM f")
def _(t):
    return indexing.trigger_reindex(_state(t), path="site/1.html")["ledger"].select("path")


@_query("apply_changes", f"WITH {_FILES} SELECT path, md5(html) AS hash FROM f WHERE page_id % 2 = 1 AND (known OR page_id % 7 = 0) AND (page_id % 7 = 0 OR NOT old) UNION ALL SELECT path, 'old' FROM f WHERE page_id % 2 = 1 AND known AND old AND page_id % 7 <> 0 UNION ALL SELECT 'gone/' || page_id, md5(html) FROM f")
def _(t):
    f = _files(t)
    changes = f.filter("page_id % 2 = 0").select("path", F.lit("deleted").alias("op")).unionByName(f.filter("page_id % 2 = 1 and page_id % 7 = 0").select("path", F.lit("modified").alias("op")))
    return indexing.apply_changes(_state(t), changes, f)["ledger"].select("path", "hash")


@_query("line_chunks", """
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents WHERE text IS NOT NULL AND text <> ''),
n AS (SELECT doc_id, l, len(l) AS n FROM d WHERE len(l) > 0),
c(doc_id, k, s, e) AS (
  SELECT doc_id, 0, 0, CASE WHEN n <= 100 THEN n ELSE coalesce(list_max(list_filter(range(50, least(100, n)), lambda i: regexp_matches(l[i + 1], '^\\s*$|^[})\\]]'))) + 1, 50) END FROM n
  UNION ALL SELECT c.doc_id, k + 1, greatest(e - 5, s + 1), CASE WHEN n - greatest(e - 5, s + 1) <= 50 THEN n ELSE
    coalesce(list_max(list_filter(range(greatest(e - 5, s + 1) + 50, least(greatest(e - 5, s + 1) + 100, n)), lambda i: regexp_matches(l[i + 1], '^\\s*$|^[})\\]]'))) + 1, greatest(e - 5, s + 1) + 50) END
  FROM c JOIN n ON c.doc_id = n.doc_id WHERE e < n)
SELECT doc_id, k AS chunk_index, s + 1 AS start_line, e AS end_line FROM c""")
def _(t):
    c = t("documents").select("doc_id", F.inline(kernels.chunks_udf()("text")))
    return c.select("doc_id", "chunk_index", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


# -- SQL for two that had none, over whole tables


@_query("budget_selection", """
WITH RECURSIVE n AS (SELECT source, doc_id AS id, quality::DOUBLE AS score, n_chars, 5 + (n_chars + 79) // 80 AS cost, toxic = 1 AS critical, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS k FROM labels JOIN documents USING (doc_id)),
g(source, k, id, taken, room, over) AS (
  SELECT source, k, id, cost <= 100 OR critical, CASE WHEN cost <= 100 THEN 100 - cost ELSE 100 END, cost > 100 AND critical FROM n WHERE k = 1
  UNION ALL SELECT n.source, n.k, n.id, n.cost <= room OR (n.critical AND NOT over), CASE WHEN n.cost <= room THEN room - n.cost ELSE room END, over OR (n.cost > room AND n.critical)
  FROM g JOIN n ON g.source = n.source AND n.k = g.k + 1)
SELECT source, id FROM g WHERE taken""")
def _(t):
    n = t("labels").join(t("documents"), "doc_id").select("source", F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"), F.col("n_chars").alias("chars"), (F.col("toxic") == 1).alias("critical"))
    return memory.select_within(n, 100, ["source"]).select("source", "id")


@_query("entity_resolution", f"""
WITH l AS (SELECT trim(lower(p_name)) AS l, min(p_partkey) AS id FROM part GROUP BY 1), p AS (SELECT DISTINCT 'the ' || substr(lower(p_name), 1, length(p_name) - p_partkey % 3 // 1) AS probe FROM part WHERE p_partkey % 100 = 0),
m AS (SELECT probe, id, CASE WHEN q = l THEN 1 WHEN (contains(q, l) OR contains(l, q)) AND least(length(q), length(l)) / greatest(length(q), length(l)) > 0.5 THEN 2 WHEN levenshtein(q, l) <= {config.MAX_EDITS} THEN 3 END AS tier,
  CASE WHEN q = l THEN 1.0 WHEN contains(q, l) OR contains(l, q) THEN least(length(q), length(l)) / greatest(length(q), length(l)) ELSE 1 - levenshtein(q, l) / greatest(length(q), length(l)) END AS score
  FROM (SELECT probe, trim(substr(probe, 5)) AS q FROM p), l)
SELECT probe, arg_min(id, (tier, -score, id)) AS id, min(tier)::INTEGER AS tier FROM m WHERE tier IS NOT NULL GROUP BY probe""")
def _(t):
    p = t("part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("the "), F.expr("substr(lower(p_name), 1, cast(length(p_name) - p_partkey % 3 as int))")).alias("probe"))
    return graph.resolve(p, t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))).select("probe", "id", "tier")
