"""Lookups, predicates, upkeep and renderings bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sql
from ..functions import encoder, text
from ..operators import cells, graph, lookup, structure, tables, vector
from .indexes import _own
from . import more  # noqa: F401  its queries are there first
from .queries import _CODE, _EDGES, ORACLES, _call_edges, _edges, _query, _symbols


@_query("record_by_id", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 7")
def _(t):
    return lookup.by_key(t("documents"), "doc_id", 7).select("doc_id", "lang", "n_chars")


@_query("chunks_of_file", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3")
def _(t):
    return lookup.by_key(t("conversations"), "conv_id", 3).select("conv_id", "turn", "role")


@_query("needs_index", "SELECT page_id FROM pages WHERE page_id % 3 = 0 OR page_id % 4 = 0")
def _(t):
    p = t("pages").select("page_id", F.length("url").alias("mtime"), F.length("html").alias("size"))
    # a third is not in the ledger, a fourth has another size there
    known = p.filter("page_id % 3 <> 0").withColumn("size", F.when(F.col("page_id") % 4 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return lookup.needs_index(p, known, "page_id").select("page_id")


@_query("in_progress", "SELECT event_id, event_type = 'click' AS running FROM events")
def _(t):
    state = F.when(F.col("event_type") == "click", "In_Progress").when(F.col("event_type") == "error", "idle")
    return t("events").select("event_id", lookup.in_progress(state).alias("running"))


@_query("missing_vectors", "SELECT vec_id FROM embeddings WHERE vec_id % 9 = 0")
def _(t):
    return lookup.missing_vectors(t("embeddings").withColumn("embedding", F.when(F.col("vec_id") % 9 != 0, F.col("embedding")))).select("vec_id")


@_query("priority_order", "SELECT doc_id, n FROM (SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END, doc_id DESC) AS n FROM labels) WHERE n <= 60")
def _(t):
    own = t("labels").select("doc_id", F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 1, "warning").otherwise("info").alias("severity"))
    top = lookup.by_priority(own, 60, "doc_id", "doc_id")
    from pyspark.sql import Window

    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc(text.severity_rank(F.col("severity"))), F.desc("doc_id"))).cast("long").alias("n"))


@_query("importers", f"WITH {_CODE} SELECT 'f' || d AS name, s AS id FROM e WHERE s % 2 = 0 AND d % 100 = 0")
def _(t):
    edges = _call_edges(t).withColumn("edge_kind", F.when(F.col("source_symbol_id") % 2 == 0, "imports").otherwise("calls"))
    names = t("part").filter("p_partkey % 100 = 0").select(F.concat(F.lit("f"), "p_partkey").alias("name"))
    return structure.callers(_symbols(t), edges, names, "imports").select("name", "id")


@_query("induced_subgraph", "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 3 = 0")
def _(t):
    edges = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("from_node"), F.concat(F.lit("o"), "o_orderkey").alias("to_node"))
    nodes = t("customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionByName(t("orders").filter("o_orderkey % 3 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id")))
    return graph.subgraph(nodes, edges).select("id")


@_query("keep_newest", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def _(t):
    return tables.keep_newest(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_orderkey")


@_query("stale_status", "SELECT user_id, epoch_us(max(ts)) // 1000000 AS last_updated FROM events GROUP BY user_id HAVING epoch_us(max(ts)) // 1000000 < (SELECT epoch_us(max(ts)) // 1000000 FROM events) - 600")
def _(t):
    e = t("events").select("user_id", F.expr("unix_micros(cast(ts AS timestamp)) div 1000000").alias("at"), "event_type")
    now = e.agg(F.max("at")).first()[0]  # the clock
    return tables.stale(tables.status_view(e, "user_id", "at", "event_type"), now, 600).select("user_id", "last_updated")


@_query("symbols_in_scope", "SELECT p_partkey AS id FROM part WHERE p_type = 'PROMO' AND p_brand = 'Brand#12'")
def _(t):
    return lookup.by_key(lookup.by_key(_symbols(t), "scope", "PROMO"), "file_path", "Brand#12").select("id")


@_query("text_values", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS rank, left(md5(url), 8) AS short,
  CASE page_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN 86400 ELSE 604800 END * (page_id % 9) AS seconds,
  page_id % 7 > 3 OR (page_id % 7 = 3 AND page_id % 5 >= 2) AS newer FROM pages""")
def _(t):
    severity = F.element_at(F.array(*[F.lit(x) for x in ("critical", "warning", "info", "other")]), (F.col("page_id") % 4 + 1).cast("int"))
    length = F.concat((F.col("page_id") % 9).cast("string"), F.element_at(F.array(*[F.lit(x) for x in "mhdw"]), (F.col("page_id") % 4 + 1).cast("int")))
    version = F.concat(F.lit("v"), (F.col("page_id") % 7).cast("string"), F.lit("."), (F.col("page_id") % 5).cast("string"))
    return t("pages").select(
        "page_id", text.severity_rank(severity).alias("rank"), text.short_id(F.concat(F.lit("lesson_"), F.md5("url"))).alias("short"),
        text.duration_seconds(length).alias("seconds"), (text.version_triple(version) >= text.version_triple(F.lit("3.2.0"))).alias("newer"),
    )


@_query("sql_functions", "SELECT vec_id, round(greatest(0, least(1, 1 - (vec_id % 30) / 10.0::DOUBLE / 2)), 6) AS score, round(0.8::DOUBLE * pow(0.5::DOUBLE, (vec_id % 90) / 30.0::DOUBLE), 6) AS left_over FROM embeddings")
def _(t):
    e = t("embeddings")
    sql.register(e.sparkSession)
    return e.selectExpr("vec_id", "round(distance_score((vec_id % 30) / 10D), 6) AS score", "round(decayed(0.8D, CAST(vec_id % 90 AS DOUBLE)), 6) AS left_over")


@_query("sql_line_chunks", ORACLES["line_chunks"])
def _(t):
    d = t("documents").select("doc_id", "text")
    sql.register(d.sparkSession)
    d.createOrReplaceTempView("quarrylake_documents")
    return d.sparkSession.sql("SELECT doc_id, chunk_index, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM line_chunks(TABLE(quarrylake_documents), 'text')")


@_query("semantic_search")
def _(t):
    # whole texts of all documents; queries are those whose id is divisible by 100
    d = t("documents").select("doc_id", "text")
    _, vectors = encoder.fitted_vectors(d, "doc_id", "text")
    index = cells.VectorCells(d.sparkSession, _own(t, "encoded"))
    index.build(vectors, "doc_id")
    q = index.rows().filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return index.knn(q, 5).select("qid", F.col("id").alias("doc_id"), F.round("distance", 5).alias("distance"), "rank")


@_query("first_pages", "SELECT conv_id, turn FROM (SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 40 OFFSET 20)")
def _(t):
    return vector.page(t("conversations"), ["conv_id", "turn"], 40, 20).select("conv_id", "turn")


# searches of the graph start from every customer whose key is divisible by 100
def _starts(t):
    return t("customer").filter("c_custkey % 100 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("node"))


_FROM = "starts_with(s, 'c') AND substr(s, 2)::BIGINT % 100 = 0"


@_query("graph_expand_hundredth", f"""
WITH {_EDGES}, b AS (SELECT s, d FROM edges WHERE conf >= 0 UNION SELECT d, s FROM edges WHERE conf >= 0),
one AS (SELECT s AS start, d AS node, 1 AS depth FROM b WHERE {_FROM}),
two AS (SELECT one.start, b.d AS node, 2 AS depth FROM one JOIN b ON one.node = b.s WHERE b.d <> one.start)
SELECT start, node, min(depth) AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY start, node""")
def _(t):
    return graph.expand(_edges(t), _starts(t), 2, min_confidence=0.0).select("start", "node", "depth")


@_query("graph_paths_hundredth", f"""
WITH {_EDGES}, b AS (SELECT s, d, conf, s || '>' || d AS e FROM edges WHERE conf >= 0 UNION ALL SELECT d, s, conf, s || '>' || d FROM edges WHERE conf >= 0),
c1 AS (SELECT s AS start, d AS node, -conf AS c, e, e AS path FROM b WHERE {_FROM}),
one AS (SELECT start, node, path FROM c1 QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY c, e) = 1),
c2 AS (SELECT start, b.d AS node, -conf AS c, e, path AS p, path || ' ' || e AS path FROM one JOIN b ON node = s WHERE b.d <> start AND (start, b.d) NOT IN (SELECT (start, node) FROM one)),
two AS (SELECT start, node, path FROM c2 QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY c, e, p) = 1)
SELECT * FROM one UNION ALL SELECT * FROM two""")
def _(t):
    return graph.expand(_edges(t), _starts(t), 2, min_confidence=0.0).select("start", "node", F.array_join("path", " ").alias("path"))
