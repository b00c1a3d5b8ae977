"""What tools answer: rows of hits and records as the JSON that callers read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Catalog

#: The fields that answers carry, in their order.
CODE = ("file_path", "chunk_index", "start_line", "end_line", "content", "language", "score", "distance")
LESSON = ("id", "title", "content", "severity", "tags", "agent", "repo", "created_at", "updated_at")
CHECKPOINT = ("id", "agent", "working_on", "state", "repo", "session_id", "created_at")


def projected(df: DataFrame, fields: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    """df with the fields of an answer alone, in their order; those that df lacks are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in (*fields, *more)])


def answer(rows: DataFrame, name: str, order: list[Column], given: dict[str, Column], limit: int) -> DataFrame:
    """One row, answer: {name: the first limit rows in order, the given fields, count}. Nulls are written."""
    top = rows.orderBy(*order).limit(limit)  # as many rows as the caller asked for
    n = F.row_number().over(_by(order)).alias("n")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct(*rows.columns).alias("r")))), lambda x: x["r"])
    one = top.select(n, *rows.columns).agg(listed.alias("rows"))
    return one.select(F.to_json(F.struct(F.col("rows").alias(name), *[c.alias(k) for k, c in given.items()], F.size("rows").alias("count")), {"ignoreNullFields": "false"}).alias("answer"))


def _by(order: list[Column]):
    from pyspark.sql import Window

    return Window.orderBy(*order)


def search_answer(hits: DataFrame, query: str, limit: int = 10, language: str | None = None) -> DataFrame:
    """The answer to a search for code: hits (file_path, ..., score, distance), the nearest first."""
    own = hits.filter(F.col("language") == language) if language else hits
    order = [F.col("distance").asc(), F.col("file_path").asc(), F.col("chunk_index").asc()]
    return answer(projected(own, CODE), "results", order, {"query": F.lit(query), "limit": F.lit(limit)}, limit)


def list_answer(lessons: DataFrame, severity: str | None = None, limit: int = 50) -> DataFrame:
    """The answer that lists lessons, newest first: those of a severity, or all."""
    own = lessons.filter(F.col("severity") == severity) if severity else lessons
    return answer(projected(own, LESSON), "lessons", [F.col("created_at").desc(), F.col("id").asc()], {"severity": F.lit(severity or "all")}, limit)


def checkpoint_answer(checkpoints: DataFrame, agent: str, limit: int = 5) -> DataFrame:
    """The answer that lists an agent's checkpoints, newest first."""
    own = checkpoints.filter(F.col("agent") == agent)
    return answer(projected(own, CHECKPOINT), "checkpoints", [F.col("created_at").desc(), F.col("id").asc()], {"agent": F.lit(agent)}, limit)


def delete_lesson(catalog: Catalog, id: str) -> bool:
    """Delete a lesson with its vector and its node and edges of the graph, in one commit; False if there is none.

    Tables that the catalog lacks are passed over: lessons (id), vectors (record_id), nodes (id, record_id), edges (from_node, to_node)."""
    there = catalog.versions()
    lessons = catalog.read("lessons")
    if not lessons.filter(F.col("id") == id).limit(1).count():
        return False
    out = {"lessons": lessons.filter(~F.col("id").eqNullSafe(F.lit(id)))}
    if "vectors" in there:
        out["vectors"] = catalog.read("vectors").filter(~F.col("record_id").eqNullSafe(F.lit(id)))
    if "nodes" in there:
        from .graph import remove_nodes

        nodes = catalog.read("nodes")
        gone = nodes.filter(F.col("record_id") == id).select("id")
        out["nodes"], out["edges"] = remove_nodes(nodes, catalog.read("edges"), gone)
    return catalog.commit(out)
