"""The index of source files: chunks with vectors, symbols, call edges and a ledger, kept in step with the files.

State is a dict of tables: chunks (path, chunk_index, start_line, end_line, content, embedding), symbols (id, file_path,
symbol_name, symbol_kind, language, start_line, end_line, scope), edges (source_symbol_id, target_symbol_name, edge_kind),
ledger (path, mtime, size, hash). Each step takes the state and returns the next; a Catalog writes its tables together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import chunk_lines, embed_udf, symbols_udf
from ..shipping import ship_package
from .structure import call_edges
from .tables import Catalog, diff

CHUNKS = "path string, chunk_index int, start_line int, end_line int, content string, embedding array<float>"
SYMBOLS = "id string, file_path string, symbol_name string, symbol_kind string, language string, start_line int, end_line int, scope string"
EDGES = "source_symbol_id string, target_symbol_name string, edge_kind string"
LEDGER = "path string, mtime long, size long, hash string"
State = dict[str, DataFrame]


def empty(spark: SparkSession) -> State:
    return {k: spark.createDataFrame([], s) for k, s in (("chunks", CHUNKS), ("symbols", SYMBOLS), ("edges", EDGES), ("ledger", LEDGER))}


#: Bytes of chunks from which on a task passes them on.
PASSED_ON = 1 << 20


def chunked(files: DataFrame, embed=None) -> DataFrame:
    """files (path, content) -> chunks. embed is a Column function of the content; the default is a stand-in.

    A task holds the files as they arrive, in Arrow, and the chunks of few of them at once."""
    embed = embed or embed_udf()
    ship_package(files.sparkSession)
    c = files.select(F.col("path").cast("string"), F.col("content").cast("string")).filter("content is not null")
    c = c.mapInArrow(_chunk_batches, "path string, chunk_index int, start_line int, end_line int, content string")
    return c.withColumn("embedding", embed("content"))


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"path": pa.string(), "chunk_index": pa.int32(), "start_line": pa.int32(), "end_line": pa.int32(), "content": pa.string()}
    out, size = [], 0
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            for c in chunk_lines(content.as_py()):
                out.append(c | {"path": path.as_py()})
                size += len(c["content"])
            if size >= PASSED_ON:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in kinds.items()], list(kinds))
                out, size = [], 0
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in kinds.items()], list(kinds))


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, language, content) -> (symbols, edges)."""
    s = files.select(F.col("path").alias("file_path"), "language", F.posexplode(symbols_udf("content", "language")).alias("k", "s"))
    key = F.concat_ws(":", "file_path", F.lpad(F.col("k").cast("string"), 6, "0"))
    s = s.select(key.alias("id"), "file_path", "s.symbol_name", "s.symbol_kind", "language", "s.start_line", "s.end_line", "s.scope")
    return s, call_edges(s).select("source_symbol_id", "target_symbol_name", "edge_kind")


def _less(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    return df.join(gone.select(F.col("path").alias(column)).distinct(), column, "left_anti").select(*df.columns)


def delete_files(state: State, gone: DataFrame, symbols: bool = False) -> State:
    """The state without the chunks and ledger rows of the files in gone (path); with symbols, without theirs and the edges from them too."""
    out = state | {"chunks": _less(state["chunks"], gone, "path"), "ledger": _less(state["ledger"], gone, "path")}
    if symbols:
        old = state["symbols"].join(gone.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select(F.col("id").alias("source_symbol_id"))
        out |= {"symbols": _less(state["symbols"], gone, "file_path"), "edges": state["edges"].join(old, "source_symbol_id", "left_anti").select(*state["edges"].columns)}
    return out


def delete_under(state: State, folder: str) -> State:
    """The state without any file under folder."""
    own = state["ledger"].filter(F.startswith(F.col("path"), F.lit(folder.rstrip("/") + "/"))).select("path")
    return delete_files(state, own, symbols=True)


def index_files(state: State, files: DataFrame, embed=None, structural: bool = True) -> State:
    """The state with files (path, mtime, size, hash, language, content); those whose hash the ledger has are not read again.

    A file's old chunks, symbols and edges make room for the new ones. The ledger takes time and size of all files, so a file that
    was only touched is not looked at again."""
    known = state["ledger"].select("path", "hash")
    fresh = files.join(known, ["path", "hash"], "left_anti")
    out = delete_files(state, fresh, symbols=structural)
    out |= {"ledger": _less(out["ledger"], files, "path")}
    add = {"chunks": chunked(fresh, embed), "ledger": files}
    if structural:
        add["symbols"], add["edges"] = parsed(fresh)
    return out | {k: out[k].unionByName(v.select(*out[k].columns)) for k, v in add.items()}


def index_report(state: State, listing: DataFrame, compare: tuple[str, ...] = ("hash",)) -> DataFrame:
    """One row: files that are new, changed, unchanged, deleted, by what compare names."""
    d = diff(listing, state["ledger"], "path", compare)
    count = lambda s: F.count_if(F.col("state") == s)
    return d.agg(count("new").alias("new"), count("changed").alias("changed"), count("same").alias("unchanged"), count("deleted").alias("deleted"))


def index_repo(state: State, files: DataFrame, embed=None) -> tuple[State, DataFrame]:
    """(state with all files, report): files the ledger lacks or has with another hash are indexed."""
    return index_files(state, files, embed), index_report(state, files)


def diff_index(state: State, files: DataFrame, embed=None) -> tuple[State, DataFrame]:
    """(state, report): only files of another time or size are looked at, and what is listed no more is deleted."""
    d = diff(files, state["ledger"], "path", ("mtime", "size"))
    moved = files.join(d.filter("state in ('new', 'changed')").select("path"), "path", "left_semi")
    gone = d.filter("state = 'deleted'").select("path")
    return index_files(delete_files(state, gone), moved, embed), index_report(state, files, ("mtime", "size"))


def full_reindex(state: State, files: DataFrame, folder: str, embed=None) -> State:
    """The state with all that lies under folder indexed anew."""
    return index_files(delete_under(state, folder), files, embed)


def trigger_reindex(state: State, files: DataFrame | None = None, folder: str | None = None, path: str | None = None, embed=None) -> State:
    """A folder is indexed at once; of a path the rows go, so that the next diff indexes it; without either the ledger is emptied."""
    if folder is not None:
        return index_files(state, files.filter(F.startswith(F.col("path"), F.lit(folder.rstrip("/") + "/"))), embed)
    if path is not None:
        spark = state["ledger"].sparkSession
        return delete_files(state, spark.createDataFrame([(path,)], "path string"))
    return state | {"ledger": state["ledger"].limit(0)}


def apply_changes(state: State, changes: DataFrame, files: DataFrame, embed=None) -> State:
    """changes (path, op) of a batch, coalesced: deleted files go, and the others, as files has them, are indexed."""
    gone = changes.filter("op = 'deleted'").select("path")
    moved = files.join(changes.filter("op <> 'deleted'").select("path").distinct(), "path", "left_semi")
    return index_files(delete_files(state, gone), moved, embed)


def load(catalog: Catalog) -> State:
    """The state that a catalog holds; the empty one before its first commit."""
    there = catalog.state()["tables"]
    return {k: catalog.read(k) if k in there else v for k, v in empty(catalog.spark).items()}


def apply_batch(catalog: Catalog, changes: DataFrame, files: DataFrame, batch: int, sink: str = "index", embed=None) -> bool:
    """Commit the changes of a numbered batch to the state of catalog, its number with them; False if it was there already."""
    if batch <= catalog.applied(sink):
        return False
    return catalog.commit(apply_changes(load(catalog), changes, files, embed), sink, batch)
