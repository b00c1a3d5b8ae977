"""Streams: file changes, rate limits, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config
from ..operators.indexing import apply_batch
from ..operators.tables import Catalog
from ..written import written


def coalesce_changes(events: DataFrame) -> DataFrame:
    """events (seq, op, path, to) of a batch -> path, op: the last one of each path; a rename deletes one path and modifies another."""
    moved = F.col("op") == "renamed"
    each = events.select("seq", F.inline(F.when(moved, F.array(F.struct(F.col("path").alias("p"), F.lit("deleted").alias("o")), F.struct(F.col("to").alias("p"), F.lit("modified").alias("o")))).otherwise(F.array(F.struct(F.col("path").alias("p"), F.col("op").alias("o"))))))
    return each.groupBy(F.col("p").alias("path")).agg(F.max_by("o", F.struct("seq", "o")).alias("op"))


def rate_limited(stream: DataFrame, key: str, at: str, seconds: int = config.RATE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Rows that come at least seconds behind the last one that was let through of their key, by event time within a
    batch; the others are dropped. The state of a key is one time, kept until the watermark is seconds past it."""
    schema, names = stream.schema, stream.columns

    def run(keys, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for pdf in (pd.concat(list(frames)).sort_values(at, kind="stable"),):
            keep = []
            for t in (pdf[at].astype("int64") // 1000).tolist():
                through = last is None or t - last >= seconds * 1_000_000
                last = t if through else last
                keep.append(through)
            yield pdf[keep][names]
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    s = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return s.groupBy(key).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def debounced(stream: DataFrame, key: str, at: str, quiet: str = "500 milliseconds", late: str = "1 second") -> DataFrame:
    """key, at, n: one row for each burst of a key's rows, once it has been quiet, with its last time."""
    burst = stream.withWatermark(at, late).groupBy(F.session_window(at, quiet), key)
    return burst.agg(F.max(at).alias(at), F.count("*").alias("n")).select(key, at, "n")


def settled(files: DataFrame, at: str, now: Column, seconds: int = config.SETTLED_SECONDS) -> DataFrame:
    """Files that were not changed for seconds: the others may still be written."""
    return files.filter(F.col(at) <= now - F.expr(f"INTERVAL {seconds} SECONDS"))


def session_stream(spark: SparkSession, folder: str) -> DataFrame:
    """value, file of new *.jsonl files of a folder, as a stream."""
    return spark.readStream.option("pathGlobFilter", "*.jsonl").text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def daemon(stream: DataFrame, catalog: Catalog, ingest, sync, folder: str, trigger: dict, name: str = "daemon"):
    """Each micro-batch of session lines is ingested, then what it touched is synced; restarts go on from folder.

    ingest(batch, catalog) returns the tables to commit, which are committed with the number of the batch, so a batch that
    runs again after a restart is not ingested twice. sync(files, catalog, number) runs each time, as it may be
    what was lost: it reads the catalog and writes the same again."""

    def step(batch: DataFrame, i: int) -> None:
        if i > catalog.applied(name):
            catalog.commit(ingest(batch, catalog), name, i)
        sync(batch.select("file").distinct(), catalog, i)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", folder).trigger(**trigger).start()


def activity(stream: DataFrame, at: str, kind: str, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per span and kind; the same on a batch."""
    return stream.withWatermark(at, late).groupBy(F.window(at, span), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def index_changes(stream: DataFrame, apply, folder: str, trigger: dict):
    """Run apply(batch, id) on coalesced changes of each micro-batch; restarts go on from folder."""
    return stream.writeStream.foreachBatch(lambda batch, i: apply(coalesce_changes(batch), i)).option("checkpointLocation", folder).trigger(**trigger).start()


def index_into(stream: DataFrame, catalog: Catalog, read, folder: str, trigger: dict, sink: str = "index", embed=None):
    """A stream of changes (seq, op, path, to), applied to the index that catalog holds, each micro-batch once, also where a
    restart runs it again. read(changes) returns the files (path, mtime, size, hash, language, content) that were modified."""

    def step(batch: DataFrame, i: int) -> None:
        if i > catalog.applied(sink):
            changes = written(coalesce_changes(batch), "changes")
            apply_batch(catalog, changes, read(changes), i, sink, embed)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", folder).trigger(**trigger).start()
