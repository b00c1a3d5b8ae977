"""Server-sent events as a streaming sink: each epoch of a query is published once, whole."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import ship_package

FORMAT = "quarrylake_activity"
PARTS, EPOCHS = "parts", "epochs"


@dataclass
class Staged(WriterCommitMessage):
    """A file that a task wrote, and its number of events."""

    file: str
    events: int


class EpochWriter(DataSourceStreamWriter):
    """Tasks write files under parts; an epoch's manifest under epochs names those that count.

    The manifest is written aside and moved to the name of its epoch. An epoch that is run again
    after its manifest was published, as when a query stops before its checkpoint says so, finds
    it there and gives up its own files; one that stops before publishes nothing. So readers, who
    go by manifests, find each epoch once and whole."""

    def __init__(self, path: str):
        self.path = path

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Staged:
        system, base = self._open()
        folder = posixpath.join(base, PARTS)
        system.create_dir(folder, recursive=True)
        name, n = f"{uuid.uuid4().hex}.sse", 0
        with system.open_output_stream(posixpath.join(folder, name)) as out:
            for row in iterator:
                lines = "".join(f"data: {line}\n" for line in (row["data"] or "").split("\n"))
                out.write(f"event: {row['event']}\n{lines}\n".encode())
                n += 1
        return Staged(name, n)

    def _drop(self, system, base: str, messages: list) -> None:
        from pyarrow import fs

        for m in messages:
            file = posixpath.join(base, PARTS, m.file) if m else None
            if file and system.get_file_info(file).type != fs.FileType.NotFound:
                system.delete_file(file)

    def commit(self, messages: list, batchId: int) -> None:
        from pyarrow import fs

        system, base = self._open()
        folder = posixpath.join(base, EPOCHS)
        system.create_dir(folder, recursive=True)
        target = posixpath.join(folder, f"{batchId:012d}.json")
        if system.get_file_info(target).type != fs.FileType.NotFound:
            return self._drop(system, base, messages)
        self._drop(system, base, [m for m in messages if m and not m.events])
        own = [m for m in messages if m and m.events]
        text = json.dumps({"epoch": batchId, "files": [m.file for m in own], "events": sum(m.events for m in own)})
        aside = posixpath.join(base, f".{batchId}.{uuid.uuid4().hex}")
        with system.open_output_stream(aside) as out:
            out.write(text.encode())
        system.move(aside, target)

    def abort(self, messages: list, batchId: int) -> None:
        system, base = self._open()
        self._drop(system, base, messages)


class ActivitySink(DataSource):
    """The format quarrylake_activity; its option path is a folder, as a URI."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> EpochWriter:
        if not {"event", "data"} <= set(schema.names):
            raise ValueError("an activity stream has the columns event and data")
        return EpochWriter(self.options["path"])


def publish(events: DataFrame, path: str, checkpoint: str, trigger: dict):
    """Start a query that writes a stream of events (event, data) to path; restarts go on from checkpoint."""
    spark = events.sparkSession
    ship_package(spark)
    spark.dataSource.register(ActivitySink)
    return events.select("event", "data").writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def published(spark: SparkSession, path: str) -> DataFrame:
    """epoch, event, data of what publish wrote to path and committed; data keeps its lines."""
    epochs = spark.read.schema("epoch long, files array<string>").json(f"{path}/{EPOCHS}").select("epoch", F.explode("files").alias("file"))
    raw = spark.read.option("lineSep", "\n\n").text(f"{path}/{PARTS}").filter("value <> ''").select("value", F.col("_metadata.file_name").alias("file"))
    data = F.array_join(F.transform(F.filter(F.split("value", "\n"), lambda x: x.startswith("data: ")), lambda x: F.substring(x, F.lit(7), F.length(x))), "\n")
    return raw.join(epochs, "file").select("epoch", F.regexp_extract("value", "^event: ([^\n]*)", 1).alias("event"), data.alias("data"))


def stats_event(counts: dict[str, Column], at: Column) -> Column:
    """The data of a stats event: counts by name, and the time as epoch seconds."""
    return F.to_json(F.struct(F.lit("stats").alias("type"), *[c.cast("long").alias(k) for k, c in counts.items()], at.cast("long").alias("timestamp")))


def tool_event(totals: DataFrame, at: Column) -> DataFrame:
    """totals (tool, invocations, errors, tokens) -> event, data: one event on all tools; the most active is that of most calls, then of least name."""
    most = F.coalesce(F.min_by("tool", F.struct(-F.col("invocations"), F.col("tool"))), F.lit(""))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = totals.agg(whole("invocations").alias("total_invocations"), most.alias("most_active_tool"), whole("errors").alias("recent_errors"), whole("tokens").alias("estimated_tokens_saved"))
    data = F.to_json(F.struct(F.lit("tool_activity").alias("type"), *one.columns, at.cast("long").alias("timestamp")))
    return one.select(F.lit("activity").alias("event"), data.alias("data"))
