"""Operators of streams that keep state: files held back until they rest, calls paired with their results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config
from ..shipping import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gate(StatefulProcessor):
    """Holds the newest change of a key and lets it out once nothing was newer for a time."""

    def __init__(self, key: str, millis: int):
        self.key, self.millis = key, millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, changes long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, n = self.held.get() if self.held.exists() else (-1, 0)
        for r in rows:
            at, n = max(at, r["__at"]), n + 1
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.held.update((at, n))
        self.handle.registerTimer(at + self.millis)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, n = self.held.get()
        self.held.clear()
        yield Row(**{self.key: key[0], "at": at, "changes": n})

    def close(self) -> None:
        pass


def needs_rocksdb(spark: SparkSession) -> None:
    """State with timers is kept in RocksDB; a session that names another store is told so."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(name, None) != ROCKSDB:
        spark.conf.set(name, ROCKSDB)


def held_back(stream: DataFrame, key: str, at: str, seen: str, seconds: int = config.SETTLED_SECONDS, late: str = "0 seconds") -> DataFrame:
    """key, at, changes: a key of the stream once, when the clock of seen is seconds past its newest at.

    at is when a file was changed, seen when that was noticed: the watermark follows seen, so a file
    that was changed long ago and noticed now is not late. A file that is too fresh is kept as
    state and comes out by its timer, also where no further row names it; changed again before, it is held
    again from there, and changed after it came out, it comes out anew. changes counts the rows that
    are told by one row of output. Rows with a null key or at are left out."""
    spark = stream.sparkSession
    ship_package(spark)
    needs_rocksdb(spark)
    kind = stream.schema[key].dataType.simpleString()
    s = stream.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), F.unix_millis(F.col(at).cast("timestamp")).alias("__at"), F.col(seen).cast("timestamp").alias("__seen"))
    s = s.withWatermark("__seen", late)
    out = s.groupBy(key).transformWithState(Gate(key, seconds * 1000), f"`{key}` {kind}, at long, changes long", "append", "EventTime")
    return out.select(key, F.timestamp_millis("at").alias("at"), "changes")


def paired(uses: DataFrame, results: DataFrame, key: str, within: str, at: str = "at", late: str = "10 minutes") -> DataFrame:
    """uses (key, at, ...) and results (key, at, ...) -> uses with the result_ columns of each result of its key that came
    at its time or up to within later; a use without one stays, with nulls, once none can come any more.

    On streams both sides have watermarks, so what is kept of a use is bounded by within and late,
    and a use without a partner comes out when the watermark has passed it; on tables it is a left join. Rows
    with a null key or time pair with nothing, and as streams they are left out."""
    if uses.isStreaming != results.isStreaming:
        raise ValueError("both sides are streams, or both are tables")
    r = results.select(*[F.col(c).alias(f"result_{c}") for c in results.columns])
    if uses.isStreaming:
        uses = uses.filter(F.col(key).isNotNull()).withWatermark(at, late)
        r = r.filter(F.col(f"result_{key}").isNotNull()).withWatermark(f"result_{at}", late)
    on: Column = (F.col(key) == F.col(f"result_{key}")) & (F.col(f"result_{at}") >= F.col(at)) & (F.col(f"result_{at}") <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return uses.join(r, on, "left_outer")
