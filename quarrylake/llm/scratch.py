"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship_package

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one of our own on a local master (tests); a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarrylake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_open: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession):
    """Deletes, at its end, the tables of all operators that began within it."""
    _open.append([])
    try:
        yield
    finally:
        _delete(spark, _open.pop())


def _delete(spark: SparkSession, folders: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in folders:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(conf).delete(path, True)


def inner_names(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores before it as it takes to be none of columns."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


class Scratch:
    """Written tables of one operator run, under a folder of their own.

    A table that has been written survives lost executors: later steps read it instead of
    recomputing what stands before it. ``keep`` also lets go of the shuffle files of the steps
    that led to the table, which otherwise stay until the driver happens to collect garbage.
    """

    def __init__(self, spark: SparkSession, tag: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
        if _open:
            _open[-1].append(self.root)
        self.n = 0

    def keep(self, df: DataFrame, name: str, arrow_rows: int | None = None, codec: str = "snappy") -> DataFrame:
        """Write df and return the written table. arrow_rows bounds a Python batch meanwhile."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = self.spark.conf.get(ARROW_ROWS)
        if arrow_rows:
            self.spark.conf.set(ARROW_ROWS, str(arrow_rows))
        try:
            df.write.mode("overwrite").parquet(path, compression=codec)
        finally:
            if arrow_rows:
                self.spark.conf.set(ARROW_ROWS, before)
        schema = df.schema
        del df
        self.release()
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        _delete(self.spark, [t._scratch_path for t in tables])
