"""Training-order materialisation of token ids in binary shards.

Documents are dealt to groups by a hash of doc_id and text and ordered by doc_id in each, so the
result depends on the documents alone, not on how the input is split. The documents of a group
follow each other, each closed by END_ID, and are cut into sequences of LENGTH ids. Sequences are
numbered densely; a keyed Feistel permutation with cycle walking gives number g of N the global
slot of training step order. Shards hold a fixed number of slots each, as records of one fixed
stride, so slot k stands at byte (k mod shard) * stride of shard k div shard, and reading can
resume at any slot.

A record is LENGTH unsigned little-endian ids, of two bytes where the vocabulary allows, and one
newline byte. It is written by Spark's text writer, which copies bytes unchanged, so shards land
in any store Spark can write, under folder/data/bin=B/shard=K with BIN shards to a bin: a reader
that resumes lists the bins it needs, by computed paths. folder/layout holds the four numbers
that the paths are computed from.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import mix
from .wordmemo import token_batches, vocabulary_size

LENGTH, SHARD, BIN, END_ID, PAD_ID = 2048, 4096, 1024, 1, 0
KEY, TURNS = 0x5EED, 6
#: Documents of a group, on average at most; groups are a power of two, MAX_GROUPS at most, and grow beyond that.
GROUP, MAX_GROUPS, MAX_TASKS = 2048, 1 << 18, 100_000


def permute(g: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of range(n), applied to g: Feistel over the next even number of bits, walked until below n."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    low = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(TURNS, dtype=np.uint64) + mix(np.array([key], np.uint64)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        return (left << half) | right

    out = once(g.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


_SCHEMA = "number long, first_doc_id long, first_start long, n_docs long, n_ids long, crc long, data binary"


def _sequences(length: int, width: int, path: str | None):
    """Rows of a group: number in the group, first document and where in it, documents, ids that count, CRC and ids."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress  # ids are moved in two thirds of their room
        tail, number = np.zeros(0, f"<u{width}"), 0
        begins, names = np.zeros(0, np.int64), []  # of the documents in tail

        def cut(ids, rows: int):
            nonlocal tail, number, begins, names
            block = ids[: rows * length]
            lo = np.arange(rows, dtype=np.int64) * length
            first = np.searchsorted(begins, lo, "right") - 1
            docs = np.searchsorted(begins, lo + length, "left") - first
            cols: list[list] = [[], []]
            for k in range(rows):
                data = np.full(length, PAD_ID, block.dtype)
                part = block[k * length : (k + 1) * length]
                data[: len(part)] = part
                cols[0].append(zlib.crc32(data))
                cols[1].append(press(data))
            out = [
                pa.array(np.arange(number, number + rows)), pa.array([names[k] for k in first.tolist()], pa.int64()),
                pa.array(lo - begins[first]), pa.array(docs), pa.array(np.minimum(length, len(ids) - lo)),
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()),
            ]
            number += rows
            tail = ids[rows * length :]
            if len(tail):
                keep = int(np.searchsorted(begins, rows * length, "right")) - 1
                begins, names = begins[keep:] - rows * length, names[keep:]
            else:
                begins, names = np.zeros(0, np.int64), []
            return pa.RecordBatch.from_arrays(out, [c.split()[0] for c in _SCHEMA.split(", ")])

        for b in batches:
            parts, at, starts = [tail], len(tail), []
            for ids in token_batches(b.column("text").to_pylist(), path):
                starts.append(at)
                parts += [ids.astype(tail.dtype), np.array([END_ID], tail.dtype)]
                at += len(ids) + 1
            begins = np.concatenate([begins, np.array(starts, np.int64)])
            names = names + b.column("id").to_pylist()
            ids = np.concatenate(parts)
            if len(ids) >= length:
                yield cut(ids, len(ids) // length)
            else:
                tail = ids
        if len(tail):
            yield cut(tail, 1)

    return run


def write_shards(docs: DataFrame, folder: str, length: int = LENGTH, shard: int = SHARD, key: int = KEY, path: str | None = None) -> DataFrame:
    """Write docs (doc_id, text, ...) to folder and return the index, a row per sequence.

    Columns: slot, shard, byte_offset, crc32 of the record's ids, n_ids (fewer than length only in
    a group's last sequence, padded with PAD_ID), first_doc_id, first_start (its ids before the
    sequence), n_docs. A null, empty or blank text is one END_ID; a null doc_id stays null;
    repeated rows are written each. No documents: no shard and no row. Other columns are not read.

    Sequences and slots depend on the rows of docs, length and key only. Counts per group come to
    the driver, two numbers for each of at most MAX_GROUPS. Texts are shuffled once, to their
    groups, and ids once, compressed, to their shards.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "shards")
    width = 2 if vocabulary_size(path) <= 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    groups = min(MAX_GROUPS, 1 << max(0, math.ceil(math.log2(max(1, docs.count()) / GROUP))))
    dealt = docs.withColumn("h", F.xxhash64("id", "text"))
    dealt = dealt.repartitionById(groups, F.pmod("h", F.lit(groups)).cast("int")).sortWithinPartitions("id", "h").select("id", "text")
    rows = dealt.mapInArrow(_sequences(length, width, path), _SCHEMA).withColumn("part", F.spark_partition_id())
    rows = s.keep(rows, "sequences", arrow_rows=500)
    counts = rows.groupBy("part").count().orderBy("part").toPandas()
    n = int(counts["count"].sum())
    first = dict(zip(counts["part"], counts["count"].cumsum() - counts["count"]))
    spark.createDataFrame([(length, shard, width, n)], "length long, shard long, width int, n long").coalesce(1).write.mode("overwrite").json(f"{folder}/layout")

    @F.pandas_udf("long")
    def slot_of(part: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series(permute(part.map(first).to_numpy(np.int64) + number.to_numpy(np.int64), max(1, n), key))

    rows = rows.withColumn("slot", slot_of("part", "number")).withColumn("shard", F.expr(f"slot div {shard}"))
    s.release()  # by now nothing holds the shuffle of the texts
    if n:
        _write(rows, folder, -(-n // shard))
    s.release()
    return rows.select(
        "slot", "shard", F.expr(f"slot % {shard} * {width * length + 1}").alias("byte_offset"), F.col("crc").alias("crc32"),
        "n_ids", "first_doc_id", "first_start", "n_docs",
    )


def _write(rows: DataFrame, folder: str, shards: int) -> None:
    def run(batches):
        import zstandard

        loosen = zstandard.ZstdDecompressor().decompress
        for b in batches:
            data = pa.array([loosen(x) for x in b.column("data").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("slot"), data], ["shard", "slot", "data"])

    tasks = min(shards, MAX_TASKS)
    dealt = rows.select("shard", "slot", "data").repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)"))
    loose = dealt.mapInArrow(run, "shard long, slot long, data binary").withColumn("bin", F.expr(f"shard div {BIN}"))
    loose = loose.sortWithinPartitions("bin", "shard", "slot").select("bin", "shard", F.col("data").cast("string").alias("value"))
    loose.write.partitionBy("bin", "shard").option("lineSep", "\n").mode("overwrite").text(f"{folder}/data")


def read_shards(spark: SparkSession, folder: str, start_slot: int = 0, end_slot: int | None = None) -> DataFrame:
    """slot, crc32, data of the records from start_slot on and before end_slot; other shards are not opened, other bins not listed.

    A shard is one file of a bounded size, read as a whole. Without a record there is no row."""
    layout = spark.read.json(f"{folder}/layout", schema="length long, shard long, width int, n long").first()
    shard, size, end = layout["shard"], layout["length"] * layout["width"], min(layout["n"], layout["n"] if end_slot is None else end_slot)
    if start_slot >= end:
        return spark.createDataFrame([], "slot long, crc32 long, data binary")
    paths = [f"{folder}/data/bin={b}" for b in range(start_slot // shard // BIN, (end - 1) // shard // BIN + 1)]
    files = spark.read.format("binaryFile").option("basePath", f"{folder}/data").load(paths)
    files = files.filter(F.col("shard").between(start_slot // shard, (end - 1) // shard)).select(F.col("shard").cast("long").alias("shard"), "content")

    def run(batches):
        for b in batches:
            for k, content in zip(b.column("shard").to_pylist(), b.column("content")):
                content = memoryview(content.as_buffer())
                for lo in range(0, len(content) // (size + 1), 256):  # some records at a time
                    data = [bytes(content[i : i + size]) for i in range(lo * (size + 1), min((lo + 256) * (size + 1), len(content)), size + 1)]
                    slots = pa.array(np.arange(k * shard + lo, k * shard + lo + len(data)))
                    yield pa.RecordBatch.from_arrays([slots, pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array(data, pa.binary())], ["slot", "crc32", "data"])

    return files.mapInArrow(run, "slot long, crc32 long, data binary").filter(F.col("slot").between(start_slot, end - 1))


def unpack(data: bytes, width: int = 2) -> list[int]:
    return np.frombuffer(data, f"<u{width}").tolist()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per sequence of all documents: its index entry, and the CRC of what is read back from its slot."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = Scratch(spark, "token-shards")
    folder = f"{s.root}/out"
    index = write_shards(docs, folder)
    found = read_shards(spark, folder).select("slot", F.col("crc32").alias("read_crc32"))
    return index.join(found, "slot", "left")


ORACLE = None
