"""Near-duplicates among vectors: random-hyperplane hashing, exact cosines, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

#: The share of links at exactly the threshold that all tables together may miss.
MISS = 1e-5
SEED = 20


def plan_tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): bits follow log2 of the number of vectors that are compared with each
    other, so that a bucket holds about eight unrelated vectors at any size; tables follow from
    bits and miss."""
    bits = max(6, math.ceil(math.log2(max(n, 2) / 8)))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-hit))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64), lengths


def near_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null, their lengths are equal, and their
    cosine in double precision is at least threshold. A vector that is null, empty, zero or holds
    a null or non-finite component, and one without a label or an id, links with nothing: n_links
    0 and itself as component. Equal vectors of one label are one class, so copies are never
    paired with each other; n_links still counts each of them. Other columns are not returned.

    Memory is bounded by an Arrow batch. Candidate pairs leave a bucket once for each table in
    which they meet; pairs of distinct near vectors are as many as their links.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = vectors.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("v"),
    )
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    v = v.withColumns({"sound": sound, "v": F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))})
    digest = F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)
    v = v.withColumn("key", F.when(F.col("sound"), digest))
    rows = scratch.keep(v.select("id", "label", "sound", "key"), "rows")
    classes = v.filter("sound").groupBy("label", "key").agg(
        F.min("id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v")
    )
    classes = scratch.keep(classes, "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold)
    agree = 1 - math.acos(threshold) / math.pi
    # 128 more signs: a pair at the threshold falls below this many equal ones once in a thousand million
    least = math.floor(128 * agree - 6 * math.sqrt(128 * agree * (1 - agree)))

    def signatures(batches):
        planes: dict[int, np.ndarray] = {}
        weights = (1 << np.arange(bits, dtype=np.int64))
        for b in batches:
            flat, lengths = _flat(b.column("v"))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            sign = np.zeros((b.num_rows, tables), np.int64)
            sketch = np.zeros((b.num_rows, 2), np.int64)
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, int(d)]).standard_normal((int(d), tables * bits + 128))
                m = flat[(starts[own][:, None] + np.arange(d)).ravel()].reshape(len(own), d)
                side = (m @ planes[d]) >= 0
                sign[own] = side[:, :-128].reshape(len(own), tables, bits) @ weights
                sketch[own] = np.packbits(side[:, -128:], axis=1).view(np.int64)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), pa.array(sign.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("label"), cells, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["rep", "label", "cells", "s1", "s2"])

    kind = classes.schema["label"].dataType.simpleString()
    cells = classes.select("rep", "label", "v").mapInArrow(signatures, f"rep long, label {kind}, cells array<long>, s1 long, s2 long")
    cells = cells.select("rep", "label", "s1", "s2", F.posexplode("cells").alias("tbl", "cell"))
    cells = scratch.keep(cells, "cells", arrow_rows=1000)
    pairs = cells.alias("x").join(cells.alias("y"), ["label", "tbl", "cell"]).filter(
        f"x.rep < y.rep and bit_count(x.s1 ^ y.s1) + bit_count(x.s2 ^ y.s2) <= {128 - least}"
    )
    pairs = scratch.keep(pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct(), "pairs")

    def cosines(batches):
        for b in batches:
            x, nx = _flat(b.column("va"))
            y, ny = _flat(b.column("vb"))
            keep = np.zeros(b.num_rows, bool)
            at_x, at_y = np.cumsum(nx) - nx, np.cumsum(ny) - ny
            for d in np.unique(nx[nx == ny]):
                own = np.flatnonzero((nx == d) & (ny == d))
                p = x[(at_x[own][:, None] + np.arange(d)).ravel()].reshape(len(own), d)
                q = y[(at_y[own][:, None] + np.arange(d)).ravel()].reshape(len(own), d)
                # scaled first, so that no square overflows or vanishes
                p, q = p / np.abs(p).max(1, keepdims=True), q / np.abs(q).max(1, keepdims=True)
                cosine = np.einsum("ij,ij->i", p, q) / np.sqrt(np.einsum("ij,ij->i", p, p) * np.einsum("ij,ij->i", q, q))
                keep[own] = cosine >= threshold
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    va = classes.select(F.col("rep").alias("a"), F.col("v").alias("va"))
    vb = classes.select(F.col("rep").alias("b"), F.col("v").alias("vb"))
    links = pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(cosines, "a long, b long")
    links = scratch.keep(links, "links", arrow_rows=4000)
    sizes = classes.select(F.col("rep").alias("b"), "size")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("others"))
    found = components(scratch, links)
    # a component's smallest id is that of one of its classes' representatives
    classes = classes.select("label", "key", "rep", "size").join(degree, "rep", "left").join(
        found.select(F.col("node").alias("rep"), "component"), "rep", "left"
    )
    classes = scratch.keep(classes, "linked")
    return rows.join(classes, ["label", "key"], "left").select(
        F.col("id").alias(id),
        F.coalesce(F.col("size") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "rep", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and groups of every vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    THEN embedding::DOUBLE[] END AS e FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE x.e IS NOT NULL AND y.e IS NOT NULL AND list_cosine_similarity(x.e, y.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links,
  least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS kept
FROM v
"""
