"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

A sketch has SIZE coordinates. In round i each shingle falls into one bin by that round's hash
and offers the value i + fraction there; a bin keeps its least value. From round SIZE on, round i
offers all shingles to bin i - SIZE, so every coordinate fills. A bin that is filled in round i
cannot change in a later one, so rounds end once all are filled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .caches import claim
from .components import components
from .scratch import Scratch, inner_names
from .textops import between, mix, rolling, word_hashes

#: Two texts at similarity 0.75 share no band with probability (1 - 0.75**ROWS)**BANDS = 5e-6.
#: Bands read the first coordinates; all of them estimate a similarity, two bits from each.
SIZE, ROWS, BANDS = 1024, 4, 32
SHINGLE, SIMILARITY = 5, 75
_ROUND = np.uint64(52)  # 12 bits for the round, 52 for the fraction


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence if it is shorter."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() touches A-Z only
    if not len(words):
        return words
    start = np.arange(max(1, len(words) - n + 1))
    return np.unique(between(rolling(words), start, np.minimum(start + n, len(words))))


def sketch(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The fast similarity sketch of a non-empty array of distinct 64-bit hashes."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(size, empty, np.uint64)
    # some 2 * size values at a time, so that few sets need more than five turns
    r, step = 0, max(1, 2 * size // len(elements))
    while r < 2 * size:
        rounds = np.arange(r, min(r + step, 2 * size), dtype=np.uint64)
        h = mix(elements[:, None] ^ mix(rounds * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)))
        bins = np.where(rounds < size, h % np.uint64(size), rounds % np.uint64(size)).astype(np.int64)
        value = (rounds << _ROUND) | (mix(h) >> np.uint64(12))
        np.minimum.at(out, bins.ravel(), value.ravel())
        r += step
        if not (out == empty).any():
            break
    return out


_TURN = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


_PLANES = 2
_BITS = [f"b{j}_{i}" for j in range(_PLANES) for i in range(SIZE // 64)]


def _describe(text: str | None) -> tuple[int, ...]:
    """n, two halves of a set digest, sketch bits in longs, band keys."""
    s = shingle_hashes(text or "")
    if not len(s):
        return 0, 0, 0, *[0] * len(_BITS), []
    k = sketch(s)
    d1, d2 = mix(s).sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
    m = mix(k)
    bits = np.concatenate([np.packbits((m >> np.uint64(j) & np.uint64(1)).astype(np.uint8)).view(np.int64) for j in range(_PLANES)])
    bands = mix(mix(k[: ROWS * BANDS].reshape(-1, ROWS) + _TURN).sum(1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    return len(s), int(d1.view(np.int64)), int(d2.view(np.int64)), *bits.tolist(), bands.view(np.int64).tolist()


_SETS = ["id", "n", "d1", "d2", *_BITS, "bands"]


def _sketches(batches):
    claim("sketches", lambda: None)
    types = [pa.int64()] * (len(_SETS) - 1) + [pa.list_(pa.int64())]
    for b in batches:
        rows = [_describe(t.as_py()) for t in b.column("text")]
        cols = list(zip(*rows)) if rows else [[]] * (len(_SETS) - 1)
        yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, t) for c, t in zip(cols, types[1:])]], _SETS)


def exact_shingles(text: str | None, n: int = SHINGLE) -> set:
    """The set itself, without hashing of ours."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(n)]))


def _verify(percent: int):
    def run(batches):
        for b in batches:
            keep, last, left = [], None, set()
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist()):
                if x != last:
                    last, left = x, exact_shingles(x)
                right = exact_shingles(y)
                both = len(left & right)
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept: a row for each row.

    Links are 100 * intersection >= percent * union of five-word shingle sets. A null or empty
    text, or one of white space, has no shingle and links with nothing; a null doc_id is a row
    of its own with null component_id and kept true. Rows that repeat a doc_id count as one
    document, with the sets of each row; kept is then true for each of them. Other columns are
    not read, whatever their names.

    Equal sets are one class. Linear work comes first: every class tries the least neighbour of
    its band buckets, components are formed, and in buckets whose members components still
    separate, all try one member drawn for the bucket. Pairs of a bucket are looked at only where
    that leaves members apart: those outside the drawn member's component, against all of the
    bucket, and each pair in one bucket only. Sketch bits sort out pairs five deviations below
    the threshold; the others are verified on their full texts. No step holds a whole bucket; skewed joins read written tables,
    so adaptive execution splits them.
    """
    spark = docs.sparkSession
    s = scratch or Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    schema = ", ".join(f"{c} {'array<long>' if c == 'bands' else 'long'}" for c in _SETS)
    sets = s.keep(docs.mapInArrow(_sketches, schema), "sets", arrow_rows=500)
    key = ["n", "d1", "d2"]
    classes = sets.filter("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    copies = s.keep(classes.filter("size > 1").drop("size"), "copies")
    members = sets.select("id", *key).join(copies, key, "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    members = s.keep(members, "members")
    reps = sets.join(copies, key, "left").filter("n > 0 and id is not null and (rep is null or rep = id)")
    # a row for each set that an id stands for
    reps = s.keep(reps.select("id", "n", "d1", "d2", *_BITS, "bands").dropDuplicates(["id", "n", "d1", "d2"]).drop("d1", "d2"), "reps")
    s.drop(sets)
    bands = reps.select(F.explode("bands").alias("band"), "id")
    bits = reps.select("id", "n", *_BITS)
    # coordinates that are not equal still agree in their two bits once in four
    p = (1 - percent / 100) * (1 - 2.0**-_PLANES)
    differ = int(SIZE * p + 5 * (SIZE * p * (1 - p)) ** 0.5) + 1

    def like(x: str, y: str) -> str:
        planes = [[f"({x}.b{j}_{i} ^ {y}.b{j}_{i})" for j in range(_PLANES)] for i in range(SIZE // 64)]
        counts = " + ".join(f"bit_count({' | '.join(p)})" for p in planes)
        return f"{counts} <= {differ} and 100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        texts = docs.filter("id is not null")
        left, right = (texts.select(F.col("id").alias(i), F.col("text").alias("t" + i)) for i in "ab")
        # sorted at any size: a broadcast of the pairs would not hold on a large corpus
        found = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        found = found.select("a", "b", "ta", "tb").mapInArrow(_verify(percent), "a long, b long")
        return s.keep(found.distinct(), name, arrow_rows=500)

    buckets = bands.groupBy("band").agg(F.min("id").alias("rep"), F.count("*").alias("c"))
    buckets = s.keep(buckets.filter("c > 1").select("band", "rep"), "buckets")
    stars = s.keep(bands.join(buckets, "band").filter("id <> rep"), "stars")
    tries = stars.select("id", "rep").distinct().join(bits, "id")
    tries = tries.alias("x").join(bits.withColumnRenamed("id", "rep").alias("y"), "rep").filter(like("x", "y"))
    first = s.keep(tries.groupBy(F.col("id").alias("b")).agg(F.min("rep").alias("a")).select("a", "b"), "first")
    links = verified(first, "links")
    found = components(s, links)

    apart = _component_of(_component_of(stars, found, "id", "ic"), found, "rep", "rc").filter("ic <> rc")
    apart = s.keep(apart.select("band").distinct(), "apart")
    others = s.keep(bands.join(apart, "band", "left_semi"), "others")
    opened = others.groupBy("id").agg(F.collect_set("band").alias("open"))  # BANDS at most
    others = s.keep(others.join(bits, "id").join(opened, "id"), "others")

    def separate(links_of: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of open buckets with their components, and of those the ones outside the drawn member's."""
        now = s.keep(_component_of(others, links_of, "id", "ic", "alone"), "now")
        # one that has links already stands a better chance to link others
        drawn = now.groupBy("band").agg(F.min(F.struct("alone", F.xxhash64("id", "band").alias("h"), "id", "n", *_BITS, "ic")).alias("r"))
        drawn = s.keep(drawn.select("band", "r.*").drop("alone", "h"), "drawn")
        rest = now.alias("x").join(drawn.alias("y"), "band").filter("x.ic <> y.ic")
        rest = s.keep(rest.select("band", "x.id", "x.n", *[f"x.{b}" for b in _BITS], "x.ic", F.col("y.id").alias("drawn"), F.expr(like("x", "y")).alias("near"), "x.open"), "rest")
        return now, rest

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    tried = first
    now, rest = separate(found)
    pairs = s.keep(rest.filter("near").select(*ordered("id", "drawn")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    tried = tried.unionByName(pairs)
    more = verified(pairs, "more")
    if more.limit(1).count():
        links = links.unionByName(more)
        found = components(s, links)
        now, rest = separate(found)
    # a pair comes from the least of the open buckets that hold both
    once = "x.band = array_min(array_intersect(x.open, y.open))"
    cross = rest.alias("x").join(now.alias("y"), "band").filter(f"x.ic <> y.ic and {like('x', 'y')} and {once}")
    pairs = cross.select(*ordered("x.id", "y.id")).distinct().join(tried, ["a", "b"], "left_anti")
    more = verified(s.keep(pairs, "pairs"), "more")
    if more.limit(1).count():
        found = components(s, links.unionByName(more))
    out = members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _component_of(df: DataFrame, found: DataFrame, column: str, name: str, alone: str | None = None) -> DataFrame:
    """df with the component of the class in column, itself where it has no link."""
    found = found.select(F.col("node").alias(column), F.col("component").alias("__c"))
    out = df.join(found, column, "left").withColumn(name, F.coalesce("__c", column))
    return (out.withColumn(alone, F.col("__c").isNull()) if alone else out).drop("__c")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each near-duplicate group, all columns. Texts without a word, null and empty ones, and
    rows with a null doc_id are groups of their own and stay; rows that repeat a kept doc_id stay each; no documents give none."""
    (kept,) = inner_names(docs.columns, "kept_id")
    found = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi")


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
keyed AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS k, s FROM sets),
reps AS (SELECT min(doc_id) AS rep, k, any_value(n) AS n FROM keyed WHERE n > 0 GROUP BY k),
rows AS (SELECT rep, n, unnest(s) AS g FROM reps JOIN keyed USING (k, n) WHERE doc_id = rep),
pairs AS (SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM rows x JOIN rows y ON x.g = y.g AND x.rep <> y.rep GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 75 * (na + nb - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, keyed.n::BIGINT AS n_shingles, least(coalesce(rep, doc_id), coalesce(b, rep, doc_id)) AS component_id,
  doc_id = least(coalesce(rep, doc_id), coalesce(b, rep, doc_id)) AS kept
FROM keyed LEFT JOIN reps ON keyed.k = reps.k AND keyed.n > 0 LEFT JOIN least_of ON least_of.a = rep
"""
