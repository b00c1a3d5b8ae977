"""Audit of how filters interact, over every order in which they can be applied.

A document is a mask of the filters that it fails, and documents of one part and mask are one
cell with counts. Cells are unpivoted against the steps of all orders; a running bit-or window
over a cell's steps gives the failures that came earlier, conditional sums over cells give the
metrics of a step, and a window over all steps of a filter gives its total.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: The filters, each a bit of a mask from the lowest up.
FILTERS = "ABCDE"
#: A: fewer words; B: a smaller percentage of words that are distinct; C: a greater percentage of capitals; D: any of these characters.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, "#$%&*|"
_CAPITALS, _REST, _SYMBOLS = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0)), SYMBOLS.encode()


def text_failures(data: bytes) -> int:
    """The bits of A to D that a text, as UTF-8, fails."""
    words = data.split()  # at 0x20 and 0x09-0x0D
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    n_chars = len(data.translate(None, _REST))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
        | (100 * capitals > MAX_CAPITALS * n_chars) << 2
        | (len(data.translate(None, _SYMBOLS)) < len(data)) << 3
    )


def _judge(batches):
    for b in batches:
        masks, digests = [], []
        for t in b.column("text"):
            data = t.as_py() or b""
            masks.append(text_failures(data))
            digests.append(hashlib.sha256(data).digest())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])


def filter_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...), labels (doc_id, quality, toxic, ...) -> part, mask, n, good, toxic.

    part is lang, a null one the empty string. A null text is an empty one. A document fails E if
    a smaller doc_id has the same text, told by its SHA-256; a null doc_id comes after all others
    and before none, and rows that repeat a doc_id and a text stand beside each other, so neither
    fails for the other. good and toxic count documents whose doc_id some row of labels gives
    quality 1, toxic 1; a null doc_id has no label. Other columns are not read, whatever their
    names. No documents give no cells.

    Texts are read once and not shuffled. Copies are gathered in each task before their digest
    is shuffled, so a text of very many copies is a few rows when it is compared.
    """
    s = Scratch(docs.sparkSession, "cells")
    read = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("text"))
    judged = s.keep(read.mapInArrow(_judge, "id long, part string, mask int, digest binary"), "judged", arrow_rows=500)
    rows = judged.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("c"))
    marks = labels.select(F.col("doc_id").cast("long").alias("lid"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    marks = marks.filter("lid is not null and (good or bad)").groupBy("lid").agg(F.bool_or("good").alias("good"), F.bool_or("bad").alias("bad"))
    rows = rows.join(marks, F.col("id") == F.col("lid"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "bad")})
    # of each kind of copies, how many there are and which is the first of them; c counts all rows of that id
    kinds = rows.groupBy("digest", "mask", "part", "good", "bad").agg(F.sum("c").alias("n"), F.min(F.struct(F.col("id").isNull().alias("last"), "id", "c")).alias("first"))
    # a window over kinds, of which a text has no more than four times as many as there are parts
    least = F.min(F.struct("first.last", "first.id")).over(W.partitionBy("digest"))
    kinds = kinds.withColumn("least", least)
    passing = F.when((F.col("first.last") == F.col("least.last")) & F.col("first.id").eqNullSafe(F.col("least.id")), F.col("first.c")).otherwise(0)
    split = kinds.select("part", "good", "bad", F.inline(F.array(
        F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")),
    )))
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.filter("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good").alias("good"), count("bad").alias("toxic"))


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """cells (part, mask, n, good, toxic) -> a row per part, order of filters and step.

    filters names one filter by a letter for each bit of mask. Cells that repeat a part and a mask
    are added up, and null counts are 0. The result has steps for each part of cells, zeros included:
    kept after the step, removed in it, redundant (failing its filter, removed before), unique_fails (failing
    its filter alone), good_lost and toxic_lost of those removed, and shapley, the removed of its
    filter over all orders. The work is a row per cell and step of all orders.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    cells = cells.groupBy("part", "mask").agg(total("n"), total("good"), total("toxic"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    long = cells.withColumn("filter_order", F.explode(orders))
    long = long.select("*", F.posexplode(F.split("filter_order", "(?<=.)(?=.)")).alias("step", "filter"))
    long = long.withColumns({"step": F.col("step") + 1, "bit": F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)")})
    before = W.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def sums(what, n: str = "n"):
        return F.sum(F.when(what, F.col(n)).otherwise(0)).cast("long")

    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        sums(~fails & ~gone).alias("kept"), sums(fails & ~gone).alias("removed"), sums(fails & gone).alias("redundant"),
        sums(F.col("mask") == F.col("bit")).alias("unique_fails"),
        sums(fails & ~gone, "good").alias("good_lost"), sums(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by language."""
    s = Scratch(spark, "audit")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    cells = s.keep(filter_cells(read("documents"), read("labels")), "cells")
    return interactions(cells).drop("filter")


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
masks AS (SELECT part, (len(w) < {MIN_WORDS})::INT AS a, (100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w))::INT AS b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(t))::INT AS c, regexp_matches(t, '[{SYMBOLS}]')::INT AS d, (doc_id > first)::INT AS e,
    EXISTS (FROM labels l WHERE l.doc_id = docs.doc_id AND quality = 1) AS good, EXISTS (FROM labels l WHERE l.doc_id = docs.doc_id AND toxic = 1) AS bad
  FROM docs JOIN firsts USING (t)),
cells AS (SELECT part, {{'A': a, 'B': b, 'C': c, 'D': d, 'E': e}} AS m, a + b + c + d + e AS fails, count(*) AS n,
    count(*) FILTER (good) AS good, count(*) FILTER (bad) AS toxic FROM masks GROUP BY ALL),
flat AS (SELECT *, map {{'A': m.A, 'B': m.B, 'C': m.C, 'D': m.D, 'E': m.E}} AS f FROM cells),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, k::INT AS k, o[k] AS x, list_transform(range(1, k), lambda i: o[i]) AS before FROM orders, range(1, 6) r(k)),
judged AS (SELECT *, f[x] = 1 AS failing, len(list_filter(before, lambda y: f[y] = 1)) > 0 AS gone FROM flat, steps),
sums AS (SELECT part, o AS filter_order, k AS step, x, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failing AND fails = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost FROM judged GROUP BY ALL)
SELECT * EXCLUDE (x), (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM sums
"""
