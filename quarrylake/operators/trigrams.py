"""Substring search over a stored posting table of trigrams, and of single characters and pairs for shorter needles.

A text that holds a needle holds all of the needle's trigrams, so the postings of its rarest ones
name every text that can match, and only these are read and compared. Postings are never wrong by
being stale: a change appends those of the new text, and what no longer matches is refused by the
comparison. Nothing is ever rewritten but by compact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship_package
from ..written import written

#: Trigrams of a needle that are looked up; any of them suffice, more leave fewer texts to read.
PROBES = 4
#: Characters of texts that a task cuts up at once; needles that a text is compared with at once. Both bound memory.
CHARS, TOGETHER = 1 << 21, 1024


def text_grams(low: str) -> set[str]:
    """The trigrams of a lower-cased text; a shorter text that is not empty is its own."""
    return {low[k : k + 3] for k in range(len(low) - 2)} if len(low) >= 3 else {low} - {""}


@F.pandas_udf(T.ArrayType(T.StringType()))
def grams(low: pd.Series) -> pd.Series:
    """text_grams of a column that is lower-cased already; null has none."""
    return low.map(lambda t: [] if t is None else sorted(text_grams(t)))


def _cut(texts: list[str], row: np.ndarray) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts, none empty, and the rows that they are of, ascending -> for pieces of one, two and three characters: (pieces, where the rows of each end, rows)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    n = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), n)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    letters = np.flatnonzero(seen)
    own, size, rows = (np.cumsum(seen) - 1)[codes], len(letters), int(row[-1]) + 1
    letters = letters.astype(np.uint32)
    key = own
    for width in (1, 2, 3):
        if width > 1:
            key = key[:-1] * size + own[width - 1 :]
        inside = text[: len(key)] == text[width - 1 :]
        of, named = key[inside], None
        if size**width * rows >= 1 << 63:
            named, of = np.unique(of, return_inverse=True)
        if not len(of):
            continue
        both = np.sort(of * rows + row[text[: len(key)][inside]])
        both = both[np.append(True, both[1:] != both[:-1])]
        of = both // rows
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
        piece = of[ends - 1] if named is None else named[of[ends - 1]]
        chars = np.stack([letters[piece // size**k % size] for k in range(width - 1, -1, -1)], 1)
        line = chars.tobytes().decode("utf-32-le")
        yield [line[k : k + width] for k in range(0, len(line), width)], ends, both % rows


def postings(df: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """df -> part, gram, n, ids: pieces of one to three characters of the columns and the n rows of a part of df that hold them, each row once.

    Texts are lower-cased by Spark, as a search does. A part has whole rows, up to CHARS characters and one row more."""
    ship_package(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for b in batches:
            texts, row, held = [], [], 0
            for k in range(b.num_rows):
                for c in range(1, b.num_columns):
                    if t := b.column(c)[k].as_py():
                        texts.append(t)
                        row.append(k)
                        held += len(t)
                if held >= CHARS or texts and k == b.num_rows - 1:
                    part += 1
                    for pieces, ends, rows in _cut(texts, np.array(row, np.int64)):
                        ids = b.column(0).take(pa.array(rows))
                        starts = np.append(0, ends).astype(np.int32)
                        named = pa.array(np.full(len(pieces), part))
                        yield pa.RecordBatch.from_arrays([named, pa.array(pieces), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(starts), ids)], ["part", "gram", "n", "ids"])
                    texts, row, held = [], [], 0

    low = [F.lower(F.col(c).cast("string")).alias(f"c{k}") for k, c in enumerate(columns)]
    return df.filter(F.col(id).isNotNull()).select(F.col(id).alias("id"), *low).mapInArrow(run, f"part long, gram string, n int, ids array<{kind}>")


class TrigramIndex:
    """The postings of a table under a root: layers of Parquet, each file sorted by gram. A row has a gram and those rows of some texts
    that hold it. counts, of the first layer, tell which grams are rare; they guide and need not be exact."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _layer(self, rows: DataFrame) -> None:
        rows.repartition("gram").sortWithinPartitions("gram").write.parquet(f"{self.root}/postings/layer={uuid.uuid4().hex}")

    def build(self, df: DataFrame, id: str, columns: list[str]) -> None:
        """The postings of all rows of df."""
        self._layer(postings(df, id, columns))
        self._lists().groupBy("gram").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{self.root}/counts")

    def append(self, changed: DataFrame, id: str, columns: list[str]) -> None:
        """Add the postings of new or changed rows, before their texts are to be found. Deleted rows need nothing."""
        self._layer(postings(changed, id, columns))

    def _lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/postings").select("layer", "part", "gram", "n", "ids")

    def rows(self) -> DataFrame:
        return self._lists().select("gram", F.explode("ids").alias("id"))

    def layers(self) -> int:
        return self.spark.read.parquet(f"{self.root}/postings").select("layer").distinct().count()

    def compact(self, df: DataFrame, id: str, columns: list[str], to: str) -> TrigramIndex:
        """An index of what df now holds, of one layer, under another root."""
        new = TrigramIndex(self.spark, to)
        new.build(df, id, columns)
        return new

    def candidates(self, needles: DataFrame) -> DataFrame:
        """needles (needle), distinct and lower-cased -> needle, id of the rows that may hold it."""
        return self._named(needles).distinct()

    def _named(self, needles: DataFrame) -> DataFrame:
        """candidates; a row of several layers may come more than once.

        A needle of three characters or more is looked up by its rarest grams, one of which may be in no posting; a shorter one is a gram itself."""
        ship_package(self.spark)
        own = needles.filter("needle <> ''").select("needle", F.explode(F.when(F.length("needle") < 3, F.array("needle")).otherwise(grams(F.col("needle")))).alias("gram"))
        counts = self.spark.read.parquet(f"{self.root}/counts")
        ranked = own.join(counts, "gram", "left").groupBy("needle").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, PROBES).alias("g"))
        rare = written(ranked.select("needle", F.size("g").alias("k"), F.explode("g.gram").alias("gram")), "rare")
        # all grams of a text are in one part of a layer: its lists meet there, and no row is made for what one gram alone names
        lists = self._lists().join(rare, "gram").groupBy("layer", "part", "needle", "k").agg(F.collect_list("ids").alias("l")).filter(F.size("l") == F.col("k"))
        return lists.select("needle", F.explode(F.aggregate(F.slice("l", 2, PROBES), F.get("l", F.lit(0)), F.array_intersect)).alias("id"))

    def search(self, df: DataFrame, needles: DataFrame, id: str, columns: list[str]) -> DataFrame:
        """needles (needle) -> needle and the columns of df of the rows that hold it in one of columns, any case.

        An empty or null needle finds nothing. df is what the index was built and appended from, as it is now."""
        wanted = needles.filter("needle is not null and needle <> ''").select("needle", F.lower("needle").alias("__low")).distinct()
        wanted = written(wanted, "needles")
        found = self._named(wanted.select(F.col("__low").alias("needle")).distinct())
        # a text meets up to TOGETHER needles or so at once, and is lower-cased once for these
        part = F.pmod(F.xxhash64("needle"), F.lit(1 + wanted.count() // TOGETHER))
        found = found.groupBy(F.col("id").alias("__id"), part.alias("__part")).agg(F.collect_set("needle").alias("__needles"))
        rows = df.join(found, F.col(id) == F.col("__id")).withColumns({f"__c{k}": F.lower(F.col(c).cast("string")) for k, c in enumerate(columns)})
        rows = rows.withColumn("__low", F.explode("__needles"))
        hit = F.lit(False)
        for k in range(len(columns)):
            hit = hit | F.coalesce(F.contains(F.col(f"__c{k}"), F.col("__low")), F.lit(False))
        return rows.filter(hit).join(wanted, "__low").select("needle", *df.columns)

    def search_one(self, df: DataFrame, text: str, id: str, columns: list[str], order: list, limit: int) -> DataFrame:
        """Rows of df that hold text, as text_search finds them, of those alone that the postings name."""
        one = self.spark.createDataFrame([(text,)], T.StructType([T.StructField("needle", T.StringType())]))
        return self.search(df, one, id, columns).drop("needle").orderBy(*order).limit(limit)
