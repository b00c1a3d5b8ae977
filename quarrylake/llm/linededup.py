"""Line dedup over content-defined chunks of lines.

A document is its text split at newlines. A rolling polynomial hash over the hashes of WINDOW
lines decides after which lines a chunk ends, so an inserted or deleted line moves only the
boundaries near it. A chunk of two or more lines whose bytes also stand in an earlier place of the
corpus is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: Lines that a boundary looks at, and the expected number of lines between boundaries, a power of two.
WINDOW, SPACING = 4, 4
#: The polynomial's odd base, the bits its powers keep, the modulus and the factor that mix its value.
BASE, POWER_BITS, PRIME, FACTOR, SHIFT = 40503, 28, 2147483647, 69069, 16


def powers(window: int) -> tuple[int, ...]:
    """What the hash of the line k before counts for; odd, so that each line of the window moves the value."""
    return tuple(pow(BASE, k, 1 << POWER_BITS) for k in range(window))


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _chunks(text: Column, window: int, spacing: int) -> list[tuple[str, Column]]:
    """Columns that cut text to chunks, to be added one after the other."""
    lines, hashes, ends = F.col("lines"), F.col("hashes"), F.col("ends")

    def closes(i: Column) -> Column:
        # 32 bits times 28 bits, window times: no sum of eight lines overflows
        value = sum((F.coalesce(F.get(hashes, i - k), F.lit(0)) * f for k, f in enumerate(powers(window))), F.lit(0).cast("long"))
        return F.shiftright(value % PRIME * FACTOR, SHIFT).bitwiseAND(F.lit(spacing - 1)) == 0

    last = F.size(lines) - 1
    before = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(-1))
    return [
        ("lines", F.split(text, "\n", -1)),
        ("hashes", F.transform(lines, line_hash)),
        ("ends", F.filter(F.sequence(F.lit(0), last), lambda i: closes(i) | (i == last))),
        ("chunks", F.transform(ends, lambda e, k: F.array_join(F.slice(lines, before(k) + 2, e - before(k)), "\n"))),
    ]


def _cut(df: DataFrame, window: int, spacing: int) -> DataFrame:
    """df with the columns of _chunks. Each comes out of a generator of one row, behind which it
    is a value: folded into the lambdas that read it, it would be computed anew for each line."""
    for name, column in _chunks(F.col("text"), window, spacing):
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def dedup_lines(docs: DataFrame, window: int = WINDOW, spacing: int = SPACING) -> DataFrame:
    """docs with text, n_chunks and n_removed; every row stays.

    A chunk is removed if it has two lines at least, is not all white space, and a chunk with the
    same bytes comes before it, in the order of doc_id (null last), hash of the document's text,
    chunk number. Rows that repeat a doc_id with one text count as one document. A null text
    stays null and has no chunk; an empty one has one. text keeps its remaining chunks joined by
    newlines, and is empty where all went. Other columns pass through, whatever their names; of
    the names text, n_chunks and n_removed the new columns replace old ones.

    Each task first gathers equal chunks, so a chunk of very many documents leaves a task once.
    Of chunks whose hash repeats, the first place of each is kept by a comparison of bytes. The
    joins sort at any size, read written tables and are split where a key is hot.
    """
    if not 1 <= window <= 8 or spacing & (spacing - 1) or spacing < 1:
        raise ValueError("window is 1 to 8 lines, spacing a power of two")
    spark = docs.sparkSession
    s = Scratch(spark, "lines")
    # what comes with the text is one column, so its names meet none of those made here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mine = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("v"), F.col("text").cast("string").alias("text"))
    rows = _cut(mine.drop("row"), window, spacing).select("id", "v", F.posexplode("chunks").alias("k", "chunk"))
    rows = rows.filter(F.col("chunk").contains("\n") & F.col("chunk").rlike(r"\S")).withColumn("h", F.xxhash64("chunk"))
    hashes = s.keep(rows.select("id", "v", "k", "h"), "hashes")
    repeated = s.keep(hashes.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "repeated")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "v", "k")
    firsts = rows.groupBy("h", "chunk").agg(F.min(place).alias("p")).select("h", "p.*")
    firsts = s.keep(firsts.join(repeated.hint("merge"), "h", "left_semi").select("id", "v", "k"), "firsts")
    # what repeats and is nobody's first place goes; null-safe, for documents without an id
    places = s.keep(hashes.join(repeated.hint("merge"), "h", "left_semi").select("id", "v", "k").distinct(), "places")
    gone = places.alias("x").join(firsts.alias("y"), F.expr("x.id <=> y.id and x.v = y.v and x.k = y.k"), "left_anti")
    gone = gone.groupBy(F.col("id").alias("gid"), F.col("v").alias("gv")).agg(F.collect_list("k").alias("gone"))
    gone = s.keep(gone, "gone")
    s.drop(hashes, repeated, firsts, places)
    out = _cut(mine.join(gone.hint("merge"), F.expr("id <=> gid and v = gv"), "left"), window, spacing)
    # a set of all positions less those gone keeps order; array_except is a hash set
    left = F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda k: F.get("chunks", k)), "\n"))
    n_chunks = F.when(F.col("text").isNull(), 0).otherwise(F.size("chunks")).cast("long")
    kept = [c for c in docs.columns if c not in ("n_chunks", "n_removed")]
    return out.select(
        *[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in kept],
        n_chunks.alias("n_chunks"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines of all documents, the remaining text as its SHA-256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_chunks", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text of every document without its repeated chunks; documents that lost all go. Nulls, empty texts,
    repeated rows and names are as in dedup_lines; no documents give none."""
    out = dedup_lines(docs)
    lost = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")
    out = out.filter(~F.coalesce(lost, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


_VALUE = " + ".join(f"coalesce(CASE WHEN i > {k} THEN h[i - {k}] END, 0) * {f}" for k, f in enumerate(powers(WINDOW)))
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
hashed AS (SELECT *, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM lines),
marked AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR
    (({_VALUE}) % {PRIME} * {FACTOR} // {1 << SHIFT}) % {SPACING} = 0) AS e FROM hashed),
cut AS (SELECT doc_id, text, list_transform(range(1, len(e) + 1), lambda k: array_to_string(l[(CASE WHEN k > 1 THEN e[k - 1] ELSE 0 END) + 1 : e[k]], chr(10))) AS c FROM marked),
rows AS (SELECT doc_id, k, c[k] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS k FROM cut)),
judged AS (SELECT *, contains(chunk, chr(10)) AND regexp_matches(chunk, '\\S')
    AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) > 1 AS gone FROM rows),
kept AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '') AS t FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(t) END AS kept_sha256 FROM documents d LEFT JOIN kept USING (doc_id)
"""
