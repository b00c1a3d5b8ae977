"""Document fingerprints in the manner of I-Match, from DataFrame functions only.

Terms are maximal runs of letters, lower-cased. Of a document's distinct terms those stay whose
document frequency lies in a band. They are hashed under several randomised lexicons of the band,
one hash, independent of order, over all the terms that a lexicon leaves. PARTS lexicons each leave out another
one of PARTS equal shares of the band, so each term counts in all but one of them. For each of
SEEDS draws there are four smaller lexicons, of a sixteenth of the band and so on: what holds
fewer terms survives greater changes, so the share of equal hashes falls as texts part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

#: The band, as shares of all documents. A document has d distinct terms on average, so at most
#: d / RARE terms lie in the band whatever the corpus: this bounds what is broadcast.
RARE, COMMON = 0.001, 0.1
#: Lexicons that leave out one share each; draws, and of 1024 values of a term those that each lexicon of a draw holds.
PARTS, SEEDS, HOLDS = 4, 6, (64, 16, 4, 1)
#: The terms of the band are broadcast up to so many, and joined by sorting beyond.
MAX_BROADCAST = 2_000_000
NONE = "-"


def terms_of(text: Column) -> Column:
    """The distinct terms of text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\P{L}+"), lambda w: w != ""))


def band(docs: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """term, part, bits, code of the terms that at least rare and at most common of all documents hold, and two documents at least.

    part is the share of the band that a term falls to, bits are ten for each draw, and code, of 40 bits,
    is what a term adds to the hash of a lexicon; all from its MD5."""
    n = docs.count()
    counts = docs.select(F.explode(terms_of(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").count()
    held = counts.filter((F.col("count") >= max(2, rare * n)) & (F.col("count") <= max(3, common * n)))
    digest = F.md5("term")

    def number(start: int, digits: int) -> Column:
        return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")

    return held.select("term", (number(16, 4) % PARTS).cast("int").alias("part"), number(1, 15).alias("bits"), number(20, 10).alias("code"))


def _lexicons(shift: str = "shiftright(bits, {n})") -> list[str]:
    """For each lexicon, which terms it holds, in SQL."""
    drawn = [f"({shift.format(n=10 * s)} & 1023) < {most}" for s in range(SEEDS) for most in HOLDS]
    return [f"part <> {p}" for p in range(PARTS)] + drawn


def _banded(df: DataFrame, key: list[str], known: DataFrame) -> DataFrame:
    """df (key, sha, t) -> key, sha, copies, fingerprint. Equal rows become one, counted by copies.

    What a lexicon leaves is hashed by the sum of the terms' codes, which is the same in any order,
    as the hash of the sorted terms would be, and is gathered in place; its MD5 is what is shown."""
    # one row without a term for each text keeps it where no term is in the band
    rows = df.select(*key, "sha", F.explode(F.concat(F.array(F.lit(None).cast("string")), terms_of(F.col("t")))).alias("term"))
    rows = rows.join(known, "term", "left").filter("term is null or part is not null")
    names = [f"l{k}" for k in range(PARTS + SEEDS * len(HOLDS))]
    sums = [F.sum(F.when(F.expr(holds), F.col("code"))).alias(n) for n, holds in zip(names, _lexicons())]
    out = rows.groupBy(*key, "sha").agg(F.count_if(F.col("term").isNull()).alias("copies"), *sums)
    shown = [F.coalesce(F.substring(F.md5(F.expr(f"{n} div copies").cast("string")), 1, 8), F.lit(NONE)) for n in names]
    fingerprint = F.when(F.coalesce("l0", "l1").isNotNull(), F.concat_ws(" ", *shown)).otherwise(F.concat(F.lit("all."), "sha"))
    return out.select(*key, "sha", "copies", fingerprint.alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    """0 to 1, of two columns of fingerprints: 1 where they are equal, else the share of equal hashes
    among the lexicons that hold terms of either text; 0 where only one has terms of the band."""
    x, y = F.split(a, " "), F.split(b, " ")
    equal = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda e: (e["x"] == e["y"]) & (e["x"] != NONE)))
    either = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda e: (e["x"] != NONE) | (e["y"] != NONE)))
    apart = F.col(a).startswith("all.") | F.col(b).startswith("all.")
    return F.when(F.col(a) == F.col(b), 1.0).when(apart, 0.0).otherwise(equal / either)


def next_ids(ids: DataFrame, s: Scratch) -> DataFrame:
    """ids (id, ...) of distinct ids -> with next_id, the next smaller one; after the least, the greatest.

    Rows are dealt by ranges of id; only the first id of each range, a row per range, is put in
    one order."""
    n = 4 * int(s.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.repartitionByRange(n, F.desc("id")).withColumn("part", F.spark_partition_id())
    dealt = s.keep(dealt, "ranges")
    firsts = dealt.groupBy("part").agg(F.max("id").alias("first"))
    order = W.orderBy("part")
    after = firsts.select("part", F.lead("first").over(order).alias("after"), F.max("first").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("top"))
    after = s.keep(after, "firsts")
    own = dealt.withColumn("next_id", F.lead("id").over(W.partitionBy("part").orderBy(F.desc("id"))))
    out = own.join(F.broadcast(after), "part", "left")  # a row per range
    return s.keep(out.withColumn("next_id", F.coalesce("next_id", "after", "top")).drop("part", "after", "top"), "next")


def fingerprints(docs: DataFrame, rare: float = RARE, common: float = COMMON) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last third of the code points by the first as many of the next
    document, in descending order of doc_id; the last is followed by the first. A null text is an
    empty one. A null doc_id has no next document: its edited text ends where the replacement
    would begin, and near_next is 0. Where rows repeat a doc_id, each of them is kept; as someone's
    next document the least beginning counts, and the least fingerprint. A text without a term of
    the band has a hash of itself for a fingerprint. Other columns are not read.

    Terms are looked up and aggregated within the tasks that read the text; a text is shuffled once
    for the edit, and the part that replaces another's end once.
    """
    s = Scratch(docs.sparkSession, "fingerprints")
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known = s.keep(band(docs, rare, common), "band")
    ids = docs.filter("id is not null").groupBy("id").agg(F.max(F.length("text")).alias("n"))
    after = next_ids(ids, s)
    before = after.select(F.col("next_id").alias("id"), F.col("id").alias("prev"), F.expr("n div 3").cast("int").alias("k"))
    around = s.keep(after.select("id", "next_id").join(before, "id"), "around")
    third = F.expr("length(text) div 3").cast("int")
    # the same join twice: texts are shuffled once, as the two read one exchange
    named = docs.filter("id is not null").join(around.hint("merge"), "id")
    heads = named.select("prev", F.left("text", F.col("k")).alias("head")).groupBy("prev").agg(F.min("head").alias("head"))
    named = named.join(heads.withColumnRenamed("prev", "hid").hint("merge"), F.col("id") == F.col("hid"))
    edited = F.concat(F.left("text", F.length("text") - third), F.left("head", third))
    full = named.select("id", "next_id", "text", edited.alias("edited"))
    alone = docs.filter("id is null").select("id", F.lit(None).cast("long").alias("next_id"), "text", F.left("text", F.length("text") - third).alias("edited"))
    known = F.broadcast(known) if known.count() <= MAX_BROADCAST else known.hint("merge")

    def fingerprinted(df: DataFrame) -> DataFrame:
        both = df.select("id", "next_id", F.xxhash64("text").alias("v"), F.inline(F.array(
            F.struct(F.lit(0).alias("kind"), F.length("text").cast("long").alias("n"), F.col("text").alias("t")),
            F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), F.col("edited").alias("t")),
        )))
        return _banded(both.withColumn("sha", F.sha2("t", 256)), ["id", "next_id", "v", "kind", "n"], known)

    # apart, as texts with an id stand by id already and are aggregated without a shuffle
    found = s.keep(fingerprinted(full).unionByName(fingerprinted(alone)), "found", codec="zstd")
    own = found.filter("kind = 0").select("id", "next_id", "v", "n", "copies", "fingerprint")
    nexts = own.filter("id is not null").groupBy(F.col("id").alias("nid")).agg(F.min("fingerprint").alias("next_fingerprint"))
    other = found.filter("kind = 1").select(F.col("id").alias("eid"), F.col("v").alias("ev"), "sha", F.col("fingerprint").alias("edited_fingerprint"))
    out = own.join(other, F.expr("id <=> eid and v = ev")).join(nexts, F.col("next_id") == F.col("nid"), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        F.coalesce(likeness("fingerprint", "next_fingerprint"), F.lit(0.0)).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SUMS = ", ".join(f"sum(code) FILTER (WHERE {x}) AS l{k}" for k, x in enumerate(_lexicons("(bits >> {n})")))
_HASHES = ", ".join(f"coalesce(substr(md5(l{k}::VARCHAR), 1, 8), '{NONE}')" for k in range(PARTS + SEEDS * len(HOLDS)))
_TERMS = r"list_distinct(list_filter(regexp_split_to_array(lower({t}), '\P{{L}}+'), lambda w: w <> ''))"


def _likeness_sql(a: str, b: str) -> str:
    x, y = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    each = f"range(1, {PARTS + SEEDS * len(HOLDS) + 1})"
    equal = f"len(list_filter({each}, lambda i: {x}[i] = {y}[i] AND {x}[i] <> '{NONE}'))"
    either = f"len(list_filter({each}, lambda i: {x}[i] <> '{NONE}' OR {y}[i] <> '{NONE}'))"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN starts_with({a}, 'all.') OR starts_with({b}, 'all.') THEN 0.0::DOUBLE ELSE {equal}::DOUBLE / {either} END"


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
follow AS (SELECT doc_id, t, coalesce(lead(doc_id) OVER w, max(doc_id) OVER ()) AS nid, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt
  FROM docs WINDOW w AS (ORDER BY doc_id DESC)),
edits AS (SELECT *, substr(t, 1, length(t) - length(t) // 3) || substr(nt, 1, length(t) // 3) AS edited FROM follow),
texts AS (SELECT doc_id, 0 AS kind, t FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
counted AS (SELECT term, count(*) AS c FROM (SELECT unnest({_TERMS.format(t="t")}) AS term FROM docs) GROUP BY term),
band AS (SELECT term, ('0x' || substr(md5(term), 16, 4))::BIGINT % {PARTS} AS part, ('0x' || substr(md5(term), 1, 15))::BIGINT AS bits,
    ('0x' || substr(md5(term), 20, 10))::BIGINT AS code
  FROM counted, (SELECT count(*) AS n FROM docs) WHERE c >= greatest(2, {RARE} * n) AND c <= greatest(3, {COMMON} * n)),
held AS (SELECT doc_id, kind, {_SUMS}
  FROM (SELECT doc_id, kind, unnest({_TERMS.format(t="t")}) AS term FROM texts) JOIN band USING (term) GROUP BY doc_id, kind),
prints AS (SELECT doc_id, kind, CASE WHEN coalesce(l0, l1) IS NULL THEN 'all.' || sha256(t) ELSE array_to_string([{_HASHES}], ' ') END AS p FROM texts LEFT JOIN held USING (doc_id, kind))
SELECT e.doc_id, length(e.t)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.p AS fingerprint, b.p AS edited_fingerprint,
  {_likeness_sql("a.p", "b.p")} AS near_edited, {_likeness_sql("a.p", "c.p")} AS near_next
FROM edits e JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 1
  JOIN prints c ON c.doc_id = e.nid AND c.kind = 0
"""
