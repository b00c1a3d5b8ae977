"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct words that one deletion, replacement or insertion
over the observed alphabet makes of it. Those that are words of the vocabulary are its near words:
a hash join finds them, and no distance is computed. Words are handled as arrays of Latin-1 codes,
and a neighbour is its 64-bit hash and the edit that makes it, from which SQL spells it out
where the hash is that of a word, so that what is joined in the end is equal letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .textops import P, mix, powers

#: A word's least length and count; how many times as frequent its form is; of how many runs one loses a letter.
MIN_LENGTH, MIN_COUNT, FACTOR, SPOIL = 6, 5, 5, 199
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: The filter that neighbours pass before they are joined: a fixed 4 MB at any size of the vocabulary.
#: Fuller at larger sizes, it lets more neighbours through to the join and loses none.
FILTER_BITS = 25
#: Positions of words whose neighbours are made at once.
BLOCK = 1 << 14
_INVERSE = np.uint64(pow(int(P), -1, 1 << 64))

#: Latin-1 bytes to themselves where they are letters of a run, A-Z to a-z, all others to a space.
_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]
_TO_RUN = bytes(b + 32 if 0x41 <= b < 0x5B else b if b in set(_LETTERS) else 0x20 for b in range(256))


def text_words(id: int | None, text: str, spoil: int = SPOIL) -> Counter:
    """Counts of the lower-cased runs of letters of a text, as Latin-1 bytes; a run whose CRC-32
    with the id is a multiple of spoil lacks a letter."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if id is None else id}:".encode())
    # a code point is a byte, and what is not Latin-1 is no letter of a run
    for run, n in Counter(text.encode("latin-1", "replace").translate(_TO_RUN).split()).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % spoil == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, spoil: int = SPOIL, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """docs (doc_id, text, ...) -> word, n: the vocabulary of all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased, at least
    min_length long and min_count times found. A null text has none; a null doc_id counts as an
    empty one; rows that repeat a document count again. Tasks add up their counts before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for id, t in zip(b.column("id"), b.column("text")):
                if t.is_valid:
                    for w, n in text_words(id.as_py(), t.as_py(), spoil).items():
                        if len(w) >= min_length:
                            held[w] += n
            if len(held) >= HELD:
                yield rows()
                held = Counter()
        yield rows()

    read = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    counted = read.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, their codes + 1 as a matrix) for each length."""
    raw = [w.encode("latin-1") for w in words]
    lengths = np.array([len(w) for w in raw], np.int64)
    for m in np.unique(lengths):
        own = np.flatnonzero(lengths == m)
        yield own, np.frombuffer(b"".join(raw[i] for i in own), np.uint8).reshape(len(own), m).astype(np.uint64) + np.uint64(1)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Sums of codes[:, :i] * P**i, from none to all."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum(codes * powers(codes.shape[1]), axis=1, out=out[:, 1:])
    return out


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.zeros(len(words), np.uint64)
    for own, codes in _by_length(words):
        out[own] = mix(_prefixes(codes)[:, -1])
    return out


def neighbours(words: list[str], alphabet: np.ndarray, wanted=lambda h: np.ones(len(h), bool)) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the word, hash of the neighbour, position, letters skipped, code of the letter put in or 0) in
    blocks of all distinct neighbours that wanted lets pass; alphabet are Latin-1 codes."""
    letters = alphabet.astype(np.uint64) + np.uint64(1)
    for own, codes in _by_length(words):
        n, m = codes.shape
        sums = _prefixes(codes)
        rest = sums[:, -1:] - sums  # of what stands at a position and after it
        power = powers(m + 1)
        for at in range(0, n * (m + 1), BLOCK):
            row, pos = np.divmod(np.arange(at, min(at + BLOCK, n * (m + 1))), m + 1)
            inside = pos < m
            there = np.where(inside, codes[row, np.minimum(pos, m - 1)], np.uint64(0))
            head, p = sums[row, pos], power[pos]
            # of equal letters in a row only the first is deleted, and one is inserted only behind the last
            first = np.flatnonzero(inside & ((pos == 0) | (there != codes[row, np.maximum(pos, 1) - 1])))
            after = rest[row[first], pos[first] + 1]
            parts = [(row[first], mix(head[first] + after * _INVERSE), pos[first], np.ones(len(first), np.int8), np.zeros(len(first), np.uint64))]
            differ = there[:, None] != letters[None, :]
            put = p[:, None] * letters[None, :]
            i, k = np.nonzero(differ & inside[:, None])
            parts.append((row[i], mix((head + np.where(inside, rest[row, np.minimum(pos + 1, m)], 0))[i] + put[i, k]), pos[i], np.ones(len(i), np.int8), letters[k]))
            i, k = np.nonzero(differ)
            parts.append((row[i], mix((head + rest[row, pos] * P)[i] + put[i, k]), pos[i], np.zeros(len(i), np.int8), letters[k]))
            for r, h, at_, skip, letter in parts:
                keep = np.flatnonzero(wanted(h))
                if len(keep):
                    yield own[r[keep]], h[keep], at_[keep], skip[keep], letter[keep] - (letter[keep] > 0)


def _slots(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two of 2 ** size bits of the filter that stand for a hash."""
    return h >> np.uint64(64 - size), h & np.uint64((1 << size) - 1)


def _filter(words: DataFrame, size: int) -> np.ndarray:
    """The filter of words (h): at most 2 ** size / 64 rows come to the driver, whatever there is."""

    def bits(batches):
        for b in batches:
            at = np.concatenate(_slots(b.column("h").to_numpy().view(np.uint64), size))
            one = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(one.view(np.int64))], ["at", "one"])

    rows = words.select("h").mapInArrow(bits, "at long, one long").groupBy("at").agg(F.bit_or("one").alias("one")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[rows["at"].to_numpy()] = rows["one"].to_numpy().view(np.uint64)
    return out


def near_words(words: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """words (word, n), distinct words of Latin-1 letters -> word, near, near_n: the pairs of words that
    differ by exactly one inserted, deleted or replaced letter, in both directions. Null words have none.

    A neighbour is a row of fixed size until it is known to be a word, and a word can be the
    neighbour of no more words than it has neighbours, so no key is hot. Neighbours first pass a
    filter of 2 ** filter_bits bits, at least 6, that holds all words and is broadcast.
    """
    spark = words.sparkSession
    s = Scratch(spark, "spelling")

    def hashed(batches):
        for b in batches:
            h = word_hashes(b.column("word").to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(h)], ["word", "n", "h"])

    known = s.keep(words.filter("word is not null and word <> ''").select("word", F.col("n").cast("long").alias("n")).mapInArrow(hashed, "word string, n long, h long"), "words")
    # at most the letters of a run, which are 90
    letters = known.select(F.explode(F.array_distinct(F.split("word", "(?<=.)(?=.)"))).alias("c")).distinct().toArrow()["c"].to_pylist()
    alphabet = np.array(sorted(c.encode("latin-1")[0] for c in letters), np.uint8)
    shared = spark.sparkContext.broadcast((alphabet, _filter(known, filter_bits)))

    def emit(batches):
        alphabet, bits = shared.value

        def wanted(h: np.ndarray) -> np.ndarray:
            a, b = _slots(h, filter_bits)
            out = bits[a >> np.uint64(6)] >> (a & np.uint64(63)) & np.uint64(1) == 1
            left = np.flatnonzero(out)
            b = b[left]
            out[left] = bits[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1) == 1
            return out

        for b in batches:
            source = b.column("h").to_numpy()
            for row, h, pos, skip, letter in neighbours(b.column("word").to_pylist(), alphabet, wanted):
                put = pa.array([chr(c) if c else "" for c in letter.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(source[row]), pa.array(h.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(skip.astype(np.int32)), put],
                    ["source", "h", "pos", "skip", "put"],
                )

    # dealt anew, as few files of words make many neighbours
    dealt = known.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "word").select("word", "h")
    made = s.keep(dealt.mapInArrow(emit, "source long, h long, pos int, skip int, put string"), "neighbours", arrow_rows=1000)
    met = made.join(known.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "h"), "h").drop("h")
    spelt = F.expr("concat(left(word, pos), put, substring(word, pos + 1 + skip))")
    # words of one hash are told apart here, as the neighbour is spelt out
    pairs = met.join(known.select("word", F.col("h").alias("source")), "source").filter(spelt == F.col("near"))
    out = s.keep(pairs.select("word", "near", "near_n").distinct(), "pairs")
    shared.destroy()
    return out


def spelling_forms(words: DataFrame, factor: int = FACTOR, filter_bits: int = FILTER_BITS) -> DataFrame:
    """words (word, n) -> word, form, root, n, n_near, form_n, a row per word.

    form is the near word of largest n, of equal ones the smallest in code-point order, if its n is
    at least factor times the word's, else null. root is where forms lead from word to word, the
    word itself if it has no form. A repeated word counts with the sum of its n; a null or empty one is left out; no words give none.

    As n grows by factor along forms, chains have log(n) links, and each of the joins that follow
    them doubles their reach.
    """
    if factor < 2:
        raise ValueError("factor is at least 2")
    s = Scratch(words.sparkSession, "forms")
    words = words.filter("word is not null and word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = s.keep(words, "words")
    best = near_words(words, filter_bits).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    formed = words.join(best, "word", "left").withColumn("form_n", -F.col("best.n")).withColumn("ok", F.coalesce(F.col("form_n") >= factor * F.col("n"), F.lit(False)))
    formed = s.keep(formed.select(
        "word", F.when(F.col("ok"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("ok"), F.col("form_n")).alias("form_n"),
    ), "formed")
    roots = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 0
    longest, reach = 1, 1
    while factor ** (longest + 1) <= most:
        longest += 1
    while reach < longest:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = s.keep(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    out = formed.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants of the words of all documents."""
    s = Scratch(spark, "vocabulary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_forms(s.keep(word_counts(docs), "counts", arrow_rows=500))


_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC_TABLE = f"list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: {_STEP}, b::BIGINT))"
ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c, hex(encode(doc_id || ':' || run)) AS x FROM runs GROUP BY ALL),
table_ AS (SELECT {_CRC_TABLE} AS t),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT),
    lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8), 4294967295)) AS h FROM counted, table_),
spoilt AS (SELECT CASE WHEN h % {SPOIL} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM spoilt WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
open_ AS (SELECT word, n, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS p FROM places),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM places),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM open_ a JOIN open_ b USING (p) WHERE a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.d = w.word UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.d = w.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) = 1),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FACTOR} * n THEN near END AS form, CASE WHEN near_n >= {FACTOR} * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk(word, cur) AS (SELECT word, word FROM formed UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.cur WHERE form IS NOT NULL)
SELECT f.word, f.form, w.cur AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w USING (word) JOIN formed e ON e.word = w.cur WHERE e.form IS NULL
"""
