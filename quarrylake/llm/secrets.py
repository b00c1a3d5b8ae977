"""Secret scan: keyword automaton, regular expressions anchored at its hits, embedded checksums.

An Aho-Corasick automaton of all keywords reads each text once. A rule's regular expression is
tried only where one of its keywords starts. What some kinds of token say about themselves, a
CRC-32 or a Bech32 checksum, is then computed, so a look-alike is dropped. Runs of hexadecimal
digits have no keyword: every eighth character is probed, and a run of 32 covers four probes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

#: The digits of base 62 and of Bech32, and the generator of the latter's checksum.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
#: Shortest hexadecimal run, and the distance of the probes that find one.
HEX, PROBE = 32, 8
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPANS_DDL = "array<struct<kind: string, start: int, end: int>>"


def crc_holds(token: str) -> bool:
    """Whether the last six digits are the CRC-32, in base 62, of the thirty before them."""
    crc = 0
    for c in token[-6:]:
        crc = crc * 62 + BASE62.index(c)
    return crc == zlib.crc32(token[-36:-6].encode())


def bech32_holds(token: str) -> bool:
    """Whether a Bech32 string, all in one case, carries the checksum of its prefix and data."""
    prefix, _, data = token.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    sum_ = 1
    for v in values:
        top, sum_ = sum_ >> 25, (sum_ & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(GENERATOR):
            if top >> i & 1:
                sum_ ^= g
    return sum_ == 1


class Rule(NamedTuple):
    """A kind of secret. keywords are lower-case; pattern is tried, against the text as it is, where
    one starts. Matches of a kind do not overlap, and one that least or holds refuses still takes
    its place. least bounds the length of the pattern's last group, or of the match where there is none."""

    kind: str
    keywords: tuple[str, ...]
    pattern: str
    least: int = 0
    holds: Callable[[str], bool] | None = None


#: In the order in which spans of one start are listed; "hex" is the kind without keywords.
RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    Rule("access", ("akia",), r"AKIA[A-Z0-9]+", 16),
    Rule("hex", (), r"[0-9a-f]+", HEX),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<![0-9A-Za-z_])gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z_])", 0, crc_holds),
    Rule("npm", ("npm_",), r"(?<![0-9A-Za-z_])npm_[0-9A-Za-z]{36}(?![0-9A-Za-z_])", 0, crc_holds),
    Rule("age", ("age-secret-key-1",), rf"(?<![0-9A-Za-z_])AGE-SECRET-KEY-1[{BECH32.upper()}]{{58}}(?![0-9A-Za-z_])", 0, bech32_holds),
    Rule("nostr", ("nsec1",), rf"(?<![0-9A-Za-z_])nsec1[{BECH32}]{{58}}(?![0-9A-Za-z_])", 0, bech32_holds),
)


@cache
def _compiled():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, rule in enumerate(RULES):
        for w in rule.keywords:
            automaton.add_word(w, (len(w), k))
    automaton.make_automaton()
    return automaton, [re.compile(r.pattern, re.ASCII) for r in RULES], re.compile(f"[0-9a-f]{{{HEX // PROBE},}}"), re.compile(f"[0-9a-f]{{{HEX},}}")


def _starts(text: str) -> Iterator[tuple[int, int]]:
    """Where a rule's pattern may match: (start, number of the rule)."""
    automaton, _, probes, runs = _compiled()
    # only A-Z are lowered, so places stay what they are
    for last, (length, k) in automaton.iter(text.encode().lower().decode()):
        yield last - length + 1, k
    hexed = next(k for k, r in enumerate(RULES) if r.kind == "hex")
    for m in probes.finditer(text[PROBE - 1 :: PROBE]):
        # a run over these probes ends before the next probe and starts after the one before
        for run in runs.finditer(text, m.start() * PROBE, (m.end() + 1) * PROBE - 1):
            yield run.start(), hexed


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets of text by start, then kind as in RULES; ends are exclusive."""
    if not text:
        return []
    patterns = _compiled()[1]
    taken, out = [0] * len(RULES), []
    for start, k in sorted(_starts(text)):
        if start < taken[k]:
            continue
        m = patterns[k].match(text, start)
        if not m:
            continue
        taken[k] = m.end()
        rule = RULES[k]
        if len(m[m.lastindex or 0]) >= rule.least and (rule.holds is None or rule.holds(m[0])):
            out.append((start, k, m.end()))
    return [(RULES[k].kind, start, end) for start, k, end in out]


def _redacted(text: str | None, spans: list[dict] | None) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s in spans:  # by start; a span within one already shown adds nothing
        if s["end"] > at:
            out.append(text[at : s["start"]] + f"[{s['kind']}]" if s["start"] >= at else "")
            at = s["end"]
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets, an array of (kind, start, end) in code points, by start, then kind as in RULES.

    A null or empty text has none. Every row and column stays as it is, whatever its name; only a
    column named secrets is replaced. Repeated rows are scanned each for itself; no rows give none. One pass without a
    shuffle; a task holds an Arrow batch of texts, and time grows with the length of a text alone.
    """

    @F.arrow_udf(SPANS_DDL)
    def spans(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(("kind", "start", "end"), s)) for s in secret_spans(t.as_py())] for t in texts]
        return pa.array(rows, SPANS)

    return docs.withColumn("secrets", spans(F.col("text").cast("string")))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """find_secrets, each secret in text replaced by its kind in brackets; those that overlap by the kind of the first."""

    @F.arrow_udf("string")
    def shown(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_redacted(t.as_py(), s.as_py()) for t, s in zip(texts, spans)], pa.string())

    return find_secrets(docs).withColumn("text", shown(F.col("text").cast("string"), F.col("secrets")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents: counts and digest of the three base kinds, and all spans."""
    s = Scratch(spark, "secrets")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = s.keep(find_secrets(docs).select("doc_id", "secrets"), "found", arrow_rows=500)
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("secrets", lambda x: x["kind"].isin(*kinds))
    base = ("assign", "access", "hex")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(shown(of(*base)), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"))


def _matches_sql(kind: str, rank: int, pattern: str, holds: str) -> str:
    """(doc_id, kind, rank, s, e) of the matches m of pattern that holds lets pass."""
    return f"""
SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s, s + length(m) AS e FROM (
  SELECT doc_id, t, ms[i] AS m, list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM docs) WHERE len(ms) > 0))
WHERE {holds}"""


_ASSIGN = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
_ASSIGN += """["'']?\\x20*[:=]\\x20*["'']?"""
_FREE = "NOT regexp_matches(substr(t, s::BIGINT, (s > 0)::BIGINT), '[0-9A-Za-z_]') AND NOT regexp_matches(substr(t, (s + length(m) + 1)::BIGINT, 1), '[0-9A-Za-z_]')"
_CRC = f"""xor(list_reduce(list_transform(range(1, 31), lambda i: ord(substr(right(m, 36), i, 1))::BIGINT),
    lambda c, b: list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), 4294967295), 4294967295)"""
_DIGITS = f"list_reduce(list_transform(range(1, 7), lambda i: strpos('{BASE62}', substr(right(m, 6), i, 1)) - 1), lambda c, d: c * 62 + d, 0::BIGINT)"
_GEN = "xor(" * 5 + "xor((c & 33554431) << 5, v)" + "".join(f", CASE WHEN (c >> {25 + i}) & 1 = 1 THEN {g} ELSE 0 END)" for i, g in enumerate(GENERATOR))


def _bech32_sql(prefix: str) -> str:
    head = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    data = f"list_transform(range(1, 59), lambda i: strpos('{BECH32}', lower(substr(right(m, 58), i, 1))) - 1)"
    return f"list_reduce(list_concat({head}::BIGINT[], {data}), lambda c, v: {_GEN}, 1::BIGINT) = 1"


_SQL_RULES = (
    ("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(m, '^{_ASSIGN}', '')) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    ("hex", "[0-9a-f]+", f"length(m) >= {HEX}"),
    ("github", "gh[pousr]_[0-9A-Za-z]{36}", f"{_FREE} AND {_CRC} = {_DIGITS}"),
    ("npm", "npm_[0-9A-Za-z]{36}", f"{_FREE} AND {_CRC} = {_DIGITS}"),
    ("age", f"AGE-SECRET-KEY-1[{BECH32.upper()}]{{58}}", f"{_FREE} AND {_bech32_sql('age-secret-key-')}"),
    ("nostr", f"nsec1[{BECH32}]{{58}}", f"{_FREE} AND {_bech32_sql('nsec')}"),
)
ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_matches_sql(kind, rank, pattern, holds) for rank, (kind, pattern, holds) in enumerate(_SQL_RULES))}),
shown AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN shown USING (doc_id)
"""
