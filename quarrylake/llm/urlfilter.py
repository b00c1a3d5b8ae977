"""URL filters: pattern rules behind an index of literal tokens.

Every rule is a regular expression over host and path, with the literal tokens that any URL it
fits must contain. A rule stands in the index under the one of its tokens that is rarest among
the URLs at hand. The tokens of a URL fetch candidate rules by a join with the index, and only
those run their expressions. Rules are rows, as many as there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An index of up to so many rules, of some 200 bytes each, is broadcast; a larger one is joined by sorting.
MAX_BROADCAST = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): path rules for a host and its subdomains.
HOST_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words that block a URL, as a whole token of its host or path, where no host rule fits; a starting point for lists of one's own.
BLOCKED_WORDS = (
    "adult", "bestiality", "betting", "bookmaker", "botnet", "camgirl", "camgirls", "casino", "casinos", "cialis", "crackz", "darknet",
    "escort", "escorts", "gambling", "hardcore", "hentai", "jackpot", "keygen", "keylogger", "levitra", "malware", "milf", "nsfw", "nude",
    "nudes", "nulled", "payday", "phishing", "poker", "porn", "porno", "pornstar", "ransomware", "roulette", "serialz", "sex", "sexcam",
    "slots", "spam", "spyware", "torrent", "torrents", "trojan", "tramadol", "viagra", "warez", "webcamsex", "xxx",
)
RULES = "verdict string, host string, path string, word string"


def rule_rows(spark: SparkSession, hosts=HOST_RULES, words=BLOCKED_WORDS) -> DataFrame:
    """Rules as rows of verdict, host, path, word: of a host and its subdomains with a path, or of a word."""
    return spark.createDataFrame([*((v, h, p, None) for v, h, p in hosts), *(("block", None, None, w) for w in words)], RULES)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines with the names of RULES."""
    return spark.read.json(path, schema=RULES)


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, "([^A-Za-z0-9/_])", r"\\$1")


def compiled(rules: DataFrame) -> DataFrame:
    """rules -> code, word, regex, tokens. code orders the host rules that fit a URL: length, length of the host,
    whether it blocks; it tells the rule, as the URL has the rest. Rows with neither host nor word are left out."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    word = F.translate("word", UPPER, LOWER)
    by_host = F.concat(F.lit(r"^(?:[^/]*\.)?"), _quoted(host), F.when(path == "", F.lit("(?:/|$)")).otherwise(_quoted(path)))
    by_word = F.concat(F.lit("(^|[^a-z0-9])"), _quoted(word), F.lit("([^a-z0-9]|$)"))
    # the last token of a path may go on in the URL, so it counts only if something closes it
    literal = F.concat(
        F.regexp_extract_all(host, F.lit("[a-z0-9]+"), F.lit(0)),
        F.regexp_extract_all(F.translate(path, UPPER, LOWER), F.lit("[a-z0-9]+(?=[^a-z0-9])"), F.lit(0)),
    )
    code = F.expr("shiftleft(cast(length(host) + length(coalesce(path, '')) as bigint), 24)") + F.length("host") * 2 + (F.col("verdict") == "block").cast("long")
    return rules.filter("host is not null or word is not null").select(
        F.when(F.col("host").isNotNull(), code).alias("code"), F.when(F.col("host").isNull(), word).alias("word"),
        F.when(F.col("host").isNotNull(), by_host).otherwise(by_word).alias("regex"),
        F.array_distinct(F.when(F.col("host").isNotNull(), literal).otherwise(F.regexp_extract_all(word, F.lit("[a-z0-9]+"), F.lit(0)))).alias("tokens"),
    ).distinct()


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://, empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_BROADCAST else df.hint("merge")


def token_index(subjects: DataFrame, rules: DataFrame) -> DataFrame:
    """compiled rules -> token, code, word, regex: each under the rarest of its tokens among subjects (tokens), the
    first of equals; a rule without a literal token under the empty token, which each subject has."""
    each = rules.select("*", F.explode_outer("tokens").alias("token")).drop("tokens")
    literal = each.filter("token is not null").select("token").distinct()
    seen = subjects.select(F.explode("tokens").alias("token")).join(_small(literal, literal.count()), "token").groupBy("token").count()
    each = each.join(seen.withColumnRenamed("token", "seen_token").hint("merge"), F.col("token") == F.col("seen_token"), "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token")))
    return each.groupBy("code", "word", "regex").agg(rarest.alias("r")).select("r.token", "code", "word", "regex")


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, url: str = "url") -> DataFrame:
    """pages with host, path, rule, pattern and verdict.

    A null url, or one without "://", has an empty host and path. rule is the longest host rule
    that fits (ties: longer host, then one that blocks), else null; pattern the first word rule that
    fits by its word, else null. verdict is the host rule's; where none fits, block if a word rule
    fits, else allow. A host rule without a path fits every path. All rows and columns are kept,
    repeated and null ones too; columns with these five names are replaced. Without rules all is allowed.

    Only pairs of a URL and a rule that has its token leave the explode; fits are gathered by URL
    before they are shuffled, so a URL of very many rows is one group of few rows.
    """
    rules = compiled(rule_rows(pages.sparkSession) if rules is None else rules)
    own = ["host", "path", "rule", "pattern", "verdict"]
    kept = [c for c in pages.columns if c not in own]
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit(""))
    mine = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(address).alias("host"), path_of(address).alias("path"))
    mine = mine.withColumn("subject", F.concat("host", "path"))
    lowered = F.translate("subject", UPPER, LOWER)
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split(lowered, "[^a-z0-9]+")))
    subjects = mine.select("subject", tokens.alias("tokens"))
    index = token_index(subjects, rules)
    pairs = subjects.select("subject", F.explode("tokens").alias("token")).join(_small(index, rules.count()), "token")
    fits = pairs.filter(F.rlike(F.when(F.col("code").isNotNull(), F.col("subject")).otherwise(lowered), F.col("regex")))
    best = fits.groupBy("subject").agg(F.max("code").alias("code"), F.min("word").alias("word")).withColumnRenamed("subject", "fit")
    out = mine.join(best, F.col("subject") == F.col("fit"), "left")
    hosts = F.shiftright(F.col("code").bitwiseAND(F.lit((1 << 24) - 1)), 1).cast("int")
    length = F.shiftright("code", 24).cast("int")
    rule = F.when(F.col("code").isNotNull(), F.concat(F.right("host", hosts), F.left("path", length - hosts)))
    by_host = F.when(F.col("code") % 2 == 1, "block").otherwise("allow")
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in kept], "host", "path", rule.alias("rule"), F.col("word").alias("pattern"),
        F.when(F.col("code").isNotNull(), by_host).when(F.col("word").isNotNull(), "block").otherwise("allow").alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "pattern", "verdict")


_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = "CASE " + " ".join(
    f"WHEN regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN '{w}'"
    for w in sorted(BLOCKED_WORDS)
) + " END"
ORACLE = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rhost, rpath) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in HOST_RULES)}),
judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max(struct_pack(r := rhost || rpath, v := verdict), length(rhost || rpath) * 1000 + length(rhost)) FROM rules
     WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best,
    {_WORD} AS pattern FROM split)
SELECT page_id, host, path, best.r AS rule, pattern, coalesce(best.v, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM judged
"""
