"""Counts, summaries and point lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import severity_rank


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with that key; raise_missing tells an empty result from an error."""
    return df.filter(F.col(column) == value)


def raise_missing(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise KeyError(f"{what} not found")
    return df


def under(df: DataFrame, column: str, folder: str) -> DataFrame:
    """Rows whose path lies under folder."""
    return df.filter(F.startswith(F.col(column), F.lit(folder.rstrip("/") + "/")))


def tag_histogram(df: DataFrame, column: str = "tags") -> DataFrame:
    return df.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def agent_summary(df: DataFrame, agent: str, at: str) -> DataFrame:
    return df.groupBy(agent).agg(F.count("*").alias("n"), F.max(at).alias("last")).orderBy(F.desc("last"), agent)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, t in tables.items()]
    return reduce(DataFrame.unionByName, rows).groupBy().pivot("k", list(tables)).agg(F.first("n"))


def by_priority(df: DataFrame, limit: int, newest: str = "created_at", key: str = "id") -> DataFrame:
    """Critical, warning, info, each newest first."""
    return df.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc(newest), key).limit(limit)


def needs_index(listing: DataFrame, ledger: DataFrame, key: str = "path") -> DataFrame:
    """Listed files that the ledger lacks or knows with another time or size."""
    old = ledger.select(key, F.col("mtime").alias("__m"), F.col("size").alias("__s"))
    j = listing.join(old, key, "left")
    return j.filter(~(F.col("mtime").eqNullSafe(F.col("__m")) & F.col("size").eqNullSafe(F.col("__s")))).drop("__m", "__s")


def missing_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.filter(F.col(column).isNull())


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values that are not null, each once, in order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def greatest_or(df: DataFrame, column: str, default=0) -> DataFrame:
    """One row: the greatest value, default without any."""
    return df.agg(F.coalesce(F.max(column), F.lit(default)).alias("value"))


def exists(df: DataFrame) -> DataFrame:
    """One row: whether there is a row. Reads one."""
    return df.limit(1).agg((F.count("*") > 0).alias("found"))


def with_counts(df: DataFrame, other: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Each row of df with the number of rows of other that have its key, 0 for none: one aggregate and one join for all rows."""
    n = other.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    return df.join(n, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__key", "__n")


def exact_or_like(df: DataFrame, column: str, terms: list[str], text: str, limit: int = 10) -> DataFrame:
    """Rows whose column is one of terms; only if there is none, those that hold the whole text, limit of them."""
    hits = df.filter(F.col(column).isin(terms))
    like = df.filter(F.contains(F.lower(column), F.lit(text.lower()))).orderBy(column).limit(limit)
    none = hits.limit(1).agg((F.count("*") == 0).alias("__none"))
    return hits.unionByName(like.join(F.broadcast(none), F.col("__none")).drop("__none"))  # one row is broadcast


def indexed_with_hash(ledger: DataFrame, listing: DataFrame) -> DataFrame:
    """listing (path, hash) with indexed: whether the ledger holds the path with that hash."""
    known = ledger.select("path", "hash", F.lit(True).alias("__known")).distinct()
    return listing.join(known, ["path", "hash"], "left").withColumn("indexed", F.coalesce("__known", F.lit(False))).drop("__known")


def in_progress(state: Column) -> Column:
    return F.coalesce(F.lower(state) == "in_progress", F.lit(False))


def options(limit: int | None = None, min_score: float | None = None) -> tuple[int, float]:
    """(limit, min_score) of a search: 10 and 0 if not given, the score within 0 and 1."""
    return (config.DEFAULT_LIMIT if limit is None else limit), min(1.0, max(0.0, min_score or 0.0))


def dashboard(tables: dict[str, DataFrame], version: str, started: int, now: int, size: int) -> DataFrame:
    """One row: counts of the tables, version, seconds of uptime, bytes."""
    return counts(tables).withColumns({"version": F.lit(version), "uptime": F.lit(now - started), "bytes": F.lit(size)})


def by_severities(df: DataFrame, severities: list[str], order: list, limit: int) -> DataFrame:
    """Rows of the severities, one severity after the other, limit in all."""
    place = F.array_position(F.array(*[F.lit(s) for s in severities]), F.col("severity"))
    return df.filter(F.col("severity").isin(severities)).orderBy(place, *order).limit(limit)


def latest_of_recent(df: DataFrame, key: str, at: str, id: str, n: int) -> DataFrame:
    """The latest row of each of the n keys that were seen last, in the order of the key."""
    best = df.groupBy(key).agg(F.max_by(id, F.struct(at, id)).alias(id), F.max(at).alias(at))
    return best.orderBy(F.desc(at), key).limit(n).orderBy(key)
