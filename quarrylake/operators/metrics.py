"""Roll-ups of calls (tool, agent, status, latency_ms, response_bytes)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .tables import Catalog

BOUNDS_MS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0)


def roll_up(calls: DataFrame, by: list[str]) -> DataFrame:
    """Invocations, errors, mean latency, bytes and tokens; tokens count successful calls only."""
    ok = F.col("status") == "success"
    return calls.groupBy(*by).agg(
        F.count("*").alias("invocations"), F.count_if(~ok).alias("errors"), F.avg("latency_ms").alias("avg_ms"),
        F.sum("response_bytes").alias("bytes"),
        F.coalesce(F.sum(F.when(ok, F.col("response_bytes"))), F.lit(0)).cast("double").alias("ok_bytes"),
    ).withColumn("tokens", F.col("ok_bytes") * config.TOKENS_PER_BYTE).drop("ok_bytes")


def bucket_of(latency: Column, bounds: tuple[float, ...] = BOUNDS_MS) -> Column:
    out = F.lit(None).cast("double")
    for b in reversed(bounds):
        out = F.when(latency <= b, b).otherwise(out)
    return out


def p95_by_bucket(calls: DataFrame, by: list[str], bounds: tuple[float, ...] = BOUNDS_MS) -> DataFrame:
    """Upper bound of the first bucket that 95 % of the calls reach; the mean where that is none."""
    n = calls.groupBy(*by, bucket_of(F.col("latency_ms"), bounds).alias("bound")).agg(F.count("*").alias("c"), F.sum("latency_ms").alias("s"))
    whole = Window.partitionBy(*by)
    n = n.withColumns({"total": F.sum("c").over(whole), "mean": F.sum("s").over(whole) / F.sum("c").over(whole), "upto": F.sum("c").over(whole.orderBy(F.col("bound").asc_nulls_last()))})
    hit = F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * 0.95), F.col("bound")))
    return n.groupBy(*by).agg(F.coalesce(hit, F.first("mean")).alias("p95"))


def latency_stats(calls: DataFrame, by: list[str]) -> DataFrame:
    """Exact p50, p95, p99 and maximum."""
    return calls.groupBy(*by).agg(*[F.percentile("latency_ms", q).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.max("latency_ms").alias("max_ms"))


def record(totals: DataFrame, calls: DataFrame, by: list[str]) -> DataFrame:
    """totals (by, invocations, errors, bytes, tokens) with a batch of calls added to them."""
    new = roll_up(calls, by).select(*by, "invocations", "errors", "bytes", "tokens")
    both = totals.select(*new.columns).unionByName(new)
    return both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("invocations", "errors", "bytes", "tokens")])


#: Relative error of what a sketch tells; it fixes the buckets, so only sketches of one error can be merged.
ERROR = 0.01
SKETCH = ("bucket", "n")


def sketch(calls: DataFrame, by: list[str], value: str = "latency_ms", error: float = ERROR) -> DataFrame:
    """by, bucket, n: how many values fall to each bucket of a quantile sketch, that is, between two powers of (1 + error) / (1 - error).

    The buckets of a key are some thousand at most, whatever there is, as doubles span so many powers. Negative values have buckets of their
    own, mirrored; bucket is null for zero, and nulls and NaN count nowhere."""
    x = F.col(value).cast("double")
    step = math.log((1 + error) / (1 - error))
    # odd numbers for positive values, even ones for negative: one whole number stands for both
    power = F.ceil(F.log(F.abs(x)) / step).cast("long")
    bucket = F.when(x > 0, power * 2 + 1).when(x < 0, power * 2)
    return calls.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged_sketch(one: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of what both sketches tell of, the same as if it had been made at once."""
    return one.unionByName(other).groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketched: DataFrame, by: list[str], quantiles: dict[str, float], error: float = ERROR) -> DataFrame:
    """by and a column for each of quantiles: a value within error, relatively, of the one of rank ceil(q * n), the first at least."""
    odd = F.pmod(F.col("bucket"), F.lit(2)) == 1
    power = (F.col("bucket") - odd.cast("long")) / 2
    size = F.exp(power * math.log((1 + error) / (1 - error))) * (1 - error)
    s = sketched.withColumn("at", F.when(F.col("bucket").isNull(), 0.0).when(odd, size).otherwise(-size))
    whole = Window.partitionBy(*by)
    s = s.withColumns({"upto": F.sum("n").over(whole.orderBy("at")), "total": F.sum("n").over(whole)})
    reached = lambda q: F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("total") * q))
    return s.groupBy(*by).agg(*[F.min(F.when(reached(q), F.col("at"))).alias(name) for name, q in quantiles.items()])


def record_latency(catalog: Catalog, calls: DataFrame, by: list[str], sink: str, batch: int, name: str = "latency") -> bool:
    """Merge the sketch of a batch of calls into the stored one, once for each number of a batch; False if it was there already."""
    if batch <= catalog.applied(sink):
        return False
    new = sketch(calls, by)
    old = catalog.read(name) if name in catalog.versions() else None
    return catalog.commit({name: new if old is None else merged_sketch(old, new, by)}, sink, batch)


def exposition(metrics: DataFrame, name: str, kind: str, labels: list[str], value: str) -> DataFrame:
    """line: a family of metrics as text, its type first, then a line for each row, by labels."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), r'(["\\\\])', r"\\$1"), F.lit('"')) for c in labels])
    line = F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string"))
    head = metrics.sparkSession.createDataFrame([(0, f"# TYPE {name} {kind}")], "o int, line string")
    return head.unionByName(metrics.select(F.lit(1).alias("o"), line.alias("line"))).orderBy("o", "line").select("line")


def ingest_totals(report: DataFrame) -> DataFrame:
    """One row over a report of sessions: sessions, found, stored, failed."""
    failed = F.count_if(F.col("error").isNotNull()) if "error" in report.columns else F.lit(0).cast("long")
    return report.agg(F.count("*").alias("sessions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "stored")], failed.alias("failed"))
