"""Joins that equality does not say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(ranges: DataFrame, points: DataFrame, lo: str, hi: str, at: str, keys: list[str], width: int) -> DataFrame:
    """ranges x points of equal keys with lo <= at < hi, for whole numbers lo, hi, at.

    Both meet in cells of width: a point has one, a range those it touches, so a join on equality finds the
    candidates. width near the usual length of a range keeps these few; nulls and empty ranges meet nothing."""
    r = ranges.filter(F.col(lo) < F.col(hi))
    r = r.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    p = points.withColumn("__cell", F.floor(F.col(at) / width))
    return r.join(p, [*keys, "__cell"]).filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("__cell")
