"""Joins of points and ranges, and gaps between ranges.

A range is listed under every bin of ``width`` that it touches, a point under its own; the join is then an
equi-join on key and bin with the bounds as a rest, so a key with many ranges spreads over its bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binned_range_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, first: str, last: str, width: int) -> DataFrame:
    """Inner join of points with the closed ranges of their key that hold them; each pair once."""
    bin_of = lambda c: F.floor(F.col(c) / width)
    r = ranges.where(F.col(first) <= F.col(last)).withColumn("_bin", F.explode(F.sequence(bin_of(first), bin_of(last))))
    return points.withColumn("_bin", bin_of(at)).join(r, [*keys, "_bin"]).where(F.col(at).between(F.col(first), F.col(last))).drop("_bin")


def with_a_point(ranges: DataFrame, points: DataFrame, keys: Sequence[str], at: str, first: str, last: str, width: int) -> DataFrame:
    """The ranges that hold at least one point."""
    hit = binned_range_join(points.select(*keys, at).distinct(), ranges.select(*keys, first, last).distinct(), keys, at, first, last, width)
    return ranges.join(hit.select(*keys, first, last).distinct(), [*keys, first, last], "left_semi").select(*ranges.columns)


def idle_gaps(ranges: DataFrame, stream: str, start: str, end: str, tie: str) -> DataFrame:
    """(stream, idle): the time between the end of a range and the start of the next, where that is positive."""
    w = Window.partitionBy(stream).orderBy(start, end, tie)
    gap = F.greatest(F.lit(0), F.col(start) - F.lag(end).over(w))
    return ranges.withColumn("gap", gap).groupBy(stream).agg(F.coalesce(F.sum("gap"), F.lit(0)).alias("idle"))
