"""Percentiles of very large columns from counts in signed logarithmic buckets.

A value x falls in the bucket ``sign(x), ceil(ln|x| / ln g)`` with ``g = (1 + a) / (1 - a)``; a bucket's
representative ``2 g^k / (1 + g)`` is within the relative error ``a`` of every value in it, and zero has a
bucket of its own. Buckets are counted with map-side combine, so what is shuffled is bounded by the number
of groups times buckets whatever the number of rows, and a hot group is no burden. A sketch is the table of
(group, sign, bucket, rows): two sketches are combined by adding the rows of equal buckets, in any order.
The percentile q of n values is the value at rank ``floor(q * (n - 1))`` of the ascending values, exactly
located among the buckets and returned with the relative error a.

Defined results: null, NaN and infinite values aren't counted; a group without a finite value has no row;
a null group is a group; ties fall in one bucket; subnormal values count as zero. Rows count as often as they are
delivered: a sketch can't tell copies apart, and sketches of separate days only add up if none of them tries to.
Where copies must count once, they are dropped before (``without_copies``), at the price of a shuffle of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions.keys import usable

ERROR = 0.005
PERCENTS = (1.0, 25.0, 50.0, 75.0, 95.0, 99.0)
_LEAST = 2.3e-308


def _base(error: float) -> float:
    return math.log((1 + error) / (1 - error))


def bucket(value: Column, error: float = ERROR) -> Column:
    return F.when(F.abs(value) < _LEAST, F.lit(0)).otherwise(F.ceil(F.ln(F.abs(value)) / F.lit(_base(error))).cast("int"))


def sign(value: Column) -> Column:
    return F.when(F.abs(value) < _LEAST, F.lit(0)).otherwise(F.signum(value).cast("int"))


def sketch(rows: DataFrame, groups: Sequence[str], value: str, error: float = ERROR) -> DataFrame:
    """(groups, sign, bucket, rows)"""
    v = F.col(value).cast("double")
    return rows.where(usable(v)).groupBy(*groups, sign(v).alias("sign"), bucket(v, error).alias("bucket")).agg(F.count("*").alias("rows"))


def combined(sketches: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """One sketch from those of separate files or days."""
    one = sketches[0]
    for s in sketches[1:]:
        one = one.unionByName(s)
    return one.groupBy(*groups, "sign", "bucket").agg(F.sum("rows").alias("rows"))


def percentiles(sketched: DataFrame, groups: Sequence[str], percents: Sequence[float] = PERCENTS, error: float = ERROR) -> DataFrame:
    """(groups, rows, relative_error, p1, p25, ...), named after the percents.

    A group's buckets are at most a few hundred thousand whatever its rows, so a window over them is bounded.
    """
    half = F.lit(2.0 / (1.0 + math.exp(_base(error))))
    size = half * F.exp(F.col("bucket") * F.lit(_base(error)))
    value = F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * size)
    order = F.col("sign") * F.lit(1 << 40) + F.col("sign") * F.col("bucket")
    w = Window.partitionBy(*groups)
    up = w.orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketched.withColumns({"order": order, "value": value}).withColumns({"upto": F.sum("rows").over(up), "n": F.sum("rows").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p / 100.0) * (F.col("n") - 1)), F.struct("order", "value")))["value"]
    name = lambda p: f"p{p:g}".replace(".", "_")
    return ranked.groupBy(*groups).agg(F.max("n").alias("rows"), F.lit(error).alias("relative_error"), *[at(p).alias(name(p)) for p in percents])


def without_copies(rows: DataFrame, columns: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    """The rows without exact copies, told apart by 128 bits over the columns, so that narrow rows are shuffled."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return rows.select(F.xxhash64(*cells).alias("_h1"), F.xxhash64(F.lit(1), *cells).alias("_h2"), *keep).dropDuplicates(["_h1", "_h2"]).drop("_h1", "_h2")


_GROUP = ["source_table", "canonical_condition_id", "metric"]


def run_store_sketch(runtime_estimates: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One sketch of runtime_estimates.seconds_per_update and of evaluations.value per metric, over all finite values."""
    of = lambda t, rows, metric, v: sketch(rows.select(F.lit(t).alias("source_table"), "canonical_condition_id", metric.alias("metric"), F.col(v).alias("value")), _GROUP, "value")
    return of("runtime_estimates", runtime_estimates, F.lit("seconds_per_update"), "seconds_per_update").unionByName(of("evaluations", evaluations, F.col("metric"), "value"))


def run_store_percentiles(runtime_estimates: DataFrame, evaluations: DataFrame) -> DataFrame:
    return percentiles(run_store_sketch(runtime_estimates, evaluations), _GROUP)
