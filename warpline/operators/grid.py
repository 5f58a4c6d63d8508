"""Irregular readings put onto the regular grid of their series, with missing slots filled.

A slot is ``[k*every, (k+1)*every)``. The usable readings of one slot are averaged. Every series gets
a regression with a linear trend and ``HARMONICS`` harmonics of a season of ``PERIOD`` slots: the sums
of its normal equations are plain aggregates over blocks of ``BLOCK`` slots that add up to those of the
series, so no task ever holds a whole series. A missing slot gets the regression's value plus the
residual interpolated between the observed slots at both ends of its gap, so filled stretches meet the
readings.

The trend is measured from the series' first block and centred, so large slot numbers lose no digits. All coefficients
but the constant have a prior at zero for series of any length, which weighs ``(PARAMETERS / slots) ** FADE`` of the
readings: much for fewer slots than coefficients, where nearly the straight line between the gap's ends is left, and
next to nothing for many.

Defined results: null, NaN and infinite readings and readings without a step or a positive ``every``
don't count, nor do those of runs that the run table lacks (their grid is unknown); a series with fewer than two slots has
no gap; repeated rows change nothing but the mean of their slot; slots outside the first and last usable reading
aren't produced; a null key part is a key like any other; a condition that stands twice counts with the largest of its steps.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions.keys import bare_id, usable
from warpline.session import if_small, settled

PERIOD, HARMONICS, BLOCK, FADE, SLOTS_AT_ONCE = 12, 2, 4096, 6, 4096
PARAMETERS = 2 + 2 * HARMONICS
KEY = ["source", "run_id", "series", "every"]
_PAIRS = [(i, j) for i in range(PARAMETERS) for j in range(i, PARAMETERS)]


def _season(slot: Column, period: int) -> list[Column]:
    phase = [slot % period * (2 * math.pi * h / period) for h in range(1, HARMONICS + 1)]
    return [f(p) for p in phase for f in (F.cos, F.sin)]


def _terms(slot: Column, block: Column, period: int) -> list[Column]:
    """The regressors of a slot: the trend in blocks since the given block."""
    return [F.lit(1.0), (slot - block * BLOCK) / F.lit(float(BLOCK)), *_season(slot, period)]


def slots(readings: DataFrame) -> DataFrame:
    """(KEY, block, slot, value) from (KEY, step, value), laid out by series and block of slots."""
    at = F.floor(F.col("step") / F.col("every")).cast("bigint")
    kept = readings.where(usable(F.col("value")) & F.col("step").isNotNull() & (F.col("every") > 0)).withColumn("slot", at).withColumn("block", F.floor(F.col("slot") / BLOCK)).drop("step")
    return kept.repartition("run_id", "series", "block").groupBy(*KEY, "block", "slot").agg(F.avg("value").alias("value"))


def _solved(sums: pd.Series) -> pd.Series:
    table = np.array(sums.tolist(), dtype=float).reshape(len(sums), -1)
    n = len(_PAIRS)
    a = np.zeros((len(table), PARAMETERS, PARAMETERS))
    for k, (i, j) in enumerate(_PAIRS):
        a[:, i, j] = a[:, j, i] = table[:, k]
    b = table[:, n:]
    # every regressor but the constant is centred and brought to one scale
    mean = a[:, 0, :] / np.maximum(1, a[:, :1, 0])
    mean[:, 0] = 0
    c = a - a[:, :1, :] * mean[:, :, None]
    c[:, 0, 1:] = c[:, 1:, 0] = 0
    d = b - mean * b[:, :1]
    scale = np.ones_like(mean)
    scale[:, 1:] = np.sqrt(np.maximum(np.einsum("kii->ki", c)[:, 1:] / np.maximum(1, a[:, :1, 0]), 1e-24))
    c /= scale[:, :, None] * scale[:, None, :]
    slots_of = np.maximum(1, a[:, 0, 0])
    prior = slots_of * (PARAMETERS / slots_of) ** FADE + 1e-9
    c += prior[:, None, None] * np.diag([0.0] + [1.0] * (PARAMETERS - 1))
    c[:, 0, 0] = slots_of
    x = np.linalg.solve(c, (d / scale)[:, :, None])[:, :, 0] / scale if len(table) else b
    x[:, 0] -= (mean * x).sum(axis=1)
    return pd.Series(list(x))


def fitted(blocks: DataFrame) -> DataFrame:
    """(KEY, origin, coefficients) from the sums of the blocks, which are moved to the series' first block, the origin, as they add up."""
    solve = F.pandas_udf(_solved, "array<double>")
    first = F.min("block").over(Window.partitionBy(*KEY))
    moved = blocks.withColumn("origin", first).withColumn("d", (F.col("block") - F.col("origin")).cast("double"))
    at = {p: F.col("sums")[k] for k, p in enumerate(_PAIRS)}
    right = [F.col("sums")[len(_PAIRS) + k] for k in range(PARAMETERS)]
    d = F.col("d")

    def shifted(i: int, j: int) -> Column:
        if 1 not in (i, j):
            return at[i, j]
        if i == j == 1:
            return at[1, 1] + 2 * d * at[0, 1] + d * d * at[0, 0]
        other = j if i == 1 else i
        return at[i, j] + d * at[0, other]

    parts = [shifted(i, j) for i, j in _PAIRS] + [r + d * right[0] if k == 1 else r for k, r in enumerate(right)]
    total = moved.groupBy(*KEY).agg(F.min("origin").alias("origin"), *[F.sum(p).alias(f"s{k}") for k, p in enumerate(parts)])
    return total.select(*KEY, "origin", solve(F.array(*[f"s{k}" for k in range(len(parts))])).alias("coefficients"))


def _of_blocks(cells: DataFrame, period: int) -> DataFrame:
    x = _terms(F.col("slot"), F.col("block"), period)
    sums = [F.sum(x[i] * x[j]) for i, j in _PAIRS] + [F.sum(x[i] * F.col("value")) for i in range(PARAMETERS)]
    end = F.struct("slot", "value")
    return cells.groupBy(*KEY, "block").agg(F.array(*sums).alias("sums"), F.min(end).alias("first"), F.max(end).alias("last"))


def gaps(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """(KEY, left, right): the observed slots on both sides of every gap, within blocks and between them."""
    end = F.struct("slot", "value")
    wide = F.col("right.slot") > F.col("left.slot") + 1
    within = Window.partitionBy(*KEY, "block").orderBy("slot")
    between = Window.partitionBy(*KEY).orderBy("block")
    inner = cells.select(*KEY, end.alias("left"), F.lead(end).over(within).alias("right"))
    outer = blocks.select(*KEY, F.col("last").alias("left"), F.lead("first").over(between).alias("right"))
    return inner.where(wide).unionByName(outer.where(wide))


def filled(readings: DataFrame, period: int = PERIOD) -> DataFrame:
    """(KEY, slot, slot_start, value) of the missing slots of every series, with a season of ``period`` slots."""
    cells = slots(readings)
    blocks = _of_blocks(cells, period)
    keys = [F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}")) for k in KEY]
    both = gaps(cells, blocks).alias("g").join(fitted(blocks).alias("f"), keys).select("g.*", "f.origin", "f.coefficients")
    model = lambda s: sum((F.col("coefficients")[i] * t for i, t in enumerate(_terms(s, F.col("origin"), period))), F.lit(0.0))
    l, r = F.col("left.slot"), F.col("right.slot")
    both = both.withColumns({"rl": F.col("left.value") - model(l), "rr": F.col("right.value") - model(r)})
    # a gap is opened piece by piece, so that no row holds a long one whole
    pieces = both.withColumn("start", F.explode(F.sequence(l + 1, r - 1, F.lit(SLOTS_AT_ONCE).cast("bigint"))))
    open_slots = pieces.withColumn("slot", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + (SLOTS_AT_ONCE - 1), r - 1))))
    slot = F.col("slot")
    value = model(slot) + F.col("rl") + (F.col("rr") - F.col("rl")) * (slot - l) / (r - l)
    return open_slots.select(*KEY, "slot", (slot * F.col("every")).alias("slot_start"), value.alias("value"))


def regular(readings: DataFrame, period: int = PERIOD) -> DataFrame:
    """(KEY, slot_start, value, filled): one row per slot between the first and the last usable reading."""
    seen = slots(readings).select(*KEY, (F.col("slot") * F.col("every")).alias("slot_start"), "value", F.lit(False).alias("filled"))
    return seen.unionByName(filled(readings, period).select(*KEY, "slot_start", "value", F.lit(True).alias("filled")))


def run_store_readings(runs: DataFrame, conditions: DataFrame, metrics: DataFrame, evaluations: DataFrame, curves: DataFrame) -> DataFrame:
    """The step-indexed histories of the run store as (KEY, step, value)."""
    every_of = conditions.groupBy("canonical_condition_id").agg(F.max("recording_every").alias("recording_every"), F.max("eval_every").alias("eval_every"))
    own = F.expr("try_cast(trim(params['recording/every']) as double)").cast("bigint")
    step_of_run = (
        runs.select(bare_id("run_id").alias("key"), "canonical_condition_id", own.alias("own"))
        .groupBy("key").agg(F.max("own").alias("own"), F.max("canonical_condition_id").alias("canonical_condition_id"))
        .join(every_of, "canonical_condition_id", "left").select("key", F.coalesce("own", "recording_every").alias("every"))
    )
    # one narrow row a run: sent along while it is small, so that the readings aren't shuffled for it
    step_of_run = if_small(settled(step_of_run))
    m = (
        metrics.where(usable(F.col("value")) & F.col("step").isNotNull()).select("run_id", "metric_key", F.col("step").cast("double").alias("step"), "value", bare_id("run_id").alias("key"))
        .join(step_of_run, "key").select(F.lit("metrics").alias("source"), "run_id", F.col("metric_key").alias("series"), "every", "step", "value")
    )
    e = (
        evaluations.where(F.col("axis").isin("epoch", "update") & usable(F.col("value")))
        .select("run_id", "axis", "canonical_condition_id", F.concat_ws("/", "axis", "split", "metric").alias("series"), F.col("axis_step").cast("double").alias("step"), "value")
        .join(every_of, "canonical_condition_id", "left")
        .select(F.lit("evaluations").alias("source"), "run_id", "series", F.when(F.col("axis") == "epoch", F.lit(1).cast("bigint")).otherwise(F.col("eval_every")).alias("every"), "step", "value")
    )
    c = curves.select(F.lit("curves").alias("source"), F.col("curve_id").cast("string").alias("run_id"), F.col("axis").alias("series"), "every", F.explode(F.arrays_zip(F.col("steps").alias("s"), F.col("mean").alias("m"))).alias("p"))
    c = c.select("source", "run_id", "series", "every", F.col("p.s").alias("step"), F.col("p.m").alias("value"))
    return m.unionByName(e).unionByName(c)


def found(readings: DataFrame) -> DataFrame:
    return filled(readings).where(F.col("value").isNotNull()).select("source", "run_id", "series", "slot_start")
