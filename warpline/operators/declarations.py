"""Declared metrics against what runs recorded: resolution, reasons, fallbacks and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions.numeric import r6
from warpline.operators import runs as R

#: Which metrics a task declares, the preferred first; fixed values.
OF_TASK = {
    "classification": ["accuracy", "loss"], "language_modeling": ["perplexity", "loss"], "seq2seq": ["exact_match", "loss"],
    "word2vec": ["hit_at_5", "loss"], "count_based_embedding": ["hit_at_5", "loss"],
}


def declared(conditions: DataFrame) -> DataFrame:
    """(condition, place, metric)"""
    of = F.create_map(*[x for task, names in OF_TASK.items() for x in (F.lit(task), F.array(*map(F.lit, names)))])
    return conditions.select(F.col("canonical_condition_id").alias("condition"), F.posexplode(F.try_element_at(of, F.col("task"))).alias("place", "metric"))


def resolved(conditions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """(condition, metric, available): the first declared metric that a terminal value exists for, else the first declared."""
    there = R.evaluation_history(evaluations).where("axis = 'terminal'").select("condition", "metric").distinct().withColumn("there", F.lit(True))
    rows = declared(conditions).join(there, ["condition", "metric"], "left")
    order = F.struct(F.col("there").isNull().alias("absent"), "place")
    return rows.groupBy("condition").agg(F.min_by(F.struct("metric", F.col("there").isNotNull().alias("available")), order).alias("r")).select("condition", "r.*")


def reasons(conditions: DataFrame, evaluations: DataFrame, split: str = "test", axis: str = "terminal") -> DataFrame:
    """(condition, metric, reason): why a declared metric has no value of this split and axis; empty if it has."""
    got = evaluations.groupBy(F.col("canonical_condition_id").alias("condition"), "metric").agg(
        F.bool_or((F.col("split") == split) & (F.col("axis") == axis)).alias("both"), F.bool_or(F.col("split") == split).alias("split"), F.bool_or(F.col("axis") == axis).alias("axis"),
    )
    reason = F.when(F.col("both").isNull(), "no such metric").when(F.col("both"), "").when(~F.col("split"), "other split").when(~F.col("axis"), "other axis").otherwise("never together")
    return declared(conditions).join(got, ["condition", "metric"], "left").select("condition", "metric", reason.alias("reason"))


def values(evaluations: DataFrame, updates: DataFrame) -> DataFrame:
    """(run_id, value, origin): the terminal loss of a run, else its last loss on any other axis, else its last update's."""
    h = R.evaluation_history(evaluations).where("metric = 'loss'")
    first = h.where("axis = 'terminal'").groupBy("run_id").agg(F.max("value").alias("a"))
    second = h.where("axis <> 'terminal'").groupBy("run_id").agg(F.max_by("value", F.struct("step", "value")).alias("b"))
    third = R.update_history(updates).groupBy("run_id").agg(F.max_by("value", "step").alias("c"))
    rows = third.join(second, "run_id", "full_outer").join(first, "run_id", "full_outer")
    origin = F.when(F.col("a").isNotNull(), "terminal").when(F.col("b").isNotNull(), "curve").otherwise("updates")
    return rows.select("run_id", r6(F.coalesce("a", "b", "c")).alias("value"), origin.alias("origin"))


def loaded(evaluations: DataFrame) -> DataFrame:
    """(run_id, metric, step, value): histories by epoch; a metric with a terminal value only is one point at step 0."""
    h = R.evaluation_history(evaluations)
    history = h.where("axis = 'epoch'").groupBy("run_id", "metric", "step").agg(F.max("value").alias("value"))
    scalars = h.where("axis = 'terminal'").join(history.select("run_id", "metric").distinct(), ["run_id", "metric"], "left_anti")
    return history.unionByName(scalars.select("run_id", "metric", F.lit(0).cast("bigint").alias("step"), "value"))


def cache_state(stored: DataFrame, selected: DataFrame) -> DataFrame:
    """(condition, valid): a stored result of (condition, run_id) holds if the same runs are selected now."""
    ids = lambda df, n: df.where("run_id is not null").groupBy("condition").agg(F.sort_array(F.collect_set("run_id")).alias(n))
    both = ids(stored, "a").join(ids(selected, "b"), "condition", "full_outer")
    return both.select("condition", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("valid"))


def running_statistics(long: DataFrame, batch: int, momentum: float = 0.9) -> DataFrame:
    """(j, mean, variance): running statistics of batch normalisation over batches of rows in order of i, from 0.

    The recurrence is the weighted sum of the batches' statistics, so batches are aggregated first and only they are ordered.
    """
    per = long.groupBy("j", F.floor(F.col("i") / batch).alias("b")).agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    w = Window.partitionBy("j").orderBy(F.col("b").desc())
    weight = (1 - momentum) * F.pow(F.lit(momentum), F.row_number().over(w) - 1)
    return per.withColumn("w", weight).groupBy("j").agg(F.sum(F.col("w") * F.col("m")).alias("mean"), F.sum(F.col("w") * F.col("s")).alias("variance"))
