"""Run analytics: selection of attempts, histories, curves over seeds, summaries, comparisons and status.

Histories are (run_id, step, value); of several values of a step the last received counts (the larger on a
tie). Values that aren't finite are no values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions.keys import bare_id
from warpline.functions.numeric import deviation, divided, finite, half_up, r6
from warpline.operators.losses import ENDLESS
from warpline.session import settled

#: Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom; fixed values.
T_95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
STATUSES = ("completed", "running", "failed", "missing")


def attempts(runs: DataFrame) -> DataFrame:
    """One row per run: its coordinates out of columns, tags and params, each with its default."""
    tag = lambda k: F.col("tags")[k]
    rows = runs.select(
        "run_id", "experiment", "variant", "status", "start_time", "end_time", F.coalesce("lifecycle_stage", F.lit("active")).alias("lifecycle"),
        F.coalesce("canonical_condition_id", "native_condition_id").alias("condition"), F.col("canonical_condition_id").isNotNull().alias("canonical"),
        F.coalesce("seed", F.col("params")["seed/master"], F.lit("single")).alias("seed"), F.coalesce(tag("run.type"), F.lit("seed_trial")).alias("run_type"),
        F.coalesce(tag("protocol.version"), F.lit("legacy")).alias("protocol"), F.coalesce(tag("trial.attempt").try_cast("int"), F.lit(1)).alias("attempt"), bare_id(tag("mlflow.parentRunId")).alias("parent"),
    )
    return rows.dropDuplicates(["run_id"])


def newest(rows: DataFrame, keys: Sequence[str], time: str = "start_time", name: str = "run_id") -> DataFrame:
    """The newest row per key, the smallest name on a tie; nulls are oldest. An aggregation, so hot keys are combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    order = F.struct(F.col(time).isNotNull().alias("has"), F.col(time).alias("t"))
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(order, _descending(F.col(name)))).alias("r"))
    return picked.select(*keys, "r.*")


def _descending(c: Column) -> Column:
    """An order in which smaller strings are larger, by the complement of every character."""
    return F.translate(F.lower(c), "0123456789abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba9876543210")


def completed(runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """(condition, seed, run_id): the newest finished seed trial per condition and seed; wanted conditions without one stay, with nulls."""
    done = attempts(runs).where("status = 'FINISHED' AND lifecycle = 'active' AND run_type = 'seed_trial'")
    picked = newest(done, ["condition", "seed"])
    return conditions.select(F.col("canonical_condition_id").alias("condition")).join(picked.select("condition", "seed", "run_id"), "condition", "left")


def chosen(runs: DataFrame) -> DataFrame:
    """(condition, variant, seed, run_id, rank): the attempt of least rank, the newest on a tie: canonical and active, native and active, any other."""
    rank = F.when(F.col("canonical") & (F.col("lifecycle") == "active"), 0).when(F.col("lifecycle") == "active", 1).otherwise(2)
    rows = attempts(runs).where("run_type = 'seed_trial'").withColumn("rank", rank)
    order = F.struct(-F.col("rank"), F.col("start_time"), _descending(F.col("run_id")))
    return rows.groupBy("condition", "variant", "seed").agg(F.max_by(F.struct("run_id", "rank"), order).alias("r")).select("condition", "variant", "seed", "r.run_id", "r.rank")


def status_precedence(runs: DataFrame) -> DataFrame:
    """(condition, seed, status, run_id): running before finished before failed before others, then the newest."""
    place = F.when(F.col("status") == "RUNNING", 0).when(F.col("status") == "FINISHED", 1).when(F.col("status") == "FAILED", 2).otherwise(3)
    rows = attempts(runs).where("run_type = 'seed_trial'")
    order = F.struct(-place, F.col("start_time"), _descending(F.col("run_id")))
    return rows.groupBy("condition", "seed").agg(F.max_by(F.struct("status", "run_id"), order).alias("r")).select("condition", "seed", "r.status", "r.run_id")


def seeds_of_conditions(runs: DataFrame) -> DataFrame:
    """(condition, seeds): over both variants; numbers first, in their order."""
    rows = attempts(runs).where("run_type = 'seed_trial'").select("condition", "seed").distinct()
    key = F.struct((~F.col("seed").rlike("^[0-9]+$")).alias("text"), F.lpad("seed", 20, "0").alias("padded"), "seed")
    return rows.groupBy("condition").agg(F.transform(F.array_sort(F.collect_list(key)), lambda r: r["seed"]).alias("seeds"))


def plan_status(runs: DataFrame, conditions: DataFrame, seeds: int = 10) -> DataFrame:
    """(condition, variant, seed, status, attempts): the planned grid against the attempts.

    The grid is conditions x variants x seeds by construction, a dimension of fixed size.
    """
    variants, numbers = F.array(F.lit("implemented"), F.lit("original")), F.sequence(F.lit(1), F.lit(seeds))
    grid = conditions.select(F.col("canonical_condition_id").alias("condition"), F.explode(variants).alias("variant"), numbers.alias("n")).select("condition", "variant", F.explode(F.transform("n", lambda k: k.cast("string"))).alias("seed"))
    state = F.when(F.col("status") == "RUNNING", 0).when(F.col("status") == "FINISHED", 1).otherwise(2)
    rows = attempts(runs).where("run_type = 'seed_trial' AND canonical AND lifecycle = 'active'").groupBy("condition", "variant", "seed").agg(F.min(state).alias("state"), F.count("*").alias("attempts"))
    status = F.when(F.col("state") == 0, "running").when(F.col("state") == 1, "completed").when(F.col("state") == 2, "failed").otherwise("missing")
    return grid.join(rows, ["condition", "variant", "seed"], "left").select("condition", "variant", "seed", status.alias("status"), F.coalesce("attempts", F.lit(0)).cast("bigint").alias("attempts"))


def status_counts(plan: DataFrame) -> DataFrame:
    """(variant, completed, running, failed, missing): every status stands, at 0 if need be."""
    return plan.groupBy("variant").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


#: Protocols whose runs may stand for each other, in either order; fixed values.
EQUIVALENT = (("2024.1", "2024.2"), ("2024.2", "2025.1"))


def compatible(a: Column, b: Column) -> Column:
    pairs = [F.array_sort(F.array(F.lit(x), F.lit(y))) for x, y in EQUIVALENT]
    both = F.array_sort(F.array(a, b))
    return (a == b) | F.coalesce(F.array_contains(F.array(*pairs), both), F.lit(False))


def protocol_pairs(runs: DataFrame) -> DataFrame:
    """(condition, implemented, original, compatible): how the protocols of both variants of a condition go together."""
    rows = attempts(runs).where("run_type = 'seed_trial'").select("condition", "variant", "protocol").distinct()
    of = lambda v: rows.where(F.col("variant") == v).select("condition", F.col("protocol").alias(v))
    both = of("implemented").join(of("original"), "condition")
    return both.withColumn("compatible", compatible(F.col("implemented"), F.col("original")))


def roots(runs: DataFrame) -> DataFrame:
    """(run_id, root, depth): the outermost known ancestor, by doubling the pointers until none changes.

    Runs in or below a cycle have no outermost one: there the pointers never rest, so that a depth of the number of runs or
    more tells them; their root and depth are null. Each round is written to the shared folder.
    """
    at = attempts(runs).select(bare_id("run_id").alias("id"), "parent")
    up = settled(at.alias("c").join(at.select(F.col("id").alias("known")), F.col("c.parent") == F.col("known"), "left").select("id", F.coalesce("known", "id").alias("up"), F.col("known").isNotNull().cast("bigint").alias("depth")))
    reach, n = 1, up.count()
    while reach < n:
        nxt = up.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        rows = settled(up.join(nxt, "up").select("id", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("depth2") > 0).alias("moved")))
        reach, up = 2 * reach, rows.drop("moved")
        if rows.where("moved").isEmpty():
            break
    ends = F.col("depth") < n
    return up.select(F.col("id").alias("run_id"), F.when(ends, F.col("up")).alias("root"), F.when(ends, F.col("depth").cast("int")).alias("depth"))


def relinks(runs: DataFrame) -> DataFrame:
    """(run_id, action, new_parent): trials whose parent isn't there, against the active parents of their condition and variant."""
    rows = attempts(runs)
    parents = rows.where("run_type = 'condition_parent' AND lifecycle = 'active'").groupBy("condition", "variant").agg(F.count("*").alias("n"), F.min("run_id").alias("candidate"))
    known = rows.select(bare_id("run_id").alias("parent"))
    orphans = rows.where("run_type = 'seed_trial' AND parent IS NOT NULL AND parent <> ''").join(known, "parent", "left_anti")
    n = F.coalesce("n", F.lit(0))
    action = F.when(n == 1, "relink").when(n == 0, "unresolved").otherwise("ambiguous")
    return orphans.join(parents, ["condition", "variant"], "left").select("run_id", action.alias("action"), F.when(n == 1, F.col("candidate")).alias("new_parent"))


def last_values(rows: DataFrame, keys: Sequence[str], value: str, received: str = "received_at") -> DataFrame:
    """One finite value per key, the last received."""
    v = F.col(value)
    return rows.where(finite(v)).groupBy(*keys).agg(F.max(F.struct(F.col(received), v.alias("v")))["v"].alias("value"))


def update_history(updates: DataFrame, value: str = "loss") -> DataFrame:
    return last_values(updates, ["run_id", "update_no"], value).select("run_id", F.col("update_no").alias("step"), "value")


def evaluation_history(evaluations: DataFrame) -> DataFrame:
    """(run_id, condition, axis, split, metric, step, value); the terminal axis is pinned to 0."""
    step = F.when(F.col("axis") == "terminal", F.lit(0)).otherwise(F.col("axis_step")).cast("bigint")
    rows = evaluations.withColumn("step", step).withColumnRenamed("canonical_condition_id", "condition")
    return last_values(rows, ["run_id", "condition", "axis", "split", "metric", "step"], "value")


def long_events(updates: DataFrame) -> DataFrame:
    """(run_id, step, metric, value): the wide rows as long ones; nulls are left out."""
    names = ("loss", "book_loss", "lr")
    long = updates.dropDuplicates().unpivot(["run_id", "update_no"], list(names), "metric", "value").where("value is not null")
    return long.select("run_id", F.col("update_no").alias("step"), "metric", "value")


def metric_arrays(metrics: DataFrame) -> DataFrame:
    """(run_id, metric_key, steps, readings): each history in order of step and time."""
    rows = metrics.where(finite("value")).select("run_id", "metric_key", "step", "logged_ms").dropDuplicates()
    order = F.array_sort(F.collect_list(F.struct("step", "logged_ms")))
    return rows.groupBy("run_id", "metric_key").agg(order.alias("o")).select("run_id", "metric_key", F.transform("o", lambda r: r["step"]).alias("steps"), F.size("o").cast("bigint").alias("readings"))


def curve(history: DataFrame, series: Sequence[str]) -> DataFrame:
    """(series, step, mean, minimum, maximum, sd, run_count) on the steps that all runs of the series have."""
    runs_of = history.groupBy(*series).agg(F.count_distinct("run_id").alias("all_runs"))
    points = history.groupBy(*series, "step").agg(F.avg("value").alias("mean"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), deviation("value").alias("sd"), F.count("*").alias("run_count"))
    rows = points.join(runs_of, list(series)).where("run_count = all_runs")
    return rows.select(*series, "step", *[r6(F.col(c)).alias(c) for c in ("mean", "minimum", "maximum", "sd")], "run_count")


def statistics(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    sd, n = deviation(v), F.count(v)
    return rows.where(finite(v)).groupBy(*keys).agg(n.alias("n"), r6(F.avg(v)).alias("mean"), r6(sd).alias("sd"), r6(sd / F.sqrt(n)).alias("se"), r6(F.min(v)).alias("minimum"), r6(F.max(v)).alias("maximum"))


def summary(evaluations: DataFrame, conditions: DataFrame) -> DataFrame:
    """(condition, metric, available, n, mean, sd, variance, run_ids) of the terminal values, for every condition and metric."""
    last = evaluation_history(evaluations).where("axis = 'terminal'")
    per = last.groupBy("condition", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("m"), deviation("value").alias("s"), F.array_join(F.array_sort(F.collect_list("run_id")), ",").alias("run_ids"))
    metrics = last.select("metric").distinct().agg(F.array_sort(F.collect_list("metric")).alias("all"))
    grid = conditions.select(F.col("canonical_condition_id").alias("condition")).crossJoin(metrics).select("condition", F.explode("all").alias("metric"))
    return grid.join(per, ["condition", "metric"], "left").select("condition", "metric", F.col("n").isNotNull().alias("available"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), r6(F.col("m")).alias("mean"), r6(F.col("s")).alias("sd"), r6(F.col("s") * F.col("s")).alias("variance"), "run_ids")


def cross_variant(runs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """(condition, seed, metric) with the value, availability and reason of both variants; a side without a value stays."""
    picked = chosen(runs)
    values = evaluation_history(evaluations).where("axis = 'terminal'").select("run_id", "metric", "value")
    side = lambda v: picked.where(F.col("variant") == v).join(values, "run_id", "left").select("condition", "seed", "metric", F.col("run_id").alias(f"{v}_run_id"), F.col("value").alias(f"{v}_value"))
    a, b = side("implemented"), side("original")
    rows = a.where("metric is not null").join(b.where("metric is not null"), ["condition", "seed", "metric"], "full_outer")
    there = lambda v: picked.where(F.col("variant") == v).select("condition", "seed", F.lit(True).alias(f"{v}_there"))
    rows = rows.join(there("implemented"), ["condition", "seed"], "left").join(there("original"), ["condition", "seed"], "left")
    reason = lambda v: F.when(F.col(f"{v}_value").isNotNull(), "").when(F.col(f"{v}_there"), "no value").otherwise("no run")
    return rows.select("condition", "seed", "metric", *[c for v in ("implemented", "original") for c in (r6(F.col(f"{v}_value")).alias(f"{v}_value"), reason(v).alias(f"{v}_reason"))])


def timing(estimates: DataFrame) -> DataFrame:
    """(condition, device, n, mean, sd_population, minimum, maximum, p50, p95) of the finite readings, exactly."""
    v = F.col("seconds_per_update")
    rows = estimates.where(finite(v)).dropDuplicates()
    p = F.percentile(v, F.array(F.lit(0.5), F.lit(0.95)))
    out = rows.groupBy(F.col("canonical_condition_id").alias("condition"), "device").agg(F.count("*").alias("n"), half_up(F.avg(v), 4).alias("mean"), half_up(F.stddev_pop(v), 4).alias("sd_population"), r6(F.min(v)).alias("minimum"), r6(F.max(v)).alias("maximum"), p.alias("p"))
    return out.select("*", half_up(F.col("p")[0], 6).alias("p50"), half_up(F.col("p")[1], 6).alias("p95")).drop("p")


def t_interval(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, low, high): the 95 % interval of the mean, low not below 0; none of fewer than two values."""
    v = F.col(value)
    s = rows.where(finite(v)).groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("m"), deviation(v).alias("sd"))
    t = F.when(F.col("n") > 31, 1.96).otherwise(F.element_at(F.array(*map(F.lit, T_95)), F.greatest(F.lit(1), F.col("n") - 1).cast("int")))
    half = t * F.col("sd") / F.sqrt("n")
    two = F.col("n") > 1
    return s.select(*keys, "n", half_up(F.col("m"), 4).alias("mean"), F.when(two, half_up(F.greatest(F.lit(0.0), F.col("m") - half), 4)).alias("low"), F.when(two, half_up(F.col("m") + half, 4)).alias("high"))


def perplexity_by_epoch(updates: DataFrame) -> DataFrame:
    """(condition, epoch, mean, sd, runs): exp of the mean loss of each run's epoch, then over runs.

    All finite losses count; an epoch whose perplexity is infinite (see ``losses.ENDLESS``) is no value of its run.
    """
    rows = updates.where(finite("loss")).dropDuplicates(["run_id", "update_no", "loss"])
    per = rows.groupBy("run_id", F.col("canonical_condition_id").alias("condition"), "epoch").agg(F.avg("loss").alias("m")).where(F.col("m") <= ENDLESS).withColumn("p", F.exp("m"))
    return per.groupBy("condition", "epoch").agg(r6(F.avg("p"), 3).alias("mean"), r6(deviation("p"), 3).alias("sd"), F.count("*").alias("runs"))


def histogram(rows: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin_index, bin_left, bin_right, count, zero_ratio): equal widths over the range, the last bin closed; with given limits others are dropped."""
    v = F.col(value)
    ok = rows.where(finite(v))
    if low is not None:
        ok = ok.where(v.between(low, high))
    ends = ok.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), r6(F.avg((v == 0).cast("int"))).alias("zero_ratio")) if low is None else ok.agg(F.lit(low).alias("lo"), F.lit(high).alias("hi"), r6(F.avg((v == 0).cast("int"))).alias("zero_ratio"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.lit(bins - 1), F.floor(divided(v - F.col("lo"), width))).cast("int")
    counts = ok.crossJoin(ends).groupBy(place.alias("bin_index")).agg(F.count("*").alias("count"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin_index"))
    return grid.join(counts, "bin_index", "left").select("bin_index", r6(F.col("lo") + width * F.col("bin_index")).alias("bin_left"), r6(F.col("lo") + width * (F.col("bin_index") + 1)).alias("bin_right"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "zero_ratio")


def completeness(runs: DataFrame, metrics: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(run_id, condition, seed, variant, score): finished, with an end, how many params, tags, metric keys and checkpoints."""
    m = metrics.groupBy("run_id").agg(F.count_distinct("metric_key").alias("keys"))
    c = checkpoints.groupBy("run_id").agg(F.count_distinct("checkpoint_id").alias("checkpoints"))
    sizes = runs.dropDuplicates(["run_id"]).select("run_id", F.coalesce(F.size("params"), F.lit(0)).alias("params"), F.coalesce(F.size("tags"), F.lit(0)).alias("tags_"))
    rows = attempts(runs).where("run_type = 'seed_trial'").join(sizes, "run_id").join(m, "run_id", "left").join(c, "run_id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("bigint")
    score = F.array((F.col("status") == "FINISHED").cast("bigint"), F.col("end_time").isNotNull().cast("bigint"), F.col("params").cast("bigint"), F.col("tags_").cast("bigint"), zero("keys"), zero("checkpoints"))
    return rows.select("run_id", "condition", "seed", "variant", score.alias("score"))


def duplicates(scored: DataFrame) -> DataFrame:
    """(condition, seed, variant, keep, losers): the run of the highest score, and the others of its group."""
    order = F.struct("score", _descending(F.col("run_id")))
    groups = scored.groupBy("condition", "seed", "variant").agg(F.max_by("run_id", order).alias("keep"), F.array_sort(F.collect_list("run_id")).alias("all"))
    return groups.where(F.size("all") > 1).select("condition", "seed", "variant", "keep", F.array_join(F.array_remove("all", F.col("keep")), ",").alias("losers"))


def smoothing_weights(points: int = 11, beta: float = 2.0) -> list[float]:
    w = np.kaiser(points, beta)
    return [float(x) for x in w / w.sum()]


def smoothed(history: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """(keys, step, value): an 11-point Kaiser mean in order of step, mirrored at both ends; shorter series stay as they are."""
    weights = smoothing_weights()
    half = len(weights) // 2
    w = Window.partitionBy(*keys).orderBy("step")
    rows = history.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(*keys))})
    long = F.col("n") >= len(weights)
    places = F.array_compact(F.array(F.col("i"), F.when(long & F.col("i").between(1, half), -F.col("i")), F.when(long & (F.col("n") - 1 - F.col("i")).between(1, half), 2 * (F.col("n") - 1) - F.col("i"))))
    mirrored = rows.withColumn("p", F.explode(places))
    by = Window.partitionBy(*keys).orderBy("p")
    mean = sum((F.lag("value", half - k).over(by) * F.lit(x) if k < half else F.lead("value", k - half).over(by) * F.lit(x) if k > half else F.col("value") * F.lit(x) for k, x in enumerate(weights)), F.lit(0.0))
    out = mirrored.withColumn("smooth", mean).where(F.col("p") == F.col("i"))
    return out.select(*keys, "step", r6(F.when(long, F.col("smooth")).otherwise(F.col("value")), 9).alias("value"))


def every_n(updates: DataFrame, every: int = 10) -> DataFrame:
    """(run_id, point, first_update, last_update, unit_count, mean, weighted): a point after each update whose number within the run is a multiple of ``every``.

    The first window has one update; a last window that isn't full gives no point.
    """
    rows = updates.where(finite("loss") & F.col("batch_size").isNotNull()).groupBy("run_id", "update_no").agg(F.max("loss").alias("loss"), F.max("batch_size").cast("bigint").alias("units"))
    i = F.row_number().over(Window.partitionBy("run_id").orderBy("update_no")) - 1
    rows = rows.withColumn("i", i).withColumn("point", F.ceil(F.col("i") / every))
    points = rows.groupBy("run_id", "point").agg(F.min("update_no").alias("first_update"), F.max("update_no").alias("last_update"), F.sum("units").alias("unit_count"), r6(F.avg("loss")).alias("mean"), r6(divided(F.sum(F.col("loss") * F.col("units")), F.sum("units"))).alias("weighted"), F.max("i").alias("top"))
    return points.where(F.col("top") == F.col("point") * every).drop("top")


def trigger_windows(events: DataFrame, closing: str = "purchase") -> DataFrame:
    """(user_id, window, closed, events, total): stretches of a user's events that end with a closing one."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("window", F.coalesce(F.sum((F.col("event_type") == closing).cast("int")).over(order), F.lit(0)))
    return rows.groupBy("user_id", "window").agg(F.max((F.col("event_type") == closing).cast("int")).alias("closed"), F.count("*").alias("events"), r6(F.sum("value"), 4).alias("total"))


def best_so_far(evaluations: DataFrame, factor: float = 4.0) -> DataFrame:
    """(run_id, step, value, best, improved, rate): the least validation loss before each epoch; the rate is divided at each one that isn't better."""
    h = evaluation_history(evaluations).where("axis = 'epoch' AND split = 'valid' AND metric IN ('loss', 'perplexity')")
    w = Window.partitionBy("run_id", "metric").orderBy("step")
    before = F.min("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = h.withColumn("before", before).withColumn("improved", F.col("before").isNull() | (F.col("value") < F.col("before")))
    worse = F.sum((~F.col("improved")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("run_id", "metric", "step", r6(F.col("value")).alias("value"), r6(F.least(F.col("value"), F.coalesce("before", "value"))).alias("best"), "improved", F.round(F.pow(F.lit(1 / factor), worse), 9).alias("rate"))


def retained(checkpoints: DataFrame, keep: int = 2) -> DataFrame:
    """(run_id, kind, checkpoint_id): the last ``keep`` generations by name of every run and kind."""
    rows = checkpoints.dropDuplicates(["checkpoint_id"])
    w = Window.partitionBy("run_id", "kind").orderBy(F.col("path").desc(), "checkpoint_id")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).select("run_id", "kind", "checkpoint_id")


def crossovers(runs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """(metric, step, winner, confirmed): the variant with the smaller mean per epoch, confirmed if it also wins the next one."""
    h = evaluation_history(evaluations).where("axis = 'epoch' AND split = 'valid'").join(attempts(runs).select("run_id", "variant"), "run_id")
    m = h.groupBy("metric", "step").agg(F.avg(F.when(F.col("variant") == "implemented", F.col("value"))).alias("a"), F.avg(F.when(F.col("variant") == "original", F.col("value"))).alias("b")).where("a is not null and b is not null")
    winner = F.when(F.round("a", 9) <= F.round("b", 9), "implemented").otherwise("original")
    rows = m.withColumn("winner", winner)
    return rows.select("metric", "step", "winner", F.coalesce(F.lead("winner").over(Window.partitionBy("metric").orderBy("step")) == F.col("winner"), F.lit(False)).alias("confirmed"))


def error_metrics(metrics: DataFrame, restored: DataFrame) -> DataFrame:
    """(metric_key, n, max_absolute, max_relative, combined) between the readings of both stores."""
    ours = metrics.where(finite("value")).select(bare_id("run_id").alias("key"), "metric_key", "step", "logged_ms", F.col("value").alias("a")).dropDuplicates()
    theirs = restored.select(bare_id("original_run_id").alias("key"), F.inline("metrics")).where(finite("value")).select("key", "metric_key", "step", "logged_ms", F.col("value").alias("b")).dropDuplicates()
    gap, size = F.abs(F.col("a") - F.col("b")), F.abs("a")
    both = ours.join(theirs, ["key", "metric_key", "step", "logged_ms"])
    return both.groupBy("metric_key").agg(F.count("*").alias("n"), r6(F.max(gap), 4).alias("max_absolute"), r6(F.max(gap / F.greatest(size, F.lit(1e-6)))).alias("max_relative"), r6(F.max(gap / (1 + size))).alias("combined"))


def last_points(points: DataFrame, series: Sequence[str]) -> DataFrame:
    """(series, seed_runs, points, final_mean, final_minimum, final_maximum) of a curve."""
    last = F.max_by(F.struct("mean", "minimum", "maximum"), "step")
    return points.groupBy(*series).agg(F.max("run_count").alias("seed_runs"), F.count("*").alias("points"), last.alias("l")).select(*series, "seed_runs", "points", F.col("l.mean").alias("final_mean"), F.col("l.minimum").alias("final_minimum"), F.col("l.maximum").alias("final_maximum"))
