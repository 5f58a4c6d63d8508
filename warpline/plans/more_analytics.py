"""Further queries of the run analytics: declarations, maintenance plans, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpline.functions.numeric import half_up, r6
from warpline.operators import declarations as D
from warpline.operators import runs as R
from warpline.operators import tensors as T
from warpline.plans.registry import Registry
from warpline.plans.run_analytics import ATTEMPTS, CHOSEN, FIN, HIST

registry = Registry()
add = registry.add

_DECLARED = "decl AS (SELECT canonical_condition_id AS condition, unnest(range(len(m))) AS place, unnest(m) AS metric FROM (SELECT *, CASE task " + " ".join(f"WHEN '{t}' THEN {n!r}" for t, n in D.OF_TASK.items()) + " END AS m FROM conditions))"

add("declared_metric", "conditions", "evaluations", sql=HIST + ", " + _DECLARED + """, r AS (SELECT d.*, t.metric IS NOT NULL AS available, row_number() OVER (PARTITION BY d.condition ORDER BY t.metric IS NULL, place) AS k
  FROM decl d LEFT JOIN (SELECT DISTINCT condition, metric FROM eh WHERE axis = 'terminal') t ON t.condition = d.condition AND t.metric = d.metric)
SELECT condition, metric, available FROM r WHERE k = 1""")(D.resolved)
add("declared_reasons", "conditions", "evaluations", sql="WITH " + _DECLARED + """, g AS (SELECT canonical_condition_id AS condition, metric, bool_or(split = 'test' AND axis = 'terminal') AS b, bool_or(split = 'test') AS s, bool_or(axis = 'terminal') AS a FROM evaluations GROUP BY ALL)
SELECT d.condition, d.metric, CASE WHEN b IS NULL THEN 'no such metric' WHEN b THEN '' WHEN NOT s THEN 'other split' WHEN NOT a THEN 'other axis' ELSE 'never together' END AS reason FROM decl d LEFT JOIN g USING (condition, metric)""")(D.reasons)
add("value_fallback", "evaluations", "updates", sql=HIST + """, a AS (SELECT run_id, max(value) AS a FROM eh WHERE metric = 'loss' AND axis = 'terminal' GROUP BY 1),
b AS (SELECT run_id, max({'s': step, 'v': value}).v AS b FROM eh WHERE metric = 'loss' AND axis <> 'terminal' GROUP BY 1), c AS (SELECT run_id, arg_max(value, step) AS c FROM uh GROUP BY 1)
SELECT run_id, round(coalesce(a, b, c), 6) + 0.0 AS value, CASE WHEN a IS NOT NULL THEN 'terminal' WHEN b IS NOT NULL THEN 'curve' ELSE 'updates' END AS origin FROM c FULL JOIN b USING (run_id) FULL JOIN a USING (run_id)""")(D.values)
add("runs_loaded", "evaluations", sql=HIST + """, h AS (SELECT run_id, metric, step, max(value) AS value FROM eh WHERE axis = 'epoch' GROUP BY ALL)
SELECT * FROM h UNION ALL SELECT run_id, metric, 0, value FROM eh WHERE axis = 'terminal' AND (run_id, metric) NOT IN (SELECT (run_id, metric) FROM h)""")(D.loaded)


@add("cache_state", "runs", "conditions", sql=CHOSEN + """, p AS (SELECT condition, list_sort(list(DISTINCT run_id)) AS a FROM chosen GROUP BY 1),
q AS (SELECT condition, list_sort(list(DISTINCT run_id)) AS b FROM (SELECT *, row_number() OVER (PARTITION BY condition, seed ORDER BY start_time DESC, run_id) AS k FROM att WHERE status = 'FINISHED' AND lifecycle = 'active' AND run_type = 'seed_trial' AND condition IN (SELECT canonical_condition_id FROM conditions)) WHERE k = 1 GROUP BY 1)
SELECT coalesce(p.condition, q.condition) AS condition, coalesce(a = b, false) AS valid FROM p FULL JOIN q ON p.condition = q.condition""")
def cache_state(runs, conditions):
    """Whether a result of the chosen attempts would still hold for the completed ones."""
    return D.cache_state(R.chosen(runs), R.completed(runs, conditions))


@add("runs_search", "runs", sql=ATTEMPTS + "SELECT run_id, condition, start_time FROM att WHERE status = 'FINISHED' AND run_type = 'seed_trial' AND variant = 'original' ORDER BY start_time DESC, run_id LIMIT 50")
def runs_search(runs):
    """The 50 newest finished trials of the original variant: filter, order and limit, as asked for."""
    return R.attempts(runs).where("status = 'FINISHED' AND run_type = 'seed_trial' AND variant = 'original'").orderBy(F.col("start_time").desc(), "run_id").limit(50).select("run_id", "condition", "start_time")


@add("parents_needed", "runs", sql=ATTEMPTS + """, p AS (SELECT condition, variant, run_id, row_number() OVER (PARTITION BY condition, variant ORDER BY start_time, run_id) AS k FROM att WHERE run_type = 'condition_parent' AND lifecycle = 'active')
SELECT DISTINCT t.condition, t.variant, CASE WHEN p.run_id IS NULL THEN 'create' ELSE 'keep' END AS action, p.run_id AS parent FROM att t LEFT JOIN (SELECT * FROM p WHERE k = 1) p USING (condition, variant) WHERE run_type = 'seed_trial'""")
def parents_needed(runs):
    """(condition, variant, action, parent): the oldest active parent of the trials, or that one must be made."""
    rows = R.attempts(runs)
    oldest = rows.where("run_type = 'condition_parent' AND lifecycle = 'active'").groupBy("condition", "variant").agg(F.min(F.struct("start_time", "run_id"))["run_id"].alias("parent"))
    groups = rows.where("run_type = 'seed_trial'").select("condition", "variant").distinct()
    return groups.join(oldest, ["condition", "variant"], "left").select("condition", "variant", F.when(F.col("parent").isNull(), "create").otherwise("keep").alias("action"), "parent")


@add("checkpoints_prunable", "checkpoints", sql="""WITH o AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY path DESC, checkpoint_id) AS k FROM (SELECT DISTINCT ON (checkpoint_id) * FROM checkpoints))
SELECT run_id, kind, checkpoint_id FROM o WHERE k > 1 AND kind NOT IN ('best', 'final')""")
def checkpoints_prunable(c):
    """Checkpoints beyond the last of their kind; best and final ones are kept."""
    kept = R.retained(c, 1).select("checkpoint_id")
    rows = c.where("kind NOT IN ('best', 'final')").select("run_id", "kind", "checkpoint_id").distinct()
    return rows.join(kept, "checkpoint_id", "left_anti").select("run_id", "kind", "checkpoint_id")


@add("timing_pivot", "runtime_estimates", sql=f"""WITH r AS (SELECT DISTINCT * FROM runtime_estimates), d AS (SELECT model, device, avg(seconds_per_update) AS s FROM r WHERE {FIN.format('seconds_per_update')} GROUP BY ALL)
SELECT model, round(coalesce(max(s) FILTER (WHERE device LIKE 'cpu%'), 0) + 1e-9, 4) + 0.0 AS cpu, round(coalesce(max(s) FILTER (WHERE device LIKE 'cuda%'), 0) + 1e-9, 4) + 0.0 AS cuda FROM d GROUP BY model""")
def timing_pivot(r):
    """(model, cpu, cuda): the slowest device of each kind by its mean, 0 where there is none."""
    d = r.where(R.finite("seconds_per_update")).dropDuplicates().groupBy("model", "device").agg(F.avg("seconds_per_update").alias("s"))
    worst = lambda k: half_up(F.coalesce(F.max(F.when(F.col("device").startswith(k), F.col("s"))), F.lit(0.0)), 4).alias(k)
    return d.groupBy("model").agg(worst("cpu"), worst("cuda"))


@add("timing_pairs", "runtime_estimates", sql=f"""WITH m AS (SELECT canonical_condition_id AS c, avg(seconds_per_update) AS s FROM (SELECT DISTINCT * FROM runtime_estimates) WHERE {FIN.format('seconds_per_update')} GROUP BY 1)
SELECT left(a.c, length(a.c) - 4) AS pair, round(a.s + 1e-9, 4) + 0.0 AS forward, round(b.s + 1e-9, 4) + 0.0 AS reversed, round(b.s / a.s + 1e-9, 4) + 0.0 AS ratio FROM m a JOIN m b ON left(a.c, length(a.c) - 4) || '-REV' = b.c WHERE a.c LIKE '%-FWD'""")
def timing_pairs(r):
    """(pair, forward, reversed, ratio) of the conditions that differ in their direction only."""
    m = r.where(R.finite("seconds_per_update")).dropDuplicates().groupBy(F.col("canonical_condition_id").alias("c")).agg(F.avg("seconds_per_update").alias("s"))
    side = lambda end, n: m.where(F.col("c").endswith(end)).select(F.regexp_replace("c", f"{end}$", "").alias("pair"), F.col("s").alias(n))
    both = side("-FWD", "forward").join(side("-REV", "reversed"), "pair")
    return both.select("pair", half_up(F.col("forward"), 4).alias("forward"), half_up(F.col("reversed"), 4).alias("reversed"), half_up(F.col("reversed") / F.col("forward"), 4).alias("ratio"))


@add("memory_estimate", "runs", sql="SELECT run_id, 8 * 10000 * try_cast(params['model/hidden_size'] AS BIGINT) * 4 AS bytes FROM (SELECT DISTINCT ON (run_id) run_id, params FROM runs)")
def memory_estimate(runs):
    """Bytes of eight dense arrays of 10,000 words by the hidden size."""
    return runs.select("run_id", (F.col("params")["model/hidden_size"].try_cast("bigint") * 8 * 10000 * 4).alias("bytes")).distinct()


@add("axis_limits", "evaluations", sql=HIST + """, m AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM eh GROUP BY 1)
SELECT metric, round(lo - greatest(0.06 * (hi - lo), 0.01 * hi, 1), 6) + 0.0 AS low, round(hi + greatest(0.06 * (hi - lo), 0.01 * hi, 1), 6) + 0.0 AS high FROM m""")
def axis_limits(e):
    """Limits of an axis with room: 6 % of the span, 1 % of the maximum, and one at least."""
    m = R.evaluation_history(e).groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    room = F.greatest(0.06 * (F.col("hi") - F.col("lo")), 0.01 * F.col("hi"), F.lit(1.0))
    return m.select("metric", r6(F.col("lo") - room).alias("low"), r6(F.col("hi") + room).alias("high"))


_LONG = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), long AS (SELECT vec_id AS i, label, unnest(range(len(e)))::INT AS j, unnest(e) AS v FROM v) "


@add("activation_summary", "embeddings", sql=_LONG + """SELECT label, round(avg(greatest(v, 0)), 6) + 0.0 AS mean, round(stddev_pop(greatest(v, 0)), 6) + 0.0 AS std, round(min(greatest(v, 0)), 6) + 0.0 AS minimum, round(max(greatest(v, 0)), 6) + 0.0 AS maximum, round(avg((v <= 0)::INT), 6) + 0.0 AS zero_ratio, count(*) AS sample_count FROM long GROUP BY label""")
def activation_summary(e):
    """Statistics of the rectified values of each label."""
    rows = T.long_form(e, "vec_id", "embedding").join(e.select(F.col("vec_id").alias("i"), "label"), "i")
    a = F.greatest(F.col("v"), F.lit(0.0))
    return rows.groupBy("label").agg(r6(F.avg(a)).alias("mean"), r6(F.stddev_pop(a)).alias("std"), r6(F.min(a)).alias("minimum"), r6(F.max(a)).alias("maximum"), r6(F.avg((F.col("v") <= 0).cast("int"))).alias("zero_ratio"), F.count("*").alias("sample_count"))


@add("parameter_statistics", "embeddings", sql=_LONG + """SELECT j, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std, round(min(v), 6) + 0.0 AS minimum, round(max(v), 6) + 0.0 AS maximum, (SELECT round(max(abs(v)), 6) + 0.0 FROM long) AS shared_limit FROM long GROUP BY j""")
def parameter_statistics(e):
    """Statistics of every column and the largest magnitude of all."""
    long = T.long_form(e, "vec_id", "embedding")
    limit = long.agg(r6(F.coalesce(F.max(F.abs("v")), F.lit(1.0))).alias("shared_limit"))
    s = long.groupBy("j").agg(r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), r6(F.min("v")).alias("minimum"), r6(F.max("v")).alias("maximum"))
    return s.crossJoin(limit)


@add("layer_running_statistics", "embeddings", sql=_LONG + """, p AS (SELECT j, i // 50 AS b, avg(v) AS m, var_pop(v) AS s FROM long GROUP BY ALL), w AS (SELECT *, 0.1 * pow(0.9, row_number() OVER (PARTITION BY j ORDER BY b DESC) - 1) AS w FROM p)
SELECT j, round(sum(w * m), 6) + 0.0 AS mean, round(sum(w * s), 6) + 0.0 AS variance FROM w GROUP BY j""")
def layer_running_statistics(e):
    return D.running_statistics(T.long_form(e, "vec_id", "embedding"), 50).select("j", r6(F.col("mean")).alias("mean"), r6(F.col("variance")).alias("variance"))


@add("steps_common", "evaluations", sql=HIST + """, n AS (SELECT condition, metric, count(DISTINCT run_id) AS runs FROM eh WHERE axis = 'epoch' GROUP BY ALL)
SELECT condition, metric, list(step ORDER BY step) AS steps FROM (SELECT condition, metric, step FROM eh JOIN n USING (condition, metric) WHERE axis = 'epoch' GROUP BY condition, metric, step, runs HAVING count(DISTINCT run_id) = runs) GROUP BY ALL""")
def steps_common(e):
    """The steps that all runs of a condition have."""
    h = R.evaluation_history(e).where("axis = 'epoch'").select("condition", "metric", "step", "run_id").distinct()
    n = h.groupBy("condition", "metric").agg(F.count_distinct("run_id").alias("runs"))
    s = h.groupBy("condition", "metric", "step").agg(F.count("*").alias("k")).join(n, ["condition", "metric"]).where("k = runs")
    return s.groupBy("condition", "metric").agg(F.array_sort(F.collect_list("step")).alias("steps"))
