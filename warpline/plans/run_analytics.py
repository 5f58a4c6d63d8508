"""Queries of the run analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpline.operators import runs as R
from warpline.operators.intervals import binned_range_join, idle_gaps, with_a_point
from warpline.plans.registry import Registry

registry = Registry()
add = registry.add

FIN = "{0} IS NOT NULL AND isfinite({0})"
ATTEMPTS = """
WITH att AS (
  SELECT run_id, experiment, variant, status, start_time, end_time, coalesce(lifecycle_stage, 'active') AS lifecycle,
    coalesce(canonical_condition_id, native_condition_id) AS condition, canonical_condition_id IS NOT NULL AS canonical,
    coalesce(seed, params['seed/master'], 'single') AS seed, coalesce(tags['run.type'], 'seed_trial') AS run_type,
    coalesce(tags['protocol.version'], 'legacy') AS protocol, coalesce(try_cast(tags['trial.attempt'] AS INT), 1) AS attempt,
    lower(regexp_replace(tags['mlflow.parentRunId'], '[\\s\\-]+', '', 'g')) AS parent
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY received_at) AS copy FROM runs) WHERE copy = 1)
"""
HIST = f"""
WITH eh AS (
  SELECT run_id, canonical_condition_id AS condition, axis, split, metric, CASE WHEN axis = 'terminal' THEN 0 ELSE axis_step END::BIGINT AS step,
    max({{'r': received_at, 'v': value}}).v AS value
  FROM evaluations WHERE {FIN.format('value')} GROUP BY ALL),
uh AS (SELECT run_id, update_no AS step, max({{'r': received_at, 'v': loss}}).v AS value FROM updates WHERE {FIN.format('loss')} GROUP BY ALL)
"""
CURVE = """
SELECT {0}, step, round(mean, 6) + 0.0 AS mean, round(minimum, 6) + 0.0 AS minimum, round(maximum, 6) + 0.0 AS maximum, round(sd, 6) + 0.0 AS sd, run_count FROM (
  SELECT {0}, step, avg(value) AS mean, min(value) AS minimum, max(value) AS maximum, coalesce(stddev_samp(value), 0) AS sd, count(*) AS run_count FROM {1} GROUP BY ALL)
JOIN (SELECT {0}, count(DISTINCT run_id) AS all_runs FROM {1} GROUP BY ALL) USING ({0}) WHERE run_count = all_runs
"""
_ATT_COLS = "run_id, experiment, variant, status, start_time, end_time, lifecycle, condition, canonical, seed, run_type, protocol, attempt, parent"

add("runs_attempts", "runs", sql=ATTEMPTS + f"SELECT {_ATT_COLS} FROM att")(R.attempts)
add("runs_completed", "runs", "conditions", sql=ATTEMPTS + """, p AS (SELECT *, row_number() OVER (PARTITION BY condition, seed ORDER BY start_time DESC, run_id) AS k FROM att WHERE status = 'FINISHED' AND lifecycle = 'active' AND run_type = 'seed_trial')
SELECT c.canonical_condition_id AS condition, p.seed, p.run_id FROM conditions c LEFT JOIN (SELECT * FROM p WHERE k = 1) p ON p.condition = c.canonical_condition_id""")(R.completed)
CHOSEN = ATTEMPTS + """, ranked AS (SELECT *, CASE WHEN canonical AND lifecycle = 'active' THEN 0 WHEN lifecycle = 'active' THEN 1 ELSE 2 END AS rank FROM att WHERE run_type = 'seed_trial'),
chosen AS (SELECT condition, variant, seed, run_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY condition, variant, seed ORDER BY rank, start_time DESC, run_id) AS k FROM ranked) WHERE k = 1)
"""
add("runs_chosen", "runs", sql=CHOSEN + "SELECT * FROM chosen")(R.chosen)
add("runs_status_precedence", "runs", sql=ATTEMPTS + """SELECT condition, seed, status, run_id FROM (SELECT *, row_number() OVER (PARTITION BY condition, seed
  ORDER BY CASE status WHEN 'RUNNING' THEN 0 WHEN 'FINISHED' THEN 1 WHEN 'FAILED' THEN 2 ELSE 3 END, start_time DESC, run_id) AS k FROM att WHERE run_type = 'seed_trial') WHERE k = 1""")(R.status_precedence)
add("runs_seeds", "runs", sql=ATTEMPTS + "SELECT condition, list(seed ORDER BY NOT regexp_full_match(seed, '[0-9]+'), lpad(seed, 20, '0'), seed) AS seeds FROM (SELECT DISTINCT condition, seed FROM att WHERE run_type = 'seed_trial') GROUP BY condition")(R.seeds_of_conditions)
PLAN = ATTEMPTS + """, grid AS (SELECT canonical_condition_id AS condition, v.variant, s.seed::VARCHAR AS seed FROM conditions, (VALUES ('implemented'), ('original')) v(variant), range(1, 11) s(seed)),
got AS (SELECT condition, variant, seed, min(CASE status WHEN 'RUNNING' THEN 0 WHEN 'FINISHED' THEN 1 ELSE 2 END) AS state, count(*) AS attempts FROM att WHERE run_type = 'seed_trial' AND canonical AND lifecycle = 'active' GROUP BY ALL),
plan AS (SELECT condition, variant, seed, CASE state WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'missing' END AS status, coalesce(attempts, 0) AS attempts FROM grid LEFT JOIN got USING (condition, variant, seed))
"""
add("plan_status", "runs", "conditions", sql=PLAN + "SELECT * FROM plan")(R.plan_status)
add("plan_status_counts", "runs", "conditions", sql=PLAN + "SELECT variant, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in R.STATUSES) + " FROM plan GROUP BY variant")(lambda r, c: R.status_counts(R.plan_status(r, c)))
add("protocol_pairs", "runs", sql=ATTEMPTS + """, p AS (SELECT DISTINCT condition, variant, protocol FROM att WHERE run_type = 'seed_trial')
SELECT condition, a.protocol AS implemented, b.protocol AS original, a.protocol = b.protocol OR list_sort([a.protocol, b.protocol]) IN (['2024.1', '2024.2'], ['2024.2', '2025.1']) AS compatible
FROM p a JOIN p b USING (condition) WHERE a.variant = 'implemented' AND b.variant = 'original'""")(R.protocol_pairs)
add("parent_roots", "runs", sql=ATTEMPTS.replace("WITH att", "WITH RECURSIVE att") + """, edge AS (SELECT lower(c.run_id) AS id, p.id AS up FROM att c LEFT JOIN (SELECT lower(run_id) AS id FROM att) p ON p.id = c.parent),
walk AS (SELECT id, id AS root, 0 AS depth FROM edge UNION ALL SELECT w.id, e.up, w.depth + 1 FROM walk w JOIN edge e ON e.id = w.root WHERE e.up IS NOT NULL AND w.depth < (SELECT count(*) FROM edge)),
ends AS (SELECT id, arg_max(root, depth) AS root, max(depth) AS depth, max(depth) < (SELECT count(*) FROM edge) AS rests FROM walk GROUP BY id)
SELECT id AS run_id, CASE WHEN rests THEN root END AS root, CASE WHEN rests THEN depth END AS depth FROM ends""")(R.roots)
add("parent_relinks", "runs", sql=ATTEMPTS + """, parents AS (SELECT condition, variant, count(*) AS n, min(run_id) AS candidate FROM att WHERE run_type = 'condition_parent' AND lifecycle = 'active' GROUP BY ALL)
SELECT a.run_id, CASE WHEN p.n = 1 THEN 'relink' WHEN p.n IS NULL THEN 'unresolved' ELSE 'ambiguous' END AS action, CASE WHEN p.n = 1 THEN p.candidate END AS new_parent
FROM att a LEFT JOIN parents p USING (condition, variant) WHERE run_type = 'seed_trial' AND a.parent <> '' AND a.parent NOT IN (SELECT lower(run_id) FROM att)""")(R.relinks)
add("history_of_updates", "updates", sql=HIST + "SELECT * FROM uh")(R.update_history)
add("history_of_evaluations", "evaluations", sql=HIST + "SELECT * FROM eh")(R.evaluation_history)
add("history_long", "updates", sql="SELECT run_id, update_no AS step, metric, value FROM (SELECT * FROM (SELECT DISTINCT * FROM updates) UNPIVOT (value FOR metric IN (loss, book_loss, lr)))")(R.long_events)
add("history_arrays", "metrics", sql=f"SELECT run_id, metric_key, list(step ORDER BY step, logged_ms) AS steps, count(*) AS readings FROM (SELECT DISTINCT run_id, metric_key, step, logged_ms FROM metrics WHERE {FIN.format('value')}) GROUP BY ALL")(R.metric_arrays)
_SERIES = ["condition", "axis", "split", "metric"]
add("curve_of_seeds", "evaluations", sql=HIST + CURVE.format(", ".join(_SERIES), "eh"))(lambda e: R.curve(R.evaluation_history(e), _SERIES))
add("curve_last_points", "evaluations", sql=HIST + ", pts AS (" + CURVE.format(", ".join(_SERIES), "eh") + ") SELECT condition, axis, split, metric, max(run_count) AS seed_runs, count(*) AS points, arg_max(mean, step) AS final_mean, arg_max(minimum, step) AS final_minimum, arg_max(maximum, step) AS final_maximum FROM pts GROUP BY ALL")(lambda e: R.last_points(R.curve(R.evaluation_history(e), _SERIES), _SERIES))
add("series_statistics", "evaluations", sql=HIST + "SELECT condition, metric, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(coalesce(stddev_samp(value), 0), 6) + 0.0 AS sd, round(coalesce(stddev_samp(value), 0) / sqrt(count(*)), 6) + 0.0 AS se, round(min(value), 6) + 0.0 AS minimum, round(max(value), 6) + 0.0 AS maximum FROM eh WHERE axis = 'terminal' GROUP BY ALL")(lambda e: R.statistics(R.evaluation_history(e).where("axis = 'terminal'"), ["condition", "metric"]))
add("condition_summary", "evaluations", "conditions", sql=HIST + """, per AS (SELECT condition, metric, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s, string_agg(run_id, ',' ORDER BY run_id) AS run_ids FROM eh WHERE axis = 'terminal' GROUP BY ALL),
grid AS (SELECT c.canonical_condition_id AS condition, m.metric FROM conditions c, (SELECT DISTINCT metric FROM per) m)
SELECT condition, metric, n IS NOT NULL AS available, coalesce(n, 0) AS n, round(m, 6) + 0.0 AS mean, round(s, 6) + 0.0 AS sd, round(s * s, 6) + 0.0 AS variance, run_ids FROM grid LEFT JOIN per USING (condition, metric)""")(R.summary)
add("cross_variant", "runs", "evaluations", sql=CHOSEN + ", " + HIST.strip().removeprefix("WITH ") + """, vals AS (SELECT run_id, metric, value FROM eh WHERE axis = 'terminal'),
side AS (SELECT c.condition, c.seed, c.variant, v.metric, v.value FROM chosen c JOIN vals v USING (run_id)),
w AS (SELECT coalesce(a.condition, b.condition) AS condition, coalesce(a.seed, b.seed) AS seed, coalesce(a.metric, b.metric) AS metric, a.value AS av, b.value AS bv
  FROM (SELECT * FROM side WHERE variant = 'implemented') a FULL JOIN (SELECT * FROM side WHERE variant = 'original') b ON a.condition = b.condition AND a.seed = b.seed AND a.metric = b.metric)
SELECT condition, seed, metric, round(av, 6) + 0.0 AS implemented_value, CASE WHEN av IS NOT NULL THEN '' WHEN (condition, seed) IN (SELECT (condition, seed) FROM chosen WHERE variant = 'implemented') THEN 'no value' ELSE 'no run' END AS implemented_reason,
  round(bv, 6) + 0.0 AS original_value, CASE WHEN bv IS NOT NULL THEN '' WHEN (condition, seed) IN (SELECT (condition, seed) FROM chosen WHERE variant = 'original') THEN 'no value' ELSE 'no run' END AS original_reason FROM w""")(R.cross_variant)
add("timing_summary", "runtime_estimates", sql=f"""SELECT canonical_condition_id AS condition, device, count(*) AS n, round(avg(s) + 1e-9, 4) + 0.0 AS mean, round(stddev_pop(s) + 1e-9, 4) + 0.0 AS sd_population, round(min(s), 6) + 0.0 AS minimum, round(max(s), 6) + 0.0 AS maximum,
  round(quantile_cont(s, 0.5) + 1e-9, 6) + 0.0 AS p50, round(quantile_cont(s, 0.95) + 1e-9, 6) + 0.0 AS p95 FROM (SELECT DISTINCT * , seconds_per_update AS s FROM runtime_estimates) WHERE {FIN.format('s')} GROUP BY ALL""")(R.timing)
_T = ", ".join(map(str, R.T_95))


@add("timing_t_interval", "runtime_estimates", sql=f"""SELECT condition, n, round(m + 1e-9, 4) + 0.0 AS mean, CASE WHEN n > 1 THEN round(greatest(0.0, m - half) + 1e-9, 4) + 0.0 END AS low, CASE WHEN n > 1 THEN round(m + half + 1e-9, 4) + 0.0 END AS high FROM (
  SELECT condition, n, m, (CASE WHEN n > 31 THEN 1.96 ELSE ([{_T}])[greatest(1, n - 1)] END)::DOUBLE * sd / sqrt(n) AS half FROM (
    SELECT canonical_condition_id AS condition, count(*) AS n, avg(seconds_per_update) AS m, coalesce(stddev_samp(seconds_per_update), 0) AS sd FROM (SELECT DISTINCT * FROM runtime_estimates) WHERE {FIN.format('seconds_per_update')} GROUP BY ALL))""")
def timing_t_interval(r):
    return R.t_interval(r.dropDuplicates().withColumnRenamed("canonical_condition_id", "condition"), ["condition"], "seconds_per_update")


add("perplexity_by_epoch", "updates", sql=f"""SELECT condition, epoch, round(avg(p), 3) + 0.0 AS mean, round(coalesce(stddev_samp(p), 0), 3) + 0.0 AS sd, count(*) AS runs FROM (
  SELECT run_id, canonical_condition_id AS condition, epoch, exp(avg(loss)) AS p FROM (SELECT DISTINCT run_id, update_no, loss, canonical_condition_id, epoch FROM updates WHERE {FIN.format('loss')}) GROUP BY ALL HAVING avg(loss) <= 20) GROUP BY ALL""")(R.perplexity_by_epoch)
_BINS = """SELECT g.b::INT AS bin_index, round(lo + (hi - lo) / {n} * g.b, 6) + 0.0 AS bin_left, round(lo + (hi - lo) / {n} * (g.b + 1), 6) + 0.0 AS bin_right, coalesce(c.count, 0) AS count, zero_ratio
FROM e, range(0, {n}) g(b) LEFT JOIN c ON c.b = g.b"""
add("histogram_of_losses", "updates", sql=f"""WITH v AS (SELECT least(loss, 20.0) AS x FROM updates WHERE {FIN.format('loss')}), e AS (SELECT min(x) AS lo, max(x) AS hi, round(avg((x = 0)::INT), 6) + 0.0 AS zero_ratio FROM v),
c AS (SELECT least(49, floor((x - lo) / ((hi - lo) / 50)))::INT AS b, count(*) AS count FROM v, e GROUP BY 1) """ + _BINS.format(n=50))(lambda u: R.histogram(u.where(R.finite("loss")).select(F.least("loss", F.lit(20.0)).alias("x")), "x", 50))
add("histogram_of_fractions", "evaluations", sql=f"""WITH v AS (SELECT value AS x FROM evaluations WHERE unit = 'fraction' AND {FIN.format('value')} AND value BETWEEN 0 AND 1), e AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, round(avg((x = 0)::INT), 6) + 0.0 AS zero_ratio FROM v),
c AS (SELECT least(29, floor((x - lo) / ((hi - lo) / 30)))::INT AS b, count(*) AS count FROM v, e GROUP BY 1) """ + _BINS.format(n=30))(lambda e: R.histogram(e.where("unit = 'fraction'"), "value", 30, 0.0, 1.0))
SCORES = ATTEMPTS + """, sizes AS (SELECT DISTINCT ON (run_id) run_id, coalesce(cardinality(params), 0) AS p, coalesce(cardinality(tags), 0) AS t FROM runs),
scored AS (SELECT a.run_id, condition, seed, variant, [(status = 'FINISHED')::BIGINT, (end_time IS NOT NULL)::BIGINT, s.p::BIGINT, s.t::BIGINT, coalesce(m.k, 0)::BIGINT, coalesce(c.k, 0)::BIGINT] AS score
  FROM att a JOIN sizes s USING (run_id) LEFT JOIN (SELECT run_id, count(DISTINCT metric_key) AS k FROM metrics GROUP BY 1) m USING (run_id) LEFT JOIN (SELECT run_id, count(DISTINCT checkpoint_id) AS k FROM checkpoints GROUP BY 1) c USING (run_id)
  WHERE run_type = 'seed_trial')
"""
add("runs_completeness", "runs", "metrics", "checkpoints", sql=SCORES + "SELECT * FROM scored")(R.completeness)
add("runs_duplicates", "runs", "metrics", "checkpoints", sql=SCORES + """, o AS (SELECT *, row_number() OVER (PARTITION BY condition, seed, variant ORDER BY score DESC, run_id) AS k FROM scored)
SELECT condition, seed, variant, max(run_id) FILTER (WHERE k = 1) AS keep, string_agg(run_id, ',' ORDER BY run_id) FILTER (WHERE k > 1) AS losers FROM o GROUP BY ALL HAVING count(*) > 1""")(lambda r, m, c: R.duplicates(R.completeness(r, m, c)))
_W = "[" + ", ".join(f"{x!r}" for x in R.smoothing_weights()) + "]::DOUBLE[]"
SMOOTH = f""", lists AS (SELECT run_id, list(value ORDER BY step) AS v, list(step ORDER BY step) AS s, count(*) AS n FROM uh GROUP BY run_id),
spread AS (SELECT run_id, v, n, unnest(s) AS step, unnest(range(n)) AS i FROM lists),
smooth AS (SELECT run_id, step, round(CASE WHEN n < 11 THEN v[i + 1] ELSE list_sum(list_transform(range(11), lambda k: ({_W})[k + 1] * v[CASE WHEN i + k - 5 < 0 THEN 5 - i - k WHEN i + k - 5 > n - 1 THEN 2 * (n - 1) - (i + k - 5) ELSE i + k - 5 END + 1])) END, 9) + 0.0 AS value FROM spread)
"""
add("history_smoothed", "updates", sql=HIST + SMOOTH + "SELECT * FROM smooth")(lambda u: R.smoothed(R.update_history(u)))
add("every_n_points", "updates", sql=f"""WITH u AS (SELECT run_id, update_no, max(loss) AS loss, max(batch_size) AS units FROM updates WHERE {FIN.format('loss')} AND batch_size IS NOT NULL GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY update_no) - 1 AS i FROM u)
SELECT run_id, ceil(i / 10)::BIGINT AS point, min(update_no) AS first_update, max(update_no) AS last_update, sum(units)::BIGINT AS unit_count, round(avg(loss), 6) + 0.0 AS mean, round(sum(loss * units) / sum(units), 6) + 0.0 AS weighted
FROM i GROUP BY 1, 2 HAVING max(i) = 10 * max(ceil(i / 10)::BIGINT)""")(R.every_n)
add("trigger_windows", "events", sql="""WITH w AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS win FROM events)
SELECT user_id, win AS "window", max((event_type = 'purchase')::INT) AS closed, count(*) AS events, round(sum(value), 4) + 0.0 AS total FROM w GROUP BY ALL""")(R.trigger_windows)
add("best_so_far", "evaluations", sql=HIST + """, h AS (SELECT *, min(value) OVER (PARTITION BY run_id, metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM eh WHERE axis = 'epoch' AND split = 'valid' AND metric IN ('loss', 'perplexity')),
f AS (SELECT *, before IS NULL OR value < before AS improved FROM h)
SELECT run_id, metric, step, round(value, 6) + 0.0 AS value, round(least(value, coalesce(before, value)), 6) + 0.0 AS best, improved, round(pow(0.25, sum((NOT improved)::INT) OVER (PARTITION BY run_id, metric ORDER BY step)), 9) AS rate FROM f""")(R.best_so_far)
add("checkpoints_retained", "checkpoints", sql="SELECT run_id, kind, checkpoint_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY path DESC, checkpoint_id) AS k FROM (SELECT DISTINCT ON (checkpoint_id) * FROM checkpoints)) WHERE k <= 2")(R.retained)
add("crossovers", "runs", "evaluations", sql=CHOSEN + ", " + HIST.strip().removeprefix("WITH ") + """, m AS (SELECT metric, step, avg(value) FILTER (WHERE variant = 'implemented') AS a, avg(value) FILTER (WHERE variant = 'original') AS b FROM eh JOIN att USING (run_id) WHERE axis = 'epoch' AND split = 'valid' GROUP BY ALL),
w AS (SELECT metric, step, CASE WHEN round(a, 9) <= round(b, 9) THEN 'implemented' ELSE 'original' END AS winner FROM m WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT metric, step, winner, coalesce(lead(winner) OVER (PARTITION BY metric ORDER BY step) = winner, false) AS confirmed FROM w""")(R.crossovers)
add("error_metrics", "metrics", "restored_runs", sql=f"""WITH a AS (SELECT DISTINCT lower(regexp_replace(run_id, '[\\s\\-]+', '', 'g')) AS key, metric_key, step, logged_ms, value AS a FROM metrics WHERE {FIN.format('value')}),
b AS (SELECT DISTINCT key, m.metric_key, m.step, m.logged_ms, m.value AS b FROM (SELECT lower(regexp_replace(original_run_id, '[\\s\\-]+', '', 'g')) AS key, unnest(metrics) AS m FROM restored_runs) WHERE {FIN.format('m.value')})
SELECT metric_key, count(*) AS n, round(max(abs(a - b)), 4) + 0.0 AS max_absolute, round(max(abs(a - b) / greatest(abs(a), 1e-6)), 6) + 0.0 AS max_relative, round(max(abs(a - b) / (1 + abs(a))), 6) + 0.0 AS combined FROM a JOIN b USING (key, metric_key, step, logged_ms) GROUP BY ALL""")(R.error_metrics)


# ---- interval joins ----
_EPOCHS = "SELECT run_id, epoch, min(update_no) AS first, max(update_no) AS last FROM updates WHERE epoch IS NOT NULL GROUP BY ALL"


def _epochs(updates):
    return updates.where("epoch is not null").groupBy("run_id", "epoch").agg(F.min("update_no").alias("first"), F.max("update_no").alias("last"))


@add("range_join", "updates", "evaluations", sql=f"""SELECT r.run_id, r.epoch, e.metric, count(*) AS n, round(avg(e.value), 6) + 0.0 AS mean FROM ({_EPOCHS}) r JOIN evaluations e ON e.run_id = r.run_id AND e.update_no BETWEEN r.first AND r.last WHERE {FIN.format('e.value')} GROUP BY ALL""")
def range_join(u, e):
    """Evaluations within the updates of each epoch of their run."""
    points = e.where(R.finite("value")).select("run_id", "metric", "update_no", "value")
    return binned_range_join(points, _epochs(u), ["run_id"], "update_no", "first", "last", 64).groupBy("run_id", "epoch", "metric").agg(F.count("*").alias("n"), R.r6(F.avg("value")).alias("mean"))


@add("range_exists", "updates", "checkpoints", sql=f"SELECT r.* FROM ({_EPOCHS}) r WHERE EXISTS (SELECT 1 FROM checkpoints c WHERE c.run_id = r.run_id AND c.update_no BETWEEN r.first AND r.last)")
def range_exists(u, c):
    """Epochs within which a checkpoint was saved."""
    return with_a_point(_epochs(u), c.select("run_id", "update_no"), ["run_id"], "update_no", "first", "last", 64)


@add("range_nested", "updates", "evaluations", "checkpoints", sql=f"""SELECT r.run_id, r.epoch, count(*) AS n FROM ({_EPOCHS}) r JOIN evaluations e ON e.run_id = r.run_id AND e.update_no BETWEEN r.first AND r.last
WHERE EXISTS (SELECT 1 FROM checkpoints c WHERE c.run_id = r.run_id AND c.update_no BETWEEN r.first AND r.last) GROUP BY ALL""")
def range_nested(u, e, c):
    """Evaluations within those epochs that hold a checkpoint."""
    outer = with_a_point(_epochs(u), c.select("run_id", "update_no"), ["run_id"], "update_no", "first", "last", 64)
    return binned_range_join(e.select("run_id", "update_no"), outer, ["run_id"], "update_no", "first", "last", 64).groupBy("run_id", "epoch").agg(F.count("*").alias("n"))


@add("idle_gaps", "events", sql="""WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + (floor(coalesce(value, 0)) * 1000000)::BIGINT AS e, event_id FROM events),
g AS (SELECT user_id, greatest(0, s - lag(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id)) AS gap FROM i)
SELECT user_id, coalesce(sum(gap), 0)::BIGINT AS idle FROM g GROUP BY user_id""")
def idle_gaps_of_users(events):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("user_id", "event_id", start.alias("start"), (start + (F.floor(F.coalesce("value", F.lit(0.0))) * 1_000_000).cast("bigint")).alias("end"))
    return idle_gaps(rows, "user_id", "start", "end", "event_id")


# ---- projections ----
@add("metric_names", "evaluations", sql="""SELECT DISTINCT metric, CASE WHEN lower(metric) LIKE '%perplexity%' OR lower(metric) LIKE '%ppl%' THEN 'perplexity' WHEN lower(metric) LIKE '%acc%' OR lower(metric) LIKE '%match%' THEN 'accuracy' WHEN lower(metric) LIKE '%loss%' THEN 'loss' ELSE 'observation' END AS family FROM evaluations""")
def metric_names(e):
    m = F.lower("metric")
    family = F.when(m.contains("perplexity") | m.contains("ppl"), "perplexity").when(m.contains("acc") | m.contains("match"), "accuracy").when(m.contains("loss"), "loss").otherwise("observation")
    return e.select("metric", family.alias("family")).distinct()


@add("checkpoint_names", "checkpoints", sql="""SELECT DISTINCT checkpoint_id, regexp_extract(path, '([a-z]+)-epoch-([0-9]+)-update-([0-9]+)', 1) AS role, try_cast(regexp_extract(path, '([a-z]+)-epoch-([0-9]+)-update-([0-9]+)', 2) AS BIGINT) + 1 AS epoch, try_cast(regexp_extract(path, '([a-z]+)-epoch-([0-9]+)-update-([0-9]+)', 3) AS BIGINT) AS step FROM checkpoints""")
def checkpoint_names(c):
    """Role, epoch (from 1) and step out of the names of the checkpoints' paths."""
    part = lambda k: F.regexp_extract("path", "([a-z]+)-epoch-([0-9]+)-update-([0-9]+)", k)
    return c.select("checkpoint_id", part(1).alias("role"), (part(2).try_cast("bigint") + 1).alias("epoch"), part(3).try_cast("bigint").alias("step")).distinct()


@add("natural_order", "conditions", sql="SELECT canonical_condition_id, row_number() OVER (ORDER BY regexp_replace(canonical_condition_id, '[0-9]+', '', 'g'), coalesce(try_cast(regexp_extract(canonical_condition_id, '[0-9]+', 0) AS BIGINT), -1), canonical_condition_id)::INT AS place FROM conditions")
def natural_order(c):
    """Names in an order that takes their numbers as numbers."""
    from pyspark.sql import Window

    name = F.col("canonical_condition_id")
    order = [F.regexp_replace(name, "[0-9]+", ""), F.coalesce(F.regexp_extract(name, "[0-9]+", 0).try_cast("bigint"), F.lit(-1)), name]
    return c.select(name, F.row_number().over(Window.orderBy(*order)).alias("place"))


@add("condition_labels", "conditions", sql="""SELECT canonical_condition_id, CASE WHEN canonical_condition_id LIKE '%-REV' THEN 'reversed' WHEN canonical_condition_id LIKE '%-FWD' THEN 'forward' ELSE 'plain' END AS direction, upper(model) AS model_label FROM conditions""")
def condition_labels(c):
    name = F.col("canonical_condition_id")
    return c.select(name, F.when(name.endswith("-REV"), "reversed").when(name.endswith("-FWD"), "forward").otherwise("plain").alias("direction"), F.upper("model").alias("model_label"))


@add("params_flat", "runs", sql="SELECT run_id, unnest(map_keys(params)) AS name, unnest(map_values(params)) AS value FROM (SELECT DISTINCT ON (run_id) run_id, params FROM runs)")
def params_flat(r):
    return r.select("run_id", F.explode("params").alias("name", "value")).distinct()


@add("condition_keys", "runs", sql="""SELECT run_id, sha256(coalesce(list_aggregate(list_sort(list_transform(list_filter(map_entries(params), lambda e: NOT starts_with(e.key, 'seed/') AND NOT starts_with(e.key, 'code/')), lambda e: e.key || '=' || e.value)), 'string_agg', ';'), '')) AS key
FROM (SELECT DISTINCT ON (run_id) run_id, params FROM runs WHERE params IS NOT NULL)""")
def condition_keys(r):
    """A digest of the params without those of the seed and the code."""
    kept = F.filter(F.map_entries("params"), lambda e: ~e["key"].startswith("seed/") & ~e["key"].startswith("code/"))
    text = F.array_join(F.array_sort(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return r.where("params is not null").select("run_id", F.sha2(text, 256).alias("key")).distinct()


@add("checkpoint_audit", "checkpoints", "checkpoint_files", sql="""WITH p AS (SELECT DISTINCT checkpoint_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(path)), '[/\\\\]+', '/', 'g'), '^(\\./)+', ''), '/$', '') AS path, nullif(regexp_replace(lower(regexp_replace(sha256, '[\\s\\-]+', '', 'g')), '^[a-z]+[0-9]*[:=]', ''), '') AS d FROM checkpoints),
f AS (SELECT regexp_replace(lower(trim(path)), '[/\\\\]+', '/', 'g') AS path, list(DISTINCT lower(sha256)) AS ds, bool_or(deleted_at IS NULL) AS alive FROM checkpoint_files GROUP BY 1)
SELECT CASE WHEN p.path IS NULL THEN 'unreferenced' WHEN f.path IS NULL THEN 'missing' WHEN NOT f.alive THEN 'deleted' WHEN p.d IS NULL THEN 'unverified' WHEN list_contains(f.ds, p.d) THEN 'verified' ELSE 'conflict' END AS state, count(*) AS n FROM p FULL JOIN f USING (path) GROUP BY 1""")
def checkpoint_audit(c, f):
    """How many checkpoints are verified, unverified, in conflict, missing or deleted, and files that nothing names."""
    from warpline.functions.keys import bare_digest, bare_path

    digest = bare_digest("sha256")
    p = c.select("checkpoint_id", bare_path("path").alias("path"), F.when(digest != "", digest).alias("d"), F.lit(True).alias("named")).distinct()
    s = f.groupBy(bare_path("path").alias("path")).agg(F.collect_set(F.lower("sha256")).alias("ds"), F.bool_or(F.col("deleted_at").isNull()).alias("alive"), F.lit(True).alias("stored"))
    state = F.when(F.col("named").isNull(), "unreferenced").when(F.col("stored").isNull(), "missing").when(~F.col("alive"), "deleted").when(F.col("d").isNull(), "unverified").when(F.array_contains("ds", F.col("d")), "verified").otherwise("conflict")
    return p.join(s, "path", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@add("generalisation_gap", "evaluations", sql=HIST + """, m AS (SELECT condition, split, avg(value) AS m FROM eh WHERE metric = 'loss' AND axis <> 'terminal' GROUP BY ALL)
SELECT condition, round(max(m) FILTER (WHERE split = 'train'), 6) + 0.0 AS train, round(max(m) FILTER (WHERE split = 'valid'), 6) + 0.0 AS valid, round(max(m) FILTER (WHERE split = 'valid') - max(m) FILTER (WHERE split = 'train'), 6) + 0.0 AS gap FROM m GROUP BY condition""")
def generalisation_gap(e):
    h = R.evaluation_history(e).where("metric = 'loss' AND axis <> 'terminal'")
    p = h.groupBy("condition").pivot("split", ["train", "valid"]).agg(F.avg("value"))
    return p.select("condition", R.r6(F.col("train")).alias("train"), R.r6(F.col("valid")).alias("valid"), R.r6(F.col("valid") - F.col("train")).alias("gap"))


@add("time_extrapolated", "runtime_estimates", sql=f"SELECT canonical_condition_id AS condition, round(max(s) + avg(s) * (1000 - 1) + 1e-9, 3) + 0.0 AS seconds FROM (SELECT DISTINCT *, seconds_per_update AS s FROM runtime_estimates) WHERE {FIN.format('s')} AND s > 0 GROUP BY 1")
def time_extrapolated(r):
    """The time of 1000 updates: the slowest, as the cold one, and the mean for the others."""
    v = F.col("seconds_per_update")
    return r.where(R.finite(v) & (v > 0)).dropDuplicates().groupBy(F.col("canonical_condition_id").alias("condition")).agg(R.half_up(F.max(v) + F.avg(v) * 999, 3).alias("seconds"))


# ---- the canned curves of the studies: select, project, aggregate over seeds ----
def _loss_study(volume: str, experiment: str):
    def build(conditions, runs, updates):
        wanted = conditions.where((F.col("volume") == volume) & (F.col("experiment_id") == experiment)).select(F.col("canonical_condition_id").alias("condition"))
        picked = R.completed(runs, conditions).where("run_id is not null").join(wanted, "condition", "left_semi").select("condition", "run_id")
        h = R.smoothed(R.update_history(updates.join(picked, "run_id", "left_semi"))).withColumn("step", F.col("step") - 1)
        return R.curve(h.join(picked, "run_id"), ["condition"])

    return build


def _metric_study(volume: str, experiment: str, metric: str, axis: str, split: str, scale: float):
    def build(conditions, runs, evaluations):
        wanted = conditions.where((F.col("volume") == volume) & (F.col("experiment_id") == experiment)).select(F.col("canonical_condition_id").alias("condition"))
        picked = R.completed(runs, conditions).where("run_id is not null").join(wanted, "condition", "left_semi").select("condition", "run_id")
        h = R.evaluation_history(evaluations.where((F.col("metric") == metric) & (F.col("axis") == axis) & (F.col("split") == split))).drop("condition")
        return R.curve(h.withColumn("value", F.col("value") * scale).join(picked, "run_id"), ["condition"])

    return build


_PICKED = ATTEMPTS + """, p AS (SELECT *, row_number() OVER (PARTITION BY condition, seed ORDER BY start_time DESC, run_id) AS k FROM att WHERE status = 'FINISHED' AND lifecycle = 'active' AND run_type = 'seed_trial'),
picked AS (SELECT p.condition, p.run_id FROM p JOIN conditions c ON c.canonical_condition_id = p.condition WHERE k = 1 AND c.volume = '{0}' AND c.experiment_id = '{1}'), """ + HIST.strip().removeprefix("WITH ").replace("{", "{{").replace("}", "}}")
for _v, _e in (("ds1", "e03"), ("ds1", "e04"), ("ds2", "e01"), ("ds2", "e02")):
    add(f"study_{_v}_{_e}_loss", "conditions", "runs", "updates", sql=_PICKED.format(_v, _e) + SMOOTH + ", h AS (SELECT p.condition, s.run_id, s.step - 1 AS step, s.value FROM smooth s JOIN picked p USING (run_id)) " + CURVE.format("condition", "h"))(_loss_study(_v, _e))
_STUDIES = [
    *[("ds1", e, "accuracy", a, s, k) for e, a, s, k in (("e03", "epoch", "valid", 1), ("e04", "epoch", "valid", 1), ("e05", "epoch", "valid", 1), ("e05", "update", "train", 1), ("e08", "epoch", "valid", 100), ("e08", "terminal", "test", 100))],
    *[("ds2", e, "perplexity", a, s, 1) for e in ("e04", "e05") for a, s in (("epoch", "valid"), ("update", "train"), ("terminal", "test")) if (e, a) != ("e04", "update")],
    *[("ds2", e, "exact_match", a, s, 1) for e in ("e06", "e07") for a, s in (("epoch", "valid"), ("update", "train"), ("terminal", "test"))],
    ("ds2", "e02", "hit_at_5", "epoch", "test", 100), ("ds2", "e02", "loss", "epoch", "valid", 1), ("ds2", "e12", "loss", "epoch", "valid", 1),
]
for _v, _e, _m, _a, _s, _k in _STUDIES:
    _sql = _PICKED.format(_v, _e) + f", h AS (SELECT p.condition, e.run_id, e.step, e.value * {_k} AS value FROM eh e JOIN picked p USING (run_id) WHERE e.metric = '{_m}' AND e.axis = '{_a}' AND e.split = '{_s}') " + CURVE.format("condition", "h")
    add(f"study_{_v}_{_e}_{_m}_{_a}", "conditions", "runs", "evaluations", sql=_sql)(_metric_study(_v, _e, _m, _a, _s, float(_k)))
