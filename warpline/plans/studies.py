"""Queries on fallback chains, look-ups, manifests, and reports of the run store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions.numeric import finite, half_up, r6
from warpline.operators import corpus as C
from warpline.operators import fallbacks as B
from warpline.operators import runs as R
from warpline.operators import tensors as T
from warpline.plans.registry import Registry
from warpline.plans.run_analytics import ATTEMPTS, FIN, HIST
from warpline.plans.texts_and_vectors import ANALOGY, TOKENS

registry = Registry()
add = registry.add

_LONG = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), long AS (SELECT vec_id AS i, label, unnest(range(len(e)))::INT AS j, unnest(e) AS v FROM v)"


def _cells(e: DataFrame) -> DataFrame:
    """(i, label, j, v)"""
    return T.long_form(e, "vec_id", "embedding").join(e.select(F.col("vec_id").alias("i"), "label"), "i")


_FIRST = ", f AS (SELECT {0}, min(origin) AS origin FROM s GROUP BY ALL) SELECT s.* FROM s JOIN f USING ({0}, origin)"
_POINTS = "SELECT {keys}, ({step})::BIGINT AS step, max({value}) AS value, {k} AS origin FROM {table} WHERE {where} AND ({step}) IS NOT NULL AND " + FIN.format("{value}") + " GROUP BY ALL"
add("curve_loss_fallback", "metrics", "evaluations", "updates", sql="WITH s AS (" + " UNION ALL ".join((
    _POINTS.format(keys="run_id", step="step - 1", value="value", k=1, table="metrics", where="metric_key = 'update/train/loss'"),
    _POINTS.format(keys="run_id", step="axis_step - 1", value="value", k=2, table="evaluations", where="axis = 'update' AND split = 'train' AND metric = 'loss'"),
    _POINTS.format(keys="run_id", step="update_no - 1", value="loss", k=3, table="updates", where="true"),
)) + ")" + _FIRST.format("run_id"))(B.loss_curves)
add("curve_accuracy_fallback", "evaluations", sql="WITH s AS (" + " UNION ALL ".join(
    _POINTS.format(keys="canonical_condition_id AS condition, run_id", step=step, value="value", k=k, table="evaluations", where=f"metric = 'accuracy' AND axis = '{axis}' AND split = '{split}'")
    for k, axis, split, step in ((1, "epoch", "valid", "axis_step"), (2, "update", "train", "axis_step"), (3, "terminal", "test", "0"))
) + ")" + _FIRST.format("condition"))(B.accuracy_curves)


@add("history_axis", "evaluations", sql=f"SELECT run_id, metric, CASE WHEN metric = 'accuracy' THEN coalesce(epoch, update_no, axis_step) ELSE coalesce(update_no, epoch, axis_step) END::BIGINT AS x, max(value) AS value FROM evaluations WHERE {FIN.format('value')} GROUP BY ALL")
def history_axis(e):
    """The evaluations on the axis that suits their metric."""
    return B.axis_of(e.where(finite("value"))).groupBy("run_id", "metric", "x").agg(F.max("value").alias("value"))


@add("history_percent", "evaluations", sql=HIST + "SELECT run_id, metric, step, round(max(value) * 100, 6) + 0.0 AS value FROM eh WHERE metric IN ('accuracy', 'hit_at_5') AND axis = 'epoch' GROUP BY ALL")
def history_percent(e):
    h = R.evaluation_history(e).where("metric IN ('accuracy', 'hit_at_5') AND axis = 'epoch'")
    return h.groupBy("run_id", "metric", "step").agg(r6(F.max("value") * 100).alias("value"))


add("metric_last_recorded", "metrics", sql=f"SELECT run_id, metric_key, max({{'l': logged_ms, 'r': received_at, 'v': value}}).v AS value FROM metrics WHERE {FIN.format('value')} GROUP BY ALL")(B.last_recorded)
add("memory_peak", "metrics", sql=f"SELECT run_id, max(value) AS peak FROM metrics WHERE metric_key = 'system/gpu_used_bytes' AND {FIN.format('value')} GROUP BY 1")(
    lambda m: m.where((F.col("metric_key") == "system/gpu_used_bytes") & finite("value")).groupBy("run_id").agg(F.max("value").alias("peak"))
)


@add("perplexity_collected", "evaluations", sql=HIST + "SELECT condition, step, list(round(value, 4) + 0.0 ORDER BY round(value, 4) + 0.0) AS perplexities FROM eh WHERE metric = 'perplexity' AND axis = 'epoch' AND split = 'valid' GROUP BY ALL")
def perplexity_collected(e):
    """The validation perplexities of the runs of a condition at each epoch; as many as its runs."""
    h = R.evaluation_history(e).where("metric = 'perplexity' AND axis = 'epoch' AND split = 'valid'")
    return h.groupBy("condition", "step").agg(F.array_sort(F.collect_list(r6(F.col("value"), 4))).alias("perplexities"))


@add("evaluation_subset", "eval_items", sql="SELECT item_set, count(*) AS full_items, count(*) FILTER (WHERE pos < 20) AS subset_items, (sum(item_id) FILTER (WHERE pos < 20))::BIGINT AS subset_ids FROM (SELECT *, row_number() OVER (PARTITION BY item_set ORDER BY item_id) - 1 AS pos FROM eval_items) GROUP BY 1")
def evaluation_subset(items):
    """The first 20 items of each set, as evaluated on the way, and all of them, as evaluated at the end."""
    placed = items.withColumn("pos", F.row_number().over(Window.partitionBy("item_set").orderBy("item_id")) - 1)
    first = F.col("pos") < 20
    return placed.groupBy("item_set").agg(F.count("*").alias("full_items"), F.count_if(first).alias("subset_items"), F.sum(F.when(first, F.col("item_id"))).alias("subset_ids"))


add("distinct_words_in_order", "documents", sql=TOKENS + "SELECT doc_id, list(word ORDER BY pos) AS words FROM (SELECT doc_id, word, min(pos) AS pos FROM tokens GROUP BY ALL) GROUP BY 1")(
    lambda d: C.tokens(d).groupBy("doc_id", "word").agg(F.min("pos").alias("pos")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]).alias("words"))
)


@add("plan_order", "runs", sql=ATTEMPTS + "SELECT condition, seed, row_number() OVER (PARTITION BY condition ORDER BY NOT regexp_full_match(seed, '[0-9]+'), lpad(seed, 20, '0'), seed) AS place FROM (SELECT DISTINCT condition, seed FROM att)")
def plan_order(runs):
    """The seeds of each condition in the order in which they are run: numbers first, by value."""
    w = Window.partitionBy("condition").orderBy(~F.col("seed").rlike("^[0-9]+$"), F.lpad("seed", 20, "0"), "seed")
    return R.attempts(runs).select("condition", "seed").distinct().withColumn("place", F.row_number().over(w))


@add("studies_merged", "conditions", "runtime_estimates", sql="""SELECT condition, list(DISTINCT study ORDER BY study) AS studies FROM (
  SELECT canonical_condition_id AS condition, volume || '/' || experiment_id AS study FROM conditions UNION ALL SELECT canonical_condition_id, 'timing/' || experiment_id FROM runtime_estimates WHERE experiment_id IS NOT NULL) GROUP BY 1""")
def studies_merged(conditions, estimates):
    """The conditions of all studies with the studies that have them."""
    a = conditions.select(F.col("canonical_condition_id").alias("condition"), F.concat_ws("/", "volume", "experiment_id").alias("study"))
    b = estimates.where("experiment_id is not null").select(F.col("canonical_condition_id").alias("condition"), F.concat(F.lit("timing/"), "experiment_id").alias("study"))
    return a.unionByName(b).groupBy("condition").agg(F.array_sort(F.collect_set("study")).alias("studies"))


@add("state_keys_equal", "runs", "restored_runs", sql="""WITH a AS (SELECT lower(regexp_replace(run_id, '[\\s\\-]+', '', 'g')) AS key, list(DISTINCT k ORDER BY k) AS ours FROM (SELECT run_id, unnest(map_keys(params)) AS k FROM runs) GROUP BY 1),
b AS (SELECT lower(regexp_replace(original_run_id, '[\\s\\-]+', '', 'g')) AS key, list(DISTINCT k ORDER BY k) AS theirs FROM (SELECT original_run_id, unnest(map_keys(params)) AS k FROM restored_runs) GROUP BY 1)
SELECT key, ours = theirs AS same FROM a JOIN b USING (key)""")
def state_keys_equal(runs, restored):
    """Whether both stores know a run's state under the same keys."""
    from warpline.functions.keys import bare_id

    keys = lambda df, c, n: df.select(bare_id(c).alias("key"), F.explode(F.map_keys("params")).alias("k")).groupBy("key").agg(F.array_sort(F.collect_set("k")).alias(n))
    return keys(runs, "run_id", "ours").join(keys(restored, "original_run_id", "theirs"), "key").select("key", (F.col("ours") == F.col("theirs")).alias("same"))


@add("identity_keys", "runs", sql=ATTEMPTS + """SELECT run_id, CASE run_type WHEN 'seed_trial' THEN condition || '|' || seed || '|' || protocol || '|' || attempt WHEN 'condition_parent' THEN condition || '|' || variant ELSE run_id END AS identity FROM att""")
def identity_keys(runs):
    """What a run is known by, which depends on its type; null where a part is."""
    part = lambda *c: F.concat(*[x for k in c for x in (F.lit("|"), F.col(k).cast("string"))][1:])
    kind = F.col("run_type")
    return R.attempts(runs).select("run_id", F.when(kind == "seed_trial", part("condition", "seed", "protocol", "attempt")).when(kind == "condition_parent", part("condition", "variant")).otherwise(F.col("run_id")).alias("identity"))


@add("runs_looked_up", "runs", "conditions", sql=ATTEMPTS + """, s AS (SELECT condition, count(DISTINCT run_id) AS n, min(run_id) AS run_id FROM att WHERE run_type = 'condition_parent' AND lifecycle = 'active' GROUP BY 1)
SELECT c.condition, CASE WHEN n IS NULL THEN 'absent' WHEN n = 1 THEN 'found' ELSE 'conflict' END AS state, CASE WHEN n = 1 THEN run_id END AS run_id FROM (SELECT DISTINCT canonical_condition_id AS condition FROM conditions) c LEFT JOIN s USING (condition)""")
def runs_looked_up(runs, conditions):
    """The active parent run of each condition, if there is just one."""
    stored = R.attempts(runs).where("run_type = 'condition_parent' AND lifecycle = 'active'")
    return B.look_up(conditions.select(F.col("canonical_condition_id").alias("condition")), stored, ["condition"], "run_id")


@add("profile_latest", "runtime_estimates", sql=f"""SELECT canonical_condition_id AS condition, device, max({{'m': measured_at, 'e': estimate_id, 's': seconds_per_update}}).s AS seconds FROM runtime_estimates WHERE {FIN.format('seconds_per_update')} AND seconds_per_update > 0 AND benchmark_updates >= 10 GROUP BY ALL""")
def profile_latest(r):
    """The newest usable measurement of each condition and device with at least ten updates."""
    v = F.col("seconds_per_update")
    newest = F.max(F.struct("measured_at", "estimate_id", v.alias("s")))["s"]
    return r.where(finite(v) & (v > 0) & (F.col("benchmark_updates") >= 10)).groupBy(F.col("canonical_condition_id").alias("condition"), "device").agg(newest.alias("seconds"))


@add("objective_pairs", "runtime_estimates", sql=f"""WITH m AS (SELECT canonical_condition_id AS c, avg(seconds_per_update) AS s FROM (SELECT DISTINCT * FROM runtime_estimates) WHERE {FIN.format('seconds_per_update')} GROUP BY 1)
SELECT left(a.c, length(a.c) - 5) AS pair, round(a.s + 1e-9, 4) + 0.0 AS full_softmax, round(b.s + 1e-9, 4) + 0.0 AS sampled, round(a.s / b.s + 1e-9, 4) + 0.0 AS ratio FROM m a JOIN m b ON left(a.c, length(a.c) - 5) || '-NEG' = b.c WHERE a.c LIKE '%-SOFT'""")
def objective_pairs(r):
    """The time of an update with the full softmax and with sampled negatives, of the same model."""
    m = r.where(finite("seconds_per_update")).dropDuplicates().groupBy(F.col("canonical_condition_id").alias("c")).agg(F.avg("seconds_per_update").alias("s"))
    side = lambda end, n: m.where(F.col("c").endswith(end)).select(F.regexp_replace("c", f"{end}$", "").alias("pair"), F.col("s").alias(n))
    both = side("-SOFT", "a").join(side("-NEG", "b"), "pair")
    return both.select("pair", half_up(F.col("a"), 4).alias("full_softmax"), half_up(F.col("b"), 4).alias("sampled"), half_up(F.col("a") / F.col("b"), 4).alias("ratio"))


_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"lower(metric_key) LIKE '%{p.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}'" for p in parts) + f" THEN '{k}'" for k, parts in B.KERNELS) + " ELSE 'other' END"


@add("kernel_summary", "metrics", sql=f"SELECT {_KIND} AS kind, metric_key AS name, count(*) AS n, round(sum(value) / count(*), 6) + 0.0 AS mean FROM metrics WHERE {FIN.format('value')} AND abs(value) < 1e6 GROUP BY ALL")
def kernel_summary(m):
    """Counts and means by kind and name, the kind being told from the name; values of a million and more, such as bytes, are no times."""
    rows = m.where(finite("value") & (F.abs("value") < 1e6))
    return rows.groupBy(B.kernel_kind(F.col("metric_key")).alias("kind"), F.col("metric_key").alias("name")).agg(F.count("*").alias("n"), r6(F.sum("value") / F.count("*")).alias("mean"))


@add("kernel_gaps", "metrics", sql=f"""WITH g AS (SELECT kind, logged_ms - lag(logged_ms) OVER (PARTITION BY run_id ORDER BY logged_ms, kind) AS gap FROM (SELECT DISTINCT run_id, logged_ms, {_KIND} AS kind FROM metrics WHERE logged_ms IS NOT NULL))
SELECT kind, count(*) AS gaps, sum(gap)::BIGINT AS total FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def kernel_gaps(m):
    """The times between launches by the kind of what was launched."""
    return B.launch_gaps(m.where("logged_ms is not null").select("run_id", "logged_ms", B.kernel_kind(F.col("metric_key")).alias("kind")).distinct(), "run_id", "logged_ms", "kind")


@add("parameter_counts", "embeddings", sql="SELECT label, count(*) AS parameters, sum(len(embedding))::BIGINT AS elements, 0::BIGINT AS duplicates, (sum(len(embedding)) * 4)::BIGINT AS parameter_bytes, (sum(len(embedding)) * 4)::BIGINT AS gradient_bytes, (sum(len(embedding)) * 8)::BIGINT AS state_bytes FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1")
def parameter_counts(e):
    """Each label's vectors as the parameters of a model."""
    return B.parameter_counts(e.where("embedding is not null"), "label", "vec_id", F.size("embedding"))


@add("parameter_consistency", "runs", sql=ATTEMPTS + """SELECT condition, CASE WHEN min(h) = max(h) THEN min(h) END AS value, count(DISTINCT h) AS "distinct" FROM att JOIN (SELECT run_id, max(try_cast(params['model/hidden_size'] AS BIGINT)) AS h FROM runs GROUP BY 1) USING (run_id) GROUP BY 1""")
def parameter_consistency(runs):
    """The size of a condition's model, if all its runs agree."""
    h = runs.groupBy("run_id").agg(F.max(F.col("params")["model/hidden_size"].try_cast("bigint")).alias("h"))
    return B.one_value(R.attempts(runs).join(h, "run_id"), ["condition"], F.col("h"))


@add("summary_with_counts", "runs", "embeddings", sql=ATTEMPTS + """SELECT condition AS name, 'runs' AS item, count(*) AS n, NULL::BIGINT AS elements FROM att WHERE condition IS NOT NULL GROUP BY 1
UNION ALL SELECT label::VARCHAR, 'parameters', count(*), sum(len(embedding))::BIGINT FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1""")
def summary_with_counts(runs, e):
    """A summary of runs with the rows of parameter counts appended; columns that one of them lacks are null."""
    a = R.attempts(runs).where("condition is not null").groupBy(F.col("condition").alias("name")).agg(F.count("*").alias("n")).withColumn("item", F.lit("runs"))
    b = parameter_counts(e).select(F.col("label").cast("string").alias("name"), F.lit("parameters").alias("item"), F.col("parameters").alias("n"), "elements")
    return a.unionByName(b, allowMissingColumns=True).select("name", "item", "n", "elements")


_PARTS = _LONG + ", c AS (SELECT label AS example, j // 8 AS step, j % 8 AS position, (i // 10) % 3 AS seed, avg(v) AS v FROM long GROUP BY ALL)"


def _attention_cells(e):
    """Means of parts of the vectors as the attention of three seeds on an example (label)."""
    rows = _cells(e).groupBy(F.col("label").alias("example"), F.expr("j div 8").cast("int").alias("step"), (F.col("j") % 8).alias("position"), F.expr("(i div 10) % 3").alias("seed"))
    return rows.agg(F.avg("v").alias("v"))


add("attention_common_cells", "embeddings", sql=_PARTS + "SELECT example, step, position FROM c WHERE v > 0 GROUP BY ALL HAVING count(DISTINCT seed) = 3")(lambda e: B.common_cells(_attention_cells(e).where("v > 0"), ["example"], ["step", "position"], "seed"))


@add("attention_summary", "embeddings", sql=_PARTS + "SELECT example, step, position, round(avg(v), 6) + 0.0 AS mean, round(min(v), 6) + 0.0 AS minimum, round(max(v), 6) + 0.0 AS maximum, count(*) AS seeds FROM (SELECT * REPLACE (CASE WHEN v > -0.02 THEN v END AS v) FROM c) WHERE v IS NOT NULL GROUP BY ALL")
def attention_summary(e):
    """Mean, least and most over the seeds of each cell; NaN cells (here those below -0.02) are left out."""
    nan = _attention_cells(e).withColumn("v", F.when(F.col("v") > -0.02, F.col("v")).otherwise(float("nan")))
    return nan.where(~F.isnan("v")).groupBy("example", "step", "position").agg(r6(F.avg("v")).alias("mean"), r6(F.min("v")).alias("minimum"), r6(F.max("v")).alias("maximum"), F.count("*").alias("seeds"))


@add("gradient_check", "embeddings", sql=_LONG + "SELECT j, round(avg(d), 5) + 0.0 AS mean, round(stddev_pop(d), 5) + 0.0 AS sd FROM (SELECT j, abs((pow(v + 0.1, 3) - pow(v - 0.1, 3)) / 0.2 - 3 * v * v) AS d FROM long) GROUP BY 1")
def gradient_check(e):
    """How far the central differences of x³ (h = 0.1) are from 3x², for each component as a parameter."""
    x = F.col("v")
    d = F.abs((F.pow(x + 0.1, F.lit(3)) - F.pow(x - 0.1, F.lit(3))) / 0.2 - 3 * x * x)
    return T.long_form(e, "vec_id", "embedding").groupBy("j").agg(r6(F.avg(d), 5).alias("mean"), r6(F.stddev_pop(d), 5).alias("sd"))


@add("sequence_predictions", "eval_items", sql="""WITH l AS (SELECT item_id, unnest(range(len(x)))::INT AS line, unnest(x) AS s FROM (SELECT item_id, string_split(text, chr(10)) AS x FROM eval_items WHERE item_set = 'sum_test')),
p AS (SELECT item_id, line, trim(split_part(s, '_', 2)) AS correct, CAST(try_cast(regexp_extract(s, '^([0-9]+)\\+', 1) AS BIGINT) + try_cast(regexp_extract(s, '\\+([0-9]+)', 1) AS BIGINT) AS VARCHAR) AS guess FROM l WHERE instr(s, '_') > 0)
SELECT item_id, line, correct, guess, guess = correct AS right_, len(list_filter(list_zip(string_split(correct, ''), string_split(guess, '')), lambda z: z[1] = z[2])) AS token_correct FROM p""")
def sequence_predictions(items):
    """The answers to the sums, those expected, and how many of their characters agree."""
    s = items.where("item_set = 'sum_test'").select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).where("instr(s, '_') > 0")
    part = lambda p: F.regexp_extract("s", p, 1).try_cast("bigint")
    rows = s.select("item_id", "line", F.trim(F.split("s", "_")[1]).alias("correct"), (part(r"^([0-9]+)\+") + part(r"\+([0-9]+)")).cast("string").alias("guess"))
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    agree = F.size(F.filter(F.zip_with(chars("correct"), chars("guess"), lambda a, b: a == b), lambda x: x)).cast("bigint")
    return rows.select("item_id", "line", "correct", "guess", (F.col("guess") == F.col("correct")).alias("right_"), agree.alias("token_correct"))


@add("report_rows", "embeddings", sql=ANALOGY + """, u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS n FROM v WHERE list_dot_product(e, e) > 0)
SELECT 'similarity' AS kind, query_id, vec_id, round(s, 6) + 0.0 AS score, rank FROM (SELECT q.vec_id AS query_id, u.vec_id, list_dot_product(q.n, u.n) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.n, u.n) DESC, u.vec_id)::INT AS rank FROM u q JOIN u ON u.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5
UNION ALL SELECT 'analogy', query_id, vec_id, round(s, 6) + 0.0, rank FROM r WHERE rank <= 5""".replace(", u AS (", ", u2 AS (", 1).replace("FROM u q JOIN u ON u.vec_id", "FROM u2 q JOIN u2 u ON u.vec_id"))
def report_rows(e):
    """The nearest vectors and the analogies of the stated queries as one long report."""
    from warpline.operators import vectors as V

    return V.nearest(e).withColumn("kind", F.lit("similarity")).unionByName(V.analogies(e).withColumn("kind", F.lit("analogy"))).select("kind", "query_id", "vec_id", "score", "rank")


@add("params_canonical_json", "runs", sql="""SELECT run_id, '{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}' AS document FROM (SELECT DISTINCT run_id, unnest(map_keys(p)) AS k, unnest(map_values(p)) AS v FROM (SELECT run_id, map_from_entries([{'k': e.key, 'v': e.value} for e in map_entries(params) if NOT starts_with(e.key, 'code/') AND NOT starts_with(e.key, 'seed/') AND NOT contains(e.value, '"')]) AS p FROM runs)) GROUP BY 1 HAVING count(*) = count(DISTINCT k)""")
def params_canonical_json(runs):
    """The params that tell a condition, as JSON with sorted keys, of the runs that were delivered with one set of them."""
    kept = F.map_filter("params", lambda k, v: ~k.startswith("code/") & ~k.startswith("seed/") & ~v.contains('"'))
    entries = runs.select("run_id", F.explode(kept).alias("k", "v")).distinct()
    one = entries.groupBy("run_id").agg(F.collect_list(F.struct("k", "v")).alias("e"), F.count("*").alias("n"), F.count_distinct("k").alias("d")).where("n = d")
    return one.select("run_id", B.canonical_json(F.map_from_entries("e")).alias("document"))


@add("uri_keys", "checkpoints", sql="SELECT DISTINCT path, sha256(regexp_replace('store://user:' || kind || '@host/' || path, '://[^/@]*@', '://')) AS uri_key FROM checkpoints WHERE path IS NOT NULL AND kind IS NOT NULL")
def uri_keys(c):
    """The keys of the checkpoints' addresses; whoever asks for one, it is the same."""
    uri = F.concat(F.lit("store://user:"), "kind", F.lit("@host/"), "path")
    return c.where("path is not null and kind is not null").select("path", B.uri_key(uri).alias("uri_key")).distinct()


@add("seed_streams", "runs", sql=ATTEMPTS + f"SELECT DISTINCT seed::BIGINT AS master, unnest(range(1, {len(B.STREAMS) + 1})) AS stream, seed::BIGINT + 10000 * unnest(range(1, {len(B.STREAMS) + 1})) AS value FROM att WHERE regexp_full_match(seed, '[0-9]+')")
def seed_streams(runs):
    """The seeds of the streams that one master seed gives, 10,000 apart."""
    master = R.attempts(runs).where(F.col("seed").rlike("^[0-9]+$")).select(F.col("seed").cast("bigint").alias("master")).distinct()
    return master.withColumn("stream", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(len(B.STREAMS)).cast("bigint")))).withColumn("value", F.col("master") + 10_000 * F.col("stream"))


@add("runs_serialised", "metrics", sql=f"SELECT run_id, metric_key, list(step ORDER BY step, logged_ms, value) AS steps, list(logged_ms ORDER BY step, logged_ms, value) AS times, list(value ORDER BY step, logged_ms, value) AS \"values\" FROM (SELECT DISTINCT run_id, metric_key, step, logged_ms, value FROM metrics WHERE {FIN.format('value')} AND step IS NOT NULL AND logged_ms IS NOT NULL) GROUP BY ALL")
def runs_serialised(m):
    """All points of each series of a run, as they are handed on: a series is one row, as in the archive that it goes to."""
    rows = m.where(finite("value") & F.col("step").isNotNull() & F.col("logged_ms").isNotNull()).select("run_id", "metric_key", F.struct("step", "logged_ms", "value").alias("p")).distinct()
    p = rows.groupBy("run_id", "metric_key").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return p.select("run_id", "metric_key", F.col("p.step").alias("steps"), F.col("p.logged_ms").alias("times"), F.col("p.value").alias("values"))


@add("parameter_renamed", "embeddings", sql="SELECT DISTINCT 'param__W' || label AS name, 'layer.' || label || '.W' AS renamed FROM embeddings WHERE label IS NOT NULL")
def parameter_renamed(e):
    """Names of an older store in the form of the present one."""
    name = F.concat(F.lit("param__W"), "label")
    return e.where("label is not null").select(name.alias("name"), F.regexp_replace(name, "^param__([A-Za-z]+)([0-9]+)$", "layer.$2.$1").alias("renamed")).distinct()


@add("embedding_alias", "embeddings", sql="SELECT vec_id, len(embedding) AS size, CASE WHEN vec_id % 2 = 0 THEN 'word_vectors' ELSE 'W_in' END AS stored_as FROM embeddings WHERE embedding IS NOT NULL")
def embedding_alias(e):
    """The matrix under whichever of its names it is stored: here every other row under the older one."""
    even = F.col("vec_id") % 2 == 0
    stored = e.where("embedding is not null").select("vec_id", F.when(even, F.col("embedding")).alias("word_vectors"), F.when(~even, F.col("embedding")).alias("W_in"))
    return stored.select("vec_id", F.size(F.coalesce("W_in", "word_vectors")).cast("bigint").alias("size"), F.when(F.col("W_in").isNotNull(), "W_in").otherwise("word_vectors").alias("stored_as"))


@add("original_summary", "runs", "evaluations", sql=ATTEMPTS + ", " + HIST.strip().removeprefix("WITH ") + """, o AS (SELECT run_id, condition FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY start_time DESC NULLS LAST, run_id) AS k FROM att WHERE variant = 'original' AND status = 'FINISHED' AND run_type = 'seed_trial') WHERE k = 1)
SELECT o.condition, e.metric, 1 AS seed_runs, round(max({'s': e.step, 'v': e.value}).v, 6) + 0.0 AS mean, 0.0::DOUBLE AS sd FROM o JOIN eh e USING (run_id) WHERE e.axis = 'epoch' AND e.split IN ('test', 'valid') GROUP BY ALL""")
def original_summary(runs, evaluations):
    """The last values of the newest original run of each condition: one run, so no spread."""
    o = R.newest(R.attempts(runs).where("variant = 'original' AND status = 'FINISHED' AND run_type = 'seed_trial'").select("condition", "run_id", "start_time"), ["condition"]).select("condition", "run_id")
    h = R.evaluation_history(evaluations).where("axis = 'epoch' AND split IN ('test', 'valid')").drop("condition").join(o, "run_id")
    return h.groupBy("condition", "metric").agg(F.lit(1).alias("seed_runs"), r6(F.max(F.struct("step", "value"))["value"]).alias("mean"), F.lit(0.0).alias("sd"))


add("checkpoint_roles", "checkpoints", sql="""WITH k AS (SELECT run_id, kind, max({'u': update_no, 'p': path}).p AS path FROM checkpoints GROUP BY ALL), w AS (SELECT run_id, max(path) FILTER (WHERE kind = 'latest') AS l, max(path) FILTER (WHERE kind = 'best') AS b, max(path) FILTER (WHERE kind = 'final') AS f FROM k GROUP BY 1),
r AS (SELECT run_id, 'latest' AS role, coalesce(l, f) AS path FROM w UNION ALL SELECT run_id, 'best', b FROM w UNION ALL SELECT run_id, 'final', f FROM w),
d AS (SELECT run_id, path, count(DISTINCT regexp_replace(lower(sha256), '[\\s\\-]+|sha256[:=]', '', 'g')) AS n FROM checkpoints WHERE sha256 IS NOT NULL GROUP BY ALL)
SELECT run_id, role, path, CASE WHEN path IS NULL THEN 'missing' WHEN n > 1 THEN 'conflict' ELSE 'ok' END AS state FROM r LEFT JOIN d USING (run_id, path)""")(B.file_roles)


@add("summary_markdown", "conditions", sql="""SELECT 0 AS place, '| task | conditions | model |' AS line UNION ALL SELECT 1, '|---|---|---|'
UNION ALL SELECT (row_number() OVER (ORDER BY task) + 1)::INT, '| ' || task || ' | ' || n || ' | ' || model || ' |' FROM (SELECT task, count(*) AS n, min(model) AS model FROM conditions GROUP BY 1)""")
def summary_markdown(c):
    return B.markdown(c.groupBy("task").agg(F.count("*").alias("conditions"), F.min("model").alias("model")), ["task", "conditions", "model"], ["task"])


@add("result_stems", "conditions", sql="SELECT canonical_condition_id AS condition, volume || '/' || experiment_id || '/' || regexp_replace(lower(canonical_condition_id), '[^a-z0-9]+', '_', 'g') AS stem FROM conditions")
def result_stems(c):
    """The folder and name that a condition's results are stored under."""
    return c.select(F.col("canonical_condition_id").alias("condition"), F.concat_ws("/", "volume", "experiment_id", F.regexp_replace(F.lower("canonical_condition_id"), "[^a-z0-9]+", "_")).alias("stem"))


@add("corpus_slice", "documents", sql=TOKENS + ", first AS (SELECT word FROM tokens WHERE pos < 100), SELECT_ AS (SELECT max(word_id) + 1 AS words, (SELECT count(*) FROM first) AS tokens FROM vocab WHERE word IN (SELECT word FROM first)) SELECT * FROM SELECT_")
def corpus_slice(d):
    """The slice of a training text: the first 100 tokens of every document, and the words that its model must know."""
    first = C.tokens(d).where("pos < 100")
    known = C.vocabulary(C.tokens(d)).join(first.select("word").distinct(), "word", "left_semi").agg((F.max("word_id") + 1).alias("words"))
    return known.crossJoin(first.agg(F.count("*").alias("tokens")))


@add("ids_synthetic", "conditions", sql="SELECT canonical_condition_id AS condition, t AS pos, (t * 48271 + recording_every * 7919) % 1000 AS id FROM conditions, range(64) r(t)")
def ids_synthetic(c):
    """Batches of 64 made-up ids for timing, seeded by the condition."""
    return c.select(F.col("canonical_condition_id").alias("condition"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))).alias("pos"), "recording_every").select("condition", "pos", F.pmod(F.col("pos") * 48271 + F.col("recording_every") * 7919, F.lit(1000)).alias("id"))
