"""Queries of the general operators for pipelines of training data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from warpline.operators import copydiff, drift, grid, references, spikes
from warpline.plans.registry import Registry

registry = Registry()

_BARE = "lower(regexp_replace({0}, '[\\s\\-]+', '', 'g'))"
P2_SQL = f"""
WITH every_of AS (SELECT DISTINCT canonical_condition_id, recording_every, eval_every FROM conditions),
step_of_run AS (
  SELECT r.key, coalesce(r.own, c.recording_every) AS every FROM (
    SELECT {_BARE.format('run_id')} AS key, max(try_cast(trim(params['recording/every']) AS BIGINT)) AS own, max(canonical_condition_id) AS canonical_condition_id
    FROM runs GROUP BY 1) r LEFT JOIN every_of c USING (canonical_condition_id)),
readings AS (
  SELECT 'metrics' AS source, m.run_id, m.metric_key AS series, s.every, m.step::DOUBLE AS step, m.value
  FROM metrics m JOIN step_of_run s ON {_BARE.format('m.run_id')} = s.key
  UNION ALL
  SELECT 'evaluations', e.run_id, concat_ws('/', axis, split, metric), CASE WHEN axis = 'epoch' THEN 1 ELSE c.eval_every END, axis_step::DOUBLE, value
  FROM evaluations e LEFT JOIN every_of c USING (canonical_condition_id) WHERE axis IN ('epoch', 'update')
  UNION ALL
  SELECT 'curves', curve_id::VARCHAR, axis, every, unnest(steps), unnest(mean) FROM curves),
cells AS (
  SELECT DISTINCT source, run_id, series, every, floor(step / every)::BIGINT AS slot FROM readings
  WHERE every > 0 AND step IS NOT NULL AND value IS NOT NULL AND isfinite(value)),
gaps AS (SELECT *, lead(slot) OVER (PARTITION BY source, run_id, series, every ORDER BY slot) AS following FROM cells)
SELECT source, run_id, series, unnest(range(slot + 1, following)) * every AS slot_start FROM gaps WHERE following > slot + 1
"""

_TEXT = """CASE WHEN regexp_full_match(trim({0}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'n:' || (trim({0})::DOUBLE + 0.0)::VARCHAR
  WHEN lower(trim({0})) IN ('true', 'false') THEN 'b:' || lower(trim({0})) ELSE 's:' || coalesce(trim({0}), '') END"""
P3_SQL = f"""
WITH source AS (
  SELECT {_BARE.format('run_id')} AS key, arg_max(params, received_at) AS params FROM runs WHERE tags['transfer.batch'] IS NOT NULL GROUP BY 1),
target AS (
  SELECT {_BARE.format('original_run_id')} AS key, arg_max(params, restored_at) AS params, arg_max(metrics, restored_at) AS metrics FROM restored_runs GROUP BY 1),
absent AS (
  SELECT key, 'run' AS item_kind, '' AS item_name, -1 AS step, -1 AS logged_ms, CASE WHEN t.key IS NULL THEN 'missing_in_target' ELSE 'missing_in_source' END AS difference
  FROM source s FULL JOIN target t USING (key) WHERE s.key IS NULL OR t.key IS NULL),
there AS (SELECT key FROM source SEMI JOIN target USING (key)),
pa AS (SELECT key, unnest(map_keys(params)) AS item_name, unnest(map_values(params)) AS v FROM source SEMI JOIN there USING (key)),
pb AS (SELECT key, unnest(map_keys(params)) AS item_name, unnest(map_values(params)) AS v FROM target SEMI JOIN there USING (key)),
params AS (
  SELECT coalesce(a.key, b.key) AS key, 'param' AS item_kind, coalesce(a.item_name, b.item_name) AS item_name, -1 AS step, -1 AS logged_ms,
    CASE WHEN b.key IS NULL THEN 'missing_in_target' WHEN a.key IS NULL THEN 'missing_in_source' ELSE 'differs' END AS difference
  FROM pa a FULL JOIN pb b ON a.key = b.key AND a.item_name = b.item_name
  WHERE a.key IS NULL OR b.key IS NULL OR {_TEXT.format('a.v')} <> {_TEXT.format('b.v')}),
ma AS (SELECT DISTINCT {_BARE.format('run_id')} AS key, metric_key, step, logged_ms, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM metrics WHERE {_BARE.format('run_id')} IN (SELECT key FROM there)),
mb AS (SELECT DISTINCT key, m.metric_key, m.step, m.logged_ms, CASE WHEN isnan(m.value) THEN NULL ELSE m.value END AS v FROM (SELECT key, unnest(metrics) AS m FROM target SEMI JOIN there USING (key))),
readings AS (
  SELECT coalesce(a.key, b.key) AS key, 'metric' AS item_kind, coalesce(a.metric_key, b.metric_key) AS item_name, coalesce(a.step, b.step) AS step, coalesce(a.logged_ms, b.logged_ms) AS logged_ms,
    CASE WHEN b.key IS NULL THEN 'missing_in_target' WHEN a.key IS NULL THEN 'missing_in_source' ELSE 'differs' END AS difference
  FROM ma a FULL JOIN mb b ON a.key = b.key AND a.metric_key = b.metric_key AND a.step = b.step AND a.logged_ms = b.logged_ms
  WHERE a.key IS NULL OR b.key IS NULL OR (a.v IS NULL) <> (b.v IS NULL) OR (a.v <> b.v AND (isinf(a.v) OR isinf(b.v) OR abs(a.v - b.v) > 1e-6 * greatest(abs(a.v), abs(b.v)))))
SELECT key AS original_run_id, item_kind, item_name, step::BIGINT AS step, logged_ms::BIGINT AS logged_ms, difference
FROM (SELECT * FROM absent UNION ALL SELECT * FROM params UNION ALL SELECT * FROM readings)
"""

_PATH = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[/\\\\]+', '/', 'g'), '^(\\./)+', ''), '/$', '')"
_DIGEST = "regexp_replace(" + _BARE + ", '^[a-z]+[0-9]*[:=]', '')"
P6_BROKEN = f"""
WITH refs AS (
  SELECT 'parent_run' AS ref_field, 'runs' AS ref_table, run_id AS record_id, {_BARE.format("tags['mlflow.parentRunId']")} AS key, min(received_at) AS seen_at FROM runs GROUP BY ALL
  UNION ALL SELECT 'checkpoint_path', 'checkpoints', checkpoint_id, {_PATH.format('path')}, min(saved_at) FROM checkpoints GROUP BY ALL
  UNION ALL SELECT 'checkpoint_sha256', 'checkpoints', checkpoint_id, {_DIGEST.format('sha256')}, min(saved_at) FROM checkpoints GROUP BY ALL),
targets AS (
  SELECT 'parent_run' AS ref_field, {_BARE.format('run_id')} AS key, coalesce(lifecycle_stage, 'active') <> 'deleted' AS alive, received_at AS seen_at FROM runs
  UNION ALL SELECT 'checkpoint_path', {_PATH.format('path')}, deleted_at IS NULL, stored_at FROM checkpoint_files
  UNION ALL SELECT 'checkpoint_sha256', {_DIGEST.format('sha256')}, deleted_at IS NULL, stored_at FROM checkpoint_files),
states AS (SELECT ref_field, key, bool_or(alive) AS alive, min(seen_at) FILTER (WHERE alive) AS since FROM targets GROUP BY 1, 2),
broken AS (
  SELECT r.*, CASE WHEN s.key IS NULL THEN 'missing' WHEN NOT s.alive THEN 'deleted' WHEN s.since > r.seen_at THEN 'late' END AS state
  FROM refs r LEFT JOIN states s USING (ref_field, key) WHERE r.key IS NOT NULL AND r.key <> '')
"""
P6_SQL = P6_BROKEN + "SELECT DISTINCT ref_field, record_id, state FROM broken WHERE state IS NOT NULL"
P6_COUNTS_SQL = P6_BROKEN + """SELECT ref_table, ref_field, strftime(seen_at, '%Y-%m') AS month, state, count(*) AS records FROM (
  SELECT ref_table, ref_field, record_id, state, min(seen_at) AS seen_at FROM broken WHERE state IS NOT NULL GROUP BY ALL) GROUP BY ALL"""
_FILES = ("result_files", "schema_fields")
_HISTORIES = ("runs", "conditions", "metrics", "evaluations", "curves")

P1_UNION_SQL = """
WITH RECURSIVE texts AS (SELECT DISTINCT file_id, record_kind, written_at, trim(ltrim(payload, chr(65279)), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM result_files WHERE payload IS NOT NULL),
files AS (SELECT file_id, record_kind, written_at, t::JSON AS v FROM texts WHERE json_valid(t) AND json_type(t) = 'OBJECT'),
nodes AS (
  SELECT file_id, record_kind, written_at, '' AS path, v, false AS is_field FROM files
  UNION ALL
  SELECT n.file_id, n.record_kind, n.written_at, CASE WHEN c.key IS NULL THEN n.path || '[]' WHEN n.path = '' THEN c.key ELSE n.path || '/' || c.key END, c.v, c.key IS NOT NULL
  FROM nodes n, LATERAL (
    SELECT k AS key, json_extract(n.v, '$."' || k || '"') AS v FROM (SELECT unnest(CASE WHEN json_type(n.v) = 'OBJECT' THEN json_keys(n.v) ELSE [] END) AS k)
    UNION ALL SELECT NULL, unnest(CASE WHEN json_type(n.v) = 'ARRAY' THEN json_extract(n.v, '$[*]') ELSE [] END)) c),
typed AS (SELECT file_id, record_kind, written_at, path, CASE json_type(v) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'integer' END AS t FROM nodes WHERE is_field),
kinds AS (SELECT record_kind, path, list(DISTINCT t) FILTER (WHERE t <> 'null') AS ts, count(DISTINCT file_id) AS files, min(written_at) AS first_seen, max(written_at) AS last_seen FROM typed GROUP BY ALL)
SELECT record_kind, path, CASE WHEN ts IS NULL THEN 'null' WHEN len(ts) = 1 THEN ts[1] WHEN len(list_filter(ts, lambda x: x NOT IN ('integer', 'number'))) = 0 THEN 'number' ELSE 'any' END AS json_type, files, first_seen, last_seen FROM kinds
"""
registry.add("p1_found", *_FILES)(drift.found)
registry.add("p1_log", *_FILES)(drift.change_log)
registry.add("p1_union_schema", "result_files", sql=P1_UNION_SQL)(drift.union_schema)


def _of_kind(kind: str):
    return lambda files, fields: drift.consistent_table(files, fields, kind)


for _kind in ("result", "report", "run_spec"):
    registry.add(f"p1_{_kind}_table", *_FILES)(_of_kind(_kind))


@registry.add("p2_found", *_HISTORIES, sql=P2_SQL)
def p2_found(*tables: DataFrame) -> DataFrame:
    return grid.found(grid.run_store_readings(*tables))


@registry.add("p2_grid", *_HISTORIES)
def p2_grid(*tables: DataFrame) -> DataFrame:
    return grid.regular(grid.run_store_readings(*tables))


registry.add("p3_found", "runs", "metrics", "restored_runs", sql=P3_SQL)(copydiff.differences)
registry.add("p4_found", "updates", "evaluations")(spikes.found)


@registry.add("p4_scores", "updates", "evaluations")
def p4_scores(updates: DataFrame, evaluations: DataFrame) -> DataFrame:
    return spikes.judged_readings(spikes.run_store_readings(updates, evaluations), all_scores=True)


registry.add("p6_found", "runs", "checkpoints", "checkpoint_files", sql=P6_SQL)(references.found)
registry.add("p6_counts", "runs", "checkpoints", "checkpoint_files", sql=P6_COUNTS_SQL)(references.counts)
