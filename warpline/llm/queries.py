"""Queries of the operators for texts and very large columns."""

from __future__ import annotations

import math

from warpline.llm import byte_pairs, languages, leaks, log_buckets
from warpline.plans.registry import Registry

_BASE = math.log((1 + log_buckets.ERROR) / (1 - log_buckets.ERROR))
_SKETCH = f"""
WITH readings AS (
  SELECT 'runtime_estimates' AS source_table, canonical_condition_id, 'seconds_per_update' AS metric, seconds_per_update AS v FROM runtime_estimates
  UNION ALL SELECT 'evaluations', canonical_condition_id, metric, value FROM evaluations),
sketch AS (
  SELECT source_table, canonical_condition_id, metric, CASE WHEN abs(v) < 2.3e-308 THEN 0 ELSE sign(v)::INTEGER END AS sign,
    CASE WHEN abs(v) < 2.3e-308 THEN 0 ELSE ceil(ln(abs(v)) / {_BASE!r})::INTEGER END AS bucket, count(*) AS rows
  FROM readings WHERE isfinite(v) GROUP BY ALL)
"""
P5_SKETCH_SQL = _SKETCH + "SELECT * FROM sketch"
# the value at the rank, taken from the readings themselves, and the middle of the bucket that it lies in
P5_SQL = f"""
WITH readings AS (
  SELECT 'runtime_estimates' AS source_table, canonical_condition_id, 'seconds_per_update' AS metric, seconds_per_update AS v FROM runtime_estimates
  UNION ALL SELECT 'evaluations', canonical_condition_id, metric, value FROM evaluations),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_table, canonical_condition_id, metric ORDER BY v) - 1 AS rank, count(*) OVER (PARTITION BY source_table, canonical_condition_id, metric) AS n
  FROM readings WHERE isfinite(v)),
middles AS (
  SELECT * EXCLUDE v, CASE WHEN abs(v) < 2.3e-308 THEN 0.0 ELSE sign(v) * {2.0 / (1.0 + math.exp(_BASE))!r} * exp(ceil(ln(abs(v)) / {_BASE!r}) * {_BASE!r}) END AS middle FROM ranked)
SELECT source_table, canonical_condition_id, metric, max(n) AS rows, {log_buckets.ERROR!r}::DOUBLE AS relative_error,
  {", ".join(f"max(middle) FILTER (WHERE rank = floor({p / 100.0!r}::DOUBLE * (n - 1))) AS p{p:g}" for p in log_buckets.PERCENTS)}
FROM middles GROUP BY 1, 2, 3
"""

registry = Registry()
registry.add("p5_percentiles", "runtime_estimates", "evaluations", sql=P5_SQL)(log_buckets.run_store_percentiles)
registry.add("p5_sketch", "runtime_estimates", "evaluations", sql=P5_SKETCH_SQL)(log_buckets.run_store_sketch)
registry.add("p7_ids", "documents")(byte_pairs.token_ids)
registry.add("p8_found", "documents", "eval_items")(leaks.leaks)
registry.add("p9_found", "documents", "lang_samples")(languages.found)
registry.add("p9_languages", "documents", "lang_samples")(languages.languages)
