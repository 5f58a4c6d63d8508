"""Queries and operators cover all rows they are asked for."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from warpline.operators import drift, spikes
from warpline.operators import runs as R
from warpline.plans import models


def test_negatives_of_all_documents(spark):
    d = spark.createDataFrame([(1, "a b a", "notes"), (2, "C a", "code"), (3, "d", None), (4, None, "notes")], "doc_id bigint, text string, doc_type string")
    got = models.sampling_negatives(d)
    assert rows(got.groupBy("doc_id", "pos", "word_id").agg(F.count("*"))) == {(1, 0, 0, 5), (1, 1, 1, 5), (1, 2, 0, 5), (2, 0, 2, 5), (2, 1, 0, 5), (3, 0, 3, 5)}
    assert got.where("negative = word_id").count() == 0
    assert rows(got.select("negative").distinct()) == {(0,), (1,), (2,), (3,)}


def test_union_schema_counts_files_exactly(spark):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    n = 20_000
    # every file has id; one of a hundred lacks n; every tenth is delivered twice, and n is then a string
    text = lambda n: F.when(F.col("id") % 100 == 0, F.lit('{"id": "x"}')).otherwise(F.lit(f'{{"id": "x", "n": {n}}}'))
    make = lambda ids, n: ids.select(F.col("id").alias("file_id"), F.lit("a").alias("record_kind"), at.alias("written_at"), text(n).alias("payload"))
    files = make(spark.range(n), "1").unionByName(make(spark.range(0, n, 10), '"1"'))
    fields = spark.createDataFrame([("a", "id", "string"), ("a", "n", "integer")], "record_kind string, field string, json_type string")
    seen = {r["path"]: (r["files"], r["json_type"]) for r in drift.union_schema(files).collect()}
    log = {(r["field"], r["change"]): r["files"] for r in drift.change_log(files, fields).collect()}
    assert seen == {"id": (n, "string"), "n": (n - n // 100, "any")}
    assert log["n", "removed"] == n - seen["n"][0] == 200


def sparse(spark, v, first=0, distance=1000):
    """Readings on the axis update, with a measure recorded every ``distance`` steps, of a run and of a null run."""
    e = [(run, "update", "valid", "loss", "nats", first + distance * i, float(x)) for run in ("r", None) for i, x in enumerate(v)]
    none = spark.createDataFrame([], "run_id string, update_no bigint, loss double, book_loss double")
    got = rows(spikes.found(none, spark.createDataFrame(e, "run_id string, axis string, split string, metric string, unit string, axis_step bigint, value double")))
    assert {r[3] for r in got if r[1]} == {r[3] for r in got if not r[1]}
    return {(r[3] - first) // distance for r in got if r[1]}


def run_of(n):
    return (0.5 + 2 * np.exp(-np.arange(n) / 12)) * (1 + 0.03 * np.random.default_rng(4).normal(size=n))


@pytest.mark.parametrize("block, halo", [(65_536, 2_048), (66, 32), (32, 16)])
def test_stretches_across_borders_of_sparse_steps(spark, monkeypatch, block, halo):
    v = run_of(134)
    # six equal readings, three on both sides of step 65,536 and of the 66th reading; a spike near the end
    v[63:69] = v[63]
    v[131] *= 4
    monkeypatch.setattr(spikes, "BLOCK", block)
    monkeypatch.setattr(spikes, "HALO", halo)
    assert sparse(spark, v) == {*range(63, 69), 131}


def test_sparse_measure_of_a_long_source(spark, monkeypatch):
    monkeypatch.setattr(spikes, "BLOCK", 64)
    monkeypatch.setattr(spikes, "HALO", 32)
    v = run_of(130)
    v[62:68] = v[62]
    # the second measure stands in every 50th row only, and all rows are delivered twice
    u = [("r", i, 0.5 + (i * 7919 % 101) / 1e4, float(v[i // 50]) if i % 50 == 0 else None) for i in range(130 * 50)] * 2
    got = spikes.found(spark.createDataFrame(u, "run_id string, update_no bigint, loss double, book_loss double"), spark.createDataFrame([], "run_id string, axis string, split string, metric string, unit string, axis_step bigint, value double"))
    assert {r[3] // 50 for r in rows(got) if r[2] == "book_loss"} == set(range(62, 68))


def test_roots_of_deep_chains_and_cycles(spark):
    schema = "run_id string, experiment string, canonical_condition_id string, native_condition_id string, variant string, seed string, status string, lifecycle_stage string, start_time timestamp_ntz, end_time timestamp_ntz, tags map<string,string>, params map<string,string>"
    parents = {f"r{i}": f"r{i - 1}" if i else None for i in range(50)} | {"a": "b", "b": "c", "c": "a", "below": "a", "self": "self", "gone": "nobody"}
    make = lambda up: spark.createDataFrame([(i, "e", "A", None, "v", "1", "FINISHED", "active", None, None, {"mlflow.parentRunId": p} if p else {}, {}) for i, p in up.items()], schema)
    want = {(f"r{i}", "r0", i) for i in range(50)} | {("gone", "gone", 0)}
    assert rows(R.roots(make(parents))) == want | {(i, None, None) for i in ("a", "b", "c", "below", "self")}
    assert rows(R.roots(make({"x": "x"}))) == {("x", None, None)} and rows(R.roots(make({"x": None}))) == {("x", "x", 0)}
    assert R.roots(make({"x": None}).limit(0)).count() == 0


def test_settled_tables_can_be_removed_and_small_ones_are_sent(spark):
    from warpline.session import if_small, settled, shared_folder, unsettle

    before = settled(spark.range(5))
    assert before.count() == 5
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(spark.range(9).join(if_small(before, 5), "id")) and "broadcast" not in plan(spark.range(9).join(if_small(before, 4), "id"))
    unsettle(spark)
    import os

    assert not [x for x in os.listdir(shared_folder(spark).removeprefix("file:")) if x.startswith("warpline-settled-")]
