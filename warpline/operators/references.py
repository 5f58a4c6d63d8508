"""References whose target is absent, deleted or came later, by runs of consecutive keys.

Keys are texts, so they are given dense integers: parent and reference keys, as 128 bits of digest, are first reduced
to one row per distinct key (with map-side combine, so a hot key is one row), laid out in buckets, and
numbered in the order of the digests, without holes within a bucket: ``(hi, lo)`` is the bucket and the place in it. Parent keys of one
state then form long runs of consecutive numbers, which end only where a key that nobody has, or one of another
state, lies between them. References are matched as-of to the run that starts at or before them; a key
beyond that run's end, or before every start, is an orphan. The state of a run is that of each of its keys: deleted,
late for the earliest reference to it, or fine. Records of keys that can be a case are found by a join on the key; the keys
with more than one record in ``HOT`` are salted over ``SALTS`` tasks (there are at most ``HOT`` of them, so their
list is broadcast), so neither a hot target nor a hot missing one gathers its references in one task.

Defined results: null and empty references are no cases; repeated rows make no second case; a record
whose own time is null can't be late; an empty parent table makes every reference missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions.keys import bare_digest, bare_id, bare_path
from warpline.session import settled

HOT, SALTS = 1000, 64
DEAD, LATE, FINE = "deleted", "late", "fine"


_KEY = ["k1", "k2"]


def _digest() -> list[Column]:
    return [F.xxhash64("field", "key").alias("k1"), F.xxhash64("key", F.lit(1), "field").alias("k2")]


def dense_keys(records: DataFrame, parents: DataFrame, buckets: int | None = None) -> DataFrame:
    """(k1, k2, hi, lo, state, since, records) of the distinct keys of records (field, key, at) and parents (field, key, alive, at).

    ``state`` and ``since`` (when the first living row came) are null for a key that isn't a parent, ``records`` is 0
    for one that isn't referred to. By default there are as many buckets as shuffle partitions.
    """
    buckets = buckets or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    no = F.lit(None)
    some = F.col("key").isNotNull() & (F.col("key") != "")
    asked = records.where(some).select(*_digest(), no.cast("boolean").alias("alive"), no.cast("timestamp").alias("since"), F.col("at").alias("earliest"), F.lit(1).alias("asked"))
    there = parents.where(some).select(*_digest(), "alive", F.when(F.col("alive"), F.col("at")).alias("since"), no.cast("timestamp").alias("earliest"), F.lit(0).alias("asked"))
    keys = asked.unionByName(there).groupBy(*_KEY).agg(F.max("alive").alias("alive"), F.min("since").alias("since"), F.min("earliest").alias("earliest"), F.sum("asked").alias("records"))
    state = F.when(F.col("alive").isNull(), no.cast("string")).when(~F.col("alive"), DEAD).when(F.col("since") > F.col("earliest"), LATE).otherwise(FINE)
    bucket = F.pmod("k1", F.lit(buckets)).cast("int")
    place = F.row_number().over(Window.partitionBy("hi").orderBy(*_KEY))
    return keys.select(*_KEY, bucket.alias("hi"), state.alias("state"), "since", "records").withColumn("lo", place)


def key_runs(keys: DataFrame) -> DataFrame:
    """(hi, first, last, state): maximal runs of consecutive parent keys (hi, lo, state) in one state."""
    w = Window.partitionBy("hi").orderBy("lo")
    before = F.lag(F.struct("lo", "state")).over(w)
    new = F.coalesce((before["lo"] + 1 != F.col("lo")) | (before["state"] != F.col("state")), F.lit(True))
    runs = keys.where("state is not null").withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("hi", "run").agg(F.min("lo").alias("first"), F.max("lo").alias("last"), F.first("state").alias("state")).drop("run")


def matched(references: DataFrame, runs: DataFrame) -> DataFrame:
    """The references (hi, lo, ...) with ``found``, their state by the run that starts at or before them: missing beyond its end."""
    names = [c for c in references.columns if c not in ("hi", "lo")]
    rest = F.struct(*names)
    asked = references.select("hi", "lo", F.lit(1).alias("order"), F.lit(None).cast("struct<last:int,state:string>").alias("run"), rest.alias("rest"))
    points = runs.select("hi", F.col("first").alias("lo"), F.lit(0).alias("order"), F.struct(F.col("last").cast("int").alias("last"), "state").alias("run"), F.lit(None).cast(asked.schema["rest"].dataType).alias("rest"))
    w = Window.partitionBy("hi").orderBy("lo", "order").rowsBetween(Window.unboundedPreceding, 0)
    seen = points.unionByName(asked).withColumn("run", F.last("run", ignorenulls=True).over(w)).where("order = 1")
    inside = F.coalesce(F.col("lo") <= F.col("run.last"), F.lit(False))
    return seen.select("hi", "lo", "rest.*", F.when(inside, F.col("run.state")).otherwise("missing").alias("found"))


def broken(records: DataFrame, parents: DataFrame, buckets: int | None = None) -> DataFrame:
    """(field, record_id, state, at) of the records (field, record_id, key, at) whose target in (field, key, alive, at) isn't there for them."""
    keys = dense_keys(records, parents, buckets)
    asked = keys.where("records > 0").select("hi", "lo", *_KEY, "since", "records")
    cases = settled(matched(asked, key_runs(keys)).where(F.col("found") != FINE).select(*_KEY, "found", "since", "records"))
    total = cases.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    hot = F.broadcast(cases.where(F.col("records") * HOT > total).select(*_KEY, F.lit(SALTS).alias("salts")))
    salted = cases.join(hot, _KEY, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts", "records")
    rows = records.where("key is not null and key <> ''").select("field", "record_id", "at", *_digest()).join(hot, _KEY, "left")
    rows = rows.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))).drop("salts")
    rows = rows.join(salted, [*_KEY, "salt"]).where((F.col("found") != LATE) | (F.col("since") > F.col("at")))
    return rows.groupBy("field", "record_id", F.col("found").alias("state")).agg(F.min("at").alias("at"))


def run_store_references(runs: DataFrame, checkpoints: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records (field, record_id, key, at) and the parents (field, key, alive, at) of the run store."""
    time = lambda c: F.col(c).cast("timestamp")
    by_run = runs.select("run_id", bare_id(F.col("tags")["mlflow.parentRunId"]).alias("key"), time("received_at").alias("received_at"), (F.coalesce(F.col("lifecycle_stage"), F.lit("active")) != "deleted").alias("alive"))
    # a run delivered again counts from its earliest row on
    once = by_run.groupBy("run_id", "key").agg(F.min("received_at").alias("at")).select(F.lit("parent_run").alias("field"), F.col("run_id").alias("record_id"), "key", "at")
    both: Column = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), form(k).alias("key")) for f, form, k in (("checkpoint_path", bare_path, "path"), ("checkpoint_sha256", bare_digest, "sha256"))]))
    of_checkpoints = checkpoints.select(F.col("checkpoint_id").alias("record_id"), time("saved_at").alias("at"), both.alias("r")).select("r.field", "record_id", "r.key", "at")
    of_files = files.select(F.col("deleted_at").isNull().alias("alive"), time("stored_at").alias("at"), both.alias("r")).select("r.field", "r.key", "alive", "at")
    parents = by_run.select(F.lit("parent_run").alias("field"), bare_id("run_id").alias("key"), "alive", F.col("received_at").alias("at"))
    return once.unionByName(of_checkpoints), parents.unionByName(of_files)


def all_broken(runs: DataFrame, checkpoints: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_field, ref_table, record_id, state, at)"""
    table = F.when(F.col("field") == "parent_run", "runs").otherwise("checkpoints")
    return broken(*run_store_references(runs, checkpoints, files)).select(F.col("field").alias("ref_field"), table.alias("ref_table"), "record_id", "state", "at")


def found(runs: DataFrame, checkpoints: DataFrame, files: DataFrame) -> DataFrame:
    return all_broken(runs, checkpoints, files).select("ref_field", "record_id", "state")


def counts(runs: DataFrame, checkpoints: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_table, ref_field, month, state, records): the broken references per table and month of the record."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return all_broken(runs, checkpoints, files).groupBy("ref_table", "ref_field", month, "state").agg(F.count("*").alias("records"))
