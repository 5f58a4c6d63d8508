from datetime import datetime, timedelta

from pyspark.sql import functions as F

from warpline.operators import references as R

T = datetime(2024, 1, 1)
DAY = timedelta(days=1)


def frames(spark, records, parents):
    """Every row of the field f; record and parent tables have columns that clash with names of the operator."""
    r = spark.createDataFrame([("f", *r, "x") for r in records], "field string, record_id string, key string, at timestamp, lo string")
    return r.drop("lo"), spark.createDataFrame([("f", *p, "x") for p in parents], "field string, key string, alive boolean, at timestamp, run string")


def cases(spark, records, parents, **more):
    return {(r["record_id"], r["state"]) for r in R.broken(*frames(spark, records, parents), **more).collect()}


def test_states(spark):
    parents = [("a", True, T), ("a", True, T + DAY), ("b", False, T), ("c", False, T), ("c", True, T + 5 * DAY), (None, True, T), ("", True, T)]
    records = [("ok", "a", T + DAY), ("ok", "a", T + DAY), ("early", "a", T - DAY), ("gone", "zz", T), ("dead", "b", T), ("late", "c", T + DAY), ("in time", "c", T + 6 * DAY), ("null", None, T), ("empty", "", T), ("timeless", "a", None)]
    assert cases(spark, records, parents) == {("early", "late"), ("gone", "missing"), ("dead", "deleted"), ("late", "late")}


def test_keys_of_any_form_become_long_runs(spark):
    known = [f"{k * 7919 % 1000:04d}x" for k in range(1000)]
    parents = [(k, k != "0500x", T) for k in known]
    orphans = ["0000", "0250", "0750y", "zz"]
    records = [(f"r{k}", k, T + DAY) for k in known[:300]] + [(f"o{k}", k, T) for k in orphans] + [("dead", "0500x", T)]
    keys = R.dense_keys(*frames(spark, records, parents), buckets=1)
    runs = R.key_runs(keys).orderBy("first").collect()
    # 1,000 parents in a few runs: cut by four orphans and on both sides of the deleted key
    assert sum(r["last"] - r["first"] + 1 for r in runs) == 1000 and 3 <= len(runs) <= 7
    assert [(r["first"], r["last"]) for r in runs if r["state"] == "deleted"] == [(keys.where("state = 'deleted'").first()["lo"],) * 2]
    left = R.matched(keys.where("records > 0").select("hi", "lo", "state"), R.key_runs(keys)).where("found = 'missing'")
    assert [r["state"] for r in left.collect()] == [None] * len(orphans)
    assert cases(spark, records, parents) == {*((f"o{k}", "missing") for k in orphans), ("dead", "deleted")} == cases(spark, records, parents, buckets=7)


def test_hot_missing_and_hot_late_targets(spark):
    records = spark.range(30_000).select(F.lit("f").alias("field"), F.concat(F.lit("r"), "id").alias("record_id"), F.when(F.col("id") % 3 == 0, "gone").when(F.col("id") % 3 == 1, "late").otherwise(F.concat(F.lit("k"), "id")).alias("key"), F.lit(T).alias("at"))
    parents = records.where("key like 'k%'").select("field", "key", F.lit(True).alias("alive"), F.lit(T - DAY).alias("at")).union(spark.createDataFrame([("f", "late", True, T + DAY)], "field string, key string, alive boolean, at timestamp"))
    got = {r["state"]: r["n"] for r in R.broken(records, parents).groupBy("state").agg(F.count("*").alias("n")).collect()}
    assert got == {"missing": 10_000, "late": 10_000}


def test_empty(spark):
    assert cases(spark, [], []) == set()
    assert cases(spark, [("r", "a", T)], []) == {("r", "missing")}


def test_forms_of_keys(spark):
    from warpline.functions import keys as K

    df = spark.createDataFrame([(r" .\A//b\c ", "SHA256:AB-c ", "A-b C"), (None, None, None)], "p string, d string, i string")
    got = df.select(K.bare_path("p"), K.bare_digest("d"), K.bare_id("i")).collect()
    assert tuple(got[0]) == ("a/b/c", "abc", "abc") and tuple(got[1]) == (None, None, None)
