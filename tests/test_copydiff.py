from datetime import datetime

import pytest
from conftest import rows

from warpline.operators import copydiff

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
RUNS = "run_id string, tags map<string,string>, params map<string,string>, received_at timestamp_ntz, key string"
METRICS = "run_id string, metric_key string, value double, logged_ms bigint, step bigint, key string"
RESTORED = "run_id string, original_run_id string, restored_at timestamp_ntz, params map<string,string>, metrics array<struct<metric_key:string,value:double,logged_ms:bigint,step:bigint>>, key string"
TAG = {"transfer.batch": "b"}


def build(spark, runs, metrics, restored):
    return spark.createDataFrame([(*r, "x") for r in runs], RUNS), spark.createDataFrame([(*m, "x") for m in metrics], METRICS), spark.createDataFrame([(*r, "x") for r in restored], RESTORED)


def test_every_difference(spark):
    nan, inf = float("nan"), float("inf")
    runs = [
        ("aa", TAG, {"p": "1", "q": "True", "r": " x ", "only": "1"}, T0), ("aa", TAG, {"p": "1", "q": "True", "r": " x ", "only": "1"}, T0),
        ("bb", TAG, None, T0), ("cc", None, {}, T0), ("dd", TAG, {"p": "old"}, T0), ("dd", TAG, {"p": "new"}, T1), ("ee", TAG, {}, T0), (None, TAG, {}, T0),
    ]
    m = lambda r, k, v, s=1, ms=5: (r, k, v, ms, s)
    metrics = [m("aa", "same", 1.0), m("aa", "same", 1.0), m("aa", "close", 1.0), m("aa", "far", 1.0), m("aa", "nan", nan), m("aa", "lost", 1.0), m("aa", "inf", inf), m("aa", "inf2", inf), m("aa", None, 1.0), m("cc", "z", 1.0), m("ee", "e", 1.0), m(None, "n", 1.0)]
    t = lambda k, v, s=1, ms=5: (k, v, ms, s)
    restored = [
        ("n1", "A-A ", T0, {"p": "nothing"}, []),
        ("n2", "A-A ", T1, {"p": "1.000000e+00", "q": "true", "r": "x", "new": "2"}, [t("same", 1.0), t("same", 1.0), t("close", 1.0 + 5e-7), t("far", 1.0 + 5e-6), t("nan", None), t("extra", 1.0), t("inf", inf), t("inf2", 5.0), t(None, 1.0)]),
        ("n3", "dd", T0, {"p": "new"}, None), ("n4", "gone", T0, None, None), ("n5", "ee", T0, None, [t("e", None)]), ("n6", None, T0, None, None),
    ]
    got = rows(copydiff.differences(*build(spark, runs, metrics, restored)))
    assert got == {
        ("aa", "param", "only", -1, -1, "missing_in_target"), ("aa", "param", "new", -1, -1, "missing_in_source"),
        ("aa", "metric", "far", 1, 5, "differs"), ("aa", "metric", "lost", 1, 5, "missing_in_target"), ("aa", "metric", "extra", 1, 5, "missing_in_source"), ("aa", "metric", "inf2", 1, 5, "differs"),
        ("bb", "run", "", -1, -1, "missing_in_target"), ("gone", "run", "", -1, -1, "missing_in_source"), ("ee", "metric", "e", 1, 5, "differs"),
    }


def test_empty_sides(spark):
    runs, metrics, restored = [("aa", TAG, {}, T0)], [("aa", "k", 1.0, 1, 1)], [("n", "aa", T0, {}, [("k", 1.0, 1, 1)])]
    assert rows(copydiff.differences(*build(spark, runs, metrics, restored))) == set()
    assert rows(copydiff.differences(*build(spark, [], [], restored))) == {("aa", "run", "", -1, -1, "missing_in_source")}
    assert rows(copydiff.differences(*build(spark, runs, metrics, []))) == {("aa", "run", "", -1, -1, "missing_in_target")}
    assert rows(copydiff.differences(*build(spark, [], [], []))) == set()


def test_sets_of_values(spark):
    nan = float("nan")
    runs, restored = [("aa", TAG, {}, T0)], lambda ms: [("n", "aa", T0, {}, ms)]
    m, t = (lambda k, v: ("aa", k, v, 1, 1)), (lambda k, v: (k, v, 1, 1))
    metrics = [m("more", 1.0), m("more", 2.0), m("less", 2.0), m("close", 1.0), m("close", 2.0), m("close", None), m("null", None), m("both", nan), m("twice", 3.0), m("twice", 3.0)]
    theirs = [t("more", 2.0), t("less", 1.0), t("less", 2.0), t("close", 2.0), t("close", 1.0 + 1e-9), t("close", nan), t("null", 1.0), t("both", None), t("twice", 4.0), t("twice", 4.0)]
    got = rows(copydiff.differences(*build(spark, runs, metrics, restored(theirs))))
    assert {r[2]: r[5] for r in got} == dict.fromkeys(["more", "less", "null", "twice"], "differs") and len(got) == 4


def test_equal_ranges_are_not_read_below_the_top(spark, monkeypatch):
    keys = [f"k{i}" for i in range(300)]
    runs = [(k, TAG, {"p": k}, T0) for k in keys]
    metrics = [(k, "m", 1.0 * i, 1, i) for k in keys for i in range(20)]
    restored = [("n", k, T0, {"p": k}, [("m", 1.0 * i + (k == "k77" and i == 3), 1, i) for i in range(20)]) for k in keys if k != "k5"]
    runs, metrics, restored = build(spark, runs, metrics, restored)
    source, target = copydiff.source_side(runs), copydiff.target_side(restored)
    seen = []
    read = copydiff.source_readings
    monkeypatch.setattr(copydiff, "source_readings", lambda m, s: seen.append(read(m, s).count()) or read(m, s))
    ranges, bits = copydiff.differing_ranges(source, metrics, target)
    assert seen[0] == 6000 and seen[1] <= 20 * 10  # below the top only what shares a range with a difference
    monkeypatch.undo()
    assert ranges.count() == 2 and bits == copydiff.DEEPEST
    left = copydiff.source_readings(metrics, copydiff.under(source, ranges, bits))
    assert {r[0] for r in rows(left.select("key"))} == {"k5", "k77"}
    assert rows(copydiff.differences(runs, metrics, restored)) == {("k77", "metric", "m", 3, 1, "differs"), ("k5", "run", "", -1, -1, "missing_in_target")}


def test_wide_ranges_are_split(spark, monkeypatch):
    monkeypatch.setattr(copydiff, "FAN_BITS", 2)
    monkeypatch.setattr(copydiff, "RANGE_ROWS", 4)
    runs = [(f"k{i}", TAG, {}, T0) for i in range(100)]
    restored = [("n", f"k{i}", T0, {"new": "1"} if i == 7 else {}, []) for i in range(100)]
    runs, metrics, restored = build(spark, runs, [], restored)
    ranges, bits = copydiff.differing_ranges(copydiff.source_side(runs), metrics, copydiff.target_side(restored))
    assert bits == copydiff.DEEPEST and ranges.count() == 1
    assert rows(copydiff.differences(runs, metrics, restored)) == {("k7", "param", "new", -1, -1, "missing_in_source")}


def test_the_shared_folder_is_wanted_on_a_cluster(spark, monkeypatch):
    from warpline import session

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_folder(Session)
