import math

import numpy as np
import pytest

from warpline.llm import log_buckets as B

SCHEMA = "g string, v double, sign string, rows string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)


def true_percentile(values, p):
    v = sorted(values)
    return v[math.floor(p / 100 * (len(v) - 1))]


@pytest.mark.parametrize("seed", range(3))
def test_error_bound_and_combination(spark, seed):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.lognormal(0, 4, 4000), -rng.lognormal(0, 2, 900), np.zeros(50), [1.0] * 300, [1e300, -1e-300]])
    rng.shuffle(v)
    df = frame(spark, [("a", float(x)) for x in v])
    whole = B.sketch(df, ["g"], "v")
    parts = [B.sketch(frame(spark, [("a", float(x)) for x in v[k::3]]), ["g"], "v") for k in range(3)]
    one, other = (B.percentiles(s, ["g"]).collect()[0] for s in (whole, B.combined(parts, ["g"])))
    assert one == other and one["rows"] == len(v)
    for p in B.PERCENTS:
        t = true_percentile(v, p)
        assert abs(one[f"p{p:g}"] - t) <= B.ERROR * abs(t) * (1 + 1e-9)


def test_dirt(spark):
    data = [("a", None), ("a", float("nan")), ("a", float("inf")), (None, 2.0), ("z", 5e-324), ("z", -5e-324)]
    got = {r["g"]: r for r in B.percentiles(B.sketch(frame(spark, data), ["g"], "v"), ["g"]).collect()}
    assert set(got) == {None, "z"} and got["z"]["p50"] == 0.0 and abs(got[None]["p99"] - 2) <= 0.01
    assert B.percentiles(B.sketch(frame(spark, []), ["g"], "v"), ["g"]).count() == 0


def test_copies_count_once(spark):
    df = frame(spark, [("a", 1.0), ("a", 1.0), ("a", 3.0), ("b", 1.0), (None, 1.0), (None, 1.0)])
    assert B.without_copies(df, ["g", "v"], ["g", "v"]).count() == 4
