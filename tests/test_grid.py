import math
import random

import numpy as np
from conftest import rows

from warpline.operators import grid

SCHEMA = "source string, run_id string, series string, every bigint, step double, value double, slot bigint, block string"


def frame(spark, data):
    return spark.createDataFrame([(*r, 0, "clash") for r in data], SCHEMA)


def test_gaps_and_dirt(spark):
    nan, inf = float("nan"), float("inf")
    data = [("m", "r", "s", 10, t, v) for t, v in ((3.0, 1.0), (3.0, 1.0), (9.0, 3.0), (25.0, None), (38.0, nan), (41.0, inf), (55.0, 7.0), (None, 1.0))]
    data += [("m", None, "s", 10, 0.0, 1.0), ("m", None, "s", 10, 20.0, 1.0), ("m", "z", "s", 0, 0.0, 1.0), ("m", "z", "s", None, 9.0, 1.0), ("m", "one", "s", 1, 5.0, 1.0)]
    data += [("m", "neg", "s", 10, -15.0, 1.0), ("m", "neg", "s", 10, 5.0, 1.0)]
    got = rows(grid.found(frame(spark, data)))
    assert got == {("m", "r", "s", s) for s in (10, 20, 30, 40)} | {("m", None, "s", 10), ("m", "neg", "s", -10)}
    assert grid.found(frame(spark, [])).count() == 0
    whole = {r["slot_start"]: r for r in grid.regular(frame(spark, data)).where("run_id = 'r'").collect()}
    assert set(whole) == {0, 10, 20, 30, 40, 50} and not whole[0]["filled"] and whole[0]["value"] == (1 + 1 + 3) / 3
    # few slots: nearly the straight line between the ends
    assert math.isclose(whole[20]["value"], whole[0]["value"] + (7 - whole[0]["value"]) * 2 / 5, rel_tol=0.01)


def test_blocks_do_not_hide_gaps(spark, monkeypatch):
    random.seed(3)
    seen = sorted(random.sample(range(400), 150))
    monkeypatch.setattr(grid, "BLOCK", 16)
    got = {r[3] for r in rows(grid.found(frame(spark, [("m", "r", "s", 1, float(s), 1.0) for s in seen])))}
    assert got == set(range(seen[0], seen[-1] + 1)) - set(seen)


def test_fill_follows_trend_and_season(spark):
    f = lambda s: 2 + 0.05 * s + math.sin(2 * math.pi * s / grid.PERIOD) + 0.5 * math.cos(4 * math.pi * s / grid.PERIOD)
    missing = {7, 8, 9, 40, 41, 77}
    data = [("m", "r", "s", 1, float(s), f(s)) for s in range(120) if s not in missing]
    got = {r["slot"]: r["value"] for r in grid.filled(frame(spark, data)).collect()}
    assert set(got) == missing
    assert max(abs(v - f(s)) for s, v in got.items()) < 1e-4


def test_normal_equations_agree_with_least_squares(spark, monkeypatch):
    rng = np.random.default_rng(1)
    s = np.sort(rng.choice(300, 120, replace=False))
    v = rng.normal(size=120)
    monkeypatch.setattr(grid, "BLOCK", 64)
    far = 10**9 // 64 * 64 * 12 + 128  # large slot numbers lose no digits
    blocks = grid._of_blocks(grid.slots(frame(spark, [("m", "r", "s", 1, float(a + far), float(b)) for a, b in zip(s, v, strict=True)])), grid.PERIOD)
    got = grid.fitted(blocks).collect()[0]
    c = got["coefficients"]
    s = s + far
    cols = [np.ones(120), s / 64 - got["origin"]] + [g(2 * np.pi * h * (s % grid.PERIOD) / grid.PERIOD) for h in (1, 2) for g in (np.cos, np.sin)]
    assert np.allclose(c, np.linalg.lstsq(np.stack(cols, 1), v, rcond=None)[0], atol=1e-3)


def test_a_long_gap_is_opened_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(grid, "SLOTS_AT_ONCE", 7)
    got = grid.filled(frame(spark, [("m", "r", "s", 1, 0.0, 1.0), ("m", "r", "s", 1, 100.0, 1.0)])).collect()
    assert sorted(r["slot"] for r in got) == list(range(1, 100)) and all(math.isclose(r["value"], 1.0) for r in got)
