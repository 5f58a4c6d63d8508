import numpy as np
import pytest

from warpline.operators import seq2seq as S


@pytest.mark.parametrize("attention", [False, True])
def test_gradients_are_those_of_the_loss(attention):
    rng = np.random.default_rng(0)
    w = S.made(7, 3, 4, attention, rng)
    q, a = rng.integers(0, 7, (5, 4)), rng.integers(0, 7, (5, 3))
    _, g = S.step(w, q, a)
    for k, x in w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in x.shape)
            kept, h = x[at], 1e-5
            x[at] = kept + h
            up, _ = S.step(w, q, a)
            x[at] = kept - h
            down, _ = S.step(w, q, a)
            x[at] = kept
            assert abs((up - down) / (2 * h) - g[k][at]) < 1e-7


def test_given_characters_are_read_on_and_weights_add_up():
    rng = np.random.default_rng(1)
    w = S.made(5, 3, 4, True, rng)
    q = rng.integers(0, 5, (2, 6))
    out, weights = S.decoded(w, q, 0, 4)
    again, same = S.decoded(w, q, 0, 4, given=out)
    assert (out == again).all() and np.allclose(weights, same) and np.allclose(weights.sum(-1), 1) and weights.shape == (2, 4, 6)
    assert S.decoded(S.made(5, 3, 4, False, rng), q, 0, 4)[1].shape == (2, 4, 0)


def test_learns_to_copy_and_handles_dirt(spark):
    pairs = [("copy", f"{k}", f"_{k}") for k in range(10, 40)] + [("copy", None, "_1"), ("copy", "1", None), ("copy", "", "_1"), ("empty", "", "")]
    df = spark.createDataFrame([(*p, "x") for p in pairs], "condition string, question string, answer string, seed string")
    got = S.trained(df, attention=True, seeds=1, epochs=60, hidden=32, batch=8, rate=0.01).collect()
    assert len(got) == 1 and got[0]["losses"][-1] < 0.2 * got[0]["losses"][0] and got[0]["exact_match"] > 0.9
    assert len(got[0]["predictions"]) == 30 and np.array(got[0]["weights"]).shape == (30, 2, 2)
    assert S.trained(df.limit(0)).count() == 0
