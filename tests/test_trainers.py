import numpy as np
import pytest
from pyspark.sql import functions as F

from warpline.operators import trainers as R


def slopes(f, w):
    for k, v in w.items():
        for at in [(0,) * v.ndim, tuple(n - 1 for n in v.shape)]:
            was = v[at]
            v[at] = was + 1e-5
            up = f()
            v[at] = was - 1e-5
            down = f()
            v[at] = was
            yield k, at, (up - down) / 2e-5


def test_gradients():
    rng = np.random.default_rng(0)
    w = R.language_weights(5, 4, rng)
    x, y, h = rng.integers(0, 5, (3, 6)), rng.integers(0, 5, (3, 6)), rng.normal(size=(3, 4))
    step = lambda: R.language_step(w, x, y, h, 0.3, np.random.default_rng(1))
    g = step()[1]
    assert all(abs(g[k][at] - s) < 1e-6 for k, at, s in slopes(lambda: step()[0], w))
    v = {k: rng.normal(size=(5, 4)) for k in ("in", "out")}
    inputs, there, candidates = np.array([[0, 4], [4, 0]]), np.array([[1.0, 1.0], [1.0, 0.0]]), np.array([[0, 4, 2], [4, 4, 0]])
    step = lambda: R.word2vec_step(v, inputs, there, candidates, np.array([1.0, 0.0, 0.0]))
    g = step()[1]
    assert all(abs(g[k][at] - s) < 1e-6 for k, at, s in slopes(lambda: step()[0], v))


def test_l2_and_dropout():
    w = {"w": np.ones((2, 2)), "b": np.ones(2)}
    g = R.l2({k: np.zeros_like(x) for k, x in w.items()}, w, 0.1)
    assert g["w"].tolist() == [[0.1, 0.1]] * 2 and g["b"].tolist() == [0, 0]
    m = R.dropout_mask((200, 200), 0.25, np.random.default_rng(0))
    assert set(np.unique(m)) == {0.0, 1 / 0.75} and abs(m.mean() - 1) < 0.02
    assert (R.dropout_mask((3,), 0.0, np.random.default_rng(0)) == 1).all()


@pytest.mark.parametrize("kind", ["cbow", "skipgram"])
def test_word2vec(spark, kind):
    # a and b stand between x and y, c and d between u and v
    rows = [("k", [*p], t) for p, ts in (("xy", "ab"), ("uv", "cd")) for t in ts for _ in range(40)] + [("one", ["q"], "q"), ("k", None, "a")]
    got = R.trained_word2vec(spark.createDataFrame(rows, "condition string, context array<string>, target string").repartition(3), kind, seeds=2, epochs=30).collect()
    assert {(r["condition"], r["seed"]) for r in got} == {("k", 1), ("k", 2)} and len(got) == 16
    for seed in (1, 2):
        v = {r["word"]: np.array(r["vector"]) for r in got if r["seed"] == seed}
        near = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
        a, b, other = ("x", "y", "u") if kind == "cbow" else ("a", "b", "c")
        assert near(a, b) > 0.8 > near(a, other)
    assert all(r["losses"][-1] < r["losses"][0] and len(r["losses"]) == 30 for r in got)


def test_language_models(spark):
    text = "the cat sat on a mat . " * 30
    rows = [("k", 1, i, w) for i, w in enumerate(text.split())] + [("short", 1, 0, "x")]
    tokens = spark.createDataFrame(rows, "condition string, doc_id bigint, pos int, word string").repartition(3)
    got = R.trained_language_models(tokens, seeds=2, epochs=40, dropout=0.1, decay=1e-5).orderBy("seed", "epoch").collect()
    assert len(got) == 80 and {r["condition"] for r in got} == {"k"}
    last = [r for r in got if r["epoch"] == 40]
    assert all(r["perplexity"] < 1.5 < got[0]["perplexity"] and r["greedy"] == "cat sat on a mat . the cat sat on".split() and len(r["sampled"]) == 10 for r in last)
    w = R.language_weights(4, 3, np.random.default_rng(0))
    assert not {1, 2} & set(R.generated(w, 0, 30, np.random.default_rng(0), skip=(1, 2)))
    assert R.trained_language_models(tokens.where(F.lit(False))).count() == 0


def test_lstm_language_model(spark):
    rng = np.random.default_rng(0)
    w = R.lstm_language_weights(6, 4, rng)
    x, y = rng.integers(0, 6, (3, 5)), rng.integers(0, 6, (3, 5))
    state = (rng.normal(size=(3, 4)), rng.normal(size=(3, 4)))
    loss = lambda: R.lstm_language_step(w, x, y, state, 0.0, rng)
    g = loss()[1]
    for k, p in w.items():
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in p.shape)
            kept = p[at]
            p[at] = kept + 1e-5
            up = loss()[0]
            p[at] = kept - 1e-5
            down = loss()[0]
            p[at] = kept
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-7
    assert len(R.generated(w, 0, 7)) == 7 and 3 not in R.generated(w, 0, 20, np.random.default_rng(1), skip=(3,))
    rows = [("a", d, i, t) for d in range(6) for i, t in enumerate("the cat sat on the mat and the dog sat on the rug".split())]
    got = R.trained_language_models(spark.createDataFrame(rows, "condition string, doc_id bigint, pos int, word string"), seeds=1, size=16, epochs=20, rate=2.0, limit=1.0, kind="lstm").orderBy("epoch").collect()
    assert got[-1]["perplexity"] < 0.6 * got[0]["perplexity"] and len(got) == 20
