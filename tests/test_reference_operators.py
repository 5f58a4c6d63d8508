"""Small fixtures with known results for the operators of the run analytics, corpora, vectors, tensors and models."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from warpline.functions import arrays as A
from warpline.operators import corpus as C
from warpline.operators import factors, intervals, recurrent
from warpline.operators import losses as L
from warpline.operators import optimizers as O
from warpline.operators import runs as R
from warpline.operators import sampling as S
from warpline.operators import tensors as T
from warpline.operators import vectors as V

T0 = datetime(2024, 1, 1)


def test_curve_over_seeds(spark):
    h = spark.createDataFrame([("A", 0, 1.0), ("A", 1, 3.0), ("B", 1, 5.0), ("B", 2, 9.0)], "run_id string, step bigint, value double").withColumn("s", F.lit("x"))
    r = R.curve(h, ["s"]).collect()
    assert len(r) == 1 and (r[0]["step"], r[0]["mean"], r[0]["minimum"], r[0]["maximum"], r[0]["run_count"]) == (1, 4.0, 3.0, 5.0, 2)
    assert math.isclose(r[0]["sd"], math.sqrt(2), abs_tol=1e-6)
    one = R.curve(h.where("run_id = 'A'"), ["s"]).collect()
    assert [x["sd"] for x in one] == [0.0, 0.0]


def test_last_value_wins_and_bad_cells(spark):
    h = spark.createDataFrame([("r", 1, 5.0, T0), ("r", 1, 7.0, T0 + timedelta(1)), ("r", 2, float("nan"), T0), ("r", 3, float("inf"), T0), ("r", 4, None, T0)], "run_id string, update_no bigint, loss double, received_at timestamp_ntz")
    assert rows(R.update_history(h)) == {("r", 1, 7.0)}
    from warpline.functions.numeric import number

    cells = spark.createDataFrame([("",), ("abc",), ("nan",), ("inf",), ("1e3",), (None,)], "v string")
    assert [r[0] for r in cells.select(number("v").alias("n")).where("n is not null").collect()] == [1000.0]


def test_every_n_first_window_has_one(spark):
    u = spark.createDataFrame([("r", 1, 1.0, 3), ("r", 2, 1.0, 3), ("r", 3, 3.0, 5), ("r", 4, 9.0, 5)], "run_id string, update_no bigint, loss double, batch_size int")
    got = [tuple(r) for r in R.every_n(u, 2).orderBy("point").collect()]
    assert got == [("r", 0, 1, 1, 3, 1.0, 1.0), ("r", 1, 2, 3, 8, 2.0, 2.25)]


def test_smoothing(spark):
    w = R.smoothing_weights()
    assert np.allclose(w[:6], [0.052445, 0.073094, 0.091778, 0.106661, 0.116245, 0.119553], atol=1e-6) and np.allclose(w, w[::-1])
    v = np.random.default_rng(0).normal(size=30)
    h = spark.createDataFrame([("long", i, float(x)) for i, x in enumerate(v)] + [("short", i, float(x)) for i, x in enumerate(v[:10])], "run_id string, step bigint, value double")
    got = R.smoothed(h).collect()
    s = np.r_[v[10:0:-1], v, v[-2:-12:-1]]
    want = np.convolve(w, s, "valid")[5:-5]
    assert np.allclose([r["value"] for r in sorted(got, key=lambda r: r["step"]) if r["run_id"] == "long"], want, atol=1e-8)
    assert np.allclose([r["value"] for r in sorted(got, key=lambda r: r["step"]) if r["run_id"] == "short"], v[:10], atol=1e-8)


def test_t_interval_and_timing(spark):
    x = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 10.0)] + [("b", 5.0), ("c", None)], "k string, v double")
    got = {r["k"]: r for r in R.t_interval(x, ["k"], "v").collect()}
    assert got["a"]["low"] == 0.0 and math.isclose(got["a"]["high"], 4 + 3.182 * 4.082483 / 2, abs_tol=1e-3) and got["b"]["low"] is None and "c" not in got


def test_relinks_and_roots(spark):
    schema = "run_id string, experiment string, canonical_condition_id string, native_condition_id string, variant string, seed string, status string, lifecycle_stage string, start_time timestamp_ntz, end_time timestamp_ntz, received_at timestamp_ntz, tags map<string,string>, params map<string,string>"
    make = lambda i, cond, kind, parent=None, stage="active": (i, "e", cond, None, "implemented", "1", "FINISHED", stage, T0, None, T0, {"run.type": kind} | ({"mlflow.parentRunId": parent} if parent else {}), {})
    runs = spark.createDataFrame([make("p1", "A", "condition_parent"), make("c1", "A", "seed_trial", "P-1 "), make("c2", "A", "seed_trial", "gone"), make("c3", "B", "seed_trial", "gone"), make("q1", "C", "condition_parent"), make("q2", "C", "condition_parent"), make("c4", "C", "seed_trial", "gone"), make("d1", "A", "seed_trial", "c1")], schema)
    assert rows(R.relinks(runs)) == {("c2", "relink", "p1"), ("c3", "unresolved", None), ("c4", "ambiguous", None)}
    roots = {r["run_id"]: (r["root"], r["depth"]) for r in R.roots(runs).collect()}
    assert roots["d1"] == ("p1", 2) and roots["c2"] == ("c2", 0) and roots["p1"] == ("p1", 0)


def test_ranges(spark):
    p = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("z", 3)], "k string, at bigint")
    r = spark.createDataFrame([("k", 1, 5), ("k", 8, 7), ("k", 6, 6)], "k string, lo bigint, hi bigint")
    assert rows(intervals.binned_range_join(p, r, ["k"], "at", "lo", "hi", 2)) == {("k", 1, 1, 5), ("k", 5, 1, 5)}
    assert rows(intervals.with_a_point(r, p, ["k"], "at", "lo", "hi", 2)) == {("k", 1, 5)}
    g = spark.createDataFrame([("s", 0, 5, 1), ("s", 7, 9, 2), ("s", 8, 12, 3), ("s", 20, 21, 4)], "s string, a bigint, b bigint, i int")
    assert rows(intervals.idle_gaps(g, "s", "a", "b", "i")) == {("s", 10)}


def test_corpus(spark):
    d = spark.createDataFrame([(1, "You say goodbye and I say hello."), (2, ""), (3, None)], "doc_id bigint, text string")
    t = C.tokens(d.where("doc_id = 1"), words=C.split_preprocessed)
    v = C.vocabulary(t)
    assert {r["word"]: r["word_id"] for r in v.collect()} == {"you": 0, "say": 1, "goodbye": 2, "and": 3, "i": 4, "hello": 5, ".": 6}
    ids = [r["word_id"] for r in C.encoded(t, v).orderBy("pos").collect()]
    assert ids == [0, 1, 2, 3, 4, 1, 5, 6]
    assert [(r["context"], r["target"]) for r in C.contexts(d, C.split_preprocessed).orderBy("pos").collect()][0] == (["you", "say", "and", "i"], "goodbye")
    assert C.tokens(d).where("doc_id > 1").count() == 0 and C.cooccurrence(d.where("doc_id > 1")).count() == 0
    toy = spark.createDataFrame([(1, "a b a c b c")], "doc_id bigint, text string")
    n = {(r["word"], r["other"]): r["n"] for r in C.cooccurrence(toy).collect()}
    assert n == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1 + 1 - 1, ("c", "a"): 1, ("b", "c"): 2, ("c", "b"): 2}
    p = {(r["word"], r["other"]): r["ppmi"] for r in C.ppmi(C.cooccurrence(toy)).collect()}
    assert abs(p["a", "b"] - 0.736966) < 1e-4 and abs(p["a", "c"] - 0.152003) < 1e-4
    assert C.batch_positions(20, 2, 3, 1) == [[3, 4, 5], [13, 14, 15]]


def test_unigram_and_negatives(spark, monkeypatch):
    counts = spark.createDataFrame([(0, 80), (1, 15), (2, 5)], "word_id bigint, n bigint")
    u = {r["word_id"]: r["p"] for r in C.unigram(counts).collect()}
    assert np.allclose([u[i] for i in range(3)], [0.709251, 0.202093, 0.088656], atol=1e-6)
    rows_ = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("word_id"))
    got = S.drawn(rows_, ["k"], C.unigram(counts, 1.0), 5, "word_id")
    assert got.count() == 15000 and got.where("negative = word_id").count() == 0
    share = {r["negative"]: r["n"] / 5000 for r in got.where("word_id = 0").groupBy("negative").agg(F.count("*").alias("n")).collect()}
    assert abs(share[1] - 0.75) < 0.02 and abs(share[2] - 0.25) < 0.02
    assert S.without_replacement(counts, "word_id", "n", 2).count() == 2
    dirt = spark.createDataFrame([(k, w) for k in range(200) for w in (0, 2, None, 99)], "k bigint, word_id bigint")
    sent = sorted(map(tuple, S.drawn(dirt, ["k", "word_id"], C.unigram(counts), 3, "word_id").collect()))
    assert len(sent) == 1200
    monkeypatch.setattr(S, "WORDS_SENT", 0)  # the way for any number of words gives the same draws
    assert sorted(map(tuple, S.drawn(dirt, ["k", "word_id"], C.unigram(counts), 3, "word_id").collect())) == sent
    assert S.drawn(dirt.limit(0), ["k"], C.unigram(counts), 3, "word_id").count() == 0


def test_vectors(spark):
    near = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [2.0, 0.1], 0), (2, [-1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1)], "vec_id bigint, embedding array<float>, label int")
    top = [(r["vec_id"], r["score"]) for r in V.nearest(near, 4).orderBy("rank").collect()]
    assert [t[0] for t in top] == [1, 3, 2, 0] and abs(top[0][1] - 0.998752) < 1e-6 and top[1][1] == 0.0
    w = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [2.0, 0.0], 1), (3, [2.0, 1.0], 1), (4, [-1.0, -1.0], 1)], "vec_id bigint, embedding array<float>, label int")
    assert [r["vec_id"] for r in V.analogies(w).orderBy("rank").collect()] == [3, 4, 0, 1, 2]
    assert rows(V.expected_ranks(w)) == {(0, 3, 1, True)}
    assert V.nearest(near.limit(0)).count() == 0


def test_losses(spark):
    r = spark.createDataFrame([([1.0, 2.0, 0.0], 1), ([0.5, -0.5, 1.0], 2)], "s array<double>, y int")
    got = L.softmax_cross_entropy(r, "s", "y").collect()[0]
    assert got["unit_count"] == 2 and abs(got["loss"] - 0.505868) < 1e-5
    g = r.select(L.softmax_gradient(F.col("s"), F.col("y"), F.lit(2.0)).alias("g")).collect()
    assert all(abs(sum(x["g"])) < 1e-12 for x in g)
    t = spark.createDataFrame([([1.0, 2.0, 0.0], 0), ([1.0, 2.0, 0.0], -1), ([0.0, 0.0, 1.0], 2), ([0.0, 0.0, 1.0], 0)], "s array<double>, y int")
    assert L.softmax_cross_entropy(t, "s", "y").collect()[0]["unit_count"] == 3
    assert L.softmax_cross_entropy(t.where("y = -1"), "s", "y").collect()[0]["loss"] is None
    b = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (-1.0, 1.0), (2.0, 0.0)], "s double, y double")
    assert abs(L.binary_cross_entropy(b, "s", "y").collect()[0]["loss"] - 1.111650) < 1e-5
    assert abs(L.binary_cross_entropy(spark.createDataFrame([(800.0, 0.0)], "s double, y double"), "s", "y").collect()[0]["loss"] - 800) < 1e-9


def test_tensors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(4, 3)), rng.normal(size=(3, 5))
    long = lambda m: spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "i bigint, j bigint, v double")
    back = lambda df, shape: _dense(df, shape)
    assert np.allclose(back(T.matmul(long(a), long(b)), (4, 5)), a @ b)
    assert np.allclose(back(T.reshaped(long(a), 3, 6), (2, 6)), a.reshape(2, 6))
    assert [r["argmax"] for r in T.first_argmax(long(a)).orderBy("i").collect()] == a.argmax(1).tolist()
    assert np.allclose(back(T.standardised(long(a)), (4, 3)), (a - a.mean(0)) / np.sqrt(a.var(0) + 1e-7))
    assert rows(T.first_argmax(spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "i bigint, j bigint, v double"))) == {(0, 0)}
    with pytest.raises(ValueError):
        T.output_size(2, 4, 1, 0)


def _dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[0], r[1]] = r["v"]
    return out


def test_images(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2, 5, 6))
    px = spark.createDataFrame([(n, y, k, float(v)) for (n, y, k), v in np.ndenumerate(x)], "n bigint, y bigint, x bigint, v double")
    cols = T.im2col(px, 5, 6, 3, 2, 1)
    padded = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    for r in cols.collect():
        assert r["v"] == padded[r["n"], r["oy"] * 2 + r["ky"], r["ox"] * 2 + r["kx"]]
    assert {(r["oy"], r["ox"]) for r in cols.collect()} == {(i, j) for i in range(3) for j in range(3)}
    pooled = {(r["n"], r["oy"], r["ox"]): r["v"] for r in T.max_pooled(T.im2col(px, 5, 6, 2, 2)).collect()}
    assert all(v == x[n, 2 * i : 2 * i + 2, 2 * j : 2 * j + 2].max() for (n, i, j), v in pooled.items()) and len(pooled) == 12


def test_optimisers(spark):
    start = spark.createDataFrame([(1, 1.0)], "k int, x double")
    path = lambda rule, rate: [r["x"] for r in O.trajectory(start, rule, lambda p, _: 2 * p, ("x",), 3, rate).orderBy("step").collect()]
    assert np.allclose(path("sgd", 0.1), [1, 0.8, 0.64, 0.512])
    p, v, want = 1.0, 0.0, [1.0]
    for _ in range(3):
        v = 0.9 * v - 0.1 * 2 * p
        p = p + 0.81 * v - 1.9 * 0.1 * 2 * p
        want.append(p)
    assert np.allclose(path("nesterov", 0.1), want)
    p, m, v, want = 1.0, 0.0, 0.0, [1.0]
    for t in range(1, 4):
        g = 2 * p
        m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
        p -= 0.3 * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (math.sqrt(v) + 1e-7)
        want.append(p)
    assert np.allclose(path("adam", 0.3), want)
    table = spark.createDataFrame([(0, 1.0, 0.5, 0.5), (1, 1.0, 0.5, 0.5)], "row bigint, p double, m double, v double")
    g = spark.createDataFrame([(0, 1.0), (0, 1.0)], "row bigint, g double")
    got = {r["row"]: r for r in O.sparse_adam_step(table, g, 1).collect()}
    assert (got[1]["p"], got[1]["m"], got[1]["v"]) == (1.0, 0.5, 0.5) and math.isclose(got[0]["m"], 0.65)


def test_recurrent(spark):
    rng = np.random.default_rng(3)
    seqs = [rng.normal(size=(n, 2)).tolist() for n in (4, 1, 3)] + [[], None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, s array<array<double>>")
    for kind in recurrent.STEPS:
        got = {r["i"]: r["state"] for r in recurrent.encoded(df, F.col("s"), kind, 2, 3).collect()}
        w = recurrent.weights(kind, 2, 3, 1)
        for i, s in enumerate(seqs):
            h, c = np.zeros((1, 3)), np.zeros((1, 3))
            for x in s or []:
                h, c = recurrent.STEPS[kind][0](np.array([x]), h, c, w)
            assert np.allclose(got[i], h[0])
    both = recurrent.encoded(df, F.col("s"), "lstm", 2, 3, both_ways=True).collect()
    assert all(len(r["state"]) == 6 for r in both)


def test_factors(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(40, 6)) @ np.diag([9, 5, 3, 1, 0.5, 0.1]) @ rng.normal(size=(6, 6))
    tall = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "i bigint, e array<double>")
    true = np.linalg.svd(m)[1]
    assert np.allclose(factors.singular_values(tall, "e"), true, atol=1e-6)
    u, s = factors.randomized_svd(T.long_form(tall, "i", "e"), 2, more=4)
    assert np.allclose(s, true[:2], rtol=1e-6)
    q = np.array([r["vec"] for r in u.orderBy("i").collect()])
    assert np.allclose(q.T @ q, np.eye(2), atol=1e-6)
    assert np.allclose(np.abs(q), np.abs(np.linalg.svd(m, full_matrices=False)[0][:, :2]), atol=1e-5)


def test_training_learns(spark):
    rng = np.random.default_rng(5)
    data = [("c", [float(a), float(b)], int(a * b > 0)) for a, b in rng.normal(size=(200, 2))]
    got = O.trained_classifiers(spark.createDataFrame(data, "condition string, x array<double>, label int"), seeds=2, epochs=40)
    last = got.where("epoch = 40").collect()
    assert len(last) == 2 and all(r["accuracy"] > 0.85 for r in last)


def test_arrays(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(A.unit(F.col("a")).alias("u"), A.unit(F.col("b")).alias("z"), A.softmax(F.col("a")).alias("s"), A.one_hot(F.lit(1), 3).alias("o"), A.argmax(F.col("b")).alias("m")).collect()[0]
    assert np.allclose(r["u"], [0.6, 0.8]) and r["z"] == [0.0, 0.0] and abs(sum(r["s"]) - 1) < 1e-12 and r["o"] == [0.0, 1.0, 0.0] and r["m"] == 0


def test_control():
    from warpline.operators import control as K

    assert K.parse_selection(["01,03-05", "e08"], ["e01", "e02", "e03", "e04", "e06", "e08"]) == (["e01", "e03", "e04", "e08"], ["e05"])
    assert K.parse_seeds(["1-3,2"], range(1, 11)) == [1, 2, 3]
    for bad in (lambda: K.parse_seeds(["99"], [1]), lambda: K.parse_selection(["x"], []), lambda: K.parse_selection(["5-2"], []), lambda: K.overridden({}, ["x"])):
        with pytest.raises(ValueError):
            bad()
    assert K.overridden({"a": {"b": 1}}, ["a.c=2", "d=x"]) == {"a": {"b": 1, "c": "2"}, "d": "x"}
    assert K.flattened({"a": {"b": 1, "c": {}}, "d": 2}) == {"a/b": 1, "a/c": {}, "d": 2}
    assert K.in_order({"a": ["b"], "b": ["c", "a"]}, ["a"]) == ["c", "b", "a"]
