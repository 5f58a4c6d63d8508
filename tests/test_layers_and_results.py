import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from warpline.operators import fallbacks as B
from warpline.operators import layers as Y
from warpline.operators import sampling as S
from warpline.operators import tensors as T
from warpline.sources import results


def long(spark, a):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "i bigint, j bigint, v double")


def dense(df, shape, keys=("i", "j")):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[k] for k in keys)] = r["v"]
    return out


def slopes(f, x, d, h=1e-5):
    out = np.zeros_like(x)
    for at in np.ndindex(x.shape):
        up, down = x.copy(), x.copy()
        up[at] += h
        down[at] -= h
        out[at] = ((f(up) - f(down)) * d).sum() / (2 * h)
    return out


def test_backward_passes_are_the_slopes_of_the_forward_ones(spark):
    rng = np.random.default_rng(0)
    x, w, dy, d = rng.normal(size=(4, 3)), rng.normal(size=(3, 2)), rng.normal(size=(4, 2)), rng.normal(size=(4, 3))
    dx, dw, db = Y.affine_gradients(long(spark, x), long(spark, w), long(spark, dy))
    assert np.allclose(dense(dx, (4, 3)), slopes(lambda a: a @ w, x, dy), atol=1e-7) and np.allclose(dense(dw, (3, 2)), x.T @ dy)
    assert np.allclose([r["v"] for r in db.orderBy("j").collect()], dy.sum(0))
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    for name, f in (("relu", lambda a: np.maximum(a, 0)), ("sigmoid", sigmoid), ("tanh", np.tanh), ("identity", lambda a: a)):
        assert np.allclose(dense(Y.through(long(spark, x), long(spark, d), Y.SLOPES[name]), (4, 3)), slopes(f, x, d), atol=1e-7)
    soft = lambda a: np.exp(a) / np.exp(a).sum(1, keepdims=True)
    assert np.allclose(dense(Y.softmax_gradient(long(spark, x), long(spark, d)), (4, 3)), slopes(soft, x, d), atol=1e-7)
    norm = lambda a: (a - a.mean(0)) / np.sqrt(a.var(0) + 1e-7)
    assert np.allclose(dense(Y.batch_norm_gradient(long(spark, x), long(spark, d)), (4, 3)), slopes(norm, x, d), atol=1e-6)


def test_convolution_and_pool_backward(spark):
    rng = np.random.default_rng(1)
    image, filters = rng.normal(size=(1, 4, 4)), rng.normal(size=(2, 2, 2))
    pixels = spark.createDataFrame([(n, y, x, float(v)) for (n, y, x), v in np.ndenumerate(image)], "n bigint, y int, x int, v double")
    f = spark.createDataFrame([(k, y, x, float(v), 0.0) for (k, y, x), v in np.ndenumerate(filters)], "f bigint, ky int, kx int, w double, bias double")
    d = rng.normal(size=(1, 2, 3, 3))
    dy = spark.createDataFrame([(n, k, y, x, float(v)) for (n, k, y, x), v in np.ndenumerate(d)], "n bigint, f bigint, oy int, ox int, v double")

    def forward(a, w=filters):
        return np.array([[[[(a[n, y : y + 2, x : x + 2] * w[k]).sum() for x in range(3)] for y in range(3)] for k in range(2)] for n in range(1)])

    dx, dw, db = Y.convolution_gradients(T.im2col(pixels, 4, 4, 2), f, dy)
    assert np.allclose(dense(dx, (1, 4, 4), ("n", "y", "x")), slopes(forward, image, d), atol=1e-7)
    assert np.allclose(dense(dw, (2, 2, 2), ("f", "ky", "kx")), slopes(lambda w: forward(image, w), filters, d), atol=1e-7)
    assert np.allclose([r["v"] for r in db.orderBy("f").collect()], d.sum((0, 2, 3)))
    g = spark.createDataFrame([(0, y, x, 1.0 + y + x) for y in range(2) for x in range(2)], "n bigint, oy int, ox int, v double")
    back = {(r["y"], r["x"]): r["v"] for r in Y.max_pool_gradient(T.max_pooled(T.im2col(pixels, 4, 4, 2, 2)), g, 2).collect()}
    assert len(back) == 4 and all(image[0, y, x] == image[0, y // 2 * 2 : y // 2 * 2 + 2, x // 2 * 2 : x // 2 * 2 + 2].max() and v == 1 + y // 2 + x // 2 for (y, x), v in back.items())


def test_what_is_made(spark):
    w = [r["v"] for r in Y.initial(spark, 400, 50, "he", 3).collect()]
    assert abs(np.mean(w)) < 2e-3 and abs(np.std(w) / math.sqrt(2 / 400) - 1) < 0.02
    assert sorted(w) == sorted(r["v"] for r in Y.initial(spark, 400, 50, "he", 3).repartition(7).collect())
    to = [r["to"] for r in Y.hashed_permutation(spark, 30).orderBy("j").collect()]
    assert sorted(to) == list(range(30)) and to != list(range(30))
    assert Y.spiral(spark).count() == 300
    got = spark.range(1).select(*[Y.divided(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("inf", 1.0, 0.0), ("minus", -1.0, 0.0), ("nan", 0.0, 0.0), ("two", 4.0, 2.0))]).first()
    assert got["inf"] == math.inf and got["minus"] == -math.inf and math.isnan(got["nan"]) and got["two"] == 2.0


def test_split_takes_the_exact_share_and_rejection_never_the_target(spark):
    for n, test in ((0, 0), (9, 0), (10, 1), (1234, 123)):
        rows = S.split(spark.range(n), "id").collect()
        assert len(rows) == n and sum(r["split"] == "test" for r in rows) == test
    got = S.rejected(spark.range(300).select("id", (F.col("id") % 3).alias("t")), ["id"], "t", 3, 4).collect()
    assert len(got) == 1200 and all(0 <= r["negative"] < 3 and r["negative"] != r["t"] for r in got)


def test_first_source_and_look_up(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    got = {tuple(r) for r in B.first_source([frame([("a", 1)]), frame([("a", 2), ("b", 3), ("b", 4)]), frame([("c", 5), (None, 6)])], ["k"]).collect()}
    assert got >= {("a", 1, 1), ("b", 3, 2), ("b", 4, 2), ("c", 5, 3)} and len(got) == 4  # a null key names nothing
    stored = spark.createDataFrame([("a", "r1"), ("b", "r2"), ("b", "r3"), ("b", "r3")], "k string, run string")
    looked = B.look_up(frame([("a", 0), ("b", 0), ("z", 0)]), stored, ["k"], "run")
    assert {tuple(r) for r in looked.collect()} == {("a", "found", "r1"), ("b", "conflict", None), ("z", "absent", None)}
    with pytest.raises(ValueError):
        B.checked(looked)


def test_kept_results_are_built_once(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(5)
    for _ in range(3):
        assert results.kept(spark, {"b": 1, "a": [2]}, build, str(tmp_path)).count() == 5
    results.kept(spark, {"a": [2], "b": 2}, build, str(tmp_path))
    assert len(built) == 2 and results.digest({"b": 1, "a": [2]}) == results.digest({"a": [2], "b": 1})
    with pytest.raises(ValueError):
        results.canonical({"x": float("nan")})


def test_archives(tmp_path):
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    (source / "sub" / "b.txt").write_text("b")
    (source / "a.txt").write_text("a" * 10)
    listed = results.archived(source, tmp_path / "x.zip")
    assert [r[0] for r in listed] == ["a.txt", "sub/b.txt"]
    assert results.extracted(tmp_path / "x.zip", tmp_path / "out") == ["a.txt", "sub/b.txt"] and (tmp_path / "out" / "sub" / "b.txt").read_text() == "b"
    for name in ("../evil.txt", "/evil.txt", "c:/evil.txt"):
        with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
            z.writestr(name, "x")
            z.writestr("MANIFEST.json", results.canonical([{"path": name, "size_bytes": 1, "sha256": ""}]))
        with pytest.raises(ValueError, match="leads out"):
            results.extracted(tmp_path / "bad.zip", tmp_path / "out2")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("a", "changed")
        z.writestr("MANIFEST.json", results.canonical([{"path": "a", "size_bytes": 1, "sha256": "0"}]))
    with pytest.raises(ValueError, match="archived"):
        results.extracted(tmp_path / "bad.zip", tmp_path / "out2")
    assert not (tmp_path / "out2").exists()
