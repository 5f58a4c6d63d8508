"""Layers and their backward passes on the long form (i, j, v), and what is made rather than read: ranges, weights, spirals.

A backward pass is the same kind of plan as the forward one: joins on the shared index with sums combined before the
shuffle. Parameters (a matrix of features by outputs, a vector of features) are dimensions; examples are rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.operators import tensors as T


def broadcasted(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], along: str) -> DataFrame:
    """(i, j, v) of f(a, b), b being one row (j, v) for ``along='i'``, one column (i, v) for ``'j'``, or one cell (v) for ``'ij'``."""
    other = b.withColumnRenamed("v", "_b")
    rows = a.join(other, {"i": "j", "j": "i"}[along]) if along != "ij" else a.crossJoin(F.broadcast(other))  # one row
    return rows.select("i", "j", f(F.col("v"), F.col("_b")).alias("v"))


def divided(a: Column, b: Column) -> Column:
    """With infinities and NaN where b is zero, as floating-point numbers have it."""
    endless = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, endless).otherwise(F.try_divide(a, b))


def assigned(long: DataFrame, where: Column, value: Column) -> DataFrame:
    """The cells with the value where the condition on (i, j, v) holds."""
    return long.select("i", "j", F.when(where, value).otherwise(F.col("v")).alias("v"))


def normal(*keys: Column | str, seed: int = 0) -> Column:
    """A standard normal number that depends on the keys and the seed alone (by the polar form of two uniform ones)."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *keys), F.lit((1 << 53) - 1)) + 1) / F.lit(float(1 << 53))
    return F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * math.pi * u(2))


def scale(kind: str, fan_in: Column, fan_out: Column, std: float = 0.01) -> Column:
    """The deviation of initial weights: he (or relu), xavier (or sigmoid, tanh), glorot over both sides, or a number."""
    if kind in ("he", "relu"):
        return F.sqrt(2.0 / fan_in)
    if kind in ("xavier", "sigmoid", "tanh"):
        return F.sqrt(1.0 / fan_in)
    return F.sqrt(2.0 / (fan_in + fan_out)) if kind == "glorot" else F.lit(std)


def initial(spark, rows: int, columns: int, kind: str = "he", seed: int = 0) -> DataFrame:
    """(i, j, v): a weight matrix, the same whatever the partitions."""
    cells = spark.range(rows * columns).select(F.expr(f"id div {columns}").alias("i"), (F.col("id") % columns).alias("j"))
    return cells.withColumn("v", normal("i", "j", seed=seed) * scale(kind, F.lit(float(rows)), F.lit(float(columns))))


# ---- forward and backward ----


def affine_gradients(x: DataFrame, w: DataFrame, dy: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dx, dw, db) of y = x w + b, for cells (i, j, v); db is (j, v)."""
    return T.matmul(dy, T.transposed(w)), T.matmul(T.transposed(x), dy), dy.groupBy("j").agg(F.sum("v").alias("v"))


def through(x: DataFrame, dy: DataFrame, slope: Callable[[Column], Column]) -> DataFrame:
    """(i, j, v): dy times the slope of an activation at x."""
    return x.join(dy.withColumnRenamed("v", "_d"), ["i", "j"]).select("i", "j", (F.col("_d") * slope(F.col("v"))).alias("v"))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


#: The slopes of the activations by name.
SLOPES: dict[str, Callable[[Column], Column]] = {
    "identity": lambda x: F.lit(1.0), "relu": lambda x: (x > 0).cast("double"),
    "sigmoid": lambda x: _sigmoid(x) * (1 - _sigmoid(x)), "tanh": lambda x: 1 - F.tanh(x) * F.tanh(x),
}


def softmax_gradient(long: DataFrame, dy: DataFrame) -> DataFrame:
    """(i, j, v): through the softmax of each row."""
    w = Window.partitionBy("i")
    rows = long.join(dy.withColumnRenamed("v", "_d"), ["i", "j"]).withColumn("e", F.exp(F.col("v") - F.max("v").over(w)))
    rows = rows.withColumn("p", F.col("e") / F.sum("e").over(w))
    return rows.select("i", "j", (F.col("p") * (F.col("_d") - F.sum(F.col("p") * F.col("_d")).over(w))).alias("v"))


def batch_norm_gradient(x: DataFrame, dy: DataFrame, eps: float = 1e-7) -> DataFrame:
    """(i, j, v): through the normalisation of each column by its mean and population variance."""
    rows = x.join(dy.withColumnRenamed("v", "_d"), ["i", "j"])
    s = rows.groupBy("j").agg(F.avg("v").alias("m"), F.sqrt(F.var_pop("v") + eps).alias("s"), F.avg("_d").alias("md"), F.avg(F.col("_d") * F.col("v")).alias("mdx"))
    at = rows.join(s, "j").withColumn("z", (F.col("v") - F.col("m")) / F.col("s"))
    mdz = (F.col("mdx") - F.col("md") * F.col("m")) / F.col("s")
    return at.select("i", "j", ((F.col("_d") - F.col("md") - F.col("z") * mdz) / F.col("s")).alias("v"))


def dropped_out(long: DataFrame, ratio: float, u: Column, training: bool = True, inverted: bool = False) -> DataFrame:
    """Cells whose uniform number u is beyond the ratio stay. The plain form scales when it isn't training, the inverted one when it is."""
    keep = 1 - ratio
    if not training:
        return long.select("i", "j", (F.col("v") * (1.0 if inverted else keep)).alias("v"))
    return long.select("i", "j", F.when(u > ratio, F.col("v") * (1 / keep if inverted else 1.0)).otherwise(0.0).alias("v"))


def convolution_gradients(columns: DataFrame, filters: DataFrame, dy: DataFrame, stride: int = 1, padding: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dx, dw, db) of T.convolved for dy (n, f, oy, ox, v): pixels (n, y, x, v), weights (f, ky, kx, v), biases (f, v)."""
    d = dy.withColumnRenamed("v", "_d")
    dw = columns.join(d, ["n", "oy", "ox"]).groupBy("f", "ky", "kx").agg(F.sum(F.col("v") * F.col("_d")).alias("v"))
    back = d.join(filters.select("f", "ky", "kx", "w"), "f").groupBy("n", "oy", "ox", "ky", "kx").agg(F.sum(F.col("_d") * F.col("w")).alias("v"))
    # only the windows' places inside the image have a pixel
    back = back.join(columns.select("n", "oy", "ox", "ky", "kx"), ["n", "oy", "ox", "ky", "kx"], "left_semi")
    return T.col2im(back, stride, padding), dw, dy.groupBy("f").agg(F.sum("v").alias("v"))


def max_pool_gradient(pooled: DataFrame, dy: DataFrame, stride: int, padding: int = 0) -> DataFrame:
    """(n, y, x, v): each gradient (n, oy, ox, v) goes to the first largest pixel of its window."""
    routed = pooled.select("n", "oy", "ox", "ky", "kx").join(dy, ["n", "oy", "ox"])
    return T.col2im(routed, stride, padding)


def attended(weights: DataFrame, states: DataFrame) -> DataFrame:
    """(example, step, k, v): the states (example, position, k, v) in the mean of the weights (example, step, position, weight)."""
    rows = weights.join(states, ["example", "position"])
    return rows.groupBy("example", "step", "k").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))


def attended_gradients(weights: DataFrame, states: DataFrame, d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gradients of the weights (example, step, position, v), of the states (example, position, k, v)) for d (example, step, k, v)."""
    g = d.withColumnRenamed("v", "_d")
    of_weights = states.join(g, ["example", "k"]).groupBy("example", "step", "position").agg(F.sum(F.col("v") * F.col("_d")).alias("v"))
    of_states = weights.join(g, ["example", "step"]).groupBy("example", "position", "k").agg(F.sum(F.col("weight") * F.col("_d")).alias("v"))
    return of_weights, of_states


# ---- images ----


def permuted(pixels: DataFrame, permutation: DataFrame) -> DataFrame:
    """Cells (i, j, v) with their j replaced by the permutation (j, to)."""
    return pixels.join(permutation, "j").select("i", F.col("to").alias("j"), "v")


def hashed_permutation(spark, n: int, seed: int = 0) -> DataFrame:
    """(j, to): a permutation of 0..n-1 by a digest of each number, so the same in any engine. n is a dimension."""
    order = F.row_number().over(Window.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|{seed}"))), "id")) - 1
    return spark.range(n).select(F.col("id").alias("j"), order.cast("bigint").alias("to"))


def tiled(images: DataFrame, height: int, width: int, across: int, gutter: int = 1) -> DataFrame:
    """(y, x, v) of images (n, y, x, v) laid side by side, ``across`` in a row; the gutters between them have no cell (NaN in a dense picture)."""
    row, column = F.expr(f"n div {across}"), F.col("n") % across
    return images.select((row * (height + gutter) + F.col("y")).alias("y"), (column * (width + gutter) + F.col("x")).alias("x"), "v")


def spiral(spark, classes: int = 3, points: int = 100, noise: float = 0.2, seed: int = 0) -> DataFrame:
    """(label, place, x, y): arms of a spiral that can't be told apart by a line."""
    r = F.col("place") / float(points)
    angle = F.col("label") * 4.0 + r * 4.0 + (noise * normal("label", "place", seed=seed) if noise else F.lit(0.0))
    cells = spark.range(classes * points).select(F.expr(f"id div {points}").alias("label"), (F.col("id") % points).alias("place"))
    return cells.select("label", "place", (r * F.sin(angle)).alias("x"), (r * F.cos(angle)).alias("y"))
