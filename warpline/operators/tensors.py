"""Tensor algebra on two forms: rows with a vector each, and long relations (i, j, v) without the zeros.

Everything is relational or an expression over arrays, so it runs in the JVM and spreads over rows; a matrix
product is a join on the inner index with map-side partial sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.functions import arrays as A


def long_form(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(i, j, v)"""
    return rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("i"), F.posexplode(A.doubles(vector)).alias("j", "v"))


def row_form(long: DataFrame) -> DataFrame:
    """(i, vec) in order of j."""
    return long.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda r: r["v"]).alias("vec"))


def transposed(long: DataFrame) -> DataFrame:
    return long.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of a @ b."""
    inner = a.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("y")), "k")
    return inner.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def gram(rows: DataFrame, vector: str) -> DataFrame:
    """(i, j, v) of X'X: one matrix product a batch of rows, whose cells are added up, so nothing is joined.

    Vectors of several lengths add to the cells that they have.
    """

    def run(batches):
        for b in batches:
            v = b.column(0)
            sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                x = v.filter(pa.array(sizes == size)).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(size))
                i, j = np.indices((int(size), int(size)))
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array((x.T @ x).ravel())], names=["i", "j", "v"])

    return rows.where(F.col(vector).isNotNull()).select(A.doubles(vector).alias("x")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def elementwise(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """(i, j, v) over the cells of both; a missing cell is 0."""
    both = a.withColumnRenamed("v", "x").join(b.withColumnRenamed("v", "y"), ["i", "j"], "full_outer")
    return both.select("i", "j", f(F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))).alias("v"))


def reduced(long: DataFrame, axis: str | None, how: str = "sum") -> DataFrame:
    """Sum, mean or max over all cells, or of each index of the other axis."""
    agg = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]("v").alias("v")
    return long.agg(agg) if axis is None else long.groupBy("i" if axis == "j" else "j").agg(agg)


def first_argmax(long: DataFrame) -> DataFrame:
    """(i, argmax): the smallest j of the largest value."""
    return long.groupBy("i").agg(F.max(F.struct("v", (-F.col("j")).alias("n"))).alias("m")).select("i", (-F.col("m.n")).cast("int").alias("argmax"))


def reshaped(long: DataFrame, old_columns: int, new_columns: int) -> DataFrame:
    flat = F.col("i") * old_columns + F.col("j")
    return long.select(F.floor(flat / new_columns).cast("bigint").alias("i"), F.pmod(flat, F.lit(new_columns)).cast("bigint").alias("j"), "v")


def gathered(ids: DataFrame, table: DataFrame) -> DataFrame:
    """(pos, row, vec): rows of a table by their number."""
    return ids.join(table, "row")


def scatter_added(ids: DataFrame, long: DataFrame) -> DataFrame:
    """(row, j, v): the values of (pos, j, v) added to rows (pos, row); equal rows accumulate."""
    return long.join(ids, "pos").groupBy("row", "j").agg(F.sum("v").alias("v"))


def standardised(long: DataFrame, eps: float = 1e-7) -> DataFrame:
    """(i, j, v) by the mean and the population variance of each column, as batch normalisation does."""
    stats = long.groupBy("j").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    return long.join(stats, "j").select("i", "j", ((F.col("v") - F.col("m")) / F.sqrt(F.col("s") + eps)).alias("v"))


def numerical_gradient(rows: DataFrame, f: Callable[[Sequence[Column]], Column], names: Sequence[str], h: float = 1e-4) -> DataFrame:
    """The central differences of a function of columns, as columns grad_<name>."""
    at = lambda k, d: f([F.col(n) + (d if n == k else 0) for n in names])
    return rows.select("*", *[((at(k, h) - at(k, -h)) / (2 * h)).alias(f"grad_{k}") for k in names])


def output_size(size: int, kernel: int, stride: int, padding: int) -> int:
    if kernel > size + 2 * padding:
        raise ValueError("the kernel is larger than the padded image")
    return (size + 2 * padding - kernel) // stride + 1


def im2col(pixels: DataFrame, height: int, width: int, kernel: int, stride: int = 1, padding: int = 0) -> DataFrame:
    """(n, oy, ox, ky, kx, v) of pixels (n, y, x, v): every pixel tells the windows that hold it; padding gives no row."""
    oh, ow = output_size(height, kernel, stride, padding), output_size(width, kernel, stride, padding)
    span = F.sequence(F.lit(0), F.lit(kernel - 1))
    rows = pixels.withColumn("ky", F.explode(span)).withColumn("kx", F.explode(span))
    sy, sx = F.col("y") + padding - F.col("ky"), F.col("x") + padding - F.col("kx")
    rows = rows.where((sy >= 0) & (sx >= 0) & (sy % stride == 0) & (sx % stride == 0)).withColumns({"oy": F.expr(f"(y + {padding} - ky) div {stride}"), "ox": F.expr(f"(x + {padding} - kx) div {stride}")})
    return rows.where((F.col("oy") < oh) & (F.col("ox") < ow)).select("n", "oy", "ox", "ky", "kx", "v")


def col2im(columns: DataFrame, stride: int = 1, padding: int = 0) -> DataFrame:
    """(n, y, x, v): overlapping windows are added up."""
    y, x = F.col("oy") * stride + F.col("ky") - padding, F.col("ox") * stride + F.col("kx") - padding
    return columns.groupBy("n", y.alias("y"), x.alias("x")).agg(F.sum("v").alias("v"))


def convolved(columns: DataFrame, filters: DataFrame) -> DataFrame:
    """(n, f, oy, ox, v) of windows and filters (f, ky, kx, w, bias)."""
    out = columns.join(filters.select("f", "ky", "kx", "w"), ["ky", "kx"]).groupBy("n", "f", "oy", "ox").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    return out.join(filters.select("f", "bias").distinct(), "f").select("n", "f", "oy", "ox", (F.col("s") + F.col("bias")).alias("v"))


def max_pooled(columns: DataFrame) -> DataFrame:
    """(n, oy, ox, v, ky, kx): the maximum of each window and its first place, for the way back."""
    best = F.max(F.struct("v", (-F.col("ky")).alias("a"), (-F.col("kx")).alias("b")))
    return columns.groupBy("n", "oy", "ox").agg(best.alias("m")).select("n", "oy", "ox", F.col("m.v").alias("v"), (-F.col("m.a")).alias("ky"), (-F.col("m.b")).alias("kx"))


def attention(queries: DataFrame, states: DataFrame) -> DataFrame:
    """(example, step, position, weight) from (example, step, q) and (example, position, h): dot scores, softmax over the positions."""
    s = queries.join(states, "example").select("example", "step", "position", A.dot(F.col("q"), F.col("h")).alias("s"))
    w = Window.partitionBy("example", "step")
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    return e.select("example", "step", "position", (F.col("e") / F.sum("e").over(w)).alias("weight"))
