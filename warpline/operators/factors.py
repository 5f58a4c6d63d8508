"""Singular values and low-rank factors of matrices that are spread over rows.

Only k x k (or d x d, for d columns) matrices reach the driver; tall factors stay frames (i, vec).
Columns of the factors are unique up to their sign.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.operators.sampling import uniform
from warpline.operators.tensors import gram
from warpline.session import settled


def singular_values(rows: DataFrame, vector: str) -> list[float]:
    """Of a tall matrix with few columns, from the eigenvalues of X'X."""
    cells = gram(rows, vector).collect()  # d x d
    d = 1 + max((r["i"] for r in cells), default=-1)
    g = np.zeros((d, d))
    for r in cells:
        g[r["i"], r["j"]] = r["v"]
    return np.sqrt(np.maximum(0, np.linalg.eigvalsh(g)[::-1])).tolist()


def _times(a: DataFrame, b: DataFrame, k: int, row: str = "i", inner: str = "j") -> DataFrame:
    """(i, vec) of a @ b for a = (i, j, v) and b = (i, vec) of k columns."""
    j = a.join(b.select(F.col("i").alias(inner), "vec"), inner)
    return j.groupBy(F.col(row).alias("i")).agg(F.array(*[F.sum(F.col("v") * F.col("vec")[c]) for c in range(k)]).alias("vec"))


def _small_gram(y: DataFrame, k: int) -> np.ndarray:
    cells = y.agg(*[F.sum(F.col("vec")[a] * F.col("vec")[b]).alias(f"c{a}_{b}") for a in range(k) for b in range(a, k)]).collect()[0]
    g = np.zeros((k, k))
    for a in range(k):
        for b in range(a, k):
            g[a, b] = g[b, a] = cells[f"c{a}_{b}"] or 0.0
    return g


def _by(y: DataFrame, m: np.ndarray) -> DataFrame:
    """(i, vec) of y @ m for a small m."""
    k, n = m.shape
    return y.select("i", F.array(*[sum((F.col("vec")[a] * F.lit(float(m[a, c])) for a in range(k)), F.lit(0.0)) for c in range(n)]).alias("vec"))


def _orthonormal(y: DataFrame, k: int) -> DataFrame:
    w, v = np.linalg.eigh(_small_gram(y, k))
    return _by(y, v / np.sqrt(np.maximum(w, max(w.max(), 1e-30) * 1e-12)))


def randomized_svd(matrix: DataFrame, k: int, iterations: int = 2, more: int = 4, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """((i, vec) of U, the k largest singular values) of (i, j, v), by power iterations on a random start.

    The start is hashed from the column's key, so it is the same whatever the partitions.
    """
    n = k + more
    start = matrix.select(F.col("j").alias("i")).distinct()
    start = start.select("i", F.array(*[F.sqrt(-2 * F.ln(1 - uniform("i", F.lit(c), seed=seed))) * F.cos(6.283185307179586 * uniform("i", F.lit(c), seed=seed + 1)) for c in range(n)]).alias("vec"))
    y = settled(_orthonormal(settled(_times(matrix, start, n)), n))
    for _ in range(iterations):
        z = settled(_times(matrix, y, n, row="j", inner="i"))
        y = settled(_orthonormal(settled(_times(matrix, _orthonormal(z, n), n)), n))
    b = settled(_times(matrix, y, n, row="j", inner="i"))
    w, v = np.linalg.eigh(_small_gram(b, n))
    order = np.argsort(w)[::-1][:k]
    return _by(y, v[:, order]), np.sqrt(np.maximum(0, w[order])).tolist()
