"""Vectors as array<double> columns: expressions over higher-order functions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Zero = lambda: F.lit(0.0)


def doubles(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, Zero(), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, Zero(), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """Length one; a zero vector stays zero."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def both(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def softmax(v: Column) -> Column:
    m = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - m))
    return F.transform(e, lambda x: x / total(e))


def argmax(v: Column) -> Column:
    """The first place of the largest value, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def one_hot(label: Column, classes: Column | int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes) - 1), lambda k: (k == label).cast("double"))


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
