"""Numbers with the conventions of the run analytics: no NULL deviation, no error on zero, finite only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def number(c: Column | str) -> Column:
    """A cell as a double, or null: of text that is no number, and of values that aren't finite."""
    c = F.col(c) if isinstance(c, str) else c
    v = c.try_cast("double")
    return F.when(finite(v), v)


def divided(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(otherwise)).otherwise(a / b)


def deviation(c: Column | str) -> Column:
    """The sample standard deviation, 0 of one value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded, so that results don't depend on the order of additions; never -0."""
    return F.round(c, digits) + F.lit(0.0)


def half_up(c: Column, digits: int) -> Column:
    """Rounded, with means of decimal readings that lie on a tie taken up, however the sum was added."""
    return F.round(c + 1e-9, digits) + F.lit(0.0)
