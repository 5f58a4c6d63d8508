"""Comparable forms of identifiers that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_id(c: Column | str) -> Column:
    """Lower case, without blanks and dashes; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, r"[\s\-]+", ""))


def bare_digest(c: Column | str) -> Column:
    """``bare_id`` without an algorithm prefix such as ``sha256:``."""
    return F.regexp_replace(bare_id(c), r"^[a-z]+[0-9]*[:=]", "")


def bare_path(c: Column | str) -> Column:
    """Lower case path with single forward slashes, no blanks around it, no leading ``./`` and no trailing slash."""
    c = F.col(c) if isinstance(c, str) else c
    p = F.regexp_replace(F.lower(F.trim(c)), r"[/\\]+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), r"/$", "")


def usable(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
