"""Interval algebra and comparisons as column expressions.

Ranges are closed.  NaN keys are kept out of ranges (``valid_key``); an inverted query is an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import flt

CLOSED = ("both", "left", "right", "neither")
EPSILON = 1e-3


def check_range(lo: float, hi: float) -> None:
    if not lo <= hi:
        raise ValueError(f"not a range: [{lo}, {hi}]")


def in_range(key: Column, lo: float | Column, hi: float | Column, closed: str = "both") -> Column:
    """Is the key in the range, with the named ends included?"""
    if closed not in CLOSED:
        raise ValueError(f"closed must be one of {CLOSED}")
    lo, hi = flt(lo), flt(hi)
    low = key >= lo if closed in ("both", "left") else key > lo
    high = key <= hi if closed in ("both", "right") else key < hi
    return low & high


def covers(point: float | Column, lo: Column, hi: Column) -> Column:
    """Is the point in the closed range?"""
    p = flt(point)
    return (lo <= p) & (hi >= p)


def overlaps(lo1: Column, hi1: Column, lo2: float | Column, hi2: float | Column) -> Column:
    """Do two closed ranges share a point?"""
    return (lo1 <= flt(hi2)) & (hi1 >= flt(lo2))


def inside(point: float | Column, lo: Column, hi: Column) -> Column:
    """Is the point strictly inside the range?"""
    p = flt(point)
    return (lo < p) & (hi > p)


def zero_width(lo: Column, hi: Column) -> Column:
    return lo == hi


def valid_range(lo: Column, hi: Column) -> Column:
    """An empty range is null at both ends and not valid."""
    return F.coalesce(lo <= hi, F.lit(False))


def queries_overlap(a: str, b: str) -> Column:
    """Do the queries of two aliased tables have an epoch and a point in common?"""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "epoch") == c(b, "epoch")) & (c(a, "qbegin") <= c(b, "qend")) & (c(a, "qend") >= c(b, "qbegin"))


def about_eq(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return F.abs(a - b) < eps


def about_gt(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return a > b + eps


def about_ge(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return a > b - eps


def about_lt(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return a < b - eps


def about_le(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return a < b + eps


def valid_key(key: Column) -> Column:
    """Keys that order as numbers do: neither null nor NaN."""
    return key.isNotNull() & ~F.isnan(key)
