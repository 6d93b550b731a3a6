"""Quantile pivots: cuts of the key space into intervals of equal mass.

Each rank's pivots come from few numbers (a histogram of at most 256 bins and buffered samples), so
the functions on one context take arrays; the DataFrame forms do the same for every epoch at once.
Both are the piecewise-linear inverse of the cumulative mass, read off at equal steps.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_PIVOTS = 256
#: Below this width pivots are uniform; mass counts as none below the tolerance.
LEAST_WIDTH, TOLERANCE = 1e-3, 1e-5


@dataclass(frozen=True)
class Context:
    """A partitioning under way: its range, bins and counts, and samples outside the range (sorted)."""

    bins: tuple[float, ...] = ()
    counts: tuple[float, ...] = ()
    left: tuple[float, ...] = ()
    right: tuple[float, ...] = ()
    first: bool = False

    @property
    def range(self) -> tuple[float, float]:
        return (self.bins[0], self.bins[-1]) if self.bins else (0.0, 0.0)


@dataclass(frozen=True)
class Pivots:
    values: tuple[float, ...]
    width: float

    def __str__(self) -> str:
        return serialize(self.values)


@dataclass
class Layout:
    """The partitioning in force: versions of bins, one for each installed set of pivots."""

    bins: tuple[float, ...] = ()
    counts: list[int] = field(default_factory=list)
    version: int = 0

    def install(self, pivots: Pivots, after=None) -> None:
        """Take pivots over as bins: they may widen the range but not narrow it. Counts start at zero."""
        p = pivots.values
        if self.bins and not (p[0] < self.bins[0] + LEAST_WIDTH and p[-1] > self.bins[-1] - LEAST_WIDTH):
            raise ValueError(f"pivots [{p[0]}, {p[-1]}] narrow the range [{self.bins[0]}, {self.bins[-1]}]")
        self.bins, self.counts, self.version = p, [0] * (len(p) - 1), self.version + 1
        if after:
            after(self)


def range_bounds(c: Context) -> tuple[float, float]:
    """The range with samples put in; a missing buffer counts as zero where the maximum is taken."""
    lo, hi = c.range
    ends = [b for b in (c.left, c.right) if b]
    start = min(b[0] for b in ends) if ends else 0.0
    if not c.first:
        start = min(start, lo) if c.left else lo
    return start, max([0.0, hi, *(b[-1] for b in ends)])


def from_sample(sample: tuple[float, ...], n: int) -> Pivots:
    """From a sorted sample: the ends, and values at fractional places i * (m - 1) / n between them."""
    m = len(sample)
    if m < 2:
        return Pivots((0.0,) * n, 0.0)
    x = np.asarray(sample, float)
    inner = np.interp(np.arange(1, n - 1) * (m - 1) / n, np.arange(m), x)
    return Pivots((float(x[0]), *map(float, inner), float(x[-1])), m / n)


def from_all(c: Context, n: int) -> Pivots:
    """From samples below the range, the histogram, and samples above it: equal masses between pivots."""
    start, end = range_bounds(c)
    n_left, n_right = len(c.left), len(c.right)
    counts = np.asarray(c.counts, float)
    mass = n_left + counts.sum() + n_right
    step = mass / (n - 1)
    if step < TOLERANCE:
        return Pivots((0.0,) * n, 0.0)
    lo, hi = c.range
    target = np.arange(1, n - 1) * step
    below = np.interp(target, np.arange(n_left + 1), [*c.left, lo]) if n_left else target
    # Within the histogram mass grows linearly in each bin; empty bins are jumped over.
    ends = n_left + np.concatenate([[0.0], np.cumsum(counts)])
    bin_ = np.clip(np.searchsorted(ends, target - TOLERANCE, side="right") - 1, 0, max(len(counts) - 1, 0))
    if len(counts):
        b, full = np.asarray(c.bins, float), np.maximum(counts[bin_], TOLERANCE)
        within = b[bin_] + np.clip((target - ends[bin_]) / full, 0, 1) * (b[bin_ + 1] - b[bin_])
    else:
        within = np.full(len(target), lo)
    above = np.interp(target - ends[-1], np.arange(n_right + 1), [hi, *c.right]) if n_right else np.full(len(target), hi)
    inner = np.where(target <= n_left - TOLERANCE, below, np.where(target <= ends[-1] + TOLERANCE, within, above))
    return Pivots((start, *map(float, inner), end), float(step))


def pivots(c: Context, n: int) -> Pivots:
    """From the samples alone at first, from everything later; uniform on [0, 1] if there is no mass to speak of."""
    if not 2 <= n <= MOST_PIVOTS:
        raise ValueError(f"2 to {MOST_PIVOTS} pivots")
    got = from_sample(c.left, n) if c.first else from_all(c, n)
    if got.width < LEAST_WIDTH:
        got = Pivots(tuple(k / (n - 1) for k in range(n)), 1 / (n - 1))
    if any(a >= b for a, b in zip(got.values, got.values[1:], strict=False)):
        raise ValueError(f"pivots don't increase: {got}")
    return got


def serialize(values) -> str:
    return ",".join(f"{v:.6f}" for v in values)


def bucket(key: Column, cuts: tuple[float, ...]) -> Column:
    """The interval (from 0) that a key falls into; -1 below the first pivot."""
    literal = F.array(*[F.lit(float(c)) for c in cuts])
    return (F.size(F.filter(literal, lambda c: c <= key)) - 1).cast("int")


def histogram(keys: DataFrame, bins: int) -> DataFrame:
    """epoch, bin, lo, hi, n of keys (epoch, key) in bins of equal width over each epoch's range; empty bins too."""
    ends = keys.groupBy("epoch").agg(F.min("key").cast("double").alias("lo"), F.max("key").cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("key").cast("double") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = keys.join(ends, "epoch").groupBy("epoch", place.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("epoch", "lo", width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    met = grid.join(counted, ["epoch", "bin"], "left")
    return met.select("epoch", "bin", (F.col("lo") + F.col("bin") * F.col("_w")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def from_histogram(hist: DataFrame, n: int) -> DataFrame:
    """epoch, idx, pivot: n pivots for each epoch's histogram (epoch, bin, lo, hi, n)."""
    order = Window.partitionBy("epoch").orderBy("bin")
    h = hist.withColumn("_to", F.sum("n").over(order)).withColumn("_from", F.col("_to") - F.col("n"))
    total = hist.groupBy("epoch").agg(F.sum("n").alias("_mass"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    targets = total.select("*", F.explode(F.sequence(F.lit(1), F.lit(n - 2))).alias("idx")).withColumn("_t", F.col("idx") * F.col("_mass") / (n - 1)) if n > 2 else None
    ends = total.select("epoch", F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.col("_lo").alias("pivot")), F.struct(F.lit(n - 1).alias("idx"), F.col("_hi").alias("pivot")))).alias("e")).select("epoch", "e.idx", "e.pivot")
    if targets is None:
        return ends
    met = targets.join(h.where("n > 0"), "epoch").where((F.col("_t") > F.col("_from")) & (F.col("_t") <= F.col("_to")))
    return met.select("epoch", "idx", (F.col("lo") + (F.col("_t") - F.col("_from")) / F.col("n") * (F.col("hi") - F.col("lo"))).alias("pivot")).unionByName(ends)


def sample_pivots(keys: DataFrame, n: int) -> DataFrame:
    """epoch, idx, pivot from each epoch's keys taken as its sample (at least two)."""
    order = Window.partitionBy("epoch").orderBy("key")
    placed = keys.select("epoch", F.col("key").cast("double").alias("key")).withColumn("_i", F.row_number().over(order) - 1).withColumn("_next", F.lead("key").over(order))
    size = placed.groupBy("epoch").agg(F.count("*").alias("_m")).where("_m > 1")
    at = F.when(F.col("idx") == n - 1, F.col("_m") - 1).otherwise(F.col("idx") * (F.col("_m") - 1) / n)
    targets = size.select("epoch", "_m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx")).withColumn("_at", at).withColumn("_i", F.floor("_at").cast("int"))
    met = targets.join(placed, ["epoch", "_i"])
    frac = F.col("_at") - F.col("_i")
    return met.select("epoch", "idx", F.when(frac > 0, (1 - frac) * F.col("key") + frac * F.col("_next")).otherwise(F.col("key")).alias("pivot"))
