"""Pivots of all ranks of all epochs: mergeable summaries of where the mass of keys lies.

A rank's mass is a row of segments (lo, hi, mass), within which it grows linearly: the bins of the layout in force with
their counts, and a segment of mass one to the next key for each key out of bounds.  Its summary is the inverse of the
cumulative mass at n equal steps: n pivots.  Summaries are merged by adding cumulative masses and reading the sum off at
n equal steps again, ``fan`` of them at a time, so no task holds more than ``fan`` summaries and no level needs more than
the one before; records themselves are read once and are never ordered across ranks.

Error: a summary is exact at its pivots, so at any key it is wrong by less than one step (mass / (n - 1)).  Errors of
merged summaries add up to one step of the sum, and each level of merging adds one more: ``levels + 1`` steps of the
epoch's mass at most, beside what the bins of the layout in force themselves blur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import valid_key
from ..runtime import ship
from .pivots import MOST_PIVOTS

#: Summaries merged by one task, and numbers of all layouts at most (they go to every task).
FAN, MOST_CUTS = 64, 5_000_000
#: A target this share of the mass past the end of a segment still lies in it.
SLACK = 1e-9


def rank_segments(keys: DataFrame, layouts: DataFrame) -> DataFrame:
    """epoch, rank, lo, hi, mass from keys (epoch, rank, key) and the layouts in force (epoch, bins: rising cuts).

    The range is closed.  Keys of an epoch without a layout are samples: a segment from each to the next.  Empty bins have no row.
    """
    ship(keys.sparkSession)
    held = {r["epoch"]: r["bins"] for r in layouts.select("epoch", "bins").take(MOST_CUTS // MOST_PIVOTS + 1)}
    if sum(map(len, held.values())) > MOST_CUTS:
        raise ValueError(f"layouts of more than {MOST_CUTS} cuts; take fewer epochs at a time")
    cuts = keys.sparkSession.sparkContext.broadcast({e: np.array(b, float) for e, b in held.items()})  # its size was looked at

    def count(batches):
        """Keys within a layout as counts of its bins (once a batch), others as they are."""
        for b in batches:
            epoch, rank, key = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            out = []
            for e in np.unique(epoch):
                own, bins = epoch == e, cuts.value.get(int(e))
                k = key[own].astype(float)
                r = rank[own]
                if bins is None:
                    out.append((e, r, k, np.full(len(k), None), np.ones(len(k), np.int64)))
                    continue
                inside = (k >= bins[0]) & (k <= bins[-1])
                out.append((e, r[~inside], k[~inside], np.where(k[~inside] < bins[0], -1, len(bins) - 1), np.ones((~inside).sum(), np.int64)))
                at = np.clip(np.searchsorted(bins, k[inside], side="right") - 1, 0, len(bins) - 2)
                pair, n = np.unique(np.stack([r[inside], at]), axis=1, return_counts=True)
                out.append((e, pair[0], bins[pair[1]], pair[1], n))
            for e, r, k, at, n in out:
                side = pa.array([None if a is None else int(a) for a in at], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), e, np.int32)), pa.array(r.astype(np.int32)), pa.array(k), side, pa.array(n)], names=["epoch", "rank", "key", "bin", "n"])

    found = keys.where(valid_key(F.col("key"))).select("epoch", "rank", "key").mapInArrow(count, "epoch INT, rank INT, key DOUBLE, bin INT, n BIGINT")
    ends = layouts.select("epoch", "bins")
    met = found.join(ends, "epoch", "left").withColumn("last", F.size("bins") - 1)
    inner = met.where((F.col("bin") >= 0) & (F.col("bin") < F.col("last"))).groupBy("epoch", "rank", "bin").agg(F.sum("n").alias("mass"), F.first("bins").alias("bins"))
    inner = inner.select("epoch", "rank", F.get("bins", "bin").alias("lo"), F.get("bins", F.col("bin") + 1).alias("hi"), F.col("mass").cast("double").alias("mass"))
    order = Window.partitionBy("epoch", "rank", "bin").orderBy("key")
    below = met.where("bin < 0").select("epoch", "rank", F.col("key").alias("lo"), F.coalesce(F.lead("key").over(order), F.get("bins", F.lit(0))).alias("hi"))
    above = met.where("bin >= last").select("epoch", "rank", F.coalesce(F.lag("key").over(order), F.get("bins", "last")).alias("lo"), F.col("key").alias("hi"))
    sample = met.where("bin is null").select("epoch", "rank", F.col("key").alias("lo"), F.coalesce(F.lead("key").over(order), "key").alias("hi"))
    single = below.unionByName(above).unionByName(sample).withColumn("mass", F.lit(1.0))
    return inner.unionByName(single)


def rank_pivots(segments: DataFrame, n: int, layouts: DataFrame | None = None) -> DataFrame:
    """epoch, rank, mass, pivots (n of them, ends included) of each rank's segments (disjoint ones).

    The ends are those of the layout in force (if given), widened by keys out of bounds; the upper one is at least zero.
    """
    if not 2 <= n <= MOST_PIVOTS:
        raise ValueError(f"2 to {MOST_PIVOTS} pivots")
    rank = ["epoch", "rank"]
    placed = segments.withColumn("to", F.sum("mass").over(Window.partitionBy(*rank).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("all", F.sum("mass").over(Window.partitionBy(*rank))).withColumn("from", F.col("to") - F.col("mass"))
    step, slack = F.col("all") / (n - 1), F.col("all") * SLACK
    # The targets idx * step that lie in the segment.
    first = F.greatest(F.lit(1), F.floor((F.col("from") + slack) / step) + 1).cast("int")
    last = F.least(F.lit(n - 2), F.floor((F.col("to") + slack) / step)).cast("int")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("idx") * step - F.col("from")) / F.col("mass")))
    inner = placed.withColumns({"first": first, "last": last}).where("first <= last").withColumn("idx", F.explode(F.sequence("first", "last")))
    inner = inner.groupBy(*rank).agg(F.array_sort(F.collect_list(F.struct("idx", (F.col("lo") + share * (F.col("hi") - F.col("lo"))).alias("pivot")))).alias("inner"))  # fewer than n
    ends = segments.groupBy(*rank).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("mass").alias("mass"))
    if layouts is not None:
        ends = ends.join(layouts.select("epoch", "bins"), "epoch", "left")
        zero = F.when(F.col("bins").isNotNull(), F.lit(0.0))
        ends = ends.withColumns({"lo": F.least("lo", F.get("bins", F.lit(0))), "hi": F.greatest("hi", F.get("bins", F.size("bins") - 1), zero)})
    met = ends.join(inner, rank, "left")
    between = F.coalesce(F.col("inner.pivot"), F.array().cast("array<double>"))
    return met.select(*rank, "mass", F.concat(F.array("lo"), between, F.array("hi")).alias("pivots"))


def cumulative(pivots: np.ndarray, mass: float, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mass of keys below, and of those below or at, each point (a pivot that repeats holds mass itself)."""
    own, first, times = np.unique(pivots, return_index=True, return_counts=True)
    step = mass / (len(pivots) - 1)
    low, high = first * step, (first + times - 1) * step
    k = np.clip(np.searchsorted(own, at, side="right") - 1, 0, len(own) - 1)
    on = own[k] == at
    nxt = np.minimum(k + 1, len(own) - 1)
    width = np.where(nxt > k, own[nxt] - own[k], 1.0)
    between = high[k] + (at - own[k]) / width * (low[nxt] - high[k])
    between = np.where(at < own[0], 0.0, np.where(at > own[-1], mass, between))
    return np.where(on, low[k], between), np.where(on, high[k], between)


def merge_summaries(pivots: list[np.ndarray], masses: list[float], n: int) -> np.ndarray:
    """n pivots of the sum of several summaries."""
    at = np.unique(np.concatenate(pivots))
    low, high = np.zeros(len(at)), np.zeros(len(at))
    for p, m in zip(pivots, masses, strict=True):
        below, upto = cumulative(p, m, at)
        low, high = low + below, high + upto
    x, y = np.repeat(at, 2), np.stack([low, high], axis=1).ravel()
    total = sum(masses)
    target = np.arange(1, n - 1) * total / (n - 1)
    j = np.clip(np.searchsorted(np.maximum.accumulate(y), target - total * SLACK), 1, len(y) - 1)
    rise = y[j] - y[j - 1]
    share = np.clip((target - y[j - 1]) / np.where(rise > 0, rise, 1), 0, 1)
    return np.concatenate([at[:1], x[j - 1] + share * (x[j] - x[j - 1]), at[-1:]])


def merge_pivots(summaries: DataFrame, n: int, fan: int = FAN) -> DataFrame:
    """epoch, mass, pivots of each epoch from its ranks' summaries (epoch, rank, mass, pivots); a level of ``fan`` at a time."""
    ship(summaries.sparkSession)

    def work(key, table):
        order = np.argsort(table.column("rank").to_numpy(), kind="stable")  # a fixed order of sums
        mass = table.column("mass").to_numpy()[order]
        own = [np.array(table.column("pivots")[int(i)].as_py(), float) for i in order]
        made = merge_summaries(own, mass.tolist(), n)
        return pa.table({"epoch": pa.array([key[0].as_py()], pa.int32()), "rank": pa.array([key[1].as_py()], pa.int32()), "mass": pa.array([float(mass.sum())]), "pivots": pa.array([made.tolist()], pa.list_(pa.float64()))})

    some = summaries.where("mass > 0").select("epoch", "rank", "mass", "pivots")
    most = some.agg(F.max("rank")).first()[0]
    while True:
        some = some.withColumn("team", F.floor(F.col("rank") / fan).cast("int")).groupBy("epoch", "team").applyInArrow(work, "epoch INT, rank INT, mass DOUBLE, pivots ARRAY<DOUBLE>")
        if not most or most < fan:
            return some.select("epoch", "mass", "pivots")
        most //= fan


def masses_below(keys: DataFrame, pivots: DataFrame) -> DataFrame:
    """epoch, idx, pivot, below: the exact number of an epoch's keys less than each of its pivots (epoch, pivots: rising).

    Counts are of intervals between pivots, then summed up; a record meets its epoch's pivots once.
    """
    ship(keys.sparkSession)
    held = {r["epoch"]: r["pivots"] for r in pivots.select("epoch", "pivots").take(MOST_CUTS // MOST_PIVOTS + 1)}
    if sum(map(len, held.values())) > MOST_CUTS:
        raise ValueError(f"more than {MOST_CUTS} pivots; take fewer epochs at a time")
    cuts = keys.sparkSession.sparkContext.broadcast({e: np.array(p, float) for e, p in held.items()})  # its size was looked at

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            epoch, key = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for e in np.unique(epoch).tolist():
                if (own := cuts.value.get(e)) is not None:
                    n = np.bincount(np.searchsorted(own, key[epoch == e].astype(float), side="right"), minlength=len(own) + 1)
                    total[e] = total[e] + n if e in total else n
        for e, n in total.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), e, np.int32)), pa.array(there.astype(np.int32)), pa.array(n[there])], names=["epoch", "idx", "n"])

    counted = keys.where(valid_key(F.col("key"))).select("epoch", "key").mapInArrow(count, "epoch INT, idx INT, n BIGINT").groupBy("epoch", "idx").agg(F.sum("n").alias("n"))
    grid = pivots.select("epoch", F.posexplode("pivots").alias("idx", "pivot"))
    upto = Window.partitionBy("epoch").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(counted, ["epoch", "idx"], "left").select("epoch", "idx", "pivot", F.sum(F.coalesce("n", F.lit(0))).over(upto).cast("bigint").alias("below"))
