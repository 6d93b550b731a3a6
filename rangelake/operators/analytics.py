"""Catalog analytics: summaries, overlap curves, read schedules, coalesced reads, scans, timing statistics.

None of these touches records: they are filters, sweeps and windows over the manifest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import check_range, overlaps
from ..runtime import ship
from ..schemas import OVERLAP
from .sweep import stabbed

#: Probe points of a summary (from, below, step) and the probe grid's cut-offs and steps.
SUMMARY_PROBES = (0.01, 2.0, 0.25)
GRID_CUTOFFS = (2.0, 5.0, 10.0, 20.0, 50.0, 100.0)
GRID_STEPS = (0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0)
READ_GAP = 1 << 20


#: Points of one run of a probe grid at most.
MOST_POINTS = 5_000_000


def summary_probes() -> list[float]:
    """32-bit floats; each step is added in double precision and rounded."""
    at, below, step = SUMMARY_PROBES
    out, p = [], np.float32(at)
    while p < below:
        out.append(float(p))
        p = np.float32(float(p) + step)
    return out


def probe_grid(lo: float, hi: float) -> list[float]:
    """Points from ``lo`` to ``hi``, denser where keys are small; sums of 32-bit floats, in order.

    Each cut-off starts its own run of points at its own step, whether or not it lies below ``lo``.
    """
    ends = [*GRID_CUTOFFS, np.inf]
    starts = [lo, *GRID_CUTOFFS]
    out: list[float] = []
    for start, end, step in zip(starts, ends, GRID_STEPS, strict=True):
        p, step = np.float32(start), np.float32(step)
        end = min(np.float32(end), np.float32(hi))
        if (float(end) - float(p)) / float(step) > MOST_POINTS:
            raise ValueError(f"keys up to {hi} would take more than {MOST_POINTS} probes")
        while p < end:
            out.append(float(p))
            p = max(np.float32(p + step), np.nextafter(p, np.float32(np.inf)))  # where the step is lost in rounding
    return sorted(out)


def summarize(manifest: DataFrame) -> DataFrame:
    """epoch, range_min, range_max, mass, point, match_mass, match_count, selectivity for each epoch with mass and each probe."""
    stats = manifest.groupBy("epoch").agg(F.min("obs_min").alias("range_min"), F.max("obs_max").alias("range_max"), F.sum("item_count").alias("mass")).where("mass > 0")
    probes = F.explode(F.array(*[F.lit(p).cast("float") for p in summary_probes()])).alias("point")
    return _curve(stats.select("*", probes), manifest).withColumn("selectivity", F.col("match_mass") / F.col("mass"))


def _curve(probed: DataFrame, manifest: DataFrame) -> DataFrame:
    """probed (epoch, point, ...) with the mass and number of blocks that cover each point."""
    blocks = manifest.select(F.col("epoch").cast("bigint").alias("g"), F.col("obs_min").alias("lo"), F.col("obs_max").alias("hi"), F.col("item_count").cast("bigint").alias("mass"))
    found = stabbed(blocks.where("lo IS NOT NULL AND hi IS NOT NULL"), probed.select(F.col("epoch").cast("bigint").alias("g"), F.col("point").alias("x")))
    met = probed.join(found.select(F.col("g").alias("epoch"), F.col("x").alias("point"), F.col("mass").alias("match_mass"), F.col("n").alias("match_count")), ["epoch", "point"])
    return met.select(*probed.columns, "match_mass", "match_count")


def overlap_curve(manifest: DataFrame) -> DataFrame:
    """Epoch, Point, MatchMass, TotalMass, MatchCount over each epoch's probe grid."""
    stats = manifest.groupBy("epoch").agg(F.min("obs_min").alias("lo"), F.max("obs_max").alias("hi"), F.sum("item_count").alias("TotalMass"))
    ship(manifest.sparkSession)

    def grid(batches):
        """The points of each epoch, some at a time."""
        for batch in batches:
            for epoch, lo, hi, mass in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                points = probe_grid(lo, hi)
                for k in range(0, len(points), 100_000):
                    some = np.array(points[k : k + 100_000], np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), epoch, np.int32)), pa.array(some), pa.array(np.full(len(some), mass, np.int64))], names=["epoch", "point", "TotalMass"])

    probed = stats.where("lo IS NOT NULL").mapInArrow(grid, "epoch INT, point FLOAT, TotalMass BIGINT").distinct()
    got = _curve(probed, manifest)
    return got.select(F.col("epoch").alias("Epoch"), F.col("point").alias("Point"), F.col("match_mass").alias("MatchMass"), "TotalMass", F.col("match_count").alias("MatchCount")).to(OVERLAP)


def max_overlap(curve: DataFrame) -> DataFrame:
    """Epoch and the greatest share of its mass, in percent, that one point's blocks hold."""
    return curve.groupBy("Epoch").agg((F.max("MatchMass") * 100.0 / F.max("TotalMass")).alias("max_percent"))


def scan_mass(manifest: DataFrame, lo: float, hi: float, epoch: int | None = None) -> DataFrame:
    """One row: mass and OOB mass of the blocks that overlap a range, of one epoch or of all."""
    check_range(lo, hi)
    m = manifest if epoch is None else manifest.where(F.col("epoch") == epoch)
    m = m.where(overlaps(F.col("obs_min"), F.col("obs_max"), lo, hi))
    return m.agg(F.coalesce(F.sum("item_count"), F.lit(0)).cast("bigint").alias("mass"), F.coalesce(F.sum("oob_count"), F.lit(0)).cast("bigint").alias("oob_mass"))


def schedule(matches: DataFrame) -> DataFrame:
    """Reads in order: each rank's first block, by rank, then each rank's others by epoch and offset (slot from 0)."""
    rn = F.row_number().over(Window.partitionBy("rank").orderBy("epoch", "offset", "sst"))
    placed = matches.withColumn("turn", rn)
    # Places follow from counts per rank, so no task orders all blocks.
    ranks = placed.groupBy("rank").agg(F.count("*").alias("n"))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ranks = ranks.select("rank", (F.row_number().over(Window.orderBy("rank")) - 1).alias("_i"), F.coalesce(F.sum(F.col("n") - 1).over(before), F.lit(0)).alias("_b"), F.count("*").over(Window.partitionBy()).alias("_n"))
    slot = F.when(F.col("turn") == 1, F.col("_i")).otherwise(F.col("_n") + F.col("_b") + F.col("turn") - 2)
    return placed.join(ranks, "rank").withColumn("slot", slot.cast("bigint")).drop("_i", "_b", "_n", "turn")


def coalesce_reads(matches: DataFrame, kv_size: int = 12, gap: int = READ_GAP) -> DataFrame:
    """epoch, rank, offset, item_count, oob_count, reads: neighbours of a rank less than ``gap`` bytes apart are one read.

    Rows between them are read along and counted.
    """
    end = F.col("offset") + F.col("item_count") * kv_size
    order = Window.partitionBy("epoch", "rank").orderBy("offset", "sst")
    m = matches.withColumn("_gap", F.col("offset") - F.lag(end).over(order))
    m = m.withColumn("_island", F.sum(F.when(F.col("_gap") < gap, 0).otherwise(1)).over(order))
    size = F.max(end) - F.min("offset")
    return m.groupBy("epoch", "rank", "_island").agg(
        F.min("offset").alias("offset"), F.floor(size / kv_size).cast("bigint").alias("item_count"), F.sum("oob_count").alias("oob_count"), F.count("*").alias("reads"), F.sum("item_count").alias("asked")
    ).drop("_island")


def read_inflation(coalesced: DataFrame) -> DataFrame:
    """One row: reads before and after, mass read and asked for, percent read of what was asked."""
    return coalesced.agg(F.sum("reads").alias("reads_in"), F.count("*").alias("reads_out"), F.sum("asked").alias("mass_in"), F.sum("item_count").alias("mass_out"), (F.sum("item_count") * 100.0 / F.sum("asked")).alias("percent"))


def task_stats(tasks: DataFrame) -> DataFrame:
    """One row from (tid, io_us, total_us): sums, means and population deviations."""
    return tasks.agg(*[f(c).alias(f"{n}_{c}") for c in ("io_us", "total_us") for n, f in (("sum", F.sum), ("avg", F.avg), ("std", F.stddev_pop))])


def thread_stats(tasks: DataFrame) -> DataFrame:
    """Per thread: tasks and time."""
    return tasks.groupBy("tid").agg(F.count("*").alias("tasks"), F.sum("io_us").alias("io_us"), F.sum("total_us").alias("total_us"))


def distinct_epochs(manifest: DataFrame) -> DataFrame:
    return manifest.select("epoch").distinct()
