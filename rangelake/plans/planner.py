"""Planners over a manifest: query plans, merge runs, workloads.

Merge runs of all epochs are one job: where a run that starts at a block ends follows from running sums, and the runs
are found by doubling steps.  ``spread_plan`` makes plans of selective queries as one job over manifests of any size.
``query_plan`` is a walk in which each step depends on all before it, in any epoch; it runs on the driver over the
manifest's ranges and counts (a few numbers per block, as numpy arrays), never over records, and takes a checked number
of blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sweep import cumulative, keep, numbered, overlapped, running_sums

#: Fixed values of query-plan generation and of run planning.
MIN_MASS, MAX_OVERLAP, MIN_DISTANCE, NEAR_COUNT = 1000, 0.02, 0.002, 3
FIRST_WIDTH, STEP = 0.001, 0.1
MEMORY_BUDGET = 500 << 20
#: Candidates of a spread plan are 1, 2, 4 ... blocks wide, up to this many doublings.
DOUBLINGS = 10
#: Blocks that a walk on the driver takes at most.
MOST_BLOCKS = 20_000_000


def _ranges(manifest: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    n = manifest.count()
    if n > MOST_BLOCKS:
        raise ValueError(f"{n} blocks are too many for a walk on the driver; ask for fewer epochs")
    pdf = manifest.select("epoch", "obs_min", "obs_max", "item_count").toPandas()
    return {int(e): (g["obs_min"].to_numpy(np.float32), g["obs_max"].to_numpy(np.float32), g["item_count"].to_numpy(np.int64)) for e, g in pdf.sort_values("epoch").groupby("epoch")}


def _after(x: np.float32, step: float) -> np.float32:
    """The 32-bit float a step on; the next one where the step is lost in rounding, so each walk ends."""
    return max(np.float32(float(x) + step), np.nextafter(x, np.float32(np.inf)))


def query_plan(manifest: DataFrame, min_mass: int = MIN_MASS, max_overlap: float = MAX_OVERLAP, min_distance: float = MIN_DISTANCE, near_count: int = NEAR_COUNT) -> DataFrame:
    """epoch, lo, hi: ranges whose block selectivities are small and spread out.

    Each epoch's keys are walked from its least. A candidate range counts if it selects less than
    ``max_overlap`` of the mass and fewer than ``near_count`` of the selectivities taken so far (in
    any epoch) are within ``min_distance``. One that selects little but is not wanted is widened;
    otherwise the next one starts two steps behind its end. Sums are of 32-bit floats.
    """
    taken: list[np.float32] = []
    out: list[tuple[int, float, float]] = []
    f32 = np.float32
    for epoch, (lo, hi, count) in sorted(_ranges(manifest).items()):
        mass = int(count.sum())
        if mass < min_mass:
            continue
        end, begin = hi.max(), lo.min()
        top = max(f32(begin + f32(FIRST_WIDTH)), np.nextafter(begin, f32(np.inf)))
        while top < end:
            share = f32(count[(lo <= top) & (hi >= begin)].sum() / mass)
            useful = share < f32(max_overlap)
            wanted = sum(abs(s - share) < f32(min_distance) for s in taken) < near_count
            if wanted and useful:
                taken.append(share)
                out.append((epoch, float(begin), float(top)))
            top = _after(top, STEP)
            if wanted or not useful:
                begin = _after(top, STEP)
                top = _after(begin, FIRST_WIDTH)
    return manifest.sparkSession.createDataFrame(out, "epoch INT, lo FLOAT, hi FLOAT")


def spread_plan(manifest: DataFrame, min_mass: int = MIN_MASS, max_overlap: float = MAX_OVERLAP, min_distance: float = MIN_DISTANCE, near_count: int = NEAR_COUNT, doublings: int = DOUBLINGS) -> DataFrame:
    """epoch, lo, hi, share: ranges whose block selectivities are small and spread out, from a manifest of any size.

    Blocks of an epoch with ``min_mass`` records or more are numbered by least key, and a candidate goes from each one's
    least key to the greatest key of the block 2^k - 1 further on.  Its share is the mass of the blocks that it overlaps,
    which must be under ``max_overlap``.  Shares are put into classes of width ``min_distance``; of each class of an epoch
    the first ``near_count`` candidates by keys are taken, which each task does among its own before any is shuffled.
    Blocks without keys take no part; equal candidates count once; an empty manifest has an empty plan.
    """
    blocks = manifest.where("obs_min IS NOT NULL AND obs_max IS NOT NULL").select(F.col("epoch").cast("bigint").alias("g"), F.col("obs_min").alias("lo"), F.col("obs_max").alias("hi"), F.col("item_count").cast("bigint").alias("mass"))
    size = blocks.groupBy("g").agg(F.sum("mass").alias("all")).where(F.col("all") >= max(1, min_mass))
    blocks = keep(numbered(blocks.join(size.select("g"), "g", "left_semi"), "g", ["lo", "hi", "mass"]), "blocks")
    width = F.explode(F.array(*[F.lit(1 << k).cast("bigint") for k in range(doublings + 1)]))
    begins = blocks.select("g", "lo", "i", width.alias("w")).select("g", "lo", (F.col("i") + F.col("w") - 1).alias("i"))
    ranges = keep(begins.join(blocks.select("g", "i", "hi"), ["g", "i"]).select("g", "lo", "hi").distinct(), "candidates")
    met = overlapped(blocks.select("g", "lo", "hi", "mass"), ranges.select(F.struct("g", "lo", "hi").alias("qid"), "g", "lo", "hi"))
    shares = met.select("qid.*", F.col("mass").cast("double").alias("met")).join(size, "g")
    shares = shares.select("g", "lo", "hi", (F.col("met") / F.col("all").cast("double")).alias("share")).where(F.col("share") < max_overlap)
    first = Window.partitionBy("g", F.floor(F.col("share") / F.lit(float(min_distance)))).orderBy("lo", "hi")
    taken = shares.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= near_count)
    return taken.select(F.col("g").cast("int").alias("epoch"), "lo", "hi", "share")


def closest_distance(values: list[float], x: float) -> float:
    """How far the nearest value is; infinite without values."""
    return min((abs(v - x) for v in values), default=float("inf"))


def run_plan(manifest: DataFrame, value_size: int, budget: int = MEMORY_BUDGET) -> DataFrame:
    """epoch, run, sst_first, sst_last, cut, records: the runs that would merge each epoch within a memory budget.

    Blocks of an epoch are taken in order of their least key.  A run ends before the first block at which the records it
    holds exceed the budget and whose least key is beyond that of the run's first block (the first run of an epoch may
    end at its own); that key is the run's cut, below which all keys can be written.  The last run has no cut.
    """
    blocks = manifest.select(F.col("epoch").cast("bigint").alias("g"), "obs_min", "obs_max", F.col("item_count").cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("one"))
    placed = running_sums(blocks.where("obs_min IS NOT NULL"), "g", ["obs_min", "obs_max", "n"], ["n", "one"])
    placed = keep(placed.select("g", (F.col("one_upto") - 1).alias("i"), "obs_min", "n", (F.col("n_upto") - F.col("n")).alias("before")), "blocks")
    # The first block past the budget: as many as have a sum before them that isn't beyond it.
    room = budget // value_size if value_size > 0 else (1 << 62)
    sums = placed.select("g", F.col("before").alias("lo"), F.col("before").alias("hi"), F.lit(0).cast("bigint").alias("mass"))
    asked = placed.select("g", (F.col("before") + room).alias("x"))
    full = cumulative(sums, asked).select("g", (F.col("x") - room).alias("before"), F.col("begun").alias("full"))
    beyond = placed.groupBy("g", "obs_min").agg((F.max("i") + 1).alias("beyond"))
    size = placed.groupBy("g").agg(F.count("*").alias("blocks"), F.sum("n").alias("mass"))
    step = placed.join(full, ["g", "before"]).join(beyond, ["g", "obs_min"]).join(size, "g")
    step = step.withColumn("to", F.when(F.col("i") == 0, F.col("full")).otherwise(F.greatest("full", "beyond")))
    step = keep(step.select("g", "i", "before", "blocks", "mass", F.when(F.col("to") < F.col("blocks"), F.col("to")).alias("to")), "steps")

    # Blocks that begin a run: those that steps lead to from the first, in rounds of steps twice as long.
    jump = step.where("to IS NOT NULL").select("g", "i", "to")
    begun = keep(size.select("g", F.lit(0).cast("bigint").alias("i")), "begun")
    while True:
        more = keep(begun.join(jump, ["g", "i"]).select("g", F.col("to").alias("i")), "begun")
        if not more.take(1):
            break
        begun = begun.unionByName(more)
        jump = keep(jump.join(jump.select("g", F.col("i").alias("to"), F.col("to").alias("further")), ["g", "to"]).select("g", "i", F.col("further").alias("to")), "jumps")

    runs = numbered(begun.join(step, ["g", "i"]), "g", ["i"], "run")
    after = placed.select("g", F.col("i").alias("to"), F.col("obs_min").alias("cut"), F.col("before").alias("end"))
    met = runs.join(after, ["g", "to"], "left")
    return met.select(
        F.col("g").cast("int").alias("epoch"), F.col("run").cast("int").alias("run"), F.col("i").cast("int").alias("sst_first"), (F.coalesce("to", "blocks") - 1).cast("int").alias("sst_last"),
        "cut", (F.coalesce("end", "mass") - F.col("before")).alias("records"),
    )


def merge_runs(manifest: DataFrame, epoch: int, value_size: int, budget: int = MEMORY_BUDGET) -> DataFrame:
    """run, sst_first, sst_last, cut, records of one epoch's runs."""
    return run_plan(manifest.where(F.col("epoch") == epoch), value_size, budget).drop("epoch")


def zipf_workload(manifest: DataFrame, indexes: DataFrame, width: int, epoch_shift: int = 0) -> DataFrame:
    """epoch, qbegin, qend in the order of ``indexes`` (n, i): from block i's least key to the greatest of the block width - 1 after it.

    Blocks are numbered from 0 by rank and offset within their epoch; a range past the end stops at the last.
    """
    order = Window.partitionBy("epoch").orderBy("rank", "offset", "sst")
    blocks = manifest.select("epoch", "obs_min", "obs_max", (F.row_number().over(order) - 1).alias("i"))
    n = blocks.groupBy("epoch").agg(F.max("i").alias("top"))
    asked = indexes.select("n", F.col("i").alias("start")).join(blocks.select("epoch", F.col("i").alias("start"), F.col("obs_min").alias("qbegin")), "start").join(n, "epoch")
    asked = asked.withColumn("stop", F.least(F.col("start") + width - 1, F.col("top")))
    ends = blocks.select("epoch", F.col("i").alias("stop"), F.col("obs_max").alias("qend"))
    return asked.join(ends, ["epoch", "stop"]).select("n", (F.col("epoch") - epoch_shift).cast("int").alias("epoch"), "qbegin", "qend")
