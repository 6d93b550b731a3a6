"""The catalog of blocks: which keys, and how many, each block (SST) of an epoch holds.

A manifest is one row per block, so it is thousands of times smaller than the records; it is still
a DataFrame throughout, and what is asked of it are filters and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import check_range, covers, overlaps, valid_key, zero_width
from ..schemas import MANIFEST


def build_manifest(records: DataFrame, kv_size: int = 12) -> DataFrame:
    """A manifest of records (epoch, rank, sst, pos, key): observed ranges, counts, byte offsets."""
    return records.where(valid_key(F.col("key"))).groupBy("epoch", "rank", "sst").agg(
        ((F.min("pos") - 1) * kv_size).cast("bigint").alias("offset"),
        F.min("key").alias("obs_min"), F.max("key").alias("obs_max"), F.min("key").alias("exp_min"), F.max("key").alias("exp_max"),
        F.count("*").alias("item_count"), F.lit(0).cast("bigint").alias("oob_count"), F.lit(0).alias("upd_round"),
    ).select(*MANIFEST.names)


def entries(manifest: DataFrame, epoch: int, rank: int | None = None) -> DataFrame:
    """All blocks of an epoch, or of one rank in it."""
    m = manifest.where(F.col("epoch") == epoch)
    return m if rank is None or rank < 0 else m.where(F.col("rank") == rank)


def covering(manifest: DataFrame, epoch: int, point: float) -> DataFrame:
    """Blocks whose observed range holds a point."""
    return entries(manifest, epoch).where(covers(point, F.col("obs_min"), F.col("obs_max")))


def overlapping(manifest: DataFrame, epoch: int, lo: float, hi: float, rank: int | None = None) -> DataFrame:
    """Blocks whose observed range overlaps a query, of one rank if asked."""
    check_range(lo, hi)
    return entries(manifest, epoch, rank).where(overlaps(F.col("obs_min"), F.col("obs_max"), lo, hi))


def epoch_stats(manifest: DataFrame) -> DataFrame:
    """Per epoch: mass, OOB mass, key range, blocks, blocks of zero width."""
    return manifest.groupBy("epoch").agg(
        F.sum("item_count").alias("mass"), F.sum("oob_count").alias("oob_mass"), F.min("obs_min").alias("range_min"), F.max("obs_max").alias("range_max"),
        F.count("*").alias("ssts"), F.count_if(zero_width(F.col("obs_min"), F.col("obs_max"))).alias("zero_width_ssts"),
    )


def totals(manifest: DataFrame) -> DataFrame:
    """One row: epochs (highest plus one), ranks (highest plus one), mass, blocks, blocks of zero width."""
    return manifest.agg(
        (F.max("epoch") + 1).cast("int").alias("epochs"), (F.max("rank") + 1).cast("int").alias("ranks"), F.sum("item_count").alias("mass"),
        F.count("*").alias("ssts"), F.count_if(zero_width(F.col("obs_min"), F.col("obs_max"))).alias("zero_width_ssts"),
    )


def epoch_mass(manifest: DataFrame, epoch: int) -> int:
    """The epoch's mass; 0 for one that isn't there."""
    return manifest.where(F.col("epoch") == epoch).agg(F.sum("item_count")).first()[0] or 0


def epoch_range(manifest: DataFrame, epoch: int) -> tuple[float, float] | None:
    """The epoch's key range; None for one that isn't there."""
    lo, hi = manifest.where(F.col("epoch") == epoch).agg(F.min("obs_min"), F.max("obs_max")).first()
    return None if lo is None else (lo, hi)


def kv_sizes(sizes: DataFrame) -> tuple[int, int]:
    """The one (key_sz, val_sz) that all files agree on; an error if they don't."""
    found = sizes.select("key_sz", "val_sz").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"key and value sizes differ between files: {[tuple(r) for r in found]}")
    return found[0]["key_sz"], found[0]["val_sz"]


def match_stats(matches: DataFrame, mass: int | Column) -> DataFrame:
    """One row: matched mass, matched OOB mass, matched blocks, selectivity (0 where there is no mass)."""
    mass = mass if isinstance(mass, Column) else F.lit(mass)
    got = matches.agg(F.coalesce(F.sum("item_count"), F.lit(0)).cast("bigint").alias("match_mass"), F.coalesce(F.sum("oob_count"), F.lit(0)).cast("bigint").alias("match_oob"), F.count("*").alias("match_count"))
    return got.withColumn("selectivity", F.when(mass > 0, F.col("match_mass") / mass).otherwise(F.lit(0.0)))


def unique_ranks(matches: DataFrame) -> DataFrame:
    return matches.select("rank").distinct().orderBy("rank")


def matches_by_rank(matches: DataFrame) -> DataFrame:
    """Per rank: blocks and mass."""
    return matches.groupBy("rank").agg(F.count("*").alias("ssts"), F.sum("item_count").alias("mass"), F.sum("oob_count").alias("oob_mass"))


def by_key(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("epoch", "obs_min", "obs_max")


def by_place(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("epoch", "rank", "offset")


def as_text(manifest: DataFrame) -> DataFrame:
    """One line of text per block."""
    line = F.format_string("epoch %d, rank %d, offset %d, observed [%.6f, %.6f], expected [%.6f, %.6f], round %d, items %d, oob %d", "epoch", "rank", "offset", "obs_min", "obs_max", "exp_min", "exp_max", "upd_round", "item_count", "oob_count")
    return manifest.select("epoch", "rank", "sst", line.alias("line"))
