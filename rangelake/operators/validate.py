"""Does every record lie in the range that the manifest gives its block?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(records: DataFrame, manifest: DataFrame, sample_every: int | None = None) -> DataFrame:
    """Records outside their block's observed range, or of no block; all are looked at, or every n-th of a block."""
    m = manifest.select("epoch", "rank", "sst", "obs_min", "obs_max", "item_count")
    met = records.join(m, ["epoch", "rank", "sst"], "left")
    if sample_every:
        first = records.groupBy("epoch", "rank", "sst").agg(F.min("pos").alias("_first"))
        met = met.join(first, ["epoch", "rank", "sst"]).where((F.col("pos") - F.col("_first")) % sample_every == 0).drop("_first")
    return met.where(F.col("obs_min").isNull() | F.col("key").isNull() | F.isnan("key") | (F.col("key") < F.col("obs_min")) | (F.col("key") > F.col("obs_max")))


def report(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per block with a violation: how many, and the first offending key with its place in percent of the block."""
    first = records.groupBy("epoch", "rank", "sst").agg(F.min("pos").alias("_first"), F.count("*").alias("_n"))
    bad = violations(records, manifest).join(first, ["epoch", "rank", "sst"])
    return bad.groupBy("epoch", "rank", "sst").agg(
        F.count("*").alias("violations"), F.min_by("key", "pos").alias("first_key"), F.min_by((F.col("pos") - F.col("_first")) * 100.0 / F.col("_n"), "pos").alias("first_percent")
    )


def count_check(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Blocks whose number of records isn't the manifest's."""
    n = records.groupBy("epoch", "rank", "sst").agg(F.count("*").alias("records"))
    met = manifest.select("epoch", "rank", "sst", "item_count").join(n, ["epoch", "rank", "sst"], "full")
    return met.where(~F.col("item_count").eqNullSafe(F.col("records")))
