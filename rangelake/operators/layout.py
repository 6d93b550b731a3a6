"""Physical order: compaction of overlapping blocks into key order, and writing of epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import valid_key

#: Records of one file, and of one block, in a compacted epoch.
FILE_RECORDS, BLOCK_RECORDS = 83_000_000, 1 << 16


#: Records of a task, so that it sorts some hundred MB whatever the size of the epochs.
PART_RECORDS = 4_000_000


def cluster_epoch(records: DataFrame, epoch: int, parts: int | None = None) -> DataFrame:
    """One epoch in key order: a range shuffle by sampled bounds, then a sort of each part (which spills, if it must)."""
    own = records.where((F.col("epoch") == epoch) & valid_key(F.col("key")))
    ranged = own.repartitionByRange(parts, "key", "rank", "pos") if parts else own.repartitionByRange("key", "rank", "pos")
    return ranged.sortWithinPartitions("key", "rank", "pos")


def renumber(clustered: DataFrame, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """Clustered records with rank (the part), pos (from 1) and sst of the new order; a part is numbered by itself."""
    part = F.spark_partition_id()
    place = (F.monotonically_increasing_id() - part.cast("bigint") * (1 << 33) + 1).alias("_pos")
    kept = clustered.select(*[c for c in clustered.columns if c not in ("rank", "pos", "sst")], part.alias("_rank"), place)
    return kept.withColumnsRenamed({"_rank": "rank", "_pos": "pos"}).withColumn("sst", F.floor((F.col("pos") - 1) / block_records).cast("int"))


def write_records(records: DataFrame, path: str, mode: str = "errorifexists", max_records: int = FILE_RECORDS) -> None:
    """Records as Parquet by epoch; a file is closed at ``max_records``."""
    records.write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy("epoch").parquet(path)


def compact(records: DataFrame, path: str, epochs: list[int] | None = None, part_records: int = PART_RECORDS, mode: str = "errorifexists", max_records: int = FILE_RECORDS) -> None:
    """All epochs (or some) in key order, in one job: one range shuffle by (epoch, key), ties by rank and place.

    A task gets about ``part_records`` records whatever the sizes of epochs: a large one is cut into many key ranges, small
    ones share a task, and a key of very many records is cut by rank and place.  A task that holds several epochs writes a
    file of each, so each file is a narrow range of keys of one epoch and its statistics prune.
    """
    own = records.where(valid_key(F.col("key")))
    own = own if epochs is None else own.where(F.col("epoch").isin(*epochs))
    order = ["epoch", "key", "rank", "pos"]
    parts = max(1, -(-own.count() // part_records))
    write_records(own.repartitionByRange(parts, *order).sortWithinPartitions(*order), path, mode, max_records)


def read_epochs(spark, path: str) -> DataFrame:
    """Compacted records; the epoch is a partition column."""
    return spark.read.parquet(path)


def key_order_violations(clustered: DataFrame) -> DataFrame:
    """Keys of a part that are smaller than the one before them: none in a clustered epoch."""
    order = Window.partitionBy("rank").orderBy("pos")
    return clustered.withColumn("_before", F.lag("key").over(order)).where(F.col("key") < F.col("_before")).drop("_before")
