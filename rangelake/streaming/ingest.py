"""New time steps as a stream: each is taken once, when its files are complete.

Writers put a step's files under a name that the stream doesn't look at and rename them when they
are whole; the file source's checkpoint then makes each file count once, also after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.predicates import valid_key
from ..operators.manifest import build_manifest
from ..schemas import RECORD

#: Records of a block, in order of arrival.
BLOCK_RECORDS = 1 << 16


def read_steps(spark: SparkSession, path: str, schema=RECORD, max_files: int | None = None, archive: str | None = None) -> DataFrame:
    """A stream of records from Parquet files (in folders of any depth); done files may be moved to an archive."""
    r = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    r = r.option("maxFilesPerTrigger", max_files) if max_files else r
    r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive) if archive else r
    return r.parquet(path)


def append_epochs(records_to: str, manifest_to: str, after: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch function: records go to their epoch's partition, their blocks to the manifest.

    A batch replaces what an earlier try of it wrote, so a restart leaves no rows twice.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        own = batch.where(valid_key(F.col("key"))).withColumn("batch", F.lit(batch_id))
        own.persist()
        try:
            spark = batch.sparkSession
            writer = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            if own.take(1):
                writer(own).partitionBy("batch", "epoch").parquet(records_to)
                writer(build_manifest(own.select(*RECORD.names)).withColumn("batch", F.lit(batch_id))).partitionBy("batch").parquet(manifest_to)
            if after:
                after(spark.read.parquet(manifest_to) if own.take(1) else own, batch_id)
        finally:
            own.unpersist()

    return work


def ingest(steps: DataFrame, records_to: str, manifest_to: str, checkpoint: str, trigger_seconds: int | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start the ingest; without an interval it takes what is there and ends."""
    w = steps.writeStream.foreachBatch(append_epochs(records_to, manifest_to, after)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{trigger_seconds} seconds") if trigger_seconds else w.trigger(availableNow=True)).start()


def frames(tracers: DataFrame, steps_per_frame: int) -> DataFrame:
    """Rows with the tumbling frame (by count of steps) that they are buffered in."""
    return tracers.withColumn("frame", F.floor(F.col("step") / steps_per_frame).cast("int"))


def frame_summary(tracers: DataFrame, steps_per_frame: int) -> DataFrame:
    """Per frame and species: rows, tracers, steps."""
    return frames(tracers, steps_per_frame).groupBy("frame", "species").agg(F.count("*").alias("rows"), F.countDistinct("tag").alias("tracers"), F.countDistinct("step").alias("steps"))


def arrival_blocks(records: DataFrame, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """Records (epoch, rank, arrival, key, ...) with pos and sst in order of arrival."""
    pos = F.row_number().over(Window.partitionBy("epoch", "rank").orderBy("arrival"))
    return records.withColumn("pos", pos.cast("bigint")).withColumn("sst", F.floor((F.col("pos") - 1) / block_records).cast("int"))


def out_of_bounds(batch: DataFrame, lo: float, hi: float) -> DataFrame:
    """One row: keys below and above the partitioning in force, and within it: what a re-layout is decided on."""
    k = F.col("key")
    return batch.agg(F.count_if(k < lo).alias("below"), F.count_if(k > hi).alias("above"), F.count_if(k.between(lo, hi)).alias("within"))
