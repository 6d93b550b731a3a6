"""Records, manifests and cells made of the driver's tables, as every query's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.manifest import build_manifest
from .runtime import scratch
from .sources import blockfile

EVENT_BLOCK, LINE_BLOCK = 16, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch (day), rank, key, ts, event_id of events: the scan that needs no place in a file."""
    return table(spark, sf_dir, "events").select((F.dayofmonth("ts") - 1).alias("epoch"), (F.col("user_id") % 8).cast("int").alias("rank"), F.col("value").cast("float").alias("key"), "ts", "event_id")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: places in order of arrival, blocks of sixteen."""
    pos = F.row_number().over(Window.partitionBy("epoch", "rank").orderBy("ts", "event_id"))
    r = event_keys(spark, sf_dir).withColumn("pos", pos.cast("bigint"))
    return r.select("epoch", "rank", F.floor((F.col("pos") - 1) / EVENT_BLOCK).cast("int").alias("sst"), "pos", "key", "event_id")


def event_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_manifest(event_records(spark, sf_dir))


def event_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of block files of the events; a value is the event's id in eight bytes, the highest first."""
    path = scratch(spark, "event-files")
    value = F.unhex(F.lpad(F.hex("event_id"), 16, "0")).alias("value")
    blockfile.write_blocks(event_records(spark, sf_dir).select("epoch", "rank", "sst", "pos", "key", value), path, 8)
    blockfile.register(spark)
    return path


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch (year), rank, key of line items; not unique, so only for what order doesn't change."""
    return table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") - 1995).alias("epoch"), (F.col("l_suppkey") % 16).cast("int").alias("rank"), F.col("l_extendedprice").cast("float").alias("key"))


def line_clustered_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of line items in key order (in thousands), blocks of 64 within an epoch: nearly disjoint ranges."""
    keys = line_keys(spark, sf_dir).select("epoch", (F.col("key") / 1000).cast("float").alias("key"))
    i = F.row_number().over(Window.partitionBy("epoch").orderBy("key"))
    r = keys.withColumn("pos", i.cast("bigint")).select("epoch", F.lit(0).alias("rank"), F.floor((F.col("pos") - 1) / LINE_BLOCK).cast("int").alias("sst"), "pos", "key")
    return build_manifest(r)


def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", e[0].alias("ux"), e[1].alias("uy"), e[2].alias("uz"))


def cells(spark: SparkSession, sf_dir: str, species: str) -> DataFrame:
    """Fluid cells of one species (return flag): sums of line items over 64 cells, in exact hundredths."""
    cent = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint")) / 100.0
    g = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == species).groupBy((F.col("l_partkey") % 64).cast("int").alias("ix"))
    q, p, d, t = cent("l_quantity"), cent("l_extendedprice"), cent("l_discount"), cent("l_tax")
    return g.agg(
        q.alias("jx"), d.alias("jy"), t.alias("jz"), F.count("*").cast("double").alias("rho"), d.alias("px"), q.alias("py"), t.alias("pz"),
        p.alias("txx"), q.alias("tyy"), d.alias("tzz"), t.alias("tyz"), d.alias("tzx"), q.alias("txy"),
    ).select(F.lit(0).alias("t"), "ix", F.lit(0).alias("iy"), F.lit(0).alias("iz"), "jx", "jy", "jz", "rho", "px", "py", "pz", "txx", "tyy", "tzz", "tyz", "tzx", "txy")


def tracers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracers (id, t, ix, iy, iz, ii, dx, dy, dz) of embeddings: offsets from the first components, cells of a grid of four."""
    e, i = F.col("embedding"), F.col("vec_id")
    at = [F.least(F.lit(1.0), F.greatest(F.lit(-1.0), e[k].cast("double"))).alias(f"d{a}") for k, a in enumerate("xyz")]
    return table(spark, sf_dir, "embeddings").select(
        i.alias("id"), F.lit(0).alias("t"), (i % 3).cast("int").alias("ix"), (i % 5 % 3).cast("int").alias("iy"), (i % 7 % 3).cast("int").alias("iz"), (i % 64).cast("int").alias("ii"), *at
    )


def nodes(spark: SparkSession, sf_dir: str, species: str) -> DataFrame:
    """The fluid cells of a species on a grid of four in each direction, with three of their sums as a velocity."""
    c = F.col("ix")
    return cells(spark, sf_dir, species).select("t", (c % 4).alias("ix"), F.floor(c / 4 % 4).cast("int").alias("iy"), F.floor(c / 16).cast("int").alias("iz"), F.col("jy").alias("vx"), F.col("jz").alias("vy"), F.col("rho").alias("vz"))


#: Queries with their edge cases (full cover, no match, epoch that isn't there, one rank).
QUERIES = ((0, 0, 10.0, 12.0, None), (1, 2, 0.5, 1.0, None), (2, 5, 100.0, 500.0, None), (3, 29, 0.0, 1000.0, None), (4, 3, 1000.0, 2000.0, None), (5, 99, 0.0, 1.0, None), (6, 4, 5.0, 50.0, 3))


def query_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERIES), "qid INT, epoch INT, qbegin FLOAT, qend FLOAT, rank INT")
