"""Text sources: query batches, manifests, query logs, index lists.  A malformed row is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import MANIFEST, QLOG

BATCH = "epoch INT, qbegin FLOAT, qend FLOAT"
TEXT_MANIFEST = "epoch INT, offset BIGINT, obs_min FLOAT, obs_max FLOAT, exp_min FLOAT, exp_max FLOAT, item_count BIGINT, oob_count BIGINT, upd_round INT"


def _csv(spark: SparkSession, path, schema: str, header: bool = False):
    return spark.read.schema(schema).option("mode", "FAILFAST").option("header", header).csv(path)


def query_batch(spark: SparkSession, path: str) -> DataFrame:
    """qid (in file order), epoch, qbegin, qend, rank (null: all) of rows ``epoch,lo,hi``; an inverted range is an error."""
    q = _csv(spark, path, BATCH).withColumn("_line", F.monotonically_increasing_id())
    q = q.withColumn("qid", (F.row_number().over(Window.orderBy("_line")) - 1).cast("int"))  # a batch is a small file
    ok = F.assert_true(F.col("qbegin") <= F.col("qend"), F.lit("a query's begin is above its end"))
    return q.where(ok.isNull()).select("qid", "epoch", "qbegin", "qend", F.lit(None).cast("int").alias("rank"))


def text_manifest(spark: SparkSession, path) -> DataFrame:
    """Manifest rows of ``*.<rank>`` files of nine columns; the rank is the file's suffix, blocks are numbered by offset."""
    m = _csv(spark, path, TEXT_MANIFEST).withColumn("rank", F.regexp_extract(F.input_file_name(), r"\.(\d+)$", 1).cast("int"))
    sst = F.row_number().over(Window.partitionBy("epoch", "rank").orderBy("offset")) - 1
    return m.withColumn("sst", sst.cast("int")).select(*MANIFEST.names)


def mock_manifest(spark: SparkSession, path) -> DataFrame:
    """epoch, rank, obs_min, obs_max, item_count, oob_count of ``*.<epoch>.<rank>`` files; columns 0, 1, 3, 4 of each line count."""
    t = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("c"), F.input_file_name().alias("_f"))
    name = lambda k: F.regexp_extract("_f", r"\.(\d+)\.(\d+)$", k).cast("int")
    return t.select(name(1).alias("epoch"), name(2).alias("rank"), F.col("c")[0].cast("float").alias("obs_min"), F.col("c")[1].cast("float").alias("obs_max"), F.col("c")[3].cast("bigint").alias("item_count"), F.col("c")[4].cast("bigint").alias("oob_count"))


def query_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QLOG).option("header", True).csv(path)


def index_list(spark: SparkSession, path: str) -> DataFrame:
    """n (order in the file), i of a file of one number per line."""
    t = spark.read.text(path).where(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id())
    return t.select("n", F.trim("value").cast("int").alias("i"))
