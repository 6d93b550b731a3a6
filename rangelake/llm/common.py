"""Helpers shared by the operators: shared storage, Arrow column access, null-safe selection."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: Rows and bytes of an Arrow batch.  Texts may be long, so a batch is kept small.
BATCH_ROWS, BATCH_BYTES = 1024, "8m"


def tune(spark: SparkSession) -> None:
    """Bound the memory of Arrow batches (left alone where the user has chosen less) and send the code to the workers."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine one of our own if unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rangelake-")
        spark.sparkContext.setCheckpointDir(base)
    return base


_CLEANUP, _WHOLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.codegen.wholeStage"


def save(df: DataFrame, name: str, group_rows: int | None = None, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no recomputation of its lineage.

    The write's shuffle files go when it is done, for nothing reads them again; the table goes by ``drop`` or when the
    JVM ends.  ``group_rows`` is for rows of megabytes: Parquet looks at the size of what it holds after a hundred rows
    only, and a row group is read as a whole, so a group ends after so many rows.  ``wide`` is for rows of so many array
    functions that one method of them all would be too long for the JVM to compile: they get a method each.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, v) for k, v in ((_CLEANUP, "false"), (_WHOLE, "true"))}
    spark.conf.set(_CLEANUP, "true")
    if wide:
        spark.conf.set(_WHOLE, "false")
    try:
        df.write.options(**({"parquet.block.row.count.limit": group_rows} if group_rows else {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``save`` returned and that nothing reads any more."""
    for t in tables:
        where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_skewed(big: DataFrame, small: DataFrame, on: list[str], weight: str, total: int | None = None) -> DataFrame:
    """``big`` joined with ``small``, which has one row a key and, as ``weight``, the number of rows of ``big`` with it.

    A key with more than 1/1024 of all rows is split over as many parts as it has 1024ths; there are fewer than 1024 such
    keys, so their list may be broadcast whatever the size of the tables.
    """
    if total is None:
        total = small.agg(F.sum(weight)).first()[0] or 0
    hot = small.where(F.col(weight) * 1024 > total).select(*on, F.ceil(F.col(weight) * 1024 / max(total, 1)).cast("int").alias("_parts"))
    if not hot.take(1):
        return big.join(small, on)
    hot = F.broadcast(hot)
    part = F.pmod(F.xxhash64(*[f"`{c}`" for c in big.columns]), F.col("_parts")).cast("int")
    left = big.join(hot, on, "left").withColumn("_part", F.coalesce(part, F.lit(0)))
    right = small.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return left.drop("_parts").join(right.drop("_parts"), [*on, "_part"]).drop("_part")


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The texts of a batch as UTF-8, without decoding them."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def select(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, under our own names: further columns of any name do no harm."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in named.items()])


def rows(schema: pa.Schema, records: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One Arrow batch of the records, none if there are none."""
    if records:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=f.type) for c, f in zip(zip(*records, strict=True), schema, strict=True)], schema=schema
        )
