"""Reads of values by pointer, and the rolling sink of block files."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rangelake.sources import blockfile as B

DRAFTS = "_drafts-"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks"))
    rng = np.random.default_rng(4)
    for rank in range(3):
        epochs = {e: [(rng.random(n).astype("f4"), np.arange(n * 6, dtype=np.uint8).reshape(n, 6)) for n in (5, 40, 1)] for e in (0, 2)}
        B.write_file(path, rank, epochs, 6)
    B.register(spark)
    return path


@pytest.mark.parametrize("gap, split", [(0, 1 << 26), (64 << 10, 1 << 26), (13, 100), (1, 7)])
def test_values_by_pointer_are_those_of_whole_reads(spark, files, gap, split):
    keys = spark.read.format("rdb_keys").load(files).where("key > 0.4")
    got = B.fetch_values(keys.withColumn("a.b", F.lit(1)), files, gap=gap, split=split)
    assert got.columns == [*keys.columns, "a.b", "value", "bytes_read"]
    rows = got.collect()
    whole = {(r["epoch"], r["rank"], r["pos"]): bytes(r["value"]) for r in spark.read.format("rdb").load(files).collect() if r["key"] > 0.4}
    assert {(r["epoch"], r["rank"], r["pos"]): bytes(r["value"]) for r in rows} == whole and len(rows) == len(whole)
    if gap == 0 and split > 1000:  # nothing but the values, neighbours by one read
        assert sum(r["bytes_read"] for r in rows) == 6 * len(rows)
        assert sum(r["bytes_read"] > 0 for r in rows) < len(rows)
    if gap == 64 << 10:
        assert sum(r["bytes_read"] > 0 for r in rows) == 3


def test_pointers_that_repeat_are_null_or_wrong(spark, files):
    keys = spark.read.format("rdb_keys").load(files).where("rank = 1 AND epoch = 2").select("rank", "value_offset")
    twice = keys.unionByName(keys).unionByName(spark.createDataFrame([(1, None), (None, 4)], keys.schema))
    rows = B.fetch_values(twice, files).collect()
    assert len(rows) == 94 and sum(r["value"] is None for r in rows) == 2
    one = keys.limit(1).unionByName(keys.limit(1))
    assert sum(r["bytes_read"] for r in B.fetch_values(one, files, gap=0).collect()) == 6
    with pytest.raises(Exception, match="no value of 6 bytes"):
        B.fetch_values(spark.createDataFrame([(1, 1 << 30)], keys.schema), files).collect()
    with pytest.raises(ValueError, match="bytes_read"):
        B.fetch_values(keys.withColumn("value", F.lit(1)), files)
    assert B.fetch_values(keys.where("false"), files).collect() == []


def test_long_reads_are_cut(spark, files, monkeypatch):
    monkeypatch.setattr(B, "FETCH_BYTES", 20)
    rows = B.fetch_values(spark.read.format("rdb_keys").load(files), files).collect()
    assert len(rows) == 276 and max(r["bytes_read"] for r in rows) == 18


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_reads_are_the_same_however_rows_are_batched_or_dealt(spark, files, monkeypatch, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        keys = spark.read.format("rdb_keys").load(files).withColumn("block", F.min("value_offset").over(Window.partitionBy("epoch", "rank", "sst")))
        for split in (1 << 26, 50):  # a block's values are one read, also where stripes are shorter than a block
            rows = B.fetch_values(keys, files, gap=0, split=split, start=F.col("block")).collect()
            assert len(rows) == 276 and sum(r["bytes_read"] > 0 for r in rows) == 18 and sum(r["bytes_read"] for r in rows) == 6 * 276
        twice = keys.unionByName(keys).unionByName(keys)
        assert sum(r["bytes_read"] for r in B.fetch_values(twice, files, gap=0).collect()) == 6 * 276
        monkeypatch.setattr(B, "FETCH_ROWS", 2)  # pointers that repeat over a cut are still read once
        rows = B.fetch_values(twice, files, gap=0).collect()
        assert sum(r["bytes_read"] for r in rows) == 6 * 276 and len({(r["rank"], r["value_offset"], bytes(r["value"])) for r in rows}) == 276 and len(rows) == 828
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


# The sink


def table(spark, n=1000, seed=5):
    rng = random.Random(seed)
    data = [(rng.randrange(3), rng.random() if i % 50 else None, i.to_bytes(4, "big")) for i in range(n)] + [(1, float("nan"), b"\0\0\0\0")]
    return spark.createDataFrame(data, "epoch INT, key FLOAT, value BINARY").repartition(4)


def content(df):
    return sorted((r["epoch"], r["key"], bytes(r["value"])) for r in df.where("key IS NOT NULL AND NOT isnan(key)").select("epoch", "key", "value").collect())


def names(path):
    return sorted(os.listdir(path))


@pytest.mark.parametrize("block", [7, 1000])
def test_files_roll_at_their_limit(spark, tmp_path, block):
    B.register(spark)
    path, df = str(tmp_path / "out"), table(spark)
    write = lambda mode: df.write.format("rdb").mode(mode).option("file_records", 60).option("block_records", block).save(path)
    write("append")
    first = names(path)
    assert first == [B.file_name(k) for k in range(len(first))] and len(first) >= 17
    assert content(spark.read.format("rdb").load(path)) == content(df)
    m = spark.read.format("rdb_manifest").load(path)
    per = m.groupBy("rank").agg(F.sum("item_count").alias("n"), F.max("item_count").alias("most")).collect()
    assert max(r["n"] for r in per) == 60 and max(r["most"] for r in per) <= block
    assert m.where("obs_min > obs_max").count() == 0
    write("append")
    assert len(names(path)) == 2 * len(first) and content(spark.read.format("rdb").load(path)) == sorted(content(df) * 2)
    df.where("epoch = 1").write.format("rdb").mode("overwrite").option("file_records", 1000).save(path)
    assert content(spark.read.format("rdb").load(path)) == content(df.where("epoch = 1")) and len(names(path)) <= 4


def test_small_files_are_read_together(spark, tmp_path, monkeypatch):
    """A task for each of very many small files, and a batch for each block, cost more than the rows."""
    path, rng = str(tmp_path / "many"), np.random.default_rng(2)
    for rank in range(200):
        B.write_file(path, rank, {0: [(rng.random(5).astype("f4"), np.full((5, 3), rank, np.uint8))] * 2}, 3)
    B.register(spark)
    got = spark.read.format("rdb").load(path)
    assert got.rdd.getNumPartitions() == 1
    assert sorted((r["rank"], r["pos"], r["value"][0]) for r in got.collect()) == [(k, p, k) for k in range(200) for p in range(1, 11)]
    assert got.where("rank = 7 AND key >= 0").count() == 10
    reader = B._Reader({"path": path}, True)
    assert [len(b) for part in reader.partitions() for b in reader.read(part)] == [2000]
    monkeypatch.setattr(B, "PACK", 700)  # ten files of 70 bytes
    assert len(reader.partitions()) == 20


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    B.register(spark)
    path, df = str(tmp_path / "out"), table(spark)
    df.write.format("rdb").mode("append").save(path)
    before = names(path)
    bad = df.unionByName(spark.createDataFrame([(0, 1.0, b"short")], df.schema)).coalesce(2)
    with pytest.raises(Exception, match="values of other than 4 bytes"):
        bad.write.format("rdb").mode("append").option("file_records", 20).option("value_size", 4).save(path)
    assert names(path) == before and content(spark.read.format("rdb").load(path)) == content(df)


def test_a_killed_task_leaves_nothing(tmp_path):
    """A task that is killed reports nothing; the job's folder goes with its drafts."""
    schema = B.StructType([f for f in B.RECORD.fields if f.name in ("epoch", "key", "value")])
    w = B.BlockWriter({"path": str(tmp_path), "file_records": "2", "block_records": "2"}, schema, False)
    batch = B.pa.RecordBatch.from_arrays([B.pa.array([0, 0, 0], B.pa.int32()), B.pa.array([1, 2, 3], B.pa.float32()), B.pa.array([b"a", b"b", b"c"])], names=["epoch", "key", "value"])

    def killed():
        yield batch
        raise SystemExit

    with pytest.raises(SystemExit):
        w.write(killed())
    assert any(n.startswith(DRAFTS) for n in names(tmp_path))
    done = w.write(iter([batch]))
    w.commit([done, None])  # the other try of the task
    assert names(tmp_path) == [B.file_name(0), B.file_name(1)]
    w.write(iter([batch]))
    w.abort([None])
    assert names(tmp_path) == [B.file_name(0), B.file_name(1)]


def test_odd_writes(spark, tmp_path):
    B.register(spark)
    path = str(tmp_path / "out")
    table(spark).where("false").write.format("rdb").mode("append").save(path)
    assert names(path) == [] and spark.read.format("rdb").load(path).count() == 0
    with pytest.raises(Exception, match="no column value"):
        table(spark).drop("value").write.format("rdb").mode("append").save(path)
    many = spark.range(500).select((F.col("id") % 100).cast("int").alias("epoch"), F.col("id").cast("float").alias("key"), F.lit(b"").alias("value"))
    many.coalesce(1).write.format("rdb").mode("append").option("block_records", 4).save(path)
    assert spark.read.format("rdb").load(path).groupBy("epoch").count().where("count != 5").count() == 0


# The stream


def _take(spark, path, to, checkpoint):
    stream = spark.readStream.format("rdb").option("settle_ms", 20).load(path)
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(to)
    q.awaitTermination()
    assert q.exception() is None
    return sorted((r["epoch"], r["rank"], r["pos"], r["key"], bytes(r["value"])) for r in spark.read.parquet(to).collect())


def test_a_stream_takes_each_epoch_once(spark, tmp_path):
    B.register(spark)
    path, to, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    block = lambda n: [(np.arange(n, dtype="f4"), np.zeros((n, 2), np.uint8))]
    B.write_file(path, 0, {0: block(3), 2: block(4)}, 2)
    B.write_file(path, 1, {0: block(5)}, 2)
    B.write_file(path, 3, {0: block(9)}, 2)  # rank 2 isn't there yet
    first = _take(spark, path, to, checkpoint)
    assert len(first) == 12
    assert _take(spark, path, to, checkpoint) == first  # started again, with nothing new
    B.write_file(path, 0, {0: block(3), 2: block(4), 5: block(2)}, 2)
    B.write_file(path, 2, {1: block(1)}, 2)
    whole = sorted((r["epoch"], r["rank"], r["pos"], r["key"], bytes(r["value"])) for r in spark.read.format("rdb").load(path).collect())
    assert _take(spark, path, to, checkpoint) == whole and len(whole) == 24


def test_files_that_grow_are_left_alone(tmp_path, monkeypatch):
    path = str(tmp_path)
    block = [(np.arange(2, dtype="f4"), np.zeros((2, 2), np.uint8))]
    B.write_file(path, 0, {0: block}, 2)
    s = B._Stream({"path": path, "settle_ms": "0"})
    assert s.latestOffset() == {"taken": [[1, 1]]}
    B.write_file(path, 0, {0: block, 1: block}, 2)
    B.write_file(path, 1, {0: block}, 2)
    assert s.latestOffset() == {"taken": [[1, 1]]}  # seen at this size for the first time
    assert s.latestOffset() == {"taken": [[2, 1], [1, 1]]}
    parts = s.partitions({"taken": [[1, 1]]}, {"taken": [[2, 1], [1, 1]]})
    assert sorted((p.rank, b[0]) for p in parts for b in p.blocks) == [(0, 1), (1, 0)]
    size = dict(B.list_ranks(path))
    looks = iter([{0: 5}, {0: size[0]}, size, size])
    again = B._Stream({"path": path, "settle_ms": "0"})
    monkeypatch.setattr(again, "_look", lambda: next(looks))
    assert again.latestOffset()["taken"] == [[2, 1], [1, 1]]


def test_reads_of_one_rank_open_one_file(spark, files, monkeypatch):
    opened = []
    real = B.read_footer
    monkeypatch.setattr(B, "read_footer", lambda path, rank, size: opened.append(rank) or real(path, rank, size))
    r = B._Reader({"path": files}, values=False)
    list(r.pushFilters([B.EqualTo(("rank",), 1)]))
    assert {p.rank for p in r.partitions()} == {1} and opened == [1]
