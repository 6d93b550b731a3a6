"""Buffered frames: bytes of dumps and restart files, streams that go on from either."""

import struct

import numpy as np
import pytest

from rangelake.streaming import frames as FR

SPECIES = (FR.Species("electron", -1.0, 1.0), FR.Species("ion", 1.0, 400.0))
COLUMNS = ("w", "x")
SCHEMA = "rank INT, step BIGINT, t DOUBLE, species STRING, tag INT, w FLOAT, x FLOAT"


def rows(steps=range(11), ranks=2):
    return [(r, s * 10, s / 2, n, k, float(k), float(s * 100 + k)) for r in range(ranks) for s in steps for n, m in (("electron", 2 + (s + r) % 2), ("ion", s % 3)) for k in range(m)]


def test_a_dump_by_bytes():
    b = FR.Buffer(SPECIES, 2, 2)
    assert b.take(0.5, [np.array([[1, 2]]), np.zeros((0, 2))]) is None
    first, second = b.take(1.0, [np.array([[3, 4], [5, 6]]), np.array([[7, 8]])])
    assert first == struct.pack("<iffiifd", 2, -1, 1, 2, 2, 1, 1) + struct.pack("<2i2f", 1, 2, 0.5, 1.0) + struct.pack("<6f", 1, 2, 3, 4, 5, 6)
    assert second == struct.pack("<iffiifd", 2, 1, 400, 2, 2, 1, 1) + struct.pack("<2i2f", 0, 1, 0.5, 1.0) + struct.pack("<2f", 7, 8)
    assert b.times == [] and b.frames == []


def test_a_restart_file_by_bytes():
    b = FR.Buffer(SPECIES, 2, 3)
    b.take(0.5, [np.array([[1, 2]]), np.zeros((0, 2))])
    b.take(0.75, [np.array([[3, 4]]), np.array([[5, 6]])])
    raw = b.restart()
    assert raw == struct.pack("<3i", 2, 3, 6) + struct.pack("<6i", 1, 1, 0, 0, 1, 0) + struct.pack("<2f", 0.5, 0.75) + np.array([np.nan], "<f4").tobytes() + struct.pack("<2i", 2, 1) + struct.pack("<6f", 1, 2, 3, 4, 5, 6)
    again = FR.Buffer.restored(raw, SPECIES, 2)
    assert again.restart() == raw and again.take(1, [np.zeros((0, 2))] * 2) == b.take(1, [np.zeros((0, 2))] * 2)
    for bad in (raw[:-4], raw + b"\0\0\0\0"):
        with pytest.raises(ValueError, match="don't fit"):
            FR.Buffer.restored(bad, SPECIES, 2)
    with pytest.raises(ValueError, match="of 2 species"):
        FR.Buffer.restored(raw, SPECIES[:1], 2)


def test_dumps_of_a_table_come_back(spark, tmp_path):
    d = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    made = FR.dump_frames(d, SPECIES, COLUMNS, 4)
    FR.write_files(made, str(tmp_path))
    got = sorted((r["rank"], r["step"], r["species"], r["frame"], r["t"], r["w"], r["x"]) for r in FR.read_dumps(spark, str(tmp_path), COLUMNS).collect())
    assert got == sorted((r, (s // 40) * 40 + 30, n, s // 10 % 4, t, w, x) for r, s, t, n, _, w, x in rows() if s < 80)
    kept = {r["rank"]: bytes(r["restored"]) for r in FR.read_restarts(spark, str(tmp_path)).collect()}
    assert {r: FR.Buffer.restored(x, SPECIES, 2).times for r, x in kept.items()} == {0: [4.0, 4.5, 5.0], 1: [4.0, 4.5, 5.0]}
    with pytest.raises(Exception, match="2 variables, not 1"):
        FR.read_dumps(spark, str(tmp_path), ("w",)).collect()
    with pytest.raises(Exception, match="aren't among"):
        FR.dump_frames(d, SPECIES[:1], COLUMNS, 4).collect()
    assert FR.dump_frames(d.where("false"), SPECIES, COLUMNS, 4).collect() == []


def _stream(spark, path, to, checkpoint, schema=SCHEMA):
    t = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    made = FR.buffer_frames(t, SPECIES, COLUMNS, 4)
    q = made.writeStream.foreachBatch(lambda b, i: FR.write_files(b, to)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def _bytes(spark, path):
    return {r["path"].split(path)[-1]: bytes(r["content"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).collect() if ".crc" not in r["path"]}


def test_dump_restore_and_go_on_gives_the_frames_of_one_run(spark, tmp_path):
    one, two, whole = (str(tmp_path / x) for x in ("one", "two", "whole"))
    put = lambda data, path, schema=SCHEMA: spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    FR.write_files(FR.dump_frames(spark.createDataFrame(rows(), SCHEMA), SPECIES, COLUMNS, 4), whole)
    # One stream, in three micro-batches and two starts.
    put(rows(range(3)), f"{one}-in")
    put(rows(range(3, 6)), f"{one}-in")
    _stream(spark, f"{one}-in", one, f"{one}-c")
    put(rows(range(6, 11)), f"{one}-in")
    _stream(spark, f"{one}-in", one, f"{one}-c")
    assert _bytes(spark, one) == _bytes(spark, whole)
    # A stream that ends, and another one that has its restart files alone.
    put(rows(range(6)), f"{two}-in")
    _stream(spark, f"{two}-in", two, f"{two}-c")
    taken = [(r["rank"], 50, None, None, None, None, None, bytes(r["restored"])) for r in FR.read_restarts(spark, two).collect()]
    put([*taken, *[(*r, None) for r in rows(range(4, 11))]], f"{two}-later", f"{SCHEMA}, restored BINARY")  # some steps again
    _stream(spark, f"{two}-later", two, f"{two}-c2", f"{SCHEMA}, restored BINARY")
    assert _bytes(spark, two) == _bytes(spark, whole)
