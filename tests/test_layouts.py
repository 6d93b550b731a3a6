"""Streams that lay out anew: against plain walks, over micro-batches, kills and restarts."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rangelake import queries, views
from rangelake.streaming import layouts as S


def rows(writers=6, most=400, seed=1):
    rng = random.Random(seed)
    out = []
    for w in range(writers):
        spread = 10.0 ** (w % 3)
        out += [(w // 3, w % 3, p + 1, rng.choice([rng.gauss(5, spread), 5.0, -rng.expovariate(0.1)])) for p in range(rng.randrange(1, most))]
    return [*out, (9, 0, 1, float("nan")), (9, 0, 2, None), (8, 0, 1, 4.0)]


def frame(spark, data):
    return spark.createDataFrame(data, "epoch INT, rank INT, pos BIGINT, key FLOAT")


def plain(data, buffer):
    """(epoch, rank, pos) -> version, and the layouts' (epoch, rank, version, pos, lo, hi), record by record."""
    versions, made = {}, []
    for e, r in sorted({(e, r) for e, r, _, _ in data}):
        version, lo, hi, held = 0, None, None, []
        for _, _, p, k in sorted(x for x in data if x[:2] == (e, r)):
            if k is None or k != k:
                continue
            k = float(np.float32(k))
            if version and lo <= k <= hi:
                versions[e, r, p] = version
                continue
            held.append((p, k))
            if len(held) == buffer:
                ks = [k for _, k in held]
                lo, hi = (min(lo, *ks), max(0.0, hi, *ks)) if version else (min(ks), max(ks))
                version += 1
                made.append((e, r, version, p, lo, hi))
                versions |= {(e, r, p): version for p, _ in held}
                held = []
        versions |= {(e, r, p): 0 for p, _ in held}
    return versions, sorted(made)


@pytest.mark.parametrize("buffer, pivots", [(8, 4), (1, 2), (50, 16)])
def test_replay_is_the_plain_walk(spark, buffer, pivots):
    data = rows()
    events = S.replay(frame(spark, data).repartition(5), buffer, pivots)
    versions, made = plain(data, buffer)
    assert {(r["epoch"], r["rank"], r["pos"]): r["version"] for r in S.delivered(events).collect()} == versions
    assert sorted((r["epoch"], r["rank"], r["version"], r["pos"], r["lo"], r["hi"]) for r in S.layouts(events).collect()) == made
    for r in events.where("kind = 'final'").collect():
        assert all(a <= b for a, b in zip(r["pivots"], r["pivots"][1:])) and len(r["pivots"]) == len(r["counts"]) + 1 <= pivots
        assert sum(r["counts"]) == sum(v == r["version"] for (e, k, _), v in versions.items() if (e, k) == (r["epoch"], r["rank"]))


def test_buckets_are_those_of_the_layout(spark):
    events = S.replay(frame(spark, rows()), 16, 8).collect()
    own = {(r["epoch"], r["rank"], r["version"]): r["pivots"] for r in events if r["kind"] == "layout"}
    for r in events:
        if r["kind"] == "record":
            p = own[r["epoch"], r["rank"], r["version"]]
            assert p[r["bucket"]] <= r["key"] and (r["key"] < p[r["bucket"] + 1] or r["bucket"] == len(p) - 2)


def test_steps_make_no_difference(monkeypatch):
    rng = np.random.default_rng(3)
    keys, pos = rng.normal(size=500).astype("f4"), np.arange(500)

    def run(cuts):
        w = S.Writer(20, 6)
        out = [e for a, b in zip([0, *cuts], [*cuts, 500], strict=True) for e in w.take(pos[a:b], keys[a:b])] + list(w.close())
        flat = [(k, p, v) for e in out if e["kind"].iloc[0] in ("record", "held") for k, p, v in zip(e["kind"], e["pos"], e["version"], strict=True)]
        return sorted(flat), [e["pivots"].iloc[0] for e in out if "pivots" in e]

    whole = run([])
    assert run([1, 2, 19, 20, 21, 300]) == whole
    monkeypatch.setattr(S, "STEP", 7)
    assert run([250]) == whole


def test_equal_keys_and_negative_ones():
    w = S.Writer(4, 8)
    made = [e for e in w.take(np.arange(8), np.array([5] * 4 + [-1, -2, -3, -4], "f4")) if e["kind"].iloc[0] == "layout"]
    assert made[0]["pivots"].iloc[0] == [5.0, 5.0] and made[1]["pivots"].iloc[0][0] == -4.0 and made[1]["pivots"].iloc[0][-1] == 5.0
    with pytest.raises(ValueError):
        S._check(0, 4)
    with pytest.raises(ValueError):
        S._check(4, 1)


def _files(spark, data, path):
    """Each writer's records over several files, in order of time."""
    for k in range(4):
        part = [(*x, x[2] == max(y[2] for y in data if y[:2] == x[:2])) for x in data if x[2] % 1000 // 100 == k]
        spark.createDataFrame(part, "epoch INT, rank INT, pos BIGINT, key FLOAT, last BOOLEAN").coalesce(1).write.mode("append").parquet(path)


def _start(spark, path, to, checkpoint, **more):
    records = spark.readStream.schema("epoch INT, rank INT, pos BIGINT, key FLOAT, last BOOLEAN").option("maxFilesPerTrigger", 1).parquet(path)
    return S.write_events(S.lay_out(records, 8, 4, last_pos="last", **more), to, checkpoint)


def test_a_killed_stream_goes_on_and_equals_the_replay(spark, tmp_path, monkeypatch):
    data = [x for x in rows() if x[0] < 8]
    path, to, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    _files(spark, data, path)
    whole = S.write_events

    def failing(events, path, checkpoint):
        """Writes the third batch and dies before it is marked as done."""

        def write(batch, batch_id):
            batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
            if batch_id == 2:
                raise RuntimeError("killed")

        return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

    monkeypatch.setattr(S, "write_events", failing)
    with pytest.raises(Exception, match="killed"):
        _start(spark, path, to, checkpoint).awaitTermination()
    monkeypatch.setattr(S, "write_events", whole)
    q = _start(spark, path, to, checkpoint)
    q.awaitTermination()
    assert q.exception() is None
    got = spark.read.parquet(to)
    want = S.replay(frame(spark, data), 8, 4)
    for part in (S.delivered, S.layouts, lambda e: e.where("kind = 'final'").select("epoch", "rank", "version", "pivots", "counts", "n_left", "n_right")):
        assert sorted(map(str, part(got).collect())) == sorted(map(str, part(want).collect()))
    assert got.select("batch").distinct().count() == 4


def test_an_idle_writer_is_closed(spark, tmp_path):
    data = [x for x in rows(2, 60) if x[0] < 8]
    path, to, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    frame(spark, data).coalesce(1).write.parquet(path)
    records = spark.readStream.schema("epoch INT, rank INT, pos BIGINT, key FLOAT").parquet(path)
    events = S.lay_out(records, 8, 4, idle_ms=500)
    q = events.writeStream.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(to)).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            q.awaitTermination(1)
            if not q.isActive or (q.lastProgress and q.lastProgress["batchId"] >= 1 and spark.read.parquet(to).where("kind = 'final'").count() == 2):
                break
    finally:
        q.stop()
    assert q.exception() is None
    assert sorted(map(str, S.delivered(spark.read.parquet(to)).collect())) == sorted(map(str, S.delivered(S.replay(frame(spark, data), 8, 4)).collect()))


@pytest.mark.parametrize("name", ["stream_deliveries", "stream_layouts"])
def test_queries_equal_their_sql_past_its_last_level(spark, tmp_path, name):
    """Keys that rise and fall: the writers lay out more often than the SQL has levels."""
    rng = random.Random(3)
    data = [(i, i, i % 2, rng.uniform(-i, i) if i % 3 else float(i)) for i in range(1, 400)]
    events = spark.createDataFrame(data, "event_id BIGINT, s INT, user_id BIGINT, value DOUBLE")
    events.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "value").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    versions = S.replay(views.event_records(spark, str(tmp_path)), queries._HELD, 4).agg(F.max("version")).first()[0]
    assert versions > queries._LEVELS
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = queries.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
