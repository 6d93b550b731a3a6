"""Interval algebra, range queries, manifests: the fixed cases and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangelake.functions import predicates as R
from rangelake.operators import analytics as A
from rangelake.operators import layout as L
from rangelake.operators import manifest as M
from rangelake.operators import query as Q
from rangelake.operators import validate as C


def records(spark, keys, epoch=0, ranks=2, block=4):
    rows = [(epoch, i % ranks, i // ranks // block, i // ranks + 1, float(k)) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "epoch INT, rank INT, sst INT, pos BIGINT, key FLOAT")


def test_queries_overlap(spark):
    q = spark.createDataFrame([(1, 0, 0.5, 10.0), (2, 0, 0.0, 1.0), (3, 1, 1.0, 2.0)], "qid INT, epoch INT, qbegin FLOAT, qend FLOAT")
    pairs = {(r[0], r[1]) for r in q.alias("a").join(q.alias("b"), R.queries_overlap("a", "b")).select("a.qid", "b.qid").collect()}
    assert pairs == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}


def test_schedule_takes_each_ranks_first(spark):
    items = [(0, 0, 0), (0, 0, 10), (0, 1, 0), (0, 2, 0), (0, 0, 5)]
    m = spark.createDataFrame([(e, r, i, o) for i, (e, r, o) in enumerate(items)], "epoch INT, rank INT, sst INT, offset BIGINT")
    got = [(r["rank"], r["offset"]) for r in A.schedule(m).orderBy("slot").collect()]
    assert got == [(0, 0), (1, 0), (2, 0), (0, 5), (0, 10)]
    assert A.schedule(m).agg(F.countDistinct("slot"), F.max("slot")).first()[:] == (5, 4)


@pytest.mark.parametrize(("a", "b", "want"), [((0, 1), (1, 2), True), ((0, 10), (2, 3), True), ((2, 3), (0, 10), True), ((0, 1), (1.5, 2), False), ((1, 1), (1, 1), True)])
def test_overlaps(spark, a, b, want):
    d = spark.createDataFrame([(float(a[0]), float(a[1]))], "lo FLOAT, hi FLOAT")
    assert d.select(R.overlaps(F.col("lo"), F.col("hi"), *b)).first()[0] is want


def test_inverted_and_empty_ranges(spark):
    with pytest.raises(ValueError, match="not a range"):
        Q.range_query(records(spark, [1, 2]), 0, 2, 1)
    d = spark.createDataFrame([(None, None), (1.0, 1.0)], "lo FLOAT, hi FLOAT")
    assert [r[0] for r in d.select(R.valid_range(F.col("lo"), F.col("hi"))).collect()] == [False, True]


def test_boundaries_and_float_literals(spark):
    r = records(spark, [0.5, 0.51, 0.6, 1.0])
    n = {c: r.where(R.in_range(F.col("key"), 0.51, 1.0, c)).count() for c in R.CLOSED}
    assert n == {"both": 3, "left": 2, "right": 2, "neither": 1}
    with pytest.raises(ValueError, match="closed"):
        R.in_range(F.col("key"), 0, 1, "open")


def test_nan_keys_stay_out(spark):
    r = records(spark, [1.0, float("nan"), -0.0, -3.5, 1e-40])
    m = M.build_manifest(r)
    assert m.agg(F.sum("item_count")).first()[0] == 4
    assert m.agg(F.min("obs_min")).first()[0] == -3.5
    assert C.violations(r, m).count() == 1


@pytest.mark.parametrize("n", [1, 2, 10, 11, 101])
def test_preview(spark, n):
    keys = spark.createDataFrame([(float(k),) for k in range(n)], "key FLOAT").repartition(3)
    assert {r["percent"]: r["key"] for r in Q.preview(keys).collect()} == {p: float(p * (n - 1) // 100) for p in (0, 10, 50, 100)}


def test_preview_of_nothing(spark):
    assert Q.preview(spark.createDataFrame([], "key FLOAT")).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 100, width=32), min_size=1, max_size=60), st.floats(0, 100, width=32), st.floats(0, 50, width=32))
def test_pruned_query_is_full_scan(spark, keys, lo, width):
    lo, hi = float(np.float32(lo)), float(np.float32(lo + width))
    r = records(spark, keys)
    m = M.build_manifest(r)
    want = sorted(k for k in map(np.float32, keys) if np.float32(lo) <= k <= np.float32(hi))
    assert [x["key"] for x in Q.range_query(r, 0, lo, hi).collect()] == [float(k) for k in want]
    cand = Q.candidates(r, m, 0, lo, hi)
    assert cand.where(R.in_range(F.col("key"), lo, hi)).count() == len(want)
    s = Q.selectivity(r, m, 0, lo, hi).first()
    assert 0 <= s["key_selectivity"] <= s["sst_selectivity"] <= 1
    assert C.violations(r, m).count() == 0


def test_batch_covers_missing_epochs_and_ranks(spark):
    r = records(spark, range(20))
    q = spark.createDataFrame([(0, 0, 3.0, 5.0, None), (1, 0, 3.0, 5.0, 1), (2, 9, 0.0, 1.0, None), (3, 0, 100.0, 200.0, -1)], "qid INT, epoch INT, qbegin FLOAT, qend FLOAT, rank INT")
    got = {x["qid"]: (x["keys"], x["epoch_mass"]) for x in Q.batch_report(r, M.build_manifest(r), q).collect()}
    assert got == {0: (3, 20), 1: (2, 20), 2: (0, 0), 3: (0, 20)}


def test_filters_reach_the_scan(spark, tmp_path):
    L.compact(records(spark, range(100)).unionByName(records(spark, range(50), epoch=1)), str(tmp_path / "c"), part_records=25)
    df = Q.range_query(L.read_epochs(spark, str(tmp_path / "c")), 1, 10, 12, ordered=False).select("key")
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(epoch" in plan and "GreaterThanOrEqual(key,10.0)" in plan
    assert df.count() == 3


def test_compaction_keeps_rows_and_orders_keys(spark, tmp_path):
    rng = np.random.default_rng(1)
    r = records(spark, [*rng.exponential(5, 300), 1.0, 1.0, 1.0])
    L.compact(r, str(tmp_path / "c"), part_records=25)
    back = L.read_epochs(spark, str(tmp_path / "c"))
    assert sorted(x["key"] for x in back.collect()) == sorted(x["key"] for x in r.collect())
    one = L.renumber(L.cluster_epoch(r, 0, 3), 16)
    assert L.key_order_violations(one).count() == 0 and one.count() == 303
    ends = one.groupBy("rank").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("rank").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(ends, ends[1:], strict=False))


def test_compaction_deals_epochs_of_unlike_sizes_and_hot_keys_evenly(spark, tmp_path):
    big = spark.range(8000).selectExpr("0 AS epoch", "CAST(id % 4 AS INT) AS rank", "0 AS sst", "id AS pos", "CAST(IF(id % 2 = 0, 7, id) AS FLOAT) AS key")
    small = spark.range(3000).selectExpr("CAST(1 + id % 60 AS INT) AS epoch", "0 AS rank", "0 AS sst", "id AS pos", "CAST(id AS FLOAT) AS key")
    L.compact(big.unionByName(small), str(tmp_path / "c"), part_records=500)
    back = L.read_epochs(spark, str(tmp_path / "c")).withColumn("file", F.input_file_name())
    tasks = back.groupBy(F.regexp_extract("file", r"part-(\d+)", 1).alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 11000 and len(tasks) >= 15 and max(r["count"] for r in tasks) <= 1500
    files = back.groupBy("epoch", "file").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("epoch", "file").collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(files, files[1:], strict=False) if a["epoch"] == b["epoch"])
    assert sum(r["epoch"] == 0 for r in files) >= 10 and sum(r["epoch"] != 0 for r in files) <= 60 + len(tasks)


def test_clustering_prunes_more(spark):
    rng = np.random.default_rng(2)
    r = records(spark, rng.exponential(5, 400), block=10)
    before = M.overlapping(M.build_manifest(r), 0, 1, 1.2).agg(F.sum("item_count")).first()[0]
    after = M.overlapping(M.build_manifest(L.renumber(L.cluster_epoch(r, 0, 2), 10)), 0, 1, 1.2).agg(F.sum("item_count")).first()[0]
    assert after < before / 3


def test_kv_sizes(spark):
    assert M.kv_sizes(spark.createDataFrame([(4, 8), (4, 8)], "key_sz INT, val_sz INT")) == (4, 8)
    with pytest.raises(ValueError, match="differ"):
        M.kv_sizes(spark.createDataFrame([(4, 8), (4, 9)], "key_sz INT, val_sz INT"))


def test_validator_sees_every_record(spark):
    rows = [(0, 0, 0, i + 1, 1.0) for i in range(1001)]
    m = M.build_manifest(spark.createDataFrame(rows, "epoch INT, rank INT, sst INT, pos BIGINT, key FLOAT"))
    for bad, sampled in ((0, 1), (999, 0), (1000, 1)):
        own = [(*r[:4], 9.0) if i == bad else r for i, r in enumerate(rows)]
        d = spark.createDataFrame(own, "epoch INT, rank INT, sst INT, pos BIGINT, key FLOAT")
        assert C.violations(d, m).count() == 1
        assert C.violations(d, m, sample_every=1000).count() == sampled
        assert C.report(d, m).first()["first_key"] == 9.0


def test_probe_grid():
    low = A.probe_grid(0.0, 2.0)
    assert len(low) == 20 or len(low) == 21
    assert min(A.probe_grid(7.0, 12.0)) == 2.0  # cut-offs below the range start runs of their own
    assert max(A.probe_grid(150.0, 160.0)) < 160
    assert A.probe_grid(0.5, 0.5) == []
