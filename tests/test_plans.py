"""Planners, pivots, timing against plain versions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangelake.operators import pivots as PV
from rangelake.operators.timing import Timer, log_query
from rangelake.plans import planner as PL
from rangelake.sources.text import query_log


def manifest(spark, epochs):
    """Blocks (least, greatest, records) of each epoch."""
    rows = [(e, 0, i, 0, lo, hi, lo, hi, n, 0, 0) for e, blocks in epochs.items() for i, (lo, hi, n) in enumerate(blocks)]
    return spark.createDataFrame(rows, "epoch INT, rank INT, sst INT, offset BIGINT, obs_min FLOAT, obs_max FLOAT, exp_min FLOAT, exp_max FLOAT, item_count BIGINT, oob_count BIGINT, upd_round INT")


def plain_plan(epochs):
    f, taken, out = np.float32, [], []
    for e in sorted(epochs):
        blocks = [(f(a), f(b), n) for a, b, n in epochs[e]]
        mass = sum(n for *_, n in blocks)
        if mass < 1000:
            continue
        top_key = max(b for _, b, _ in blocks)
        lo = min(a for a, _, _ in blocks)
        hi = f(lo + f(0.001))
        while hi < top_key:
            sel = f(sum(n for a, b, n in blocks if a <= hi and b >= lo) / mass)
            need = sum(1 for t in taken if abs(t - sel) < f(0.002)) < 3
            use = sel < f(0.02)
            if need and use:
                taken.append(sel)
                out.append((e, float(lo), float(hi)))
            hi = f(float(hi) + 0.1)
            if need or not use:
                lo = f(float(hi) + 0.1)
                hi = f(float(lo) + 0.001)
    return out


def test_query_plan(spark):
    rng = np.random.default_rng(3)
    epochs = {}
    for e, total in ((0, 6000), (1, 6000), (2, 999)):
        keys = np.sort(rng.exponential(3, total)).astype("f4")
        epochs[e] = [(float(k[0]), float(k[-1]), len(k)) for k in np.array_split(keys, total // 60 + 1)]
    got = [tuple(r) for r in PL.query_plan(manifest(spark, epochs)).collect()]
    assert got == plain_plan(epochs) and {r[0] for r in got} <= {0, 1} and got


def plain_spread(epochs, doublings):
    found = {}
    for e, blocks in epochs.items():
        mass, order = sum(n for *_, n in blocks), sorted((np.float32(a), np.float32(b), n) for a, b, n in blocks)
        if mass < 1000:
            continue
        for i, (lo, *_) in enumerate(order):
            for j in (i + (1 << k) - 1 for k in range(doublings + 1)):
                if j < len(order):
                    hi = order[j][1]
                    share = sum(n for a, b, n in order if a <= hi and b >= lo) / mass
                    if share < 0.02:
                        found.setdefault((e, int(np.floor(share / 0.002))), set()).add((e, float(lo), float(hi), share))
    return sorted(r for rows in found.values() for r in sorted(rows)[:3])


def test_spread_plan(spark):
    rng = np.random.default_rng(4)
    epochs = {}
    for e, total in ((0, 60000), (1, 30000), (2, 999)):
        keys = np.sort(rng.exponential(3, total)).astype("f4")
        epochs[e] = [(float(k[0]), float(k[-1] + rng.random() * 0.01), len(k)) for k in np.array_split(keys, total // 90 + 1)]
    epochs[1] += epochs[1][:3] + [(5.0, 5.0, 7)] * 40  # equal blocks, one hot key
    plan = PL.spread_plan(manifest(spark, epochs), doublings=4)
    got = sorted(tuple(r) for r in plan.collect())
    assert got == plain_spread(epochs, 4) and {r[0] for r in got} == {0, 1} and len({int(r[3] / 0.002) for r in got}) > 5
    assert "WindowGroupLimit" in plan._jdf.queryExecution().optimizedPlan().toString()  # a task keeps a few of each class


def test_spread_plan_of_nothing(spark):
    none = manifest(spark, {0: [(1.0, 2.0, 5)]})
    assert PL.spread_plan(none).count() == 0 and PL.spread_plan(none.limit(0)).count() == 0
    empty = manifest(spark, {0: [(1.0, 2.0, 5000)]}).withColumn("obs_min", F.lit(None).cast("float"))
    assert PL.spread_plan(empty).count() == 0


def test_closest_distance():
    assert PL.closest_distance([1.0, 4.0], 3.0) == 1.0
    assert PL.closest_distance([], 3.0) == float("inf")


def plain_runs(blocks, value_size, budget):
    """(run, first, last, cut, records) of blocks (least, greatest, records), one block after the other."""
    blocks = sorted(blocks)
    runs, first, held, last_cut = [], 0, 0, float("-inf")
    for i, (least, _, n) in enumerate(blocks):
        if held * value_size > budget and least > last_cut:
            runs.append((len(runs), first, i - 1, least, held))
            first, held, last_cut = i, 0, least
        held += n
    return [*runs, (len(runs), first, len(blocks) - 1, None, held)] if blocks else []


@pytest.mark.parametrize("value_size, budget, parts", [(1, 10, 1), (8, 100, 5), (1, 0, 3), (0, 10, 2), (3, 1 << 40, 4)])
def test_runs_are_those_of_the_plain_walk(spark, value_size, budget, parts):
    rng = np.random.default_rng(5)
    epochs = {0: [(0.0, 1.0, 11), (1.0, 1.0, 11), (1.0, 2.0, 1)], 1: [(2.0, 2.0, 3)] * 40, 2: [(float(a), float(a + 1), int(n)) for a, n in zip(rng.integers(0, 15, 90), rng.integers(0, 9, 90), strict=True)], 5: [(0.5, 0.5, 0)]}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {tuple(r) for r in PL.run_plan(manifest(spark, epochs), value_size, budget).collect()}
        one = [tuple(r) for r in PL.merge_runs(manifest(spark, epochs), 2, value_size, budget).orderBy("run").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {(e, *r) for e, blocks in epochs.items() for r in plain_runs(blocks, value_size, budget)}
    assert one == plain_runs(epochs[2], value_size, budget)
    assert PL.run_plan(manifest(spark, {}), 1, 10).collect() == []


def test_no_run_is_cut_within_its_keys(spark):
    rng = np.random.default_rng(6)
    blocks = [(float(a), float(a), 4) for a in rng.integers(0, 6, 60)]
    runs = PL.merge_runs(manifest(spark, {3: blocks}), 3, 1, 20).orderBy("run").collect()
    least = sorted(a for a, _, _ in blocks)
    assert [i for r in runs for i in range(r["sst_first"], r["sst_last"] + 1)] == list(range(60))
    assert all(x >= r["cut"] for r in runs[:-1] for x in least[r["sst_last"] + 1 :])


def test_pivots_of_nothing_are_uniform():
    assert PV.pivots(PV.Context(first=True), 5).values == (0, 0.25, 0.5, 0.75, 1)
    assert PV.pivots(PV.Context(left=(3.0,), first=True), 3).values == (0, 0.5, 1)
    assert PV.pivots(PV.Context(bins=(0.0, 1.0), counts=(0,)), 3).values == (0, 0.5, 1)


def test_pivots_from_two_samples():
    p = PV.pivots(PV.Context(left=(1.0, 3.0), first=True), 3)
    assert p.values[0] == 1 and p.values[-1] == 3 and p.values[1] == pytest.approx(1 + 2 / 3)


def test_pivots_from_a_uniform_histogram():
    c = PV.Context(bins=tuple(float(k) for k in range(11)), counts=(10,) * 10)
    assert PV.pivots(c, 6).values == pytest.approx((0, 2, 4, 6, 8, 10))


def test_pivots_jump_over_empty_bins():
    c = PV.Context(bins=(0.0, 1.0, 2.0, 3.0), counts=(10, 0, 10))
    assert PV.pivots(c, 5).values == pytest.approx((0, 0.5, 1.0, 2.5, 3.0))


def test_samples_on_both_sides_widen_the_range():
    c = PV.Context(bins=(10.0, 20.0), counts=(8,), left=(1.0, 2.0, 3.0, 4.0), right=(25.0, 26.0, 27.0, 28.0))
    p = PV.pivots(c, 5)
    assert p.values[0] == 1 and p.values[-1] == 28 and p.width == 4
    assert p.values[1:4] == pytest.approx((10, 15, 20))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=2, max_size=20), st.integers(3, 12))
def test_pivots_hold_equal_mass(counts, n):
    c = PV.Context(bins=tuple(float(k) for k in range(len(counts) + 1)), counts=tuple(counts))
    p = PV.pivots(c, n)
    mass = np.interp(p.values, c.bins, np.concatenate([[0], np.cumsum(counts)]))
    assert np.allclose(np.diff(mass), sum(counts) / (n - 1))


def test_layout_may_widen_but_not_narrow():
    lay, seen = PV.Layout(), []
    lay.install(PV.Pivots((0.0, 1.0, 2.0), 1.0), seen.append)
    lay.install(PV.Pivots((-1.0, 1.0, 3.0), 1.0))
    assert lay.version == 2 and seen == [lay] and lay.counts == [0, 0]
    with pytest.raises(ValueError, match="narrow"):
        lay.install(PV.Pivots((0.0, 1.0, 3.0), 1.0))
    assert PV.serialize((1, 2.5)) == "1.000000,2.500000"


def test_buckets(spark):
    d = spark.createDataFrame([(-1.0,), (0.0,), (1.5,), (2.0,)], "key FLOAT")
    assert [r[0] for r in d.select(PV.bucket(F.col("key"), (0.0, 1.0, 2.0))).collect()] == [-1, 0, 1, 2]


def test_timer_and_query_log(spark, tmp_path):
    t = Timer()
    with t.event("a"):
        pass
    with t.event("a"):
        pass
    assert t.table(spark).first()["runs"] == 2 and t.total() == t.total("a")
    for k in range(2):
        log_query(spark, str(tmp_path / "log"), ("p", k, 0.0, 1.0, 0.5, 0.25, 10, 20))
    assert query_log(spark, str(tmp_path / "log")).orderBy("epoch").collect()[1][1] == 1


def test_walks_end_where_steps_are_lost_in_rounding(spark):
    from rangelake.operators import analytics

    far = 3e9  # a step of 0.1 is lost
    m = spark.createDataFrame([(0, far, far + 2048.0, 2000)], "epoch int, obs_min float, obs_max float, item_count long")
    assert PL.query_plan(m).count() <= 1
    with pytest.raises(ValueError):
        analytics.probe_grid(0.0, far)
