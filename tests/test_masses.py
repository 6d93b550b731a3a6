"""Summaries of mass: against local pivots, exact masses and the stated bound."""

import random

import numpy as np
import pytest

from rangelake.operators import masses as MS
from rangelake.operators import pivots as PV


def keys(ranks=5, n=400, seed=1):
    rng = random.Random(seed)
    return [(e, r, float(np.float32(rng.choice([rng.lognormvariate(1, 1), 3.0, -rng.random()])))) for e in range(3) for r in range(ranks) for _ in range(rng.randrange(2, n))]


def frames(spark, rows, bins):
    return spark.createDataFrame([*rows, (0, 0, None), (0, 0, float("nan"))], "epoch INT, rank INT, key FLOAT").repartition(4), spark.createDataFrame(bins, "epoch INT, bins ARRAY<DOUBLE>")


BINS = [(0, [0.5, 1.0, 2.0, 2.5, 4.0]), (1, [-5.0, 50.0])]


def test_rank_pivots_are_those_of_one_context(spark):
    rows = keys()
    k, layouts = frames(spark, rows, BINS)
    got = {(r["epoch"], r["rank"]): r for r in MS.rank_pivots(MS.rank_segments(k, layouts), 9, layouts).collect()}
    assert set(got) == {(e, r) for e, r, _ in rows}
    for (e, r), found in got.items():
        own = np.sort([x for a, b, x in rows if (a, b) == (e, r)])
        assert found["mass"] == len(own) and len(found["pivots"]) == 9
        if e == 2:
            assert (found["pivots"][0], found["pivots"][-1]) == (own[0], own[-1])
            continue
        bins = np.array(dict(BINS)[e])
        inside = own[(own >= bins[0]) & (own <= bins[-1])]
        counts = np.bincount(np.clip(np.searchsorted(bins, inside, side="right") - 1, 0, len(bins) - 2), minlength=len(bins) - 1)
        c = PV.Context(tuple(bins), tuple(map(float, counts)), tuple(own[own < bins[0]]), tuple(own[own > bins[-1]]))
        assert np.allclose(found["pivots"], PV.from_all(c, 9).values, atol=1e-4)


def test_merged_pivots_keep_the_bound(spark):
    rows = keys(ranks=40, n=120, seed=2)
    k, none = frames(spark, rows, [])
    n, fan = 33, 4
    made = MS.merge_pivots(MS.rank_pivots(MS.rank_segments(k, none), n), n, fan)
    pivots = {r["epoch"]: r for r in made.collect()}
    levels = 3  # 40 ranks, 10, 3, 1
    for e, found in pivots.items():
        own = np.sort([x for a, _, x in rows if a == e])
        assert found["mass"] == len(own) and np.all(np.diff(found["pivots"]) >= 0)
        step = len(own) / (n - 1)
        for i, p in enumerate(found["pivots"]):
            below, upto = np.searchsorted(own, p), np.searchsorted(own, p, side="right")
            assert below - (levels + 1) * step - 40 <= i * step <= upto + (levels + 1) * step + 40  # a segment a rank is cut
    exact = {(r["epoch"], r["idx"]): r["below"] for r in MS.masses_below(k, made).collect()}
    assert exact == {(e, i): int((np.array([x for a, _, x in rows if a == e]) < p).sum()) for e, r in pivots.items() for i, p in enumerate(r["pivots"])}


def test_merging_is_exact_where_nothing_is_lost():
    one = np.linspace(0, 10, 11)
    assert np.allclose(MS.merge_summaries([one, one], [10, 30], 11), one)
    two = MS.merge_summaries([np.array([0.0, 1.0]), np.array([5.0, 6.0])], [1, 1], 5)
    assert np.allclose(two, [0, 0.5, 1, 5.5, 6])
    atom = MS.merge_summaries([np.array([3.0, 3.0, 3.0]), np.array([2.0, 4.0])], [10, 2], 5)
    assert np.allclose(atom, [2, 3, 3, 3, 4])
    below, upto = MS.cumulative(np.array([1.0, 1.0, 2.0]), 2.0, np.array([0.0, 1.0, 1.5, 2.0, 9.0]))
    assert below.tolist() == [0, 0, 1.5, 2, 2] and upto.tolist() == [0, 1, 1.5, 2, 2]


@pytest.mark.parametrize("n", [1, 257])
def test_numbers_of_pivots_have_bounds(spark, n):
    with pytest.raises(ValueError):
        MS.rank_pivots(spark.createDataFrame([], "epoch INT, rank INT, lo DOUBLE, hi DOUBLE, mass DOUBLE"), n)


def test_an_empty_table_has_no_pivots(spark):
    k, layouts = frames(spark, [], BINS)
    made = MS.merge_pivots(MS.rank_pivots(MS.rank_segments(k, layouts), 5, layouts), 5)
    assert made.collect() == [] and MS.masses_below(k, made).collect() == []
