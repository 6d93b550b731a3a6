"""The bitmap index, against scans of all records."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rangelake.functions.predicates import in_range
from rangelake.operators import bitmaps as BM

EDGES = (0.0, 1.0, 2.5, 2.75, 8.0)


@settings(max_examples=120, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 300), st.integers(0, 70_000)), max_size=200), st.integers(0, 400))
def test_bitmaps_come_back(some, run):
    places = np.array(sorted(some | set(range(run))), np.int64)
    assert BM.decode(BM.encode(places)).tolist() == places.tolist()


def test_the_shortest_form_is_taken():
    forms = [BM.encode(np.array(p))[0] for p in ([900], list(range(1000)), list(range(0, 1000, 2)), [1, 70_000])]
    assert forms == [BM.SHORTS, BM.RUNS, BM.BITS, BM.LONGS]
    assert len(BM.encode(np.arange(60_000))) == 5


def rows():
    rng = random.Random(7)
    return [(e, r, i // 50, i * 3 + 1, rng.choice([rng.uniform(-1, 9), 2.5, 1.0])) for e in range(2) for r in range(3) for i in range(170)] + [(0, 0, 0, -9, None), (0, 0, 0, -8, float("nan"))]


@pytest.mark.parametrize("closed", ["both", "left", "right", "neither"])
@pytest.mark.parametrize("lo, hi, epoch", [(1.0, 2.5, None), (0.3, 7.9, 1), (2.5, 2.5, None), (-5, 50, 0), (20, 30, None)])
def test_ranges_by_the_index(spark, closed, lo, hi, epoch):
    r = spark.createDataFrame(rows(), "epoch INT, rank INT, sst INT, pos BIGINT, key FLOAT").repartition(3)
    index = BM.build_index(r, EDGES)
    own = r.where(in_range(r.key, lo, hi, closed))
    own = own if epoch is None else own.where(own.epoch == epoch)
    want = sorted((x["epoch"], x["rank"], x["sst"], x["pos"]) for x in own.where("NOT isnan(key)").collect())
    assert sorted(map(tuple, BM.indexed_range(index, r, lo, hi, epoch, closed).collect())) == want
    report = BM.index_report(index, r, lo, hi, epoch, closed).first()
    assert report["hits"] == len(want) and report["from_index"] <= len(want) <= report["from_index"] + report["checked"]
    assert report["blocks_checked"] <= report["blocks"] and report["checked"] <= report["block_records"]


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_an_index_is_built_once_in_few_batches(spark, monkeypatch, batch):
    """The same index however rows are batched, its bitmaps as ``encode`` makes them, and a report that builds it once."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        r = spark.createDataFrame(rows() + [(5, 0, 0, p, 3.0) for p in (*range(40), 90_000)], "epoch INT, rank INT, sst INT, pos BIGINT, key FLOAT")
        blocks = {}
        for e, k, s, p, key in rows() + [(5, 0, 0, p, 3.0) for p in (*range(40), 90_000)]:
            if key is not None and key == key:
                blocks.setdefault((e, k, s), []).append((p, np.searchsorted(np.array(EDGES, "f4"), np.float32(key), side="right")))
        want = {}
        for name, own in blocks.items():
            first = min(own)[0]
            for b in {b for _, b in own}:
                want[*name, b] = (first, BM.encode(np.array(sorted(p - first for p, x in own if x == b))))
        found = BM.build_index(r, EDGES).collect()
        assert {(x["epoch"], x["rank"], x["sst"], x["bin"]): (x["first"], bytes(x["bitmap"])) for x in found} == want and len(found) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    kept, keep = [], BM.keep
    monkeypatch.setattr(BM, "keep", lambda df, name: kept.append(name) or keep(df, name))
    BM.index_report(BM.build_index(r, EDGES), r, 1, 2).collect()
    assert kept == ["bitmaps"]


def test_whole_bins_need_no_record(spark):
    r = spark.createDataFrame(rows(), "epoch INT, rank INT, sst INT, pos BIGINT, key FLOAT")
    report = BM.index_report(BM.build_index(r, EDGES), r, 0.99999, 2.74999, None, "both").first()
    assert report["checked"] < report["block_records"] / 3 and report["from_index"] > report["hits"] / 2
    nothing = BM.index_report(BM.build_index(r.where("false"), EDGES), r, 1, 2)
    assert nothing.first().asDict() == dict.fromkeys(("hits", "from_index", "checked", "blocks_checked", "blocks", "block_records"), 0)
    with pytest.raises(ValueError):
        BM.build_index(r, (1.0, 1.0))


def test_files_of_epochs(spark):
    q = spark.createDataFrame([(1, 0), (2, 4), (3, 11)], "qid INT, epoch INT")
    assert [tuple(r) for r in BM.epoch_files(q).orderBy("qid").collect()] == [(1, 0, 0, 0, 2, 0), (2, 4, 1, 3, 5, 1), (3, 11, 3, 9, 11, 2)]
