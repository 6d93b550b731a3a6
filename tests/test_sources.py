"""Block files, dumps, text sources, sinks and the stream: written here, read back."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangelake.functions import physics as P
from rangelake.operators import manifest as M
from rangelake.schemas import RECORD
from rangelake.sources import blockfile as B
from rangelake.sources import dumps as D
from rangelake.sources import sinks as K
from rangelake.sources import text as X
from rangelake.streaming import ingest as S


@pytest.fixture
def blocks(spark, tmp_path):
    """Two ranks, two epochs, blocks of several sizes, one with a single key; a file behind a gap."""
    B.register(spark)
    rng, rows = np.random.default_rng(5), []
    for rank in (0, 1, 3):
        epochs = {}
        for epoch in (0, 1):
            own, pos = [], 1
            for sst, n in enumerate((5, 1, 7)):
                keys = rng.uniform(10 * sst, 10 * sst + 10, n).astype("<f4")
                values = rng.integers(0, 256, (n, 6), dtype=np.uint8)
                own.append((keys, values))
                if rank < 3:
                    rows += [(epoch, rank, sst, pos + i, float(keys[i]), values[i].tobytes()) for i in range(n)]
                pos += n
            epochs[epoch] = own
        B.write_file(str(tmp_path / "in"), rank, epochs, 6)
    return str(tmp_path / "in"), rows


def test_records_come_back(spark, blocks):
    path, rows = blocks
    got = spark.read.format("rdb").load(path)
    assert sorted((*r[:5], bytes(r[5])) for r in got.collect()) == sorted(rows)


def test_keys_point_at_their_values(spark, blocks):
    path, rows = blocks
    want = {r[:4]: r[5] for r in rows}
    for r in spark.read.format("rdb_keys").load(path).collect():
        with open(f"{path}/{B.file_name(r['rank'])}", "rb") as f:
            f.seek(r["value_offset"])
            assert f.read(6) == want[r["epoch"], r["rank"], r["sst"], r["pos"]]


def test_manifest_matches_records(spark, blocks):
    path, _ = blocks
    m = spark.read.format("rdb_manifest").load(path)
    assert M.kv_sizes(m) == (4, 6)
    built = M.build_manifest(spark.read.format("rdb_keys").load(path), kv_size=10)
    cols = ["epoch", "rank", "sst", "obs_min", "obs_max", "item_count"]
    assert sorted(map(tuple, m.select(cols).collect())) == sorted(map(tuple, built.select(cols).collect()))


def test_pushed_filters_choose_blocks(blocks):
    path, _ = blocks
    reader = B._Reader({"path": path}, values=False)
    list(reader.pushFilters([B.EqualTo(("epoch",), 1), B.EqualTo(("rank",), 1), B.GreaterThanOrEqual(("key",), 12.0), B.LessThan(("key",), 19.0)]))
    assert [(p.rank, [(b[0], b[1]) for b in p.blocks]) for p in reader.partitions()] == [(1, [(1, 1)])]


def test_filtered_query(spark, blocks):
    path, rows = blocks
    got = spark.read.format("rdb").load(path).where("epoch = 0 AND key BETWEEN 5 AND 15").select("rank", "key").collect()
    assert sorted(map(tuple, got)) == sorted((r[1], r[4]) for r in rows if r[0] == 0 and 5 <= r[4] <= 15)
    assert spark.read.format("rdb").load(path).where("rank IN (1, 7) AND epoch > 0").count() == 13


def test_long_manifest_needs_a_second_read(spark, tmp_path):
    B.register(spark)
    own = [(np.array([k], "<f4"), np.zeros((1, 2), np.uint8)) for k in range(300)]
    B.write_file(str(tmp_path / "x"), 0, {0: own}, 2)
    assert spark.read.format("rdb_manifest").load(str(tmp_path / "x")).count() == 300
    assert spark.read.format("rdb").load(str(tmp_path / "x")).agg(F.sum("key")).first()[0] == 299 * 150


def test_bad_files(spark, tmp_path):
    B.register(spark)
    one = {0: [(np.array([1], "<f4"), np.zeros((1, 2), np.uint8))]}
    B.write_file(str(tmp_path / "a"), 0, one, 2)
    B.write_file(str(tmp_path / "a"), 1, {0: [(np.array([1], "<f4"), np.zeros((1, 3), np.uint8))]}, 3)
    with pytest.raises(Exception, match="sizes differ"):
        spark.read.format("rdb").load(str(tmp_path / "a")).count()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / B.file_name(0)).write_bytes(b"short")
    with pytest.raises(Exception, match="no footer"):
        spark.read.format("rdb_manifest").load(str(tmp_path / "b")).count()
    (tmp_path / "c").mkdir()
    assert spark.read.format("rdb").load(str(tmp_path / "c")).count() == 0


def particle_file(path, step, rank, n, rng):
    p = np.zeros(n, D.PARTICLE_ROW)
    for c in ("ux", "uy", "uz"):
        p[c] = rng.normal(size=n)
    p["tag1"] = np.arange(n)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(D.write_header(step, rank, 2, 48, (n,)) + p.tobytes())
    return p


def test_particles_and_energies(spark, tmp_path):
    rng = np.random.default_rng(7)
    ps = {r: particle_file(tmp_path / "particle" / "T.200" / f"eparticle.200.{r}", 200, r, 20 + r, rng) for r in (0, 1)}
    assert len(D.write_header(0, 0, 1, 48, (1,))) == 103 + 12
    got = D.particles(spark, str(tmp_path / "particle"))
    assert got.count() == 41
    e = {(r["rank"], r["key"]) for r in D.energies(got).collect()}
    want = {(r, float(np.float32(np.sqrt(1 + sum(p[c].astype(float) ** 2 for c in ("ux", "uy", "uz"))) - 1)[i])) for r, p in ps.items() for i in range(len(p))}
    assert e == want
    (tmp_path / "particle" / "T.200" / "eparticle.200.9").write_bytes(b"\0" * 200)
    with pytest.raises(Exception, match="byte order"):
        D.particles(spark, str(tmp_path / "particle")).count()


def test_raw_trace_and_timesteps(spark, tmp_path):
    for step, rank in ((0, 0), (200, 0), (1000, 0), (200, 1)):
        f = tmp_path / f"T.{step}" / f"energies.{rank}"
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(np.arange(step + rank, step + rank + 3, dtype="<f4").tobytes())
    t = D.raw_trace(spark, str(tmp_path))
    assert t.count() == 12 and t.where("step = 200 AND rank = 1").agg(F.max("key")).first()[0] == 203
    steps = D.timesteps(D.files(spark, str(tmp_path)))
    assert {r["step"]: r["epoch"] for r in steps.collect()} == {0: 0, 200: 1, 1000: 2}


def test_fields_lose_their_ghost_cells(spark, tmp_path):
    for rank in (0, 1):
        inner = np.arange(8, dtype="<f4").reshape(2, 2, 2) + 100 * rank
        data = b"".join(np.pad(inner + 1000 * v, 1).astype("<f4").tobytes(order="F") for v in range(6))
        f = tmp_path / "T.5" / f"fields.5.{rank}"
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(D.write_header(5, rank, 2, 4, (4, 4, 4)) + data)
    got = {(r["ix"], r["iy"], r["iz"]): (r["ex"], r["bz"]) for r in D.fields(spark, str(tmp_path), (2, 1, 1)).collect()}
    assert len(got) == 16 and got[1, 0, 1] == (5.0, 5005.0) and got[3, 1, 0] == (106.0, 5106.0)


def test_tracers(spark, tmp_path):
    rows = np.array([[1, *range(6)], [0, *range(6, 12)]], "<f4")
    (tmp_path / "electron.3").write_bytes(struct.pack("<iiffdfd", 2, 7, -1, 1, 2.5, 1.0, 1.0) + rows.tobytes())
    got = D.tracers(spark, str(tmp_path), glob="electron.*").collect()
    assert [(r["t"], r["species"], r["tag"], r["uz"]) for r in got] == [(2.5, "electron", 1, 5.0), (2.5, "electron", 0, 11.0)]
    (tmp_path / "ion.0").write_bytes(struct.pack("<ifdfd", 0, 1, 2.5, 1.0, 2.0))
    with pytest.raises(Exception, match="mangled"):
        D.tracers(spark, str(tmp_path), header="merged", glob="ion.*").count()


def test_configuration_files():
    assert D.read_info(struct.pack("<11d", *range(11)))[10] == 10
    assert D.read_namelist("&datum\n a = 3, ! comment\n b = 1.5d0\n name = 'x'\n/") == {"a": 3, "b": 1.5, "name": "x"}


def test_text_sources(spark, tmp_path):
    (tmp_path / "q.csv").write_text("2,0.30124,0.30204\n2,0.5,0.75\n0,1,1\n")
    q = X.query_batch(spark, str(tmp_path / "q.csv")).orderBy("qid").collect()
    assert [(r["qid"], r["epoch"]) for r in q] == [(0, 2), (1, 2), (2, 0)] and q[0]["qbegin"] == float(np.float32(0.30124))
    (tmp_path / "bad.csv").write_text("2,0.3,x\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        X.query_batch(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "inv.csv").write_text("2,0.5,0.3\n")
    with pytest.raises(Exception, match="above its end"):
        X.query_batch(spark, str(tmp_path / "inv.csv")).collect()
    (tmp_path / "mock.3.7").write_text("0.5 1.5 9 100 4\n")
    assert X.mock_manifest(spark, str(tmp_path / "mock.*")).first()[:] == (3, 7, 0.5, 1.5, 100, 4)
    (tmp_path / "zipf").write_text("13\n7\n\n99\n")
    assert [r["i"] for r in X.index_list(spark, str(tmp_path / "zipf")).orderBy("n").collect()] == [13, 7, 99]


def test_text_manifest_round_trip(spark, tmp_path, blocks):
    m = spark.read.format("rdb_manifest").load(blocks[0])
    K.write_text_manifest(m, str(tmp_path / "out"))
    (tmp_path / "flat").mkdir()
    for f in (tmp_path / "out").rglob("part-*.csv"):
        (tmp_path / "flat" / f"manifest.{f.parent.name.split('=')[1]}").write_bytes(f.read_bytes())
    back = X.text_manifest(spark, str(tmp_path / "flat"))
    cols = ["epoch", "rank", "sst", "offset", "item_count"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, m.select(cols).collect()))


def test_stream_takes_each_step_once(spark, tmp_path):
    src, rec, man, ck = (str(tmp_path / n) for n in ("in", "rec", "man", "ck"))
    make = lambda e, n: spark.createDataFrame([(e, 0, 0, i + 1, float(i), b"v") for i in range(n)], S.RECORD).coalesce(1).write.mode("append").parquet(src)
    run = lambda: S.ingest(S.read_steps(spark, src), rec, man, ck).awaitTermination(120)
    make(0, 5)
    run()
    run()
    assert spark.read.parquet(rec).count() == 5
    make(1, 3)
    run()
    assert {r["epoch"]: r["mass"] for r in M.epoch_stats(spark.read.parquet(man)).collect()} == {0: 5, 1: 3}


def test_frames_and_bounds(spark):
    t = spark.createDataFrame([(s, s % 2, "e") for s in range(10)], "step INT, tag INT, species STRING")
    assert [tuple(r) for r in S.frame_summary(t, 4).orderBy("frame").collect()] == [(0, "e", 4, 2, 4), (1, "e", 4, 2, 4), (2, "e", 2, 2, 2)]
    b = spark.createDataFrame([(0.5,), (1.5,), (9.0,)], "key FLOAT")
    assert S.out_of_bounds(b, 1, 2).first()[:] == (1, 1, 1)
    r = S.arrival_blocks(spark.createDataFrame([(0, 0, i, float(i)) for i in range(5)], "epoch INT, rank INT, arrival INT, key FLOAT"), 2)
    assert [x["sst"] for x in r.orderBy("pos").collect()] == [0, 0, 1, 1, 2]


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 0, 0, 2.0, 3.0), (0, 0, 0, 0, 1.0, 4.0)], "t INT, ix INT, iy INT, iz INT, ex DOUBLE, ey DOUBLE")
    K.write_bricks(cells, str(tmp_path / "gda"), ["ex", "ey"])
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "gda")).where("var = 'ex'").orderBy("ix").collect()] == [1.0, 2.0]
    tr = spark.createDataFrame([(1.0, "e", 0), (2.0, "e", 7), (1.0, "e", 7)], "t DOUBLE, species STRING, tag INT")
    K.write_trajectories(tr, str(tmp_path / "traj"))
    assert spark.read.parquet(str(tmp_path / "traj")).count() == 2
    plan = spark.createDataFrame([(1, 0.25, 0.5)], "epoch INT, lo FLOAT, hi FLOAT")
    K.write_query_plan(plan, str(tmp_path / "plan"))
    assert X.query_batch(spark, str(tmp_path / "plan")).first()[1:4] == (1, 0.25, 0.5)


def test_trilinear_velocity_is_exact_on_linear_fields(spark):
    nodes = spark.createDataFrame([(0, x, y, z, float(x), float(2 * y), float(x + z)) for x in range(3) for y in range(3) for z in range(3)], "t INT, ix INT, iy INT, iz INT, vx DOUBLE, vy DOUBLE, vz DOUBLE")
    tr = spark.createDataFrame([(1, 0, 1, 0, 1, 0.5, -0.5, 0.0)], "id INT, t INT, ix INT, iy INT, iz INT, dx DOUBLE, dy DOUBLE, dz DOUBLE")
    assert P.velocity_at(tr, nodes).first()[2:] == pytest.approx((1.75, 0.5, 3.25))


def test_positions_and_fields_at_tracers(spark):
    d = spark.createDataFrame([(3, 0.25)], "i INT, dx DOUBLE")
    x = P.to_global(F.col("i"), F.col("dx"), 2.0, 1.0)
    back = P.to_local(x, 2.0, 1.0)
    assert d.select(*back).first()[:] == (3, 0.25)
    coeffs = "ex0 dexdy dexdz d2exdydz ey0 deydz deydx d2eydzdx ez0 dezdx dezdy d2ezdxdy cbx dcbxdx cby dcbydy cbz dcbzdz".split()
    cell = spark.createDataFrame([(0, 5, *[float(k) for k in range(18)])], "t INT, ii INT, " + ", ".join(f"{c} DOUBLE" for c in coeffs))
    tr = spark.createDataFrame([(0, 5, 0.5, -1.0, 2.0)], "t INT, ii INT, dx DOUBLE, dy DOUBLE, dz DOUBLE")
    r = P.fields_at(tr, cell).first()
    assert (r["ex"], r["bx"], r["bz"]) == (0 - 1 * 1 + 2 * (2 - 1 * 3), 12 + 0.5 * 13, 16 + 2 * 17)


def test_random_payload_is_seeded(spark):
    a = P.random_payload(spark.range(10, numPartitions=2), 3).collect()
    assert a == P.random_payload(spark.range(10, numPartitions=2), 3).collect() and all(0 <= r["pi"] < 689 for r in a)


def test_write_blocks_from_records(spark, tmp_path):
    rows = [(e, r, s, 4 * s + k + 1, float(10 * e + k), bytes([e, r, k])) for e in (0, 3) for r in (0, 1) for s in (0, 1) for k in range(4)]
    odd = [(0, 0, 0, 9, None, b"abc"), (0, 0, 0, 10, float("nan"), b"abc")]
    records = spark.createDataFrame(rows + odd, RECORD)
    B.write_blocks(records.repartition(5), str(tmp_path / "x"), 3)
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == [B.file_name(0), B.file_name(1)]
    B.register(spark)
    assert sorted(map(tuple, spark.read.format("rdb").load(str(tmp_path / "x")).collect())) == sorted(rows)
    assert {r["item_count"] for r in spark.read.format("rdb_manifest").load(str(tmp_path / "x")).collect()} == {4}
    B.write_blocks(records.where("epoch > 9"), str(tmp_path / "none"), 3)
    assert spark.read.format("rdb").load(str(tmp_path / "none")).count() == 0
