"""Buffered tracer frames: what a rank's tracers do at several steps goes out as one file a species.

A rank keeps the frames of its last steps.  When it holds ``n_frames`` of them they are dumped, and the buffer starts
anew: a tumbling window by count, kept as state from one micro-batch to the next.  The state itself is the rank's restart
file, which is given out after each micro-batch, so a run can be taken up by another stream from its files alone.

A dump: variables, charge, mass, variables, frames, two ones, then tracers of each frame, its times, and the values of all
tracers frame by frame.  A restart file: species, frames, number of values, then tracers of each species and frame, times
(NaN: not yet filled), values of each species, and the values.  Numbers are of four bytes, the second one of eight.

A step of a rank comes in one micro-batch as a whole (it is one file).  Of a step that comes again nothing is taken.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import ship
from ..sources.blockfile import _open
from ..sources.dumps import files, step_of, suffix_of

_HEAD, _RESTART = "<iffiifd", "<iii"
#: What a buffer gives out: dumps (a step and species each) and restart files.
FILES = "kind STRING, rank INT, step BIGINT, species STRING, data BINARY"
_STATE = "step BIGINT, data BINARY"


@dataclass(frozen=True)
class Species:
    name: str
    charge: float
    mass: float


@dataclass
class Buffer:
    """One rank's frames under way."""

    species: tuple[Species, ...]
    n_values: int
    n_frames: int
    times: list[float] = field(default_factory=list)
    frames: list[list[np.ndarray]] = field(default_factory=list)  # by frame, then species

    def take(self, t: float, own: list[np.ndarray]) -> list[bytes] | None:
        """One step's values by species; the dumps where it fills the buffer."""
        self.times.append(t)
        self.frames.append([np.ascontiguousarray(v, "<f4").reshape(-1, self.n_values) for v in own])
        if len(self.times) < self.n_frames:
            return None
        out = []
        for k, s in enumerate(self.species):
            counts = np.array([len(f[k]) for f in self.frames], "<i4")
            head = struct.pack(_HEAD, self.n_values, s.charge, s.mass, self.n_values, self.n_frames, 1.0, 1.0)
            out.append(head + counts.tobytes() + np.array(self.times, "<f4").tobytes() + b"".join(f[k].tobytes() for f in self.frames))
        self.times, self.frames = [], []
        return out

    def restart(self) -> bytes:
        kinds, n = len(self.species), self.n_frames
        counts, times = np.zeros((kinds, n), "<i4"), np.full(n, np.nan, "<f4")
        times[: len(self.times)] = self.times
        for j, f in enumerate(self.frames):
            counts[:, j] = [len(v) for v in f]
        values = b"".join(f[k].tobytes() for k in range(kinds) for f in self.frames)
        return struct.pack(_RESTART, kinds, n, len(values) // 4) + counts.tobytes() + times.tobytes() + counts.sum(axis=1).astype("<i4").tobytes() + values

    @classmethod
    def restored(cls, data: bytes, species: tuple[Species, ...], n_values: int) -> Buffer:
        kinds, n, size = struct.unpack_from(_RESTART, data)
        if kinds != len(species):
            raise ValueError(f"a restart file of {kinds} species, not {len(species)}")
        at = struct.calcsize(_RESTART)
        counts = np.frombuffer(data, "<i4", kinds * n, at).reshape(kinds, n)
        times = np.frombuffer(data, "<f4", n, at + 4 * kinds * n)
        sums = np.frombuffer(data, "<i4", kinds, at + 4 * (kinds * n + n))
        at += 4 * (kinds * n + n + kinds)
        if counts.sum() * n_values != size or (counts.sum(axis=1) != sums).any() or len(data) != at + 4 * size:
            raise ValueError("a restart file whose counts don't fit its values")
        values, filled, own = np.frombuffer(data, "<f4", size, at).reshape(-1, n_values), int((~np.isnan(times)).sum()), []
        cuts = np.concatenate([[0], np.cumsum(counts)])
        for j in range(filled):
            own.append([values[cuts[k * n + j] : cuts[k * n + j + 1]] for k in range(kinds)])
        return cls(species, n_values, n, [float(t) for t in times[:filled]], own)


def _steps(rows: pd.DataFrame, species: tuple[Species, ...], columns: list[str]) -> Iterator[tuple[int, float, list[np.ndarray]]]:
    """(step, time, values by species) of a rank's rows, in order."""
    known = [s.name for s in species]
    if odd := set(rows["species"]) - set(known):
        raise ValueError(f"species that aren't among {known}: {sorted(map(str, odd))}")
    for step, own in rows.sort_values(["step", "species", "tag"], kind="stable").groupby("step", sort=True):
        yield int(step), float(own["t"].iloc[0]), [own.loc[own["species"] == n, columns].to_numpy("<f4") for n in known]


def _dumped(rank: int, step: int, species: tuple[Species, ...], made: list[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"kind": "dump", "rank": rank, "step": step, "species": [s.name for s in species], "data": made})


def buffer_frames(tracers: DataFrame, species: tuple[Species, ...], columns: tuple[str, ...], n_frames: int) -> DataFrame:
    """FILES of a stream of tracers (rank, step, t, species, tag, and value columns).

    A row with ``restored`` (BINARY, optional column: a restart file) and its step takes a rank up from there.
    """
    ship(tracers.sparkSession)
    names = list(columns)

    def work(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (rank,) = key
        rows = pd.concat(list(frames))
        last, data = state.get if state.exists else (-1, None)
        given = rows[rows["restored"].notna()]
        if data is None and len(given):
            first = given.sort_values("step").iloc[-1]
            last, data = int(first["step"]), bytes(first["restored"])
        b = Buffer.restored(bytes(data), species, len(names)) if data is not None else Buffer(species, len(names), n_frames)
        rows = rows[rows["restored"].isna() & (rows["step"] > last)]
        for step, t, own in _steps(rows, species, names):
            if made := b.take(t, own):
                yield _dumped(rank, step, species, made)
            last = step
        data = b.restart()
        state.update((last, data))
        yield pd.DataFrame({"kind": ["restart"], "rank": [rank], "step": [last], "species": [None], "data": [data]})

    restored = F.col("restored") if "restored" in tracers.columns else F.lit(None).cast("binary")
    own = tracers.select("rank", "step", "t", "species", "tag", *names, restored.alias("restored"))
    return own.groupBy("rank").applyInPandasWithState(work, FILES, _STATE, "append", GroupStateTimeout.NoTimeout)


def dump_frames(tracers: DataFrame, species: tuple[Species, ...], columns: tuple[str, ...], n_frames: int) -> DataFrame:
    """FILES of a table of whole ranks: all dumps, and each rank's restart file at the end.  A task holds one buffer and one step."""
    ship(tracers.sparkSession)
    names = list(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, b, held, last = None, None, [], -1

        def give(frame: pd.DataFrame) -> pa.RecordBatch:
            kinds = pa.schema([("kind", pa.string()), ("rank", pa.int32()), ("step", pa.int64()), ("species", pa.string()), ("data", pa.binary())])
            return pa.RecordBatch.from_pandas(frame, kinds, preserve_index=False)

        def step() -> Iterator[pa.RecordBatch]:
            if held:
                for at, t, own in _steps(pd.concat(held), species, names):
                    if made := b.take(t, own):
                        yield give(_dumped(rank, at, species, made))
                held.clear()

        def end() -> Iterator[pa.RecordBatch]:
            if b is not None:
                yield from step()
                yield give(pd.DataFrame({"kind": ["restart"], "rank": [rank], "step": [last], "species": [None], "data": [b.restart()]}))

        for batch in batches:
            for (r, s), own in batch.to_pandas().groupby(["rank", "step"], sort=False):
                if r != rank:
                    yield from end()
                    rank, b, last = int(r), Buffer(species, len(names), n_frames), -1
                if s != last:
                    yield from step()
                    last = int(s)
                held.append(own)
        yield from end()

    own = tracers.select("rank", "step", "t", "species", "tag", *names)
    return own.repartition("rank").sortWithinPartitions("rank", "step", "species", "tag").mapInArrow(work, FILES)


def write_files(made: DataFrame, path: str) -> None:
    """FILES as ``T.<step>/<species>_buffer.<rank>`` and ``restore/buffered_tracer.<rank>``; a file takes its name when it is whole."""
    ship(made.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(path)
        for b in batches:
            for kind, rank, step, name, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                folder = f"{root}/T.{step}" if kind == "dump" else f"{root}/restore"
                system.create_dir(folder, recursive=True)
                to = f"{folder}/{name}_buffer.{rank}" if kind == "dump" else f"{folder}/buffered_tracer.{rank}"
                with system.open_output_stream(f"{to}.draft") as f:
                    f.write(data)
                system.move(f"{to}.draft", to)
        yield from ()

    # The last restart file of a rank counts; dumps have one each.
    last = made.where("kind = 'restart'").groupBy("rank").agg(F.max_by(F.struct("step", "data"), "step").alias("m")).select(F.lit("restart").alias("kind"), "rank", "m.step", F.lit(None).cast("string").alias("species"), "m.data")
    made.where("kind = 'dump'").unionByName(last).mapInArrow(work, "rank INT").write.format("noop").mode("overwrite").save()


def read_dumps(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """step, rank, species, frame (from 0), t and values of every tracer of the dumps below a folder."""
    names = list(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for step, rank, species, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n_values, _, _, again, n, one, also = struct.unpack_from(_HEAD, raw)
                if (one, also) != (1.0, 1.0) or n_values != again:
                    raise ValueError(f"{species}_buffer.{rank}: mangled header")
                if n_values != len(names):
                    raise ValueError(f"{species}_buffer.{rank}: {n_values} variables, not {len(names)}")
                counts = np.frombuffer(raw, "<i4", n, struct.calcsize(_HEAD))
                times = np.frombuffer(raw, "<f4", n, struct.calcsize(_HEAD) + 4 * n)
                values = np.frombuffer(raw, "<f4", -1, struct.calcsize(_HEAD) + 8 * n).reshape(-1, n_values)
                if len(values) != counts.sum():
                    raise ValueError(f"{species}_buffer.{rank}: {len(values)} tracers, not {counts.sum()}")
                m, frame = len(values), np.repeat(np.arange(n, dtype=np.int32), counts)
                cols = [pa.array(np.full(m, step)), pa.array(np.full(m, rank, np.int32)), pa.array([species] * m, pa.string()), pa.array(frame), pa.array(times[frame])]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(np.ascontiguousarray(values[:, k])) for k in range(n_values)]], names=["step", "rank", "species", "frame", "t", *names])

    found = files(spark, path, "*_buffer.*").select(
        step_of(F.col("path")).cast("bigint").alias("step"), suffix_of(F.col("path")).alias("rank"), F.regexp_extract("path", r"([^/]*)_buffer\.\d+$", 1).alias("species"), "content"
    )
    return found.mapInArrow(work, "step BIGINT, rank INT, species STRING, frame INT, t FLOAT, " + ", ".join(f"`{c}` FLOAT" for c in names))


def read_restarts(spark: SparkSession, path: str) -> DataFrame:
    """rank and restored (the file's bytes) of the restart files below a folder."""
    found = files(spark, path, "buffered_tracer.*")
    return found.select(suffix_of(F.col("path")).alias("rank"), F.col("content").alias("restored"))
