"""Readers of simulation dumps: particles, raw traces, fields and fluid cells, tracers.

Files are read whole by Spark's binary source, from any file system it knows, and decoded by numpy
in Arrow batches; the file's name gives step and rank.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.physics import kinetic_energy
from ..runtime import ship
from ..schemas import FIELD, HYDRO, PARTICLE

#: Fixed values of the dump format: byte-order boilerplate, its marks, and the header after it.
BOILERPLATE = struct.Struct("<5shifd")
MARKS = (np.int16(-13570), np.int32(-559038737), 1.0, 1.0)
HEADER = struct.Struct("<iii3i4f3f3f2iif")
PARTICLE_ROW = np.dtype([("dx", "<f4"), ("dy", "<f4"), ("dz", "<f4"), ("cell", "<i4"), ("ux", "<f4"), ("uy", "<f4"), ("uz", "<f4"), ("w", "<f4"), ("tag1", "<i8"), ("tag2", "<i8")])
FIELD_VARIABLES = ("ex", "ey", "ez", "bx", "by", "bz")
HYDRO_VARIABLES = ("jx", "jy", "jz", "rho", "px", "py", "pz", "ke", "txx", "tyy", "tzz", "tyz", "tzx", "txy")
TRACER_BASE = ("x", "y", "z", "ux", "uy", "uz")
TRACER_EXTRA = ("ex", "ey", "ez", "bx", "by", "bz")


def read_header(raw: bytes, name: str = "") -> tuple[dict, int]:
    """(step, rank, nproc; where the header ends)."""
    _, cafe, beef, one, one_too = BOILERPLATE.unpack_from(raw)
    if (np.int16(cafe), np.int32(beef), one, one_too) != MARKS:
        raise ValueError(f"{name}: not a dump of this byte order")
    h = HEADER.unpack_from(raw, BOILERPLATE.size)
    return {"step": h[2], "rank": h[16], "nproc": h[17]}, BOILERPLATE.size + HEADER.size


def read_array_header(raw: bytes, at: int) -> tuple[int, tuple[int, ...], int]:
    """(element size, dimensions, where the array begins)."""
    size, n = struct.unpack_from("<ii", raw, at)
    return size, struct.unpack_from(f"<{n}i", raw, at + 8), at + 8 + 4 * n


def write_header(step: int, rank: int, nproc: int, element: int, dims: tuple[int, ...]) -> bytes:
    head = BOILERPLATE.pack(bytes((8, 2, 4, 4, 8)), *map(lambda x: x.item() if hasattr(x, "item") else x, MARKS))
    return head + HEADER.pack(0, 0, step, *[0] * 3, *[0.0] * 4, *[0.0] * 3, *[0.0] * 3, rank, nproc, 0, 0.0) + struct.pack(f"<ii{len(dims)}i", element, len(dims), *dims)


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path and content of the files of a directory tree."""
    ship(spark)
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "content")


def step_of(path: F.Column) -> F.Column:
    """The step in a path's T.<n>; null without one."""
    return F.nullif(F.regexp_extract(path, r"T\.(\d+)", 1), F.lit("")).cast("int")


def suffix_of(path: F.Column) -> F.Column:
    """The number after the last dot of a file's name."""
    return F.nullif(F.regexp_extract(path, r"\.(\d+)$", 1), F.lit("")).cast("int")


def timesteps(paths: DataFrame) -> DataFrame:
    """step, epoch of the T.<n> folders that occur in ``path``: numbered from 0 in numeric order."""
    steps = paths.select(step_of(F.col("path")).alias("step")).where("step is not null").distinct()
    return steps.withColumn("epoch", (F.dense_rank().over(Window.orderBy("step")) - 1).cast("int"))  # as many rows as steps


def particles(spark: SparkSession, path: str, glob: str = "*particle.*") -> DataFrame:
    """Particle dumps as rows of PARTICLE."""

    def work(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head, at = read_header(raw, name)
                size, dims, at = read_array_header(raw, at)
                if size != PARTICLE_ROW.itemsize or len(raw) - at < size * dims[0]:
                    raise ValueError(f"{name}: {dims[0]} particles of {size} bytes don't fit")
                p = np.frombuffer(raw, PARTICLE_ROW, dims[0], at)
                for k in range(0, len(p), 1 << 16):
                    q = p[k : k + (1 << 16)]
                    n = len(q)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, head["step"], np.int32)), pa.array(np.full(n, head["rank"], np.int32)), *[pa.array(np.ascontiguousarray(q[c])) for c in PARTICLE_ROW.names]], names=PARTICLE.names)

    return files(spark, path, glob).mapInArrow(work, PARTICLE)


def energies(particles_: DataFrame) -> DataFrame:
    """The compressed trace: t, rank, key (kinetic energy as a 32-bit float)."""
    return particles_.select("t", "rank", kinetic_energy(F.col("ux"), F.col("uy"), F.col("uz")).alias("key"))


def raw_trace(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """rank (the file's suffix), step, pos and key of files that are nothing but 32-bit floats."""

    def work(batches):
        for b in batches:
            for rank, step, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                keys = np.frombuffer(raw, "<f4", len(raw) // 4)
                for k in range(0, len(keys), 1 << 16):
                    q = keys[k : k + (1 << 16)]
                    n = len(q)
                    yield pa.RecordBatch.from_arrays([pa.array([rank] * n, pa.int32()), pa.array([step] * n, pa.int32()), pa.array(np.arange(k + 1, k + n + 1)), pa.array(q)], names=["rank", "step", "pos", "key"])

    return files(spark, path, glob).select(suffix_of(F.col("path")).alias("rank"), step_of(F.col("path")).alias("step"), "content").mapInArrow(work, "rank int, step int, pos bigint, key float")


def _grid(spark: SparkSession, path: str, glob: str, variables: tuple[str, ...], topology: tuple[int, int, int], schema, species: str | None) -> DataFrame:
    """Sub-domains without their ghost cells, placed in the global grid; cells are counted from 0."""
    nx, ny, _ = topology

    def work(batches):
        for b in batches:
            for name, step, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                head, at = read_header(raw, name)
                _, dims, at = read_array_header(raw, at)
                cells = int(np.prod(dims))
                data = [np.frombuffer(raw, "<f4", cells, at + 4 * cells * i).reshape(dims, order="F")[1:-1, 1:-1, 1:-1] for i in range(len(variables))]
                inner = data[0].shape
                r = head["rank"]
                first = [i * n for i, n in zip((r % nx, r // nx % ny, r // nx // ny), inner, strict=True)]
                n = int(np.prod(inner))
                index = np.unravel_index(np.arange(n), inner, order="F")
                cols = [np.full(n, head["step"] if step is None else step, np.int32), *[(i + f).astype(np.int32) for i, f in zip(index, first, strict=True)]]
                arrays = [pa.array(c) for c in cols] + [pa.array(d.ravel(order="F")) for d in data]
                if species:
                    arrays.insert(1, pa.array([species] * n))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return files(spark, path, glob).select("path", step_of(F.col("path")).alias("step"), "content").mapInArrow(work, schema)


def fields(spark: SparkSession, path: str, topology: tuple[int, int, int], glob: str = "fields.*") -> DataFrame:
    """Electric and magnetic fields as rows of FIELD."""
    return _grid(spark, path, glob, FIELD_VARIABLES, topology, FIELD, None)


def hydro(spark: SparkSession, path: str, topology: tuple[int, int, int], species: str, glob: str) -> DataFrame:
    """Fluid quantities of one species as rows of HYDRO."""
    return _grid(spark, path, glob, HYDRO_VARIABLES, topology, HYDRO, species)


def read_info(raw: bytes) -> tuple[float, ...]:
    """The eleven doubles of a run's info file."""
    return struct.unpack("<11d", raw[:88])


def read_namelist(text: str) -> dict[str, int | float | str]:
    """name = value pairs of a namelist; comments and group marks are skipped."""
    out: dict[str, int | float | str] = {}
    for line in text.split("\n"):
        line = line.split("!")[0].strip().rstrip(",")
        if "=" not in line:
            continue
        name, value = (p.strip() for p in line.split("=", 1))
        for kind in (int, float):
            try:
                out[name.lower()] = kind(value.lower().replace("d", "e") if kind is float else value)
                break
            except ValueError:
                continue
        else:
            out[name.lower()] = value.strip("'\"")
    return out


def tracer_schema(extra: tuple[str, ...] = ()) -> str:
    return "t double, species string, tag int, " + ", ".join(f"{c} float" for c in (*TRACER_BASE, *extra))


def tracers(spark: SparkSession, path: str, extra: tuple[str, ...] = (), header: str = "snapshot", glob: str | None = None) -> DataFrame:
    """Tracer snapshots as rows of TRACER (base columns and ``extra``); the file's name begins with the species.

    ``header``: "snapshot" is count, variables, charge, mass, time and two ones; "merged" is count,
    charge over mass, time and two ones.  Other ones than 1.0 are an error.
    """
    head = "<iiffdfd" if header == "snapshot" else "<ifdfd"
    names = ("tag", *TRACER_BASE, *extra)

    def work(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = struct.unpack_from(head, raw)
                if h[-2:] != (1.0, 1.0):
                    raise ValueError(f"{name}: mangled header {h[-2:]}")
                if header == "snapshot" and h[1] != len(names):
                    raise ValueError(f"{name}: {h[1]} variables, not {len(names)}")
                data = np.frombuffer(raw, "<f4", h[0] * len(names), struct.calcsize(head)).reshape(-1, len(names))
                n, species = len(data), name.rsplit("/", 1)[-1].split(".")[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h[-3])), pa.array([species] * n, pa.string()), pa.array(data[:, 0].astype(np.int32)), *[pa.array(np.ascontiguousarray(data[:, i])) for i in range(1, len(names))]], names=["t", "species", *names])

    return files(spark, path, glob).mapInArrow(work, tracer_schema(extra))
