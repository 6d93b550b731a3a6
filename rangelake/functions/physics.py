"""Particle and fluid quantities as column expressions and joins on cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Fixed value: the bits of a tracer's number within its rank.
TAG_BITS = 19


def kinetic_energy(ux: Column, uy: Column, uz: Column) -> Column:
    """sqrt(1 + u.u) - 1 in double precision, kept as a 32-bit float."""
    d = [c.cast("double") for c in (ux, uy, uz)]
    return (F.sqrt(F.lit(1.0) + d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) - 1).cast("float")


def _tensor(density: Column, mass: float, v: dict[str, Column], u: dict[str, Column]) -> dict[str, Column]:
    """Pressure p_ij = T_ij - mass * density * v_i * u_j; the stress is symmetric, the pressure needn't be."""
    stress = {"xx": "txx", "yy": "tyy", "zz": "tzz", "xy": "txy", "yx": "txy", "xz": "tzx", "zx": "tzx", "yz": "tyz", "zy": "tyz"}
    return {f"p{ij}": F.col(t) - mass * density * v[ij[0]] * u[ij[1]] for ij, t in stress.items()}


def _where_dense(density: Column, columns: dict[str, Column]) -> list[Column]:
    return [F.when(F.abs(density) > 0, c).otherwise(0.0).alias(n) for n, c in columns.items()]


def ion_moments(hydro: DataFrame, mass: float, keys: tuple[str, ...] = ("t", "ix", "iy", "iz")) -> DataFrame:
    """n, v = j / n, u = p / n / mass and the pressure tensor of ion cells; zero where there is no density."""
    n = F.col("rho")
    v = {a: F.col(f"j{a}") / n for a in AXES}
    u = {a: F.col(f"p{a}") / n / mass for a in AXES}
    return hydro.select(*keys, n.alias("n"), *_where_dense(n, {f"v{a}": v[a] for a in AXES} | {f"u{a}": u[a] for a in AXES} | _tensor(n, mass, v, u)))


def electron_moments(hydro: DataFrame, keys: tuple[str, ...] = ("t", "ix", "iy", "iz")) -> DataFrame:
    """n = |rho|, v = -j / n, u = p / n and the pressure tensor of electron cells; zero where there is no density."""
    n = F.abs("rho")
    v = {a: -F.col(f"j{a}") / n for a in AXES}
    u = {a: F.col(f"p{a}") / n for a in AXES}
    return hydro.select(*keys, n.alias("n"), *_where_dense(n, {f"v{a}": v[a] for a in AXES} | {f"u{a}": u[a] for a in AXES} | _tensor(n, 1.0, v, u)))


def magnitude(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def total_current(ions: DataFrame, electrons: DataFrame, keys: tuple[str, ...] = ("t", "ix", "iy", "iz")) -> DataFrame:
    """jx, jy, jz, jmag of both species' cells (raw hydro), joined on the cell."""
    e = electrons.select(*keys, *[F.col(f"j{a}").alias(f"_{a}") for a in AXES])
    j = ions.join(e, list(keys)).select(*keys, *[(F.col(f"j{a}") + F.col(f"_{a}")).alias(f"j{a}") for a in AXES])
    return j.withColumn("jmag", magnitude(*[F.col(f"j{a}") for a in AXES]))


def with_field_magnitude(fields: DataFrame) -> DataFrame:
    return fields.withColumn("bmag", magnitude(F.col("bx"), F.col("by"), F.col("bz")))


def bulk_velocity(ions: DataFrame, electrons: DataFrame, keys: tuple[str, ...] = ("t", "ix", "iy", "iz")) -> DataFrame:
    """(n_e v_e + n_i v_i) / (n_i + n_e) from both species' moments; null where there are no electrons."""
    e = electrons.select(*keys, F.col("n").alias("_n"), *[F.col(f"v{a}").alias(f"_{a}") for a in AXES])
    mean = lambda a: (F.col(f"_{a}") * F.col("_n") + F.col(f"v{a}") * F.col("n")) / (F.col("n") + F.col("_n"))
    return ions.join(e, list(keys)).select(*keys, *[F.when(F.col("_n") > 0, mean(a)).alias(f"v{a}") for a in AXES])


def mass_velocity(ions: DataFrame, electrons: DataFrame, mass: float, keys: tuple[str, ...] = ("t", "ix", "iy", "iz")) -> DataFrame:
    """Velocity of both species weighted by mass, from raw hydro (electrons of charge -1, ions of +1)."""
    e = electrons.select(*keys, F.abs("rho").alias("_n"), *[F.col(f"j{a}").alias(f"_{a}") for a in AXES])
    met = ions.join(e, list(keys))
    total = F.col("_n") + F.col("rho") * mass
    return met.select(*keys, *[((F.col(f"j{a}") * mass - F.col(f"_{a}")) / total).alias(f"v{a}") for a in AXES])


def rank_to_index(rank: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    """(ix, iy, iz) of a rank in a grid of nx by ny by any."""
    rest = F.floor(rank / nx)
    return (F.pmod(rank, F.lit(nx)).cast("int"), F.pmod(rest, F.lit(ny)).cast("int"), F.floor(rest / ny).cast("int"))


def index_to_rank(ix: Column, iy: Column, iz: Column, nx: int, ny: int, nz: int) -> Column:
    """The rank (from 0) of grid indexes, taken around the ends."""
    return (F.pmod(ix, F.lit(nx)) + nx * (F.pmod(iy, F.lit(ny)) + ny * F.pmod(iz, F.lit(nz)))).cast("int")


def next_slice(steps: DataFrame, within: int) -> DataFrame:
    """step, next: the next existing step of each, if it is at most ``within`` steps on; step 0 reads step 1 where it is there."""
    a, b = steps.select("step"), steps.select(F.col("step").alias("_s"))
    near = a.join(b, (F.col("_s") > F.col("step")) & (F.col("_s") <= F.col("step") + within), "left").groupBy("step").agg(F.min("_s").alias("next"))
    one = steps.where("step = 1").limit(1).select(F.lit(True).alias("_one"))
    return near.join(F.broadcast(one), F.lit(True), "left").select("step", "next", F.when((F.col("step") == 0) & F.col("_one"), 1).otherwise(F.col("step")).cast("int").alias("reads"))


def fields_at(tracers: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("t", "ii")) -> DataFrame:
    """E and B at tracers (keys, dx, dy, dz in -1..1) from the cells' interpolation coefficients."""
    c, x, y, z = F.col, F.col("dx"), F.col("dy"), F.col("dz")
    return tracers.join(cells, list(keys)).select(
        *tracers.columns,
        (c("ex0") + y * c("dexdy") + z * (c("dexdz") + y * c("d2exdydz"))).alias("ex"),
        (c("ey0") + z * c("deydz") + x * (c("deydx") + z * c("d2eydzdx"))).alias("ey"),
        (c("ez0") + x * c("dezdx") + y * (c("dezdy") + x * c("d2ezdxdy"))).alias("ez"),
        (c("cbx") + x * c("dcbxdx")).alias("bx"), (c("cby") + y * c("dcbydy")).alias("by"), (c("cbz") + z * c("dcbzdz")).alias("bz"),
    )


def velocity_at(tracers: DataFrame, nodes: DataFrame, volume_weight: float = 0.125, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """Bulk velocity at tracers (id, t, ix, iy, iz, dx, dy, dz) by trilinear weights of the eight nodes around them.

    Eight rows per tracer meet the nodes in one equi-join; no window, no loop.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (0, 1) for j in (0, 1) for k in (0, 1)])).alias("o")
    side = lambda d, o: F.when(F.col(f"o.{o}") == 1, 1 + F.col(d)).otherwise(1 - F.col(d))
    around = tracers.select("id", *keys, "ix", "iy", "iz", "dx", "dy", "dz", corner)
    around = around.select("id", *keys, *[(F.col(f"i{a}") + F.col(f"o.{o}")).alias(f"i{a}") for a, o in zip(AXES, "ijk", strict=True)], (volume_weight * side("dx", "i") * side("dy", "j") * side("dz", "k")).alias("w"))
    met = around.join(nodes.select(*keys, "ix", "iy", "iz", "vx", "vy", "vz"), [*keys, "ix", "iy", "iz"])
    return met.groupBy("id", *keys).agg(*[F.sum(F.col("w") * F.col(f"v{a}")).alias(f"v{a}") for a in AXES])


def voxel_index(ii: Column, nx2: int, ny2: int) -> tuple[Column, Column, Column]:
    """(ix, iy, iz) of a cell number in a grid with ghost cells (nx2 by ny2 in the first two directions)."""
    return rank_to_index(ii, nx2, ny2)


def to_global(index: Column, offset: Column, cell: float, origin: float) -> Column:
    """Coordinate of an offset (-1..1) in a cell (counted with its ghost cell)."""
    return (index + (offset - 1) * 0.5) * cell + origin


def to_local(x: Column, cell: float, origin: float) -> tuple[Column, Column]:
    """(cell index, offset) of a coordinate: the inverse of ``to_global``."""
    at = (x - origin) / cell
    index = F.floor(at) + 1
    return index.cast("int"), (at - F.floor(at)) * 2 - 1


def tracer_tag(rank: Column, i: Column) -> Column:
    """A tracer's tag: its rank above the low bits of its number."""
    return F.shiftleft(rank, TAG_BITS).bitwiseOR(i.bitwiseAND(F.lit((1 << TAG_BITS) - 1)))


def select_every(particles: DataFrame, every: int) -> DataFrame:
    """Each n-th particle (by i) of each rank, with its tag."""
    return particles.where(F.pmod("i", F.lit(every)) == 0).withColumn("tag", tracer_tag(F.col("rank"), F.col("i")))


def in_domain(x: Column, y: Column, z: Column, low: tuple[float, float, float], high: tuple[float, float, float]) -> Column:
    return x.between(low[0], high[0]) & y.between(low[1], high[1]) & z.between(low[2], high[2])


def tagged(tracers: DataFrame) -> DataFrame:
    return tracers.where("tag != 0")


def dumps_at(step: Column, interval: int) -> Column:
    """Is a dump due at this step?"""
    return F.pmod(step, F.lit(interval)) == 0 if interval > 0 else F.lit(False)


def frame_index(step: Column, pass_interval: int, tracer_interval: int) -> Column:
    """The frame of a buffer that a step goes to; never negative."""
    return F.greatest(F.lit(0), F.floor((F.pmod(step, F.lit(pass_interval)) - 1) / tracer_interval)).cast("int")


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def is_negative(x: Column) -> Column:
    return (x < 0).cast("int")


def random_payload(df: DataFrame, seed: int = 0) -> DataFrame:
    """Columns pf (0 to 13.76) and pi (0 to 688): a seeded payload for benchmarks."""
    n = F.floor(F.rand(seed) * 689)
    return df.withColumns({"pf": (n / 50).cast("float"), "pi": n.cast("int")})


def downsample(cells: DataFrame, columns: list[str], stride: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Some variables of every n-th cell in each direction."""
    keep = [F.pmod(f"i{a}", F.lit(s)) == 0 for a, s in zip(AXES, stride, strict=True)]
    return cells.where(keep[0] & keep[1] & keep[2]).select("t", "ix", "iy", "iz", *columns)
