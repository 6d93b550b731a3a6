"""Writers.  Nothing is written into an input's folder, and nothing is overwritten unless asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_MANIFEST = ("epoch", "offset", "obs_min", "obs_max", "exp_min", "exp_max", "item_count", "oob_count", "upd_round")


def write_text_manifest(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows of nine columns, one folder per rank; numbers with six decimals."""
    cols = [F.format_string("%.6f", c).alias(c) if c[:3] in ("obs", "exp") else F.col(c) for c in TEXT_MANIFEST]
    manifest.select("rank", *cols).repartition("rank").sortWithinPartitions("rank", "epoch", "offset").write.mode(mode).partitionBy("rank").csv(path)


def write_overlap_curve(curve: DataFrame, path: str, mode: str = "errorifexists") -> None:
    curve.repartition("Epoch").sortWithinPartitions("Epoch", "Point").write.mode(mode).option("header", True).partitionBy("Epoch").csv(path)


def write_query_plan(plan: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """epoch,lo,hi without a header, six decimals, in order."""
    plan.orderBy("epoch", "lo").select("epoch", F.format_string("%.6f", "lo").alias("lo"), F.format_string("%.6f", "hi").alias("hi")).coalesce(1).write.mode(mode).csv(path)


def write_trace(energies: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The compressed trace: 32-bit keys by step."""
    energies.write.mode(mode).partitionBy("t").parquet(path)


def write_particles(particles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One step's particles in eight columns."""
    p = particles.select("t", *[F.col(f"d{a}").alias(f"d{a.upper()}") for a in "xyz"], *[F.col(f"u{a}").alias(f"U{a}") for a in "xyz"], F.col("cell").alias("i"), F.lit(-1).alias("q"))
    p.write.mode(mode).partitionBy("t").parquet(path)


def write_bricks(cells: DataFrame, path: str, variables: list[str], by_step: bool = True, mode: str = "errorifexists") -> None:
    """One folder per variable, and per step if asked, its cells in x, y, z order."""
    long = cells.select("t", "ix", "iy", "iz", F.explode(F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).cast("float").alias("value")) for v in variables])).alias("v"))
    long = long.select("t", "ix", "iy", "iz", "v.var", "v.value").repartition("var", "t").sortWithinPartitions("var", "t", "iz", "iy", "ix")
    long.write.mode(mode).partitionBy(*(("var", "t") if by_step else ("var",))).parquet(path)


def write_snapshots(tracers: DataFrame, path: str, mode: str = "append") -> None:
    tracers.write.mode(mode).partitionBy("t", "species").parquet(path)


def write_trajectories(tracers: DataFrame, path: str, mode: str = "append") -> None:
    """Each tracer's rows (tag 0 marks none) together and in time order, by species."""
    own = tracers.where("tag != 0").repartition("species", "tag").sortWithinPartitions("species", "tag", "t")
    own.write.mode(mode).partitionBy("species").parquet(path)


def write_workload(queries: DataFrame, path: str, mode: str = "append") -> None:
    """epoch,begin,end rows in the order of n."""
    queries.orderBy("n").select("epoch", "qbegin", "qend").coalesce(1).write.mode(mode).csv(path)
