"""Schemas of the tables that operators take and give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"INT": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BINARY": T.BinaryType()}


def _struct(text: str) -> T.StructType:
    """From "name TYPE, ..."; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(","))])


RECORD = _struct("epoch INT, rank INT, sst INT, pos BIGINT, key FLOAT, value BINARY")
MANIFEST = _struct(
    "epoch INT, rank INT, sst INT, offset BIGINT, obs_min FLOAT, obs_max FLOAT, exp_min FLOAT, exp_max FLOAT, "
    "item_count BIGINT, oob_count BIGINT, upd_round INT"
)
QUERY = _struct("qid INT, epoch INT, qbegin FLOAT, qend FLOAT, rank INT")
QLOG = _struct("path STRING, epoch INT, qbegin FLOAT, qend FLOAT, qselectivity FLOAT, qkeyselectivity DOUBLE, qreadus BIGINT, qsortus BIGINT")
OVERLAP = _struct("Epoch INT, Point FLOAT, MatchMass BIGINT, TotalMass BIGINT, MatchCount BIGINT")
PIVOTS = _struct("idx INT, pivot DOUBLE")
PARTICLE = _struct("t INT, rank INT, dx FLOAT, dy FLOAT, dz FLOAT, cell INT, ux FLOAT, uy FLOAT, uz FLOAT, w FLOAT, tag1 BIGINT, tag2 BIGINT")
FIELD = _struct("t INT, ix INT, iy INT, iz INT, ex FLOAT, ey FLOAT, ez FLOAT, bx FLOAT, by FLOAT, bz FLOAT")
HYDRO = _struct(
    "t INT, species STRING, ix INT, iy INT, iz INT, jx FLOAT, jy FLOAT, jz FLOAT, rho FLOAT, px FLOAT, py FLOAT, pz FLOAT, ke FLOAT, "
    "txx FLOAT, tyy FLOAT, tzz FLOAT, tyz FLOAT, tzx FLOAT, txy FLOAT"
)
TRACER = _struct(
    "t DOUBLE, species STRING, tag INT, x FLOAT, y FLOAT, z FLOAT, ux FLOAT, uy FLOAT, uz FLOAT, "
    "ex FLOAT, ey FLOAT, ez FLOAT, bx FLOAT, by FLOAT, bz FLOAT"
)


def flt(x: float | Column) -> Column:
    """A FLOAT literal: keys are compared as 32-bit floats, and a DOUBLE literal would be another number."""
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("float")
