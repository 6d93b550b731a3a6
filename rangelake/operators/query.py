"""Range queries: exact results, candidates by block, batches, full scans, previews, selectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import check_range, in_range
from ..schemas import flt
from . import manifest as M
from .intervals import interval_join
from .sweep import numbered, overlapped

#: A batch of at most this many queries is sent to every task; a larger one is joined by key bins.
BROADCAST_QUERIES = 64


def range_query(records: DataFrame, epoch: int, lo: float, hi: float, rank: int | None = None, closed: str = "both", ordered: bool = True) -> DataFrame:
    """Records of an epoch with keys in the range, in key order (ties by rank and place).

    Both filters reach the scan: the epoch prunes partitions, the key row groups.
    """
    check_range(lo, hi)
    out = records.where((F.col("epoch") == epoch) & in_range(F.col("key"), lo, hi, closed))
    out = out if rank is None or rank < 0 else out.where(F.col("rank") == rank)
    return out.orderBy("key", "rank", "pos") if ordered else out


def candidates(records: DataFrame, manifest: DataFrame, epoch: int, lo: float, hi: float, rank: int | None = None) -> DataFrame:
    """All records of the blocks that overlap the query: what a reader without row filters would read."""
    blocks = M.overlapping(manifest, epoch, lo, hi, rank).select("epoch", "rank", "sst")
    return records.where(F.col("epoch") == epoch).join(blocks, ["epoch", "rank", "sst"], "left_semi")


def value_pointers(records: DataFrame, manifest: DataFrame, key_size: int = 4, value_size: int = 8) -> DataFrame:
    """epoch, rank, key and the byte offset of the value in its rank's file (keys come before values in a block)."""
    first = F.min("pos").over(Window.partitionBy("epoch", "rank", "sst"))
    met = records.select("epoch", "rank", "sst", "key", (F.col("pos") - first).alias("_i")).join(manifest.select("epoch", "rank", "sst", "offset", "item_count"), ["epoch", "rank", "sst"])
    return met.select("epoch", "rank", "key", (F.col("offset") + F.col("item_count") * key_size + F.col("_i") * value_size).alias("value_offset"))


def full_scan(records: DataFrame, epoch: int, lo: float, hi: float) -> DataFrame:
    """The baseline: every block of the epoch is read, keys in [lo, hi) stay."""
    return range_query(records, epoch, lo, hi, closed="left")


def batch_query(records: DataFrame, queries: DataFrame, closed: str = "both") -> DataFrame:
    """qid, epoch, rank, key, pos of the matches of every query (qid, epoch, qbegin, qend, rank), in one job.

    A few queries go to the records; many are dealt over key bins (``intervals``).
    """
    if queries.limit(BROADCAST_QUERIES + 1).count() > BROADCAST_QUERIES:
        return interval_join(records, queries, closed)
    q = queries.select("qid", F.col("epoch").alias("_e"), "qbegin", "qend", F.col("rank").alias("_r"))
    q = F.broadcast(q)  # its size was looked at
    on = (F.col("epoch") == F.col("_e")) & in_range(F.col("key"), F.col("qbegin"), F.col("qend"), closed) & (F.coalesce("_r", F.lit(-1)).isin(-1) | (F.col("rank") == F.col("_r")))
    return records.join(q, on).select("qid", "epoch", "rank", "key", "pos")


def batch_report(records: DataFrame, manifest: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: matched keys, candidate mass, epoch mass, block and key selectivity; queries without a match too."""
    hits = batch_query(records, queries).groupBy("qid").agg(F.count("*").alias("keys"))
    # Blocks of all ranks of an epoch are one group, those of each rank another.
    group = lambda rank: (F.shiftleft(F.col("epoch").cast("bigint"), 32) + rank + 1)
    m = manifest.select(F.explode(F.array(group(F.lit(-1)), group(F.col("rank")))).alias("g"), F.col("obs_min").alias("lo"), F.col("obs_max").alias("hi"), F.col("item_count").cast("bigint").alias("mass"))
    q = queries.where("qbegin <= qend").select("qid", group(F.coalesce("rank", F.lit(-1))).alias("g"), F.col("qbegin").alias("lo"), F.col("qend").alias("hi"))
    mass = overlapped(m.where("lo IS NOT NULL AND hi IS NOT NULL"), q).select("qid", F.col("mass").alias("match_mass"), F.col("n").alias("match_count"))
    total = manifest.groupBy("epoch").agg(F.sum("item_count").alias("epoch_mass"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = queries.select("qid", "epoch").join(hits, "qid", "left").join(mass, "qid", "left").join(total, "epoch", "left")
    out = out.select("qid", "epoch", *[zero(c) for c in ("keys", "match_mass", "match_count", "epoch_mass")])
    share = lambda c: F.when(F.col("epoch_mass") > 0, F.col(c) / F.col("epoch_mass")).otherwise(0.0)
    return out.withColumns({"sst_selectivity": share("match_mass"), "key_selectivity": share("keys")})


def selectivity(records: DataFrame, manifest: DataFrame, epoch: int, lo: float, hi: float, rank: int | None = None) -> DataFrame:
    """One row: epoch, matched keys and mass, block selectivity, key selectivity.

    The denominator is the whole epoch's mass, with a rank as well.
    """
    mass = manifest.where(F.col("epoch") == epoch).agg(F.coalesce(F.sum("item_count"), F.lit(0)).alias("epoch_mass"))
    got = M.overlapping(manifest, epoch, lo, hi, rank).agg(F.coalesce(F.sum("item_count"), F.lit(0)).alias("match_mass"), F.count("*").alias("match_count"))
    keys = range_query(records, epoch, lo, hi, rank, ordered=False).agg(F.count("*").alias("keys"))
    share = lambda c: F.when(F.col("epoch_mass") > 0, F.col(c) / F.col("epoch_mass")).otherwise(0.0)
    out = mass.crossJoin(got).crossJoin(keys)  # three tables of one row
    return out.select(F.lit(epoch).alias("epoch"), "epoch_mass", "match_mass", "match_count", "keys", share("match_mass").alias("sst_selectivity"), share("keys").alias("key_selectivity"))


def preview(keys: DataFrame, percents: tuple[int, ...] = (0, 10, 50, 100)) -> DataFrame:
    """percent, key: of n keys in order the one at index floor(percent * (n - 1) / 100).

    Keys are numbered in order once (``sweep``), so no task holds them all.
    """
    placed = numbered(keys.select(F.lit(0).cast("bigint").alias("g"), "key"), "g", ["key"])
    n = placed.count()
    wanted = {p: p * (n - 1) // 100 for p in percents} if n else {}
    asked = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    at = F.floor(F.col("percent") * (n - 1) / 100)
    return placed.where(F.col("i").isin(list(wanted.values()))).select("key", "i", asked).where(F.col("i") == at).select("percent", "key")


def raw_count(trace: DataFrame, lo: float, hi: float, closed: str = "both") -> DataFrame:
    """Per rank of a raw trace (rank, key): hits, keys, greatest key."""
    return trace.groupBy("rank").agg(F.count_if(in_range(F.col("key"), lo, hi, closed)).alias("hits"), F.count("*").alias("total"), F.max("key").alias("max_key"))


def raw_summary(per_rank: DataFrame) -> DataFrame:
    """One row: all hits, all keys, percent, greatest key."""
    return per_rank.agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"), (F.sum("hits") * 100.0 / F.sum("total")).alias("percent"), F.max("max_key").alias("max_key"))


def top_hits(per_rank: DataFrame, n: int = 10) -> DataFrame:
    """The ranks with most hits."""
    return per_rank.select("rank", "hits").orderBy(F.desc("hits"), "rank").limit(n)


def stabbing(records: DataFrame, epoch: int, key: float) -> DataFrame:
    """Records with exactly that key, as a 32-bit float."""
    return records.where((F.col("epoch") == epoch) & (F.col("key") == flt(key)))
