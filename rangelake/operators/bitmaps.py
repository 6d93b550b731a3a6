"""A binned bitmap index of keys: open ranges from the index alone where bins lie within them.

Keys are cut into bins by fixed edges.  For each block and bin with records the index holds how many they are, their
least and greatest key, and a compressed bitmap of their places.  A bin whose keys all lie within a range is a hit as a
whole; of bins at the range's ends the records at their places, and no others, are looked up and checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import check_range, in_range, valid_key
from ..runtime import ship
from ..schemas import flt
from .sweep import keep

#: Forms of a bitmap: places of 16 bits, bits, runs of places, places of 32 bits.
SHORTS, BITS, RUNS, LONGS = range(4)
INDEX = "epoch INT, rank INT, sst INT, first BIGINT, bin INT, n BIGINT, least FLOAT, most FLOAT, bitmap BINARY"
#: Time steps in one file of an index, as queries of many epochs name them.
EPOCHS_PER_FILE = 3
#: Places given out together.
PLACES = 65_536


def encode(places: np.ndarray) -> bytes:
    """Rising places as the shortest of the forms, after a byte that names it."""
    if not len(places):
        return bytes([SHORTS])
    if places[-1] >= 1 << 16:
        return bytes([LONGS]) + places.astype("<u4").tobytes()
    start = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    length = np.diff(start, append=len(places))
    sizes = {SHORTS: 2 * len(places), RUNS: 4 * len(start), BITS: int(places[-1]) // 8 + 1}
    form = min(sizes, key=lambda f: (sizes[f], f))
    if form == SHORTS:
        raw = places.astype("<u2")
    elif form == RUNS:
        raw = np.stack([places[start], length - 1], axis=1).astype("<u2")
    else:
        bits = np.zeros(int(places[-1]) + 1, bool)
        bits[places] = True
        raw = np.packbits(bits, bitorder="little")
    return bytes([form]) + raw.tobytes()


def decode(raw: bytes) -> np.ndarray:
    form, body = raw[0], raw[1:]
    if form == BITS:
        return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little"))
    if form == RUNS:
        start, more = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64).T
        n = more + 1
        return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
    return np.frombuffer(body, "<u2" if form == SHORTS else "<u4").astype(np.int64)


def _pieces(parts: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(number, bitmap) of each part that takes more than places of 16 bits; ``at`` are the places of all parts in order."""
    starts, ends = parts[:-1], parts[1:]
    n, last = ends - starts, at[ends - 1]
    rises = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
    runs = rises[ends - 1] - rises[starts] + 1
    short = (last < 1 << 16) & (2 * n <= 4 * runs) & (2 * n <= last // 8 + 1)
    for k in np.flatnonzero(~short).tolist():
        yield k, encode(at[starts[k] : ends[k]])


def _encoded(parts: np.ndarray, at: np.ndarray) -> pa.Array:
    """``encode`` of each part of ``at``; the many that are places of 16 bits are made together."""
    shorts = np.empty((len(at), 2), np.uint8)
    shorts[:] = (at & 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2)
    raw, other = shorts.tobytes(), dict(_pieces(parts, at))
    head = bytes([SHORTS])
    cuts = (2 * parts).tolist()
    return pa.array([other[k] if k in other else head + raw[s:e] for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))], pa.binary())


def build_index(records: DataFrame, edges: tuple[float, ...]) -> DataFrame:
    """INDEX of records (epoch, rank, sst, pos, key); bin k holds keys from edge k - 1 on and below edge k.

    A task holds a batch and one block at a time.  Records without a key aren't indexed.
    """
    ship(records.sparkSession)
    cuts = np.array(edges, np.float32)
    if len(cuts) < 1 or (np.diff(cuts) <= 0).any():
        raise ValueError("edges have to rise")
    names = [f.split()[0] for f in INDEX.split(", ")]

    def whole(ids: np.ndarray, pos: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        """The rows of whole blocks that follow each other."""
        new = np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])
        block, first = np.cumsum(new) - 1, pos[new]
        at = np.searchsorted(cuts, key, side="right")
        order = np.lexsort((at, block))  # stable, so places rise within a block and bin
        block, at, key = block[order], at[order], key[order]
        part = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (at[1:] != at[:-1])]))
        own, ends = block[part], np.append(part, len(key))
        name = ids[new][own]
        cols = [pa.array(name[:, c].astype(np.int32)) for c in range(3)] + [pa.array(first[own]), pa.array(at[part].astype(np.int32)), pa.array(np.diff(ends).astype(np.int64))]
        cols += [pa.array(np.minimum.reduceat(key, part)), pa.array(np.maximum.reduceat(key, part)), _encoded(ends, pos[order] - first[block])]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of the block that the next batch may go on with
        for b in batches:
            if not len(b):
                continue
            ids = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            own = (ids, b.column(3).to_numpy(), b.column(4).to_numpy())
            if (ids[-1] == ids[0]).all() and (not held or (held[-1][0][-1] == ids[0]).all()):
                held.append(own)  # nothing but more of one block
                continue
            last = len(ids) - int(np.argmax((ids[::-1] != ids[-1]).any(axis=1))) if (ids[0] != ids[-1]).any() else 0
            done = [*held, *([tuple(x[:last] for x in own)] if last else [])]
            yield whole(*(np.concatenate(x) for x in zip(*done, strict=True)))
            held = [tuple(x[last:] for x in own)]
        if held:
            yield whole(*(np.concatenate(x) for x in zip(*held, strict=True)))

    own = records.where(valid_key(F.col("key"))).select("epoch", "rank", "sst", F.col("pos").cast("bigint").alias("pos"), "key")
    return own.repartition("epoch", "rank", "sst").sortWithinPartitions("epoch", "rank", "sst", "pos").mapInArrow(index, INDEX)


def _parts(index: DataFrame, epoch: int | None, lo: float, hi: float, closed: str) -> tuple[DataFrame, Column]:
    """The index's rows that may hold hits, and whether all of a row's records are."""
    check_range(lo, hi)
    own = index if epoch is None else index.where(F.col("epoch") == epoch)
    below, above = flt(lo), flt(hi)
    may = ((F.col("most") >= below) if closed in ("both", "left") else (F.col("most") > below)) & ((F.col("least") <= above) if closed in ("both", "right") else (F.col("least") < above))
    return own.where(may), in_range(F.col("least"), lo, hi, closed) & in_range(F.col("most"), lo, hi, closed)


def places(parts: DataFrame) -> DataFrame:
    """epoch, rank, sst, pos of the records of rows of an index."""
    ship(parts.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n, start = [], 0, 0
            first, raws = b.column(3).to_numpy(), b.column(4).to_pylist()
            for k, raw in enumerate(raws):
                out.append(decode(raw))
                n += len(out[-1])
                if n >= PLACES or k == len(raws) - 1:  # so many places are given out together
                    size = [len(x) for x in out]
                    same = [pa.array(np.repeat(b.column(c).to_numpy()[start : k + 1], size)) for c in range(3)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.concatenate(out) + np.repeat(first[start : k + 1], size))], names=["epoch", "rank", "sst", "pos"])
                    out, n, start = [], 0, k + 1

    return parts.select("epoch", "rank", "sst", "first", "bitmap").mapInArrow(work, "epoch INT, rank INT, sst INT, pos BIGINT")


def indexed_range(index: DataFrame, records: DataFrame, lo: float, hi: float, epoch: int | None = None, closed: str = "neither") -> DataFrame:
    """epoch, rank, sst, pos of the records in a range; records are read for the bins at its ends alone."""
    parts, whole = _parts(index, epoch, lo, hi, closed)
    on = ["epoch", "rank", "sst", "pos"]
    own = records.where(in_range(F.col("key"), lo, hi, closed)).select("epoch", "rank", "sst", F.col("pos").cast("bigint").alias("pos"))
    own = own if epoch is None else own.where(F.col("epoch") == epoch)
    checked = places(parts.where(~whole)).join(own, on, "left_semi")
    return places(parts.where(whole)).unionByName(checked)


def index_report(index: DataFrame, records: DataFrame, lo: float, hi: float, epoch: int | None = None, closed: str = "neither") -> DataFrame:
    """One row: hits, those from the index alone, records and blocks that had to be checked, and blocks and records that a
    catalog of the blocks' ranges would have read."""
    index = keep(index, "bitmaps")  # it is read five times
    parts, whole = _parts(index, epoch, lo, hi, closed)
    block = ["epoch", "rank", "sst"]
    sums = parts.agg(F.coalesce(F.sum(F.when(whole, F.col("n"))), F.lit(0)).alias("from_index"), F.coalesce(F.sum(F.when(~whole, F.col("n"))), F.lit(0)).alias("checked"))
    blocks = parts.where(~whole).select(*block).distinct().agg(F.count("*").alias("blocks_checked"))
    all_ = index if epoch is None else index.where(F.col("epoch") == epoch)
    ranges = all_.groupBy(*block).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
    met = _parts(ranges, None, lo, hi, closed)[0].agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("block_records"))
    good = indexed_range(index, records, lo, hi, epoch, closed).agg(F.count("*").alias("hits"))
    return good.crossJoin(sums).crossJoin(blocks).crossJoin(met)  # tables of one row


def epoch_files(queries: DataFrame, per_file: int = EPOCHS_PER_FILE) -> DataFrame:
    """``queries`` (epoch and any columns) with file (its number), first_epoch and last_epoch of the file, and step (in it, from 0)."""
    first = F.col("epoch") - F.pmod("epoch", F.lit(per_file))
    return queries.withColumns({
        "file": F.floor(F.col("epoch") / per_file).cast("int"), "first_epoch": first.cast("int"), "last_epoch": (first + per_file - 1).cast("int"), "step": F.pmod("epoch", F.lit(per_file)).cast("int"),
    })
