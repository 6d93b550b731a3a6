"""Best-fit-decreasing packing of token sequences into fixed-size sequences.

Best fit decreasing takes the pieces from long to short and puts each into the open bin with the
least room that still holds it.  Pieces of one length are interchangeable, so the plan is made on
the *histogram of lengths* (at most ``size`` entries, however large the corpus): a segment tree
over remaining capacities finds the tightest open bins in logarithmic time, and runs of equal bins
are filled together.  The plan is exactly best fit decreasing over all pieces; pieces are then
numbered within their length by a distributed, salted numbering and looked up in the plan.

Defined results: a null text is empty (one end mark); repeated rows are packed each by itself;
null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, save, select, tune
from .wordbpe import load_cache

SIZE, END_ID = 4096, 1


class Capacities:
    """Segment tree over remaining capacities 0..size: which of them some open bin has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)

    def put(self, at: int, there: bool) -> None:
        i = at + self.leaves
        self.some[i] = there
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] | self.some[2 * i + 1]

    def tightest(self, least: int) -> int:
        """The smallest capacity of an open bin that is at least ``least``; -1 if there is none."""
        i = least + self.leaves
        if self.some[i]:
            return least
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def plan(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Steps (length, first piece, first bin, pieces a bin, offset) of best fit decreasing.

    Pieces of a length are numbered from 0; piece j of a step that starts at piece i goes to bin
    ``first bin + (j - i) // pieces a bin`` at ``offset + (j - i) % pieces a bin * length``.
    """
    tree, open_bins, steps, bins = Capacities(size), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not open_bins.get(room):
                open_bins[room] = []
                tree.put(room, True)
            open_bins[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, at = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, each = size, size // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.put(room, False)
                each = room // length
            full, rest = divmod(min(left, n * each), each)
            steps.append((length, at, first, each, size - room))
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            at += full * each + rest
            left -= full * each + rest
    return np.array(steps, np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end mark, cut only where longer than ``size``."""
    tune(docs.sparkSession)
    picked = select(docs, doc_id=id_col, text=text_col)
    kind = picked.schema["doc_id"].dataType.simpleString()

    def work(batches):
        cache, end = load_cache(vocabulary), int(end_id).to_bytes(4, "little")
        for b in batches:
            (texts,) = columns(b, "text")
            at, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(cache.ids(texts)):
                raw += end
                for k, p in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[p : p + 4 * size]
                    at.append(i), piece.append(k), start.append(p // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return picked.mapInArrow(work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (columns as above, any further ones dropped) with sequence_id and offset.

    Numbering within a length is salted by row hash, so a length that a third of all rows has is
    dealt over many tasks; only the histogram of lengths reaches the driver.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    found = found.select(*names)
    per = found.groupBy("length").count().collect()  # at most ``size`` rows
    histogram = {r["length"]: r["count"] for r in per}
    if not histogram:
        return found.withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")})
    steps = plan(histogram, size)
    salts = max(64, sum(histogram.values()) // 50_000)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_at", F.row_number().over(within)).join(first, ["length", "_salt"]).select(*names, (F.col("_first") + F.col("_at") - 1).alias("_at"))

    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = found.sparkSession.sparkContext.broadcast(steps[order])  # bounded by the lengths there are, not by rows

    def work(batches):
        plan_ = steps.value
        key = (plan_[:, 0] << 46) + plan_[:, 1]
        for b in batches:
            length, at = b.column(3).to_numpy(), b.column(5).to_numpy()
            s = plan_[np.searchsorted(key, (length << 46) + at, side="right") - 1]
            bin_, place = np.divmod(at - s[:, 1], s[:, 3])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(s[:, 2] + bin_), pa.array(s[:, 4] + place * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id bigint, offset bigint"
    return numbered.mapInArrow(work, schema)


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Encode, cut and pack whole documents; the encoded pieces are kept in the shared folder in between."""
    return pack(save(pieces(docs, vocabulary, size=size, end_id=end_id), "pieces"), size)
