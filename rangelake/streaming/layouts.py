"""A stream that lays its epochs out anew while they are written.

Each writer (epoch, rank) has a layout in force: pivots that cut its range into bins.  Keys within the range are
delivered at once and counted in their bin; keys out of bounds are held back.  When ``buffer`` of them are held, pivots
are made of the bins' counts and the held keys, the new layout is installed as the next version, and the held records
are delivered under it.  A writer without a layout holds everything.

The state of a writer (layout, counts, held records) is kept by Structured Streaming from one micro-batch to the next,
so a stream that is killed goes on from its checkpoint.  Where a micro-batch ends makes no difference: a writer's records
are taken in order of ``pos``, and a layout changes at the record that fills the buffer.  ``replay`` does the same to a
table, a part of it at a time, with the state of one writer in memory.

A writer's records of one micro-batch are sorted by one task; the source's files per trigger bound them.  Ranks with most
of the rows can be split into lanes by the caller (as further ranks), for layouts of ranks are merged by mass later on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.predicates import valid_key
from ..operators.pivots import MOST_PIVOTS, Context, Pivots, from_all, from_sample
from ..runtime import ship

#: Records a writer holds back before it lays out anew, and pivots of a layout.
BUFFER, PIVOT_COUNT = 4096, 64
#: Records looked at together; a layout may change within.
STEP = 8192

#: What the stream writes: records as they are delivered (with version and bucket), a row for each layout installed, and
#: the records that a writer still held when it was closed (version 0).
EVENTS = "kind STRING, epoch INT, rank INT, pos BIGINT, key FLOAT, version INT, bucket INT, pivots ARRAY<DOUBLE>, counts ARRAY<BIGINT>, n_left BIGINT, n_right BIGINT"
_STATE = "version INT, pivots ARRAY<DOUBLE>, counts ARRAY<BIGINT>, held_pos ARRAY<BIGINT>, held_keys ARRAY<FLOAT>"
_COLUMNS = [f.split()[0] for f in EVENTS.split(", ")]


@dataclass
class Writer:
    """One writer's layout, counts and held records."""

    buffer: int = BUFFER
    pivot_count: int = PIVOT_COUNT
    version: int = 0
    pivots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    held_pos: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    held_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def _deliver(self, pos: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
        """Records under the layout in force; the last bin holds its upper end."""
        bucket = np.clip(np.searchsorted(self.pivots, keys.astype(float), side="right") - 1, 0, len(self.counts) - 1)
        self.counts = self.counts + np.bincount(bucket, minlength=len(self.counts))
        return pd.DataFrame({"kind": "record", "pos": pos, "key": keys, "version": self.version, "bucket": bucket})

    def _lay_out(self, at: int) -> Iterator[pd.DataFrame]:
        """Install pivots of all mass since the last ones, and deliver what was held; ``at`` is the record that called for it."""
        order = np.sort(self.held_keys)
        if self.version:
            left, right = order[order < self.pivots[0]], order[order > self.pivots[-1]]
            made = from_all(Context(tuple(self.pivots), tuple(self.counts), tuple(map(float, left)), tuple(map(float, right))), self.pivot_count)
        else:
            left, right = order, order[:0]
            made = from_sample(tuple(map(float, order)), self.pivot_count) if len(order) > 1 else Pivots((float(order[0]),) * 2, 1.0)
        values = np.unique(made.values)  # of equal pivots one is enough: the bins between them are empty
        self.pivots = values if len(values) > 1 else np.repeat(values, 2)
        self.counts, self.version = np.zeros(len(self.pivots) - 1, np.int64), self.version + 1
        yield pd.DataFrame({"kind": ["layout"], "pos": at, "version": self.version, "pivots": [self.pivots.tolist()], "n_left": len(left), "n_right": len(right)})
        pos, keys = self.held_pos, self.held_keys
        self.held_pos, self.held_keys = pos[:0], keys[:0]
        yield self._deliver(pos, keys)

    def take(self, pos: np.ndarray, keys: np.ndarray) -> Iterator[pd.DataFrame]:
        """Events of further records, which are in order of ``pos``."""
        at = 0
        while at < len(keys):
            k, p = keys[at : at + STEP], pos[at : at + STEP]
            out = (k < self.pivots[0]) | (k > self.pivots[-1]) if self.version else np.ones(len(k), bool)
            room = self.buffer - len(self.held_keys)
            filled = np.flatnonzero(out)[room - 1 : room]
            if len(filled):  # the layout changes at this record
                k, p, out = k[: filled[0] + 1], p[: filled[0] + 1], out[: filled[0] + 1]
            if not out.all():
                yield self._deliver(p[~out], k[~out])
            self.held_pos, self.held_keys = np.concatenate([self.held_pos, p[out]]), np.concatenate([self.held_keys, k[out]])
            if len(filled):
                yield from self._lay_out(int(p[-1]))
            at += len(k)

    def close(self) -> Iterator[pd.DataFrame]:
        """The layout at the end with its counts, and the records still held."""
        if self.version:
            yield pd.DataFrame({"kind": ["final"], "version": self.version, "pivots": [self.pivots.tolist()], "counts": [self.counts.tolist()], "n_left": int((self.held_keys < self.pivots[0]).sum()), "n_right": int((self.held_keys > self.pivots[-1]).sum())})
        if len(self.held_pos):
            yield pd.DataFrame({"kind": "held", "pos": self.held_pos, "key": self.held_keys, "version": 0})


def _full(events: pd.DataFrame, epoch: int, rank: int) -> pd.DataFrame:
    events["epoch"], events["rank"] = epoch, rank
    out = events.reindex(columns=_COLUMNS)
    whole = {"pos": "Int64", "version": "Int32", "bucket": "Int32", "n_left": "Int64", "n_right": "Int64"}
    out = out.astype(whole | {"key": "float32"})
    return out.astype({c: object for c in whole} | {"pivots": object, "counts": object}).where(out.notna(), None)


def _check(buffer: int, pivot_count: int) -> None:
    if buffer < 1 or not 2 <= pivot_count <= MOST_PIVOTS:
        raise ValueError(f"a buffer of at least one record, and 2 to {MOST_PIVOTS} pivots")


def lay_out(records: DataFrame, buffer: int = BUFFER, pivot_count: int = PIVOT_COUNT, idle_ms: int | None = None, last_pos: str | None = None) -> DataFrame:
    """The stream ``records`` (epoch, rank, pos, key) as EVENTS; records without a key go nowhere.

    A writer is closed, its state dropped and what it holds given out, when a record of it is marked (``last_pos``: a
    boolean column) or when nothing came for ``idle_ms`` milliseconds.
    """
    _check(buffer, pivot_count)
    ship(records.sparkSession)

    def work(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w = Writer(buffer, pivot_count)
        if state.exists:
            version, pivots, counts, held_pos, held_keys = state.get
            w = Writer(buffer, pivot_count, version, np.array(pivots, float), np.array(counts, np.int64), np.array(held_pos, np.int64), np.array(held_keys, np.float32))
        if state.hasTimedOut:
            state.remove()
            for e in w.close():
                yield _full(e, *key)
            return
        own = pd.concat(list(frames)).sort_values("pos", kind="stable")
        for e in w.take(own["pos"].to_numpy(np.int64), own["key"].to_numpy(np.float32)):
            yield _full(e, *key)
        if own["last"].any():
            if state.exists:
                state.remove()
            for e in w.close():
                yield _full(e, *key)
            return
        state.update((w.version, w.pivots.tolist(), w.counts.tolist(), w.held_pos.tolist(), [float(k) for k in w.held_keys]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    own = records.where(valid_key(F.col("key"))).select("epoch", "rank", "pos", "key", (F.coalesce(F.col(last_pos), F.lit(False)) if last_pos else F.lit(False)).alias("last"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return own.groupBy("epoch", "rank").applyInPandasWithState(work, EVENTS, _STATE, "append", timeout)


def write_events(events: DataFrame, path: str, checkpoint: str, trigger_seconds: int | None = None) -> StreamingQuery:
    """Start the stream; each micro-batch's events are a partition of ``path`` that a second try of it replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    w = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=f"{trigger_seconds} seconds") if trigger_seconds else w.trigger(availableNow=True)).start()


def replay(records: DataFrame, buffer: int = BUFFER, pivot_count: int = PIVOT_COUNT) -> DataFrame:
    """The EVENTS of a table of whole epochs: what the stream gives when all its writers are closed."""
    _check(buffer, pivot_count)
    ship(records.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        name, w = None, None
        for b in batches:
            for (epoch, rank), own in b.to_pandas().groupby(["epoch", "rank"], sort=False):
                if (epoch, rank) != name:
                    if w:
                        yield from (_full(e, *name) for e in w.close())
                    name, w = (epoch, rank), Writer(buffer, pivot_count)
                yield from (_full(e, epoch, rank) for e in w.take(own["pos"].to_numpy(np.int64), own["key"].to_numpy(np.float32)))
        if w:
            yield from (_full(e, *name) for e in w.close())

    kinds = pa.schema([("kind", pa.string()), ("epoch", pa.int32()), ("rank", pa.int32()), ("pos", pa.int64()), ("key", pa.float32()), ("version", pa.int32()), ("bucket", pa.int32()), ("pivots", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64())), ("n_left", pa.int64()), ("n_right", pa.int64())])

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in work(batches):
            if len(frame):
                yield pa.RecordBatch.from_pandas(frame, kinds, preserve_index=False)

    own = records.where(valid_key(F.col("key"))).select("epoch", "rank", "pos", "key")
    return own.repartition("epoch", "rank").sortWithinPartitions("epoch", "rank", "pos").mapInArrow(arrow, EVENTS)


def delivered(events: DataFrame) -> DataFrame:
    """epoch, rank, pos, key, version (0: held to the end), bucket of every record."""
    return events.where(F.col("kind").isin("record", "held")).select("epoch", "rank", "pos", "key", "version", "bucket")


def layouts(events: DataFrame) -> DataFrame:
    """epoch, rank, version, pos (of the record that called for it), lo, hi, n_left, n_right of every layout installed."""
    ends = [F.get("pivots", F.lit(0)).alias("lo"), F.get("pivots", F.size("pivots") - 1).alias("hi")]
    return events.where("kind = 'layout'").select("epoch", "rank", "version", "pos", *ends, "n_left", "n_right")
