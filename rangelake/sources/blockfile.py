"""Block files: one file per rank of blocks of keys and values, with a manifest at the end.

Layout (fixed values of the format): ``RDB-%08x.tbl`` holds blocks (all keys of a block, then all
values), then for each epoch ``u32 epoch, u64 bytes`` and items of 44 bytes, then a footer of 28.

Three Spark data sources read a directory: ``rdb_manifest`` (no block is touched), ``rdb_keys``
(key blocks only) and ``rdb`` (keys and values).  Filters on epoch, rank and key that Spark pushes
down choose files and blocks by the manifest before anything is read.  ``fetch_values`` is the second
phase of a read of keys: of the values only the wanted ones are read.  ``rdb`` writes as well: each task
rolls files of its own, which get their names when all tasks are done.  Files are opened through
pyarrow's file systems, so the directory may be local or remote.
"""

from __future__ import annotations

import itertools
import struct
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..functions.predicates import valid_key
from ..runtime import ship
from ..schemas import MANIFEST, RECORD

ITEM = np.dtype([("idx", "<u8"), ("offset", "<u8"), ("exp_min", "<f4"), ("exp_max", "<f4"), ("obs_min", "<f4"), ("obs_max", "<f4"), ("upd_round", "<u4"), ("item_count", "<u4"), ("oob_count", "<u4")])
EPOCH, FOOTER = struct.Struct("<IQ"), struct.Struct("<IQQQ")
TAIL = 4096
#: Footers read at once when a read is planned.
FOOTER_READS = 32
#: Bytes of neighbouring blocks that one task reads; small files are read by one task up to so many bytes, and their rows given out together.
SPLIT, PACK, PACK_ROWS = 64 << 20, 4 << 20, 8192
#: Values less than so many bytes apart are fetched by one read, of at most so many bytes and for so many pointers.
FETCH_GAP, FETCH_BYTES, FETCH_ROWS = 64 << 10, 8 << 20, 1 << 16
#: Records of a file, and of a block, that is written.
FILE_RECORDS, BLOCK_RECORDS = 83_000_000, 1 << 16


def file_name(rank: int) -> str:
    return f"RDB-{rank:08x}.tbl"


def _open(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def list_ranks(path: str) -> list[tuple[int, int]]:
    """(rank, size) of ranks 0, 1, ... up to the first that has no file; the folder is listed once."""
    from pyarrow import fs

    system, root = _open(path)
    size = {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File}
    return [(rank, size[file_name(rank)]) for rank in itertools.takewhile(lambda r: file_name(r) in size, itertools.count())]


@dataclass(frozen=True)
class Footer:
    rank: int
    key_size: int
    value_size: int
    items: np.ndarray  # of ITEM, with the epoch apart
    epochs: np.ndarray


def read_footer(path: str, rank: int, size: int, guess: int = TAIL) -> Footer:
    """A file's manifest: one read of its tail, another if the manifest is longer."""
    system, root = _open(path)
    with system.open_input_file(f"{root}/{file_name(rank)}") as f:
        if size < FOOTER.size:
            raise ValueError(f"rank {rank}: no footer in {size} bytes")
        at = max(0, size - guess)
        f.seek(at)
        tail = f.read(size - at)
        n_epochs, n_bytes, key_size, value_size = FOOTER.unpack(tail[-FOOTER.size :])
        whole = n_bytes + FOOTER.size
        if whole > size:
            raise ValueError(f"rank {rank}: a manifest of {n_bytes} bytes in a file of {size}")
        if whole > len(tail):
            f.seek(size - whole)
            tail = f.read(whole)
    raw, at, items, epochs = tail[len(tail) - whole : len(tail) - FOOTER.size], 0, [], []
    for _ in range(n_epochs):
        epoch, length = EPOCH.unpack_from(raw, at)
        at += EPOCH.size
        if length % ITEM.itemsize or at + length > len(raw):
            raise ValueError(f"rank {rank}: {length} bytes of items in epoch {epoch}")
        own = np.frombuffer(raw, ITEM, length // ITEM.itemsize, at)
        items.append(own)
        epochs.append(np.full(len(own), epoch, np.int32))
        at += length
    return Footer(rank, key_size, value_size, np.concatenate(items) if items else np.empty(0, ITEM), np.concatenate(epochs) if epochs else np.empty(0, np.int32))


class Writer:
    """One rank's file, block by block.  It takes its name when it is closed, so a task that is lost leaves none behind."""

    def __init__(self, path: str, name: str | int, value_size: int, oob: int = 0):
        self.system, root = _open(path)
        self.system.create_dir(root, recursive=True)
        self.name, self.value_size, self.oob = f"{root}/{file_name(name) if isinstance(name, int) else name}", value_size, oob
        self.draft = f"{self.name}.{uuid.uuid4().hex}"
        self.file, self.at = self.system.open_output_stream(self.draft), 0
        self.items: dict[int, list[np.void]] = {}

    def block(self, epoch: int, keys: np.ndarray, values: np.ndarray) -> None:
        keys, own = np.ascontiguousarray(keys, "<f4"), self.items.setdefault(epoch, [])
        raw = keys.tobytes() + np.ascontiguousarray(values, np.uint8).reshape(len(keys), self.value_size).tobytes()
        ends = (keys.min(), keys.max()) if len(keys) else (0, 0)
        own.append((len(own), self.at, *ends, *ends, 0, len(keys), self.oob))
        self.file.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        manifest = b""
        for epoch, own in sorted(self.items.items()):
            raw = np.array(own, ITEM).tobytes()
            manifest += EPOCH.pack(epoch, len(raw)) + raw
        self.file.write(manifest + FOOTER.pack(len(self.items), len(manifest), 4, self.value_size))
        self.file.close()
        self.system.move(self.draft, self.name)


def write_file(path: str, rank: int, epochs: dict[int, list[tuple[np.ndarray, np.ndarray]]], value_size: int, oob: int = 0) -> None:
    """One rank's file from blocks (keys, values as n x value_size bytes) of each epoch."""
    out = Writer(path, rank, value_size, oob)
    for epoch, blocks in sorted(epochs.items()):
        out.items[epoch] = []
        for keys, values in blocks:
            out.block(epoch, keys, values)
    out.close()


def write_blocks(records: DataFrame, path: str, value_size: int) -> None:
    """Records (epoch, rank, sst, pos, key, value of ``value_size`` bytes) as block files, a file for each rank.

    A rank's records go to one task, for they go to one file, sorted (which spills, if it must); the task holds one
    block of records at a time.  Records without a key go nowhere.
    """
    ship(records.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rank, key, held = None, None, None, []

        def flush() -> None:
            if held:
                out.block(key[1], np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))
                held.clear()

        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in range(3)])
            keys, values = batch.column(3).to_numpy(), np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, value_size)
            cuts = np.flatnonzero((np.diff(ids) != 0).any(axis=0)) + 1
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(keys)]):
                if lo == hi:
                    continue
                now = tuple(ids[:, lo].tolist())
                if now != key:
                    flush()
                    key = now
                if now[0] != rank:
                    if out:
                        out.close()
                    rank = now[0]
                    out = Writer(path, rank, value_size)
                held.append((keys[lo:hi], values[lo:hi]))
        flush()
        if out:
            out.close()
        yield from ()

    own = records.where(valid_key(F.col("key"))).repartition("rank").sortWithinPartitions("rank", "epoch", "sst", "pos")
    own.select("rank", "epoch", "sst", "key", "value").mapInArrow(write, "rank INT").write.format("noop").mode("overwrite").save()


def fetch_values(pointers: DataFrame, path: str, value_size: int | None = None, gap: int = FETCH_GAP, split: int = SPLIT, start: Column | None = None) -> DataFrame:
    """``pointers`` (rank, value_offset and any columns, as ``rdb_keys`` gives them) with value and bytes_read.

    A rank's file is cut into stripes of ``split`` bytes, and a stripe's pointers go to one task, in order; values less
    than ``gap`` bytes apart are fetched by one read, however rows are batched.  A pointer is of the stripe that it lies in,
    or, with ``start``, that this byte place lies in: with a block's place no block is cut.  ``bytes_read`` is the read's
    length in the first row it serves and 0 in the others.  Pointers that repeat are read once; a pointer out of the file is
    an error, a null one has no value.
    """
    ship(pointers.sparkSession)
    if value_size is None:
        ranks = list_ranks(path)
        value_size = read_footer(path, *ranks[0]).value_size if ranks else 0
    names = pointers.columns
    if {"value", "bytes_read"} & set(names):
        raise ValueError("pointers have a column named value or bytes_read")
    rank_at, offset_at = names.index("rank"), names.index("value_offset")
    plain = [f"c{k}" for k in range(len(names))]

    def runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first, end) of offsets in order that one read serves."""
        far = np.flatnonzero(np.diff(at) - value_size >= max(gap, 1)) + 1
        for first, hi in itertools.pairwise([0, *far.tolist(), len(at)]):
            while first < hi:
                most = int(np.searchsorted(at[first:hi], at[first] + FETCH_BYTES - value_size, side="right"))
                end = min(first + max(1, min(most, FETCH_ROWS)), hi)
                yield first, end
                first = end

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(path)
        rank, f, last = None, None, (None, b"")  # last: a pointer that a run ended with, and its value
        held = None  # rows from the first one of a run that the next batch may go on with
        for b in itertools.chain(batches, [None]):
            done = b is None
            if done and held is None:
                return
            b = held if done else b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if len(b) else held
            values, lengths, held = [None] * len(b), np.zeros(len(b), np.int64), None
            ranks, offsets = b.column(rank_at), b.column(offset_at)
            known = np.flatnonzero(~(ranks.is_null().to_numpy(zero_copy_only=False) | offsets.is_null().to_numpy(zero_copy_only=False)))
            own, at = (c.take(pa.array(known)).to_numpy(zero_copy_only=False) for c in (ranks, offsets))
            cuts, whole = np.flatnonzero(np.diff(own)) + 1, len(b)
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(own)]):
                if lo == hi:
                    continue
                for first, end in ((lo + a, lo + z) for a, z in runs(at[lo:hi])):
                    if end == len(own) and not done and end - first < FETCH_ROWS:
                        held, whole = b.slice(known[first]), int(known[first])
                        break
                    if own[first] != rank:
                        rank, f, last = int(own[first]), system.open_input_file(f"{root}/{file_name(int(own[first]))}"), (None, b"")
                    same = int(np.searchsorted(at[first:end], last[0], side="right")) if at[first] == last[0] else 0
                    for k in range(first, first + same):
                        values[known[k]] = last[1]
                    first += same
                    if first == end:
                        continue
                    begin, length = int(at[first]), int(at[end - 1] - at[first]) + value_size
                    f.seek(begin)
                    raw = f.read(length)
                    if begin < 0 or len(raw) != length:
                        raise ValueError(f"rank {rank}: no value of {value_size} bytes at {begin + length - value_size}")
                    lengths[known[first]] = length
                    for k in range(first, end):
                        values[known[k]] = raw[at[k] - begin : at[k] - begin + value_size]
                    last = (int(at[end - 1]), values[known[end - 1]])
            if whole:
                out = b.slice(0, whole)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(values[:whole], pa.binary()), pa.array(lengths[:whole])], names=[*names, "value", "bytes_read"])

    rank, offset = F.col(plain[rank_at]), F.col(plain[offset_at])
    own = pointers.select("*", (F.col("value_offset") if start is None else start).alias("_start")).toDF(*plain, "_start")
    dealt = own.repartition(rank, F.floor(F.col("_start") / split)).drop("_start").sortWithinPartitions(rank, offset)
    schema = StructType([*pointers.schema.fields, StructField("value", BinaryType()), StructField("bytes_read", LongType())])
    return dealt.mapInArrow(fetch, schema)


@dataclass
class Files(WriterCommitMessage):
    """Drafts that a task closed, in order."""

    drafts: list[str]


class BlockWriter(DataSourceArrowWriter):
    """Block files of a table (epoch, key, value): a task closes a file at its record limit and begins another.

    Drafts lie in a folder of the job's own and get the next free ranks when all tasks are done, so a task that fails or
    is killed, or a job that is ended, leaves no file behind.  A block is of one epoch; records of several epochs may come
    mixed.  Records without a key go nowhere.
    """

    def __init__(self, options, schema: StructType, overwrite: bool):
        missing = {"epoch", "key", "value"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        self.path, self.overwrite = options["path"], overwrite
        self.columns = [schema.names.index(c) for c in ("epoch", "key", "value")]
        self.value_size = int(options["value_size"]) if "value_size" in options else None
        self.file_records, self.block_records = int(options.get("file_records", FILE_RECORDS)), int(options.get("block_records", BLOCK_RECORDS))
        if min(self.file_records, self.block_records) < 1:
            raise ValueError("files and blocks are of at least one record")
        self.drafts = f"_drafts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        made: list[str] = []
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size, out, n = self.value_size, None, 0

        def block(epoch: int) -> None:
            """Writes what is held of an epoch, up to the file's limit at a time."""
            nonlocal out, n
            parts = held.pop(epoch)
            keys, values = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
            while len(keys):
                if out is None:
                    out, n = Writer(f"{self.path}/{self.drafts}", uuid.uuid4().hex, size), 0
                take = min(len(keys), self.block_records, self.file_records - n)
                out.block(epoch, keys[:take], values[:take])
                keys, values, n = keys[take:], values[take:], n + take
                if n == self.file_records:
                    close()

        def close() -> None:
            nonlocal out
            out.close()
            made.append(out.name.rpartition("/")[2])
            out = None

        for b in iterator:
            epoch, key, value = (b.column(c) for c in self.columns)
            good = np.flatnonzero(~(key.is_null().to_numpy(zero_copy_only=False) | epoch.is_null().to_numpy(zero_copy_only=False) | np.isnan(key.to_numpy(zero_copy_only=False))))
            if not len(good):
                continue
            epochs, keys = epoch.to_numpy(zero_copy_only=False)[good], key.to_numpy(zero_copy_only=False)[good].astype("<f4")
            raw = [v or b"" for v in value.take(pa.array(good)).to_pylist()]
            size = len(raw[0]) if size is None else size
            if any(len(v) != size for v in raw):
                raise ValueError(f"values of other than {size} bytes")
            values = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), size)
            for e in np.unique(epochs).tolist():
                own = epochs == e
                held.setdefault(int(e), []).append((keys[own], values[own]))
                if sum(len(k) for k, _ in held[e]) >= self.block_records:
                    block(e)
            while sum(len(k) for parts in held.values() for k, _ in parts) > 4 * self.block_records:  # many epochs mixed
                block(max(held, key=lambda e: sum(len(k) for k, _ in held[e])))
        for e in sorted(held):
            block(e)
        if out is not None:
            close()
        return Files(made)

    def commit(self, messages: list[Files | None]) -> None:
        from pyarrow import fs

        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for rank, _ in list_ranks(self.path):
                system.delete_file(f"{root}/{file_name(rank)}")
        first = len(list_ranks(self.path))
        for k, draft in enumerate(d for m in messages if m for d in m.drafts):
            system.move(f"{root}/{self.drafts}/{draft}", f"{root}/{file_name(first + k)}")
        if system.get_file_info(f"{root}/{self.drafts}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.drafts}")

    def abort(self, messages: list[Files | None]) -> None:
        from pyarrow import fs

        system, root = _open(self.path)
        if system.get_file_info(f"{root}/{self.drafts}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.drafts}")


@dataclass
class Wanted:
    """What pushed filters leave: closed bounds of epoch, rank and key, and sets of values for the first two."""

    low: dict[str, float]
    high: dict[str, float]
    among: dict[str, set]

    @classmethod
    def none(cls) -> Wanted:
        return cls({}, {}, {})

    def take(self, f: Filter) -> bool:
        """Note a filter; are its rows sure to be checked here as well? (Never: Spark checks them again.)"""
        name = f.attribute[0] if getattr(f, "attribute", None) else None
        if name not in ("epoch", "rank", "key"):
            return False
        if isinstance(f, EqualTo):
            self.low[name] = max(self.low.get(name, f.value), f.value)
            self.high[name] = min(self.high.get(name, f.value), f.value)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low[name] = max(self.low.get(name, f.value), f.value)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high[name] = min(self.high.get(name, f.value), f.value)
        elif isinstance(f, In):
            own = set(f.value)
            self.among[name] = self.among.get(name, own) & own
        return False

    def value(self, name: str, x) -> bool:
        return self.low.get(name, x) <= x <= self.high.get(name, x) and x in self.among.get(name, (x,))

    def blocks(self, footer: Footer) -> np.ndarray:
        """Numbers of a file's blocks that may hold wanted rows."""
        i = footer.items
        keep = np.array([self.value("epoch", int(e)) for e in footer.epochs], bool) if len(i) else np.empty(0, bool)
        if "key" in self.low:
            keep &= i["obs_max"] >= np.float32(self.low["key"])
        if "key" in self.high:
            keep &= i["obs_min"] <= np.float32(self.high["key"])
        if self.among.get("key"):
            keep &= (i["obs_max"] >= np.float32(min(self.among["key"]))) & (i["obs_min"] <= np.float32(max(self.among["key"])))
        return np.flatnonzero(keep)


def read_footers(path: str, ranks: list[tuple[int, int]]) -> Iterator[Footer]:
    """The manifests of several files, ``FOOTER_READS`` of them at a time; sizes of keys and values have to agree."""
    sizes = set()
    with ThreadPoolExecutor(FOOTER_READS) as pool:
        for k in range(0, len(ranks), 16 * FOOTER_READS):  # not all manifests in memory
            for footer in pool.map(lambda r: read_footer(path, *r), ranks[k : k + 16 * FOOTER_READS]):
                sizes.add((footer.key_size, footer.value_size))
                if len(sizes) > 1:
                    raise ValueError(f"key and value sizes differ between files: {sorted(sizes)}")
                if footer.key_size != 4:
                    raise ValueError("keys are 32-bit floats")
                yield footer


@dataclass
class Blocks(InputPartition):
    """Blocks of one rank, in order of their place in the file."""

    path: str
    rank: int
    key_size: int
    value_size: int
    blocks: list[tuple[int, int, int, int, int]]  # epoch, number in the epoch, first pos, offset, records


@dataclass
class Pack(InputPartition):
    """Parts of several files that one task reads, one after the other."""

    parts: list[Blocks]


def _packed(parts: list[Blocks], values: bool, most: int) -> Iterator[InputPartition]:
    """Small parts together, in order, up to ``most`` bytes; a part that nothing goes with stays as it is."""
    own, held = [], 0
    for p in parts:
        size = sum(b[4] for b in p.blocks) * (4 + p.value_size * values)
        if own and held + size > most:
            yield Pack(own) if len(own) > 1 else own[0]
            own, held = [], 0
        own.append(p)
        held += size
    if own:
        yield Pack(own) if len(own) > 1 else own[0]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``PACK_ROWS``, but for the last one."""
    own, n = [], 0
    for b in batches:
        own.append(b)
        n += len(b)
        if n >= PACK_ROWS:
            yield from pa.Table.from_batches(own).combine_chunks().to_batches()
            own, n = [], 0
    if own:
        yield from pa.Table.from_batches(own).combine_chunks().to_batches()


class _Reader(DataSourceReader):
    def __init__(self, options, values: bool):
        self.path, self.values = options["path"], values
        self.split = int(options.get("split", SPLIT))
        self.wanted = Wanted.none()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files that a filter on rank rules out aren't opened."""
        out: list[InputPartition] = []
        for footer in read_footers(self.path, [r for r in list_ranks(self.path) if self.wanted.value("rank", r[0])]):
            out += _split(self.path, footer, self.wanted.blocks(footer), self.values, self.split)
        return list(_packed(out, self.values, min(PACK, self.split))) or [Blocks(self.path, -1, 4, 0, [])]

    def read(self, part: Blocks | Pack) -> Iterator[pa.RecordBatch]:
        parts = part.parts if isinstance(part, Pack) else [part]
        return _together(itertools.chain.from_iterable(self._blocks(p) for p in parts if p.blocks))

    def _blocks(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        system, root = _open(part.path)
        with system.open_input_file(f"{root}/{file_name(part.rank)}") as f:
            for epoch, sst, pos, offset, n in part.blocks:
                f.seek(offset)
                keys = np.frombuffer(f.read(4 * n), "<f4")
                if len(keys) != n:
                    raise ValueError(f"rank {part.rank}: a block of {n} keys ends early")
                cols = [pa.array(np.full(n, epoch, np.int32)), pa.array(np.full(n, part.rank, np.int32)), pa.array(np.full(n, sst, np.int32)), pa.array(np.arange(pos, pos + n)), pa.array(keys)]
                if self.values:
                    raw, v = f.read(part.value_size * n), part.value_size
                    if len(raw) != v * n:
                        raise ValueError(f"rank {part.rank}: a block of {n} values ends early")
                    offsets = pa.array(np.arange(0, v * n + 1, v, dtype=np.int32) if v else np.zeros(n + 1, np.int32)).buffers()[1]
                    cols.append(pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(raw)]))
                else:
                    cols.append(pa.array(offset + 4 * n + part.value_size * np.arange(n)))
                yield pa.RecordBatch.from_arrays(cols, names=(RECORD if self.values else KEYS).names)


def _split(path: str, footer: Footer, blocks: np.ndarray, values: bool, split: int) -> Iterator[Blocks]:
    """Some blocks of a file, in order of place, as parts of about ``split`` bytes."""
    sst, pos = places(footer)
    own, held = [], 0
    for b in sorted(blocks, key=lambda b: footer.items["offset"][b]):
        item = footer.items[b]
        own.append((int(footer.epochs[b]), int(sst[b]), int(pos[b]), int(item["offset"]), int(item["item_count"])))
        held += int(item["item_count"]) * (4 + footer.value_size * values)
        if held >= split:
            yield Blocks(path, footer.rank, 4, footer.value_size, own)
            own, held = [], 0
    if own:
        yield Blocks(path, footer.rank, 4, footer.value_size, own)


def places(footer: Footer) -> tuple[np.ndarray, np.ndarray]:
    """Each block's number within its epoch, and the place (from 1) of its first record within epoch and rank."""
    sst, pos = np.zeros(len(footer.items), np.int64), np.zeros(len(footer.items), np.int64)
    for e in np.unique(footer.epochs):
        own = np.flatnonzero(footer.epochs == e)
        own = own[np.argsort(footer.items["offset"][own], kind="stable")]
        sst[own] = np.arange(len(own))
        n = footer.items["item_count"][own].astype(np.int64)
        pos[own] = np.cumsum(n) - n + 1
    return sst, pos


class _Stream(DataSourceStreamReader):
    """Epochs of block files as they are completed: each is taken once, also after a restart.

    A file counts when two looks in a row, ``settle_ms`` apart, find it at the same size.  An offset holds for each rank how
    many of its epochs (in order of number) are taken; a file that is replaced by one with further epochs gives only these.
    A stream that starts or starts again waits until the files that are there keep still, so it never goes back.
    """

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.settle = int(options.get("settle_ms", 1000)) / 1000
        self.seen: dict[int, int] | None = None
        self.counted: dict[int, tuple[int, int]] = {}  # rank -> (size, epochs)

    def initialOffset(self) -> dict:
        return {"taken": []}

    def _look(self) -> dict[int, int]:
        return dict(list_ranks(self.path))

    def latestOffset(self) -> dict:
        now = self._look()
        while self.seen is None or (not self.counted and now != self.seen):
            self.seen = now
            time.sleep(self.settle)
            now = self._look()
        still = [(r, n) for r, n in now.items() if self.seen.get(r) == n and self.counted.get(r, (-1,))[0] != n]
        for footer in read_footers(self.path, still):
            self.counted[footer.rank] = (now[footer.rank], len(np.unique(footer.epochs)))
        self.seen = now
        taken: list[list[int]] = []  # runs of ranks with as many epochs
        for r in itertools.takewhile(lambda r: r in self.counted, itertools.count()):
            n = self.counted[r][1]
            if taken and taken[-1][0] == n:
                taken[-1][1] += 1
            else:
                taken.append([n, 1])
        return {"taken": taken}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        flat = lambda offset: [n for n, times in offset["taken"] for _ in range(times)]
        before, after = flat(start), flat(end)
        before += [0] * (len(after) - len(before))
        new = {r: (a, b) for r, (a, b) in enumerate(zip(before, after, strict=False)) if b > a}
        out: list[InputPartition] = []
        for footer in read_footers(self.path, [r for r in list_ranks(self.path) if r[0] in new]):
            a, b = new[footer.rank]
            fresh = np.flatnonzero(np.isin(footer.epochs, np.unique(footer.epochs)[a:b]))
            out += _split(self.path, footer, fresh, True, self.split)
        return out or [Blocks(self.path, -1, 4, 0, [])]

    def read(self, part: Blocks) -> Iterator[pa.RecordBatch]:
        return _Reader({"path": part.path}, values=True).read(part)


KEYS = StructType(RECORD.fields[:-1]).add("value_offset", LongType())


class KeySource(DataSource):
    """Key blocks only: key and the byte place of its value."""

    @classmethod
    def name(cls) -> str:
        return "rdb_keys"

    def schema(self) -> StructType:
        return KEYS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, values=False)


class RecordSource(KeySource):
    """Keys and values."""

    @classmethod
    def name(cls) -> str:
        return "rdb"

    def schema(self) -> StructType:
        return RECORD

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, values=True)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BlockWriter(self.options, schema, overwrite)


@dataclass
class Rank(InputPartition):
    path: str
    rank: int
    size: int


MANIFEST_FILE = StructType(MANIFEST.fields).add("key_sz", LongType()).add("val_sz", LongType())


class _ManifestReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [Rank(self.path, r, n) for r, n in list_ranks(self.path)] or [Rank(self.path, -1, 0)]

    def read(self, part: Rank) -> Iterator[pa.RecordBatch]:
        if part.rank < 0:
            return
        f = read_footer(part.path, part.rank, part.size)
        sst, _ = places(f)
        n = len(f.items)
        cols = {"epoch": f.epochs, "rank": np.full(n, part.rank), "sst": sst} | {c: f.items[c] for c in MANIFEST.names[3:]} | {"key_sz": np.full(n, f.key_size), "val_sz": np.full(n, f.value_size)}
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32()}
        yield pa.RecordBatch.from_arrays([pa.array(cols[x.name].astype(kinds[x.dataType.simpleString()].to_pandas_dtype())) for x in MANIFEST_FILE], names=MANIFEST_FILE.names)


class ManifestSource(DataSource):
    """The manifests at the files' ends."""

    @classmethod
    def name(cls) -> str:
        return "rdb_manifest"

    def schema(self) -> StructType:
        return MANIFEST_FILE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ManifestReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the three sources known to a session, with filter pushdown."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in (ManifestSource, KeySource, RecordSource):
        spark.dataSource.register(s)
