"""Near duplicates by SimHash: fingerprints of 64 bits, linked at a small Hamming distance through BK-trees.

1. A document's fingerprint has a bit set where more than half the hashes (XXH64) of its word runs have it.  Equal
   fingerprints are one node, so a group of copies is one node however large it is.
2. Fingerprints are dealt into shards that no link crosses: the 64 bits are cut into ``radius + 2`` blocks, and two
   fingerprints within the radius agree in at least two of them.  Each pair of blocks gives one shard key, so every
   linked pair meets in some shard, and a shard is the few fingerprints that agree in some 32 bits.
3. Each shard is a BK-tree: a node's children are keyed by their Hamming distance to it.  A search follows only edges
   whose key is within the radius of its own distance to the node.  Trees of many shards are grown and searched
   together, a level at a time, as arrays.
4. Of the links found in a shard a spanning forest goes on; components are taken over all forests.

Trees travel to the tasks that search them by a shuffle and not through the driver, for together they hold the
fingerprints of all documents.  A shard of more than ``SHARD`` fingerprints is cut into parts, and each pair of parts
is a shard of its own, so no task holds more than that and no pair is lost.

Defined results: a null, empty or blank text has fingerprint zero, which links like any other; a text of fewer words
than a run is one run; repeated rows each get a row; a null id is never a component's name unless all its ids are null.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, raw_texts, save, select, tune
from .components import components

BITS, RADIUS, WORDS, SEED = 64, 2, 3, 42
#: Most fingerprints of a shard, pairs of (query, node) looked at together, and bytes of a text cut at once.
SHARD, PAIRS, SLICE = 65_536, 2_000_000, 1 << 20
_BLANK = re.compile(rb"[\t-\r ]")


def _runs(text: bytes, words: int):
    """Hashes of the runs of ``words`` words of a text, in slices of bounded size; the last words of a slice go before the next."""
    before: list[bytes] = []
    at, first = 0, True
    while at < len(text):
        end = _BLANK.search(text, at + SLICE)
        end = end.start() if end else len(text)
        found = before + text[at:end].lower().split()
        at = end
        if len(found) < words:
            if at >= len(text) and first and found:
                yield [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
            before = found
            continue
        first = False
        line = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        yield [digest(line[s:e], SEED) for s, e in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
        before = found[len(found) - words + 1 :]


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    total, n = np.zeros(BITS, np.int64), 0
    for hashes in _runs(text or b"", words):
        for k in range(0, len(hashes), 32_768):
            part = np.array(hashes[k : k + 32_768], "<u8").view(np.uint8).reshape(-1, 8)
            total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed number)."""
    tune(docs.sparkSession)
    picked = select(docs, doc_id=id_col, text=text_col)
    kind = picked.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            found = np.array([fingerprint(t, words) for t in raw_texts(b)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return picked.mapInArrow(work, f"doc_id {kind}, fp bigint")


def grow(codes: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1 at a root) and distance to it of each code; ``root`` names the first code of each one's tree.

    All trees grow a level at a time: of the codes waiting at a node, the first at each distance becomes the child that
    the others at that distance go on to.  That is the tree of inserting them one by one.
    """
    parent, edge = np.full(len(codes), -1, np.int64), np.zeros(len(codes), np.int64)
    waiting = np.flatnonzero(root != np.arange(len(codes)))
    at = root[waiting]
    while len(waiting):
        d = np.bitwise_count(codes[waiting] ^ codes[at]).astype(np.int64)
        _, first, group = np.unique(at * (BITS + 1) + d, return_index=True, return_inverse=True)
        child = waiting[first]
        parent[child], edge[child] = at[first], d[first]
        on = child[group]
        left = on != waiting
        waiting, at = waiting[left], on[left]
    return parent, edge


def near(codes: np.ndarray, root: np.ndarray, radius: int):
    """Pairs (i, j), j < i, of codes of one tree within the radius, in portions; equal codes of a tree aren't expected."""
    parent, edge = grow(codes, root)
    child = np.flatnonzero(parent >= 0)
    key = parent[child] * (BITS + 1) + edge[child]
    order = np.argsort(key, kind="stable")
    key, child = key[order], child[order]
    room = np.cumsum(np.bincount(root, minlength=len(codes))[root])  # a search meets at most its whole tree
    at = 0
    while at < len(codes):
        end = max(at + 1, int(np.searchsorted(room, (room[at - 1] if at else 0) + PAIRS, side="right")))
        who = np.arange(at, end)
        node = root[who]
        while len(who):
            d = np.bitwise_count(codes[who] ^ codes[node]).astype(np.int64)
            hit = (d <= radius) & (node < who)
            if hit.any():
                yield who[hit], node[hit]
            low = np.searchsorted(key, node * (BITS + 1) + np.maximum(d - radius, 0))
            high = np.searchsorted(key, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
            n = high - low
            who = np.repeat(who, n)
            node = child[np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)]
        at = end


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest member) after linking a and b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(further := label[label], label):
            label = further


def _shard_keys(radius: int) -> list[tuple[int, int]]:
    """The mask of each pair of blocks, and its number."""
    cuts = [BITS * k // (radius + 2) for k in range(radius + 3)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(x | y, k) for k, (x, y) in enumerate(combinations(blocks, 2))]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: a spanning forest of each shard's links between the distinct fingerprints of ``nodes`` (column fp)."""
    signed = lambda mask: mask - (1 << BITS) if mask >> (BITS - 1) else mask
    of = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("bits")) for mask, k in _shard_keys(radius)]
    keys = nodes.select("fp", F.explode(F.array(*of)).alias("key")).select("fp", "key.part", "key.bits")
    size = keys.groupBy("part", "bits").count().where("count > 1")
    parts = F.ceil(F.col("count") / (SHARD // 2))
    # One part of a large shard meets each of its parts, itself included, in a shard of the two.
    met = (
        keys.join(size, ["part", "bits"])
        .withColumns({"parts": parts, "own": F.pmod(F.xxhash64("fp"), parts)})
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        .select("part", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    )
    shard = ["part", "bits", "low", "high"]

    def work(batches):
        held: list[np.ndarray] = []
        n = 0

        def found(rows: np.ndarray):
            codes = rows[:, 4].view(np.uint64)
            new = np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
            root = np.flatnonzero(new)[np.cumsum(new) - 1]
            label = np.arange(len(codes))
            for a, b in near(codes, root, radius):
                label = _merge(label, a, b)
            far = np.flatnonzero(label != np.arange(len(codes)))
            return pa.RecordBatch.from_arrays([pa.array(rows[far, 4]), pa.array(rows[label[far], 4])], names=["a", "b"])

        for b in batches:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1))
            n += len(held[-1])
            if n < SHARD:
                continue
            rows = np.concatenate(held)
            last = int(np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))[-1:].sum()) + 1 if (rows[0, :4] != rows[-1, :4]).any() else 0
            if last:
                yield found(rows[:last])
            held, n = [rows[last:].copy()], len(rows) - last
        if n:
            yield found(np.concatenate(held))

    return met.repartition(*shard).sortWithinPartitions(*shard, "fp").mapInArrow(work, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id of its component) of each row."""
    marked = save(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = save(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    reached = components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root").join(nodes.select("fp", "least"), "fp")
    first = reached.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = join_skewed(reached.select("fp", "root"), first, ["root"], "members").select("fp", "component_id")
    all_ = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    return join_skewed(marked, all_, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
