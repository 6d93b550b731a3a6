"""Similarity join on sets of word five-grams: chosen paths, then exact Jaccard.

1. Each text becomes the set of its five-word runs (hashed to 64 bits) and a signature of ``T``
   minima of random hashes: tokens of the set, sampled alike for all sets.  Texts with equal sets
   form one node, whatever number of copies there are.
2. Chosen paths: every run splits all nodes by the tokens at positions picked by chance (1/threshold
   of them on average); buckets of more than ``LIMIT`` nodes are split again by positions that
   depend on their path, so similar sets stay together and others part.  ``RUNS`` repetitions are made, and as many
   again until the recall is at its target: beside ``PROBES`` of the sets a signature is planted that agrees with it as
   sets just at the threshold do, and the recall is the share of these pairs that end in one component.  Small buckets are compared all against all by signature and give
   links that span them; what ``DEPTH`` splits can't part is alike, and is linked to one of its nodes.
3. Candidates' components (found without collecting them) are compared exactly, all pairs of each,
   in blocks of ``PAIRS`` nodes.  So no link inside a component is lost, and groups of near copies
   are never written out as pairs.

Defined results: words are runs of letters, digits and underscores in lower case; a text of fewer
than five words is one run of them; a text without words (null, empty) is linked to nothing and is
its own class; rows without an id are in no class (class_id null); each row of a repeated id is
judged by its own text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, join_skewed, save, select, tune
from .components import components

N, T, RUNS, LIMIT, DEPTH, PAIRS, NEAR = 5, 64, 10, 128, 5, 512, 0.6
#: Pairs planted at the threshold (at most), and the share of them that has to be found.
PROBES, RECALL = 512, 0.98
_WORD = re.compile(r"\w+")
_U = np.uint64
_RANDOM = np.random.default_rng(20_240)
_A = _RANDOM.integers(1, 1 << 63, T, dtype=np.uint64) | _U(1)
_B = _RANDOM.integers(0, 1 << 63, T, dtype=np.uint64)


class _Hashes(dict):
    """word -> 64-bit hash; emptied by its user when full."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, hashes: _Hashes, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of the text's runs of n words."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(hashes) > 1_000_000:
        hashes.clear()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(out)


def signature(tokens: np.ndarray) -> bytes:
    """T minima of random hashes of the tokens, as uint32."""
    least = np.full(T, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(tokens), 2048):
        h = ((tokens[k : k + 2048, None] * _A + _B) >> _U(32)).astype(np.uint32)
        least = np.minimum(least, h.min(0))
    return least.tobytes()


def set_id(tokens: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(tokens.tobytes())


def _children(path: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of every child: positions by a hash of the path, and the tokens there."""
    at = np.arange(1, T + 1, dtype=np.uint64)
    pick = _mix(_mix(path)[:, None] ^ (at * _U(0xD6E8FEB86659FD93))[None, :])
    row, pos = np.nonzero(pick < _U(int(2.0**64 / (threshold * T))))
    return row, _mix(_mix(path[row] * _U(0x9E3779B97F4A7C15) + pos.astype(np.uint64)) ^ sketch[row, pos].astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, T)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each member's component in a symmetric adjacency matrix."""
    n = len(linked)
    root = np.arange(n)
    near = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, root[None, :], n).min(1)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _groups(batches, key_columns: int):
    """Whole groups of rows sorted by their first columns, as tables of many groups each, cut at group bounds."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        keys = np.stack([t.column(k).to_numpy() for k in range(key_columns)], 1)
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        if not len(new):
            rest = t
            continue
        yield t.slice(0, new[-1]), np.concatenate([[0], new])
        rest = t.slice(new[-1])
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def nodes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (a hash of the text), node (of the set; null without words), size, sketch of each row."""
    tune(docs.sparkSession)
    picked = select(docs, doc_id=id_col, text=text_col).withColumn("key", F.xxhash64("text"))

    def work(batches):
        hashes = _Hashes()
        for b in batches:
            sets = [shingles(t, hashes) for t in columns(b, "text")[0]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "key", "node", "size", "sketch"],
            )

    return picked.mapInArrow(work, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, key bigint, node binary, size bigint, sketch binary")


def candidate_links(sets: DataFrame, threshold: float, runs: int = RUNS, before: int = 0, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """Links (a, b) between nodes (node, sketch) that chosen paths bring together and whose signatures are near.

    ``before`` runs were made already; these are others.
    """
    spark = sets.sparkSession

    def first(batches):
        for b in batches:
            sketch = _sketches(b.column(1))
            for run in range(before, before + runs):
                root = _mix(np.full(len(sketch), run + 1, np.uint64) * _U(0x9E3779B97F4A7C15))
                row, path = _children(root, sketch, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), b.column(0).take(pa.array(row))], names=["path", "node"])

    def deeper(batches):
        for b in batches:
            row, path = _children(b.column(0).to_numpy().view(np.uint64), _sketches(b.column(2)), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), b.column(1).take(pa.array(row))], names=["path", "node"])

    def connect(batches):
        least = int(NEAR * T)
        for t, starts in _groups(batches, 1):
            ends = np.append(starts[1:], t.num_rows)
            sketch, names = _sketches(t.column(2).combine_chunks()), t.column(1).to_pylist()
            two = starts[ends - starts == 2]
            near = two[(sketch[two] == sketch[two + 1]).sum(1) >= least]
            a, b = [names[i] for i in near], [names[i + 1] for i in near]
            for s, e in zip(starts, ends, strict=True):
                if e - s > 2:
                    x = sketch[s:e]
                    root = _roots((x[:, None] == x[None]).sum(2) >= least)
                    for i in np.flatnonzero(root != np.arange(e - s)):
                        a.append(names[s + i])
                        b.append(names[s + root[i]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    records = save(sets.select("node", "sketch").mapInArrow(first, "path bigint, node binary"), "paths")
    links = None
    for level in range(1, depth + 1):
        counts = records.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        met = save(records.join(counts, "path").join(sets.select("node", "sketch"), "node").select("path", "node", "sketch", "n"), "buckets")
        leaves = met.where(F.col("n") <= limit).select("path", "node", "sketch").repartition("path").sortWithinPartitions("path", "node")
        found = leaves.mapInArrow(connect, "a binary, b binary")
        big = met.where(F.col("n") > limit)
        last = not big.take(1)
        if level == depth and not last:
            # Alike in every token that was asked for: linked to one of their own, in time linear in their number.
            heads = big.groupBy("path").agg(F.min_by("node", F.xxhash64("node")).alias("head"))
            found = found.unionByName(big.join(heads, "path").where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")))
        links = found if links is None else links.unionByName(found)
        if last or level == depth:
            break
        records = save(big.select("path", "node", "sketch").mapInArrow(deeper, "path bigint, node binary"), "paths")
    return links.distinct() if links is not None else spark.createDataFrame([], "a binary, b binary")


def planted(sets: DataFrame, threshold: float) -> DataFrame:
    """of, node, sketch: signatures that agree with those of some sets (by least hash) in each place by the chance ``threshold``."""
    rows = []
    for r in sets.orderBy(F.xxhash64("node"), "node").select("node", "sketch").limit(PROBES).collect():
        own = np.frombuffer(r["sketch"], np.uint32)
        rng = np.random.default_rng(np.frombuffer(bytes(r["node"]), np.uint8))
        other = np.where(rng.random(T) < threshold, own, rng.integers(0, 1 << 32, T, dtype=np.uint32))
        rows.append((bytearray(r["node"]), bytearray(b"planted " + bytes(r["node"])), bytearray(other.astype(np.uint32).tobytes())))
    return sets.sparkSession.createDataFrame(rows, "of binary, node binary, sketch binary")


def near_components(sets: DataFrame, threshold: float, runs: int = RUNS, target: float = RECALL) -> DataFrame:
    """node, root of the components of candidates, from as many runs as the planted pairs call for."""
    probes = planted(sets, threshold)
    wanted, made, links = probes.count(), 0, None
    both = sets.select("node", "sketch").unionByName(probes.select("node", "sketch"))
    while True:
        found = candidate_links(both, threshold, runs, made)
        links = found if links is None else links.unionByName(found)
        near = components(links)
        one = near.select(F.col("node").alias("of"), F.col("root").alias("root_of"))
        met = probes.select("of", "node").join(near, "node").join(one, "of").where("root = root_of").count()
        if met >= target * wanted:
            return near.join(probes.select("node"), "node", "left_anti")
        made += runs


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right`` (or of ``left``)."""
    both = left if right is None else left + right
    flat = np.concatenate(both)
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    token = token.ravel()
    keep = count[token] > 1  # a token of one set overlaps nothing
    row, token = row[keep], token[keep]
    _, token = np.unique(token, return_inverse=True)
    n, width = len(left), 2048
    out = np.zeros((n, n if right is None else len(right)), np.float32)
    order = np.argsort(token.ravel(), kind="stable")
    row, token = row[order], token.ravel()[order]
    cuts = np.searchsorted(token, np.arange(0, (int(token[-1]) if len(token) else -1) + 1 + width, width))
    for c in range(len(cuts) - 1):
        a, b = cuts[c], cuts[c + 1]
        if a < b:
            m = np.zeros((len(both), width), np.float32)
            m[row[a:b], token[a:b] - c * width] = 1
            out += m[:n] @ (m[:n] if right is None else m[n:]).T
    return out


def verify(docs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """node, root, n_text_links, n_links from exact comparison of all pairs of each candidate component.

    members: node, doc_id (of one row with that set), copies, component, n (nodes of the component).
    Rows of one node may come from several blocks; roots are the least linked node of each block.
    """
    kind = members.schema["doc_id"].dataType.simpleString()
    part = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # Block pairs (i <= j) that hold the node: all with its own block.
    keyed = members.withColumn("blocks", F.ceil(F.col("n") / PAIRS)).withColumn("own", part)
    texts = docs.where("doc_id is not null").join(keyed, "doc_id").select("component", "node", "copies", "blocks", "own", "text")

    def sets(batches):
        hashes = _Hashes()
        for b in batches:
            found = [shingles(t, hashes) for t in columns(b, "text")[0]]
            fits = pa.array([len(s) > 0 and set_id(s) == n for s, n in zip(found, b.column(1).to_pylist(), strict=True)])
            out = pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([s.tobytes() for s in found], pa.binary())], names=["component", "node", "copies", "blocks", "own", "tokens"])
            yield out.filter(fits)  # another row of a repeated id has another set

    held = texts.mapInArrow(sets, "component binary, node binary, copies bigint, blocks bigint, own int, tokens binary")
    pairs = F.transform(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    dealt = held.withColumn("pair", F.explode(pairs)).select(F.xxhash64("component", "pair.i", "pair.j").alias("task"), F.xxhash64("component").alias("c"), "node", "copies", "own", "pair.i", "pair.j", "tokens")
    dealt = dealt.repartition("task").sortWithinPartitions("task", "c", "node")

    def compare(batches):
        for t, starts in _groups(batches, 2):
            ends = np.append(starts[1:], t.num_rows)
            names, copies, own = t.column("node").to_pylist(), t.column("copies").to_numpy(), t.column("own").to_numpy()
            i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
            tokens = t.column("tokens")
            out: list[tuple[bytes, bytes, int, int]] = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                keep = [k for k in range(s, e) if k == s or names[k] != names[k - 1]]  # repeated rows of one id
                x = [np.frombuffer(tokens[k].as_py(), np.uint64) for k in keep]
                size, weight = np.array([len(v) for v in x]), copies[keep]
                linked = np.zeros((len(x), len(x)), bool)
                if len(x) == 2:
                    common = len(np.intersect1d(x[0], x[1], assume_unique=True))
                    linked[0, 1] = linked[1, 0] = common >= threshold * (size.sum() - common) - 1e-9
                elif len(x) > 2:
                    if i[s] == j[s]:
                        common = _overlaps(x, None)
                        linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
                        np.fill_diagonal(linked, False)
                    else:
                        a, b = np.flatnonzero(own[keep] == i[s]), np.flatnonzero(own[keep] == j[s])
                        if len(a) and len(b):
                            common = _overlaps([x[k] for k in a], [x[k] for k in b])
                            hit = common >= threshold * (size[a][:, None] + size[b][None, :] - common) - 1e-6
                            linked[np.ix_(a, b)] = hit
                            linked[np.ix_(b, a)] = hit.T
                if len(x) == 2 and i[s] != j[s] and own[keep[0]] == own[keep[1]]:
                    linked[:] = False  # compared in the block of their own
                root = _roots(linked) if linked.any() else np.arange(len(x))
                links, docs_ = linked.sum(1), linked @ weight
                out += [(names[k], names[keep[r]], int(n), int(m)) for k, r, n, m in zip(keep, root.tolist(), links, docs_, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["node", "root", "n_text_links", "n_links"])

    return dealt.mapInArrow(compare, "node binary, root binary, n_text_links bigint, n_links bigint")


def _judged(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    """doc_id, key, root (null for rows in no class), class_id, n_links, n_text_links of each row of doc_id and text."""
    rows = save(nodes_of(docs), "nodes")
    named = rows.where("node is not null and doc_id is not null")
    sets = save(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")), "sets")
    near = near_components(sets, threshold, runs)
    sizes = near.groupBy("root").agg(F.count("*").alias("n"))
    members = near.join(sizes, "root").join(sets.select("node", "doc_id", "copies"), "node").select("node", "doc_id", "copies", F.col("root").alias("component"), "n")
    exact = save(verify(docs, members, threshold), "exact")
    links = exact.groupBy("node").agg(F.sum("n_text_links").alias("n_text_links"), F.sum("n_links").alias("n_links"))
    roots = components(exact.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = sets.select("node", "copies").join(links, "node", "left").join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), F.coalesce("n_text_links", F.lit(0)).cast("bigint").alias("n_text_links"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = known.join(sets.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    known = known.join(least, "root").select("node", "root", "class_id", "n_links", "n_text_links")
    return rows.select("doc_id", "key", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(known, "node", "left").select(
        "doc_id", "key", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("bigint").alias("n_text_links"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """doc_id, class_id (least id among documents joined by links), n_links (documents of Jaccard >= threshold,
    equal ones among them), n_text_links (different sets of five-grams so linked) of each row."""
    return _judged(select(docs, doc_id=id_col, text=text_col), threshold, runs).select("doc_id", "class_id", "n_links", "n_text_links")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row (doc_id, text and any columns) of each class: that of the smallest id, and of its texts in the class the
    one with the least hash.  Rows without an id stay, as do those linked to none, whatever other texts their id has.

    Of rows that repeat both id and text one stays.
    """
    found = save(_judged(select(docs, doc_id="doc_id", text="text"), threshold, RUNS).select("doc_id", "key", "root"), "classes")
    own = F.struct("doc_id", "key")
    first = found.where("root is not null").groupBy("root").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = join_skewed(found, first, ["root"], "n").where(own != F.col("first")).select("doc_id", "key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("key"))
    kept = rows.join(gone, ["doc_id", "key"], "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key")
    if again.take(1):
        kept = kept.join(again, ["doc_id", "key"], "left_anti").select("row").unionByName(kept.join(again, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]).select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
