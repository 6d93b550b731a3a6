"""Approximate nearest neighbours: score-aware (anisotropic) quantisation, four-bit table scans, exact reranking.

Least Euclidean distance is greatest ``q.x - |x|^2 / 2``, an inner product with a known offset.
Vectors are product-quantised in subspaces of two dimensions with sixteen centres each (four
bits); centres and codes minimise a loss that weighs the residual along the vector more than the
residual across it, for it is the former that spoils large inner products.  A search adds up
per-query tables over the codes, takes the best ``RERANK`` distinct vectors of each slab and ranks
them by exact distance in double precision on the original vectors.

The codebook is fitted on ``SAMPLE`` vectors of lowest hash; every vector is indexed and scanned.
Copies of one vector are scanned once and stand for their smallest ids, so a vector that a third
of all rows share costs no more than another.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; neither do null ids.  Equal distances go to smaller ids; a
repeated (id, vector) counts once; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, select, tune

SAMPLE, RERANK, SLAB, BLOCK, CENTRES, SUB = 20_000, 160, 16_384, 2_048, 16, 2


def parallel_weight(dim: int, threshold: float = 0.2) -> float:
    """How much more the parallel residual weighs, for inner products above ``threshold`` of the norms."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _split(x: np.ndarray) -> np.ndarray:
    """n x subspaces x SUB, padded with zeros."""
    n, d = x.shape
    pad = -d % (2 * SUB)
    return np.pad(x, ((0, 0), (0, pad))).reshape(n, -1, SUB).astype(np.float32)


def encode(x: np.ndarray, centres: np.ndarray, weight: float, rounds: int = 2) -> np.ndarray:
    """Codes (n x subspaces, 0..15) by coordinate descent on the anisotropic loss."""
    xs = _split(x)
    unit = xs / np.maximum(np.sqrt((xs**2).sum((1, 2), keepdims=True)), 1e-20)
    n, m, _ = xs.shape
    codes = np.empty((n, m), np.uint8)
    along = np.zeros((n, m), np.float32)  # each subspace's part of the parallel residual
    for s in range(m):
        r = xs[:, s, None, :] - centres[s][None]
        codes[:, s] = (r**2).sum(2).argmin(1)
        along[:, s] = ((xs[:, s] - centres[s][codes[:, s]]) * unit[:, s]).sum(1)
    total = along.sum(1)
    for _ in range(rounds):
        for s in range(m):
            r = xs[:, s, None, :] - centres[s][None]
            part = (r * unit[:, s, None, :]).sum(2)
            loss = (r**2).sum(2) + (weight - 1) * (total[:, None] - along[:, s, None] + part) ** 2
            c = loss.argmin(1)
            new = np.take_along_axis(part, c[:, None], 1)[:, 0]
            total += new - along[:, s]
            along[:, s], codes[:, s] = new, c
    return codes


def fit(x: np.ndarray, weight: float, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Centres (subspaces x 16 x SUB): codes and weighted least squares by turns."""
    rng = np.random.default_rng(seed)
    xs = _split(x)
    unit = xs / np.maximum(np.sqrt((xs**2).sum((1, 2), keepdims=True)), 1e-20)
    n, m, _ = xs.shape
    centres = np.stack([xs[rng.choice(n, CENTRES, replace=n < CENTRES), s] for s in range(m)])
    for turn in range(rounds):
        codes = encode(x, centres, weight if turn > 1 else 1.0, rounds=1)
        got = np.stack([centres[s][codes[:, s]] for s in range(m)], 1)
        along = ((xs - got) * unit).sum(2)
        total = along.sum(1)
        for s in range(m):
            others = total - along[:, s]
            u = unit[:, s].astype(np.float64)
            outer = u[:, :, None] * u[:, None, :] * (weight - 1) + np.eye(SUB)
            right = xs[:, s] + (weight - 1) * u * ((u * xs[:, s]).sum(1) + others)[:, None]
            for c in range(CENTRES):
                own = codes[:, s] == c
                if own.any():
                    centres[s, c] = np.linalg.solve(outer[own].sum(0), right[own].sum(0))
                else:
                    centres[s, c] = xs[rng.integers(n), s]
            new = ((xs[:, s] - centres[s][codes[:, s]]) * unit[:, s]).sum(1)
            total += new - along[:, s]
            along[:, s] = new
    return centres


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def tables(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """queries x bytes x 256: the inner products of both subspaces of a byte."""
    part = np.einsum("qms,mcs->qmc", _split(queries), centres)
    return (part[:, 0::2, None, :] + part[:, 1::2, :, None]).reshape(len(queries), -1, CENTRES * CENTRES)


def scan(lut: np.ndarray, packed: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Approximate ``q.x - |x|^2 / 2`` for all queries and vectors."""
    out = np.broadcast_to(-half, (len(lut), len(packed))).astype(np.float32)
    for b in range(packed.shape[1]):
        out += np.take(lut[:, b], packed[:, b], axis=1)
    return out


def _matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id, embedding of the rows that take part, and their dimension (the one that most have)."""
    v = select(vectors, vec_id=id_col, embedding=vector_col)
    v = v.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))
    top = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = top[0]["n"] if top else 0
    return v.where(F.size("embedding") == dim), dim


def build_index(vectors: DataFrame, dim: int, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray, float]:
    """Every vector with its four-bit codes (in the shared folder), the centres, the weight of parallel residuals."""
    tune(vectors.sparkSession)
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    weight = parallel_weight(dim)
    centres = fit(_matrix(rows.column(0), dim, np.float32), weight)

    def work(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dim, np.float32)
                codes = pack_codes(encode(x, centres, weight))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "embedding", "code"])

    return save(vectors.mapInArrow(work, "vec_id bigint, embedding array<double>, code binary"), "ann-index"), centres, weight


def _search_slab(qid, q, lut, ids, x, packed, k: int, rerank: int):
    """(query number, id, distance) of each query's k nearest in a slab."""
    order = np.argsort(ids, kind="stable")
    ids, x, packed = ids[order], x[order], packed[order]
    _, first, inverse = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    member = np.argsort(inverse, kind="stable")  # by class, ids ascending
    one = np.ones(len(member), bool)
    one[1:] = (inverse[member[1:]] != inverse[member[:-1]]) | (ids[member[1:]] != ids[member[:-1]])
    member = member[one]  # each id of a class once
    start = np.searchsorted(inverse[member], np.arange(len(first) + 1))
    distinct = x[first]
    half = (distinct**2).sum(1).astype(np.float32) / 2
    near = scan(lut, packed[first], half)
    r = min(rerank, len(first))
    best = np.argpartition(-near, r - 1, axis=1)[:, :r] if r < len(first) else np.broadcast_to(np.arange(r), (len(q), r))
    for i in range(len(q)):
        d = distinct[best[i]] - q[i]
        dist = np.sqrt((d * d).sum(1))
        got_id, got_d = [], []
        for j in np.argsort(dist, kind="stable"):
            if len(got_id) >= k and dist[j] > got_d[k - 1]:
                break
            c = best[i, j]
            own = ids[member[start[c] : min(start[c] + k + 1, start[c + 1])]]
            own = own[own != qid[i]][:k]
            got_id += own.tolist()
            got_d += [dist[j]] * len(own)
        top = np.lexsort((got_id, got_d))[:k]
        yield i, np.array(got_id, np.int64)[top], np.array(got_d)[top]


def search(index: DataFrame, queries: DataFrame, centres: np.ndarray, dim: int, k: int = 10, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score (distance) of the k nearest to each query (vec_id, embedding).

    Queries go in blocks of about ``BLOCK``, each against all rows of the index.
    """
    spark = index.sparkSession
    queries = save(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "ann-queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    parts = []
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").toArrow()  # about BLOCK rows
        if not own.num_rows:
            continue
        shared = spark.sparkContext.broadcast((own.column(0).to_numpy(), _matrix(own.column(1), dim)))

        def work(batches, shared=shared):
            qid, q = shared.value
            lut = tables(q, centres)
            best = [(np.empty(0, np.int64), np.empty(0)) for _ in qid]
            held: list = []

            def flush():
                ids = np.concatenate([b.column(0).to_numpy() for b in held])
                x = np.concatenate([_matrix(b.column(1), dim) for b in held])
                packed = np.concatenate([np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1) for b in held])
                for i, gi, gd in _search_slab(qid, q, lut, ids, x, packed, k, rerank):
                    a, d = np.concatenate([best[i][0], gi]), np.concatenate([best[i][1], gd])
                    a, one = np.unique(a, return_index=True)
                    top = np.lexsort((a, d[one]))[:k]
                    best[i] = a[top], d[one][top]

            n = 0
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    n += b.num_rows
                if n >= SLAB:
                    flush()
                    held, n = [], 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qid, [len(a) for a, _ in best])), pa.array(np.concatenate([a for a, _ in best])), pa.array(np.concatenate([d for _, d in best]))],
                names=["query_id", "vec_id", "score"],
            )

        parts.append(index.mapInArrow(work, "query_id bigint, vec_id bigint, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
