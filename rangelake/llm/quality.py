"""Quality classifier: random-indexing word vectors pooled per document, then a small network.

Random indexing: each word has a fixed sparse random index vector (by its hash); a word's context
vector is the sum of its neighbours' index vectors over the training sample.  Words outside the
vocabulary use their index vector.  Besides words, the *forms* of tokens (capitals, digits,
punctuation) have index vectors of their own.  A document is the mean of both kinds; a two-layer
numpy network, its probabilities calibrated by a temperature on a part kept aside, gives the score.

``SAMPLE`` bounds the labelled rows learned from (those of lowest hash) and ``VOCABULARY`` the
words with context vectors; everything else covers all rows and whole texts.

Defined results: null and empty texts are scored from zero vectors; repeated rows alike; with
fewer than ten labelled rows or one class only, every score is the labels' mean (0.5 without any).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, save, select, tune
from .toxicity import labelled_sample

SAMPLE, VOCABULARY, DIM, HASHES, HIDDEN = 12_000, 30_000, 64, 4096, 32
_CORE = re.compile(r"[^\W\d_]+")


def index_vectors(n: int, dim: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: six entries of +1 or -1 each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), np.float32)
    for i in range(n):
        out[i, rng.choice(dim, 6, replace=False)] = rng.choice([-1.0, 1.0], 6)
    return out


def parts(token: str) -> tuple[str, str]:
    """(word, form) of a white-space token."""
    m = _CORE.search(token)
    word = m[0].lower() if m else ""
    shape = "0" if not m else "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a" if m[0].islower() else "aA"
    rest = re.sub(r"\w+", "w", token)
    return word, f"{shape} {rest[:8]} {min(len(token), 24) // 3}"


class Vectors:
    """Token -> row of one matrix (word part and form part side by side); grown on demand, emptied when full."""

    def __init__(self, words: dict[str, int], context: np.ndarray, most: int = 150_000):
        self.words, self.context, self.most = words, context, most
        self.index, self.forms = index_vectors(HASHES, DIM, 1), index_vectors(HASHES, DIM, 2)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.matrix = np.zeros((4096, 2 * DIM), np.float32)

    def rows(self, tokens: list[str]) -> np.ndarray:
        at = self.at
        for t in set(tokens).difference(at):
            word, form = parts(t)
            k = len(at)
            if k == len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            i = self.words.get(word)
            self.matrix[k, :DIM] = self.context[i] if i is not None else self.index[zlib.crc32(word.encode("utf-8", "replace")) % HASHES] / 6**0.5
            self.matrix[k, DIM:] = self.forms[zlib.crc32(form.encode("utf-8", "replace")) % HASHES]
            at[t] = k
        return np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))

    def document(self, text: str | None) -> np.ndarray:
        """The pooled vector and three numbers on length and repetition."""
        tokens = (text or "").split()
        out = np.zeros(2 * DIM + 3, np.float32)
        if not tokens:
            return out
        if len(self.at) > self.most:
            self.clear()
        # Tokens in order of first use, so sums don't depend on what was read before.
        used, first, count = np.unique(self.rows(tokens), return_index=True, return_counts=True)
        order = np.argsort(first)
        used, count = used[order], count[order]
        out[: 2 * DIM] = count.astype(np.float32) @ self.matrix[used] / len(tokens)
        lines = text.split("\n")
        out[2 * DIM :] = np.log1p(len(tokens)) / 10, len(used) / len(tokens), len(set(lines)) / len(lines)
        return out


@dataclass
class Model:
    words: dict[str, int]
    context: np.ndarray
    layers: tuple | None = None  # mean, scale, w1, b1, w2, b2
    temperature: float = 1.0
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 0, epochs: int = 60) -> tuple[tuple, float]:
    """Layers of a network trained by Adam, and the temperature that fits the fifth kept aside best."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside, own = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    z = (x - mean) / scale
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    best, kept = np.inf, [a.copy() for a in p]
    weight = np.where(y == 1, 0.5 / max(y[own].mean(), 1e-3), 0.5 / max(1 - y[own].mean(), 1e-3)) ** 0.5
    for _ in range(epochs):
        for k in range(0, len(own), 128):
            i = rng.permutation(own)[:128] if k == 0 else own[(rng.integers(0, len(own), 128))]
            h = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) * weight[i] / len(i)
            dh = d[:, None] * p[2] * (1 - h * h)
            grads = [z[i].T @ dh + 1e-3 * p[0], dh.sum(0), h.T @ d + 1e-3 * p[2], d.sum()]
            step += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - 3e-3 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        logit = np.tanh(z[aside] @ p[0] + p[1]) @ p[2] + p[3]
        loss = np.mean(np.logaddexp(0, logit) - y[aside] * logit)
        if loss < best:
            best, kept = loss, [np.copy(a) for a in p]
    logit = np.tanh(z[aside] @ kept[0] + kept[1]) @ kept[2] + kept[3]
    grid = np.exp(np.linspace(-1.5, 1.5, 61))
    temperature = grid[int(np.argmin([np.mean(np.logaddexp(0, logit / t) - y[aside] * logit / t) for t in grid]))]
    return (mean, scale, *kept), float(temperature)


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """A model learned from at most ``bound`` labelled rows."""
    tune(docs.sparkSession)
    sample = save(labelled_sample(docs, labels, "quality", bound).select("doc_id", "text", F.col("y").cast("int").alias("y")), "quality-sample")

    def count(batches):
        c: Counter = Counter()

        def flush():
            items = list(c.items())
            for k in range(0, len(items), 20_000):
                part = items[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part]), pa.array([n for _, n in part], pa.int64())], names=["w", "n"])
            c.clear()

        for b in batches:
            for t in columns(b, "text")[0]:
                c.update(set(w.lower() for w in _CORE.findall(t or "")))
                if len(c) > 200_000:  # partial counts, so a task's memory is bounded
                    yield from flush()
        yield from flush()

    counted = sample.select("text").mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    words = {r["w"]: i for i, r in enumerate(counted.where("n >= 3").orderBy(F.desc("n"), "w").limit(VOCABULARY).collect())}

    def contexts(batches):
        index = index_vectors(HASHES, DIM, 1)
        out = np.zeros((len(words), DIM), np.float32)
        for b in batches:
            for t in columns(b, "text")[0]:
                ws = [w.lower() for w in _CORE.findall(t or "")]
                if len(ws) < 2:
                    continue
                r = np.zeros((len(ws) + 4, DIM), np.float32)
                r[2:-2] = index[[zlib.crc32(w.encode("utf-8", "replace")) % HASHES for w in ws]]
                near = r[:-4] + r[1:-3] + r[3:-1] + r[4:]
                at = np.fromiter((words.get(w, -1) for w in ws), np.int64, len(ws))
                order = np.argsort(at, kind="stable")
                order = order[np.searchsorted(at[order], 0) :]
                if len(order):
                    u, first = np.unique(at[order], return_index=True)
                    out[u] += np.add.reduceat(near[order], first)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int32()), pa.array(list(out), pa.list_(pa.float32()))], names=["i", "v"])

    context = np.zeros((len(words), DIM), np.float32)
    if words:
        sums = sample.select("text").mapInArrow(contexts, "i int, v array<float>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[k]).cast("float") for k in range(DIM)]).alias("v"))
        for r in sums.collect():  # at most VOCABULARY rows
            context[r["i"]] = r["v"]
        context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-6
    model = Model(words, context)

    def pooled(batches):
        vectors = Vectors(model.words, model.context)
        for b in batches:
            texts, ys = columns(b, "text", "y")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([vectors.document(t) for t in texts], pa.list_(pa.float32())), pa.array(ys, pa.int32())], names=["doc_id", "v", "y"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(pooled, f"doc_id {kind}, v array<float>, y int").collect()  # at most ``bound`` rows
    rows.sort(key=lambda r: (r["doc_id"], r["v"], r["y"]))  # one order, however they came
    y = np.array([r["y"] for r in rows], float)
    if len(y):
        model.prior = float(y.mean())
    if len(y) >= 10 and 0 < model.prior < 1:
        model.layers, model.temperature = train(np.array([r["v"] for r in rows], float), y)
    return model


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of each row.  One narrow pass."""
    tune(docs.sparkSession)
    picked = select(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY x DIM numbers

    def work(batches):
        m = shared.value
        vectors = Vectors(m.words, m.context)
        for b in batches:
            (texts,) = columns(b, "text")
            x = np.array([vectors.document(t) for t in texts], float).reshape(len(texts), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(x))], names=["doc_id", "score"])

    return picked.mapInArrow(work, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")
