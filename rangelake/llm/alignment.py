"""Alignment of two tokenizers' tokens over the bytes that both cover.

1. The owner of a byte is the token that it belongs to.  ``np.repeat`` of token numbers over the tokens' byte lengths
   gives the owners of all bytes, once for vocabulary A and once for B.  Where either owner changes, a pair of owners
   begins: these pairs are the overlaps (links).  Where both change at once, both texts of tokens are cut: between two
   cuts lies a group.
2. A link's count is the number of documents that hold its pair of ids linked.  Tasks keep their texts in *chunks*; a
   chunk's distinct pairs are counted once, whatever number of its documents holds them, and only they are shuffled.
   Counts go back to the chunk, and each document adds up its own.

Texts are encoded once and read once; links stay with their chunk as numbers.  Both vocabularies end a token before any
single blank between two visible characters, so texts are cut there into units, and a task encodes each distinct unit
once.  A is a byte-level vocabulary of the tokenizers library that sees the text after one blank, B a sentencepiece
model that adds this blank itself; both give every id.

Defined results: a null or empty text, and one whose tokens' bytes aren't those of the text in either vocabulary, has no
tokens (zeros, groups ''); repeated rows count as documents of their own; ids may be null.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _planes, _unplanes
from .common import columns, save, select, tune

#: Characters of a chunk, bytes whose owners are laid out at once, and distinct units a worker remembers.
CHUNK, SLICE, MEMORY = 8_000_000, 1 << 21, 400_000
#: Here both vocabularies end a token, whatever stands around.
_CUT = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones for themselves, others by 256 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Both:
    """Two vocabularies, and the tokens of the units met so far."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.no_truncation(), self.a.no_padding()
        self.a.encode_special_tokens = True
        byte, vocab = _byte_of(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: An id's text by vocabulary, id and whether it ends its group's part.
        self.words = [w for i in range(len(self.bytes_a)) for w in (f"{i},", f"{i}|")] + [w for i in range(len(self.bytes_b)) for w in (f"{i},", f"{i};")]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.tokens = [_Lists(), _Lists()]

    def units(self, texts: list[str]) -> np.ndarray:
        """The numbers of units; new ones are encoded."""
        new = [u for u in dict.fromkeys(texts) if u not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            ids_a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in new], add_special_tokens=False)]
            ids_b = self.b.encode(new, num_threads=1)
            good = [b"".join([self.bytes_a[i] for i in x]) == (own := b" " + u.encode()) == b"".join([self.bytes_b[i] for i in y]) for u, x, y in zip(new, ids_a, ids_b, strict=True)]
            self.good = np.concatenate([self.good, good])
            self.tokens[0].add(ids_a), self.tokens[1].add(ids_b)
        return np.fromiter(map(self.number.__getitem__, texts), np.int64, len(texts))


class _Lists:
    """Lists of numbers, end to end."""

    def __init__(self):
        self.flat, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lists: list[list[int]]) -> None:
        size = np.array([len(x) for x in lists], np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, np.array([i for x in lists for i in x], np.int64)])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists' numbers one after the other, and each one's size."""
        n = self.size[which]
        return self.flat[np.arange(n.sum()) + np.repeat(self.start[which] - (np.cumsum(n) - n), n)], n


@functools.cache
def load(a: str, b: str) -> Both:
    """One per Python worker and pair of vocabularies."""
    return Both(a, b)


class _Document:
    """What is known of one text: sums, its groups' text or digest so far, and its linked pairs."""

    def __init__(self, keep: bool):
        self.n = np.zeros(4, np.int64)
        self.text, self.sha, self.some = ([] if keep else None), hashlib.sha256(), False

    def add(self, n: np.ndarray, groups: str) -> None:
        self.n += n
        if self.text is not None:
            self.text.append(groups)
        else:
            self.sha.update((";" if self.some else "").encode() + groups[:-1].encode())
        self.some = True

    def groups(self) -> str:
        return "" if not self.some else "".join(self.text)[:-1] if self.text is not None else self.sha.hexdigest()


def _owners(both: Both, unit: np.ndarray, doc: np.ndarray, docs: list[_Document]) -> np.ndarray:
    """Adds the tokens of units to their documents; returns the linked pairs as doc * all pairs + pair, one a link."""
    (ids_a, n_a), (ids_b, n_b) = both.tokens[0].take(unit), both.tokens[1].take(unit)
    own_a = np.repeat(np.arange(len(ids_a)), both.len_a[ids_a])
    own_b = np.repeat(np.arange(len(ids_b)), both.len_b[ids_b])
    new_a, new_b = (np.concatenate([[True], x[1:] != x[:-1]]) for x in (own_a, own_b))
    start = np.flatnonzero(new_a | new_b)
    link_a, link_b = own_a[start], own_b[start]
    cut = np.flatnonzero(new_a & new_b)
    first_a, first_b = own_a[cut], own_b[cut]
    # Tokens in the order of the groups' text: those of A, then those of B; each marked where it ends its part.
    size_a, size_b = np.diff(first_a, append=len(ids_a)), np.diff(first_b, append=len(ids_b))
    end_a, end_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    end_a[first_a + size_a - 1] = end_b[first_b + size_b - 1] = True
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    code[np.arange(len(ids_a)) + np.repeat(first_b, size_a)] = 2 * ids_a + end_a
    code[np.arange(len(ids_b)) + np.repeat(first_a + size_a, size_b)] = 2 * (len(both.bytes_a) + ids_b) + end_b
    doc_a = np.repeat(doc, n_a)
    here = doc[np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))]
    count = lambda x: np.searchsorted(x, here, side="right") - np.searchsorted(x, here)
    n = np.stack([count(doc_a), count(np.repeat(doc, n_b)), count(doc_a[first_a]), count(doc_a[link_a])], axis=1)
    ends = np.cumsum(n[:, 0] + n[:, 1]).tolist()
    for d, own, a, b in zip(here.tolist(), n, [0, *ends[:-1]], ends, strict=True):
        docs[d].add(own, "".join(map(both.words.__getitem__, code[a:b].tolist())))
    pairs = len(both.bytes_a) * len(both.bytes_b)
    return doc_a[link_a] * pairs + ids_a[link_a] * len(both.bytes_b) + ids_b[link_b]


def _batch(both: Both, texts: list[str | None], keep: bool) -> tuple[list[_Document], np.ndarray, np.ndarray]:
    """The documents of a batch; their distinct linked pairs as (number of document) * all pairs + pair, and how often."""
    docs = [_Document(keep) for _ in texts]
    if len(both.number) > MEMORY:
        both.forget()
    cut = [_CUT.split(t) if t else [] for t in texts]
    unit = both.units([u for us in cut for u in us])
    doc = np.repeat(np.arange(len(texts)), [len(us) for us in cut])
    bad = np.unique(doc[~both.good[unit]]) if len(unit) else doc
    if len(bad):
        fine = ~np.isin(doc, bad)
        unit, doc = unit[fine], doc[fine]
    size = np.cumsum(both.tokens[0].size[unit]) * 4 if len(unit) else unit  # about the bytes
    found, times, at = [], [], 0
    while at < len(unit):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE)))
        key, n = np.unique(_owners(both, unit[at:end], doc[at:end], docs), return_counts=True)
        found.append(key), times.append(n)
        at = end
    if not found:
        return docs, np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, which = np.unique(np.concatenate(found), return_inverse=True)
    return docs, key, np.bincount(which, np.concatenate(times)).astype(np.int64)


_OUT = pa.schema(
    [("is_doc", pa.bool_()), ("chunk", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("at", pa.binary()), ("times", pa.binary())]
)


def _chunk_rows(chunk: int, held: list, ids: pa.DataType, all_pairs: int):
    """A chunk's rows: one a document, with the places of its pairs in the chunk's table, and that table."""
    pairs = np.concatenate([key % all_pairs for _, _, key, _ in held])
    table, where, n = np.unique(pairs, return_inverse=True, return_counts=True)
    at = 0
    for keys, docs, key, times in held:
        ends = np.searchsorted(key // all_pairs, np.arange(len(docs)), side="right").tolist()
        cut = list(zip([0, *ends[:-1]], ends, strict=True))
        n_ = np.array([d.n for d in docs], np.int64).reshape(-1, 4)
        made = [pa.array([True] * len(docs)), pa.array([chunk] * len(docs), pa.int64()), *[pa.array(n_[:, k]) for k in range(4)], pa.array([d.groups() for d in docs], pa.string())]
        made += [pa.array([_planes(where[at + a : at + b]) for a, b in cut], pa.binary()), pa.array([_planes(times[a:b]) for a, b in cut], pa.binary())]
        yield pa.RecordBatch.from_arrays([keys, *made], names=["doc_id", *_OUT.names])
        at += len(key)
    for k in range(0, len(table), 1 << 20):
        raw = [table[k : k + (1 << 20)].astype("<i8").tobytes(), _planes(n[k : k + (1 << 20)])]
        row = [False, chunk, None, None, None, k, None, *raw]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, ids), *[pa.array([v], f.type) for v, f in zip(row, _OUT, strict=True)]], names=["doc_id", *_OUT.names])


def align_documents(docs: DataFrame, vocabulary_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text", emit: str = "digests") -> tuple[DataFrame, DataFrame]:
    """Per row doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups; and the pairs a, b, n (documents), is_best.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` (``emit='groups'``) or, as ``groups_sha256``, its digest.
    """
    tune(docs.sparkSession)
    picked = select(docs, doc_id=id_col, text=text_col)
    kind = picked.schema["doc_id"].dataType.simpleString()
    keep = emit == "groups"
    both = load(vocabulary_a, model_b)
    size_b, all_pairs = len(both.bytes_b), len(both.bytes_a) * len(both.bytes_b)

    def work(batches):
        both = load(vocabulary_a, model_b)
        task = TaskContext.get()
        name, number, held, n, ids = (task.partitionId() if task else 0) << 32, 0, [], 0, None
        for b in batches:
            (texts,) = columns(b, "text")
            ids = b.column(0).type
            held.append((b.column(0), *_batch(both, texts, keep)))
            n += sum(len(t or "") for t in texts)
            if n >= CHUNK:
                yield from _chunk_rows(name + number, held, ids, all_pairs)
                number, held, n = number + 1, [], 0
        if held:
            yield from _chunk_rows(name + number, held, ids, all_pairs)

    named = "is_doc boolean, chunk bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, at binary, times binary"
    made = save(picked.mapInArrow(work, f"doc_id {kind}, {named}"), "aligned")

    def unpack(batches):
        for b in batches:
            for chunk, first, pairs, n in zip(*columns(b, "chunk", "n_links", "at", "times"), strict=True):
                pairs = np.frombuffer(pairs, "<i8")
                at = np.arange(first, first + len(pairs), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk)), pa.array(at), pa.array(pairs), pa.array(_unplanes(n).astype(np.int64))], names=["chunk", "at", "pair", "n"])

    tables = made.where("not is_doc").select("chunk", "n_links", "at", "times").mapInArrow(unpack, "chunk bigint, at int, pair bigint, n bigint")
    a = F.floor(F.col("pair") / size_b).cast("int")
    counts = save(tables.groupBy("pair").agg(F.sum("n").alias("n")), "pairs").withColumn("a", a)
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most one row an id of A
    pairs = counts.join(F.broadcast(best), "a").select("pair", "a", (F.col("pair") % size_b).cast("int").alias("b"), "n", (F.col("n") == F.col("most")).alias("is_best"))
    met = tables.select("chunk", "at", "pair").join(pairs.select("pair", "n", "is_best"), "pair").select("chunk", "at", "n", "is_best")

    def assemble(docs_: pa.Table, table: pa.Table) -> pa.Table:
        n, is_best = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
        at = table.column("at").to_numpy()
        n[at], is_best[at] = table.column("n").to_numpy(), table.column("is_best").to_numpy()
        sums, bests = [], []
        for raw, times in zip(docs_.column("at"), docs_.column("times"), strict=True):
            own, k = _unplanes(raw.as_py()), _unplanes(times.as_py()).astype(np.int64)
            sums.append(int((n[own] * k).sum()))
            bests.append(int((is_best[own] * k).sum()))
        keep_ = docs_.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(bests, pa.int64()))
        return keep_.append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups", docs_.column("groups"))

    rows = made.where("is_doc").drop("is_doc")
    out = rows.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(assemble, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")
    return out if keep else out.withColumnRenamed("groups", "groups_sha256"), pairs.select("a", "b", "n", "is_best")
