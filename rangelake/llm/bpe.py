"""BPE encoding and decoding by a distinct-word table.

1. Each task splits its texts into units and replaces them by numbers of a dictionary of its
   *chunk* (about ``CHUNK`` characters of text).  The chunks' dictionaries are dealt by word.
2. Each distinct word is encoded once, for all chunks that hold it, whatever number they are.
3. The ids go back to the chunk and are joined to the documents' numbers by position; pieces of
   the decoded text come from an id-to-piece table (bounded by the vocabulary), joined to each
   distinct word of a chunk.  A vocabulary with a decoder of its own decodes whole texts by it.

Texts are read twice and never shuffled: documents move as numbers, about 1.5 bytes a word.  So
the table has to give the same rows in the same partitions each time: files do (``stored``),
any other table is written down first.  A chunk is named by its place (partition and number) and
a digest of its dictionary, so chunks of one content are apart, and a chunk that was not read
alike twice is an error and never a wrong result.

Defined results: a null text is empty (no ids, empty decoded text); ids may be null or repeated.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, save, select, tune
from .wordbpe import WordBpe, load

CHUNK = 24_000_000


class _Numbers(dict):
    """unit -> number in order of first use, so frequent units get small numbers."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


def _planes(values: np.ndarray) -> bytes:
    """uint32 as byte planes: high bytes are mostly alike and compress away in a shuffle."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _chunks(batches, bpe: WordBpe, keep: bool):
    """(dictionary, rows) of each chunk; rows: (key array, index, numbers), only if ``keep``."""
    numbers, held, n = _Numbers(), [], 0
    for b in batches:
        (texts,) = columns(b, "text")
        seqs = []
        for t in texts:
            us = bpe.units(t)
            seqs.append(np.fromiter(map(numbers.__getitem__, us), "<u4", len(us)))
            n += len(t or "")
        if keep:
            held.append((b.column(0), seqs))
        if n >= CHUNK:
            yield numbers, held
            numbers, held, n = _Numbers(), [], 0
    yield numbers, held


def _name(numbers: dict, number: int) -> int:
    """Of a task's chunk: its partition, its number there and its dictionary."""
    task = TaskContext.get()
    what = f"{task.partitionId() if task else 0} {number}\n" + "\n".join(numbers)
    return int.from_bytes(hashlib.blake2b(what.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", emit: str = "digests", stored: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens and, by ``emit``, either ids (array) and decoded (string), or their SHA-256 digests.

    ``stored`` says that ``docs`` is read from files with nothing but columns chosen and rows filtered since.
    """
    spark = docs.sparkSession
    tune(spark)
    picked = select(docs, doc_id=id_col, text=text_col)
    if not stored:
        picked = save(picked, "texts")
    kind = picked.schema["doc_id"].dataType.simpleString()
    # Each chunk holds a word at most once, some 60 words new to it for each document.
    buckets = max(64, picked.count() * 60 // 2_000_000)

    def dictionaries(batches):
        bpe = load(vocabulary)
        for number, (numbers, _) in enumerate(_chunks(batches, bpe, keep=False)):
            if not numbers:
                continue
            name, parts = _name(numbers, number), {}
            for unit, i in numbers.items():
                raw = unit.encode("utf-8", "surrogatepass")
                w, at = parts.setdefault(zlib.crc32(raw) % buckets, ([], []))
                w.append(raw)
                at.append(i)
            for bucket, (w, at) in parts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([name], pa.int64()), pa.array([b"\n".join(w)], pa.binary()), pa.array([_planes(np.diff(np.array(at, np.int64), prepend=0))], pa.binary())],
                    names=["bucket", "chunk", "words", "at"],
                )

    def encode(table: pa.Table) -> pa.Table:
        """All chunks' words of a bucket: each distinct one is encoded once."""
        lists = [raw.as_py().decode("utf-8", "surrogatepass").split("\n") for raw in table.column("words")]
        distinct = list(set().union(*lists))
        bpe = load(vocabulary)
        ids = dict(zip(distinct, bpe.encode_units(distinct), strict=True))
        lengths, values = [], []
        for ws in lists:
            own = [ids[w] for w in ws]
            lengths.append(_planes(np.array([len(x) // 4 for x in own])))
            values.append(_planes(np.frombuffer(b"".join(own), "<u4")))
        return pa.table({"chunk": table.column("chunk").combine_chunks(), "at": table.column("at").combine_chunks(), "lengths": pa.array(lengths, pa.binary()), "ids": pa.array(values, pa.binary())})

    def numbered(batches):
        bpe = load(vocabulary)
        for number, (numbers, held) in enumerate(_chunks(batches, bpe, keep=True)):
            name = _name(numbers, number)
            for keys, seqs in held:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(seqs), pa.int64()), keys, pa.array([_planes(s) for s in seqs], pa.binary())], names=["chunk", "doc_id", "seq"])

    full = emit != "digests"
    out_type = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if full else [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def assemble(docs_: pa.Table, words: pa.Table) -> pa.Table:
        bpe = load(vocabulary)
        vocab = bpe.tok.get_vocab()
        piece = [b""] * (max(vocab.values()) + 1)  # the id-to-piece table
        for t, i in vocab.items():
            piece[i] = t.encode()
        number = [str(i).encode() for i in range(len(piece))]
        n_units = max((int(_unplanes(raw.as_py()).astype(np.int64).sum()) + 1 for raw in words.column("at")), default=0)
        ids: list = [None] * n_units
        for at, lengths, values in zip(words.column("at"), words.column("lengths"), words.column("ids"), strict=True):
            place = np.cumsum(_unplanes(at.as_py()).astype(np.int64)).tolist()
            cuts = np.cumsum(_unplanes(lengths.as_py()).astype(np.int64)).tolist()
            flat = _unplanes(values.as_py()).tolist()
            for p, a, b in zip(place, [0, *cuts[:-1]], cuts, strict=True):
                ids[p] = flat[a:b]
        size = np.array([len(x) for x in ids], np.int64)
        as_ids = None if full else [b" ".join([number[i] for i in x]) for x in ids]
        as_text = [b" ".join([piece[i] for i in x]) for x in ids]
        n, first, second = [], [], []
        for raw in docs_.column("seq"):
            seq = _unplanes(raw.as_py())
            if len(seq) and (not n_units or int(seq.max()) >= n_units):
                raise RuntimeError("a chunk's dictionary is missing: its rows were not read alike twice")
            n.append(int(size[seq].sum()) if len(seq) else 0)
            seq = seq.tolist()
            if bpe.tok.decoder is None:
                text = b" ".join([as_text[k] for k in seq])
            else:
                text = bpe.tok.decode([i for k in seq for i in ids[k]], skip_special_tokens=False).encode()
            if full:
                first.append([i for k in seq for i in ids[k]])
                second.append(text.decode())
            else:
                first.append(hashlib.sha256(b" ".join([as_ids[k] for k in seq])).hexdigest())
                second.append(hashlib.sha256(text).hexdigest())
        return pa.Table.from_arrays([docs_.column("doc_id"), *[pa.array(c, f.type) for c, f in zip((n, first, second), out_type, strict=True)]], names=["doc_id", *out_type.names])

    table = picked.select("text").mapInArrow(dictionaries, "bucket int, chunk bigint, words binary, at binary").groupBy("bucket").applyInArrow(encode, "chunk bigint, at binary, lengths binary, ids binary")
    sequences = picked.mapInArrow(numbered, f"chunk bigint, doc_id {kind}, seq binary")
    rest = "ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string"
    return sequences.groupBy("chunk").cogroup(table.groupBy("chunk")).applyInArrow(assemble, f"doc_id {kind}, n_tokens bigint, {rest}")
