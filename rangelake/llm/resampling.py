"""Target-distribution importance resampling with hashed word features.

A document's weight says how much likelier its features are in a target table than in all documents; a keyed noise
(Gumbel) is added, and the highest scores are drawn, which samples without replacement by the weights.

External sort-count: each batch of texts is written once, as a packed stream of 16-bit buckets and the places where its
documents end.  Counting sorts each stream and takes run lengths, which are summed by bucket in a shuffle.  Only the
counts (one a bucket, at most 65,536) reach the driver.  A second pass over the streams gathers each bucket's gain and
sums it by document with ``np.add.reduceat``; texts are read once.

Ranks: scores are whole numbers, so the histogram of scores is small however many documents there are (a gain lies
within 1000 ln 2^63 of zero either way, the noise between -3,200 and 23,000).  Running sums over it tell which scores
are drawn; documents of one such score are numbered among themselves.

Defined results: a null or empty text has no features, weight 0 and isn't drawn; repeated rows are drawn each by itself
(all of one id have its noise); a null id has the noise of an empty one and comes before others; an empty target gives
every bucket the gain of its smoothed counts; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import raw_texts, save, select, tune

BUCKETS, NGRAMS, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 20
#: Bytes of words: digits, letters in lower case, and all of characters beyond ASCII; others are blanks.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _word_lists(text: bytes | None):
    """The words of a text in slices of bounded size."""
    text = (text or b"").translate(_WORD)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = end if end >= 0 else len(text)
        yield text[at:end].split()
        at = end


def feature_buckets(text: bytes | None, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """The bucket of each run of 1 to ``ngrams`` words of a UTF-8 text, as 16-bit numbers; and its number of words."""
    parts, before, n = [], [], 0
    for words in _word_lists(text):
        n += len(words)
        words = before + words
        for k in range(1, ngrams + 1):
            own = words[max(0, len(before) - k + 1) :]  # runs that end in this slice
            runs = own if k == 1 else [b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)]
            parts.append((np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % buckets).astype("<u2"))
        before = words[len(words) - ngrams + 1 :] if ngrams > 1 else []
    return np.concatenate(parts) if parts else np.zeros(0, "<u2"), n


def bucket_streams(docs: DataFrame, id_col: str, text_col: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """A row a batch of texts, kept in the shared folder: ids, where each one's features end, its words, and the packed stream."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket has to fit 16 bits")
    tune(docs.sparkSession)
    picked = select(docs, doc_id=id_col, text=text_col)
    kind = picked.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            found = [feature_buckets(t, ngrams, buckets) for t in raw_texts(b)]
            if not found:
                continue
            ends = np.cumsum([len(f) for f, _ in found], dtype=np.int64)
            ids = b.column(0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([ends.astype("<i8").tobytes()], pa.binary()),
                    pa.array([np.array([n for _, n in found], "<i8").tobytes()], pa.binary()),
                    pa.array([np.concatenate([f for f, _ in found]).tobytes()], pa.binary()),
                ],
                names=["ids", "ends", "words", "stream"],
            )

    return save(picked.mapInArrow(work, f"ids array<{kind}>, ends binary, words binary, stream binary"), "streams")


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of the streams lie in it; buckets without any have no row."""

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                stream = np.sort(np.frombuffer(raw, "<u2"))
                if len(stream):
                    first = np.flatnonzero(np.concatenate([[True], stream[1:] != stream[:-1]]))
                    total[stream[first]] += np.diff(first, append=len(stream))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    return streams.select("stream").mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from ``bucket_counts`` of both tables."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, counts in ((s, source), (t, target)):
        for r in counts.collect():  # one row a bucket
            into[r["bucket"]] = r["n"]
    all_s, all_t = s.sum() + buckets, t.sum() + buckets
    return np.array([math.floor(1000 * math.log((y + 1) * all_s / ((x + 1) * all_t))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weigh(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, n_words, weight of every document of the streams."""
    kind = streams.schema["ids"].dataType.elementType.simpleString()
    gain_ = streams.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def work(batches):
        for b in batches:
            ids, ends, words, stream = (b.column(b.schema.get_field_index(c)) for c in ("ids", "ends", "words", "stream"))
            for i in range(len(b)):
                end = np.frombuffer(ends[i].as_py(), "<i8")
                size = np.diff(end, prepend=0)
                total, some = np.zeros(len(end), np.int64), np.flatnonzero(size)
                if len(some):
                    total[some] = np.add.reduceat(gain_.value[np.frombuffer(stream[i].as_py(), "<u2")], (end - size)[some])
                weight = total // np.maximum(size, 1)  # floors go down
                yield pa.RecordBatch.from_arrays([ids[i].values, pa.array(size), pa.array(np.frombuffer(words[i].as_py(), "<i8")), pa.array(weight)], names=["doc_id", "n_features", "n_words", "weight"])

    return streams.mapInArrow(work, f"doc_id {kind}, n_features bigint, n_words bigint, weight bigint")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``weighed`` with score and rank: 1, 2, 3... of the drawn ``percent`` of documents of enough words, null of the others."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = save(weighed.withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least_words
    n = scored.where(able).count() * percent // 100
    per = scored.where(able).groupBy("score").agg(F.count("*").alias("here"))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # over the scores there are, a bounded number
    some = per.withColumn("higher", F.coalesce(F.sum("here").over(higher), F.lit(0))).where(F.col("higher") < n).select("score", "higher")
    met = scored.join(F.broadcast(some), "score", "left").withColumn("may", able & F.col("higher").isNotNull())
    order = Window.partitionBy("score").orderBy("doc_id", "n_features")
    rank = F.col("higher") + F.row_number().over(order)
    names = ["doc_id", "n_features", "n_words", "weight", "score"]
    drawn = met.where("may").select(*names, rank.alias("rank")).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return drawn.unionByName(met.where("not may").select(*names, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", target_id: str = "item_id", text_col: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank of every row of ``docs``, drawn towards ``target``."""
    streams = bucket_streams(docs, id_col, text_col, ngrams, buckets)
    aim = bucket_streams(target, target_id, text_col, ngrams, buckets)
    return draw(weigh(streams, gains(bucket_counts(streams, buckets), bucket_counts(aim, buckets), buckets)), percent, least_words, seed)
