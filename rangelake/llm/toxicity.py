"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digits and signs that stand for letters, letters spaced
out one by one), matched by one Aho-Corasick automaton of word stems, whole words and exception phrases, and the weights of
the hits that no exception covers are normalised by length and turned into a probability.

The lexicon's weights are log odds learned from labelled rows: of words and word beginnings in
toxic against other documents, near copies counted once; the weight of a seed word is a prior that the
documents with it correct.  Exception phrases are learned likewise, in any language: a listed word with
the word before or behind it, where that surely speaks against toxicity.  ``SAMPLE`` bounds the labelled rows used
(the ones of lowest hash, whatever the size of the table) and ``MOST_STEMS`` the stems and phrases learned from
them; everything else covers all rows.

Defined results: null and empty texts have no hit and get the score of such; repeated rows are
scored each by itself; without usable labels the seed lexicon and fixed coefficients are used.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, save, select, tune

SAMPLE, MOST_STEMS = 16_000, 2_000

#: Words that count without any labels, with their weight.
SEED = dict.fromkeys("idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile bastard bitch asshole dumbass retard filth vermin".split(), 4.0)
#: Phrases in which a listed word is no insult.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash bags", "take out the trash", "taking out the trash", "clown fish", "circus clown", "pond scum", "soap scum", "loser bracket", "losers bracket", "sore loser rule", "filth pit")
#: Latin look-alikes of other scripts, and signs for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝвнмткαεοριτυνκχηωɑıⅼɡ", "aeopcyxijshdqwbhmtkaeopituvkxnwailg", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"}

_MIXED = re.compile(r"[^\W\d_][0-9@$!€]+(?=[^\W\d_])|(?<![\w@$!€])[0-9@$€](?=[^\W\d_])|[^\W\d_][0-9](?![\w@$!€])")
_LONG_RUN = re.compile(r"([^\W\d_])\1{2,}")
_SPACED = re.compile(r"(?<![^\W_])[^\W_]([ .\-_*])[^\W_](?:\1[^\W_])+(?:\1[^\W_](?![^\W_]))")
_HIDDEN = re.compile("[­​-‏⁠﻿̀-ͯ]")


class _Fold(dict):
    """Code point -> folded letter or a blank; filled on demand."""

    def __missing__(self, point: int) -> str:
        c = chr(point).lower()
        if c in HOMOGLYPHS:
            out = HOMOGLYPHS[c]
        else:
            base = unicodedata.normalize("NFKD", c)
            out = "".join(x for x in base if x.isalpha() and not unicodedata.combining(x)) or " "
            out = "".join(HOMOGLYPHS.get(x, x) for x in out)
        self[point] = out
        return out


_FOLD = _Fold()


def _unleet(text: str, one: str) -> str:
    return _MIXED.sub(lambda m: "".join(one if c == "1" else SIGNS.get(c, c) for c in m[0]), text)


def fold(text: str | None) -> list[str]:
    """The folded text between blanks; two readings where a 1 may be an i or an l."""
    if not text:
        return [" "]
    if not text.isascii() and _HIDDEN.search(text):
        text = _HIDDEN.sub("", text)
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: m[0].replace(m[1], ""), text)
    readings = [text]
    if _MIXED.search(text):
        readings = list(dict.fromkeys(_unleet(text, one) for one in "il"))
    out = [f" {r.translate(_FOLD)} " for r in readings]
    return [_LONG_RUN.sub(r"\1", r) if _LONG_RUN.search(r) else r for r in out]


@dataclass
class Lexicon:
    """stems: word beginnings, or whole words if they end with a blank, and their weights."""

    stems: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-3.0, 2.0, 2.0)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for stem in self.stems:
                self._automaton.add_word(f" {stem}", (len(stem) + 1, stem))
            for phrase in self.exceptions:
                self._automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, stem) in the folded text; of stems at one place the heaviest; exceptions taken away."""
        return self._read(text)[1]

    def phrases(self, text: str | None) -> set[str]:
        """Each word hit with the word before it, and with the one behind it, where only a blank is between."""
        reading, hits = self._read(text)
        out = set()
        for start, _, _ in hits:
            end = reading.index(" ", start + 1)
            before, behind = reading.rfind(" ", 0, start), reading.find(" ", end + 1)
            if 0 <= before < start - 1:
                out.add(reading[before + 1 : end])
            if behind > end + 1:
                out.add(reading[start + 1 : behind])
        return {p for p in out if len(p) <= 64}

    def _read(self, text: str | None) -> tuple[str, list[tuple[int, int, str]]]:
        """The reading of greatest weight and its hits."""
        best: list[tuple[int, int, str]] = []
        chosen = " "
        if not self.stems:
            return chosen, best
        weight = lambda own: sum(self.stems[s] for *_, s in own)
        for reading in fold(text):
            found: dict[int, tuple[int, str]] = {}
            skip = []
            for end, (n, stem) in self.automaton().iter(reading):
                start = end - n + 1
                if stem is None:
                    skip.append((start, end))
                elif start not in found or self.stems[stem] > self.stems[found[start][1]]:
                    found[start] = (end, stem)
            skip.sort()
            begins, reach = [a for a, _ in skip], list(accumulate((b for _, b in skip), max))
            covered = lambda s: (k := bisect_right(begins, s)) and s + 1 < reach[k - 1]  # noqa: E731, B023
            kept = [(s, e, w) for s, (e, w) in found.items() if not covered(s)]
            if weight(kept) > weight(best):
                chosen, best = reading, kept
        return chosen, best

    def features(self, text: str | None) -> tuple[float, float]:
        """The summed weight of the hits (the same stem again says less), normalised by the root of the length, and its logarithm."""
        counts = Counter(stem for *_, stem in self.hits(text))
        total = sum(self.stems[stem] * math.log2(1 + n) for stem, n in counts.items())
        if not total:
            return 0.0, 0.0
        return total / math.sqrt(50 + len(text.split())), math.log1p(total)

    def score(self, text: str | None) -> float:
        b, u, v = self.coefficients
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, b + u * x + v * y))))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.02, rounds: int = 40) -> np.ndarray:
    """Newton's method; the intercept isn't penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [l2] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str) -> F.Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """doc_id, text, y of at most ``bound`` labelled training rows, those of lowest hash; of labels at odds the lower one counts."""
    ids = select(labels, doc_id="doc_id", y=label).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id"))
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return select(docs, doc_id="doc_id", text="text").join(F.broadcast(ids), "doc_id")  # ``bound`` rows of two numbers


def _copy_key(text: str | None) -> int:
    """The least hash of the text's five-word runs: the same for nearly all near copies."""
    ws = (text or "").lower().split()
    return min((zlib.crc32(" ".join(ws[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(ws) - 4))), default=0)


def _word_features(text: str | None) -> set[str]:
    out: set[str] = set()
    for w in set(fold(text)[0].split()):
        if len(w) >= 3:
            out.add(f"{w} ")
        out.update(w[:k] for k in range(4, min(len(w), 7) + 1))
    return out


def choose_stems(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Of features (text, toxic documents, other documents) those that surely speak for toxicity, with careful log odds.

    A beginning gives way to the longer one that has nearly all of its documents.
    """
    support = {f: a for f, a, _ in counts}
    out = {}
    for f, a, b in counts:
        # As few toxic and as many other documents as these counts may well stand for.
        low, high = a - 2 * math.sqrt(a), b + 2 * math.sqrt(b) + 2
        if low > 0 and (weight := math.log(low / toxic) - math.log(high / clean)) > 0.5:
            out[f] = (min(weight, 8.0), a)
    longer = {f[:-1] for f in out if support[f] >= 0.8 * support.get(f[:-1], 10**12)}
    return {f: w for f, (w, _) in out.items() if f not in longer}


def seed_weight(weight: float, a: int, b: int, toxic: int, clean: int) -> float:
    """Log odds of a word in ``a`` of the toxic and ``b`` of the other documents, which are ``weight`` where it is in none."""
    return min(weight, math.log((a + 1) / toxic) - math.log(b / clean + math.exp(-weight) / toxic))


def choose_exceptions(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    """Of phrases (text, toxic documents, other documents) those that surely speak against toxicity, the commonest first."""
    out = []
    for f, a, b in counts:
        high, low = a + 2 * math.sqrt(a) + 2, b - 2 * math.sqrt(b)
        if low > 0 and math.log(low / clean) - math.log(high / toxic) > 0.5:
            out.append((-b, f))
    return [f for _, f in sorted(out)]


def _counted(sample: DataFrame, features) -> DataFrame:
    """f, a, b: in how many toxic and other documents of the sample each feature is."""

    def count(batches):
        by: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            names = list(by[0].keys() | by[1].keys())
            for k in range(0, len(names), 20_000):
                part = names[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([by[1][f] for f in part], pa.int64()), pa.array([by[0][f] for f in part], pa.int64())], names=["f", "a", "b"])
            by[0].clear(), by[1].clear()

        for b in batches:
            for t, y in zip(*columns(b, "text", "y"), strict=True):
                by[y].update(features(t))
                if len(by[0]) + len(by[1]) > 200_000:  # partial counts, so a task's memory is bounded
                    yield from flush()
        yield from flush()

    return sample.mapInArrow(count, "f string, a bigint, b bigint").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Lexicon:
    """A lexicon learned from at most ``bound`` labelled rows."""
    tune(docs.sparkSession)

    def keyed(batches):
        for b in batches:
            (texts,) = columns(b, "text")
            yield pa.RecordBatch.from_arrays([pa.array([_copy_key(t) for t in texts], pa.int64()), b.column(1), b.column(2).cast(pa.int32())], names=["key", "text", "y"])

    sample = labelled_sample(docs, labels, "toxic", bound).select("doc_id", "text", "y").mapInArrow(keyed, "key bigint, text string, y int")
    sample = save(sample.groupBy("key", "y").agg(F.min("text").alias("text")), "toxic-sample")  # of near copies always the same one
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if toxic < 4 or not clean:
        return Lexicon({f"{w} ": x for w, x in SEED.items()})

    seeds = [f"{w} " for w in SEED]
    counted = _counted(sample, _word_features).withColumn("seed", F.col("f").isin(seeds))
    ratio = (F.col("a") + 0.5) / (toxic + 1) / ((F.col("b") + 0.5) / (clean + 1))
    likely = (F.col("a") >= 4) & (ratio > math.e)
    found = counted.where(likely | F.col("seed")).orderBy(F.desc("seed"), F.desc(F.col("a") * F.log(ratio)), "f").limit(20 * MOST_STEMS).collect()
    stems = choose_stems([(r["f"], r["a"], r["b"]) for r in found], toxic, clean)
    stems = dict(sorted(stems.items(), key=lambda s: -s[1])[:MOST_STEMS])
    seen = {r["f"]: (r["a"], r["b"]) for r in found if r["seed"]}
    prior = {f: seed_weight(SEED[f[:-1]], *seen.get(f, (0, 0)), toxic, clean) for f in seeds}
    stems = {f: w for f, w in prior.items() if w > 0} | stems
    lexicon = Lexicon(stems)
    against = _counted(sample, lexicon.phrases).where(F.col("b") > 4).orderBy(F.desc("b"), "a", "f").limit(20 * MOST_STEMS).collect()
    lexicon = Lexicon(stems, EXCEPTIONS + tuple(choose_exceptions([(r["f"], r["a"], r["b"]) for r in against], toxic, clean)[:MOST_STEMS]))

    def featured(batches):
        for b in batches:
            texts, ys = columns(b, "text", "y")
            f = [lexicon.features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in f]), pa.array([x for _, x in f]), pa.array(ys, pa.int32())], names=["x", "v", "y"])

    rows = sample.mapInArrow(featured, "x double, v double, y int").toPandas()  # at most ``bound`` rows of three numbers
    w = fit_logistic(rows[["x", "v"]].to_numpy(), rows["y"].to_numpy())
    if w[1] + w[2] > 0:
        lexicon.coefficients = tuple(float(x) for x in w)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of each row.  One narrow pass."""
    tune(docs.sparkSession)
    picked = select(docs, doc_id=id_col, text=text_col)

    def work(batches):
        for b in batches:
            (texts,) = columns(b, "text")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lexicon.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    return picked.mapInArrow(work, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    tune(docs.sparkSession)
    i = docs.columns.index(text_col)

    def work(batches):
        for b in batches:
            yield b.filter(pa.array([lexicon.score(t) < threshold for t in b.column(i).to_pylist()]))

    return docs.mapInArrow(work, docs.schema)
