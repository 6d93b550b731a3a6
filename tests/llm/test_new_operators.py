"""Token alignment, importance resampling and SimHash against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rangelake.llm import alignment, queries, resampling, simhash

A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  two  blanks ", "plain words of a text", "a<|endoftext|>b </s> <s>", "low ▁ mark", "tab\tnew\nline\r\n\x0b\x0c", "naïve café — „quoted“",
    "日本語のテキスト と 英語", "🙂 emoji🙂🙂 x", "é combining e ́x", " nbsp   b  c", "x" * 3000, "ﬁ ligature ½ ①", "it's we'll I'M", "123 4567 89.5 1 2 3", "a b \x00 c \x7f", "٣٤ عربى", "a  b   c", "end ",
]
IDS = "doc_id BIGINT, text STRING, rank INT, chunk STRING, fp INT, score STRING, `a.b` INT"


def table(spark, rows):
    """With further columns whose names are those of the operators' own."""
    return spark.createDataFrame([(i, t, 1, "c", 2, "s", 3) for i, t in rows], IDS)


# token alignment


@pytest.fixture(scope="module")
def library():
    both = alignment.Both(A, B)
    return both.a, both.b


def plain_alignment(tok, model, text):
    """(A ids, B ids, groups, links) by byte ranges."""
    byte = alignment._byte_of()
    if not text:
        return [], [], [], []
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    own = [[bytes(byte[c] for c in tok.id_to_token(i)) for i in a], [piece(i) for i in b]]
    if any(b"".join(x) != (" " + text).encode() for x in own):
        return [], [], [], []
    spans = [[(e - len(t), e) for t, e in zip(x, itertools.accumulate(map(len, x)), strict=True)] for x in own]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups = [([i for i, (s, e) in zip(a, spans[0], strict=True) if lo <= s and e <= hi], [i for i, (s, e) in zip(b, spans[1], strict=True) if lo <= s and e <= hi]) for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True)]
    links = [(i, j) for i, (s, e) in zip(a, spans[0], strict=True) for j, (u, v) in zip(b, spans[1], strict=True) if s < v and u < e]
    return a, b, groups, links


def written(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def test_alignment_of_odd_texts(spark, library):
    rows = list(enumerate([*ODD, "plain words of a text", "plain words again"])) + [(None, "plain"), (4, "plain words of a text")]
    out, pairs = alignment.align_documents(table(spark, rows).repartition(3), A, B, emit="groups")
    plain = [(i, *plain_alignment(*library, t)) for i, t in rows]
    count = Counter(p for *_, links in plain for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = [(i, len(a), len(b), len(g), len(x), sum(count[p] == best[p[0]] for p in x), sum(count[p] for p in x), written(g)) for i, a, b, g, x in plain]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert {(r["a"], r["b"]): (r["n"], r["is_best"]) for r in pairs.collect()} == {p: (n, n == best[p[0]]) for p, n in count.items()}
    digests, _ = alignment.align_documents(table(spark, rows), A, B)
    assert sorted(r["groups_sha256"] for r in digests.collect()) == sorted(hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab e.,'\n\t ▁é1ßÀ- ́日🙂<|>")), max_size=4))
def test_units_give_the_tokens_of_whole_texts(texts):
    both = alignment.load(A, B)
    docs, _, _ = alignment._batch(both, texts, True)
    for d, t in zip(docs, texts, strict=True):
        a, b, groups, links = plain_alignment(both.a, both.b, t)
        assert (d.n.tolist(), d.groups()) == ([len(a), len(b), len(groups), len(links)], written(groups))


def test_long_texts_are_laid_out_in_slices(monkeypatch):
    both = alignment.Both(A, B)
    text = "some words, of a text that's long " * 40
    whole = alignment._batch(both, [text, "x y"], False)
    monkeypatch.setattr(alignment, "SLICE", 50)
    monkeypatch.setattr(alignment, "MEMORY", 2)
    parts = alignment._batch(both, [text, "x y"], False)
    assert [(d.n.tolist(), d.groups()) for d in whole[0]] == [(d.n.tolist(), d.groups()) for d in parts[0]]
    assert all(np.array_equal(x, y) for x, y in zip(whole[1:], parts[1:], strict=True))


def test_alignment_in_small_chunks(spark, library, monkeypatch):
    rows = [(i, f"word{i % 7} and others") for i in range(60)]
    want = sorted(map(tuple, alignment.align_documents(table(spark, rows), A, B)[0].collect()))
    monkeypatch.setattr(alignment, "CHUNK", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(map(tuple, alignment.align_documents(table(spark, rows), A, B)[0].collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    assert alignment.align_documents(table(spark, rows).where("doc_id < 0"), A, B)[0].collect() == []


# importance resampling

_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, n=1):
    words = _WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def plain_resample(docs, target, n=1, buckets=10_000, percent=10, least=20):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *plain_features(t, n)) for i, t in docs]
    s, t = Counter(crc(f) for _, fs, _ in own for f in fs), Counter(crc(f) for x in target for f in plain_features(x, n)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, fs, words in own:
        w = sum(gain[crc(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), words, w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((o for o in out if o[2] >= least), key=lambda o: (-o[4], o[0] is not None, o[0] or 0, o[1]))
    for k, o in enumerate(able[: len(able) * percent // 100]):
        o[5] = k + 1
    return sorted(map(tuple, out), key=str)


def resampling_rows():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["Wörter", "like-this", "aim", "other", f"w{rng.randrange(99)}", "É", "x_y"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [*enumerate([*ODD, *texts]), (None, texts[7]), (50, texts[29]), (50, texts[30])], ["aim Aim other", None, "", "wörter aim w1"]


@pytest.mark.parametrize("n, buckets, percent", [(1, 10_000, 10), (2, 97, 35), (3, 65_536, 100)])
def test_resampling_equals_the_plain_version(spark, n, buckets, percent, monkeypatch):
    docs, target = resampling_rows()
    monkeypatch.setattr(resampling, "SLICE", 40)
    aim = spark.createDataFrame(list(enumerate(target)), "item_id BIGINT, text STRING")
    got = resampling.resample(table(spark, docs).repartition(5), aim, ngrams=n, buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, target, n, buckets, percent)


def test_resampling_of_empty_tables(spark):
    docs, target = resampling_rows()
    aim = spark.createDataFrame(list(enumerate(target)), "item_id BIGINT, text STRING")
    assert resampling.resample(table(spark, docs).where("false"), aim).collect() == []
    got = resampling.resample(table(spark, docs), aim.where("false"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, [])


# SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, radius):
    group = {c: {c} for c in codes}
    for a, b in itertools.combinations(sorted(set(codes)), 2):
        if (a ^ b).bit_count() <= radius and group[a] is not group[b]:
            group[a] |= group[b]
            for c in group[b]:
                group[c] = group[a]
    return {c: frozenset(g) for c, g in group.items()}


def clustered(n, seed=1):
    """Fingerprints of chains and balls, and others far off."""
    rng = random.Random(seed)
    codes = [0]
    for _ in range(n):
        c = rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(codes)
        for _ in range(rng.randrange(4)):
            c ^= 1 << rng.randrange(64)
        codes.append(c)
    return sorted(set(codes))


@pytest.mark.parametrize("slice_", [1 << 20, 5])
def test_fingerprints(slice_, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", slice_)
    rng = random.Random(2)
    texts = [*ODD, "one", "one two", "one two three", "A B\tC  d\x0be", *[" ".join(rng.choice(["ab", "c", "Déf", "g h"]) for _ in range(rng.randrange(80))) for _ in range(60)]]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_trees_are_those_of_single_insertions():
    codes = np.array(clustered(300), np.uint64)
    root = np.repeat([0, 100], [100, len(codes) - 100])
    parent, edge = simhash.grow(codes, root)
    for start, end in ((0, 100), (100, len(codes))):
        children = defaultdict(dict)
        for i in range(start + 1, end):
            at = start
            while (d := int(codes[i] ^ codes[at]).bit_count()) in children[at]:
                at = children[at][d]
            children[at][d] = i
            assert (parent[i], edge[i]) == (at, d)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_searches_find_all_pairs(radius, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 900)
    codes = np.array(clustered(400, 3), np.uint64)
    got = {(int(x), int(y)) for a, b in simhash.near(codes, np.zeros(len(codes), np.int64), radius) for x, y in zip(a, b, strict=True)}
    assert got == {(j, i) for i, j in itertools.combinations(range(len(codes)), 2) if int(codes[i] ^ codes[j]).bit_count() <= radius}


@pytest.mark.parametrize("radius, shard", [(2, 65_536), (2, 40), (1, 65_536), (3, 40)])
def test_components_over_all_shards(spark, radius, shard, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", shard)
    codes = clustered(900, 4)
    nodes = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp BIGINT")
    want, label = plain_components(codes, radius), {c: c for c in codes}

    def find(c):
        while label[c] != c:
            c = label[c]
        return c

    for r in simhash.links(nodes, radius).collect():
        a, b = find(r["a"] % (1 << 64)), find(r["b"] % (1 << 64))
        label[max(a, b)] = min(a, b)
    assert {c: find(c) for c in codes} == {c: min(g) for c, g in want.items()}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 400))) for _ in range(40)]
    near = [" ".join(w if rng.random() > 0.004 else "changed" for w in t.split()) for t in base for _ in range(6)]
    rows = [*enumerate([*ODD, *base, *near, *[base[3]] * 30, "", None]), (None, "alone and null"), (None, base[5]), (7, base[5])]
    got = simhash.near_duplicates(table(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    code = [plain_fingerprint(t) for _, t in rows]
    group, least = plain_components(code, 2), {}
    for (i, _), c in zip(rows, code, strict=True):
        if i is not None:
            least[group[c]] = min(i, least.get(group[c], i))
    want = [(i, f"{c:016x}", least.get(group[c])) for (i, _), c in zip(rows, code, strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert len({g for g in group.values() if len(g) > 1}) > 5
    assert simhash.near_duplicates(table(spark, rows).where(F.lit(False))).collect() == []


def test_registered_queries_have_the_contracts_columns(spark):
    folder = "/root/testdata/sf0.001"
    names = {
        "op11_token_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
        "op12_importance_resampling": {"doc_id", "n_features", "weight", "score", "rank"},
        "op13_simhash": {"doc_id", "fingerprint", "component_id"},
    }
    for name, columns in names.items():
        out = queries.queries()[name](spark, folder)
        assert set(out.columns) == columns
        assert out.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
        assert all(t == "string" if c in ("fingerprint", "groups_sha256") else t == "bigint" for c, t in out.dtypes)


def test_byte_streams_are_packed(spark):
    streams = resampling.bucket_streams(table(spark, [(1, "a b a"), (2, None), (3, "c")]).coalesce(1), "doc_id").collect()
    assert [list(r["ids"]) for r in streams] == [[1, 2, 3]]
    assert np.frombuffer(streams[0]["ends"], "<i8").tolist() == [3, 3, 4]
    assert np.frombuffer(streams[0]["stream"], "<u2").tolist() == [zlib.crc32(w) % 10_000 for w in (b"a", b"b", b"a", b"c")]


def test_resampling_equals_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({queries.oracle_sql()['op12_importance_resampling']})").fetchall()
    assert sorted(map(tuple, queries.queries()["op12_importance_resampling"](spark, folder).collect())) == sorted(want)
