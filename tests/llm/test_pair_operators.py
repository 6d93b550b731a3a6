"""Search, neighbours, line and document deduplication, the pipeline: against brute force on awkward tables."""

import math
import pathlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rangelake.llm import ann, components, jaccard, linededup, search, secrets, toxicity

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, score STRING, pos INT, node DOUBLE, key INT"
PATH = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "own", 1, 2.0, 3) for i, t in rows], SCHEMA).repartition(parts)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed=0, groups=12, size=6, hot=40):
    """Documents with groups of near and exact copies, a passage that many share, and odd rows."""
    rng = random.Random(seed)
    rows, passage = [], " ".join(words(rng, 60))
    for g in range(groups):
        base = words(rng, 150)
        for k in range(size if g else hot):
            own = list(base)
            for _ in range(k % 5):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rows += [" ".join(words(rng, 60)) + " " + passage for _ in range(150)]
    rows += ["", None, "...", "one two", "one two", "One, two!", rows[0], rows[0], " ".join(words(rng, 6000))]
    return list(enumerate(rows))


def five_grams(t):
    w = re.findall(r"\w+", (t or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def classes(sets, threshold=0.8):
    """Plain: (least id of the component, links) of each row."""
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("limit", [128, 8])
def test_jaccard_join_is_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "PAIRS", 16 if limit == 8 else 512)
    rows = near_copies()
    docs = frame(spark, rows)
    if limit == 8:
        plain = jaccard.candidate_links
        monkeypatch.setattr(jaccard, "candidate_links", lambda s, t, r, before: plain(s, t, r, before, limit=8, depth=2))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(docs).collect()}
    assert got == classes({i: five_grams(t) for i, t in rows})


def test_runs_go_on_until_planted_pairs_are_found(spark, monkeypatch):
    rng = random.Random(11)
    sets = [" ".join(f"w{rng.randrange(4000)}" for _ in range(60)) for _ in range(150)]
    nodes = jaccard.nodes_of(frame(spark, enumerate(sets))).select("node", "sketch")
    probes = jaccard.planted(nodes, 0.8).collect()
    own = {bytes(r["node"]): np.frombuffer(r["sketch"], np.uint32) for r in nodes.collect()}
    agree = [np.mean(np.frombuffer(p["sketch"], np.uint32) == own[bytes(p["of"])]) for p in probes]
    assert len(probes) == 150 and abs(np.mean(agree) - 0.8) < 0.02
    plain, made = jaccard.candidate_links, []
    monkeypatch.setattr(jaccard, "candidate_links", lambda s, t, r, before: made.append(before) or plain(s, t, r, before, limit=2, depth=3))
    near = jaccard.near_components(nodes, 0.8, runs=1, target=0.9)
    assert len(made) > 1 and made == list(range(len(made)))
    assert near.join(nodes, "node", "left_anti").count() == 0  # no planted one is left
    assert jaccard.near_components(nodes.limit(0), 0.8).count() == 0


def test_jaccard_of_odd_tables(spark):
    d = frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "other"), (9, "a b c d e f")])
    got = sorted((str(r[0]), str(r[1]), r[2]) for r in jaccard.near_duplicates(d).collect())
    assert got == [("7", "7", 0), ("7", "7", 2), ("7", "7", 2), ("9", "7", 2), ("None", "None", 0), ("None", "None", 0)]
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns and sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("7", "a b c d e f"), ("7", "other"), ("None", "a b c d e f"), ("None", "a b c d e f")]
    assert jaccard.near_duplicates(d.limit(0)).count() == 0 and jaccard.keep_one(d.limit(0)).count() == 0


def test_one_of_each_class_stays_by_row(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c + " more"), (8, None), (8, ""), (8, None)]
    d = spark.createDataFrame([(i, t, i, 2) for i, t in rows], "doc_id BIGINT, text STRING, `a.b` BIGINT, root INT")
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns
    got = sorted((r["doc_id"], str(r["text"]), r["a.b"]) for r in kept.collect())
    assert [g for g in got if g[0] != 7] == [(1, a, 1), (5, b, 5), (8, "", 8), (8, "None", 8)]
    assert len([g for g in got if g[0] == 7]) == 1


def test_overlaps_in_columns_and_blocks():
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000)).astype(np.uint64)) for _ in range(7)]
    want = np.array([[len(np.intersect1d(a, b)) for b in x] for a in x])
    assert (jaccard._overlaps(x, None)[~np.eye(7, dtype=bool)] == want[~np.eye(7, dtype=bool)]).all()
    assert (jaccard._overlaps(x[:3], x[3:]) == want[:3, 3:]).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(50)] + [(2000, 2001 + k) for k in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    d = spark.createDataFrame([*edges, (5, None), (None, None), *edges[:9]], "a BIGINT, b BIGINT")
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert {r["node"]: r["root"] for r in components.components(d).collect()} == want
    assert components.components(d.limit(0)).count() == 0


# Lines


def plain_lines(rows, threshold=0.8):
    """By all runs of nine characters of a line, each pair of lines compared."""
    where = defaultdict(set)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if n := line.strip(" \t\r").lower():
                where[n].add((i, k))
    names = list(where)
    sets = {k: frozenset(n[j : j + 9] for j in range(max(1, len(n) - 8))) for k, n in enumerate(names)}
    groups = defaultdict(set)
    for k, (root, _) in classes(sets, threshold).items():
        groups[root] |= where[names[k]]
    gone = defaultdict(list)
    for g in groups.values():
        for i, k in sorted(g)[1:]:
            gone[i].append(k)
    return {i: sorted(k) for i, k in gone.items()}


def line_rows(seed=1):
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randrange(12, 60), 900)) for _ in range(30)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(base).split(" ")
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            lines.append(rng.choice(["", " ", "\t"]) + " ".join(w) + rng.choice(["", "\r"]))
        rows.append((i, "\n".join(lines)))
    return [*rows, (500, None), (501, ""), (502, "\n\n \n"), (503, "short"), (504, "SHORT "), (505, "a\nb\na"), (506, "é" * 30_000), (507, "é" * 30_000 + "\nend of it")]


def test_line_dedup_is_brute_force(spark):
    rows = line_rows()
    got = {r["doc_id"]: r["removed"] for r in linededup.dedup_report(frame(spark, rows)).collect()}
    want = plain_lines(rows)
    right = sum(got[i] == want.get(i, []) for i in got)
    assert len(got) == len(rows) and right >= 0.97 * len(rows)
    assert all(got[i] == want.get(i, []) for i in range(500, 508))


def test_line_dedup_looks_at_every_run(spark):
    long = "https://where.example/" + "".join(map(str, range(100, 160)))
    texts = ["chapter 10", "chapter 11", "https://www.one.example/a", "https://www.two.example/b", "see table 12 below, page 7", "see table 12 below, page 9"]
    texts += ["\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed\u770b\u82b1\u548c\u6811", "\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed\u770b\u82b1\u7684\u4eba\u5f88\u591a", "QmFzZTY0IHRleHQ=", "QmFzZTY0IG90aGVyIHRleHQ=", long, long + "!"]
    rows = [*enumerate(texts), *((100 + i, t) for i, t in line_rows(3))]
    got = {r["doc_id"]: r["removed"] for r in linededup.dedup_report(frame(spark, rows)).collect()}
    want = plain_lines(rows)
    assert [i for i in range(len(texts)) if got[i]] == [5, len(texts) - 1]  # page 7 and page 9 share 17 of 19 runs
    assert all(got[i] == want.get(i, []) for i in range(len(texts)))
    assert sum(got[i] == want.get(i, []) for i in got) >= 0.97 * len(rows)


def test_line_dedup_signs_prose_by_word_pairs(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"{w}{rng.randrange(99)}" for w in words(rng, n))
    texts = [prose(60), prose(18), prose(5), prose(60) + " https://where.example/" + "x7q" * 20, "\u6211\u4eec" * 30, "ab " * 90]
    got = {r["doc_id"]: (r["r0"] is not None, r["w0"] is not None) for r in linededup.signed_lines(frame(spark, enumerate(texts))).collect()}
    assert got == {0: (False, True), 1: (True, True), 2: (True, False), 3: (True, True), 4: (True, False), 5: (True, False)}


def test_line_dedup_between_kinds_of_signature(spark):
    rng = random.Random(6)
    rows = []
    for n in range(10, 60):  # words: signed by runs, by both, by word pairs; one of a pair with a long word, or a word less
        base = [f"{w}{rng.randrange(999)}" for w in words(rng, n)]
        rows += [" ".join(base), " ".join(base[1:]), " ".join([*base, "z" * 40]), " ".join([*base[:-1], base[-1] + "s"]), " ".join(base[: n // 2] + ["other"] + base[n // 2 + 1 :])]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["removed"] for r in linededup.dedup_report(frame(spark, rows)).collect()}
    want = plain_lines(rows)
    assert len(want) > 100 and {i for i in got if got[i]} <= set(want)
    assert sum(bool(got[i]) for i in want) >= 0.98 * len(want)


def test_line_dedup_of_ids_of_all_sizes(spark):
    texts = ["some line here", "other words", "some line here", "more of it"]
    for ids in ([0, 1, 2, 3], [-5, -4, -3, -2], [-(1 << 63), 7, 1 << 62, (1 << 63) - 1], [1 << 32, (1 << 32) + 1, (1 << 32) + 2, (1 << 32) + 3]):
        got = {r["doc_id"]: r["removed"] for r in linededup.dedup_report(frame(spark, zip(ids, texts, strict=True))).collect()}
        assert got == {ids[0]: [], ids[1]: [], ids[2]: [0], ids[3]: []}


def template_lines(n, seed=4):
    """Lines of one template, mutually alike to 0.5-0.75, each tenth with a near copy."""
    rng = random.Random(seed)
    fixed = " ".join(words(rng, 40))
    rows = []
    for _ in range(n):
        own = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
        rows += [f"{fixed} {own}"] + ([f"{fixed} {own[:-2]}.."] if rng.random() < 0.1 else [])
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_line_dedup_of_one_template(spark):
    rows = template_lines(300)
    got = {r["doc_id"]: r["removed"] for r in linededup.dedup_report(frame(spark, rows)).collect()}
    want = plain_lines(rows)
    assert len(want) > 20 and {i for i in got if got[i]} <= set(want)
    assert sum(bool(got[i]) for i in want) >= 0.95 * len(want)


def test_line_dedup_of_large_buckets_in_full_and_by_prefixes(spark, monkeypatch):
    rows = template_lines(150, seed=9)
    want = plain_lines(rows)
    monkeypatch.setattr(linededup, "NEIGHBOURS", 1)
    for full in (4, 1000):  # nearly all by prefixes, all in full
        monkeypatch.setattr(linededup, "FULL", full)
        got = {r["doc_id"]: r["removed"] for r in linededup.dedup_report(frame(spark, rows)).collect()}
        assert {i for i in got if got[i]} <= set(want) and sum(bool(got[i]) for i in want) >= 0.95 * len(want)


def test_line_dedup_removes_no_unlike_lines(spark):
    texts = [
        "https://example.com/a\nhttps://example.org/b\nhttps://elsewhere.net/zzz",
        "\u673a\u5668\u5b66\u4e60\u662f\u4eba\u5de5\u667a\u80fd\u7684\u4e00\u4e2a\u5206\u652f\n\u673a\u5668\u5b66\u4e60\u662f\u4eba\u5de5\u667a\u80fd\u6211\u4eec\u4eca\u5929\u4e0d\u8c08",
        "Invoice number 12345\nInvoice number 12999", "the price is 10\nthe price is 99", "\t" * 40 + "\n" + " " * 50, "\U0001f600\U0001f601\n\U0001f600\U0001f602",
    ]
    got = linededup.dedup_report(frame(spark, enumerate(texts))).collect()
    assert len(got) == len(texts) and not any(r["removed"] for r in got)
    assert {r["doc_id"]: r["n_lines"] for r in got}[4] == 0


def test_line_dedup_of_few_shingles_many_times(spark):
    texts = ["=" * 200, "=" * 90 + "\nab" + "ab" * 300, "ab" * 40, "ab" * 40 + "c"]
    got = {r["doc_id"]: r["removed"] for r in linededup.dedup_report(frame(spark, enumerate(texts))).collect()}
    assert got == {0: [], 1: [0], 2: [0], 3: []}  # two shingles against three


def test_line_dedup_beside_clashing_columns(spark):
    names = ["doc_id", "text", "n_chars", "_gone", "_new", "_key", "_id", "key", "removed", "row", "new"]
    d = spark.createDataFrame([(1, "one line of some text here", 1, *"abcdefgh"), (2, "One line of some text here\nmore of it all", 2, *"abcdefgh"), (None, None, None, *"abcdefgh")], "doc_id long, text string, n_chars int, " + ", ".join(f"{n} string" for n in names[3:]))
    out = linededup.drop_duplicate_lines(d)
    assert out.columns == names
    assert {(r["doc_id"], r["text"], r["n_chars"], r["new"]) for r in out.collect()} == {(1, "one line of some text here", 1, "h"), (2, "more of it all", 14, "h"), (None, None, None, "h")}


def test_line_dedup_with_salted_buckets(spark, monkeypatch):
    rows = line_rows(2)
    plain = sorted(map(str, linededup.dedup_report(frame(spark, rows)).collect()))
    monkeypatch.setattr(linededup, "SAMPLED", 1)
    monkeypatch.setattr(linededup, "HOT", 12)
    salted = sorted(map(str, linededup.dedup_report(frame(spark, rows)).collect()))
    assert sum(a == b for a, b in zip(plain, salted, strict=True)) >= 0.97 * len(rows)


def test_line_dedup_returns_documents(spark):
    d = frame(spark, [(1, "keep this first line of text\nand another one follows"), (2, "Keep this first line of text"), (3, "new words\nkeep this first line of text"), (None, "keep this first line of text"), (4, " \n"), (5, None)])
    out = linededup.drop_duplicate_lines(d)
    assert out.columns == d.columns
    got = {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()}
    assert got == {(1, "keep this first line of text\nand another one follows", 52), (3, "new words", 9), (None, "keep this first line of text", 28), (4, " \n", 2), (5, None, None)}
    assert linededup.drop_duplicate_lines(d.limit(0)).count() == 0 and linededup.dedup_report(d.limit(0)).count() == 0


def test_texts_of_many_lines_lose_lines_in_linear_time(spark):
    lines = [f"line number {k} of a very long document" if k % 2 else "the same again and again" for k in range(100_000)]
    removed = spark.createDataFrame([(1, list(range(2, 100_000, 2)))], "doc_id BIGINT, removed ARRAY<INT>").withColumn("key", F.xxhash64(F.lit("\n".join(lines))))
    d = spark.createDataFrame([(1, "\n".join(lines), 4, 5), (2, None, 4, 5), (3, "a\n\nb\n", 4, 5)], "doc_id BIGINT, text STRING, `a.b` INT, lines INT")
    whole, linededup.duplicate_lines = linededup.duplicate_lines, lambda docs, threshold: removed
    try:
        began = time.time()
        got = {r["doc_id"]: r["text"] for r in linededup.drop_duplicate_lines(d).collect()}
        assert time.time() - began < 15
    finally:
        linededup.duplicate_lines = whole
    assert got == {1: "\n".join([lines[0], *lines[1::2]]), 2: None, 3: "a\n\nb\n"}


def test_line_dedup_of_repeated_rows(spark):
    d = frame(spark, [(1, "some line here\nx y"), (1, "some line here\nx y"), (2, "x y\nsome line here")])
    got = sorted((r["doc_id"], r["n_lines"], r["removed"]) for r in linededup.dedup_report(d).collect())
    assert got == [(1, 2, []), (1, 2, []), (2, 2, [0, 1])]


def test_line_dedup_plan_has_no_python(spark):
    plan = linededup.signed_lines(frame(spark, [(1, "a b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Search


def plain_search(rows, k=10, most=search.TERMS):
    rows = [(i, t) for i, t in rows if i is not None]
    tfs = [Counter(re.findall(r"\w+", (t or "").lower())) for _, t in rows]
    n, mean = len(rows), sum(sum(c.values()) for c in tfs) / len(rows)
    df = Counter(t for c in tfs for t in c)
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    own = defaultdict(Counter)
    for (i, _), c in zip(rows, tfs, strict=True):
        if i % 100 == 0:
            own[i].update(c)
    out = {}
    for q, c in own.items():
        terms = sorted(sorted(c, key=lambda t: (-c[t] * idf[t], t))[:most])
        best = {}
        for (i, _), tf in zip(rows, tfs, strict=True):
            norm = search.K1 * (1 - search.B + search.B * sum(tf.values()) / mean)
            s = 0.0
            for t in terms:
                if t in tf:
                    s += idf[t] * (tf[t] * (search.K1 + 1) / (tf[t] + norm))
            if s:
                best[i] = max(s, best.get(i, 0))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return {q: [i for _, i in b] for q, b in out.items() if b}


@pytest.mark.parametrize("shard", [24_000_000, 4000])
def test_search_is_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "WINDOW", 8)
    rng = random.Random(5)
    rows = [(i * 7, " ".join(words(rng, rng.randrange(1, 80), 150))) for i in range(300)]
    rows += [(i, rows[100][1]) for i in range(4001, 4040)] + [(700, rows[100][1]), (None, "w1 w2"), (9100, None), (9200, ""), (9300, "...")]
    docs = frame(spark, rows)
    texts = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = defaultdict(dict)
    for r in search.search_like(docs, texts).collect():
        got[r["query_id"]][r["rank"]] = r["doc_id"]
    assert {q: [b[k + 1] for k in range(len(b))] for q, b in got.items()} == plain_search(rows)


def test_a_row_group_holds_one_shard(spark, monkeypatch):
    """Parquet by itself keeps a hundred rows of seven MB in memory before it looks at their size."""
    monkeypatch.setattr(search, "SHARD", 100)
    rng = random.Random(2)
    index = search.build_index(frame(spark, [(i, " ".join(words(rng, 30))) for i in range(60)], 2))
    files = list(pathlib.Path(index.saved_at.removeprefix("file:")).glob("*.parquet"))
    found = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in found) > 20
    assert all(m.row_group(k).num_rows <= search.GROUP for m in found for k in range(m.num_row_groups))


def test_search_asks_for_every_term(spark):
    common = " ".join(f"shared{i}" for i in range(40))
    rows = [(0, " ".join(f"own{i}" for i in range(12)) + " " + common)] + [(1 + i, f"{common} other{i}") for i in range(15)]
    docs = frame(spark, rows)
    texts = docs.where("doc_id = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = [r["doc_id"] for r in search.search_like(docs, texts).orderBy("rank").collect()]
    assert got == plain_search(rows, most=None)[0] and len(got) == 10


def test_search_counts_a_repeated_id_once(spark):
    rng = random.Random(12)
    rows = [(0, "w1 w2 w3 w4")] + [(5, "w1 w2 w3 w4")] * 30 + [(1 + 10 * i, f"w1 w{i % 5} " + " ".join(words(rng, 5 + i))) for i in range(60)]
    docs = frame(spark, rows, 1)
    texts = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = [r["doc_id"] for r in search.search_like(docs, texts).orderBy("rank").collect()]
    assert got == plain_search(rows)[0] and len(set(got)) == 10


@pytest.mark.parametrize("copies, repeated", [(0, False), (300, False), (20, True)])
def test_queries_scored_together_are_as_scored_alone(copies, repeated, monkeypatch):
    rng = random.Random(copies)
    texts = [sorted(rng.choices(range(400), [1 / (w + 1) for w in range(400)], k=rng.randint(0, 60))) for _ in range(700)]
    texts += [texts[5]] * copies
    found = [(np.array(sorted(set(d)), np.int32), np.array([d.count(w) for w in sorted(set(d))], np.int32)) for d in texts]
    ids = [i // 2 if repeated else i for i in range(len(texts))]
    row = search._shard(ids, found, [len(d) for d in texts], {str(w): w for w in range(400)}).to_pylist()[0]
    p = search.Postings(row, 30.0)
    queries = [sorted(rng.sample(range(-3, 400), rng.randint(0, 80))) for _ in range(60)] + [d for d, _ in (found[i] for i in range(0, len(found), 40))]
    numbers = [np.array([max(w, -1) for w in q], np.int64) for q in queries]
    idf = [np.array([0.01 + (w * 7 % 13) for w in q], float) for q in queries]
    reads = []
    p.scores = lambda *a, f=p.scores: reads.append(1) or f(*a)
    first = search.top_k_together(p, numbers, idf, 10, [0.0] * len(queries))
    together = len(reads)
    alone = [search.top_k(p, n, w, 10) for n, w in zip(numbers, idf, strict=True)]
    assert first == alone and (repeated or together < len(reads) / 3)
    floors = [x[3][0] if len(x) > 3 else 0.0 for x in first]
    monkeypatch.setattr(search, "CELLS", 5000)
    p = search.Postings(row, 30.0)
    assert search.top_k_together(p, numbers, idf, 10, [0.0] * len(queries)) == alone and p.matrix[1].size <= 20_000
    best = lambda found: [[y for y in x if y[0] >= f] for x, f in zip(found, floors, strict=True)]
    assert best(search.top_k_together(p, numbers, idf, 10, floors)) == best(alone)


def test_search_prunes():
    rng = random.Random(6)
    docs = [["common"] * rng.randrange(1, 4) + (["rare"] if i % 500 == 0 else []) + ["pad"] * rng.randrange(20) for i in range(4000)]
    numbers = search._Numbers()
    found = [np.unique(np.array([numbers[t] for t in d]), return_counts=True) for d in docs]
    row = search._shard(list(range(4000)), found, [len(d) for d in docs], numbers).to_pylist()[0]
    p, seen = search.Postings(row, 10.0), []
    plain = p.scores
    p.scores = lambda first, end, weight: (seen.append((end - first).sum()), plain(first, end, weight))[1]
    assert len(search.top_k(p, p.numbers(["common", "rare", "absent"]), np.array([0.1, 6.0, 1.0]), 4)) == 4
    assert sum(seen) < 0.5 * len(p.at)  # of all postings


@pytest.mark.parametrize("turns", [(1, 8, 64), (16, 64)])
def test_search_in_rounds_is_brute_force(spark, monkeypatch, turns):
    """Shards of later rounds begin with the k-th best score of those before, in every task."""
    monkeypatch.setattr(search, "SHARD", 2000)
    monkeypatch.setattr(search, "QUERIES", 100)
    monkeypatch.setattr(search, "MANY", 2)
    monkeypatch.setattr(search, "TURNS", turns)
    rng = random.Random(9)
    rows = [(i * 5, " ".join(words(rng, rng.randrange(1, 80), 150))) for i in range(400)]
    rows += [(i, rows[100][1]) for i in range(4001, 4040)] + [(700, rows[100][1]), (None, "w1 w2"), (9100, None)]
    docs = frame(spark, rows)
    texts = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    saved, save = [], search.save
    monkeypatch.setattr(search, "save", lambda df, name, *a: saved.append(name) or save(df, name, *a))
    got = defaultdict(dict)
    for r in search.search_like(docs, texts).collect():
        got[r["query_id"]][r["rank"]] = r["doc_id"]
    assert {q: [b[k + 1] for k in range(len(b))] for q, b in got.items()} == plain_search(rows)
    assert saved.count("search-hits") > len(turns)


def test_rare_postings_are_added_up_in_pieces(monkeypatch):
    """What is gathered at once is the share of PIECE queries, so that it stays in a core's cache."""
    rng = random.Random(4)
    texts = [sorted(rng.sample(range(3000), 60)) for _ in range(600)]
    found = [(np.array(d, np.int32), np.ones(len(d), np.int32)) for d in texts]
    row = search._shard(list(range(600)), found, [60] * 600, {str(w): w for w in range(3000)}).to_pylist()[0]
    p, sizes, ranges = search.Postings(row, 60.0), [], search._ranges
    assert p.numbers(["7", "none", "2999"]).tolist() == [7, -1, 2999]
    p.matrix, p.by_doc  # noqa: B018
    monkeypatch.setattr(search, "_ranges", lambda first, end: sizes.append((end - first).sum()) or ranges(first, end))
    numbers, idf = [f[0].astype(np.int64) for f in found[:128]], [np.full(60, 2.0)] * 128
    floors = [x[0][0] for x in search.top_k_together(p, numbers, idf, 1, [0.0] * 128)]
    sizes.clear()
    assert [x[0][1] for x in search.top_k_together(p, numbers, idf, 1, floors)] == list(range(128))
    assert 0 < max(sizes) < 1.5 * sum(sizes) * search.PIECE / 128


def test_search_of_nothing(spark):
    d = frame(spark, [(1, "a")])
    none = d.limit(0).select(F.col("doc_id").alias("query_id"), "text")
    assert search.search_like(d, none).count() == 0
    assert search.search_like(d.limit(0), none).count() == 0


# Neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 32))
    x = (centres[rng.integers(0, 20, 3000)] + 0.6 * rng.normal(size=(3000, 32))).astype("f4")
    x[1000:2000] = x[0]  # a third of all rows are one vector
    rows = [(i, [float(v) for v in e], 1) for i, e in enumerate(x)]
    odd = [(5000, None, 1), (5100, [0.0] * 32, 1), (5200, [float("nan")] * 32, 1), (5300, [None] * 32, 1), (5400, [1.0], 1), (None, rows[3][1], 1), (5500, [], 1), rows[0], (5600, [float("inf")] * 32, 1)]
    d = spark.createDataFrame([*rows, *odd], "vec_id BIGINT, embedding ARRAY<FLOAT>, score INT").repartition(3)
    vectors, dim = ann.usable(d)
    assert dim == 32 and vectors.count() == 3001
    index, centres_, _ = ann.build_index(vectors, dim)
    got = defaultdict(list)
    for r in ann.search(index, index.where("vec_id % 100 = 0"), centres_, dim).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 100):
        dist = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        dist[q] = np.inf
        want = np.lexsort((np.arange(3000), dist))[:10].tolist()
        hits += len(set(want) & {i for i, _ in got[q]})
        assert all(abs(dist[i] - s) < 1e-9 for i, s in got[q]) and len(got[q]) == 10
        if dist[want[-1]] == 0:
            assert [i for i, _ in got[q]] == want
    assert set(got) == set(range(0, 3000, 100)) and hits >= 0.95 * 300


def test_neighbours_of_a_row_repeated_often():
    x = np.array([[1.0, 2.0]] * 75 + [[9.0, 9.0]] * 20)
    ids = np.array([3] * 60 + list(range(10, 25)) + list(range(100, 120)))
    q = np.array([[1.0, 2.0]])
    centres = ann.fit(x.astype("f4"), 1.0)
    packed = ann.pack_codes(ann.encode(x.astype("f4"), centres, 1.0))
    ((_, got, dist),) = ann._search_slab(np.array([7]), q, ann.tables(q, centres), ids, x, packed, 10, 160)
    assert got.tolist() == [3, *range(10, 19)] and not dist.any()


def test_neighbours_of_few(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 1.0])], "vec_id BIGINT, embedding ARRAY<FLOAT>")
    v, dim = ann.usable(d)
    index, c, _ = ann.build_index(v, dim)
    got = ann.search(index, index.where("vec_id = 0"), c, dim).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 1.0), (2, 2, 1.0)]
    assert ann.usable(d.limit(0))[1] == 0


def test_anisotropic_codes_spare_the_parallel_residual():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 16)).astype("f4")
    w = ann.parallel_weight(16, 0.5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(weight):
        c = ann.fit(x, weight)
        codes = ann.encode(x, c, weight)
        got = np.stack([c[s][codes[:, s]] for s in range(c.shape[0])], 1).reshape(len(x), -1)[:, :16]
        return (((x - got) * u).sum(1) ** 2).mean()

    assert w > 1 and parallel(w) < 0.8 * parallel(1.0)


# Pipeline


def test_pipeline_is_its_stages(spark, tmp_path):
    rng = random.Random(11)
    rows = near_copies(4, groups=4, size=3, hot=5)
    rows += [(900 + k, "you pathetic idiot moron " + " ".join(words(rng, 20))) for k in range(4)]
    rows += [(950, 'note token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" ' + " ".join(words(rng, 30)))]
    d = frame(spark, rows)
    d.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    lex = toxicity.Lexicon({f"{w} ": x for w, x in toxicity.SEED.items()})
    kept = [(i, t) for i, t in rows if lex.score(t) < 0.7]
    gone, lined = plain_lines(kept), []
    for i, t in kept:
        new = t if i not in gone else "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone[i])
        if i not in gone or new.strip():
            lined.append((i, new))
    roots = classes({i: five_grams(t) for i, t in lined})
    final = {i: secrets.redact_text(t) for i, t in lined if roots[i][0] == i}
    assert {r["doc_id"] for r in got} == set(final) and 950 in final and not {900, 901} & set(final)
    assert "[SECRET]" in final[950]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    lengths = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in final.items()}
    assert {i: sum(r["length"] for r in got if r["doc_id"] == i) for i in final} == lengths
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram jaccard join", "secret scan", "best-fit packing"]
