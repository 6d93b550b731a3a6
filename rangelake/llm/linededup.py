"""Fuzzy line deduplication, by DataFrame functions alone.

A line (trimmed of blanks, tabs and a carriage return, lower case) is the set of its character shingles: all runs of
``SHINGLE`` characters (UTF-16 units), at every place.  Lines are put into buckets by ``BANDS`` bands of ``ROWS`` rows, each
the hash that follows a fixed mark on the ring of hashes: those of a line's pairs of neighbouring words if it has ``PAIRS`` of them,
and those of all runs if it has few pairs or long words.  Each line of a bucket is paired
with the bucket's first line and with the ``NEIGHBOURS`` lines before it, all of them in small buckets.  Pairs are
verified by the exact Jaccard similarity of their sets of all runs, and a distributed union-find joins what is verified.

A larger bucket whose lines are not all joined by then is searched for links between its components: in full up to
``FULL`` lines, beyond that by an exact prefix join on the rarest shingles in the bucket, which no pair that is similar
enough escapes.  Of each component of lines the first occurrence (by document id, then place) stays.

Equal lines are one node from the start.  Buckets that a sample shows to be large are salted, and keys that hold
many rows are split in joins, so no task gets one whole.

Defined results: blank lines are never removed and never compared; rows without an id take no part and stay as they
are; null and empty texts have no lines; rows that repeat id and text count once and are treated alike, and rows of
one id that hold a line at one place keep it each; a line without a whole shingle is one shingle; further columns of
any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, join_skewed, save, select
from .components import components

SHINGLE, BANDS, ROWS = 9, 6, 3
#: Lines of at least so many different word pairs are signed by these; below half as many again by all runs too (or only).
PAIRS = 16
#: Lines of longer words than this, on the whole or one of them, are signed by all runs too.
MEAN_WORD, LONG_WORD = 8, 32
#: In a bucket each line is paired with so many lines before it (all of them in small buckets) and with the first.
NEIGHBOURS = 8
#: Buckets of several components are searched in full up to so many lines; larger ones by a prefix join.
FULL = 128
#: Lines in a list of lines that share a shingle; longer lists are cut.
LIST = 1024
#: A bucket that is estimated, from one line in ``SAMPLED``, to hold more than ``HOT`` lines is salted.
SAMPLED, HOT = 64, 4096

#: Evenly spaced places on the ring of 64-bit hashes, one for each row.
_MARKS = [-(1 << 63) + (r << 64) // (BANDS * ROWS) + 1 for r in range(BANDS * ROWS)]
#: Columns of the bands' keys, by runs (r) and by word pairs (w).
_KEYS = [f"{by}{b}" for by in "rw" for b in range(BANDS)]


def _norm(line: F.Column) -> F.Column:
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def _whole(docs: DataFrame) -> bool:
    return docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def _place(docs: DataFrame, narrow: bool) -> F.Column:
    """A line's place among all: one number where ids are whole numbers, so that minima are taken by hash, not by sorting."""
    if narrow:
        return F.shiftleft(F.col("doc_id").cast("bigint"), 31) + F.col("pos")
    if _whole(docs):
        return F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    return F.struct("doc_id", "pos")


def _narrow(signed: DataFrame) -> bool:
    """Whether a place of 64 bits holds each id and a line's number."""
    if not _whole(signed):
        return False
    least, most = signed.agg(F.min("doc_id"), F.max("doc_id")).first()
    return least is None or (-(1 << 32) <= least and most < 1 << 32)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), pos, norm, id64, id2 (128 bits of the line) of each line that isn't blank."""
    d = docs.where("doc_id is not null and text is not null")
    out = d.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # A test of norm would be made before it, by making norm once more.
    out = out.where(F.ltrim("line", F.lit(" \t\r")) != "").select("doc_id", "key", "pos", _norm(F.col("line")).alias("norm"))
    return out.select("*", F.xxhash64("norm").alias("id64"), F.xxhash64(F.lit("second"), "norm").alias("id2"))


def _shingles(norm: str) -> F.Column:
    """Hashes of all runs of a line, repeats included.

    The line is bound as the lambda's variable: in the inner lambda a column's bytes would be copied for each run.
    """
    run, step = 2 * SHINGLE, 2
    return F.expr(f"element_at(transform(array(encode({norm}, 'UTF-16BE')), u -> transform(sequence(1, greatest(octet_length(u) - {run - 1}, 1), {step}), i -> xxhash64(substring(u, i, {run})))), 1)")


def _word_pairs(words: str) -> F.Column:
    """Hashes of all words, each with the next one."""
    return F.expr(f"array_distinct(element_at(transform(array({words}), u -> transform(u, (w, i) -> xxhash64(w, get(u, i + 1)))), 1))")


def _after(ring: str, h: str, by: str) -> list[F.Column]:
    """What follows each mark on the ring (sorted hashes and marks), and the ring's first hash."""
    after = [F.get(ring, F.array_position(ring, F.lit(m)).cast("int")) for m in _MARKS]
    return [a.alias(f"{by}v{k}") for k, a in enumerate([*after, F.array_min(h)])]


def _hashes(by: str) -> list[F.Column]:
    """The same without the marks among it."""
    kept = [F.nullif(F.col(f"{by}v{k}"), F.lit(m)).alias(f"{by}v{k}") for k, m in enumerate(_MARKS[1:])]
    return kept + [F.col(f"{by}v{k}") for k in (len(_MARKS) - 1, len(_MARKS))]


def _filled(by: str, k: int) -> F.Column:
    """Row k; where no hash lies before the next mark it is that of the next."""
    return F.coalesce(*[F.col(f"{by}v{j}") for j in range(k, len(_MARKS) + 1)]).alias(f"{by}v{k}")


def _band_keys(by: str) -> list[F.Column]:
    """The bands' keys of one kind (null for a line that isn't signed by it)."""
    row = [F.col(f"{by}v{k}") for k in range(len(_MARKS))]
    return [F.when(row[0].isNotNull(), F.xxhash64(F.lit(f"{by}{b}"), *row[b * ROWS : (b + 1) * ROWS])).alias(f"{by}{b}") for b in range(BANDS)]


def signed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, pos, id64, id2, band keys r0.. (by runs) and w0.. (by word pairs) of each line.

    A row is the hash that follows its mark, so the chance that it is the same for two lines is the similarity of their
    sets, and that of a band the similarity to the power of ROWS.  Lines of prose are signed by their word pairs, a
    sixth of the runs: an edit takes about as large a share of both.  Lines of few word pairs or of long words are
    signed by all runs.  The two kinds overlap, so that lines that are alike have one kind in common.
    """
    own, ring = ["doc_id", "key", "pos", "id64", "id2"], lambda h: F.sort_array(F.concat(h, F.array(*map(F.lit, _MARKS))))
    cut = _lines(docs).select(*own, "norm", F.split("norm", " ").alias("words"))
    cut = cut.select(*own, "norm", "words", _word_pairs("words").alias("w"))
    long = (F.length("norm") > MEAN_WORD * F.size("words")) | F.exists("words", lambda w: F.length(w) > LONG_WORD)
    cut = cut.select(*own, F.when(F.size("w") >= PAIRS, F.col("w")).alias("w"), F.when((2 * F.size("w") < 3 * PAIRS) | long, F.array_distinct(_shingles("norm"))).alias("r"))
    cut = cut.select(*own, "r", "w", ring("r").alias("rr"), ring("w").alias("wr"))
    rows = cut.select(*own, *_after("rr", "r", "r"), *_after("wr", "w", "w")).select(*own, *_hashes("r"), *_hashes("w"))
    rows = rows.select(*own, *[_filled(by, k) for by in "rw" for k in range(len(_MARKS))])
    return rows.select(*own, *_band_keys("r"), *_band_keys("w"))


def distinct_lines(signed: DataFrame, narrow: bool) -> DataFrame:
    """id64, id2, n (occurrences), at (the first one's place), doc_id, key, pos (of the first), band keys of each different line."""
    at = _place(signed, narrow)
    same = [F.max(c).alias(c) for c in _KEYS]  # all the same
    if not narrow:
        first = [F.min_by(c, at).alias(c) for c in ("doc_id", "key", "pos")]
        return save(signed.groupBy("id64", "id2").agg(F.count("*").alias("n"), F.min(at).alias("at"), *first, *same), "distinct-lines", wide=True)
    found = signed.groupBy("id64", "id2").agg(F.count("*").alias("n"), F.min(at).alias("at"), F.min_by("key", at).alias("key"), *same)
    doc_id, pos = F.shiftright("at", 31).cast(signed.schema["doc_id"].dataType), F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    return save(found.select("id64", "id2", "n", "at", doc_id.alias("doc_id"), "key", pos.alias("pos"), *_KEYS), "distinct-lines", wide=True)


def _records(lines: DataFrame) -> DataFrame:
    return lines.select("id64", F.explode(F.array_compact(F.array(*_KEYS))).alias("bucket"))


def shared_buckets(records: DataFrame) -> DataFrame:
    """bucket, id64, head (the bucket's first line) and before (the lines before it, NEIGHBOURS at most) of the lines (id64, bucket) that share a bucket.

    A large bucket is salted, and each of its parts has a head; heads have themselves as head and none before them.
    """
    sampled = records.where(F.pmod("id64", F.lit(SAMPLED)) == 0).groupBy("bucket").count()
    hot = save(sampled.where(F.col("count") > HOT // SAMPLED).select("bucket", F.ceil(F.col("count") * SAMPLED / HOT).alias("salts")), "hot-buckets")
    some = bool(hot.take(1))
    if some:
        records = records.join(hot, "bucket", "left").select("id64", "bucket", F.coalesce(F.pmod(F.xxhash64("id64", "bucket"), "salts"), F.lit(0)).cast("int").alias("salt"), F.col("salts").isNotNull().alias("hot"))
    else:
        records = records.select("id64", "bucket", F.lit(0).alias("salt"), F.lit(False).alias("hot"))
    own = Window.partitionBy("bucket", "salt").orderBy("id64")
    # One list for all neighbours: nearly all buckets hold one line.
    before = F.collect_list("id64").over(own.rowsBetween(-NEIGHBOURS, -1))
    placed = records.select("bucket", "hot", "id64", F.first("id64").over(own).alias("head"), before.alias("before"))
    return save(placed.where((F.size("before") > 0) | F.col("hot")), "shared-buckets")


def candidate_pairs(shared: DataFrame) -> DataFrame:
    """a, b: pairs of different lines (id64) of one bucket, linear in the buckets' sizes: all pairs of small buckets."""
    others = F.array_distinct(F.concat(F.array("head"), "before"))
    pairs = shared.where(F.size("before") > 0).select("id64", F.explode(others).alias("other"))
    heads = shared.where("hot and size(before) = 0").select("bucket", "id64")
    first = heads.groupBy("bucket").agg(F.min("id64").alias("other"))
    pairs = pairs.unionByName(heads.join(first, "bucket").select("id64", "other"))
    # Lines of one id64 and two id2 are one record each, and a pair of their own.
    return pairs.select(F.greatest("id64", "other").alias("a"), F.least("id64", "other").alias("b")).distinct()


def _bucket_lines(shared: DataFrame) -> DataFrame:
    """bucket, id64, n (lines of the bucket) of the lines of buckets with more than NEIGHBOURS + 1."""
    heads = shared.select("bucket", F.col("head").alias("id64")).distinct()
    lines = shared.where("size(before) > 0").select("bucket", "id64").unionByName(heads)
    large = lines.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > NEIGHBOURS + 1)
    return save(join_skewed(lines, large, ["bucket"], "n").select("bucket", "id64", "n").distinct(), "large-buckets")


def named_lines(distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """The different lines that a pair names."""
    named = pairs.select(F.col("a").alias("id64")).unionByName(pairs.select(F.col("b").alias("id64"))).distinct()
    return save(distinct.select("id64", "id2", "doc_id", "key", "pos").join(named, "id64", "left_semi"), "named-lines")


def line_texts(docs: DataFrame, named: DataFrame) -> DataFrame:
    """id64, node (struct of id64 and id2), norm, n, cells of the named lines, cut from the documents that hold them first.

    n is the number of different shingles, cells are the different values of 16 bits of their hashes.
    """
    held = named.groupBy("doc_id", "key").agg(F.collect_list(F.struct("pos", "id64", "id2")).alias("wanted"))
    # Of one plan at every size: the documents are dealt by id and text.
    met = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").join(held.hint("shuffle_hash"), ["doc_id", "key"])
    # The cut text is bound as a variable, for it is asked for each line.
    cut = F.transform(F.array(F.split("text", "\n", -1)), lambda parts: F.transform("wanted", lambda w: F.struct(w["id64"].alias("id64"), w["id2"].alias("id2"), _norm(F.get(parts, w["pos"])).alias("norm"))))
    found = met.select(F.explode(F.element_at(cut, 1)).alias("l")).select("l.id64", F.struct("l.id64", "l.id2").alias("node"), "l.norm")
    found = found.groupBy("id64", "node").agg(F.first("norm").alias("norm"))  # rows may repeat id and text
    found = found.select("*", _shingles("norm").alias("h")).select("id64", "node", "norm", F.size(F.array_distinct("h")).alias("n"), F.transform("h", lambda x: F.shiftright(x, 48).cast("smallint")).alias("cells"))
    return save(found.withColumn("cells", F.array_distinct("cells")), "line-texts")


def _met(texts: DataFrame, pairs: DataFrame, *own: str) -> DataFrame:
    """a, b and columns own1, own2 of both lines.  A line is ``a`` few times, but the first of a bucket is ``b`` often."""
    uses = pairs.groupBy("b").agg(F.count("*").alias("uses"))
    right = texts.select(F.col("id64").alias("b"), *[F.col(c).alias(f"{c}2") for c in own]).join(uses, "b")
    left = texts.select(F.col("id64").alias("a"), *[F.col(c).alias(f"{c}1") for c in own])
    return join_skewed(pairs.join(left, "a"), right, ["b"], "uses")


def likely_pairs(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b: the pairs that can be similar enough by their numbers of shingles and by their cells.

    A cell of one line that the other lacks holds at least one shingle that the other lacks.
    """
    met = _met(texts, pairs, "n", "cells").withColumn("overlap", F.ceil(threshold / (1 + threshold) * (F.col("n1") + F.col("n2")) - 1e-9))
    met = met.where(F.least("n1", "n2") >= F.col("overlap"))
    lacks = [F.col(f"n{k}") - F.size(f"cells{k}") for k in (1, 2)]
    # By inline, as a test of a plain column would go into the join, and make the column for each time it's named.
    met = met.select("a", "b", "overlap", F.inline(F.array(F.struct(F.size(F.array_intersect("cells1", "cells2")).alias("common"), F.least(*lacks).alias("more")))))
    return save(met.where("more + common >= overlap").select("a", "b").distinct(), "likely-pairs")


def verified_links(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """a, b (nodes) of the pairs (id64) whose sets of all shingles have at least this Jaccard similarity."""
    met = _met(texts, likely_pairs(texts, pairs, threshold), "node", "norm")
    sets = met.select("node1", "node2", _shingles("norm1").alias("h1"), _shingles("norm2").alias("h2"))
    sets = sets.select("node1", "node2", F.array_distinct("h1").alias("s1"), F.array_distinct("h2").alias("s2"))
    met = sets.select("node1", "node2", F.inline(F.array(F.struct(F.size(F.array_intersect("s1", "s2")).alias("common"), (F.size("s1") + F.size("s2")).alias("both")))))
    met = met.where(F.col("common") >= threshold * (F.col("both") - F.col("common")) - 1e-9)
    return save(met.select(F.col("node1").alias("a"), F.col("node2").alias("b")), "line-links")


def parted_members(large: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame | None:
    """bucket, n (lines), id64, root of the large buckets (bucket, id64, n) that hold lines of several components; None if there are none."""
    known = texts.select("id64", "node").join(roots, "node", "left").select("id64", F.xxhash64(F.coalesce("root", "node")).alias("root"))
    known = known.groupBy("id64").agg(F.min("root").alias("root"))
    members = save(large.join(known, "id64").select("bucket", "n", "id64", "root"), "bucket-roots")
    parted = members.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.first("n").alias("n")).where("r1 != r2").select("bucket", F.col("n").alias("weight"))
    out = save(join_skewed(members, parted, ["bucket"], "weight").drop("weight"), "parted-buckets")
    drop(members)
    return out if out.take(1) else None


def full_pairs(members: DataFrame) -> DataFrame:
    """a, b: all pairs of lines of different components that share a bucket of at most FULL lines."""
    some = members.where(F.col("n") <= FULL)
    met = some.select("bucket", F.col("id64").alias("a"), F.col("root").alias("r1")).join(some.select("bucket", F.col("id64").alias("b"), F.col("root").alias("r2")), "bucket")
    return met.where("a > b and r1 != r2").select("a", "b").distinct()


def prefix_pairs(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b: all pairs of lines of different components among the members that can be similar enough.

    Of two sets of n and m shingles with an overlap of at least o = threshold / (1 + threshold) * (n + m), both have a
    common shingle among their first n - o + 1 and m - o + 1, in any order that holds for both.  First come those of
    one component alone, which join nothing and are only counted; then the rarest, so what all lines of a template
    share joins nothing either.  A line is taken once, however many of its buckets are large.
    """
    lines = members.groupBy("id64").agg(F.min("root").alias("root"))
    of = lines.join(texts.groupBy("id64").agg(F.first("norm").alias("norm")), "id64").select("id64", "root", _shingles("norm").alias("h"))
    of = of.select("id64", "root", F.array_distinct("h").alias("s")).select("id64", "root", F.size("s").alias("n"), F.explode("s").alias("token"))
    often = of.groupBy("token").agg(F.count("*").alias("often"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    often = save(often.where("r1 != r2").select("token", "often"), "shingle-counts")
    own = Window.partitionBy("id64")
    # The last of a line's shared shingles has place n.
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "token"))
    ranked = join_skewed(of, often, ["token"], "often").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    lists = ranked.groupBy("token", "root", F.pmod(F.xxhash64("id64"), F.ceil(F.col("often") / LIST)).alias("part"))
    lists = save(lists.agg(F.collect_list(F.struct("id64", "n", "place")).alias("own")), "line-lists")
    some = lists.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("token")
    lists = lists.join(some, "token", "left_semi")
    # The smaller set (of equal ones, either) needs fewer of its shingles.
    less = lists.select("token", F.col("root").alias("r1"), F.filter("own", lambda e: e["place"] <= e["n"] - F.ceil(2 * threshold / (1 + threshold) * e["n"] - 1e-9) + 1).alias("l1")).where(F.size("l1") > 0)
    more = lists.select("token", F.col("root").alias("r2"), F.col("own").alias("l2"))
    met = less.join(more, "token").where("r1 != r2").select(F.explode("l1").alias("x"), "l2").select("x", F.explode("l2").alias("y"))
    n, m = F.col("x.n"), F.col("y.n")
    overlap = F.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    met = met.where((n <= m) & (n >= threshold * m - 1e-9) & (F.col("x.place") <= n - overlap + 1) & (F.col("y.place") <= m - overlap + 1))
    return met.select(F.greatest("x.id64", "y.id64").alias("a"), F.least("x.id64", "y.id64").alias("b")).distinct()


def line_roots(docs: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """node, root of the lines that are linked to another."""
    shared = shared_buckets(_records(distinct))
    large = _bucket_lines(shared)
    pairs = save(candidate_pairs(shared), "line-pairs")
    texts = line_texts(docs, named_lines(distinct, pairs))
    links = verified_links(texts, pairs, threshold)
    roots = components(links)
    members = parted_members(large, texts, roots) if large.take(1) else None
    if members is None:
        return roots
    more = full_pairs(members)
    larger = members.where(F.col("n") > FULL)
    if larger.take(1):
        more = more.unionByName(prefix_pairs(larger, texts, threshold)).distinct()
    more = more.join(pairs, ["a", "b"], "left_anti")  # those were verified above
    found = verified_links(texts, save(more, "line-pairs"), threshold)
    return components(links.unionByName(found)) if found.take(1) else roots


def _duplicates(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The lines (doc_id, key, pos, id64, id2), and doc_id, key, removed (sorted places) of the documents that lose a line."""
    signed = save(signed_lines(docs), "lines", wide=True)
    narrow = _narrow(signed)
    distinct = distinct_lines(signed, narrow)
    roots = line_roots(docs, distinct, threshold).select("node.*", F.col("root.id64").alias("_r1"), F.col("root.id2").alias("_r2"))
    # Lines that occur once and are linked to none stay where they are.
    known = distinct.select("id64", "id2", "n", "at").join(roots, ["id64", "id2"], "left").where("n > 1 or _r1 is not null")
    known = save(known.select("id64", "id2", "n", "at", F.coalesce("_r1", "id64").alias("r1"), F.coalesce("_r2", "id2").alias("r2")), "repeated-lines")
    first = known.groupBy("r1", "r2").agg(F.min("at").alias("first"), F.count("*").alias("members"))
    known = save(join_skewed(known, first, ["r1", "r2"], "members").select("id64", "id2", "n", "first"), "line-roots")
    placed = join_skewed(signed.select("doc_id", "key", "pos", "id64", "id2"), known, ["id64", "id2"], "n")
    gone = placed.where(_place(signed, narrow) != F.col("first"))
    return signed, gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def duplicate_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (xxhash64 of the text), removed (sorted places of lines to go) of the documents that lose a line."""
    return _duplicates(select(docs, doc_id=id_col, text=text_col), threshold)[1]


def dedup_report(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines (that aren't blank), n_removed, removed (places, from 0) of every row; none for a row without an id."""
    docs = select(docs, doc_id=id_col, text=text_col)
    signed, removed = _duplicates(docs, threshold)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        rows = docs.groupBy("doc_id", F.xxhash64("text").alias("key")).agg(F.count("*").alias("_rows"))
        on = ["doc_id", "key"]
    else:  # an id names its row, and no text need be read for it
        rows = docs.groupBy("doc_id").agg(F.count("*").alias("_rows"))
        on = ["doc_id"]
    # Rows that repeat id and text each have all their lines.
    lines = signed.groupBy(*on).agg(F.count("*").alias("_lines"))
    found = rows.join(lines, on, "left").join(removed.select(*on, "removed"), on, "left")
    found = found.withColumn("n_lines", F.col("_lines") / F.col("_rows")).withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    return found.select("doc_id", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def drop_duplicate_lines(docs: DataFrame, threshold: float = 0.8, chars_col: str | None = "n_chars") -> DataFrame:
    """The documents (doc_id, text and any columns) without the lines that repeat others.

    A document goes if it had lines and keeps none.
    """
    removed = duplicate_lines(docs, threshold)
    # Lines are cut before the join and looked up by place after it, so a text's work grows with its lines alone.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    parts = docs.select(F.col("doc_id").alias("id"), F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in others]).alias("row"), F.xxhash64("text").alias("own"), F.split("text", "\n", -1).alias("lines"))
    met = parts.join(removed, (F.col("id") == F.col("doc_id")) & (F.col("own") == F.col("key")), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("removed", F.array().cast("array<int>")))
    met = met.select("id", "row", "removed", F.when(F.col("lines").isNotNull(), F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")).alias("new"))
    met = met.where(F.col("removed").isNull() | (F.btrim("new", F.lit(" \t\r\n")) != ""))
    out = []
    for c in docs.columns:
        if c in ("doc_id", "text"):
            own = F.col("id" if c == "doc_id" else "new")
        else:
            own = F.col("row").getField(c)
            if c == chars_col:
                own = F.when(F.col("removed").isNull(), own).otherwise(F.length("new")).cast(docs.schema[c].dataType)
        out.append(own.alias(c))
    return met.select(*out)
