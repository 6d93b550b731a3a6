"""The registered queries: each applies one operator, with production parameters, to its whole table.

The contract's digest columns are derived here from the operators' real outputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, html, jaccard, linededup, packing, quality, resampling, search, secrets, simhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    texts = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.search_like(docs, texts)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), of("literal").alias("n_literal"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score_toxicity(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return _scored(found, 0.7)


def _scored(found: DataFrame, threshold: float) -> DataFrame:
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary(), stored=True)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, dim = ann.usable(_table(spark, sf_dir, "embeddings"))
    if not dim:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index, centres, _ = ann.build_index(vectors, dim)
    return ann.search(index, index.where("vec_id % 100 = 0").select("vec_id", "embedding"), centres, dim)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality.score_quality(docs, quality.learn(docs, _table(spark, sf_dir, "labels")))
    return _scored(found, 0.5)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(_table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = alignment.align_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return found


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bm25_search, op2_secret_scan, op3_toxicity, op4_bpe, op5_nearest_neighbours, op6_best_fit_packing, op7_line_dedup, op8_quality, op9_ngram_jaccard_join, op10_html_text, op11_token_alignment, op12_importance_resampling, op13_simhash)}


#: All pairs of documents that share a run of five words, by their exact similarity; classes by closure.
_JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
g AS MATERIALIZED (SELECT doc_id, unnest(list_distinct([hash(array_to_string(w[k : k + 4], ' ')) FOR k IN range(1, greatest(1, len(w) - 4) + 1)])) AS t FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(CAST(t AS VARCHAR), ' ' ORDER BY t)) AS own FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b, x.own AS own, y.own AS other FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c) - 1e-9::DOUBLE),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, least(a, min(b)) AS class_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links, count(DISTINCT other) FILTER (WHERE other != own) AS n_text_links FROM l GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_text_links, 0) AS n_text_links
FROM documents LEFT JOIN c ON c.a = doc_id LEFT JOIN k ON k.a = doc_id"""


#: CRC-32 a byte at a time over each distinct word, by the table of its polynomial; digits of hexadecimal text by their place.
_DIGIT = lambda text, at: f"(instr('0123456789abcdef', substr({text}, {at}, 1)) - 1)"
_WORDS_OF = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RESAMPLING_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, unnest({_WORDS_OF}) AS w FROM documents), q AS MATERIALIZED (SELECT unnest({_WORDS_OF}) AS w FROM benchmark),
c AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)),
v AS (SELECT w, lower(hex(encode(w))) AS h FROM (SELECT w FROM d UNION SELECT w FROM q)),
b AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, [CAST({_DIGIT("h", "2 * k + 1")} * 16 + {_DIGIT("h", "2 * k + 2")} AS BIGINT) FOR k IN range(len(h) // 2)]),
 lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, c),
s AS (SELECT bucket, count(*) AS n FROM d JOIN b USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM q JOIN b USING (w) GROUP BY bucket),
a AS (SELECT (SELECT count(*) FROM d) AS s_all, (SELECT count(*) FROM q) AS t_all),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000)))) AS BIGINT) AS gain FROM a, s LEFT JOIN t ON t.bucket = s.bucket),
f AS (SELECT doc_id, count(*) AS n, sum(gain) AS total FROM d JOIN b USING (w) JOIN g USING (bucket) GROUP BY doc_id),
h AS (SELECT documents.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total::DOUBLE / n), 0) AS BIGINT) AS weight, sha256('2024:' || documents.doc_id) AS own FROM documents LEFT JOIN f ON f.doc_id = documents.doc_id),
e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((list_sum([CAST({_DIGIT("own", "k")} AS BIGINT) * (1::BIGINT << (4 * (8 - k))) FOR k IN range(1, 9)])::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS able FROM e WHERE n_features >= 20)
SELECT e.doc_id, n_features, weight, score, CASE WHEN k <= 10 * able // 100 THEN k END AS rank FROM e LEFT JOIN r ON r.doc_id = e.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL of the join and of the resampling; the others have no SQL form (or none of exactly their sums), and tests hold them against plain versions."""
    return {"op9_ngram_jaccard_join": _JACCARD_SQL, "op12_importance_resampling": _RESAMPLING_SQL}
