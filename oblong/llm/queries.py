"""The queries of the training-data operators: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oblong.llm import codes, embeddings, jaccard, language, packing, passages, pii, quality, search, sp_bpe, suffix_tree, variants, warc
from oblong.llm.shared import small_batches


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_read(spark, sf_dir, "documents"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op3_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(_read(spark, sf_dir, "documents"))


def op4_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op5_pca_tiled_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_output_codes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op7_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(spark, warc.write(_read(spark, sf_dir, "pages")))


def op8_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_bpe.encode_documents(_read(spark, sf_dir, "documents"))


def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_read(spark, sf_dir, "documents"))


def op11_uniform_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_products(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_weighted_distinct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_read(spark, sf_dir, "embeddings"))


def op13_two_dictionary_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_weak_supervision_pii": op1_weak_supervision_pii,
        "op2_harmonic_packing": op2_harmonic_packing,
        "op3_multi_order_jaccard": op3_multi_order_jaccard,
        "op4_distribution_divergence": op4_distribution_divergence,
        "op5_pca_tiled_near_duplicates": op5_pca_tiled_near_duplicates,
        "op6_output_codes_language": op6_output_codes_language,
        "op7_content_addressed_warc": op7_content_addressed_warc,
        "op8_sentencepiece_bpe": op8_sentencepiece_bpe,
        "op9_attention_quality": op9_attention_quality,
        "op10_suffix_tree_scores": op10_suffix_tree_scores,
        "op11_uniform_threshold_top_k": op11_uniform_threshold_top_k,
        "op12_weighted_distinct_codes": op12_weighted_distinct_codes,
        "op13_two_dictionary_variants": op13_two_dictionary_variants,
    }


#: Null html counts as empty, as DuckDB would digest it to null.
OP7_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


#: Inner products of whole numbers, exact in double precision at this size.
OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score, q.r
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.r <> c.r
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_ASSIGN = """
d{i} AS (
  SELECT p.vec_id, p.pos, c.k, list_sum(list_transform(list_zip(p.part, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
  FROM p JOIN c{i} c ON p.pos = c.pos
), a{i} AS (SELECT vec_id, pos, k, far FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id, pos ORDER BY far, k) = 1)"""

_MOVED = """
m{i} AS (
  SELECT a.pos, a.k, j, CAST(floor(CAST(sum(p.part[j]) AS DOUBLE) / count(*)) AS BIGINT) AS x
  FROM a{i} a JOIN p ON p.vec_id = a.vec_id AND p.pos = a.pos, generate_series(1, len(p.part)) t(j)
  GROUP BY a.pos, a.k, j
), c{n} AS (
  SELECT c.pos, c.k, coalesce(m.c, c.c) AS c
  FROM c{i} c LEFT JOIN (SELECT pos, k, list(x ORDER BY j) AS c FROM m{i} GROUP BY pos, k) m ON m.pos = c.pos AND m.k = c.k
)"""

#: Ids do not repeat here; means are exact in double precision at this size.
OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, label, pos, v[pos * (len(v) // 16) + 1 : (pos + 1) * (len(v) // 16)] AS part FROM v, range(16) t(pos)
), c0 AS (
  SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS k, part AS c FROM p QUALIFY k < 64
), {_ASSIGN.format(i=0)}, {_MOVED.format(i=0, n=1)}, {_ASSIGN.format(i=1)}, {_MOVED.format(i=1, n=2)}, {_ASSIGN.format(i=2)},
e AS (
  SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY pos) AS code, CAST(sum(far) AS BIGINT) AS error FROM a2 GROUP BY vec_id
), b AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, k)) AS codebooks_sha256 FROM c2
)
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN e USING (vec_id), b
"""

#: DuckDB has no crc32: bits are shifted one by one for the table of bytes, and bytes are folded in one by one. Its levenshtein
#: counts bytes, so the 64 letters beyond ASCII are first written as other single bytes.
OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b, CAST(b AS UBIGINT) AS c, 0 AS i FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE i = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY doc, run),
hashed AS (
  SELECT run, n, xor(list_reduce(
           list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(regexp_replace(hex(encode(doc || ':' || run)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: CAST('0x' || x AS UBIGINT))),
           lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS h
  FROM counted, crc
), placed AS (SELECT *, CAST(h % length(run) AS BIGINT) AS spot FROM hashed),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, spot) || substr(run, spot + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM placed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), plain AS (
  SELECT word, n, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_`{|') AS s FROM w
), cut AS (
  SELECT DISTINCT word, n, s, left(s, CAST(i AS BIGINT)) || substr(s, CAST(i AS BIGINT) + 2) AS d FROM plain, generate_series(0, length(s)) t(i)
), near AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n
  FROM cut a JOIN cut b ON a.d = b.d AND a.word <> b.word
  WHERE levenshtein(a.s, b.s) = 1
), best AS (SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM near GROUP BY word, n),
f AS (
  SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS spot, form AS nxt FROM f
  UNION ALL
  SELECT steps.word, f.word, f.form FROM steps JOIN f ON f.word = steps.nxt
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, steps.spot AS root FROM f JOIN steps ON steps.word = f.word AND steps.nxt IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_content_addressed_warc": OP7_SQL,
        "op11_uniform_threshold_top_k": OP11_SQL,
        "op12_weighted_distinct_codes": OP12_SQL,
        "op13_two_dictionary_variants": OP13_SQL,
    }
