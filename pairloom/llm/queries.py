"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import (
    attribution, compression, languages, metric_tree, near_dups, outliers, packing, passages, prefix_trie,
    tree_forest, warc, whitening, word_table,
)
from pairloom.llm.common import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(run):
    """Register a function of session and folder under its own name."""
    QUERIES[run.__name__] = run
    return run


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.quality_rules(read_table(spark, folder, "documents"))


def _remainder(key: str, divisor: int) -> Column:
    """CRC-32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


def quality_model(spark: SparkSession, docs: DataFrame, folder: str) -> compression.CompressionModel:
    labels = read_table(spark, folder, "labels").where(_remainder("doc_id", 5) != 0)
    return compression.fit_compression(docs, labels)


@query
def op4_compression_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    scored = compression.score_quality(docs, quality_model(spark, docs, folder))
    return scored.select(
        "doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


_WORDS = r"regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x20\x09-\x0D]+')"

SQL["op1_minhash_dedup"] = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
  FROM worded),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM sets JOIN least ON least.a = doc_id
"""


@query
def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dups.near_duplicates(read_table(spark, folder, "documents"), shingle_words=4)
    return found.drop("n_rows")


@query
def op8_distinct_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return word_table.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = languages.fit_languages(docs.where(_remainder("doc_id", 3) != 1))
    found = languages.identify_languages(docs, model)
    held_out = F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


SQL["op7_mtree_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op7_mtree_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    return metric_tree.top_k(vectors, F.col("vec_id") % 100 == 0)


SQL["op2_warc_roundtrip"] = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n,
         sha256(coalesce(html, '')) AS digest FROM pages),
least AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN least ON p.digest = least.digest
"""


@query
def op2_warc_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_digests(read_table(spark, folder, "pages"))


@query
def op5_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(read_table(spark, folder, "documents"))


@query
def op6_token_attribution(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return attribution.attribute_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


# Unsigned CRC-32 (reflected, polynomial 0xEDB88320) of a text of ASCII characters, bit by bit.
_CRC = """xor(4294967295, list_reduce([ord(ch) FOR ch IN string_split({text}, '')],
  lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, bit: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)),
  4294967295))"""

SQL["op11_prefix_trie"] = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
         {_CRC.format(text="CAST(conv_id AS VARCHAR)")} % 4 AS h FROM turns GROUP BY conv_id),
shared AS (
  SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (
  SELECT s.conv_id, taken + place - h + 1 AS depth, role, text FROM shared s JOIN turns t ON t.conv_id = s.conv_id
  WHERE place >= h
  UNION ALL
  SELECT s.conv_id, place + 1, role, text FROM shared s JOIN turns t ON t.conv_id = s.base WHERE place < h),
paths AS (
  SELECT conv_id, text, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS path
  FROM rebuilt),
members AS (
  SELECT conv_id, path, text FROM paths
  UNION ALL SELECT conv_id, CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]), '' FROM shared),
nodes AS (
  SELECT path, CAST(len(path) AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) AS saved
  FROM members GROUP BY path),
children AS (
  SELECT path[:len(path) - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children, children.n IS NULL AS leaf
  FROM nodes LEFT JOIN children USING (path)),
totals AS (
  SELECT path[:k] AS path, sum(CAST(leaf AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, leaf, saved, unnest(range(0, depth + 1)) AS k FROM known) GROUP BY 1),
ends AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, len(path)) AS path FROM members GROUP BY conv_id) GROUP BY path)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children,
       CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM known v JOIN totals t ON t.path = v.path
LEFT JOIN nodes p ON p.path = v.path[:len(v.path) - 1] AND v.depth > 0
LEFT JOIN ends e ON e.path = v.path
"""


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, convs = prefix_trie.in_order(read_table(spark, folder, "conversations"))
    base = F.col("conv_id") - F.col("conv_id") % 20
    shared = _remainder("conv_id", 4)
    return prefix_trie.prefix_trie(*prefix_trie.share_openings(turns, convs, base, shared, most=3))


@query
def op12_tree_forest(spark: SparkSession, folder: str) -> DataFrame:
    return tree_forest.near_copies(read_table(spark, folder, "embeddings"))


@query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(read_table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
