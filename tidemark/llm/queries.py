"""The registered queries of this package and, where SQL can express one, its DuckDB SQL.

The tokenizer files' paths are parameters of the operators; the queries take them from
the installed public_tokenizers package.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import bpe_decode, bpe_encode
from tidemark.llm.collocations import collocations
from tidemark.llm.collocations_sql import OP11_SQL
from tidemark.llm.cover_tree import top_k
from tidemark.llm.html_main_text import main_text
from tidemark.llm.importance import resample
from tidemark.llm.importance_sql import OP13_SQL
from tidemark.llm.language_id import fit as fit_languages
from tidemark.llm.language_id import held_out, identify
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import BASE, apply_rules, fit
from tidemark.llm.storage import scratch_path, written
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.suffix_dedup import suffix_dedup
from tidemark.llm.token_store import read_tokens, write_tokens
from tidemark.llm.wordpiece import token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens through the block store and back."""
    path = scratch_path(spark, "token_store")
    write_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), 0, path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that no repeated window of 35 words covers."""
    cut = substring_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"), "text")
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, unnest(range(1, len(w) - 33)) AS i,
         unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i+34], ' ')))) AS m
  FROM d WHERE len(w) >= 35
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM g
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM h WHERE n > 1
), words AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), kept AS (
  SELECT words.r, count(*) FILTER (gone.p IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS t
  FROM words LEFT JOIN gone USING (r, p) GROUP BY words.r
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document and the pieces that they would make."""
    return token_counts(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that no repeated string of 200 bytes covers."""
    cut = suffix_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents
), g AS (
  SELECT r, unnest(range(0, CAST(length(x) // 2 - 199 AS BIGINT))) AS i,
         unnest(list_transform(range(0, CAST(length(x) // 2 - 199 AS BIGINT)), lambda i: md5(substr(x, CAST(2 * i + 1 AS BIGINT), 400)))) AS m
  FROM d WHERE length(x) >= 400
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM g
), s AS (
  SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM h WHERE n > 1
), island AS (
  SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS k FROM s
), span AS (
  SELECT r, k, min(i) AS a, max(i) + 200 AS z FROM island GROUP BY r, k
), gap AS (
  SELECT r, k, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY k) AS kept_from FROM span
), parts AS (
  SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS tail_from,
         string_agg(substr(x, CAST(2 * kept_from + 1 AS BIGINT), CAST(2 * (a - kept_from) AS BIGINT)), '' ORDER BY k) AS head
  FROM gap JOIN d USING (r) GROUP BY r
)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, CAST(2 * coalesce(tail_from, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN parts USING (r)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in power-of-two pieces, each its own sequence."""
    packed = pack(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of every query vector."""
    return top_k(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.r <> d.r WHERE q.vec_id % 20 = 0
), k AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and whether the base rule and the learned list keep it."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    rules = fit(docs, _table(spark, sf_dir, "labels", "doc_id", "quality"))
    return apply_rules(docs, rules).select("doc_id", *BASE, "base_failed", "kept")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    found = written(near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_uid"), "classes")
    names = found.groupBy("class_uid").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return found.join(names, "class_uid").select("doc_id", "class_id", "class_size")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_encode(_table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe_decode(encoded, path).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases of 2 to 4 words."""
    return collocations(_table(spark, sf_dir, "documents", "text", "lang"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit_languages(docs.where(~held_out("doc_id")))
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by how much their n-grams look like those of the benchmark texts."""
    return resample(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "text"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_store": op1_token_store,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_packing": op5_packing,
        "op6_html_main_text": op6_html_main_text,
        "op7_exact_top_k": op7_exact_top_k,
        "op8_quality_rules": op8_quality_rules,
        "op9_near_dup": op9_near_dup,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_collocations": op11_collocations,
        "op12_language_id": op12_language_id,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op4_suffix_dedup": OP4_SQL, "op7_exact_top_k": OP7_SQL, "op11_collocations": OP11_SQL, "op13_importance": OP13_SQL}
