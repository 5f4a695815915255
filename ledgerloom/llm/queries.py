"""The queries opN_<name>, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embeddings, licenses, pieces, quality, secrets, simhash, substrings, tokens

TABLE = "{}/{}.parquet"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(TABLE.format(sf_dir, name))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summaries(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.deduplicated(table(spark, sf_dir, "documents")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, order = tokens.written(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return tokens.read_back(spark, folder, order)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.packed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=1)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secrets, op2_sentencepiece, op3_chat, op4_simhash, op5_embeddings, op6_substrings, op7_licenses, op8_token_files, op9_packing, op10_quality)
}

SUBSTRINGS_SQL = """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, ws, unnest(range(len(ws) - 12)) AS i FROM d WHERE len(ws) > 12),
    w AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 13], ' ') AS words FROM s),
    f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY words) AS first FROM w),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE first < doc_id),
    x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d),
    k AS (SELECT x.doc_id, count(c.p) AS n_removed, coalesce(string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY x.p), '') AS kept
          FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)"""

SQL: dict[str, str] = {
    "op3_chat": chat.rendered_sql(),
    "op5_embeddings": embeddings.near_vectors_sql(),
    "op6_substrings": SUBSTRINGS_SQL,
    "op7_licenses": licenses.licenses_sql(),
    "op10_quality": quality.verdicts_sql(),
}
