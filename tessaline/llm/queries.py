"""The operators bound to the driver tables: opN_<name> queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"), folds=3, fold=1)


def op4_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.graph_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", radius=0.9)


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.piece_codec import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.ivfpq import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=50, top=5)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, per_cent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.toxicity import detect

    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, fold=0)


def op9_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.shuffle_shards import shuffle_shards

    size = (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1)).cast("long")
    out = shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", size, shards=16)
    return out.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
frequent AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT y.doc_id, y.pos, y.line, f.keeper IS NOT NULL AND y.doc_id <> f.keeper AS gone
  FROM keyed y LEFT JOIN frequent f USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_token_counts": op2_token_counts,
        "op3_language_id": op3_language_id,
        "op4_graph_dedup": op4_graph_dedup,
        "op5_piece_codec": op5_piece_codec,
        "op6_ivfpq_search": op6_ivfpq_search,
        "op7_minhash_dedup": op7_minhash_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_shuffle_shards": op9_shuffle_shards,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": OP10_SQL}
