"""The queries of this subpackage, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import chat_format, decontaminate, jaccard_join, language_id, line_dedup, nearest, packing, quality, substring_dedup, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source; its path is the language section of the source."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.conversations(turns.unionByName(more)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_suffix_array_dedup, op2_quality_classifier, op3_nearest_neighbours, op4_benchmark_decontamination, op5_best_fit_packing,
        op6_ngram_jaccard_join, op7_substring_dedup, op8_chat_formatting, op9_line_dedup, op10_language_id,
    )
    return {f.__name__: f for f in every}


#: Rung 1 is taken where the raw text would not parse back: an escape code, an end mark, or the separator in a role.
OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), r AS (
  SELECT *, regexp_matches(role || ' ' || text, '\\[lhcb]') OR contains(role, '</turn>' || chr(10)) OR contains(text, '</turn>' || chr(10)) OR contains(role, ': ') AS rung1
  FROM t
), s AS (
  SELECT *, length(role) + length(text) + CASE WHEN rung1 THEN
      (length(role) + length(text) - length(replace(role, '\', '')) - length(replace(text, '\', '')))
    + (length(role) + length(text) - length(replace(role, '</turn>', '')) - length(replace(text, '</turn>', ''))) / 7
    + (length(role) + length(text) - length(replace(role, '### ', '')) - length(replace(text, '### ', ''))) / 4
    + (length(role) + length(text) - length(replace(role, ': ', '')) - length(replace(text, ': ', ''))) / 2 ELSE 0 END + 14 AS n
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_formatting": OP8_SQL, "op9_line_dedup": line_dedup.SQL}
