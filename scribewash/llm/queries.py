"""The registered queries of the subpackage, one opN_<name> for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_digest, format_chats
from .common import documents, table
from .decontaminate import decontaminate
from .language_id import language_id
from .license_scan import license_scan
from .quality_mil import quality_mil
from .quality_rules import quality_rules
from .sentencepiece_viterbi import encode_digest
from .simhash import simhash_groups
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity

SELF_TEST = "</s>[INST] ok [/INST]"


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_toxicity_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(documents(spark, sf_dir))


def op4_quality_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(SELF_TEST).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat_digest(format_chats(turns.unionByName(probe)))


def op10_language_string_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_template_decontamination,
        op2_toxicity_weak_supervision,
        op3_sentencepiece_viterbi,
        op4_quality_attention_mil,
        op5_license_scan,
        op6_simhash_near_dedup,
        op7_quality_rules,
        op8_suffix_array_dedup,
        op9_chat_formatting,
        op10_language_string_kernels,
    )
    return {f.__name__: f for f in found}


OP9_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows_
), sized AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))
    + CASE WHEN before = role THEN length('<|im_sep|>')
      ELSE length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10)) END AS chars FROM marked
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
  sha256(learnt) AS loss_sha256, formatted_chars FROM joined
"""

# Hexadecimal digits stand for bytes; texts are first cut into overlapping parts, as a substring far into a
# long string is slow. Spans: starts of known windows that lie at most 50 apart are one removed run.
OP8_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents
), parts AS (
  SELECT k, o, substr(h, 2 * o + 1, 698) AS g FROM (SELECT k, h, unnest(range(0, greatest(length(h) // 2 - 49, 0), 300)) AS o FROM d)
), windows AS (
  SELECT k, o + j AS i, substr(g, 2 * j + 1, 100) AS s
  FROM (SELECT k, o, g, unnest(range(0, length(g) // 2 - 49)) AS j FROM parts)
), firsts AS (
  SELECT s, min(k) AS least FROM windows GROUP BY s HAVING min(k) < max(k)
), starts AS (
  SELECT DISTINCT k, i FROM windows JOIN firsts USING (s) WHERE least < k
), gaps AS (
  SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM starts
), numbered AS (
  SELECT k, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS span FROM gaps
), spans AS (
  SELECT k, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY k, span
), pieces AS (
  SELECT k, span, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS after FROM spans
), cut AS (
  SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS kept
  FROM pieces JOIN d USING (k) GROUP BY k
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_suffix_array_dedup": OP8_SQL, "op9_chat_formatting": OP9_SQL}
