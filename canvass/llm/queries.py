"""Registered queries of the training-data operators: opN_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canvass.llm.audit_sql import LICENSE_SCAN, SOURCE_DIVERGENCE, TURN_REPAIR
from canvass.llm.common import table
from canvass.llm.divergence import divergence_report
from canvass.llm.factor_machine import classify
from canvass.llm.license_scan import license_report
from canvass.llm.mixing import Target, mix
from canvass.llm.minhash import near_duplicates
from canvass.llm.packing import pack
from canvass.llm.phrases import phrase_report
from canvass.llm.quality_rules import STOP_WORDS, rule_report
from canvass.llm.suffix_dedup import dedup_report
from canvass.llm.token_files import token_file_digest
from canvass.llm.topk import top_k
from canvass.llm.transcripts import format_chats
from canvass.llm.turn_repair import repair_report

Query = Callable[[SparkSession, str], DataFrame]


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("level")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), Target(max_repeat=2.0))
    return mixed.select("doc_id", "source", "mix.*")


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_report(table(spark, sf_dir, "documents"))


def op5_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_report(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), metadata=("n_chars",))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_report(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_harmonic_packing, op2_exact_topk, op3_temperature_mixing, op4_repeated_phrases, op5_minhash_classes,
        op6_suffix_dedup, op7_chat_formatting,
        op8_token_files, op9_quality_rules, op10_quality_classifier, op11_source_divergence, op12_license_scan,
        op13_turn_repair,
    )
}

_WORDS = r"[w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> '']"


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


ORACLES: dict[str, str] = {
    "op11_source_divergence": SOURCE_DIVERGENCE,
    "op12_license_scan": LICENSE_SCAN,
    "op13_turn_repair": TURN_REPAIR,
    "op2_exact_topk": """WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
 s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
WHERE rank <= 10""",
    "op4_repeated_phrases": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
 g AS (SELECT *, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM t),
 f AS (SELECT doc_id, w, i, len(g) = 13 AND min(doc_id) OVER (PARTITION BY array_to_string(g, ' ')) < doc_id AS late FROM g),
 c AS (SELECT doc_id, w, i, max(CAST(late AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
 k AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op9_quality_rules": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM documents),
 p AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
 g AS (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
 m AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
 n AS (SELECT r, count(DISTINCT pos) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM m WHERE n > 1) GROUP BY r),
 c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(l) AS n_lines,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
  len([x FOR x IN w IF x IN ({_listed(STOP_WORDS + tuple(x.capitalize() for x in STOP_WORDS))})]) AS n_stop,
  len([x FOR x IN l IF regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]')]) AS n_bullet,
  len([x FOR x IN l IF ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…')]) AS n_dots FROM d LEFT JOIN n ON n.r = d.r),
 q AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbols_per_word,
  coalesce(n_stop::DOUBLE / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_ratio,
  coalesce(n_bullet::DOUBLE / nullif(n_lines, 0), 0) AS bullet_line_ratio, coalesce(n_dots::DOUBLE / nullif(n_lines, 0), 0) AS ellipsis_line_ratio FROM c)
SELECT *, NOT base_failed AND mean_word_chars BETWEEN 2.0 AND 15.0 AND symbols_per_word <= 0.1 AND stop_word_ratio >= 0.03
  AND dup_line_ratio <= 0.5 AND bullet_line_ratio <= 0.9 AND ellipsis_line_ratio <= 0.3 AS kept FROM q""",
}
