"""The thin queries over whole tables, one for each operator, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaakya.llm import (
    exact_mph,
    langid_rank,
    lm_backoff,
    packing_cg,
    pii_bootstrap,
    quality_gbdt,
    rules_ledger,
    sigtree_join,
    sp_suffix,
    toxicity_zstd,
)
from vaakya.llm.vocabularies import vocabulary


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbdt.classify(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_suffix.digests(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_rank.classified(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_cg.pack(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_ledger.judged(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.report(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_mph.exact_groups(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_zstd.classify(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_backoff.backoff_scores(_documents(spark, sf_dir))
    # sums of logarithms differ in their last bits by the order of adding
    return found.withColumns({"log_score": F.round("log_score", 3), "mean_log_score": F.round("mean_log_score", 6)})


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree_join.shingle_components(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_classifier,
            op2_sentencepiece_codec,
            op3_language_id,
            op4_packing,
            op5_quality_rules,
            op6_pii,
            op7_exact_dedup,
            op8_toxicity,
            op9_lm_scoring,
            op10_ngram_jaccard_join,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": _RULES_SQL,
        "op7_exact_dedup": _DEDUP_SQL,
        "op9_lm_scoring": _BACKOFF_SQL,
    }


_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

_BACKOFF_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS k FROM d),
p AS (SELECT r, w, lag(w) OVER (PARTITION BY r ORDER BY k) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY k) AS u FROM t),
one AS (SELECT w, count(*) AS c FROM t GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS c FROM p WHERE u IS NOT NULL GROUP BY u, v, w),
s2 AS (SELECT p.*, CASE WHEN p.v IS NULL THEN a.c / (SELECT count(*) FROM t) WHEN two.c >= 2 THEN two.c / b.c
         ELSE 0.4::DOUBLE * (a.c / (SELECT count(*) FROM t)) END AS score
       FROM p JOIN one a ON a.w = p.w LEFT JOIN one b ON b.w = p.v LEFT JOIN two ON two.v = p.v AND two.w = p.w),
s AS (SELECT x.r, sum(ln(CASE WHEN x.u IS NULL THEN x.score WHEN three.c >= 2 THEN three.c / c.c ELSE 0.4::DOUBLE * x.score END)) AS score
      FROM s2 x LEFT JOIN three ON three.u = x.u AND three.v = x.v AND three.w = x.w LEFT JOIN two c ON c.v = x.u AND c.w = x.v GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(score, 0), 3) AS log_score,
       CASE WHEN len(w) > 0 THEN round(score / len(w), 6) END AS mean_log_score
FROM d LEFT JOIN s USING (r)
"""

_RULES_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(range(1, len(w)), lambda k: w[k] = w[k + 1])) AS n_stutter,
         length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS n_letters
  FROM d LEFT JOIN rep USING (r)
), b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3 THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 5 * n_stutter > n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > n_letters THEN 64 ELSE 0 END)
    + (CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END) AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
       failed = 0 AS kept, failed::INTEGER AS failed
FROM b
"""
