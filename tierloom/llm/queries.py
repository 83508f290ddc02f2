"""The subpackage's queries, opN_<name> and pipeline, with their parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierloom.llm import ann, bpe, ctw_text, exact_dedup, html_text, mixing, quality, simhash, token_counts, url_filter
from tierloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("uid")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "n_near", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_text.scored(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_simhash": op3_simhash,
        "op4_token_counts": op4_token_counts,
        "op5_mix_sources": op5_mix_sources,
        "op6_quality": op6_quality,
        "op7_html_text": op7_html_text,
        "op8_lm_score": op8_lm_score,
        "op9_nearest": op9_nearest,
        "op10_url_filter": op10_url_filter,
        "pipeline": pipeline,
    }


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
"""

OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS sn, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT sn, src, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 3.0 AS cap,
         1.0::DOUBLE + (row_number() OVER (ORDER BY sn, src) - 1) % 3 AS w
  FROM d GROUP BY sn, src),
f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, sn, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(w) OVER (ORDER BY cap / w, sn, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM s),
l AS (SELECT coalesce(max(lev), 0.0) AS lev FROM f),
t AS (
  SELECT sn, src, source_size, least(cap, l.lev * w) AS target,
         ('0x' || substr(sha256('mix:' || sn::VARCHAR || ':' || src), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS drawn
  FROM s, l),
r AS (
  SELECT d.doc_id, d.size, t.*, row_number() OVER (PARTITION BY d.sn, d.src ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS k,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each
  FROM d JOIN t ON d.sn = t.sn AND d.src = t.src),
c AS (
  SELECT r.*, floor(each) + floor(drawn + (each - floor(each)) * (k + 1)) - floor(drawn + (each - floor(each)) * k) AS copies
  FROM r)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op5_mix_sources": OP5_SQL, "op10_url_filter": url_filter.sql()}
