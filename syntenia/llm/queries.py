"""The ten operators as queries over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, decontaminate, exact_dedup, language_id, mixing, simhash, store, token_counts, toxicity, url_filter, wavelet


def vocabulary(name: str) -> str:
    """A public tokenizer's file; the package is on every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    held_out = store.fold(F.col("doc_id"), 5) == 1
    found = bloom_lm.score(docs, train_rows=~held_out).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(store.table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(store.table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_output(store.table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, rows=store.fold(F.col("id"), 3) != 1)
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (store.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    held_out = store.fold(F.col("doc_id"), 3) == 1
    found = language_id.identify(docs, train=~held_out).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(store.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(store.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(store.table(spark, sf_dir, "documents"), keep="largest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_simhash, op3_token_counts, op4_token_output, op5_mixing, op6_toxicity, op7_language_id, op8_url_filter, op9_exact_dedup, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": OP9, "op5_mixing": OP5}


OP9 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

OP5 = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':0'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM base GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((n - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * (SELECT sum(source_size) FROM sizes)::DOUBLE AS total FROM sizes),
l AS (SELECT *, most / weight AS ratio,
             (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
h AS (SELECT (SELECT level FROM l WHERE ratio > level ORDER BY ratio, n LIMIT 1) AS height),
t AS (SELECT source, source_size, CASE WHEN height IS NULL OR ratio <= height THEN most ELSE weight * height END AS target FROM l, h),
e AS (SELECT b.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size::DOUBLE, 2.0) ELSE 0.0 END AS expected FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p FROM e),
k AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + p * (1 - u)) END AS rank FROM r),
g AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS budget,
             sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN p > 0 AND upto - size / 2.0 <= budget THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM g
"""
