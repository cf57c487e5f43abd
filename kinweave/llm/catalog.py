"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str) -> Column:
    """Rows that no model may learn labels from: crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, fit(docs.where(~held_out("doc_id"))))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm.htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm.toxicity import score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    out = score_toxicity(docs, docs.where(~held_out("doc_id")), labels)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm.topk import search

    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinweave.llm.pieces import encode_texts

    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


TOPK_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def queries() -> dict[str, Query]:
    return {
        "op10_sentencepiece": op10_sentencepiece,
        "op1_language_id": op1_language_id,
        "op2_html_text": op2_html_text,
        "op3_nearest": op3_nearest,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_minhash_neardup": op5_minhash_neardup,
        "op6_toxicity": op6_toxicity,
        "op7_exact_topk": op7_exact_topk,
        "op8_license_scan": op8_license_scan,
        "op9_source_mixing": op9_source_mixing,
    }


def oracle_sql() -> dict[str, str]:
    from kinweave.llm import licenses, mixing

    return {"op7_exact_topk": TOPK_SQL, "op8_license_scan": licenses.oracle_sql(), "op9_source_mixing": mixing.SQL}
