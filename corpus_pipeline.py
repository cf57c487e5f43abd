"""A corpus pipeline of the training-data operators: each stage works on what its predecessor kept.

Rows, not ids, are what the stages keep: rows with equal or null ids are
documents of their own, and extra columns of any name travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import langid, mixing, neardup, pieces, suffixes
from kinweave.llm.catalog import held_out
from kinweave.llm.storage import materialize

#: A document goes if no language is clearly ahead; of four languages each would have 0.25 by chance.
LEAST_SCORE = 0.35


def _own(docs: DataFrame, *names: str) -> list[str]:
    """Names for results that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; those without letters or with a score below LEAST_SCORE go."""
    net = langid.fit(docs.where(~held_out("doc_id")))
    lang, score = _own(docs, "lang_pred", "score")
    marked = langid.identify(docs, net, carry=tuple(docs.columns), results=(lang, score))
    return marked.where((F.col(lang) != langid.UND) & (F.col(score) >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates of five-word shingles at 0.8; of rows that are equal in all columns one stays.

    Rows go by a 64-bit code of all their columns, so equal ids with different
    texts are different documents.
    """
    row, first = _own(docs, "row_code", "row_first")
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])) if len(docs.columns) > 2 else F.lit("")
    coded = docs.withColumn(row, F.xxhash64("doc_id", "text", rest))
    groups = neardup.near_duplicates(coded.select(F.col(row).alias("doc_id"), "text"), words=5, percent=80).select(F.col("doc_id").alias(row), F.col("component_id").alias(first)).distinct()
    # The smallest id of each group; partial sums first, so a group of any size is one row of a task.
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row))
    best = coded.select(row, "doc_id").join(groups, row).groupBy(first).agg(F.min(order).alias("best")).select(F.col(f"best.{row}").alias(row))
    kept = coded.join(best, row, "left_semi")
    return kept.dropDuplicates([row]).select(*[F.col(f"`{c}`") for c in docs.columns])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a document with a smaller id has; documents with nothing left go."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    (prefix,) = _own(docs, "cut_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    cut = suffixes.remove_repeats(docs, keep_text=True, carry=rest, prefix=prefix)
    out = cut.where((F.col(f"{prefix}n_removed") == 0) | (F.trim(f"{prefix}kept_text") != ""))
    text = F.col(f"{prefix}kept_text")
    own = {"text": text.alias("text"), "n_chars": F.char_length(text).cast("long").alias("n_chars")}
    return out.select(*[own.get(c, F.col(f"`{c}`")) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that the mix holds."""
    return pieces.encode_texts(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Networks, sketches and pieces are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
