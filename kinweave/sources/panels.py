"""Association panels derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(events: DataFrame) -> DataFrame:
    """sample_idx (order of ids) and iid."""
    ids = events.select(F.col("user_id").alias("iid")).distinct()
    return ids.withColumn("sample_idx", F.row_number().over(Window.orderBy("iid")) - 1)


def dosages(events: DataFrame) -> DataFrame:
    """variant_idx, chrom, pos, iid, dosage (0, 1, 2): one row for each variant and sample, zeros included."""
    k = F.get_json_object("props", "$.k").cast("int")
    seen = events.groupBy(F.col("user_id").alias("iid"), k.alias("variant_idx")).agg(F.least(F.lit(2), F.count(F.lit(1))).cast("int").alias("dosage"))
    grid = samples(events).select("iid").withColumn("variant_idx", F.explode(F.sequence(F.lit(0), F.lit(99))))
    full = grid.join(seen, ["iid", "variant_idx"], "left")
    return full.select("variant_idx", (F.floor(F.col("variant_idx") / 10) + 1).cast("int").alias("chrom"), ((F.col("variant_idx") % 10 + 1) * 1000).cast("int").alias("pos"), "iid", F.coalesce("dosage", F.lit(0)).alias("dosage"))


def variants(events: DataFrame) -> DataFrame:
    """variant_idx, sid, chrom, pos and dosage as an array in sample order: the layout of genotype sources."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("iid", "dosage"))), lambda s: s["dosage"].cast("double"))
    rows = dosages(events).groupBy("variant_idx", "chrom", "pos").agg(order.alias("dosage"))
    return rows.withColumn("sid", F.concat(F.lit("v"), F.col("variant_idx").cast("string"))).select("variant_idx", "sid", "chrom", "pos", "dosage")


def phenotypes(events: DataFrame) -> DataFrame:
    """iid, pheno_idx, pheno, value, n: mean value of each user and event type, and its events."""
    rows = events.groupBy(F.col("user_id").alias("iid"), F.col("event_type").alias("pheno")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("pheno_idx", F.dense_rank().over(Window.orderBy("pheno")) - 1)


def with_gaps(phenos: DataFrame, least: int) -> DataFrame:
    """The same with NULL where a cell has fewer events than ``least``: patterns of missing values."""
    return phenos.withColumn("value", F.when(F.col("n") >= least, F.col("value")))


SQL = """
panel_samples AS (SELECT user_id AS iid, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER) AS sample_idx FROM (SELECT DISTINCT user_id FROM events)),
panel_seen AS (SELECT user_id AS iid, CAST(json_extract_string(props, '$.k') AS INTEGER) AS variant_idx, CAST(least(2, count(*)) AS INTEGER) AS dosage FROM events GROUP BY 1, 2),
panel_dosage AS (
  SELECT CAST(v.k AS INTEGER) AS variant_idx, CAST(v.k // 10 + 1 AS INTEGER) AS chrom, CAST((v.k % 10 + 1) * 1000 AS INTEGER) AS pos, s.iid, s.sample_idx, coalesce(d.dosage, 0) AS dosage
  FROM panel_samples s CROSS JOIN range(0, 100) v(k) LEFT JOIN panel_seen d ON d.iid = s.iid AND d.variant_idx = v.k),
panel_pheno AS (
  SELECT user_id AS iid, event_type AS pheno, avg(value) AS value, count(*) AS n, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS pheno_idx FROM events GROUP BY 1, 2)
"""
