"""Live view of a growing bundle and of status files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def bundle_progress(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 200) -> DataFrame:
    """Streaming: rows, smallest p and significant hits of each phenotype so far."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.groupBy("Pheno").agg(F.count(F.lit(1)).alias("rows"), F.min("PValue").alias("min_p"), F.count(F.when(F.col("significant"), 1)).alias("hits"))


def events_by_stage(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """Streaming: events of each stage and minute, late ones up to ``late``."""
    rows = spark.readStream.schema("ts timestamp, stage string, state string").json(path)
    return rows.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "stage").agg(F.count(F.lit(1)).alias("events"), F.max("state").alias("state"))
