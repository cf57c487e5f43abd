"""Variant-level operators (S6-S10, F1, F9-F11, F13, A1, J1, J6, J7, J9, U1) on long or array dosages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variant_stats(calls: DataFrame) -> DataFrame:
    """Called samples, mean, population variance and minor allele frequency of each variant of a long table."""
    freq = F.avg("dosage") / 2
    return calls.groupBy("variant_idx", "chrom", "pos").agg(F.count("dosage").alias("called"), F.avg("dosage").alias("mean"), F.var_pop("dosage").alias("variance"), F.least(freq, 1 - freq).alias("maf"))


def array_stats(dosage: Column) -> dict[str, Column]:
    """The same of an array column, in one row: called, mean, variance; NULL elements are missing."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate(dosage, zero, lambda a, x: F.when(x.isNull(), a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"))))
    mean = sums["s"] / sums["n"]
    return {"called": sums["n"].cast("long"), "mean": mean, "variance": F.greatest(F.lit(0.0), sums["q"] / sums["n"] - mean * mean)}


def standardise(calls: DataFrame) -> DataFrame:
    """z of each call, (x - mean) / sd over called samples; constant variants and missing calls 0."""
    own = Window.partitionBy("variant_idx")
    sd = F.stddev_pop("dosage").over(own)
    z = F.when(sd > 0, (F.col("dosage") - F.avg("dosage").over(own)) / sd)
    return calls.withColumn("z", F.coalesce(z, F.lit(0.0)))


def maf_filter(calls: DataFrame, floor: float = 0.05, refuse: bool = True) -> DataFrame:
    """variants with minor allele frequency of at least ``floor``; refuses to drop all, unless told not to."""
    kept = variant_stats(calls).where(F.col("maf") >= floor)
    if refuse and kept.isEmpty():
        raise ValueError(f"no variant has a minor allele frequency of {floor} or more")
    return kept


def spaced_markers(m: int, k: int, variants: DataFrame) -> DataFrame:
    """K variants evenly spaced over m by half-even rounding, all if k is m or more."""
    if k >= m:
        return variants
    spark = variants.sparkSession
    step = (m - 1) / max(k - 1, 1)
    places = spark.range(k).select(F.bround(F.col("id") * step).cast("int").alias("variant_idx")).distinct()
    return variants.join(places, "variant_idx", "left_semi")


def align(*tables: DataFrame, order: DataFrame) -> DataFrame:
    """Samples (iid, sample_idx of ``order``) that every table has, in the order of the genotype file; refuses none and repeated ids."""
    out = order
    for t in tables:
        out = out.join(t.select("iid").distinct(), "iid", "left_semi")
    got = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("iid").alias("d")).first()
    if not got.n:
        raise ValueError("the inputs share no sample")
    if got.n != got.d:
        raise ValueError("a sample id stands more than once in the genotype file")
    return out.orderBy("sample_idx")


def missing_chromosomes(tested: DataFrame, kinship: DataFrame) -> DataFrame:
    """Tested chromosomes that the kinship panel lacks."""
    return tested.select("chrom").distinct().join(kinship.select("chrom").distinct(), "chrom", "left_anti")


def shard(items: DataFrame, i: int, n: int, order: str) -> DataFrame:
    """Every n-th item from the i-th on."""
    return items.withColumn("at", F.row_number().over(Window.orderBy(order)) - 1).where(F.col("at") % n == i)


def ols_scan(calls: DataFrame, phenos: DataFrame) -> DataFrame:
    """N5 without kinship and covariates: F, beta and SE per standardised dosage for each variant and phenotype, one shuffle join and one aggregation."""
    z = standardise(calls).select("variant_idx", "chrom", "pos", "iid", "z")
    rows = z.join(phenos.select("iid", "pheno_idx", "pheno", "value").where("value IS NOT NULL"), "iid")
    sums = rows.groupBy("variant_idx", "chrom", "pos", "pheno_idx", "pheno").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("value", "z").alias("beta"), F.regr_sxx("value", "z").alias("sxx"), F.regr_syy("value", "z").alias("syy"))
    nu = F.col("n") - 2
    rss = F.greatest(F.lit(1e-300), F.col("syy") - F.col("beta") * F.col("beta") * F.col("sxx"))
    se = F.sqrt(rss / nu / F.col("sxx"))
    return sums.withColumn("nu", nu.cast("double")).withColumn("se", se).withColumn("f", (F.col("beta") / F.col("se")) * (F.col("beta") / F.col("se"))).withColumn("sfve", F.sqrt(F.col("beta") * F.col("beta") * F.col("sxx") / F.col("syy"))).where("sxx > 0")
