"""Simulated panels (S19) for trials: unlinked variants and one phenotype of a given heritability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def draw(n: int = 100, m: int = 500, *, h2: float = 0.5, n_causal: int = 10, seed: int = 19930909) -> dict[str, np.ndarray]:
    """dosage (n x m, two alleles of frequency 1/2), y (n), causal variants; the genetic part of y has variance h2, the rest 1 - h2 in expectation."""
    rng = np.random.default_rng(seed)
    dosage = rng.binomial(2, 0.5, size=(n, m)).astype(float)
    z = (dosage - dosage.mean(0)) / np.maximum(dosage.std(0), 1e-12)
    causal = rng.choice(m, size=n_causal, replace=False)
    part = z[:, causal] @ rng.standard_normal(n_causal)
    part *= np.sqrt(h2) / part.std()
    return {"dosage": dosage, "y": part + rng.standard_normal(n) * np.sqrt(1 - h2), "causal": causal}


def sim_gwas(spark: SparkSession, n: int = 100, m: int = 500, *, chroms: int = 4, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Variants, samples and phenotypes of ``draw`` in the layout of the sources; the driver draws, so for small panels."""
    got = draw(n, m, **options)
    rows = [(i, f"sim{i}", i * chroms // m + 1, 1000 * i + 1, got["dosage"][:, i].tolist()) for i in range(m)]
    variants = spark.createDataFrame(rows, "variant_idx int, sid string, chrom int, pos int, dosage array<double>")
    samples = spark.createDataFrame([(f"s{j}", j) for j in range(n)], "iid string, sample_idx int")
    phenos = spark.createDataFrame([(f"s{j}", 0, "sim", float(v)) for j, v in enumerate(got["y"])], "iid string, pheno_idx int, pheno string, value double")
    return variants, samples, phenos
