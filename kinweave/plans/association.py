"""Whole analyses: scan with thresholds, inflation and linkage groups; low-rank scan; interaction scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import clump as linkage
from kinweave.operators import genotype, post, prep, scan
from kinweave.operators.epistasis import pair_results, pair_thresholds, scan_pairs
from kinweave.sources.shared import materialize


def gwas(variants: DataFrame, samples: DataFrame, phenos: DataFrame, *, covars: DataFrame | None = None, kinship: DataFrame | None = None, kin_samples: DataFrame | None = None, loco: bool = True, n_perm: int = 100, q: float = 0.05, seed: int = 19930909, rint: bool = True, rint_discrete: bool = True, missing_code: float | None = None, categorical: tuple[str, ...] = (), book: DataFrame | None = None, choose: Callable[[DataFrame], DataFrame] | None = None, min_minor: int = 10, clump_window: int | None = None, clump: bool | None = None, clump_r2: float = 0.5, clump_p: float | None = None, rank: str = "full") -> dict[str, DataFrame]:
    """results (the bundle's columns), minima, thresholds, inflation and prepared phenotypes.

    Phenotypes are prepared over all samples of their table first (N16). Raw
    discrete ones that are degenerate (F8), over all aligned samples or within
    their pattern of missing values, are left out. ``kin_samples`` (iid,
    sample_idx) belongs to ``kinship`` and is joined by id. ``clump_window`` 0
    means the whole genome (N10); it or ``clump`` asks for linkage groups.
    ``choose`` picks rows of prepared phenotypes (F9); ``book`` names the levels
    of coded texts.
    """
    ready = materialize(prep.prepare(phenos, missing_code=missing_code, categorical=categorical, rint=rint, rint_discrete=rint_discrete, flags=True, book=book), "prepared")
    ready = choose(ready) if choose else ready
    phenos = ready
    tables = [t for t in (ready, covars, kin_samples) if t is not None]
    aligned = genotype.align(*tables, order=samples)
    raw = ready.where("raw").join(aligned.select("iid"), "iid", "left_semi")
    bad = prep.degenerate(raw, min_minor).where("degenerate").select("pheno_idx")
    seen = raw.where("value IS NOT NULL").select("pheno_idx").distinct()
    bad = bad.unionByName(raw.select("pheno_idx").distinct().join(seen, "pheno_idx", "left_anti"))
    ready = ready.join(F.broadcast(bad), "pheno_idx", "left_anti")
    if ready.isEmpty():
        raise ValueError("no phenotype is left")
    variants = variants.persist()
    d = scan.design(aligned, ready, covars, kin_samples)
    scanned = scan.scan(variants, d, loco=loco, n_perm=n_perm, seed=seed, kinship=kinship, rank=rank, min_minor=min_minor).persist()
    rows = scan.results(scanned)
    minima = scan.permutation_minima(scanned)
    limits = scan.thresholds(minima, q)
    meta = variants.select("variant_idx", "sid", "chrom", "pos")
    names = phenos.select("pheno_idx", "pheno").distinct()
    rows = rows.join(meta, "variant_idx").join(F.broadcast(names), "pheno_idx")
    rows = post.significant(rows, limits)
    inflation = post.inflation(rows).join(names, "pheno_idx").select(F.col("pheno").alias("Pheno"), F.col("pheno_idx").alias("PhenoIndex"), F.col("lambda_gc").alias("LambdaGC"), F.col("n_variants").alias("NVariants"))
    bundle = rows.select(
        F.col("variant_idx").cast("long").alias("sid_index"), F.col("sid").alias("SNP"), F.col("chrom").cast("double").alias("Chr"), F.lit(None).cast("double").alias("GenDist"), F.col("pos").cast("double").alias("ChrPos"),
        F.col("p").alias("PValue"), F.col("beta").alias("SnpWeight"), F.col("se").alias("SnpWeightSE"), F.col("effect").alias("EffectSize"), F.col("sfve").alias("SnpFractVarExpl"),
        F.lit(0.0).alias("Mixing"), F.col("nullh2").alias("Nullh2"), F.col("pheno").alias("Pheno"), F.lit(1 + n_perm).cast("long").alias("PhenoCount"), "threshold", "significant",
    )
    if clump_window is not None or clump:
        limit = F.lit(clump_p) if clump_p is not None else F.col("threshold")
        hits = rows.where(F.col("p") <= limit).select("pheno_idx", "variant_idx", "chrom", "pos", "p")
        groups = linkage.ld_groups(hits, variants, window=clump_window or None, r2=clump_r2, keep=d.places).join(names, "pheno_idx").select(F.col("pheno").alias("Pheno"), F.col("variant_idx").cast("long").alias("sid_index"), F.col("ld_group").alias("LDGroup"))
        bundle = bundle.join(groups, ["Pheno", "sid_index"], "left").select(*bundle.columns, "LDGroup")
    return {"results": bundle, "minima": minima, "thresholds": limits, "inflation": inflation, "scanned": rows, "phenotypes": ready}


def extreme(variants: DataFrame, samples: DataFrame, phenos: DataFrame, *, markers: int = 5000, grm: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """B: low-rank leave-one-chromosome-out scan with evenly spaced kinship variants, of ``grm`` (with ``kin_samples``) if given."""
    of = variants if grm is None else grm
    panel = genotype.spaced_markers(of.count(), markers, of)
    return gwas(variants, samples, phenos, kinship=panel, rank="low", **options)


def gwas_epi(variants: DataFrame, samples: DataFrame, phenos: DataFrame, *, covars: DataFrame | None = None, marginals: DataFrame | None = None, marginal_thresholds: DataFrame | None = None, marginal_top_k: int = 100, maf_floor: float = 0.05, rint: bool = False, ties: str = "average", q: float = 0.05, choose: Callable[[DataFrame], DataFrame] | None = None, **options) -> dict[str, DataFrame]:
    """C: pairs of anchors (the best marginal variants, or all) and all variants above the frequency floor.

    pairs: pheno_idx, i, j, rank, f, beta, se, p; thresholds; and table, the
    pairs in the fixed columns of a pair bundle, with the marginal results of
    the anchor where they are known. ``marginals``: pheno_idx, variant_idx, p
    and beta; ``marginal_thresholds``: pheno_idx, threshold.
    """
    ready = prep.prepare(phenos, rint=rint, ties=ties)
    ready = choose(ready) if choose else ready
    s = genotype.array_stats(F.col("dosage"))
    kept = variants.withColumn("freq", s["mean"] / 2).where(F.least("freq", 1 - F.col("freq")) >= maf_floor).drop("freq").persist()
    if kept.isEmpty():
        raise ValueError("no variant reaches the frequency floor")
    d = scan.design(genotype.align(*[t for t in (ready, covars) if t is not None], order=samples), ready, covars)
    anchors = None
    if marginals is not None:
        anchors = post.top_hits(marginals, marginal_top_k).join(kept.select("variant_idx"), "variant_idx", "left_semi").select("pheno_idx", "variant_idx")
    found = scan_pairs(kept, d, anchors=anchors, **options)
    pairs, limits = pair_results(found), pair_thresholds(found, q)
    return {"pairs": pairs, "thresholds": limits, "table": pair_table(pairs, limits, kept, phenos, marginals, marginal_thresholds)}


def pair_table(pairs: DataFrame, limits: DataFrame, variants: DataFrame, phenos: DataFrame, marginals: DataFrame | None = None, marginal_thresholds: DataFrame | None = None) -> DataFrame:
    """The pair bundle's columns: names and places of both ends, rank, threshold, significance, the anchor's marginal result."""
    names = phenos.select("pheno_idx", F.col("pheno").alias("Pheno")).distinct()
    out = pairs.join(F.broadcast(names), "pheno_idx")
    for end in "ij":
        out = out.join(variants.select(F.col("variant_idx").alias(end), F.col("sid").alias(f"SNP_{end}"), F.col("chrom").cast("int").alias(f"Chr_{end}"), F.col("pos").cast("long").alias(f"ChrPos_{end}")), end)
    out = out.join(F.broadcast(limits.select("pheno_idx", "threshold")), "pheno_idx", "left")
    if marginals is not None:
        beta = F.col("beta") if "beta" in marginals.columns else F.lit(None).cast("double")
        out = out.join(marginals.select("pheno_idx", F.col("variant_idx").alias("i"), F.col("p").alias("marginal_PValue_i"), beta.alias("marginal_SnpWeight_i")).dropDuplicates(["pheno_idx", "i"]), ["pheno_idx", "i"], "left")
    else:
        out = out.withColumns({"marginal_PValue_i": F.lit(None).cast("double"), "marginal_SnpWeight_i": F.lit(None).cast("double")})
    if marginal_thresholds is not None:
        out = out.join(F.broadcast(marginal_thresholds.select("pheno_idx", F.col("threshold").alias("marginal_threshold_i"))), "pheno_idx", "left")
    else:
        out = out.withColumn("marginal_threshold_i", F.lit(None).cast("double"))
    return out.select(
        "Pheno", F.col("rank").cast("long").alias("rank"), "SNP_i", "Chr_i", "ChrPos_i", "SNP_j", "Chr_j", "ChrPos_j", F.col("p").alias("PValue"), F.col("beta").alias("SnpWeight"), F.col("se").alias("SnpWeightSE"),
        "threshold", F.coalesce(F.col("p") < F.col("threshold"), F.lit(False)).alias("signif"), "marginal_PValue_i", "marginal_SnpWeight_i", "marginal_threshold_i",
    )
