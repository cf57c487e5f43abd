"""After a scan (N8, N9, N11, F15, A7, W2-W10, J8, U2, U3): thresholds, inflation, effect sizes, top hits, plot layout, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.special import CHI2_MEDIAN, chi2_isf_col


def significant(results: DataFrame, thresholds: DataFrame) -> DataFrame:
    """strictly below the phenotype's threshold."""
    return results.join(F.broadcast(thresholds.select("pheno_idx", "threshold")), "pheno_idx", "left").withColumn("significant", F.coalesce(F.col("p") < F.col("threshold"), F.lit(False)))


def inflation(results: DataFrame) -> DataFrame:
    """Median of the chi-square values of p over its expectation; the transform comes before the median."""
    chi = F.when((F.col("p") > 0) & (F.col("p") < 1), chi2_isf_col(F.col("p"))).when(F.col("p") == 1, F.lit(0.0))
    return results.where(F.col("p").isNotNull() & ~F.isnan("p")).withColumn("x", chi).groupBy("pheno_idx").agg((F.expr("percentile(x, 0.5D)") / CHI2_MEDIAN).alias("lambda_gc"), F.count("p").alias("n_variants"))


def effect_size(results: DataFrame, stats: DataFrame, phenos: DataFrame) -> DataFrame:
    """Beta squared times the variance of the dosage over that of the phenotype."""
    var_y = phenos.groupBy("pheno_idx").agg(F.var_pop("value").alias("var_y"))
    rows = results.join(stats.select("variant_idx", F.col("variance").alias("var_g")), "variant_idx").join(F.broadcast(var_y), "pheno_idx")
    return rows.withColumn("effect_size", F.col("beta") * F.col("beta") * F.col("var_g") / F.col("var_y"))


def top_hits(results: DataFrame, k: int, by: tuple[str, ...] = ("p", "variant_idx")) -> DataFrame:
    """The k best of each phenotype with their rank; Spark cuts each task's groups before the shuffle."""
    order = Window.partitionBy("pheno_idx").orderBy(*by)
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def above(results: DataFrame, cut: float) -> DataFrame:
    """Finite F strictly above a cut."""
    return results.where((F.col("f") > cut) & (F.col("f") < float("inf")))


def best(results: DataFrame) -> DataFrame:
    """Smallest p of each phenotype."""
    return results.groupBy("pheno_idx").agg(F.min("p").alias("min_p"), F.min_by("variant_idx", F.struct("p", "variant_idx")).alias("variant_idx"))


def anchor_union(hits: DataFrame) -> DataFrame:
    """Distinct variants in the order they were first listed."""
    first = hits.groupBy("variant_idx").agg(F.min(F.struct("pheno_idx", "rank")).alias("first"))
    return first.withColumn("ord", F.row_number().over(Window.orderBy("first")) - 1).select("variant_idx", "ord")


def enrich_pairs(pairs: DataFrame, marginals: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pairs with the single-variant results of both ends, NULL where there are none."""
    out = pairs
    for end in "ij":
        out = out.join(marginals.select("pheno_idx", F.col("variant_idx").alias(end), F.col("p").alias(f"marginal_p_{end}"), F.col("beta").alias(f"marginal_beta_{end}")), ["pheno_idx", end], "left")
    return out.join(F.broadcast(thresholds.select("pheno_idx", F.col("threshold").alias("marginal_threshold"))), "pheno_idx", "left")


def natural_key(chrom: Column) -> Column:
    """Chromosome names in natural order: digits padded, lower case."""
    return F.concat(F.when(chrom.rlike(r"^\d+$"), F.lit("0")).otherwise(F.lit("1")), F.lpad(F.regexp_extract(chrom, r"(\d+)", 1), 12, "0"), F.lower(chrom))


def manhattan(results: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """X and -log10 p of valid rows, chromosomes one after the other in natural order; p of 0 takes the smallest positive p."""
    valid = results.where(F.col("p").between(0, 1) & (F.col("pos") >= 0) & F.col("chrom").isNotNull())
    seen = valid.groupBy("chrom").agg(F.max("pos").cast("double").alias("seen"))
    sizes = seen.join(lengths.select("chrom", "length"), "chrom", "left") if lengths is not None else seen.withColumn("length", F.col("seen"))
    if lengths is not None and sizes.where("length < seen").limit(1).count():
        raise ValueError("a chromosome is shorter than a position on it")
    sizes = sizes.withColumn("length", F.coalesce("length", "seen"))
    before = Window.orderBy(natural_key(F.col("chrom").cast("string"))).rowsBetween(Window.unboundedPreceding, -1)
    layout = sizes.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0.0))).withColumn("centre", F.col("offset") + F.col("length") / 2)
    least = valid.where("p > 0").groupBy("pheno_idx").agg(F.min("p").alias("least"))
    rows = valid.join(F.broadcast(layout.drop("seen", "length")), "chrom").join(F.broadcast(least), "pheno_idx", "left")
    return rows.withColumn("x", F.col("offset") + F.col("pos")).withColumn("y", -F.log10(F.greatest("p", F.coalesce("least", F.lit(5e-324))))).drop("least")


def svg(points: DataFrame, title: str, limit: int = 20_000, labels: int = 10) -> str:
    """K16, W10 without a plotting library: a scatter of a layout's most significant points, its threshold, chromosome names and the best hits' names."""
    from html import escape

    extra = [F.col(c) for c in ("threshold", "variant_idx", "chrom", "centre") if c in points.columns]
    rows = points.select("x", "y", *extra).orderBy(F.desc("y"), "x").limit(limit).collect()
    wide, high = max((r.x for r in rows), default=1.0) or 1.0, max((r.y for r in rows), default=1.0) or 1.0
    at = lambda x, y: (20 + 960 * x / wide, 380 - 340 * y / high)
    chroms = sorted({str(r.chrom) for r in rows}) if rows and "chrom" in rows[0] else []
    shades = ("#334", "#778")
    parts = []
    for r in rows:
        x, y = at(r.x, r.y)
        shade = shades[chroms.index(str(r.chrom)) % 2] if chroms else shades[0]
        parts.append(f'<circle cx="{x:.1f}" cy="{y:.1f}" r="2" fill="{shade}"/>')
    if rows and "threshold" in rows[0] and rows[0].threshold:
        import math

        y = at(0, min(-math.log10(rows[0].threshold), high * 1.05))[1]
        parts.append(f'<line x1="20" x2="980" y1="{y:.1f}" y2="{y:.1f}" stroke="#a33" stroke-dasharray="4"/>')
    if rows and "variant_idx" in rows[0]:
        for r in rows[:labels]:
            x, y = at(r.x, r.y)
            parts.append(f'<text x="{x:.1f}" y="{y - 4:.1f}" font-size="8">{escape(str(r.variant_idx))}</text>')
    for name, centre in sorted({(str(r.chrom), r.centre) for r in rows}) if rows and "centre" in rows[0] else ():
        parts.append(f'<text x="{at(centre, 0)[0]:.1f}" y="395" font-size="9" text-anchor="middle">{escape(name)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1000 400"><title>{escape(title)}</title>{"".join(parts)}</svg>'


def status_rollup(status: DataFrame) -> DataFrame:
    """Shards of a run as one row a run: sums, maxima, first known values, and whether all are done."""
    return status.groupBy("run").agg(
        F.sum("done").alias("done"), F.sum("total").alias("total"), F.max("elapsed").alias("elapsed"), F.first("label", ignorenulls=True).alias("label"), F.bool_and(F.col("state") == "done").alias("all_done"), F.count(F.lit(1)).alias("shards")
    )


def recent_events(events: DataFrame, n: int, width: float = 10.0) -> DataFrame:
    """The last n events after dropping repeats of a stage and state within a time bucket (the earliest stays)."""
    bucket = F.floor(F.col("ts") / width)
    first = Window.partitionBy(bucket, "stage", "state").orderBy("ts")
    return events.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k").orderBy(F.desc("ts")).limit(n)
