"""Queries over the panels and the SQL that checks them, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.special import f_sf_sql, f_sf_udf, norm_ppf_sql
from kinweave.operators import clump, genotype, kinship, linalg, post, prep, scan
from kinweave.operators.epistasis import pair_masks, pair_products_of, pair_results, scan_pairs
from kinweave.plans import association
from kinweave.sources import panels, sinks
from kinweave.sources.files import MISSING_WORDS, read_chrom_sizes
from kinweave.sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
GAP = 3
OLS_P = 0.05


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {panels.SQL.strip()}{sql}"
        return f

    return add


def r6(name: str, digits: int = 6) -> Column:
    return (F.round(name, digits) + 0.0).alias(name)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return panels.read(spark, d, "events")


def _ols(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    rows = genotype.ols_scan(panels.dosages(e), panels.phenotypes(e))
    return rows.withColumn("p", f_sf_udf("f", "nu"))


STD = """,
std AS (SELECT d.*, CASE WHEN stddev_pop(dosage) OVER w > 0 THEN (dosage - avg(dosage) OVER w) / stddev_pop(dosage) OVER w ELSE 0.0 END AS z FROM panel_dosage d WINDOW w AS (PARTITION BY variant_idx))"""
OLS = STD + f""",
sums AS (
  SELECT variant_idx, chrom, pos, pheno_idx, pheno, count(*) AS n, regr_slope(value, z) AS beta, regr_sxx(value, z) AS sxx, regr_syy(value, z) AS syy
  FROM std JOIN panel_pheno USING (iid) GROUP BY ALL HAVING regr_sxx(value, z) > 0),
ols0 AS (SELECT *, CAST(n - 2 AS DOUBLE) AS nu, sqrt(greatest(1e-300, syy - beta * beta * sxx) / (n - 2) / sxx) AS se FROM sums),
ols1 AS (SELECT *, (beta / se) * (beta / se) AS f, sqrt(beta * beta * sxx / syy) AS sfve FROM ols0),
ols AS (SELECT *, {f_sf_sql("f", "nu")} AS p FROM ols1)"""


@query("SELECT variant_idx, chrom, pos, iid, dosage FROM panel_dosage")
def dosage_panel(spark: SparkSession, d: str) -> DataFrame:
    """S1-like long panel with zeros."""
    return panels.dosages(_events(spark, d)).select("variant_idx", "chrom", "pos", "iid", "dosage")


STATS = "SELECT variant_idx, chrom, pos, count(dosage) AS called, round(avg(dosage), 6) AS mean, round(var_pop(dosage), 6) AS variance, round(least(avg(dosage) / 2, 1 - avg(dosage) / 2), 6) AS maf FROM panel_dosage GROUP BY ALL"


@query(STATS)
def variant_stats(spark: SparkSession, d: str) -> DataFrame:
    """A1, S8."""
    s = genotype.variant_stats(panels.dosages(_events(spark, d)))
    return s.select("variant_idx", "chrom", "pos", "called", r6("mean"), r6("variance"), r6("maf"))


@query(STATS + " HAVING least(avg(dosage) / 2, 1 - avg(dosage) / 2) >= 0.32")
def maf_filter(spark: SparkSession, d: str) -> DataFrame:
    """an empty table where no variant reaches the floor, as in SQL."""
    s = genotype.maf_filter(panels.dosages(_events(spark, d)), 0.32, refuse=False)
    return s.select("variant_idx", "chrom", "pos", "called", r6("mean"), r6("variance"), r6("maf"))


@query(STD + " SELECT variant_idx, iid, round(z, 6) + 0.0 AS z FROM std")
def standardise(spark: SparkSession, d: str) -> DataFrame:
    """F1, N1."""
    return genotype.standardise(panels.dosages(_events(spark, d))).select("variant_idx", "iid", r6("z"))


PAIRS_SQL = STD + """,
pairs AS (SELECT a.chrom, a.iid AS i, b.iid AS j, sum(a.z * b.z) AS s, count(*) AS m FROM std a JOIN std b USING (variant_idx) WHERE a.iid <= b.iid GROUP BY ALL)"""


@query(PAIRS_SQL + " SELECT i, j, round(sum(s) / sum(m), 6) + 0.0 AS k FROM pairs GROUP BY ALL")
def grm(spark: SparkSession, d: str) -> DataFrame:
    """A2, N2."""
    return kinship.pair_kinship(panels.dosages(_events(spark, d)), digits=6).select("i", "j", "k")


@query(PAIRS_SQL + ", total AS (SELECT i, j, sum(s) AS st, sum(m) AS mt FROM pairs GROUP BY ALL) SELECT chrom, i, j, round((st - s) / (mt - m), 6) + 0.0 AS k FROM pairs JOIN total USING (i, j)")
def loco_grm(spark: SparkSession, d: str) -> DataFrame:
    """J2."""
    return kinship.pair_kinship(panels.dosages(_events(spark, d)), loco=True, digits=6).select("chrom", "i", "j", "k")


@query(f"SELECT iid, sample_idx FROM panel_samples WHERE iid IN (SELECT iid FROM panel_pheno WHERE n >= {GAP}) AND iid IN (SELECT c_custkey FROM customer)")
def align_samples(spark: SparkSession, d: str) -> DataFrame:
    """Genotype order kept over samples that all tables share."""
    e = _events(spark, d)
    other = panels.read(spark, d, "customer").select(F.col("c_custkey").alias("iid"))
    return genotype.align(panels.phenotypes(e).where(F.col("n") >= GAP), other, order=panels.samples(e)).select("iid", "sample_idx")


@query("SELECT DISTINCT chrom FROM panel_dosage WHERE chrom NOT IN (SELECT chrom FROM panel_dosage WHERE variant_idx < 70)")
def chrom_coverage(spark: SparkSession, d: str) -> DataFrame:
    """F19, J7."""
    p = panels.dosages(_events(spark, d))
    return genotype.missing_chromosomes(p, p.where("variant_idx < 70"))


RANK = """, ranked AS (
  SELECT iid, pheno_idx, pheno, rank() OVER (PARTITION BY pheno_idx ORDER BY q) + (count(*) OVER (PARTITION BY pheno_idx, q) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY pheno_idx) AS n_obs
  FROM (SELECT *, round(value / 5) AS q FROM panel_pheno))"""


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    # A mean that is a tie of the rounding may miss it by the error of its sum, which depends on the order of rows.
    p = panels.phenotypes(_events(spark, d))
    return p.withColumn("value", F.round(F.round("value", 9) / 5)).select("iid", "pheno_idx", "pheno", "value")


@query(RANK + " SELECT iid, pheno_idx, CAST(rank AS DOUBLE) AS rank, n_obs FROM ranked")
def rint_rank(spark: SparkSession, d: str) -> DataFrame:
    """Average ranks of values with ties."""
    return prep.average_rank(_coarse(spark, d)).select("iid", "pheno_idx", "rank", "n_obs")


@query(RANK + f" SELECT iid, pheno_idx, round({norm_ppf_sql('((rank-0.375)/(n_obs+0.25))')}, 6) + 0.0 AS value FROM ranked")
def rint(spark: SparkSession, d: str) -> DataFrame:
    """W1, N16."""
    return prep.rank_normalise(_coarse(spark, d)).select("iid", "pheno_idx", r6("value"))


LEVELS = f", lv AS (SELECT pheno_idx, pheno, least(3, n // {GAP}) AS v, count(*) AS c FROM panel_pheno GROUP BY ALL), per AS (SELECT pheno_idx, pheno, count(*) AS levels, min(c) AS rarest FROM lv GROUP BY ALL)"


def _levels(spark: SparkSession, d: str) -> DataFrame:
    p = panels.phenotypes(_events(spark, d))
    return p.withColumn("value", F.least(F.lit(3), F.floor(F.col("n") / GAP)).cast("double"))


@query(LEVELS + " SELECT pheno, levels, levels BETWEEN 2 AND 3 AS discrete FROM per")
def discrete_mask(spark: SparkSession, d: str) -> DataFrame:
    """F4, A9."""
    return prep.discrete_mask(_levels(spark, d)).select("pheno", "levels", "discrete")


@query(LEVELS + " SELECT pheno, levels, rarest, levels < 2 OR rarest < 10 AS degenerate FROM per")
def degenerate(spark: SparkSession, d: str) -> DataFrame:
    """F8."""
    return prep.degenerate(_levels(spark, d)).select("pheno", "levels", "rarest", "degenerate")


@query(""", lab AS (SELECT vec_id AS iid, label FROM embeddings), lv AS (SELECT DISTINCT label FROM lab WHERE label IS NOT NULL)
SELECT iid, 'label_' || CAST(lv.label AS VARCHAR) AS indicator, CAST(lab.label = lv.label AS INTEGER) AS value FROM lab CROSS JOIN lv""")
def one_vs_rest(spark: SparkSession, d: str) -> DataFrame:
    """F5, F6 on panel V's ten classes."""
    v = panels.read(spark, d, "embeddings").select(F.col("vec_id").alias("iid"), F.lit(0).alias("pheno_idx"), F.lit("label").alias("pheno"), F.col("label").cast("double").alias("value"))
    return prep.one_vs_rest(v).select("iid", "indicator", "value")


@query(f""", txt AS (
  SELECT pheno, CASE WHEN pheno_idx % 2 = 0 THEN CASE WHEN value < 40 THEN ' No' WHEN value < 60 THEN 'partial' ELSE 'YES' END ELSE CASE WHEN value < 50 THEN 'white' WHEN value < 55 THEN 'unknown' ELSE 'Red' END END AS t FROM panel_pheno),
seen AS (SELECT pheno, lower(trim(t)) AS label, count(*) AS n FROM txt WHERE trim(t) NOT IN ({", ".join(repr(w) for w in MISSING_WORDS)}) GROUP BY ALL),
tier AS (SELECT *, CASE label WHEN 'no' THEN '0' WHEN 'partial' THEN '1' WHEN 'yes' THEN '2' END AS tr FROM seen),
how AS (SELECT *, CASE WHEN min(CAST(tr IS NOT NULL AS INT)) OVER (PARTITION BY pheno) = 1 THEN 'tiers' ELSE 'alphabetical' END AS how FROM tier)
SELECT pheno, label, CAST(dense_rank() OVER (PARTITION BY pheno ORDER BY CASE WHEN how = 'tiers' THEN tr ELSE label END) - 1 AS DOUBLE) AS code, n, how FROM how""")
def text_codes(spark: SparkSession, d: str) -> DataFrame:
    """F3, A13, N15."""
    p = panels.phenotypes(_events(spark, d))
    v = F.col("value")
    text = F.when(F.col("pheno_idx") % 2 == 0, F.when(v < 40, " No").when(v < 60, "partial").otherwise("YES")).otherwise(F.when(v < 50, "white").when(v < 55, "unknown").otherwise("Red"))
    rows = p.withColumn("text", text).withColumn("text", F.when(~F.trim("text").isin(*MISSING_WORDS), F.col("text")))
    return prep.text_codes(rows).select("pheno", "label", "code", "n", "how")


@query(f""", gap AS (SELECT pheno_idx, pheno, string_agg(CASE WHEN n < {GAP} + 8 THEN CAST(iid AS VARCHAR) END, ',' ORDER BY CAST(iid AS VARCHAR)) AS gone, count(CASE WHEN n < {GAP} + 8 THEN 1 END) AS missing, count(CASE WHEN n >= {GAP} + 8 THEN 1 END) AS kept FROM panel_pheno GROUP BY ALL)
SELECT pheno_idx, pheno, md5(coalesce(gone, '')) AS pattern, missing, kept FROM gap""")
def na_groups(spark: SparkSession, d: str) -> DataFrame:
    """A3."""
    return prep.na_groups(panels.with_gaps(panels.phenotypes(_events(spark, d)), GAP + 8))


@query(OLS + " SELECT variant_idx, pheno_idx, round(beta, 6) + 0.0 AS beta, round(se, 6) AS se, round(f, 6) AS f, round(sfve, 6) AS sfve FROM ols")
def ols_scan(spark: SparkSession, d: str) -> DataFrame:
    """N5 without kinship."""
    return _ols(spark, d).select("variant_idx", "pheno_idx", r6("beta"), r6("se"), r6("f"), r6("sfve"))


@query(OLS + " SELECT variant_idx, pheno_idx, round(-log10(p), 6) + 0.0 AS neg_log10_p FROM ols")
def ols_pvalue(spark: SparkSession, d: str) -> DataFrame:
    """N6."""
    return _ols(spark, d).select("variant_idx", "pheno_idx", (F.round(-F.log10("p"), 6) + 0.0).alias("neg_log10_p"))


@query(OLS + ", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY pheno_idx ORDER BY round(f, 9) DESC, variant_idx) AS INTEGER) AS rank FROM ols) SELECT pheno_idx, rank, variant_idx, round(f, 6) AS f FROM r WHERE rank <= 10")
def top_hits(spark: SparkSession, d: str) -> DataFrame:
    """W2, W7, W8, W10."""
    rows = _ols(spark, d).withColumn("order", -F.round("f", 9))
    return post.top_hits(rows, 10, by=("order", "variant_idx")).select("pheno_idx", "rank", "variant_idx", r6("f"))


@query(OLS + " SELECT pheno_idx, round(-log10(min(p)), 6) AS best FROM ols GROUP BY ALL")
def pheno_min_p(spark: SparkSession, d: str) -> DataFrame:
    """A5."""
    return post.best(_ols(spark, d)).select("pheno_idx", F.round(-F.log10("min_p"), 6).alias("best"))


@query(OLS + " SELECT variant_idx, pheno_idx, round(f, 6) AS f FROM ols WHERE f > 4.0")
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    """W9."""
    return post.above(_ols(spark, d), 4.0).select("variant_idx", "pheno_idx", r6("f"))


@query(OLS + ", best AS (SELECT pheno_idx, chrom, min(p) AS min_p FROM ols GROUP BY ALL) SELECT pheno_idx, round(quantile_cont(min_p, 0.05), 6) AS threshold, count(*) AS n_perm FROM best GROUP BY ALL")
def quantile_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Chromosomes stand in for permutations."""
    minima = _ols(spark, d).groupBy("pheno_idx", "chrom").agg(F.min("p").alias("min_p"))
    return scan.thresholds(minima).select("pheno_idx", r6("threshold"), "n_perm")


@query(OLS + ", best AS (SELECT pheno_idx, chrom, min(p) AS min_p FROM ols GROUP BY ALL), t AS (SELECT pheno_idx, quantile_cont(min_p, 0.5) AS threshold FROM best GROUP BY ALL) SELECT pheno_idx, variant_idx, round(-log10(p), 6) AS y FROM ols JOIN t USING (pheno_idx) WHERE p < threshold")
def significant_hits(spark: SparkSession, d: str) -> DataFrame:
    """F15."""
    rows = _ols(spark, d)
    limit = scan.thresholds(rows.groupBy("pheno_idx", "chrom").agg(F.min("p").alias("min_p")), 0.5)
    return post.significant(rows, limit).where("significant").select("pheno_idx", "variant_idx", F.round(-F.log10("p"), 6).alias("y"))


@query(OLS + f", x AS (SELECT pheno_idx, {norm_ppf_sql('(p/2)')} AS z FROM ols) SELECT pheno_idx, round(quantile_cont(z * z, 0.5) / 0.4549364231195728, 6) AS lambda_gc, count(z) AS n_variants FROM x GROUP BY ALL")
def lambda_gc(spark: SparkSession, d: str) -> DataFrame:
    """A7, N11."""
    return post.inflation(_ols(spark, d)).select("pheno_idx", r6("lambda_gc"), "n_variants")


@query(OLS + ", g AS (SELECT variant_idx, var_pop(dosage) AS vg FROM panel_dosage GROUP BY ALL), y AS (SELECT pheno_idx, var_pop(value) AS vy FROM panel_pheno GROUP BY ALL) SELECT variant_idx, pheno_idx, round(beta * beta * vg / vy, 6) AS effect_size FROM ols JOIN g USING (variant_idx) JOIN y USING (pheno_idx)")
def effect_size(spark: SparkSession, d: str) -> DataFrame:
    """N9."""
    e = _events(spark, d)
    rows = post.effect_size(_ols(spark, d), genotype.variant_stats(panels.dosages(e)), panels.phenotypes(e))
    return rows.select("variant_idx", "pheno_idx", r6("effect_size"))


LD = OLS + f""", hits AS (SELECT pheno_idx, variant_idx, chrom, pos, p FROM ols WHERE p <= {OLS_P}),
cand AS (SELECT a.pheno_idx, a.chrom, a.variant_idx AS a, b.variant_idx AS b FROM hits a JOIN hits b ON a.pheno_idx = b.pheno_idx AND a.chrom = b.chrom AND a.variant_idx < b.variant_idx AND b.pos - a.pos <= 5000),
cor AS (SELECT a, b, coalesce(pow(corr(x.dosage, y.dosage), 2), 0.0) AS r2 FROM (SELECT DISTINCT a, b FROM cand) c JOIN panel_dosage x ON x.variant_idx = c.a JOIN panel_dosage y ON y.variant_idx = c.b AND y.iid = x.iid GROUP BY ALL)"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _ols(spark, d).where(F.col("p") <= OLS_P).select("pheno_idx", "variant_idx", "chrom", "pos", "p")


@query(LD + " SELECT pheno_idx, a, b, round(r2, 6) AS r2 FROM cand JOIN cor USING (a, b)")
def ld_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J4, L31."""
    return clump.ld_pairs(_hits(spark, d), panels.variants(_events(spark, d)), 5000).select("pheno_idx", "a", "b", r6("r2"))


@query("RECURSIVE " + LD + """, link AS (SELECT pheno_idx, a, b FROM cand JOIN cor USING (a, b) WHERE r2 >= 0.002),
sym AS (SELECT pheno_idx, a, b FROM link UNION SELECT pheno_idx, b, a FROM link),
reach AS (SELECT pheno_idx, variant_idx AS a, variant_idx AS g FROM hits UNION SELECT r.pheno_idx, s.b, r.g FROM reach r JOIN sym s ON s.pheno_idx = r.pheno_idx AND s.a = r.a),
comp AS (SELECT pheno_idx, a AS variant_idx, min(g) AS g FROM reach GROUP BY ALL),
best AS (SELECT pheno_idx, g, variant_idx, row_number() OVER (PARTITION BY pheno_idx, g ORDER BY p, variant_idx) AS k, p FROM comp JOIN hits USING (pheno_idx, variant_idx)),
num AS (SELECT pheno_idx, g, CAST(dense_rank() OVER (PARTITION BY pheno_idx ORDER BY p, variant_idx) AS INTEGER) AS ld_group FROM best WHERE k = 1)
SELECT pheno_idx, variant_idx, ld_group FROM comp JOIN num USING (pheno_idx, g)""")
def ld_groups(spark: SparkSession, d: str) -> DataFrame:
    """L32, A8, W3."""
    g = clump.ld_groups(_hits(spark, d), panels.variants(_events(spark, d)), window=5000, r2=0.002)
    return g.select("pheno_idx", "variant_idx", "ld_group")


@query(OLS + ", r AS (SELECT *, row_number() OVER (PARTITION BY pheno_idx ORDER BY round(f, 9) DESC, variant_idx) AS rank FROM ols), f1 AS (SELECT variant_idx, min((pheno_idx, rank)) AS first FROM r WHERE rank <= 5 GROUP BY ALL) SELECT variant_idx, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS ord FROM f1")
def anchor_union(spark: SparkSession, d: str) -> DataFrame:
    """U2, S16."""
    rows = _ols(spark, d).withColumn("order", -F.round("f", 9))
    return post.anchor_union(post.top_hits(rows, 5, by=("order", "variant_idx")))


@query(OLS + """, t AS (SELECT pheno_idx, min(p) AS threshold FROM ols GROUP BY ALL)
SELECT x.pheno_idx, i, j, round(a.p, 6) AS marginal_p_i, round(b.p, 6) AS marginal_p_j, round(threshold, 6) AS marginal_threshold
FROM (SELECT p.pheno_idx, CAST(k AS INTEGER) AS i, CAST(k + 7 AS INTEGER) AS j FROM (SELECT DISTINCT pheno_idx FROM panel_pheno) p, range(0, 100) t(k)) x
LEFT JOIN ols a ON a.pheno_idx = x.pheno_idx AND a.variant_idx = i LEFT JOIN ols b ON b.pheno_idx = x.pheno_idx AND b.variant_idx = j LEFT JOIN t ON t.pheno_idx = x.pheno_idx""")
def marginal_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose ends may lack a result."""
    rows = _ols(spark, d).select("pheno_idx", "variant_idx", "p", "beta")
    pairs = panels.phenotypes(_events(spark, d)).select("pheno_idx").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("j", F.col("i") + 7)
    out = post.enrich_pairs(pairs, rows, rows.groupBy("pheno_idx").agg(F.min("p").alias("threshold")))
    return out.select("pheno_idx", "i", "j", r6("marginal_p_i"), r6("marginal_p_j"), r6("marginal_threshold"))


@query(", v AS (SELECT DISTINCT variant_idx, chrom, pos FROM panel_dosage) SELECT a.variant_idx AS i, b.variant_idx AS j FROM v a JOIN v b ON a.variant_idx < b.variant_idx WHERE NOT (a.chrom = b.chrom AND abs(a.pos - b.pos) < 3000)")
def pair_mask(spark: SparkSession, d: str) -> DataFrame:
    """F13, J5, U5."""
    v = panels.dosages(_events(spark, d)).select("variant_idx", "chrom", "pos").distinct()
    return pair_masks(v, 3000).select("i", "j")


PRODUCT = STD + """, prod AS (SELECT a.variant_idx AS i, b.variant_idx AS j, a.iid, a.z * b.z AS t FROM std a JOIN std b USING (iid) WHERE b.variant_idx > a.variant_idx AND NOT (a.chrom = b.chrom AND abs(a.pos - b.pos) < 3000)),
ps AS (SELECT *, (t - avg(t) OVER w) / nullif(stddev_pop(t) OVER w, 0) AS z FROM prod WINDOW w AS (PARTITION BY i, j))"""


@query(PRODUCT + " SELECT i, j, count(*) AS n, round(avg(t), 6) + 0.0 AS mean, round(var_pop(t), 6) AS variance FROM prod GROUP BY ALL")
def pair_products(spark: SparkSession, d: str) -> DataFrame:
    """Products of standardised dosages of all pairs."""
    rows = pair_products_of(panels.dosages(_events(spark, d)), 3000)
    return rows.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.avg("t").alias("mean"), F.var_pop("t").alias("variance")).select("i", "j", "n", r6("mean"), r6("variance"))


@query(PRODUCT + """, fit AS (SELECT i, j, pheno_idx, regr_r2(value, z) AS r2, count(*) AS n FROM ps JOIN panel_pheno USING (iid) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY pheno_idx ORDER BY round(r2, 9) DESC, i, j) AS INTEGER) AS rank FROM fit WHERE r2 IS NOT NULL) SELECT pheno_idx, rank, i, j, round(r2, 6) AS r2 FROM r WHERE rank <= 20""")
def pair_topk_ols(spark: SparkSession, d: str) -> DataFrame:
    """W7, W8 on pairs."""
    rows = pair_products_of(panels.dosages(_events(spark, d)), 3000).join(panels.phenotypes(_events(spark, d)).select("iid", "pheno_idx", "value"), "iid")
    fit = rows.groupBy("i", "j", "pheno_idx").agg(F.regr_r2("value", "t").alias("r2")).where("r2 IS NOT NULL").withColumn("order", -F.round("r2", 9))
    return post.top_hits(fit, 20, by=("order", "i", "j")).select("pheno_idx", "rank", "i", "j", r6("r2"))


@query(OLS + """, c AS (SELECT chrom, CAST(max(pos) AS DOUBLE) AS len FROM ols GROUP BY ALL), o AS (SELECT chrom, coalesce(sum(len) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, len FROM c)
SELECT pheno_idx, variant_idx, off + pos AS x, round(-log10(p), 6) AS y, off + len / 2 AS centre FROM ols JOIN o USING (chrom)""")
def manhattan_layout(spark: SparkSession, d: str) -> DataFrame:
    """F16, W4, A10."""
    return post.manhattan(_ols(spark, d)).select("pheno_idx", "variant_idx", "x", r6("y"), "centre")


@query("SELECT CAST(chrom AS VARCHAR) AS chrom, CAST(max(pos) AS DOUBLE) AS length FROM panel_dosage GROUP BY ALL")
def chrom_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Labels written as '1.0' read '1'."""
    p = panels.dosages(_events(spark, d)).groupBy("chrom").agg(F.max("pos").alias("length"))
    path = f"{shared_dir(spark)}/sizes-{uuid.uuid4().hex}"
    p.select(F.concat(F.col("chrom").cast("string"), F.lit(".0\t"), F.col("length").cast("string")).alias("value")).write.text(path)
    return read_chrom_sizes(spark, path).select("chrom", "length")


@query(", v AS (SELECT DISTINCT variant_idx FROM panel_dosage) SELECT variant_idx FROM (SELECT *, row_number() OVER (ORDER BY variant_idx) - 1 AS k FROM v) WHERE k % 4 = 1")
def shard_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """W5."""
    v = panels.dosages(_events(spark, d)).select("variant_idx").distinct()
    return genotype.shard(v, 1, 4, "variant_idx").select("variant_idx")


@query("SELECT DISTINCT CAST(round_even((100 - 1) / (7 - 1) * k, 0) AS INTEGER) AS variant_idx FROM range(0, 7) t(k)")
def spaced_markers(spark: SparkSession, d: str) -> DataFrame:
    """S6."""
    v = panels.dosages(_events(spark, d)).select("variant_idx").distinct()
    return genotype.spaced_markers(100, 7, v)


@query(OLS + " SELECT pheno, count(*) AS n, round(min(p), 6) AS least FROM ols GROUP BY ALL")
def bundle_union(spark: SparkSession, d: str) -> DataFrame:
    """Shards of a bundle together again."""
    rows = _ols(spark, d).select(F.col("pheno").alias("Pheno"), F.col("p").alias("PValue"), "pheno_idx").persist()
    paths = [f"{shared_dir(spark)}/shard{i}-{uuid.uuid4().hex}" for i in range(3)]
    for i, path in enumerate(paths):
        sinks.write_bundle(rows.where(F.col("pheno_idx") % 3 == i), path)
    return sinks.merge_bundles(spark, paths).groupBy(F.col("Pheno").alias("pheno")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("PValue"), 6).alias("least"))


@query(""" SELECT user_id % 7 AS run, sum(event_id % 10) AS done, CAST(count(*) * 10 AS BIGINT) AS total, round(max(value), 6) AS elapsed, bool_and(event_type = 'click') AS all_done, count(*) AS shards FROM events GROUP BY ALL""")
def status_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A11, A12."""
    e = _events(spark, d).select((F.col("user_id") % 7).alias("run"), (F.col("event_id") % 10).alias("done"), F.lit(10).cast("long").alias("total"), F.col("value").alias("elapsed"), F.lit("x").alias("label"), F.when(F.col("event_type") == "click", "done").otherwise("running").alias("state"))
    return post.status_rollup(e).select("run", "done", "total", r6("elapsed"), "all_done", "shards")


# A kinship panel that does not vary gives a kinship of 0, under which the mixed models are ordinary regressions: the whole
# machinery of sums, folds, spectra, fits and tests runs, and SQL can check it.
FLAT = " SELECT variant_idx, pheno_idx, round(f, 4) AS f, round(beta, 5) + 0.0 AS beta, round(se, 5) AS se, round(p, 5) AS p FROM ols"


def _flat(variants: DataFrame) -> DataFrame:
    return variants.withColumn("dosage", F.transform("dosage", lambda x: F.lit(1.0)))


def _unstructured(spark: SparkSession, d: str, rank: str, **options) -> DataFrame:
    v, s, p = _inputs(spark, d)
    v = v.persist()
    rows = scan.results(scan.scan(v, scan.design(s, p), kinship=_flat(v), rank=rank, **options))
    return rows.select("variant_idx", "pheno_idx", r6("f", 4), r6("beta", 5), r6("se", 5), r6("p", 5))


@query(OLS + FLAT)
def scan_unstructured(spark: SparkSession, d: str) -> DataFrame:
    """L3-L4, L10-L18 without structure: the leave-one-chromosome-out scan."""
    return _unstructured(spark, d, "full")


@query(OLS + FLAT)
def scan_single_unstructured(spark: SparkSession, d: str) -> DataFrame:
    """L12, L18 without structure: one kinship for all chromosomes, with permutations."""
    return _unstructured(spark, d, "full", loco=False, n_perm=3)


@query(OLS + FLAT)
def scan_plain_unstructured(spark: SparkSession, d: str) -> DataFrame:
    """L5-L11, N13 without structure: covariates kept in the basis, restricted likelihood."""
    return _unstructured(spark, d, "plain", reml=True)


@query(OLS + FLAT)
def scan_lowrank_unstructured(spark: SparkSession, d: str) -> DataFrame:
    """L20-L26, N12 without structure: a factor of no rank."""
    return _unstructured(spark, d, "low")


@query(PRODUCT + f""", y AS (SELECT iid, pheno_idx, value FROM panel_pheno),
cors AS (SELECT p.i, p.j, y.pheno_idx, count(*) AS n, corr(y.value, a.z) AS ya, corr(y.value, p.t) AS yt, corr(a.z, p.t) AS zt FROM prod p JOIN std a ON a.variant_idx = p.i AND a.iid = p.iid JOIN y ON y.iid = p.iid GROUP BY ALL HAVING var_pop(p.t) > 1e-8),
part AS (SELECT *, CAST(n - 3 AS DOUBLE) AS nu, pow(yt - ya * zt, 2) / ((1 - ya * ya) * (1 - zt * zt)) AS r2 FROM cors WHERE 1 - zt * zt > 0.01),
ff AS (SELECT *, nu * r2 / (1 - r2) AS f FROM part), pp AS (SELECT *, {f_sf_sql("f", "nu")} AS p FROM ff)
SELECT pheno_idx, i, j, round(f, 4) AS f, round(p, 5) AS p FROM pp WHERE p < 0.05""")
def epi_unstructured(spark: SparkSession, d: str) -> DataFrame:
    """L33-L36, F13, F14, N14 without structure: all pairs of all variants below a p-value, for every phenotype."""
    v, s, p = _inputs(spark, d)
    v = v.persist()
    rows = pair_results(scan_pairs(v, scan.design(s, p), p_threshold=0.05, window=3000, kinship=_flat(v)))
    return rows.select("pheno_idx", "i", "j", r6("f", 4), r6("p", 5))


# Beyond SQL: decompositions and random permutations. Tests compare them with independent dense computations.
def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = _events(spark, d)
    return panels.variants(e), panels.samples(e), panels.phenotypes(e)


@query()
def gwas_loco(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: L17, N2-N9 with permutation thresholds."""
    return association.gwas(*_inputs(spark, d), n_perm=20)["results"]


@query()
def gwas_single_k(spark: SparkSession, d: str) -> DataFrame:
    """L18."""
    return association.gwas(*_inputs(spark, d), n_perm=5, loco=False)["results"]


@query()
def gwas_kinship_panel(spark: SparkSession, d: str) -> DataFrame:
    """Kinship from another panel (every second variant)."""
    v, s, p = _inputs(spark, d)
    return association.gwas(v, s, p, n_perm=5, kinship=v.where("variant_idx % 2 = 0"))["results"]


@query()
def gwas_covar(spark: SparkSession, d: str) -> DataFrame:
    """Covariates: number of events and its square root, beside the intercept."""
    v, s, p = _inputs(spark, d)
    n = _events(spark, d).groupBy(F.col("user_id").alias("iid")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return association.gwas(v, s, p, n_perm=5, covars=n.select("iid", F.array("n", F.sqrt("n")).alias("covs")))["results"]


@query()
def gwas_na(spark: SparkSession, d: str) -> DataFrame:
    """A3, N1 by pattern of missing values."""
    v, s, p = _inputs(spark, d)
    return association.gwas(v, s, panels.with_gaps(p, 9), n_perm=5)["results"]


@query()
def perm_threshold(spark: SparkSession, d: str) -> DataFrame:
    """L19, N7, N8."""
    return association.gwas(*_inputs(spark, d), n_perm=50)["thresholds"]


@query()
def gwas_inflation(spark: SparkSession, d: str) -> DataFrame:
    """A7 of a mixed-model scan, K8."""
    return association.gwas(*_inputs(spark, d), n_perm=5)["inflation"]


@query()
def gwas_clump(spark: SparkSession, d: str) -> DataFrame:
    """L32 on mixed-model hits."""
    return association.gwas(*_inputs(spark, d), n_perm=5, clump_window=5000, clump_r2=0.002, clump_p=0.05)["results"]


@query()
def lowrank_loco(spark: SparkSession, d: str) -> DataFrame:
    """L20-L27, S6."""
    return association.extreme(*_inputs(spark, d), markers=40, n_perm=5)["results"]


def _plain(spark: SparkSession, d: str, reml: bool) -> DataFrame:
    v, s, p = _inputs(spark, d)
    design = scan.design(s, prep.rank_normalise(p))
    return scan.results(scan.scan(v, design, rank="plain", reml=reml)).drop("sfve")


@query()
def plain_gls_ml(spark: SparkSession, d: str) -> DataFrame:
    """L3-L11, N13 by maximum likelihood."""
    return _plain(spark, d, False)


@query()
def plain_gls_reml(spark: SparkSession, d: str) -> DataFrame:
    """L6-L8, N13 by restricted likelihood."""
    return _plain(spark, d, True)


@query()
def randomized_eigh(spark: SparkSession, d: str) -> DataFrame:
    """L29 on the markers of panel V: leading eigenvalues."""
    import numpy as np

    x = np.array([r.embedding for r in panels.read(spark, d, "embeddings").select("embedding", "vec_id").orderBy("vec_id").collect()], float)
    lam, _ = linalg.randomized_eigh(linalg.standardise(x.T).T, rank=10)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(lam)], "k int, eigenvalue double")


@query()
def epi_tier2(spark: SparkSession, d: str) -> DataFrame:
    """C: the five best marginal variants of each phenotype against all."""
    v, s, p = _inputs(spark, d)
    return association.gwas_epi(v, s, p, marginals=_ols(spark, d), marginal_top_k=5, top_k=50, n_perm=5, window=3000)["pairs"]


@query()
def epi_all_anchors(spark: SparkSession, d: str) -> DataFrame:
    """L35 over all unordered pairs of all variants, for every phenotype."""
    v, s, p = _inputs(spark, d)
    return association.gwas_epi(v, s, p, p_threshold=0.05, window=3000)["pairs"]


for _name, _sql in list(SQL.items()):
    # A query's own clauses follow the panel's: a bare SELECT needs no comma between them.
    _head = f"WITH {panels.SQL.strip()}"
    _own = _sql[len(_head) :]
    if _own.startswith("RECURSIVE "):
        SQL[_name] = "WITH RECURSIVE " + panels.SQL.strip() + _own[len("RECURSIVE ") :]
    elif not _own.startswith(","):
        SQL[_name] = _head + " " + _own
