"""Pairwise interaction scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.special import f_isf, f_sf, f_sf_udf
from kinweave.operators import linalg
from kinweave.operators.genotype import standardise
from kinweave.operators.kinship import assembled, chromosome_sums, dosage_matrix, fold_factors, fold_tiles
from kinweave.operators.scan import Design, factor_model, opened, pack, unpack

#: Anchors of a task, and numbers of a batch of products (64 MB).
ANCHORS, PRODUCTS = 64, 1 << 23
PAIRS = "pheno_idx int, perm int, i int, j int, f double, beta double, se double, p double"


def pair_masks(variants: DataFrame, window: int) -> DataFrame:
    """Unordered pairs (i before j) that aren't on one chromosome closer than ``window`` (strictly), as an upper triangle."""
    a = variants.select(F.col("variant_idx").alias("i"), F.col("chrom").alias("ci"), F.col("pos").alias("pi"))
    b = variants.select(F.col("variant_idx").alias("j"), F.col("chrom").alias("cj"), F.col("pos").alias("pj"))
    return a.join(b, (F.col("i") < F.col("j")) & ~((F.col("ci") == F.col("cj")) & (F.abs(F.col("pi") - F.col("pj")) < window)))


def pair_products_of(calls: DataFrame, window: int) -> DataFrame:
    """L33 in relational form, for small panels: i, j, iid and t, the product of standardised dosages, of all pairs that the masks allow."""
    z = standardise(calls).select("variant_idx", "chrom", "pos", "iid", "z")
    a = z.select(F.col("variant_idx").alias("i"), F.col("chrom").alias("ci"), F.col("pos").alias("pi"), "iid", F.col("z").alias("zi"))
    rows = a.join(z, "iid").where((F.col("variant_idx") > F.col("i")) & ~((F.col("ci") == F.col("chrom")) & (F.abs(F.col("pos") - F.col("pi")) < window)))
    return rows.select("i", F.col("variant_idx").alias("j"), "iid", (F.col("zi") * F.col("z")).alias("t"))


def permuted(y: np.ndarray, n_perm: int, seed: int) -> np.ndarray:
    """One generator for all columns; permutation k of phenotype p is column k * P + p."""
    n, p = y.shape
    order = np.random.default_rng(seed).random((n_perm, n, p)).argsort(axis=1)
    return np.concatenate([np.take_along_axis(y, order[k], axis=0) for k in range(n_perm)], axis=1) if n_perm else np.zeros((n, 0))


def scan_pairs(variants: DataFrame, d: Design, *, anchors: DataFrame | None = None, top_k: int = 1000, p_threshold: float | None = None, n_perm: int = 0, seed: int = 19930909, window: int = 25_000, var_floor: float = 1e-8, kinship: DataFrame | None = None) -> DataFrame:
    """Interactions of anchors (pheno_idx, variant_idx; all variants if None) with all variants, tile by tile.

    A tile is a pair of chromosomes; its kinship leaves both out, so (a, b) and
    (b, a) share one decomposition, and delta is fitted once with the covariates
    alone. A task takes up to ``ANCHORS`` anchors of a tile: their standardised
    products with the tile's variants are rotated together and tested with the
    design [covariates, anchor]. Each task hands out the best ``top_k`` pairs of
    a phenotype, or all pairs below ``p_threshold``, and the largest F of each
    permutation; permutations are made in the tasks. ``kinship``: another panel
    of the same samples for the kinship.
    """
    spark = variants.sparkSession
    symmetric = anchors is None
    if not np.isfinite(d.y).all():
        raise ValueError("interaction scans need complete phenotypes")
    x = d.x[:, linalg.independent_columns(d.x)]
    real, nu = d.y.shape[1], float(len(x) - x.shape[1] - 2)
    sent, numbers, places = spark.sparkContext.broadcast(d.y), d.columns, d.places
    cut = f_isf(p_threshold, nu) if p_threshold is not None else None
    rows = variants.select(F.col("chrom").cast("string").alias("chrom"), "variant_idx", "pos", "dosage")
    # Chromosomes in the order of the variants, so the first of a pair is its anchor.
    chroms = [r.chrom for r in rows.groupBy("chrom").agg(F.min("variant_idx").alias("first")).orderBy("first").collect()]
    place = {c: k for k, c in enumerate(chroms)}
    if anchors is None:
        listed = rows.select("chrom", "variant_idx").withColumn("phenos", F.lit(None).cast("array<int>"))
    else:
        listed = anchors.groupBy("variant_idx").agg(F.sort_array(F.collect_set("pheno_idx")).cast("array<int>").alias("phenos")).join(rows.select("chrom", "variant_idx"), "variant_idx")
    listed = listed.persist()
    count = {r.chrom: r["count"] for r in listed.groupBy("chrom").count().collect()}
    tiles = [(a, b, min(a, b), max(a, b), -(-count[a] // ANCHORS)) for a in sorted(count, key=place.get) for b in chroms if not symmetric or place[a] <= place[b]]
    if any(not set(chroms) - {a, b} for a, b, *_ in tiles):
        raise ValueError("a tile leaves no chromosome for the kinship")
    if not tiles:
        raise ValueError("no anchor is left")
    plan = F.broadcast(spark.createDataFrame(tiles, "ca string, cb string, lo string, hi string, parts int"))

    def columns() -> np.ndarray:
        return np.column_stack([sent.value, permuted(sent.value, n_perm, seed)])

    panel = variants if kinship is None else kinship
    few = panel.count() < len(x)

    def fit(table: pa.Table) -> pa.Table:
        if few:
            blob = factor_model(table, places, x, True)
        else:
            s, u, _ = linalg.plain_spectrum(assembled(table, len(x)), x)
            blob = pack(s=s, u=u)
        m, y = opened(blob, x, True), columns()
        uy = m["u"].T @ y
        log_delta = linalg.plain_fit(m["s"], m["ux"], uy, off=linalg.off_basis(m["u"], x, m["ux"], y, uy))
        lo, hi = table.column("fold")[0].as_py().split("\t")
        return pa.table({"lo": [lo], "hi": [hi], "model": pa.array([pack(log_delta=log_delta, **unpack(blob))], pa.binary())})

    folds = {f"{lo}\t{hi}": {lo, hi} for _, _, lo, hi, _ in tiles}
    parts_of = fold_factors(panel, folds) if few else fold_tiles(chromosome_sums(panel, places), folds)
    models = parts_of.groupBy("fold").applyInArrow(fit, "lo string, hi string, model binary").persist()
    left = listed.withColumnRenamed("chrom", "ca").join(rows.select("variant_idx", "pos", "dosage"), "variant_idx").join(plan, "ca")
    left = left.select("ca", "cb", "lo", "hi", F.pmod(F.xxhash64("variant_idx"), F.col("parts")).cast("int").alias("part"), F.col("variant_idx").alias("i"), F.col("pos").alias("pi"), F.col("dosage").alias("di"), "phenos")
    parts = left.select(F.col("ca").alias("ca_"), F.col("cb").alias("cb_"), F.col("part").alias("part_"), "lo", "hi").distinct()
    own = ["ca_", "cb_", "part_", "variant_idx", "pos", "dosage", "model"]
    right = parts.join(rows.withColumnRenamed("chrom", "cb_"), "cb_").withColumn("model", F.lit(None).cast("binary")).select(*own)
    of_model = parts.join(models, ["lo", "hi"]).withColumns({"variant_idx": F.lit(-1).cast(dict(rows.dtypes)["variant_idx"]), "pos": F.lit(None).cast(dict(rows.dtypes)["pos"]), "dosage": F.lit(None).cast(dict(rows.dtypes)["dosage"])})
    right = right.unionByName(of_model.select(*own))
    schema = pa.schema([(c, pa.int32()) for c in ("pheno_idx", "perm", "i", "j")] + [(c, pa.float64()) for c in ("f", "beta", "se", "p")])

    def test(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows:
            return schema.empty_table()
        model = opened(next(m for m in two.column("model").to_pylist() if m), x, True)
        two = two.filter(pa.compute.greater_equal(two.column("variant_idx"), 0)).sort_by("variant_idx")
        jj, pj = two.column("variant_idx").to_numpy(), two.column("pos").to_numpy()
        sj = linalg.standardise(dosage_matrix(two.column("dosage").combine_chunks(), places))
        same = one.column("ca")[0].as_py() == one.column("cb")[0].as_py()
        si = linalg.standardise(dosage_matrix(one.column("di").combine_chunks(), places))
        y = columns()
        ui, uy = model["u"].T @ si.T, model["u"].T @ y
        ii, pi, phenos = one.column("i").to_numpy(), one.column("pi").to_numpy(), one.column("phenos").to_pylist()
        out, top = [], np.full(uy.shape[1] - real, -np.inf)
        step = max(1, PRODUCTS // max(1, sj.size))
        for a in range(0, len(ii), step):
            chosen = []  # (anchor, variants) of the pairs of a batch
            for r in range(a, min(a + step, len(ii))):
                ok = ((sj * si[r]).var(1) > var_floor) & (jj != ii[r])
                if same:
                    ok &= ~(np.abs(pj - pi[r]) < window)
                    if symmetric:
                        ok &= jj > ii[r]
                if ok.any():
                    chosen.append((r, np.flatnonzero(ok)))
            if not chosen:
                continue
            products = np.concatenate([linalg.standardise(sj[k] * si[r]) for r, k in chosen]).T
            rotated = model["u"].T @ products
            at = 0
            for r, k in chosen:
                us, t = rotated[:, at : at + len(k)], products[:, at : at + len(k)]
                at += len(k)
                xi, uxi = np.column_stack([x, si[r]]), np.column_stack([model["ux"], ui[:, r]])
                off = linalg.with_tests(linalg.off_basis(model["u"], xi, uxi, y, uy), xi, uxi, y, uy, t, us)
                got = linalg.plain_wald(model["s"], uxi, uy, model["log_delta"], us, guard=True, off=off)
                with np.errstate(all="ignore"):
                    top = np.fmax(top, np.fmax.reduce(got["f"][:, real:], axis=0, initial=-np.inf))
                for p in range(real) if phenos[r] is None else np.flatnonzero(np.isin(numbers, phenos[r])):
                    f = got["f"][:, p]
                    best = np.flatnonzero(f > cut) if cut is not None else np.argsort(-f, kind="stable")[:top_k]
                    n = len(best)
                    out.append((np.full(n, numbers[p]), np.full(n, -1), np.full(n, ii[r]), jj[k][best], f[best], got["beta"][best, p], got["se"][best, p], f_sf(f[best], nu)))
        if n_perm:
            none = np.full(len(top), np.nan)
            out.append((np.tile(numbers, n_perm), np.repeat(np.arange(n_perm), real), np.full(len(top), -1), np.full(len(top), -1), top, none, none, none))
        if not out:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(v), t.type) for v, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    found = left.groupBy("ca", "cb", "part").cogroup(right.groupBy("ca_", "cb_", "part_")).applyInArrow(test, PAIRS).withColumn("nu", F.lit(nu)).persist()
    order = Window.partitionBy("pheno_idx").orderBy(F.desc("f"), "i", "j")
    best = found.where("perm < 0").withColumn("rank", F.row_number().over(order))
    if cut is None:
        best = best.where(F.col("rank") <= top_k)
    rest = found.where("perm >= 0").withColumn("rank", F.lit(0))
    return best.unionByName(rest)


def pair_results(found: DataFrame) -> DataFrame:
    return found.where("perm < 0").drop("perm")


def pair_thresholds(found: DataFrame, q: float = 0.05) -> DataFrame:
    """Quantile of the smallest p of each permutation over the whole run."""
    top = found.where("perm >= 0 AND f > double('-Infinity')").groupBy("pheno_idx", "perm", "nu").agg(F.max("f").alias("f")).withColumn("min_p", f_sf_udf("f", "nu"))
    return top.groupBy("pheno_idx").agg(F.expr(f"percentile(min_p, {q!r}D)").alias("threshold"))
