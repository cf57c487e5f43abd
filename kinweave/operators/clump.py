"""Linkage groups of hits.

Hits stand in cells: blocks of at most ``CELL`` variants of one stretch of a
chromosome as long as the window. A cell meets itself and the next stretch's
cells (every other cell if there is no window), so the range join is an equi
join on cells, and a task correlates two cells by matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.kinship import dosage_matrix
from kinweave.sources.shared import materialize

CELL = 256


def pairwise_r2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared correlation of all rows of a with all of b over the samples that both call (NaN is missing); 0 where one doesn't vary."""
    ma, mb = np.isfinite(a), np.isfinite(b)
    x, y, ma, mb = np.where(ma, a, 0.0), np.where(mb, b, 0.0), ma.astype(float), mb.astype(float)
    n, sx, sy = ma @ mb.T, x @ mb.T, ma @ y.T
    cov = n * (x @ y.T) - sx * sy
    va, vb = n * ((x * x) @ mb.T) - sx * sx, n * (ma @ (y * y).T) - sy * sy
    ok = (va > 1e-12) & (vb > 1e-12)
    return np.where(ok, cov * cov / np.where(ok, va * vb, 1.0), 0.0)


def _cells(hits: DataFrame, variants: DataFrame, window: int | None) -> tuple[DataFrame, DataFrame]:
    """cell, variant_idx, chrom, pos, dosage of every variant that is a hit of some phenotype; and the pairs of cells (x, y) that may hold linked hits."""
    own = hits.select("variant_idx", F.col("chrom").cast("string").alias("c"), F.col("pos").cast("double").alias("at")).distinct()
    stretch = F.struct(F.lit("").alias("c"), F.lit(0).cast("long").alias("bin")) if window is None else F.struct("c", F.floor(F.col("at") / max(window, 1)).cast("long").alias("bin"))
    own = own.withColumn("stretch", stretch)
    size = own.groupBy("stretch").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    own = own.join(size, "stretch").withColumn("part", F.pmod(F.xxhash64("variant_idx"), F.col("parts")).cast("int"))
    cells = own.select("stretch", "part").distinct().select(F.concat_ws("/", "stretch.c", F.col("stretch.bin").cast("string"), F.col("part").cast("string")).alias("cell"), F.col("stretch.c").alias("c"), F.col("stretch.bin").alias("bin"))
    left = cells.select(F.col("cell").alias("x"), "c", F.explode(F.array("bin", F.col("bin") + 1) if window is not None else F.array("bin")).alias("bin"), F.col("bin").alias("home"))
    pairs = left.join(cells.withColumnRenamed("cell", "y"), ["c", "bin"]).where((F.col("home") < F.col("bin")) | (F.col("x") <= F.col("y"))).select("x", "y")
    rows = own.select(F.concat_ws("/", "stretch.c", F.col("stretch.bin").cast("string"), F.col("part").cast("string")).alias("cell"), "variant_idx", "c", "at")
    return rows.join(variants.select("variant_idx", "dosage"), "variant_idx"), pairs


def correlated(hits: DataFrame, variants: DataFrame, window: int | None = 50_000, least: float = 0.0, keep: np.ndarray | None = None) -> DataFrame:
    """A, b, r2 of variants (a before b by place, then index) that are hits, on one chromosome within ``window`` base pairs (None: anywhere), with r2 of at least ``least``; ``keep``: places of the samples that count."""
    cells, pairs = _cells(hits, variants, window)
    pairs = materialize(pairs, "cell-pairs")
    left = pairs.join(cells.withColumnRenamed("cell", "x"), "x")
    right = pairs.join(cells.withColumnRenamed("cell", "y"), "y").select(*[F.col(c).alias(f"{c}_") for c in ("x", "y", "variant_idx", "at", "dosage")])

    def test(one: pa.Table, two: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], pa.int32()), "b": pa.array([], pa.int32()), "r2": pa.array([], pa.float64())})
        if not one.num_rows or not two.num_rows:
            return empty
        i, j = one.column("variant_idx").to_numpy(), two.column("variant_idx_").to_numpy()
        pi, pj = one.column("at").to_numpy(), two.column("at_").to_numpy()
        r2 = pairwise_r2(dosage_matrix(one.column("dosage").combine_chunks(), keep), dosage_matrix(two.column("dosage_").combine_chunks(), keep))
        ok = r2 >= least
        if window is not None:
            ok &= np.abs(pi[:, None] - pj) <= window
        if one.column("x")[0].as_py() == one.column("y")[0].as_py():
            ok &= i[:, None] < j
        r, c = np.nonzero(ok)
        first = (pi[r] < pj[c]) | ((pi[r] == pj[c]) & (i[r] < j[c]))
        a, b = np.where(first, i[r], j[c]), np.where(first, j[c], i[r])
        return pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "r2": pa.array(r2[r, c], pa.float64())})

    return left.groupBy("x", "y").cogroup(right.groupBy("x_", "y_")).applyInArrow(test, "a int, b int, r2 double")


def ld_pairs(hits: DataFrame, variants: DataFrame, window: int | None = 50_000, least: float = 0.0, keep: np.ndarray | None = None) -> DataFrame:
    """pheno_idx, a, b, r2 of the pairs of ``correlated`` of which both are hits of the phenotype."""
    found = correlated(hits, variants, window, least, keep)
    one, two = (hits.select("pheno_idx", F.col("variant_idx").alias(x)).distinct() for x in "ab")
    return found.join(one, "a").join(two, ["pheno_idx", "b"]).select("pheno_idx", "a", "b", "r2")


def components(links: DataFrame) -> DataFrame:
    """pheno_idx, node and g (smallest node reachable) of every node of ``links`` (pheno_idx, a, b), by alternating large and small stars.

    Each round writes its links to the shared folder, so plans stay small; their
    number grows with the logarithm of the longest chain, and the loop ends
    only when nothing changes.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = materialize(links.select("pheno_idx", a, b).where("a <> b").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select("pheno_idx", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("pheno_idx", "a").agg(F.min("b").alias("m")).select("pheno_idx", "a", F.least("a", "m").alias("m"))
        large = both.join(least, ["pheno_idx", "a"]).where("b > a").select("pheno_idx", F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.join(large.groupBy("pheno_idx", "a").agg(F.min("b").alias("m")), ["pheno_idx", "a"])
        small = small.select("pheno_idx", F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("pheno_idx", "a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = materialize(small, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pheno_idx", "a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("pheno_idx", F.col("a").alias("node")).agg(F.min("b").alias("g"))
        before = now


def ld_groups(hits: DataFrame, variants: DataFrame, *, window: int | None = 50_000, r2: float = 0.5, keep: np.ndarray | None = None) -> DataFrame:
    """hits (pheno_idx, variant_idx, chrom, pos, p) with ld_group: connected hits, numbered by their smallest p. ``window`` None: any two hits may be linked, chromosomes included."""
    hits = materialize(hits, "hits")
    found = components(ld_pairs(hits, variants, window, r2, keep).select("pheno_idx", "a", "b"))
    rows = hits.join(found.withColumnRenamed("node", "variant_idx"), ["pheno_idx", "variant_idx"], "left").withColumn("g", F.coalesce("g", "variant_idx"))
    first = rows.groupBy("pheno_idx", "g").agg(F.min(F.struct("p", "variant_idx")).alias("first"))
    number = first.withColumn("ld_group", F.row_number().over(Window.partitionBy("pheno_idx").orderBy("first"))).drop("first")
    return rows.join(number, ["pheno_idx", "g"]).drop("g")
