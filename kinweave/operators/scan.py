"""Mixed-model scans on Spark.

One plan for every variant of the method:

1. spectra: for each fold (a chromosome left out, or one for all) and each
   pattern of missing values, one task decomposes the kinship: the matrix of
   samples, or, of fewer variants than samples, their factor, whose singular
   vectors are the matrix's and leave only directions of eigenvalue 0;
2. fit: columns, that is phenotypes and their permutations, come in chunks of
   about ``COLUMNS``, chunks in a few lanes; a task fits delta for the chunks
   of one fold and lane;
3. scan: a task tests one block of ``BLOCK`` variants against the chunks of one
   lane. Real phenotypes give result rows, p-values included; permuted columns
   only their largest F, so nothing of size variants x permutations leaves a task;
4. the relational tail: quantiles, significance, groups, order.

Permutations are made in the tasks from (seed, column) and rotated there;
neither they nor rotated columns travel. What travels once is the table of
real phenotypes (samples x phenotypes, a broadcast).
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.special import f_sf, f_sf_udf
from kinweave.operators import linalg
from kinweave.operators.kinship import assembled, chromosome_sums, dosage_matrix, fold_factors, fold_tiles

BLOCK, COLUMNS, LANES = 1024, 4096, 8
#: Numbers of the columns of a chunk (64 MB), which holds fewer columns where samples are many.
CELLS = 1 << 23
RESULT = "kind int, variant_idx int, pheno_idx int, perm int, f double, beta double, se double, sfve double, nullh2 double, p double, effect double"


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(blob)))


def coded(dosage: np.ndarray) -> np.ndarray:
    """Whole dosages in a byte each, missing as -1; others as they are."""
    called = np.isfinite(dosage)
    codes = np.where(called, dosage, -1).astype(np.int8)
    return codes if np.array_equal(np.where(called, codes, 0), np.where(called, dosage, 0)) and not (codes[called] < 0).any() else dosage


def opened(blob: bytes, x: np.ndarray, plain: bool) -> dict[str, np.ndarray]:
    """Arrays of a fold's model: s, u, rest and, of the plain path, ux. A factor travels as dosages and v, from which u is made again."""
    m = unpack(blob)
    if "codes" in m:
        codes = m.pop("codes")
        z = linalg.standardise(np.where(codes < 0, np.nan, codes) if codes.dtype == np.int8 else codes).T
        m["u"] = (z if plain else z - x @ (np.linalg.pinv(x) @ z)) @ m.pop("v")
        m["rest"] = np.array(len(x) - len(m["s"]) - (0 if plain else x.shape[1]))
    if plain:
        m["ux"] = m["u"].T @ x
    return m


def factor_model(table: pa.Table, places: np.ndarray, x: np.ndarray, plain: bool) -> bytes:
    """Model of a fold from its variants, fewer than samples: K = z z' / M has the singular vectors of z, whose other eigenvalues are 0."""
    order = np.argsort(table.column("variant_idx").to_numpy())
    dosage = dosage_matrix(table.column("dosage").combine_chunks(), places)[order]
    z = linalg.standardise(dosage).T
    s, v = linalg.factor_basis(z if plain else z - x @ (np.linalg.pinv(x) @ z))
    return pack(s=s + (linalg.RIDGE if plain else 0), v=v, codes=coded(dosage))


@dataclass
class Design:
    """Phenotypes (samples x P, NaN is missing) with their column numbers, covariates with the intercept first, and the samples' places in the dosage arrays; ``kin_places`` in those of another kinship panel."""

    y: np.ndarray
    columns: np.ndarray
    x: np.ndarray
    places: np.ndarray
    names: list[str] = field(default_factory=list)
    raw: np.ndarray | None = None
    kin_places: np.ndarray | None = None

    def patterns(self, min_minor: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
        """A3: (samples kept, phenotypes) of each pattern of missing values, in first-seen order; raw discrete phenotypes that are degenerate within their pattern (F8) are left out."""
        found: dict[bytes, list[int]] = {}
        for j in range(self.y.shape[1]):
            found.setdefault(np.packbits(np.isfinite(self.y[:, j])).tobytes(), []).append(j)
        out = []
        for cols in found.values():
            keep = np.flatnonzero(np.isfinite(self.y[:, cols[0]]))
            if min_minor and self.raw is not None and len(keep):
                cols = [j for j in cols if not self.raw[j] or not linalg.flat(self.y[keep, j], min_minor)]
            if cols:
                out.append((keep, np.array(cols)))
        return out


def design(samples: DataFrame, phenos: DataFrame, covars: DataFrame | None = None, kin_samples: DataFrame | None = None) -> Design:
    """Collects the model's small side, as Arrow columns: samples x phenotypes, never the genotypes. ``kin_samples``: iid and sample_idx of the kinship panel."""
    own = samples.select("iid", "sample_idx").toPandas().sort_values("sample_idx")
    y = phenos.select("iid", "pheno_idx", "pheno", "value", *(["raw"] if "raw" in phenos.columns else [])).toArrow().to_pandas()
    names = y.drop_duplicates("pheno_idx").sort_values("pheno_idx")
    y = y.pivot(index="iid", columns="pheno_idx", values="value").reindex(own.iid)
    x = np.ones((len(own), 1))
    if covars is not None:
        c = covars.select("iid", "covs").toPandas().set_index("iid").covs.reindex(own.iid)
        x = np.column_stack([x, np.array(c.tolist(), float)])
    kin = None
    if kin_samples is not None:
        kin = kin_samples.select("iid", "sample_idx").toPandas().drop_duplicates("iid").set_index("iid").sample_idx.reindex(own.iid)
        if kin.isna().any():
            raise ValueError("the kinship panel lacks samples of the design")
        kin = kin.to_numpy().astype(int)
    return Design(y.to_numpy(float), names.pheno_idx.to_numpy(), x, own.sample_idx.to_numpy(), names.pheno.tolist(), names.raw.to_numpy(bool) if "raw" in names else None, kin)


def columns_of(y: np.ndarray, numbers: np.ndarray, n_perm: int, seed: int) -> np.ndarray:
    """Real phenotypes, then each one's permutations, phenotype by phenotype."""
    parts = [y]
    for j, c in enumerate(numbers):
        parts.append(y[linalg.permutation_orders(n_perm, len(y), seed, int(c)), j].T)
    return np.column_stack(parts) if n_perm else y


def scan(variants: DataFrame, d: Design, *, loco: bool = True, n_perm: int = 0, seed: int = 19930909, kinship: DataFrame | None = None, rank: str = "full", reml: bool = False, min_minor: int = 0) -> DataFrame:
    """Rows of kind 0 (results of real phenotypes) and 1 (largest F of each permutation in a block).

    ``rank``: full (projected basis), low (factor of the kinship variants) or plain (covariates kept in the basis).
    ``kinship``: another panel of variants for the kinship; the design's ``kin_places`` name its samples if their order differs.
    """
    panel = variants if kinship is None else kinship
    tested = sorted(r.c for r in variants.select(F.col("chrom").cast("string").alias("c")).distinct().collect())
    have = set(tested) if kinship is None else {r.c for r in panel.select(F.col("chrom").cast("string").alias("c")).distinct().collect()}
    if loco and kinship is None and len(tested) < 2:
        raise ValueError("leaving out the only chromosome leaves no kinship")
    if loco and set(tested) - have:
        raise ValueError(f"the kinship panel lacks chromosomes {sorted(set(tested) - have)}")
    if loco and len(have) < 2:
        raise ValueError("leaving out the only chromosome leaves no kinship")
    folds = {c: {c} for c in tested} if loco else {"all": set()}
    out = None
    for keep, cols in d.patterns(min_minor):
        if len(keep) - d.x.shape[1] - 1 < 1:
            continue
        part = _scan_pattern(variants, panel, d, keep, cols, folds, n_perm, seed, rank, reml)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no phenotype has enough samples")
    return out


def _scan_pattern(variants: DataFrame, panel: DataFrame, d: Design, keep: np.ndarray, cols: np.ndarray, folds: dict[str, set[str]], n_perm: int, seed: int, rank: str, reml: bool) -> DataFrame:
    spark = variants.sparkSession
    places, x, plain, loco = d.places[keep], d.x[keep], rank == "plain", "all" not in folds
    kin_places = (d.places if d.kin_places is None else d.kin_places)[keep]
    numbers = d.columns[cols]
    sent = spark.sparkContext.broadcast(d.y[np.ix_(keep, cols)])
    each = max(1, min(COLUMNS, CELLS // len(places)) // (1 + n_perm))
    chunks = [slice(a, min(a + each, len(cols))) for a in range(0, len(cols), each)]
    lanes = min(LANES, -(-len(chunks) // 4))
    spectra = (_lowrank_spectra(panel, kin_places, x, folds) if rank == "low" else _spectra(panel, kin_places, x, folds, plain)).persist()
    pinv = np.linalg.pinv(x)

    def rotated(m: dict[str, np.ndarray], chunk: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray | linalg.Off | None]:
        y = columns_of(sent.value[:, chunk], numbers[chunk], n_perm, seed)
        if plain:
            uy = m["u"].T @ y
            return y, uy, linalg.off_basis(m["u"], x, m["ux"], y, uy)
        return (y, *linalg.rotated(linalg.Spectrum(m["s"], m["u"], x, pinv, int(m["rest"])), y))

    def fit(table: pa.Table) -> pa.Table:
        m, lane = opened(table.column("model")[0].as_py(), x, plain), table.column("lane")[0].as_py()
        own, deltas = range(lane, len(chunks), lanes), []
        for c in own:
            _, uy, off = rotated(m, chunks[c])
            deltas.append(linalg.plain_fit(m["s"], m["ux"], uy, reml, off) if plain else linalg.fit_delta(linalg.Spectrum(m["s"], m["u"], x, pinv, int(m["rest"])), uy, off))
        n = len(own)
        return pa.table({"fold": pa.array([table.column("fold")[0].as_py()] * n, pa.string()), "lane": pa.array([lane] * n, pa.int32()), "chunk": pa.array(list(own), pa.int32()), "log_delta": pa.array([x.tolist() for x in deltas], pa.list_(pa.float64()))})

    laned = spectra.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    fitted = laned.groupBy("fold", "lane").applyInArrow(fit, "fold string, lane int, chunk int, log_delta array<double>").persist()

    fold = F.col("chrom").cast("string") if loco else F.lit("all")
    left = variants.select(fold.alias("fold"), F.floor(F.col("variant_idx") / BLOCK).cast("int").alias("block"), "variant_idx", "dosage", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    blocks = left.select(F.col("fold").alias("fold_"), F.col("block").alias("block_"), F.col("lane").alias("lane_")).distinct()
    models = spectra.select(F.col("fold").alias("fold_"), F.lit(-1).alias("chunk"), "model", F.lit(None).cast("array<double>").alias("log_delta"))
    deltas = fitted.select(F.col("fold").alias("fold_"), F.col("lane").alias("lane_"), "chunk", F.lit(None).cast("binary").alias("model"), "log_delta")
    right = blocks.join(models, "fold_").select("fold_", "block_", "lane_", "chunk", "model", "log_delta").unionByName(blocks.join(deltas, ["fold_", "lane_"]).select("fold_", "block_", "lane_", "chunk", "model", "log_delta"))
    nu = float(len(places) - x.shape[1] - 1)
    schema = pa.schema([(c, pa.int32()) for c in ("kind", "variant_idx", "pheno_idx", "perm")] + [(c, pa.float64()) for c in ("f", "beta", "se", "sfve", "nullh2", "p", "effect")])

    def test(tests: pa.Table, models: pa.Table) -> pa.Table:
        if not tests.num_rows:
            return schema.empty_table()
        tests = tests.sort_by("variant_idx")
        index = tests.column("variant_idx").to_numpy()
        dosage = dosage_matrix(tests.column("dosage").combine_chunks(), places)
        z = linalg.standardise(dosage).T
        called = np.isfinite(dosage)
        count = np.maximum(called.sum(1), 1)
        mean = np.where(called, dosage, 0).sum(1) / count
        var_g = (np.where(called, dosage - mean[:, None], 0) ** 2).sum(1) / count
        del dosage, called
        own = models.sort_by("chunk")
        m = opened(own.column("model")[0].as_py(), x, plain)
        spec = None if plain else linalg.Spectrum(m["s"], m["u"], x, pinv, int(m["rest"]))
        tested = m["u"].T @ z if plain else linalg.prepared(spec, z)
        frames = []
        for c, log_delta in zip(own.column("chunk").to_pylist()[1:], own.column("log_delta").to_pylist()[1:], strict=True):
            log_delta, at = np.array(log_delta), chunks[c]
            y, uy, off = rotated(m, at)
            real, n = at.stop - at.start, len(index)
            if plain:
                got = linalg.plain_wald(m["s"], m["ux"], uy, log_delta, tested, off=linalg.with_tests(off, x, m["ux"], y, uy, z, tested))
                got["sfve"] = np.full_like(got["f"], np.nan)
            else:
                got = linalg.wald(spec, uy, off, log_delta, y, tested)
            h2, own_numbers = 1 / (1 + np.exp(log_delta)), numbers[at]
            f = got["f"][:, :real]
            effect = got["beta"][:, :real] ** 2 * var_g[:, None] / np.maximum(y[:, :real].var(0), 1e-300)
            flat = lambda v: np.ascontiguousarray(v.T).ravel()
            frames.append([np.zeros(n * real, np.int32), np.tile(index, real), np.repeat(own_numbers, n), np.full(n * real, -1), flat(f), *(flat(got[k][:, :real]) for k in ("beta", "se", "sfve")), np.repeat(h2[:real], n), f_sf(flat(f), nu), flat(effect)])
            if n_perm:
                with np.errstate(all="ignore"):
                    top = np.fmax.reduce(got["f"][:, real:], axis=0, initial=-np.inf)
                k = real * n_perm
                none = np.full(k, np.nan)
                frames.append([np.ones(k, np.int32), np.full(k, -1), np.repeat(own_numbers, n_perm), np.tile(np.arange(n_perm), real), top, none, none, none, h2[real:], none, none])
        return pa.table([pa.array(np.concatenate(v), t.type) for v, t in zip(zip(*frames, strict=True), schema, strict=True)], schema=schema)

    out = left.groupBy("fold", "lane", "block").cogroup(right.groupBy("fold_", "lane_", "block_")).applyInArrow(test, RESULT)
    return out.withColumn("nu", F.lit(nu)).withColumn("n", F.lit(len(places)))


def _spectra(panel: DataFrame, places: np.ndarray, x: np.ndarray, folds: dict[str, set[str]], plain: bool) -> DataFrame:
    # Where x has rank below D, N3 drops a direction that only the whole matrix names.
    if panel.count() < len(x) and (plain or np.linalg.matrix_rank(x) == x.shape[1]):

        def factor(table: pa.Table) -> pa.Table:
            return pa.table({"fold": [table.column("fold")[0].as_py()], "model": pa.array([factor_model(table, places, x, plain)], pa.binary())})

        return fold_factors(panel, folds).groupBy("fold").applyInArrow(factor, "fold string, model binary")

    def decompose(table: pa.Table) -> pa.Table:
        k = assembled(table, len(x))
        if plain:
            s, u, _ = linalg.plain_spectrum(k, x)
            blob = pack(s=s, u=u)
        else:
            spec = linalg.projected_spectrum(k, x)
            blob = pack(s=spec.s, u=spec.u, rest=np.array(0))
        return pa.table({"fold": [table.column("fold")[0].as_py()], "model": pa.array([blob], pa.binary())})

    return fold_tiles(chromosome_sums(panel, places), folds).groupBy("fold").applyInArrow(decompose, "fold string, model binary")


def _lowrank_spectra(panel: DataFrame, places: np.ndarray, x: np.ndarray, folds: dict[str, set[str]]) -> DataFrame:
    """Each fold's factor is gathered in one task: kinship variants are a bounded, spaced choice (S6), samples many."""
    rows = fold_factors(panel, folds)

    def decompose(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("variant_idx").to_numpy())
        spec = linalg.lowrank_spectrum(linalg.standardise(dosage_matrix(table.column("dosage").combine_chunks(), places))[order].T, x)
        return pa.table({"fold": [table.column("fold")[0].as_py()], "model": pa.array([pack(s=spec.s, u=spec.u, rest=np.array(spec.rest))], pa.binary())})

    return rows.groupBy("fold").applyInArrow(decompose, "fold string, model binary")


def results(scanned: DataFrame) -> DataFrame:
    """Real phenotypes with p-values."""
    return scanned.where("kind = 0").drop("kind", "perm")


def permutation_minima(scanned: DataFrame) -> DataFrame:
    """A5: pheno_idx, perm and smallest p over the genome, from the largest F of all blocks."""
    top = scanned.where("kind = 1").groupBy("pheno_idx", "perm", "nu").agg(F.max("f").alias("f"))
    return top.withColumn("min_p", f_sf_udf("f", "nu")).select("pheno_idx", "perm", "min_p")


def thresholds(minima: DataFrame, q: float = 0.05) -> DataFrame:
    """A4: exact, linearly interpolated quantile of each phenotype's smallest p-values."""
    return minima.groupBy("pheno_idx").agg(F.expr(f"percentile(min_p, {q!r}D)").alias("threshold"), F.count(F.lit(1)).alias("n_perm"))
