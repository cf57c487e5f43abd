import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import clump, genotype, kinship, linalg, post, prep, scan
from kinweave.operators.epistasis import permuted, scan_pairs
from kinweave.plans import catalog
from kinweave.sources import files, panels, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(7)
    n, m = 36, 24
    g = rng.binomial(2, 0.4, (m, n)).astype(float)
    rows = [(i, f"v{i}", i // 8 + 1, 1000 * (i % 8 + 1), [None if rng.random() < 0.03 else float(v) for v in g[i]]) for i in range(m)]
    variants = spark.createDataFrame(rows, "variant_idx int, sid string, chrom int, pos int, dosage array<double>").repartition(3)
    samples = spark.createDataFrame([(f"s{j}", j) for j in range(n)], "iid string, sample_idx int")
    y = rng.normal(size=(n, 3)) + g[[3]].T
    gaps = {(2, 5), (2, 11)}
    phenos = spark.createDataFrame([(f"s{j}", p, f"p{p}", None if (p, j) in gaps else float(y[j, p])) for j in range(n) for p in range(3)], "iid string, pheno_idx int, pheno string, value double")
    dosage = np.array([[np.nan if v is None else v for v in r[4]] for r in rows])
    return variants, samples, phenos, dosage, y, gaps


def test_scan_matches_dense(spark, inputs):
    variants, samples, phenos, dosage, y, _ = inputs
    d = scan.design(samples, phenos)
    got = {(r.variant_idx, r.pheno_idx): r for r in scan.results(scan.scan(variants, d)).collect()}
    assert len(got) == 24 * 3
    chrom = np.arange(24) // 8
    for p, keep in ((0, np.arange(36)), (2, np.array([j for j in range(36) if j not in (5, 11)]))):
        z = linalg.standardise(dosage[:, keep]).T
        for c in range(3):
            k = z[:, chrom != c] @ z[:, chrom != c].T / (chrom != c).sum()
            spec = linalg.projected_spectrum(k, np.ones((len(keep), 1)))
            uy, off = linalg.rotated(spec, y[keep][:, [p]])
            ld = linalg.fit_delta(spec, uy, off)
            want = linalg.wald(spec, uy, off, ld, y[keep][:, [p]], z[:, chrom == c])
            for i, f in zip(np.flatnonzero(chrom == c), want["f"][:, 0], strict=True):
                assert got[int(i), p].f == pytest.approx(f, rel=2e-5)  # delta is found to about 1e-8


def test_partitions_and_blocks_change_nothing(spark, inputs, monkeypatch):
    variants, samples, phenos, *_ = inputs
    d = scan.design(samples, phenos.where("pheno_idx < 2"))
    one = scan.scan(variants, d, n_perm=4)
    monkeypatch.setattr(scan, "BLOCK", 3)
    two = scan.scan(variants.repartition(7), d, n_perm=4, kinship=variants)
    for a, b in ((scan.results(one), scan.results(two)), (scan.permutation_minima(one), scan.permutation_minima(two))):
        keys = [c for c in a.columns if a.schema[c].dataType.simpleString() == "int"]
        x, z = a.toPandas().sort_values(keys), b.toPandas().sort_values(keys)
        col = "p" if "p" in x else "min_p"
        assert np.allclose(x[col], z[col], rtol=1e-6)
    with pytest.raises(ValueError):
        scan.scan(variants.where("chrom = 1"), d)
    with pytest.raises(ValueError):
        scan.scan(variants, d, kinship=variants.where("chrom < 3"))


def test_pairs_are_a_triangle_and_match_dense(spark, inputs):
    variants, samples, phenos, dosage, y, _ = inputs
    d = scan.design(samples, phenos.where("pheno_idx = 0"))
    few = variants.where("variant_idx IN (0, 1, 8, 9, 16, 17)")
    rows = scan_pairs(few, d, p_threshold=0.999999, window=500).where("perm < 0").collect()
    assert len({(r.i, r.j) for r in rows}) == len(rows) == 15 and all(r.i < r.j for r in rows)
    z = {i: linalg.standardise(dosage[[i]])[0] for i in (0, 1, 8, 9, 16, 17)}
    other = np.stack([z[16], z[17]], 1)
    s, u, ux = linalg.plain_spectrum(other @ other.T / 2, np.ones((36, 1)))
    ld = linalg.plain_fit(s, ux, u.T @ y[:, [0]])
    t = linalg.standardise((z[0] * z[9])[None])[0]
    want = linalg.plain_wald(s, np.column_stack([ux, u.T @ z[0]]), u.T @ y[:, [0]], ld, (u.T @ t)[:, None])["f"][0, 0]
    assert next(r.f for r in rows if (r.i, r.j) == (0, 9)) == pytest.approx(want, rel=1e-8)
    order = np.random.default_rng(3).random((2, 36, 3)).argsort(axis=1)
    assert np.array_equal(permuted(y, 2, 3)[:, 4], y[order[1, :, 1], 1])


def test_linkage_groups(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 200).astype(float)
    far = rng.integers(0, 3, 200).astype(float)
    rows = [(0, 1, 100, x), (1, 1, 150, x), (2, 1, 160, far), (3, 2, 100, x), (4, 1, 99_000, x)]
    v = spark.createDataFrame([(i, c, p, d.tolist()) for i, c, p, d in rows], "variant_idx int, chrom int, pos int, dosage array<double>")
    hits = v.select(F.lit(0).alias("pheno_idx"), "variant_idx", "chrom", "pos", (F.lit(0.01) + F.col("variant_idx") / 1000).alias("p"))
    got = {r.variant_idx: r.ld_group for r in clump.ld_groups(hits, v, window=1000, r2=0.5).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 3, 4: 4}


def test_linkage_groups_of_long_chains(spark):
    # 70 hits, each linked with the next only; the smallest index stands at one end.
    x = np.random.default_rng(1).integers(0, 3, 60).astype(float).tolist()
    v = spark.createDataFrame([(i, 1, 100 * i, x) for i in range(70)], "variant_idx int, chrom int, pos int, dosage array<double>")
    hits = v.select(F.lit(0).alias("pheno_idx"), "variant_idx", "chrom", "pos", F.lit(0.01).alias("p"))
    assert {r.ld_group for r in clump.ld_groups(hits, v, window=100, r2=0.5).collect()} == {1}


@pytest.mark.parametrize("whole", [1 << 20, 1])
def test_plink_round_trip(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(files, "WHOLE_BED", whole)
    calls = np.array([[2, 1, 0, np.nan, 2], [0, 0, 1, 1, np.nan]])
    codes = {2.0: 0, 1.0: 2, 0.0: 3}
    body = bytearray(files.BED_MAGIC)
    for row in calls:
        for a in range(0, 5, 4):
            b = 0
            for k, v in enumerate(row[a : a + 4]):
                b |= (1 if np.isnan(v) else codes[v]) << (2 * k)
            body.append(b)
    (tmp_path / "x.bed").write_bytes(bytes(body))
    (tmp_path / "x.bim").write_text("1.0\tva\t0\t10\tA\tG\n2.0\tvb\t0\t20\tC\tT\n")
    (tmp_path / "x.fam").write_text("".join(f"f i{j} 0 0 0 -9\n" for j in range(5)))
    v, fam = files.read_plink(spark, str(tmp_path / "x"))
    rows = {r.sid: r for r in v.collect()}
    assert rows["va"].dosage == [2.0, 1.0, 0.0, None, 2.0] and rows["vb"].dosage == [0.0, 0.0, 1.0, 1.0, None]
    assert rows["vb"].chrom == 2.0 and [r.iid for r in fam.orderBy("sample_idx").collect()] == [f"i{j}" for j in range(5)]


def test_tables_and_coding(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("Strain\tq\tcolour\tgrade\na\t1.5\twhite\tNo\nb\tNA\tRed\tpartial\nc\t2\tunknown\tYES\n")
    t = files.read_wide_phenotypes(spark, str(tmp_path / "p.tsv"))
    codes = prep.text_codes(t)
    assert {(r.pheno, r.label): (r.code, r.how) for r in codes.collect()} == {("q", "1.5"): (1.5, "numeric"), ("q", "2"): (2.0, "numeric"), ("colour", "red"): (0.0, "alphabetical"), ("colour", "white"): (1.0, "alphabetical"), ("grade", "no"): (0.0, "tiers"), ("grade", "partial"): (1.0, "tiers"), ("grade", "yes"): (2.0, "tiers")}
    wide = sinks.wide_matrix(prep.encode(t, codes)).orderBy("Strain").collect()
    assert [tuple(r) for r in wide] == [("a", 1.5, 1.0, 0.0), ("b", None, 0.0, 1.0), ("c", 2.0, None, 2.0)]
    with pytest.raises(ValueError):
        prep.encode(t, prep.text_codes(t, prep.parse_levels("grade=no,yes"))).count()
    with pytest.raises(ValueError):
        prep.parse_levels("a=b")
    (tmp_path / "c.tab").write_text("f a 1 0\nf b 0 1\n")
    assert {r.iid: r.covs for r in files.read_covariates(spark, str(tmp_path / "c.tab")).collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    (tmp_path / "s.txt").write_text("1.0 100\n2 x\n")
    with pytest.raises(ValueError):
        files.read_chrom_sizes(spark, str(tmp_path / "s.txt"))


def test_layout_and_merge(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, "10", 100, 0.5), (0, 1, "2", 50, 0.0), (0, 2, "1", 300, 0.01), (0, 3, "1", 20, 2.0)], "pheno_idx int, variant_idx int, chrom string, pos int, p double")
    got = {r.variant_idx: r for r in post.manhattan(rows).collect()}
    assert {k: r.x for k, r in got.items()} == {2: 300.0, 1: 350.0, 0: 450.0} and got[1].y == pytest.approx(2.0)
    rows.write.parquet(str(tmp_path / "a"))
    rows.drop("p").write.parquet(str(tmp_path / "b"))
    assert sinks.merge_bundles(spark, [str(tmp_path / "a")] * 1).count() == 4
    with pytest.raises(ValueError):
        sinks.merge_bundles(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    sinks.write_json(spark, str(tmp_path / "s.json"), {"state": "done"})
    assert files.read_status(spark, str(tmp_path / "s.json")).first().state == "done"


@pytest.mark.parametrize("name", ["scan_unstructured", "scan_plain_unstructured", "scan_lowrank_unstructured", "epi_unstructured", "pair_topk_ols", "bundle_union", "chrom_sizes", "variant_stats", "rint", "ols_pvalue", "lambda_gc", "ld_pairs", "na_groups", "text_codes", "one_vs_rest"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(catalog.SQL[name])
    want = sorted(rel.fetchall(), key=repr)
    got = sorted((tuple(r) for r in catalog.QUERIES[name](spark, SF).select(*rel.columns).collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, abs=2e-6) if isinstance(y, float) else x == y


def test_flagship_and_alignment(spark):
    rows = catalog.gwas_loco(spark, SF)
    assert rows.columns[:14] == list(sinks.GWAS_COLUMNS)
    got = rows.toPandas()
    assert len(got) == 500 and got.PValue.between(0, 1).all() and got.threshold.notna().all()
    assert (got.significant == (got.PValue < got.threshold)).all()
    e = panels.read(spark, SF, "events")
    with pytest.raises(ValueError):
        genotype.align(spark.createDataFrame([(-1,)], "iid long"), order=panels.samples(e))


def test_all_anchors_reach_all_variants_and_phenotypes(spark):
    from kinweave.plans import catalog

    rows = catalog.epi_all_anchors(spark, "/root/testdata/sf0.001").select("pheno_idx", "i", "j").collect()
    print(len(rows), len({(r.i, r.j) for r in rows}))
    assert min(r.i for r in rows) < 30 < 90 < max(r.j for r in rows) and max(r.i for r in rows) >= 30
    assert len({r.pheno_idx for r in rows}) > 1 and len({(r.pheno_idx, r.i, r.j) for r in rows}) == len(rows)


def test_whole_genome_window_and_missing_calls(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, 120).astype(float)
    gaps = [None if j % 7 == 0 else float(v) for j, v in enumerate(x)]
    rows = [(0, 1, 100, x.tolist()), (1, 2, 500_000, gaps), (2, 3, 100, x.tolist()), (3, 1, 120, rng.integers(0, 3, 120).astype(float).tolist()), (4, 1, 130, [1.0] * 120)]
    v = spark.createDataFrame(rows, "variant_idx int, chrom int, pos int, dosage array<double>")
    hits = v.select(F.lit(0).alias("pheno_idx"), "variant_idx", "chrom", "pos", (F.lit(0.01) + F.col("variant_idx") / 1000).alias("p"))
    assert {r.variant_idx: r.ld_group for r in clump.ld_groups(hits, v, window=None, r2=0.5).collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}
    assert len({r.ld_group for r in clump.ld_groups(hits, v, window=1000, r2=0.5).collect()}) == 5
    few = clump.ld_groups(hits, v, window=None, r2=0.5, keep=np.arange(60)).collect()
    assert len(few) == 5


def test_cells_change_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(5)
    d = rng.integers(0, 3, (40, 80)).astype(float)
    d[1::3] = d[::3][: len(d[1::3])]
    v = spark.createDataFrame([(i, i // 20 + 1, 37 * i, d[i].tolist()) for i in range(40)], "variant_idx int, chrom int, pos int, dosage array<double>")
    hits = v.select(F.lit(0).alias("pheno_idx"), "variant_idx", "chrom", "pos", F.lit(0.01).alias("p"))
    want = {(a, b) for a in range(40) for b in range(a + 1, 40) if a // 20 == b // 20 and 37 * (b - a) <= 300}
    r2 = {(a, b): np.corrcoef(d[a], d[b])[0, 1] ** 2 for a, b in want}
    for cell in (256, 3):
        monkeypatch.setattr(clump, "CELL", cell)
        got = {(r.a, r.b): r.r2 for r in clump.ld_pairs(hits, v, 300).collect()}
        assert set(got) == want and all(abs(got[k] - r2[k]) < 1e-9 for k in want)


def test_preparation_guards(spark):
    rows = [(f"s{j}", 0, "cont", -9.0 if j == 3 else j / 7) for j in range(12)] + [(f"s{j}", 1, "disc", [0.0, 1.0, -9.0][j % 3]) for j in range(12)]
    p = spark.createDataFrame(rows, "iid string, pheno_idx int, pheno string, value double")
    assert prep.prepare(p).count() == 24  # all are rank-normalised
    assert prep.prepare(p.where("pheno_idx = 0"), rint=False).count() == 12  # continuous
    for bad in ({"rint": False}, {"rint_discrete": False}, {"categorical": ("disc",), "rint": False}):
        if "categorical" in bad:
            assert set(r.pheno for r in prep.prepare(p, missing_code=-9, **bad).select("pheno").distinct().collect()) == {"cont", "disc__lvl1"}
            continue
        with pytest.raises(ValueError, match="disc"):
            prep.prepare(p, **bad).count()
        assert prep.prepare(p, missing_code=-9.0, **bad).where("value IS NULL").count() == 5
    with pytest.raises(ValueError):
        prep.prepare(p, categorical=("nothing",))


def test_degenerate_only_if_raw(spark, inputs):
    from kinweave.plans import association

    variants, samples, phenos, *_ = inputs
    rare = samples.select("iid", F.lit(9).alias("pheno_idx"), F.lit("rare").alias("pheno"), F.when(F.col("sample_idx") < 3, 1.0).otherwise(0.0).alias("value"))
    both = phenos.where("pheno_idx = 0").unionByName(rare)
    names = lambda **o: {r.Pheno for r in association.gwas(variants, samples, both, n_perm=2, **o)["results"].select("Pheno").distinct().collect()}
    assert names() == {"p0", "rare"} and names(rint_discrete=False) == {"p0"}


def test_chunks_and_lanes_change_nothing(spark, inputs, monkeypatch):
    variants, samples, phenos, *_ = inputs
    d = scan.design(samples, phenos)
    for rank in ("full", "low", "plain"):
        monkeypatch.setattr(scan, "COLUMNS", 4096)
        one = scan.scan(variants, d, n_perm=3, rank=rank)
        a, b = scan.results(one).toPandas(), scan.permutation_minima(one).toPandas()
        monkeypatch.setattr(scan, "COLUMNS", 4)
        monkeypatch.setattr(scan, "LANES", 2)
        two = scan.scan(variants, d, n_perm=3, rank=rank)
        c, e = scan.results(two).toPandas(), scan.permutation_minima(two).toPandas()
        for x, z, keys, col in ((a, c, ["variant_idx", "pheno_idx"], "p"), (b, e, ["pheno_idx", "perm"], "min_p")):
            assert np.allclose(x.sort_values(keys)[col], z.sort_values(keys)[col], rtol=1e-6)


def test_tiles_of_kinship(spark, inputs, monkeypatch):
    from kinweave.operators import kinship

    variants, _, _, dosage, *_ = inputs
    z, chrom = linalg.standardise(dosage), np.arange(24) // 8 + 1
    for tile in (512, 7):
        monkeypatch.setattr(kinship, "TILE", tile)
        rows = kinship.fold_tiles(kinship.chromosome_sums(variants), {"2": {"2"}, "all": set()}).toArrow()
        for fold, out in (("2", 2), ("all", 0)):
            own = rows.filter(F_equal(rows, fold))
            k = kinship.assembled(own, 36)
            assert np.allclose(k, z[chrom != out].T @ z[chrom != out] / (chrom != out).sum())


def F_equal(table, fold):
    import pyarrow.compute as pc

    return pc.equal(table.column("fold"), fold)


def test_simulated_panel_and_streams(spark, tmp_path):
    from kinweave.functions import special
    from kinweave.sources import simulate
    from kinweave.streaming import rollup

    v, s, p = simulate.sim_gwas(spark, 60, 40, n_causal=4, h2=0.8)
    assert v.count() == 40 and p.agg(F.var_pop("value")).first()[0] > 0.5
    scanned = scan.results(scan.scan(v, scan.design(s, p)))
    assert scanned.count() == 40
    out = scanned.select(F.lit("sim").alias("Pheno"), F.col("p").alias("PValue"), (F.col("p") < 0.05).alias("significant"))
    out.write.parquet(str(tmp_path / "b"))
    live = rollup.bundle_progress(spark, str(tmp_path / "b"), out.schema).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    live.awaitTermination(120)
    row = spark.table("live").first()
    assert (row.rows, row.hits) == (40, out.where("significant").count())
    special.register(spark)
    got = spark.sql("SELECT f_sf(4.0D, 20.0D) AS a, f_isf(0.05D, 20.0D) AS b, norm_ppf(0.975D) AS c, chi2_isf(0.05D) AS d").first()
    assert got.a == pytest.approx(0.0593, abs=1e-3) and got.b == pytest.approx(4.3512, abs=1e-3) and got.c == pytest.approx(1.95996, abs=1e-4) and got.d == pytest.approx(3.8415, abs=1e-3)
    events = spark.createDataFrame([(1.0, "a", "x"), (2.0, "a", "x"), (30.0, "a", "x"), (31.0, "b", "x")], "ts double, stage string, state string")
    assert [(r.ts, r.stage) for r in post.recent_events(events, 2).collect()] == [(31.0, "b"), (30.0, "a")]


def _events_at(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_maf_filter_may_keep_nothing(spark, tmp_path):
    d = _events_at(spark, tmp_path, [(i, i, "view", 1.0, '{"k": 3}') for i in range(5)] + [(9, 0, "view", 1.0, '{"k": 4}')])
    got = catalog.QUERIES["maf_filter"](spark, d)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{d}/events.parquet/*.parquet'")
    assert len(got.collect()) == len(con.sql(catalog.SQL["maf_filter"]).fetchall()) == 1
    got = catalog.QUERIES["maf_filter"](spark, _events_at(spark, tmp_path / "none", [(i, i, "view", 1.0, '{"k": 3}') for i in range(1)] + [(i, i, "view", 1.0, '{"k": 4}') for i in range(1, 9)] + [(i, i % 9, "view", 1.0, '{"k": 4}') for i in range(9, 18)]))
    assert got.collect() == []
    with pytest.raises(ValueError):
        genotype.maf_filter(spark.createDataFrame([(0, 1, 1000, 0)], "variant_idx int, chrom int, pos int, dosage int"))


def test_ties_of_the_rounding_hold_whatever_the_order_of_sums(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for u in range(60):  # every mean is exactly 52.5, a tie of round(value / 5)
        n = int(rng.integers(7, 30))
        cents = rng.integers(0, 10_000, n - 1)
        cents = np.append(cents, 5250 * n - cents.sum())
        rows += [(len(rows) + k, u, "view", int(c) / 100, '{"k": 1}') for k, c in enumerate(cents)]
    rows += [(len(rows) + u, 100 + u, "view", 30.0, '{"k": 1}') for u in range(4)]
    d = _events_at(spark, tmp_path, rows)
    ranks = {r.iid: r.rank for r in catalog.QUERIES["rint_rank"](spark, d).collect()}
    assert {ranks[u] for u in range(60)} == {34.5} and {ranks[100 + u] for u in range(4)} == {2.5}
    assert len({r.value for r in catalog.QUERIES["rint"](spark, d).collect()}) == 2


def _no_matrix(monkeypatch):
    from kinweave.operators import epistasis

    def refuse(*_):
        raise AssertionError("fewer variants than samples need no matrix of samples")

    monkeypatch.setattr(scan, "chromosome_sums", refuse)
    monkeypatch.setattr(epistasis, "chromosome_sums", refuse)


@pytest.mark.parametrize("loco", [True, False])
def test_few_variants_need_no_matrix_of_samples(spark, inputs, monkeypatch, loco):
    variants, samples, phenos, dosage, y, _ = inputs
    _no_matrix(monkeypatch)
    d = scan.design(samples, phenos.where("pheno_idx < 2"))
    got = {(r.variant_idx, r.pheno_idx): r for r in scan.results(scan.scan(variants, d, loco=loco, n_perm=2)).collect()}
    z, chrom, out = linalg.standardise(dosage).T, np.arange(24) // 8, 0
    for c in range(3):
        kept = chrom != c if loco else np.ones(24, bool)
        spec = linalg.projected_spectrum(z[:, kept] @ z[:, kept].T / kept.sum(), np.ones((36, 1)))
        uy, off = linalg.rotated(spec, y[:, :2])
        want = linalg.wald(spec, uy, off, linalg.fit_delta(spec, uy, off), y[:, :2], z[:, chrom == c])
        for i, row in zip(np.flatnonzero(chrom == c), want["f"], strict=True):
            for p in range(2):
                assert got[int(i), p].f == pytest.approx(row[p], rel=2e-5)
                out += 1
    assert out == len(got) == 48


@pytest.mark.parametrize("reml", [False, True])
def test_few_variants_on_the_plain_path(spark, inputs, monkeypatch, reml):
    variants, samples, phenos, dosage, y, _ = inputs
    _no_matrix(monkeypatch)
    d = scan.design(samples, phenos.where("pheno_idx < 2"))
    got = {(r.variant_idx, r.pheno_idx): r for r in scan.results(scan.scan(variants, d, rank="plain", reml=reml)).collect()}
    z, chrom = linalg.standardise(dosage).T, np.arange(24) // 8
    for c in range(3):
        s, u, ux = linalg.plain_spectrum(z[:, chrom != c] @ z[:, chrom != c].T / 16, np.ones((36, 1)))
        uy = u.T @ y[:, :2]
        want = linalg.plain_wald(s, ux, uy, linalg.plain_fit(s, ux, uy, reml), u.T @ z[:, chrom == c])
        for i, f, se in zip(np.flatnonzero(chrom == c), want["f"], want["se"], strict=True):
            for p in range(2):
                assert got[int(i), p].f == pytest.approx(f[p], rel=2e-5)
                assert got[int(i), p].se == pytest.approx(se[p], rel=2e-5)


def test_pairs_of_few_variants_need_no_matrix_of_samples(spark, inputs, monkeypatch):
    variants, samples, phenos, dosage, y, _ = inputs
    _no_matrix(monkeypatch)
    d = scan.design(samples, phenos.where("pheno_idx < 2"))
    got = {(r.pheno_idx, r.i, r.j): r.f for r in scan_pairs(variants, d, p_threshold=0.999999, n_perm=2, window=500).where("perm < 0").collect()}
    z, chrom = linalg.standardise(dosage), np.arange(24) // 8
    for i, j in ((0, 9), (3, 5), (8, 20)):
        kept = (chrom != chrom[i]) & (chrom != chrom[j])
        s, u, ux = linalg.plain_spectrum(z[kept].T @ z[kept] / kept.sum(), np.ones((36, 1)))
        uy = u.T @ y[:, :2]
        t = linalg.standardise((z[i] * z[j])[None])[0]
        want = linalg.plain_wald(s, np.column_stack([ux, u.T @ z[i]]), uy, linalg.plain_fit(s, ux, uy), (u.T @ t)[:, None], guard=True)["f"][0]
        for p in range(2):
            assert got[p, i, j] == pytest.approx(want[p], rel=2e-5)


def test_models_of_few_variants_travel_as_codes():
    g = np.array([[0, 1, 2, np.nan], [2, 2, 0, 1]])
    assert scan.coded(g).dtype == np.int8 and scan.coded(g + 0.5).dtype == float
    assert scan.coded(np.where(np.isnan(g), -1.0, g)).dtype == float  # -1 would read as missing
    assert scan.coded(g * 100).dtype == float
    x = np.ones((30, 1))
    dosage = np.random.default_rng(1).binomial(2, 0.4, (4, 30)) + 0.0
    dosage[3] = dosage[2]  # a variant twice: one direction less
    s, v = linalg.factor_basis(linalg.standardise(dosage).T)
    m = scan.opened(scan.pack(s=s, v=v, codes=scan.coded(dosage)), x, False)
    assert m["u"].shape == (30, 3) and np.allclose(m["u"].T @ m["u"], np.eye(3)) and m["rest"] == 26


@pytest.mark.parametrize("gaps", [0.0, 0.2])
def test_pair_kinship_by_blocks(spark, monkeypatch, gaps):
    monkeypatch.setattr(kinship, "TILE", 4)
    rng = np.random.default_rng(2)
    rows = [(v, v // 3 + 1, 1000 * v, f"s{i:02}", int(rng.integers(0, 3))) for v in range(9) for i in range(15) if rng.random() >= gaps]
    calls = spark.createDataFrame(rows, "variant_idx int, chrom int, pos int, iid string, dosage int")
    z = {(r.variant_idx, r.iid): r.z for r in genotype.standardise(calls).collect()}
    want, wanted = {}, {}
    ids = sorted({r[3] for r in rows})
    for a, i in enumerate(ids):
        for j in ids[a:]:
            both = [(v, z[v, i] * z[v, j]) for v in range(9) if (v, i) in z and (v, j) in z]
            if both:
                want[i, j] = np.mean([t for _, t in both])
            for c in {v // 3 for v, _ in both}:
                rest = [t for v, t in both if v // 3 != c]
                wanted[c + 1, i, j] = np.mean(rest) if rest else None
    got = {(r.i, r.j): r.k for r in kinship.pair_kinship(calls).collect()}
    assert got == pytest.approx(want)
    left = kinship.pair_kinship(calls, loco=True).collect()
    assert len(left) == len(wanted)
    for r in left:
        assert r.k == (None if wanted[r.chrom, r.i, r.j] is None else pytest.approx(wanted[r.chrom, r.i, r.j]))
    alone = kinship.pair_kinship(calls.where("chrom = 1"), loco=True).collect()
    assert alone and all(r.k is None for r in alone)


@pytest.mark.parametrize("name", ["grm", "loco_grm"])
def test_pairs_of_samples_are_not_joined_variant_by_variant(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "[variant_idx" not in "".join(x for x in plan.splitlines() if "Join" in x and "iid" not in x)


def _shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_pair_kinship_moves_packed_blocks(spark, monkeypatch):
    monkeypatch.setattr(kinship, "TILE", 8)
    rng = np.random.default_rng(4)
    rows = [(v, v // 10 + 1, 1000 * v, i, int(x)) for i in range(600) for v, x in enumerate(rng.integers(0, 3, 30))]
    calls = spark.createDataFrame(rows, "variant_idx int, chrom int, pos int, iid long, dosage int").repartition(4).localCheckpoint()
    began = _shuffled(spark)
    assert kinship.pair_kinship(calls).count() == 600 * 601 // 2
    assert _shuffled(spark) - began < 1_500_000


@pytest.mark.parametrize("gaps", [0.0, 0.2])
@pytest.mark.parametrize("loco", [False, True])
def test_pair_kinship_in_strips(spark, monkeypatch, gaps, loco):
    rng = np.random.default_rng(3)
    rows = [(v, v // 3 + 1, 1000 * v, i, int(rng.integers(0, 3))) for v in range(9) for i in [*range(15), None] if rng.random() >= gaps]
    calls = spark.createDataFrame(rows, "variant_idx int, chrom int, pos int, iid int, dosage int")
    want = sorted(kinship.pair_kinship(calls, loco).collect(), key=lambda r: r[:-1])
    assert all(r.i is not None and r.i <= r.j for r in want) and len({r[:-1] for r in want}) == len(want)
    monkeypatch.setattr(kinship, "TILE", 4)
    monkeypatch.setattr(kinship, "STRIP", 6)
    got = sorted(kinship.pair_kinship(calls, loco, digits=3).collect(), key=lambda r: r[:-1])
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert all((g.k is None and w.k is None) or (abs(g.k - w.k) < 5.01e-4 and g.k == round(g.k, 3)) for g, w in zip(got, want, strict=True))


def test_leave_out_kinship_moves_packed_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(kinship, "TILE", 4)
    rng = np.random.default_rng(6)
    d = _events_at(spark, tmp_path, [(i, i % 400, "view", 1.0, f'{{"k": {k}}}') for i, k in enumerate(rng.integers(0, 100, 4_000))])
    began = _shuffled(spark)
    assert catalog.QUERIES["loco_grm"](spark, d).count() == 10 * 400 * 401 // 2
    moved = _shuffled(spark) - began
    assert moved < 2_000_000, moved
