import math
from statistics import NormalDist

import numpy as np
import pytest

from kinweave.functions import special
from kinweave.operators import linalg


def test_normal_quantile():
    for p in (1e-300, 1e-20, 1e-5, 0.01, 0.2, 0.5, 0.77, 0.999):
        assert special.norm_ppf(np.array([p]))[0] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-14)
    assert np.isnan(special.norm_ppf(np.array([-1.0, 2.0]))).all()
    assert special.chi2_isf(np.array([0.5]))[0] == pytest.approx(special.CHI2_MEDIAN, rel=1e-12)


def test_f_tail():
    # Two degrees of freedom: 1 - t / sqrt(2 + t^2); one: 1 - 2 atan(t) / pi; inverse.
    for f in (1e-8, 0.1, 1.0, 7.0, 300.0, 1e6):
        t = math.sqrt(f)
        assert special.f_sf(np.array([f]), 2)[0] == pytest.approx(1 - t / math.sqrt(2 + f), rel=1e-9, abs=1e-15)
        assert special.f_sf(np.array([f]), 1)[0] == pytest.approx(1 - 2 * math.atan(t) / math.pi, rel=1e-8)
    assert special.f_sf(np.array([special.f_isf(1e-9, 148.0)]), 148.0)[0] == pytest.approx(1e-9, rel=1e-8)
    assert special.f_sf(np.array([0.0, np.inf, np.nan, -1.0]), 5.0)[:2].tolist() == [1.0, 0.0]


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(19930909)
    n, m = 40, 60
    z = linalg.standardise(rng.binomial(2, 0.3, (m, n)).astype(float)).T
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    y = rng.normal(size=(n, 3)) + z[:, :5] @ rng.normal(size=(5, 3)) * 0.5
    return z, x, y, z @ z.T / m


def _gls(v, x, y, s):
    w = np.linalg.inv(v)
    d = np.column_stack([x, s])
    a = np.linalg.inv(d.T @ w @ d)
    b = a @ d.T @ w @ y
    r = y - d @ b
    df = len(y) - d.shape[1]
    return b[-1] ** 2 / (a[-1, -1] * (r @ w @ r) / df), b[-1]


def test_projected_scan_equals_dense_gls(panel):
    z, x, y, k = panel
    spec = linalg.projected_spectrum(k, x)
    uy, off = linalg.rotated(spec, y)
    log_delta = linalg.fit_delta(spec, uy, off)
    got = linalg.wald(spec, uy, off, log_delta, y, z[:, :7])
    for j in range(3):
        v = k + np.exp(log_delta[j]) * np.eye(len(k))
        for i in range(7):
            f, beta = _gls(v, x, y[:, j], z[:, i])
            assert got["f"][i, j] == pytest.approx(f, rel=1e-8) and got["beta"][i, j] == pytest.approx(beta, rel=1e-8)
    assert np.allclose(got["f"], (got["beta"] / got["se"]) ** 2)


def test_delta_minimises_the_restricted_likelihood(panel):
    z, x, y, k = panel
    spec = linalg.projected_spectrum(k, x)
    uy, off = linalg.rotated(spec, y)
    best = linalg.fit_delta(spec, uy, off)
    s, u, ux = linalg.plain_spectrum(k, x, ridge=0.0)
    for j in range(3):
        grid = np.linspace(-10, 10, 401)
        dense = [linalg.plain_loss(np.array([g]), s, ux, u.T @ y[:, [j]], reml=True)[0] for g in grid]
        assert linalg.plain_loss(best[[j]], s, ux, u.T @ y[:, [j]], reml=True)[0] <= min(dense) + 1e-6


def test_low_rank_equals_full(panel):
    z, x, y, k = panel
    full, low = linalg.projected_spectrum(k, x), linalg.lowrank_spectrum(z, x)
    g = z[:, :12]
    part = linalg.lowrank_spectrum(g, x)
    whole = linalg.projected_spectrum(g @ g.T / 12, x)
    for a, b in ((full, low), (whole, part)):
        ya, yb = linalg.rotated(a, y), linalg.rotated(b, y)
        da, db = linalg.fit_delta(a, *ya), linalg.fit_delta(b, *yb)
        assert np.allclose(da, db, atol=1e-4)
        fa, fb = (linalg.wald(s, *r, da, y, z[:, 20:30]) for s, r in ((a, ya), (b, yb)))
        assert np.allclose(fa["f"], fb["f"], rtol=1e-5) and np.allclose(fa["se"], fb["se"], rtol=1e-6)


def test_rank_deficient_design_drops_one_more(panel):
    z, x, y, k = panel
    twice = np.column_stack([x, x[:, 1]])
    assert len(linalg.projected_spectrum(k, twice).s) == len(k) - 3
    assert linalg.independent_columns(twice).tolist() in ([0, 1], [0, 2])


def test_randomised_eigenvalues(panel):
    z, *_ = panel
    lam, u = linalg.randomized_eigh(z, rank=10, oversample=20)
    exact = np.sort(np.linalg.eigvalsh(z @ z.T / z.shape[1]))[::-1][:10]
    assert np.allclose(lam, exact, rtol=1e-3) and np.allclose(u.T @ u, np.eye(10), atol=1e-9)


def test_projected_loss_is_the_dense_one():
    rng = np.random.default_rng(8)
    g = rng.normal(size=(25, 60))
    k, x, y = g @ g.T / 60, np.column_stack([np.ones(25), rng.normal(size=25)]), rng.normal(size=(25, 2))
    spec = linalg.projected_spectrum(k, x)
    uy, off = linalg.rotated(spec, y)
    for ld in (-3.0, 0.0, 2.5):
        got = linalg.loss(np.full(2, ld), spec.s, uy * uy, off, spec.rest)
        want = [linalg.dense_loss(ld, k, x, y[:, j]) for j in range(2)]
        assert np.allclose(got - got[0], np.array(want) - want[0], atol=1e-8)
        assert np.allclose(got, want, atol=1e-8)
