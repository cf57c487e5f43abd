"""Dense mixed-model algebra on one fold (L1-L8, L13-L16, L20-L29). Pure numpy, run inside Arrow functions.

Notation of SURVEY 2.14: y = X b + s * beta + e with variance K + delta * I.
Everything that stands against all phenotypes at once is a matrix product.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

GRID, LOW, HIGH, GOLDEN_STEPS = 64, -10.0, 10.0, 50
FLOOR = 1e-300


def standardise(dosage: np.ndarray) -> np.ndarray:
    """N1 on rows (variants): mean and deviation over called values, constant rows 0, missing 0 afterwards."""
    called = np.isfinite(dosage)
    n = np.maximum(called.sum(1), 1)
    x = np.where(called, dosage, 0.0)
    mean = x.sum(1) / n
    x = np.where(called, x - mean[:, None], 0.0)
    sd = np.sqrt((x * x).sum(1) / n)
    return x / np.where(sd > 0, sd, np.inf)[:, None]


def independent_columns(x: np.ndarray) -> np.ndarray:
    """columns that a column-pivoted QR keeps (tolerance 1e-10 of the largest diagonal), in their own order."""
    r = x.astype(float).copy()
    left, kept, first = list(range(x.shape[1])), [], None
    while left:
        norms = np.sqrt((r[:, left] ** 2).sum(0))
        i = int(norms.argmax())
        first = norms[i] if first is None else first
        if norms[i] <= 1e-10 * first or not first:
            break
        j = left.pop(i)
        kept.append(j)
        q = r[:, j] / norms[i]
        r[:, left] -= np.outer(q, q @ r[:, left])
    return np.array(sorted(kept), int)


@dataclass
class Spectrum:
    """Eigenvalues s, vectors u and, off the span of u, what projections leave; x and its pseudo-inverse."""

    s: np.ndarray
    u: np.ndarray
    x: np.ndarray
    pinv: np.ndarray
    rest: int  # residual dimensions outside u (0 unless low rank)

    def residual(self, a: np.ndarray) -> np.ndarray:
        return a - self.x @ (self.pinv @ a)


def projected_spectrum(k: np.ndarray, x: np.ndarray) -> Spectrum:
    """N3. The first D eigenvectors go even where x has rank below D (a stated quirk of the method)."""
    n, d = x.shape
    pinv = np.linalg.pinv(x)
    p = np.eye(n) - x @ pinv
    a = p @ (k + np.eye(n)) @ p
    lam, u = np.linalg.eigh((a + a.T) / 2)
    return Spectrum(np.maximum(lam[d:] - 1, 0), u[:, d:], x, pinv, 0)


def factor_basis(g: np.ndarray, floor: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues s of g g' / k (g is N x k, k < N) above the square of ``floor`` of the largest, and v so that g v has their vectors. All other eigenvalues are 0."""
    _, sv, vt = np.linalg.svd(g, full_matrices=False)
    keep = sv > floor * sv.max(initial=0)
    return sv[keep] ** 2 / max(1, g.shape[1]), vt[keep].T / sv[keep]


def lowrank_spectrum(g: np.ndarray, x: np.ndarray, floor: float = 1e-10) -> Spectrum:
    """N12 of a factor g (N x k): K = g g' / k without forming K while k < N."""
    n, k = g.shape
    pinv = np.linalg.pinv(x)
    g = g - x @ (pinv @ g)
    if k < n:
        lam, v = np.linalg.eigh(g.T @ g)
        sv = np.sqrt(np.maximum(lam, 0))
        keep = sv > floor
        u, s = (g @ v[:, keep]) / sv[keep], sv[keep] ** 2 / k
    else:
        lam, u = np.linalg.eigh(g @ g.T / k)
        keep = lam > floor
        u, s = u[:, keep], lam[keep]
    return Spectrum(s, u, x, pinv, n - x.shape[1] - len(s))


def rotated(spec: Spectrum, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """U'(y - x pinv y) and the squared length that lies off u (0 for a full basis)."""
    r = spec.residual(y)
    uy = spec.u.T @ r
    off = np.maximum((r * r).sum(0) - (uy * uy).sum(0), 0) if spec.rest else np.zeros(y.shape[1])
    return uy, off


def loss(log_delta: np.ndarray, s: np.ndarray, uy2: np.ndarray, off: np.ndarray, rest: int) -> np.ndarray:
    """N4, one log delta for each phenotype; N12's terms for the directions off u."""
    delta = np.exp(log_delta)
    w = s[:, None] + delta
    n = len(s) + rest
    sigma = np.maximum(((uy2 / w).sum(0) + off / delta) / n, FLOOR)
    return n * (np.log(2 * np.pi * sigma) + 1) + np.log(w).sum(0) + rest * np.log(delta)


def dense_loss(log_delta: float, k: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """The loss of N4 for one phenotype straight from V = K + delta I by Cholesky, without any rotation; x of full rank. A check on the projected forms, N**3 a call."""
    v = np.linalg.cholesky(k + np.exp(log_delta) * np.eye(len(k)))
    wx, wy = np.linalg.solve(v, x), np.linalg.solve(v, y)
    a = wx.T @ wx
    r = wy - wx @ np.linalg.solve(a, wx.T @ wy)
    n = len(y) - x.shape[1]
    return float(n * (np.log(2 * np.pi * max(r @ r / n, FLOOR)) + 1) + 2 * np.log(np.diag(v)).sum() + np.linalg.slogdet(a)[1] - np.linalg.slogdet(x.T @ x)[1])


def golden(f, grid: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Bracket of the first least grid value of each column, then 50 golden-section steps."""
    at = values.argmin(0)
    a, b = grid[np.maximum(at - 1, 0)], grid[np.minimum(at + 1, len(grid) - 1)]
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(GOLDEN_STEPS):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        left = f(c) < f(d)
        a, b = np.where(left, a, c), np.where(left, d, b)
    return np.clip((a + b) / 2, grid[0], grid[-1])


def fit_delta(spec: Spectrum, uy: np.ndarray, off: np.ndarray) -> np.ndarray:
    grid = np.linspace(LOW, HIGH, GRID)
    uy2 = uy * uy
    values = np.stack([loss(np.full(uy.shape[1], g), spec.s, uy2, off, spec.rest) for g in grid])
    return golden(lambda x: loss(x, spec.s, uy2, off, spec.rest), grid, values)


def prepared(spec: Spectrum, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tests (N x M) without the covariates, and rotated: what does not depend on phenotypes."""
    r = spec.residual(tests)
    return r, spec.u.T @ r


def wald(spec: Spectrum, uy: np.ndarray, off: np.ndarray, log_delta: np.ndarray, y: np.ndarray, tests: np.ndarray | tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """N5 and N12 for tests (N x M, or prepared ones) against all phenotypes: f, beta, se, sfve as M x P."""
    r, us = tests if isinstance(tests, tuple) else prepared(spec, tests)
    delta = np.exp(log_delta)
    w = 1 / (spec.s[:, None] + delta)
    n = len(spec.s) + spec.rest
    swy, sws = us.T @ (w * uy), (us * us).T @ w
    rwr = (w * uy * uy).sum(0)
    if spec.rest:
        ry = spec.residual(y)
        swy = swy + (r.T @ ry - us.T @ uy) / delta
        sws = sws + np.maximum((r * r).sum(0) - (us * us).sum(0), 0)[:, None] / delta
        rwr = rwr + off / delta
    sws = np.maximum(sws, FLOOR)
    beta = swy / sws
    variance = np.maximum(rwr - swy * beta, FLOOR) / (n - 1) / sws
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"f": beta * beta / variance, "beta": beta, "se": np.sqrt(variance), "sfve": np.sqrt(np.maximum(swy * swy / (sws * rwr), 0))}


# The plain path (N13): covariates stay in the basis, K gets a small ridge.
RIDGE = 1e-6


@dataclass
class Off:
    """Off a partial basis u all eigenvalues are ``RIDGE``: the number of directions there, and the products a'b - (u'a)'(u'b) of covariates x, phenotypes y and tests t."""

    rest: int
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    tx: np.ndarray | None = None
    ty: np.ndarray | None = None
    tt: np.ndarray | None = None


def plain_spectrum(k: np.ndarray, x: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, u = np.linalg.eigh(k + ridge * np.eye(len(k)))
    return np.maximum(s, 0), u, u.T @ x


def squares_off(a: np.ndarray, ua: np.ndarray) -> np.ndarray:
    """Squared lengths of columns of a off the basis."""
    return np.maximum(np.einsum("ij,ij->j", a, a) - np.einsum("ij,ij->j", ua, ua), 0)


def off_basis(u: np.ndarray, x: np.ndarray, ux: np.ndarray, y: np.ndarray, uy: np.ndarray) -> Off | None:
    """None for a whole basis."""
    rest = u.shape[0] - u.shape[1]
    return Off(rest, x.T @ x - ux.T @ ux, x.T @ y - ux.T @ uy, squares_off(y, uy)) if rest else None


def with_tests(off: Off | None, x: np.ndarray, ux: np.ndarray, y: np.ndarray, uy: np.ndarray, t: np.ndarray, us: np.ndarray) -> Off | None:
    """The same with tests t (N x M)."""
    return off and replace(off, tx=t.T @ x - us.T @ ux, ty=t.T @ y - us.T @ uy, tt=squares_off(t, us))


def _weighted(ux: np.ndarray, uy: np.ndarray, w: np.ndarray, off: Off | None = None, w0: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """X'WX (P x C x C), X'Wy (P x C) and y'Wy (P) for the weights (N x P) of each phenotype, w0 (P) off the basis."""
    c = ux.shape[1]
    a = np.empty((w.shape[1], c, c))
    for i in range(c):
        for j in range(i, c):
            a[:, i, j] = a[:, j, i] = (ux[:, i] * ux[:, j]) @ w
    wy = w * uy
    if off is None:
        return a, (ux.T @ wy).T, (wy * uy).sum(0)
    return a + w0[:, None, None] * off.xx, (ux.T @ wy + off.xy * w0).T, (wy * uy).sum(0) + off.yy * w0


def plain_loss(log_delta: np.ndarray, s: np.ndarray, ux: np.ndarray, uy: np.ndarray, reml: bool = False, off: Off | None = None) -> np.ndarray:
    """Profile loss of each phenotype at its own log delta; infinite where X'WX is singular."""
    rest, c = off.rest if off else 0, ux.shape[1]
    n = len(ux) + rest
    w, w0 = 1 / (s[:, None] + np.exp(log_delta)), 1 / (RIDGE + np.exp(log_delta))
    a, b, yy = _weighted(ux, uy, w, off, w0)
    sign, logdet = np.linalg.slogdet(a)
    ok = (sign > 0) & np.isfinite(logdet)
    solved = np.linalg.solve(np.where(ok[:, None, None], a, np.eye(c)), b[:, :, None])[:, :, 0]
    q = np.maximum(yy - (b * solved).sum(1), FLOOR)
    m = n - c if reml else n
    loss = m * (np.log(2 * np.pi * q / m) + 1) - np.log(w).sum(0) - rest * np.log(w0) + (logdet if reml else 0)
    return np.where(ok, loss, np.inf)


def plain_fit(s: np.ndarray, ux: np.ndarray, uy: np.ndarray, reml: bool = False, off: Off | None = None) -> np.ndarray:
    grid = np.linspace(LOW, HIGH, GRID)
    values = np.stack([plain_loss(np.full(uy.shape[1], g), s, ux, uy, reml, off) for g in grid])
    return golden(lambda x: plain_loss(x, s, ux, uy, reml, off), grid, values)


def plain_wald(s: np.ndarray, ux: np.ndarray, uy: np.ndarray, log_delta: np.ndarray, us: np.ndarray, guard: bool = False, off: Off | None = None) -> dict[str, np.ndarray]:
    """F, beta, se of rotated tests us (N x M) against all phenotypes at once; guard (F14): F is 0 where less than 1 % of a test is left by the design."""
    n, c = len(ux) + (off.rest if off else 0), ux.shape[1]
    w, w0 = 1 / (s[:, None] + np.exp(log_delta)), 1 / (RIDGE + np.exp(log_delta))
    a, b, yy = _weighted(ux, uy, w, off, w0)
    inverse = np.linalg.pinv(a, hermitian=True)
    by = (inverse @ b[:, :, None])[:, :, 0]
    sws = (us * us).T @ w
    num = us.T @ (w * uy)
    bx = [us.T @ (w * ux[:, [i]]) for i in range(c)]
    if off:
        sws += off.tt[:, None] * w0
        num += off.ty * w0
        bx = [v + off.tx[:, [i]] * w0 for i, v in enumerate(bx)]
    left = sws.copy()
    for i in range(c):
        num -= bx[i] * by[:, i]
        for j in range(c):
            left -= bx[i] * bx[j] * inverse[:, i, j]
    base = yy - (b * by).sum(1)
    ok = left > (0.01 * sws if guard else 1e-12 * np.maximum(sws, FLOOR))
    d = np.where(ok, left, 1)
    beta = np.where(ok, num / d, 0)
    v = np.maximum(base - np.where(ok, num * num / d, 0), FLOOR) / (n - c - 1) / d
    return {"f": np.where(ok, beta * beta / v, 0), "beta": beta, "se": np.where(ok, np.sqrt(v), np.nan)}


def randomized_eigh(z: np.ndarray, rank: int = 200, oversample: int = 20, rounds: int = 2, seed: int = 19930909) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenpairs of z z' / M (z is N x M) by a randomised range finder, largest first."""
    n, m = z.shape
    k = min(rank + oversample, n)
    q = np.linalg.qr(z @ (z.T @ np.random.default_rng(seed).normal(size=(n, k))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(z @ (z.T @ q))[0]
    b = z.T @ q
    lam, v = np.linalg.eigh(b.T @ b / m)
    order = np.argsort(-lam)[: min(rank, n)]
    return lam[order], q @ v[:, order]


def flat(y: np.ndarray, least: int) -> bool:
    """F8 for one column: fewer than two levels, or a rarest level of fewer than ``least`` samples."""
    _, n = np.unique(y[np.isfinite(y)], return_counts=True)
    return len(n) < 2 or int(n.min()) < least


def permutation_orders(n_perm: int, n: int, seed: int, column: int) -> np.ndarray:
    """Orders of the samples for one phenotype column."""
    return np.random.default_rng([seed, column]).random((n_perm, n)).argsort(axis=1)
