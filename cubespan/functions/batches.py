"""The estimators for many series of one length at a time: T and V hold a series in each row, all values finite.

Each gives a dict of arrays; rows that can't be estimated are False in ok. The results are those of the kernels;
rows that need a rarer path (equal times, ties, a significant break) go through them.
"""

from __future__ import annotations

import math

import numpy as np

from cubespan.errors import CubeError
from cubespan.functions import kernels

_erfc = np.frompyfunc(math.erfc, 1, 1)
#: Numbers that are held at a time.
CELLS = 1 << 21
#: Observations beyond which a series is counted by itself, in n log(n)**2 steps, instead of together with others.
LONG = 2048


def _row_blocks(m: int, cells: int):
    step = max(1, CELLS // max(1, cells))
    for a in range(0, m, step):
        yield a, min(m, a + step)


def theil_sen(t: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    m, n = t.shape
    slope, ok = np.full(m, np.nan), np.full(m, n >= 2)
    if 2 <= n <= LONG:
        i, j = np.triu_indices(n, 1)
        for a, z in _row_blocks(m, len(i)):
            dt, dv = t[a:z, j] - t[a:z, i], v[a:z, j] - v[a:z, i]
            plain = (dt != 0).all(axis=1)
            slope[a:z][plain] = np.median(dv[plain] / dt[plain], axis=1)
            todo = np.flatnonzero(~plain) + a
            _one_by_one(todo, lambda k: kernels.theil_sen(t[k], v[k]).slope, slope, ok)
    elif n >= 2:
        _one_by_one(range(m), lambda k: kernels.theil_sen(t[k], v[k]).slope, slope, ok)
    with np.errstate(invalid="ignore"):
        intercept = np.median(v, axis=1) - slope * np.median(t, axis=1) if n else slope
    return {"slope": slope, "intercept": intercept, "n": np.full(m, n), "ok": ok}


def _one_by_one(rows, f, out: np.ndarray, ok: np.ndarray) -> None:
    for k in rows:
        try:
            out[k] = f(k)
        except CubeError:
            ok[k] = False


def mann_kendall(v: np.ndarray, alpha: float = 0.05) -> dict[str, np.ndarray]:
    m, n = v.shape
    if n < 3:
        nothing = np.full(m, np.nan)
        return {"trend": np.full(m, "", object), "s": nothing, "var_s": nothing, "z": nothing, "tau": nothing, "p_value": nothing, "n": np.full(m, n), "ok": np.zeros(m, bool)}
    if n > LONG:
        s = np.array([kernels.mann_kendall(x).s for x in v])
    else:
        s = np.zeros(m)
        for k in range(n - 1):
            s += np.sign(v[:, k + 1 :] - v[:, k : k + 1]).sum(axis=1)
    ordered = np.sort(v, axis=1)
    tied = np.zeros(m)
    for k in np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1)):
        g = np.unique(v[k] + 0.0, return_counts=True)[1].astype(np.float64)
        tied[k] = (g * (g - 1) * (2 * g + 5)).sum()
    var = (n * (n - 1) * (2 * n + 5) - tied) / 18.0
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.where((s != 0) & (var > 0), (s - np.sign(s)) / np.sqrt(var), 0.0)
    p = _erfc(np.abs(z) / math.sqrt(2.0)).astype(np.float64)
    trend = np.where(p < alpha, np.where(z > 0, "increasing", "decreasing"), "no trend").astype(object)
    return {"trend": trend, "s": s, "var_s": var, "z": z, "tau": s / (n * (n - 1) / 2), "p_value": p, "n": np.full(m, n), "ok": np.ones(m, bool)}


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many small systems, and which are not singular; the rule is that of kernels.solve_symmetric()."""
    m, p = b.shape
    x = np.concatenate([a, b[:, :, None]], axis=2)
    least, ok, rows = np.abs(a).max(axis=(1, 2)) * 1e-12 * p, np.ones(m, bool), np.arange(m)
    with np.errstate(all="ignore"):
        for k in range(p):
            top = k + np.argmax(np.abs(x[:, k:, k]), axis=1)
            ok &= np.abs(x[rows, top, k]) > least
            x[rows, k], x[rows, top] = x[rows, top].copy(), x[rows, k].copy()
            f = x[:, k + 1 :, k] / x[:, k, k][:, None]
            x[:, k + 1 :, k:] -= f[:, :, None] * x[:, k, None, k:]
        out = np.zeros((m, p))
        for k in range(p - 1, -1, -1):
            out[:, k] = (x[:, k, p] - (x[:, k, k + 1 : p] * out[:, k + 1 :]).sum(axis=1)) / x[:, k, k]
    return out, ok


def least_squares(t: np.ndarray, v: np.ndarray, period: float, n_harmonics: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, centres of the times, residuals, and which designs are not singular."""
    m, n = t.shape
    p = 2 + 2 * n_harmonics
    beta, rest, ok = np.zeros((m, p)), np.zeros((m, n)), np.zeros(m, bool)
    centre = t.mean(axis=1)
    for a, z in _row_blocks(m, n * p):
        columns = [np.ones((z - a, n)), t[a:z] - centre[a:z, None]]
        for k in range(1, n_harmonics + 1):
            angle = 2 * math.pi / period * k * t[a:z]
            columns += [np.cos(angle), np.sin(angle)]
        x = np.stack(columns, axis=2)
        xt = x.transpose(0, 2, 1)
        beta[a:z], ok[a:z] = solve(xt @ x, (xt @ v[a:z, :, None])[:, :, 0])
        rest[a:z] = v[a:z] - (x @ beta[a:z, :, None])[:, :, 0]
    return beta, centre, rest, ok


def harmonic_regression(t: np.ndarray, v: np.ndarray, period: float, n_harmonics: int) -> dict[str, np.ndarray]:
    """cos and sin hold a column for each harmonic."""
    m, n = t.shape
    if n < 2 * n_harmonics + 3:
        nothing, wide = np.full(m, np.nan), np.full((m, n_harmonics), np.nan)
        return {"intercept": nothing, "slope": nothing, "cos": wide, "sin": wide, "r_squared": nothing, "rmse": nothing, "n": np.full(m, n), "ok": np.zeros(m, bool)}
    beta, centre, rest, ok = least_squares(t, v, period, n_harmonics)
    with np.errstate(all="ignore"):
        res, yy = (rest * rest).sum(axis=1), ((v - v.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
        r2 = np.where(yy == 0, 1.0, np.maximum(0.0, 1.0 - res / yy))
        return {"intercept": beta[:, 0] - beta[:, 1] * centre, "slope": beta[:, 1], "cos": beta[:, 2::2], "sin": beta[:, 3::2], "r_squared": r2, "rmse": np.sqrt(res / n), "n": np.full(m, n), "ok": ok}


def bridge_p_value(s: np.ndarray) -> np.ndarray:
    j = np.arange(1, 101)
    p = (np.where(j % 2, 2.0, -2.0) * np.exp(-2.0 * j * j * (s * s)[:, None])).sum(axis=1)
    return np.where(s > 0, np.clip(p, 0.0, 1.0), 1.0)


def detect_breaks(t: np.ndarray, v: np.ndarray, alpha: float, n_harmonics: int, period: float, min_segment: int) -> list[kernels.Breaks | None]:
    """The whole-series test for all rows at once; only series that it rejects are segmented."""
    m, n = t.shape
    if n < min_segment:
        return [None] * m
    _, _, rest, ok = least_squares(t, v, period, n_harmonics)
    ok &= (np.diff(t, axis=1) >= 0).all(axis=1)
    with np.errstate(all="ignore"):
        sse = (rest * rest).sum(axis=1)
        path = np.abs(np.cumsum(rest, axis=1)).max(axis=1) / (np.sqrt(sse / (n - 2 - 2 * n_harmonics)) * math.sqrt(n))
    top = np.where(sse > 0, path, 0.0)
    p = bridge_p_value(top)
    out: list[kernels.Breaks | None] = []
    for k in range(m):
        if not ok[k]:
            out.append(None)
        elif n < 2 * min_segment or p[k] >= alpha:
            out.append(kernels.Breaks(float(top[k]), float(p[k]), [], n))
        else:
            try:
                out.append(kernels.detect_breaks(t[k], v[k], alpha, n_harmonics, period, min_segment))
            except CubeError:
                out.append(None)
    return out
