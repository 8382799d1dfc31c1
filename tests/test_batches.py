"""Batches of series against the kernels, one by one."""

import numpy as np
import pytest

from cubespan.errors import CubeError
from cubespan.functions import batches as B
from cubespan.functions import kernels as K


@pytest.fixture(scope="module", params=[1, 2, 3, 7, 30])
def series(request):
    r, n = np.random.default_rng(request.param), request.param
    t = np.sort(np.round(r.random((40, n)) * 5, 1), axis=1)
    v = np.round(r.normal(0, 1, (40, n)), 1) + 3.0 * (t > 2.5) * (np.arange(40) % 2)[:, None]
    v[3], t[4] = 1.0, 2.0
    return t, v


def one(f, *args):
    try:
        return f(*args)
    except CubeError:
        return None


def test_theil_sen(series, monkeypatch):
    for cells in (B.CELLS, 50):
        monkeypatch.setattr(B, "CELLS", cells)
        got = B.theil_sen(*series)
        for k, (t, v) in enumerate(zip(*series)):
            w = one(K.theil_sen, t, v)
            assert got["ok"][k] == (w is not None)
            if w:
                assert (got["slope"][k], got["intercept"][k], got["n"][k]) == pytest.approx((w.slope, w.intercept, w.n))


def test_mann_kendall(series):
    got = B.mann_kendall(series[1])
    for k, v in enumerate(series[1]):
        w = one(K.mann_kendall, v)
        assert got["ok"][k] == (w is not None)
        if w:
            assert [got[f][k] for f in ("s", "var_s", "z", "tau", "p_value", "n")] == pytest.approx([w.s, w.var_s, w.z, w.tau, w.p_value, w.n]) and got["trend"][k] == w.trend


@pytest.mark.parametrize("k", [1, 2])
def test_harmonic(series, k):
    got = B.harmonic_regression(*series, 1.7, k)
    for i, (t, v) in enumerate(zip(*series)):
        w = one(K.harmonic_regression, t, v, 1.7, k)
        assert got["ok"][i] == (w is not None)
        if w:
            assert [got[f][i] for f in ("slope", "intercept", "r_squared", "rmse")] == pytest.approx([w.slope, w.intercept, w.r_squared, w.rmse], rel=1e-6, abs=1e-7)
            assert got["cos"][i].tolist() == pytest.approx([c.cos_coef for c in w.components], rel=1e-6, abs=1e-7)


@pytest.mark.parametrize("k", [0, 1])
def test_breaks(series, k):
    for i, (got, t, v) in enumerate(zip(B.detect_breaks(*series, 0.05, k, 1.7, 2 * k + 4), *series)):
        w = one(lambda a, b: K.detect_breaks(a, b, 0.05, k, 1.7, 2 * k + 4), t, v)
        assert (got is None) == (w is None), i
        if w:
            assert [b.index for b in got.breaks] == [b.index for b in w.breaks] and (got.statistic, got.p_value) == pytest.approx((w.statistic, w.p_value), abs=1e-9)
