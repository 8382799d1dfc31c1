"""Golden values of the estimators."""

import math

import numpy as np
import pytest

from cubespan import errors
from cubespan.functions import batches, kernels as K

NAN = math.nan


def noise(n):
    x = np.sin(np.arange(n) * 12.9898) * 43758.5453
    return x - np.sign(x) * np.floor(np.abs(x) + 0.5)


def test_linear_trend():
    f = K.linear_trend(range(5), [1, 3, 2, 5, 4])
    assert (f.slope, f.intercept, f.r_squared, f.p_value) == pytest.approx((0.8, 1.4, 0.64, 0.10408803866), abs=1e-10)
    f = K.linear_trend(range(20), 3 - 0.5 * np.arange(20))
    assert (f.slope, f.r_squared, f.n) == (pytest.approx(-0.5), pytest.approx(1), 20) and f.p_value < 1e-12
    f = K.linear_trend(range(6), [0, 2, NAN, 6, 8, NAN])
    assert (f.n, f.slope) == (4, pytest.approx(2))
    f = K.linear_trend(range(4), [5, 5, 5, 5])
    assert (f.slope, f.r_squared, f.p_value) == (0, 1, 1)
    with pytest.raises(errors.InsufficientData, match="needed 3"):
        K.linear_trend([0, 1], [1, 2])
    with pytest.raises(errors.DimensionMismatch):
        K.linear_trend([1, 1, 1], [1, 2, 3])
    with pytest.raises(errors.DimensionMismatch):
        K.linear_trend([1, 2], [1, 2, 3])


def test_theil_sen():
    y = 0.5 * np.arange(21)
    y[3], y[17] = 1000, -1000
    assert K.theil_sen(range(21), y).slope == pytest.approx(0.5)
    assert K.theil_sen([0, 1, 2, 10], [0, 2, 4, 20]).slope == 2
    f = K.theil_sen([0, 1, NAN, 3], [1, 3, 7, math.inf])
    assert (f.n, f.slope, f.intercept) == (2, 2, 1)
    with pytest.raises(errors.DimensionMismatch):
        K.theil_sen([1, 1, 1], [1, 2, 3])
    with pytest.raises(errors.InsufficientData):
        K.theil_sen([1], [1])


def test_pair_blocks(monkeypatch):
    r = np.random.default_rng(1)
    t, v = np.sort(r.random(60)), r.random(60).round(1)
    whole = K.theil_sen(t, v), K.mann_kendall(v)
    monkeypatch.setattr(K, "PAIR_BLOCK", 100)
    assert (K.theil_sen(t, v), K.mann_kendall(v)) == whole


def test_mann_kendall():
    f = K.mann_kendall(range(10))
    assert (f.s, f.var_s, f.z, f.tau, f.trend) == (45, 125, pytest.approx(44 / math.sqrt(125)), 1, "increasing")
    f = K.mann_kendall([1, 2, 2, 3])
    assert (f.s, f.var_s, f.tau) == (5, pytest.approx(138 / 18), pytest.approx(5 / 6))
    f = K.mann_kendall([2] * 12)
    assert (f.s, f.z, f.p_value, f.trend) == (0, 0, 1, "no trend")
    assert (K.mann_kendall([1, NAN, 2, 3, NAN, 4]).n, K.mann_kendall([1, NAN, 2, 3, NAN, 4]).s) == (4, 6)
    assert K.mann_kendall(range(10, 0, -1)).trend == "decreasing" and K.mann_kendall(range(10), alpha=0.0).trend == "no trend"
    with pytest.raises(errors.InsufficientData, match="needed 3 observations, got 2"):
        K.mann_kendall([1, 2])


def test_distributions():
    assert K.norm_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12) and K.norm_sf(1) == pytest.approx(0.158655, abs=1e-6)
    assert K.student_t_two_sided(2.0, 10) == pytest.approx(0.073388, abs=1e-6) and K.student_t_two_sided(math.inf, 5) == 0
    assert K.student_t_two_sided(1.0, 1) == pytest.approx(0.5)
    assert K.bridge_p_value(1.358) == pytest.approx(0.05, abs=1e-3) and K.bridge_p_value(0) == 1
    assert K.incomplete_beta(2, 3, 0) == 0 and K.incomplete_beta(2, 3, 1) == 1


def test_harmonic():
    t = np.arange(48) / 12
    f = K.harmonic_regression(t, 2 + 0.1 * t + 1.5 * np.cos(2 * np.pi * t) + 0.8 * np.sin(2 * np.pi * t), 1.0, 1)
    c = f.components[0]
    assert (f.intercept, f.slope, c.cos_coef, c.sin_coef, c.amplitude, c.phase) == pytest.approx((2, 0.1, 1.5, 0.8, math.hypot(1.5, 0.8), math.atan2(0.8, 1.5)), abs=1e-9)
    assert (f.r_squared, f.rmse) == pytest.approx((1, 0), abs=1e-9) and f.predict(0.25) == pytest.approx(2.025 + 0.8, abs=1e-9)
    t = np.arange(60) / 12
    f = K.harmonic_regression(t, 1 - 0.05 * t + 0.6 * np.sin(2 * np.pi * t) + 0.25 * np.cos(4 * np.pi * t) - 0.1 * np.sin(4 * np.pi * t), 1.0, 2)
    assert [f.slope, *(x for c in f.components for x in (c.cos_coef, c.sin_coef))] == pytest.approx([-0.05, 0, 0.6, 0.25, -0.1], abs=1e-9)
    with pytest.raises(errors.SingularSystem):
        K.harmonic_regression(np.arange(20.0), np.arange(20.0), 1.0, 1)
    with pytest.raises(errors.InsufficientData, match="needed 7 observations, got 5"):
        K.harmonic_regression(range(5), range(5), 3.3, 2)
    for period, k in ((0, 1), (NAN, 1), (1, 0)):
        with pytest.raises(errors.InvalidParameter):
            K.harmonic_regression(range(20), range(20), period, k)


def test_breaks():
    n = noise(200)
    stable = K.detect_breaks(range(80), 2 + 0.05 * np.arange(80) + 0.3 * n[:80])
    assert not stable.breaks and stable.p_value >= 0.05
    one = K.detect_breaks(range(60), np.where(np.arange(60) < 30, 1.0, 6.0) + 0.2 * n[:60])
    assert [b.index for b in one.breaks] == [29] and one.breaks[0].time == 29 and one.breaks[0].statistic == one.statistic
    level = np.repeat([0.0, 5.0, -3.0], 40)
    assert [b.index for b in K.detect_breaks(range(120), level + 0.2 * n[:120]).breaks] == pytest.approx([39, 79], abs=1)
    t = np.arange(72) / 12
    season = 1 + 0.8 * np.sin(2 * np.pi * t) + 2.0 * (np.arange(72) >= 36) + 0.05 * n[:72]
    assert [b.index for b in K.detect_breaks(t, season, n_harmonics=1).breaks] == pytest.approx([35], abs=1)
    gaps = np.where(np.arange(60) % 10 == 7, NAN, np.where(np.arange(60) < 30, 1.0, 6.0) + 0.2 * n[:60])
    found = K.detect_breaks(range(60), gaps)
    assert found.n == 54 and found.breaks[0].time == 29 and found.breaks[0].index == 26
    assert K.detect_breaks(range(20), np.where(np.arange(20) < 10, 0.0, 9.0)).breaks == []
    exact = K.detect_breaks(range(30), [0.0] * 30)
    assert (exact.statistic, exact.p_value) == (0, 1)


@pytest.mark.parametrize(("kwargs", "error"), [({"alpha": 1.0}, errors.InvalidParameter), ({"min_segment": 3}, errors.InvalidParameter), ({"n_harmonics": 1, "period": 0}, errors.InvalidParameter), ({"min_segment": 100}, errors.InsufficientData)])
def test_break_parameters(kwargs, error):
    with pytest.raises(error):
        K.detect_breaks(range(50), range(50), **kwargs)


def test_break_order_and_rank():
    with pytest.raises(errors.DimensionMismatch):
        K.detect_breaks([*range(20), 3], range(21))
    with pytest.raises(errors.SingularSystem):
        K.detect_breaks([1.0] * 20, range(20))
    assert K.detect_breaks(range(50), range(50), alpha=0.0).breaks == []


def test_gapfill():
    assert K.gapfill(range(4), [1, NAN, NAN, 7]).tolist() == [1, 3, 5, 7]
    got = K.gapfill(range(8), [NAN, 1, NAN, 5, NAN, NAN, 8, NAN], 2)
    assert got[2] == 3 and np.isnan(got[[0, 4, 5, 7]]).all()
    with pytest.raises(errors.DimensionMismatch):
        K.gapfill([0, 2, 1], [1, 2, 3])


def slopes_by_pairs(t, v):
    i, j = np.triu_indices(len(t), 1)
    use = t[i] != t[j]
    return np.median((v[j] - v[i])[use] / (t[j] - t[i])[use])


@pytest.mark.parametrize("kind", ["plain", "ties", "equal times", "constant", "two values"])
def test_long_series(kind, monkeypatch):
    """Counting gives what all pairs give: small series with little room for pairs, and 20,000 observations."""
    r = np.random.default_rng(11)
    for n, room in ((7, 3), (50, 20), (400, 500), (20_000, 1 << 20)):
        monkeypatch.setattr(K, "PAIR_BLOCK", room)
        t = np.sort(r.integers(0, n // 2, n)).astype(float) if kind == "equal times" else 2000 + np.arange(n) / 365
        v = {"constant": np.full(n, 3.5), "two values": r.integers(0, 2, n).astype(float), "ties": np.round(r.normal(0, 2, n) + 0.01 * t)}.get(kind, r.normal(0, 1, n) + 0.1 * t)
        assert K.theil_sen(t, v).slope == pytest.approx(slopes_by_pairs(t, v), rel=1e-9, abs=1e-12)
        s = sum(int(np.sign(v[k + 1 :] - v[k]).sum()) for k in range(n - 1))
        assert K.mann_kendall(v).s == s
        if n == 20_000:
            assert batches.mann_kendall(v[None])["s"][0] == s
            assert batches.theil_sen(t[None], v[None])["slope"][0] == K.theil_sen(t, v).slope
