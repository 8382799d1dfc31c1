"""Reports about one series, as the command line prints them."""

from __future__ import annotations

from dataclasses import asdict

from cubespan.functions import kernels


def trend(name: str, t, v, alpha: float = 0.05) -> dict:
    ols, sen, mk = asdict(kernels.linear_trend(t, v)), kernels.theil_sen(t, v), asdict(kernels.mann_kendall(v, alpha))
    n = ols.pop("n")
    mk.pop("n")
    return {"input": name, "n": n, "ols": ols, "theil_sen": {"slope": sen.slope, "intercept": sen.intercept}, "mann_kendall": {"trend": mk.pop("trend"), "alpha": alpha, **mk}}


def harmonic(name: str, t, v, period: float = 1.0, n_harmonics: int = 2) -> dict:
    fit = asdict(kernels.harmonic_regression(t, v, period, n_harmonics))
    parts = fit.pop("components")
    return {"input": name, "n": fit.pop("n"), "period": fit.pop("period"), **fit, "components": parts}


def breaks(name: str, t, v, alpha: float = 0.05, n_harmonics: int = 0, period: float = 1.0, min_segment: int = 12) -> dict:
    found = asdict(kernels.detect_breaks(t, v, alpha, n_harmonics, period, min_segment))
    return {"input": name, "n": found["n"], "statistic": found["statistic"], "p_value": found["p_value"], "alpha": alpha, "breaks": found["breaks"]}
