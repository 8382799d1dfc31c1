"""Estimators over packed series as Arrow functions for DataFrames and SQL.

A packed series is two arrays, times and values. A data error of a series gives null and doesn't fail the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType
from pyspark.sql.types import _parse_datatype_string as parse_type

from cubespan.errors import CubeError
from cubespan.functions import batches, kernels

LINEAR = "struct<slope:double,intercept:double,r_squared:double,std_err:double,p_value:double,n:bigint>"
THEIL_SEN = "struct<slope:double,intercept:double,n:bigint>"
MANN_KENDALL = "struct<trend:string,s:double,var_s:double,z:double,tau:double,p_value:double,n:bigint>"
HARMONIC = "struct<intercept:double,slope:double,components:array<struct<harmonic:int,cos_coef:double,sin_coef:double,amplitude:double,phase:double>>,period:double,r_squared:double,rmse:double,n:bigint>"
BREAKS = "struct<statistic:double,p_value:double,breaks:array<struct<index:int,time:double,statistic:double,p_value:double>>,n:bigint>"
TREND_MAP = "struct<slope:double,p_value:double>"
BREAK_MAP = "struct<count:double,first_break:double>"


def series(times: pa.Array, values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """The pairs of arrays of two list columns; None where one is null."""
    sides = []
    for c in (times, values):
        if isinstance(c, pa.ChunkedArray):
            c = c.combine_chunks()
        flat = c.values.cast(pa.float64())
        sides.append((c.offsets.to_numpy(), np.asarray(flat.to_numpy(zero_copy_only=False), np.float64), c.is_valid().to_numpy(zero_copy_only=False)))
    (to, tv, tk), (vo, vv, vk) = sides
    for i in range(len(tk)):
        yield (tv[to[i] : to[i + 1]], vv[vo[i] : vo[i + 1]]) if tk[i] and vk[i] else None


def over_series(kernel: Callable, returns: str | DataType) -> Callable:
    """An Arrow function of two list columns from a function of two arrays that gives a dict, or None."""
    kind = parse_type(returns) if isinstance(returns, str) else returns
    arrow = to_arrow_type(kind)

    @F.arrow_udf(returnType=kind)
    def run(times: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for pair in series(times, values):
            try:
                out.append(None if pair is None else kernel(*pair))
            except CubeError:
                out.append(None)
        return pa.array(out, arrow)

    return run


def _none(x: float) -> float | None:
    return x if np.isfinite(x) else None


def grouped(times: pa.Array, values: pa.Array, both: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of two list columns by the number of their finite observations: (rows, T, V). Null rows and rows with different numbers of times and values are left out. both: times have to be finite, too."""
    found: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for k, pair in enumerate(series(times, values)):
        if pair is not None and len(pair[0]) == len(pair[1]):
            t, v = pair
            good = np.isfinite(v) & np.isfinite(t) if both else np.isfinite(v)
            if not good.all():
                t, v = t[good], v[good]
            found.setdefault(len(v), []).append((k, t, v))
    for n, own in found.items():
        yield np.array([k for k, _, _ in own]), np.array([t for _, t, _ in own]).reshape(len(own), n), np.array([v for _, _, v in own]).reshape(len(own), n)


def _arrow_type(returns: str) -> pa.DataType:
    return to_arrow_type(parse_type(returns))


def over_batches(estimate: Callable, returns: str, names: tuple[str, ...], both: bool = True) -> Callable:
    """An Arrow function of two list columns from an estimator of batches.py whose result has the fields names of the struct."""
    arrow = _arrow_type(returns)

    @F.arrow_udf(returnType=parse_type(returns))
    def run(times: pa.Array, values: pa.Array) -> pa.Array:
        size, whole = len(times), np.zeros(len(times), bool)
        columns = {f: np.zeros(size, object if f == "trend" else np.int64 if f == "n" else np.float64) for f in names}
        for rows, t, v in grouped(times, values, both):
            got = estimate(t, v)
            whole[rows] = got["ok"]
            for f in names:
                columns[f][rows] = got[f]
        parts = [pa.array(columns[f], arrow.field(f).type, mask=~whole) for f in names]
        return pa.StructArray.from_arrays(parts, fields=list(arrow), mask=pa.array(~whole))

    return run


def linear_trend():
    return over_series(lambda t, v: asdict(kernels.linear_trend(t, v)), LINEAR)


def theil_sen():
    return over_batches(batches.theil_sen, THEIL_SEN, ("slope", "intercept", "n"))


def mann_kendall(alpha: float = 0.05):
    return over_batches(lambda t, v: batches.mann_kendall(v, alpha), MANN_KENDALL, ("trend", "s", "var_s", "z", "tau", "p_value", "n"), both=False)


def trend_map(alpha: float = 0.05):
    """Slope by Theil-Sen and p-value by Mann-Kendall; each is null by itself."""
    arrow = _arrow_type(TREND_MAP)

    @F.arrow_udf(returnType=parse_type(TREND_MAP))
    def run(times: pa.Array, values: pa.Array) -> pa.Array:
        slope, p = np.full(len(times), np.nan), np.full(len(times), np.nan)
        for rows, t, v in grouped(times, values):
            got = batches.theil_sen(t, v)
            slope[rows] = np.where(got["ok"], got["slope"], np.nan)
        for rows, _, v in grouped(times, values, both=False):
            got = batches.mann_kendall(v, alpha)
            p[rows] = np.where(got["ok"], got["p_value"], np.nan)
        return pa.StructArray.from_arrays([pa.array(c, pa.float64(), from_pandas=True) for c in (slope, p)], fields=list(arrow))

    return run


def ols_map():
    def estimate(t: np.ndarray, v: np.ndarray) -> dict:
        try:
            fit = kernels.linear_trend(t, v)
        except CubeError:
            return {"slope": None, "p_value": None}
        return {"slope": fit.slope, "p_value": fit.p_value}

    return over_series(estimate, TREND_MAP)


def harmonic_regression(period: float, n_harmonics: int = 2):
    kernels.check_harmonic(period, n_harmonics)
    arrow = _arrow_type(HARMONIC)
    part = arrow.field("components").type.value_type

    @F.arrow_udf(returnType=parse_type(HARMONIC))
    def run(times: pa.Array, values: pa.Array) -> pa.Array:
        size = len(times)
        whole = np.zeros(size, bool)
        plain = {f: np.zeros(size) for f in ("intercept", "slope", "r_squared", "rmse", "n")}
        wide = {f: np.zeros((size, n_harmonics)) for f in ("cos", "sin")}
        for rows, t, v in grouped(times, values):
            got = batches.harmonic_regression(t, v, period, n_harmonics)
            whole[rows] = got["ok"]
            for c in (plain, wide):
                for f in c:
                    c[f][rows] = got[f]
        a, b = wide["cos"].ravel(), wide["sin"].ravel()
        number = np.tile(np.arange(1, n_harmonics + 1, dtype=np.int32), size)
        parts = pa.StructArray.from_arrays([pa.array(x) for x in (number, a, b, np.hypot(a, b), np.arctan2(b, a))], fields=list(part))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * n_harmonics), parts).cast(arrow.field("components").type)
        columns = [pa.array(plain["intercept"]), pa.array(plain["slope"]), listed, pa.array(np.full(size, float(period))), pa.array(plain["r_squared"]), pa.array(plain["rmse"]), pa.array(plain["n"].astype(np.int64))]
        return pa.StructArray.from_arrays(columns, fields=list(arrow), mask=pa.array(~whole))

    return run


def _over_breaks(kernel: Callable, returns: str, missing: dict | None, **options) -> Callable:
    arrow = _arrow_type(returns)

    @F.arrow_udf(returnType=parse_type(returns))
    def run(times: pa.Array, values: pa.Array) -> pa.Array:
        out: list[dict | None] = [missing] * len(times)
        for rows, t, v in grouped(times, values):
            for k, found in zip(rows.tolist(), batches.detect_breaks(t, v, **options), strict=True):
                out[k] = missing if found is None else kernel(found)
        return pa.array(out, arrow)

    return run


def detect_breaks(alpha: float = 0.05, n_harmonics: int = 0, period: float = 1.0, min_segment: int = 12):
    kernels.check_breaks(alpha, n_harmonics, period, min_segment)
    return _over_breaks(asdict, BREAKS, None, alpha=alpha, n_harmonics=n_harmonics, period=period, min_segment=min_segment)


def break_map(alpha: float = 0.05, n_harmonics: int = 0, period: float = 1.0):
    """How many breaks, and the time of the first; both are null if the series can't be tested."""
    least = max(12, 2 * n_harmonics + 4)
    kernels.check_breaks(alpha, n_harmonics, period, least)
    first = lambda b: {"count": float(len(b.breaks)), "first_break": b.breaks[0].time if b.breaks else None}
    return _over_breaks(first, BREAK_MAP, {"count": None, "first_break": None}, alpha=alpha, n_harmonics=n_harmonics, period=period, min_segment=least)


def gapfill(max_gap: float | None = None):
    return over_series(lambda t, v: [_none(x) for x in kernels.gapfill(t, v, max_gap)], "array<double>")


def register(spark: SparkSession) -> list[str]:
    """Registers the estimators as SQL functions of (times, values) with default parameters; harmonic_regression has an annual period and two harmonics."""
    found = {
        "linear_trend": linear_trend(),
        "theil_sen": theil_sen(),
        "mann_kendall": mann_kendall(),
        "harmonic_regression": harmonic_regression(1.0, 2),
        "detect_breaks": detect_breaks(),
        "gapfill_linear": gapfill(),
        "trend_map_theil_sen": trend_map(),
        "trend_map_ols": ols_map(),
    }
    for name, f in found.items():
        spark.udf.register(name, f)
    return sorted(found)
