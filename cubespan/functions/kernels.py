"""Estimators of one series as numpy functions: the part that Catalyst can't express well.

A series is a pair of equally long arrays (t, v). Missing observations are NaN or infinite in either.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from cubespan.errors import DimensionMismatch, InsufficientData, InvalidParameter, SingularSystem

#: Pairs that are held at a time.
PAIR_BLOCK = 1 << 22


@dataclass(frozen=True)
class LinearTrend:
    slope: float
    intercept: float
    r_squared: float
    std_err: float
    p_value: float
    n: int


@dataclass(frozen=True)
class TheilSen:
    slope: float
    intercept: float
    n: int


@dataclass(frozen=True)
class MannKendall:
    trend: str
    s: float
    var_s: float
    z: float
    tau: float
    p_value: float
    n: int


@dataclass(frozen=True)
class Component:
    harmonic: int
    cos_coef: float
    sin_coef: float
    amplitude: float
    phase: float


@dataclass(frozen=True)
class HarmonicFit:
    intercept: float
    slope: float
    components: list[Component]
    period: float
    r_squared: float
    rmse: float
    n: int

    def predict(self, t):
        """The fitted value at t."""
        t = np.asarray(t, np.float64)
        out = self.intercept + self.slope * t
        for c in self.components:
            angle = 2 * math.pi * c.harmonic / self.period * t
            out = out + c.cos_coef * np.cos(angle) + c.sin_coef * np.sin(angle)
        return out


@dataclass(frozen=True)
class Break:
    """index: the last observation before the change, counted over the finite ones."""

    index: int
    time: float
    statistic: float
    p_value: float


@dataclass(frozen=True)
class Breaks:
    statistic: float
    p_value: float
    breaks: list[Break] = field(default_factory=list)
    n: int = 0


def finite_pairs(t, v) -> tuple[np.ndarray, np.ndarray]:
    t, v = np.asarray(t, np.float64), np.asarray(v, np.float64)
    if t.shape != v.shape:
        raise DimensionMismatch(f"{t.size} times and {v.size} values")
    good = np.isfinite(t) & np.isfinite(v)
    return t[good], v[good]


# Distributions


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b), by its continued fraction (modified Lentz method)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    guard = lambda u: u if abs(u) > 1e-300 else 1e-300
    c, d = 1.0, 1.0 / guard(1.0 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 201):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for term in (even, odd):
            d = 1.0 / guard(1.0 + term * d)
            c = guard(1.0 + term / c)
            change = c * d
            h *= change
        if abs(change - 1.0) < 3e-14:
            break
    return front * h


def student_t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def bridge_p_value(s: float) -> float:
    """Chance that the largest absolute value of a Brownian bridge exceeds s."""
    if not s > 0:
        return 1.0
    j = np.arange(1, 101)
    p = float((np.where(j % 2, 2.0, -2.0) * np.exp(-2.0 * j * j * s * s)).sum())
    return min(1.0, max(0.0, p))


# Trends


def linear_trend(t, v) -> LinearTrend:
    """Ordinary least squares with a t-test of the slope."""
    t, v = finite_pairs(t, v)
    n = len(t)
    if n < 3:
        raise InsufficientData(3, n)
    dt, dv = t - t.mean(), v - v.mean()
    xx, xy, yy = float(dt @ dt), float(dt @ dv), float(dv @ dv)
    if xx == 0:
        raise DimensionMismatch("all times are equal")
    slope = xy / xx
    rest = max(0.0, yy - slope * xy)
    err = math.sqrt(rest / (n - 2) / xx)
    p = student_t_two_sided(slope / err, n - 2) if err > 0 else float(slope == 0)
    return LinearTrend(slope, float(v.mean() - slope * t.mean()), 1.0 - rest / yy if yy > 0 else 1.0, err, p, n)


def _inversions(b: np.ndarray):
    """Level by level of a merge sort: (left places in order, starts, ends) so that left[starts[k]:ends[k]] are the places before right[k] that hold more than it; with the right places."""
    n, width = len(b), 1
    rank = np.unique(b, return_inverse=True)[1].astype(np.int64)
    place, top = np.arange(n), int(rank.max(initial=0)) + 1
    while width < n:
        block = place // (2 * width)
        is_left = place // width % 2 == 0
        left, right = place[is_left], place[~is_left]
        key = block[is_left] * top + rank[left]
        order = np.argsort(key, kind="stable")
        key, left = key[order], left[order]
        mine = block[~is_left]
        yield left, right, np.searchsorted(key, mine * top + rank[right], "right"), np.searchsorted(key, (mine + 1) * top)
        width *= 2


def _inverted(b: np.ndarray) -> int:
    """Pairs i < j with b[i] > b[j], in n log(n)**2 steps."""
    return sum(int((ends - starts).sum()) for _, _, starts, ends in _inversions(b))


def _kth_slope(t: np.ndarray, v: np.ndarray, pairs: int, k: int) -> np.ndarray:
    """The slopes of rank k and k + 1, from 0, of all pairs with different times, or of rank k alone; t ascends, equal times by v.

    Slopes below m are the inversions of v - m t, so they are counted without making pairs. Pivots drawn from
    the slopes narrow the range until the pairs in it can be listed. Where too many for that lie within 1e-12
    of one slope, that slope is the result.
    """
    n, lo, hi, below, upto = len(t), -math.inf, math.inf, 0, pairs
    rng = np.random.default_rng(n)
    tiny = max(float(np.abs(v).max()) / float(np.ptp(t)) * 1e-13, 1e-300)
    while upto - below > PAIR_BLOCK:
        i, j = np.sort(rng.integers(0, n, (2, 1 << 17)), axis=0)
        use = t[i] < t[j]
        s = (v[j] - v[i])[use] / (t[j] - t[i])[use]
        s = np.sort(s[(s > lo) & (s < hi)])
        if not len(s):
            continue
        at, room = (k - below) / (upto - below) * len(s), 2 * math.sqrt(len(s)) + 1
        p, q = (float(s[int(np.clip(at + d, 0, len(s) - 1))]) for d in (-room, room))
        one = q - p <= 2 * max(abs(p) * 1e-12, tiny)
        if one:
            p, q = p - max(abs(p) * 1e-12, tiny), q + max(abs(q) * 1e-12, tiny)
        before = (lo, hi)
        for m in (p, q):
            if lo < m < hi:
                c = _inverted(v - m * t)
                lo, hi, below, upto = (m, hi, c, upto) if c <= k else (lo, m, below, c)
        if one and upto - below > PAIR_BLOCK and (before == (lo, hi) or (lo, hi) == (p, q)):
            return np.array([(p + q) / 2] * (2 if k + 1 < upto else 1))
    found = _listed(t, v, lo, hi)
    two = [x for x in (k - below, k + 1 - below) if x < len(found)]
    return np.partition(found, two)[two]


def _middle_slope(t: np.ndarray, v: np.ndarray) -> float:
    """The median of the slopes of all pairs with different times, in n log(n)**2 steps and bounded memory."""
    order = np.lexsort((v, t))
    t, v = t[order] - t.mean(), v[order]
    same, n = np.unique(t, return_counts=True)[1], len(t)
    pairs = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not pairs:
        raise DimensionMismatch("all times are equal")
    low = _kth_slope(t, v, pairs, (pairs - 1) // 2)
    if pairs % 2:
        return float(low[0])
    return float(low[0] + (low[1] if len(low) > 1 else _kth_slope(t, v, pairs, pairs // 2)[0])) / 2


def _listed(t: np.ndarray, v: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The slopes in [lo, hi): of pairs that change their order between v - lo t and v - hi t."""
    order = np.arange(len(t)) if lo == -math.inf else np.lexsort((t, v - lo * t))
    x, y = t[order], v[order]
    out = [np.zeros(0)]
    for left, right, starts, ends in _inversions(-x if hi == math.inf else y - hi * x):
        size = ends - starts
        i = left[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        j = np.repeat(right, size)
        out.append((y[j] - y[i]) / (x[j] - x[i]))
    return np.concatenate(out)


def theil_sen(t, v) -> TheilSen:
    """Median slope of all pairs with different times. Long series are counted instead of paired."""
    t, v = finite_pairs(t, v)
    n = len(t)
    if n < 2:
        raise InsufficientData(2, n)
    if n * (n - 1) // 2 > PAIR_BLOCK:
        slope = _middle_slope(t, v)
    else:
        i, j = np.triu_indices(n, 1)
        dt, dv = t[j] - t[i], v[j] - v[i]
        if not dt.any():
            raise DimensionMismatch("all times are equal")
        slope = float(np.median(dv[dt != 0] / dt[dt != 0]))
    return TheilSen(slope, float(np.median(v) - slope * np.median(t)), n)


def mann_kendall(v, alpha: float = 0.05) -> MannKendall:
    """Rank test for a monotonic trend, corrected for ties and continuity, in the order given."""
    v = np.asarray(v, np.float64)
    v = v[np.isfinite(v)]
    n = len(v)
    if n < 3:
        raise InsufficientData(3, n)
    g = np.unique(v + 0.0, return_counts=True)[1]
    s = n * (n - 1) // 2 - int((g * (g - 1) // 2).sum()) - 2 * _inverted(v + 0.0)
    g = g.astype(np.float64)
    var = (n * (n - 1) * (2 * n + 5) - float((g * (g - 1) * (2 * g + 5)).sum())) / 18.0
    z = (s - np.sign(s)) / math.sqrt(var) if s and var > 0 else 0.0
    p = 2.0 * norm_sf(abs(z))
    trend = "no trend" if not p < alpha else "increasing" if z > 0 else "decreasing"
    return MannKendall(trend, float(s), var, float(z), s / (n * (n - 1) / 2), p, n)


# Harmonics


def check_harmonic(period: float, n_harmonics: int) -> None:
    if not math.isfinite(period) or period <= 0:
        raise InvalidParameter(f"period must be finite and positive, not {period}")
    if n_harmonics < 1:
        raise InvalidParameter("at least one harmonic is needed; linear_trend fits a trend alone")


def solve_symmetric(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gaussian elimination with row pivoting. A pivot of 1e-12 p times the largest entry or less counts as zero."""
    m, p = np.column_stack([a, b]).astype(np.float64), len(b)
    least = float(np.abs(a).max()) * 1e-12 * p
    for k in range(p):
        top = k + int(np.argmax(np.abs(m[k:, k])))
        if not abs(m[top, k]) > least:
            raise SingularSystem("the regressors are collinear: an aliased harmonic or constant time")
        m[[k, top]] = m[[top, k]]
        m[k + 1 :, k:] -= np.outer(m[k + 1 :, k] / m[k, k], m[k, k:])
    x = np.zeros(p)
    for k in range(p - 1, -1, -1):
        x[k] = (m[k, p] - m[k, k + 1 : p] @ x[k + 1 :]) / m[k, k]
    return x


def design(t: np.ndarray, centre: float, period: float, n_harmonics: int) -> np.ndarray:
    """Columns 1, t - centre, then cosine and sine of each harmonic of t."""
    columns = [np.ones_like(t), t - centre]
    for k in range(1, n_harmonics + 1):
        angle = 2 * math.pi / period * k * t
        columns += [np.cos(angle), np.sin(angle)]
    return np.stack(columns, 1)


def _least_squares(t: np.ndarray, v: np.ndarray, period: float, n_harmonics: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, the centre of the times, residuals."""
    centre = float(t.mean())
    x = design(t, centre, period, n_harmonics)
    beta = solve_symmetric(x.T @ x, x.T @ v)
    return beta, centre, v - x @ beta


def harmonic_regression(t, v, period: float, n_harmonics: int = 2) -> HarmonicFit:
    """Trend and n_harmonics Fourier pairs by least squares."""
    check_harmonic(period, n_harmonics)
    t, v = finite_pairs(t, v)
    n, needed = len(t), 2 * n_harmonics + 3
    if n < needed:
        raise InsufficientData(needed, n)
    beta, centre, rest = _least_squares(t, v, period, n_harmonics)
    res, dv = float(rest @ rest), v - v.mean()
    yy = float(dv @ dv)
    parts = [Component(k, float(a), float(b), math.hypot(a, b), math.atan2(b, a)) for k, (a, b) in enumerate(beta[2:].reshape(-1, 2), 1)]
    return HarmonicFit(float(beta[0] - beta[1] * centre), float(beta[1]), parts, period, max(0.0, 1.0 - res / yy) if yy else 1.0, math.sqrt(res / n), n)


# Breaks


def check_breaks(alpha: float, n_harmonics: int, period: float, min_segment: int) -> None:
    if not 0.0 <= alpha < 1.0:
        raise InvalidParameter(f"alpha must be at least 0 and below 1, not {alpha}")
    if min_segment < 2 * n_harmonics + 4:
        raise InvalidParameter(f"min_segment must be {2 * n_harmonics + 4} or more, not {min_segment}")
    if n_harmonics > 0 and not (math.isfinite(period) and period > 0):
        raise InvalidParameter(f"period must be finite and positive, not {period}")


def cusum(t: np.ndarray, v: np.ndarray, n_harmonics: int, period: float) -> tuple[float, float, np.ndarray]:
    """Largest absolute value, p-value and path of the scaled cumulative sum of residuals."""
    _, _, rest = _least_squares(t, v, period, n_harmonics)
    n, sse = len(rest), float(rest @ rest)
    if sse <= 0:
        return 0.0, 1.0, np.zeros(n)
    path = np.cumsum(rest) / (math.sqrt(sse / (n - 2 - 2 * n_harmonics)) * math.sqrt(n))
    top = float(np.abs(path).max())
    return top, bridge_p_value(top), path


def detect_breaks(t, v, alpha: float = 0.05, n_harmonics: int = 0, period: float = 1.0, min_segment: int = 12) -> Breaks:
    """Structural breaks: a segment whose CUSUM is significant is split where it is largest, as long as both sides keep min_segment observations."""
    check_breaks(alpha, n_harmonics, period, min_segment)
    t, v = finite_pairs(t, v)
    n = len(t)
    if n < min_segment:
        raise InsufficientData(min_segment, n)
    if (np.diff(t) < 0).any():
        raise DimensionMismatch("times must ascend")
    whole = cusum(t, v, n_harmonics, period)
    found, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2 * min_segment:
            continue
        top, p, path = whole if hi - lo == n else cusum(t[lo:hi], v[lo:hi], n_harmonics, period)
        if p >= alpha:
            continue
        at = min_segment - 1 + int(np.argmax(np.abs(path[min_segment - 1 : hi - lo - min_segment])))
        found.append(Break(lo + at, float(t[lo + at]), top, p))
        todo += [(lo, lo + at + 1), (lo + at + 1, hi)]
    return Breaks(whole[0], whole[1], sorted(found, key=lambda b: b.index), n)


# Time axis


def gapfill(t, v, max_gap: float | None = None) -> np.ndarray:
    """Linear interpolation between finite neighbours whose times differ by max_gap at most; edges stay."""
    t, v = np.asarray(t, np.float64), np.asarray(v, np.float64)
    if (np.diff(t) < 0).any():
        raise DimensionMismatch("times must ascend")
    out, good = v.copy(), np.flatnonzero(np.isfinite(v))
    for a, z in zip(good[:-1], good[1:], strict=True):
        width = t[z] - t[a]
        if z - a > 1 and width > 0 and (max_gap is None or width <= max_gap):
            out[a + 1 : z] = v[a] + (v[z] - v[a]) * (t[a + 1 : z] - t[a]) / width
    return out
