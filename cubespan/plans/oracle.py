"""Texts of DuckDB SQL, independent of the Spark plans, for the queries of the driver contract."""

from __future__ import annotations

from collections.abc import Callable

ORIGIN = 2024


def year_part(ts: str) -> str:
    leap = f"(year({ts}) % 4 = 0 AND year({ts}) % 100 <> 0 OR year({ts}) % 400 = 0)"
    return f"(CAST(year({ts}) AS DOUBLE) + (CAST(dayofyear({ts}) - 1 AS DOUBLE) + CAST(epoch_us({ts}) % 86400000000 AS DOUBLE) / 86400e6) / (CASE WHEN {leap} THEN 366.0::DOUBLE ELSE 365.0::DOUBLE END))"


EVENTS = f"e AS (SELECT user_id, user_id // 10 AS y, user_id % 10 AS x, event_type AS band, event_id AS ti, {year_part('ts')} - {ORIGIN}.0::DOUBLE AS t, CASE WHEN event_id % 10 <> 7 THEN value END AS v FROM events)"
SIGNAL = "s AS (SELECT user_id AS k, ti, t, v + CASE WHEN user_id % 3 = 0 AND t >= 0.04::DOUBLE THEN 300.0::DOUBLE ELSE 0 END + CASE WHEN user_id % 3 = 1 THEN 2000.0::DOUBLE * t ELSE 0 END AS v FROM e)"


def months(step: bool = False) -> str:
    lower = " - CASE WHEN l_suppkey % 2 = 0 AND ti / 12.0::DOUBLE - 1995.0::DOUBLE >= 0.5 THEN 60000.0::DOUBLE ELSE 0 END" if step else ""
    return f"m AS (SELECT l_suppkey, ti, ti / 12.0::DOUBLE - 1995.0::DOUBLE AS t, v{lower} AS v FROM (SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS ti, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0::DOUBLE AS v FROM lineitem GROUP BY ALL))"


def rounded(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0::DOUBLE"


def bridge(s: str) -> str:
    total = f"list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0::DOUBLE * j * j * ({s}) * ({s}))))"
    return f"(CASE WHEN {s} > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, {total})) ELSE 1.0::DOUBLE END)"


def normal(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    series = f"list_sum(list_transform(range(0, 200), lambda n: exp(n * ln(2.0::DOUBLE) + (2 * n + 1) * ln({x}) - (lgamma(2 * n + 2.0::DOUBLE) - n * ln(2.0::DOUBLE) - lgamma(n + 1.0::DOUBLE)))))"
    return f"(CASE WHEN {z} = 0 THEN 1.0::DOUBLE WHEN {x} > 6.5 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {series}) END)"


def student(t: str, df: str) -> str:
    th = f"atan(abs({t}) / sqrt(CAST({df} AS DOUBLE)))"
    even = f"1 - sin({th}) * list_sum(list_transform(range(0, {df} // 2), lambda kk: exp(lgamma(kk + 0.5::DOUBLE) - lgamma(kk + 1.0::DOUBLE) - 0.5 * ln(pi())) * pow(cos({th}), 2 * kk)))"
    odd = f"1 - 2 / pi() * ({th} + coalesce(sin({th}) * cos({th}) * list_sum(list_transform(range(0, ({df} - 1) // 2), lambda kk: exp(lgamma(kk + 1.0::DOUBLE) - lgamma(kk + 1.5::DOUBLE) + 0.5 * ln(pi()) - ln(2.0::DOUBLE)) * pow(cos({th}), 2 * kk))), 0))"
    return f"(CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"


def simpson(f: Callable[[str], str], top: str, steps: int = 4000) -> str:
    """The integral of f from 0 to top."""
    weight = f"(CASE WHEN j = 0 OR j = {steps} THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END)"
    at = f(f"(j * ({top}) / {steps}.0::DOUBLE)")
    return f"(({top}) / {3 * steps}.0::DOUBLE * list_sum(list_transform(range(0, {steps + 1}), lambda j: {weight} * ({at}))))"


def normal_tail(z: str) -> str:
    """2 P(Z > z) as an integral, so that its digits hold far out."""
    x = f"({z} / sqrt(2.0::DOUBLE))"
    integral = simpson(lambda u: f"exp(-{u} * {u} - 2 * {x} * {u})", f"sqrt({x} * {x} + 42) - {x}")
    return f"(2 / sqrt(pi()) * exp(-{x} * {x}) * {integral})"


def student_tail(t: str, df: str) -> str:
    """The two-sided p-value as an integral over the angle."""
    integral = simpson(lambda u: f"pow(sin({u}), {df} - 1)", f"CASE WHEN {t} > 0 THEN atan(sqrt(CAST({df} AS DOUBLE)) / {t}) ELSE pi() / 2 END")
    return f"(2 / sqrt(pi()) * exp(lgamma(({df} + 1) / 2.0::DOUBLE) - lgamma({df} / 2.0::DOUBLE)) * {integral})"


def ols(rel: str, key: str) -> str:
    """fit(key, n, slope, intercept, r_squared, std_err, p_value) of rel(key, t, v)."""
    return f"""sums AS (
  SELECT {key}, count(v) AS n, regr_slope(v, t) AS b, regr_intercept(v, t) AS a, regr_sxx(v, t) AS xx, regr_sxy(v, t) AS xy, regr_syy(v, t) AS yy
  FROM {rel} GROUP BY {key}
), errs AS (
  SELECT *, n >= 3 AND xx > 0 AS ok, greatest(0.0::DOUBLE, yy - b * xy) AS rest FROM sums
), fit0 AS (
  SELECT {key}, n, CASE WHEN ok THEN b END AS slope, CASE WHEN ok THEN a END AS intercept, CASE WHEN ok THEN CASE WHEN yy > 0 THEN 1 - rest / yy ELSE 1.0 END END AS r_squared,
         CASE WHEN ok THEN sqrt(rest / (n - 2) / xx) END AS std_err
  FROM errs
), fit AS (
  SELECT *, CASE WHEN std_err > 0 THEN {student("(slope / std_err)", "(n - 2)")} WHEN slope = 0 THEN 1.0::DOUBLE WHEN slope IS NOT NULL THEN 0.0::DOUBLE END AS p_value FROM fit0
)"""


def pairs(rel: str, key: str) -> str:
    """obs(key, t, v, pos) of finite values and pair(key, t1, v1, t2, v2) of rel(key, ti, t, v)."""
    return f"""obs AS (
  SELECT {key}, t, v, row_number() OVER (PARTITION BY {key} ORDER BY t, ti) AS pos FROM {rel} WHERE v IS NOT NULL
), pair AS (
  SELECT a.{key}, a.t AS t1, a.v AS v1, b.t AS t2, b.v AS v2 FROM obs a JOIN obs b ON a.{key} = b.{key} AND a.pos < b.pos
)"""


def theil_sen(key: str) -> str:
    """sen(key, slope, intercept, n) from pairs()."""
    return f"""mid AS (SELECT {key}, median(v) AS mv, median(t) AS mt, count(*) AS n FROM obs GROUP BY {key}),
slopes AS (SELECT {key}, median((v2 - v1) / (t2 - t1)) AS slope FROM pair WHERE t1 <> t2 GROUP BY {key}),
sen AS (SELECT {key}, slope, mv - slope * mt AS intercept, n FROM slopes JOIN mid USING ({key}))"""


def mann_kendall(key: str) -> str:
    """mk(key, s, var_s, z, tau, p_value, n) from pairs()."""
    return f"""sgn AS (SELECT {key}, CAST(sum(sign(v2 - v1)) AS DOUBLE) AS s FROM pair GROUP BY {key}),
ties AS (SELECT {key}, CAST(sum(g) AS BIGINT) AS n, sum(CAST(g AS DOUBLE) * (g - 1) * (2 * g + 5)) AS tied FROM (SELECT {key}, v, count(*) AS g FROM obs GROUP BY ALL) GROUP BY {key}),
var AS (SELECT {key}, n, s, (CAST(n AS DOUBLE) * (n - 1) * (2 * n + 5) - tied) / 18 AS var_s FROM ties JOIN sgn USING ({key}) WHERE n >= 3),
scored AS (SELECT *, CASE WHEN s <> 0 AND var_s > 0 THEN (s - sign(s)) / sqrt(var_s) ELSE 0.0::DOUBLE END AS z, s / (CAST(n AS DOUBLE) * (n - 1) / 2) AS tau FROM var),
mk AS (SELECT *, {normal("z")} AS p_value FROM scored)"""


def composite(rel: str, key: str, method: str, width: float | None) -> str:
    """comp(key.., t, v): rel(key.., ti, t, v)."""
    how = {"median": "median(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)"}[method]
    g = "t" if width is None else f"CAST(floor((t - (SELECT min(t) FROM axis)) / {width!r}::DOUBLE) AS BIGINT)"
    return f"""axis AS (SELECT DISTINCT ti, t FROM {rel}),
ats AS (SELECT {g} AS g, avg(t) AS gt FROM axis GROUP BY 1),
comp AS (SELECT {key}, gt AS t, v FROM (SELECT {key}, {g} AS g, {how} AS v FROM {rel} GROUP BY ALL) JOIN ats USING (g))"""


def gapfill(rel: str, key: str, max_gap: float | None) -> str:
    """filled(key, ti, t, v)."""
    cond = "" if max_gap is None else f" AND n_t - p_t <= {max_gap!r}::DOUBLE"
    look = lambda f, side, c: f"{f}(CASE WHEN v IS NOT NULL THEN {c} END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY t, ti ROWS BETWEEN {side})"
    back, ahead = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"
    return f"""near AS (
  SELECT *, {look("last_value", back, "t")} AS p_t, {look("last_value", back, "v")} AS p_v, {look("first_value", ahead, "t")} AS n_t, {look("first_value", ahead, "v")} AS n_v FROM {rel}
), filled AS (
  SELECT {key}, ti, t, CASE WHEN v IS NOT NULL THEN v WHEN n_t - p_t > 0{cond} THEN p_v + (n_v - p_v) * (t - p_t) / (n_t - p_t) END AS v FROM near
)"""


def harmonic(rel: str, key: str, period: str, k: int = 1) -> str:
    """har(key, n, centre, b0, b1, ...) and rest(key, sse, yy) of rel(key, t, v): the normal equations, eliminated step by step without pivoting."""
    p = 2 + 2 * k
    basis = ["1.0::DOUBLE", "(t - c)"] + [f"{f}(2 * pi() / ({period}) * {h} * t)" for h in range(1, k + 1) for f in ("cos", "sin")]
    rows = ", ".join(f"{e} AS x{i}" for i, e in enumerate(basis))
    sums = ", ".join([f"sum(x{i} * x{j}) AS a0_{i}_{j}" for i in range(p) for j in range(p)] + [f"sum(x{i} * v) AS r0_{i}" for i in range(p)])
    steps = []
    for s in range(p - 1):
        cells = [f"a{s}_{i}_{j} - a{s}_{i}_{s} / a{s}_{s}_{s} * a{s}_{s}_{j} AS a{s + 1}_{i}_{j}" if i > s else f"a{s}_{i}_{j} AS a{s + 1}_{i}_{j}" for i in range(p) for j in range(p)]
        cells += [f"r{s}_{i} - a{s}_{i}_{s} / a{s}_{s}_{s} * r{s}_{s} AS r{s + 1}_{i}" if i > s else f"r{s}_{i} AS r{s + 1}_{i}" for i in range(p)]
        steps.append(f"el{s + 1} AS (SELECT {key}, n, centre, {', '.join(cells)} FROM el{s})")
    last, back, fitted = p - 1, [], " - ".join(f"b{i} * x{i}" for i in range(p))
    for i in range(p - 1, -1, -1):
        rest = "".join(f" - a{last}_{i}_{j} * b{j}" for j in range(i + 1, p))
        have = ", ".join(f"b{j}" for j in range(i + 1, p))
        back.append(f"bk{i} AS (SELECT *, (r{last}_{i}{rest}) / a{last}_{i}_{i} AS b{i} FROM {'bk' + str(i + 1) if have else 'el' + str(last)})")
    return f"""cen AS (SELECT {key}, t, v, avg(t) OVER (PARTITION BY {key}) AS c FROM {rel} WHERE v IS NOT NULL),
des AS (SELECT {key}, v, c, {rows} FROM cen),
el0 AS (SELECT {key}, count(*) AS n, min(c) AS centre, {sums} FROM des GROUP BY {key} HAVING count(*) >= {p + 1}),
{', '.join(steps)}, {', '.join(back)}, har AS (SELECT * FROM bk0),
rest AS (SELECT {key}, sum(pow(v - {fitted}, 2)) AS sse, regr_syy(v, v) AS yy FROM des JOIN har USING ({key}) GROUP BY {key})"""


def breaks(rel: str, key: str, alpha: float = 0.05, least: int = 12, levels: int = 6) -> str:
    """cus(key, n, statistic, p_value) and brk(key, idx, time, statistic, p_value): the recursion on straight-line segments, a level after the other."""
    out = [f"ob AS (SELECT {key}, t, v, row_number() OVER (PARTITION BY {key} ORDER BY t, ti) - 1 AS pos FROM {rel} WHERE v IS NOT NULL)", f"seg0 AS (SELECT {key}, 0 AS lo, count(*) AS hi FROM ob GROUP BY {key} HAVING count(*) >= {least})"]
    for i in range(levels):
        out += [
            f"li{i} AS (SELECT {key}, s.lo, s.hi, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM ob JOIN seg{i} s USING ({key}) WHERE pos >= s.lo AND pos < s.hi GROUP BY ALL)",
            f"re{i} AS (SELECT {key}, lo, hi, pos, t, v - a - b * t AS e FROM ob JOIN li{i} USING ({key}) WHERE pos >= lo AND pos < hi)",
            f"pa{i} AS (SELECT *, sum(e) OVER (PARTITION BY {key}, lo ORDER BY pos) / (sqrt(sum(e * e) OVER (PARTITION BY {key}, lo) / (hi - lo - 2)) * sqrt(hi - lo)) AS w FROM re{i})",
            f"st{i} AS (SELECT {key}, lo, hi, max(abs(w)) AS statistic, arg_max(pos, row(abs(w), -pos)) FILTER (pos >= lo + {least - 1} AND pos <= hi - {least + 1}) AS idx, arg_max(t, row(abs(w), -pos)) FILTER (pos >= lo + {least - 1} AND pos <= hi - {least + 1}) AS time FROM pa{i} GROUP BY ALL)",
            f"br{i} AS (SELECT * FROM (SELECT *, {bridge('statistic')} AS p_value FROM st{i}) WHERE hi - lo >= {2 * least} AND p_value < {alpha})",
            f"seg{i + 1} AS (SELECT {key}, lo, idx + 1 AS hi FROM br{i} UNION ALL SELECT {key}, idx + 1, hi FROM br{i})",
        ]
    out.append(f"cus AS (SELECT {key}, hi AS n, statistic, {bridge('statistic')} AS p_value, idx, time FROM st0)")
    out.append("brk AS (" + " UNION ALL ".join(f"SELECT {key}, idx, time, statistic, p_value FROM br{i}" for i in range(levels)) + ")")
    return ",\n".join(out)


def harmonic_breaks(rel: str, key: str, period: str, alpha: float = 0.05, least: int = 12, levels: int = 5) -> str:
    """As breaks(), on residuals of a line and one harmonic: each level's segments are solved as harmonic() does."""
    out = [f"ob AS MATERIALIZED (SELECT {key}, t, v, row_number() OVER (PARTITION BY {key} ORDER BY t, ti) - 1 AS pos FROM {rel} WHERE v IS NOT NULL)", f"seg0 AS MATERIALIZED (SELECT {key}, 0 AS lo, count(*) AS hi FROM ob GROUP BY {key} HAVING count(*) >= {least})"]
    angle = f"2 * pi() / ({period}) * t"
    for i in range(levels):
        x = ["1.0::DOUBLE", "t - c", f"cos({angle})", f"sin({angle})"]
        p = range(4)
        sums = ", ".join([f"sum(x{r} * x{q}) AS a{r}{q}" for r in p for q in p] + [f"sum(x{r} * v) AS r{r}" for r in p])
        out += [
            f"ce{i} AS MATERIALIZED (SELECT {key}, s.lo, s.hi, pos, t, v, avg(t) OVER (PARTITION BY {key}, s.lo) AS c FROM ob JOIN seg{i} s USING ({key}) WHERE pos >= s.lo AND pos < s.hi)",
            f"de{i} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS x{k}' for k, e in enumerate(x))} FROM ce{i})",
            f"no{i}_0 AS (SELECT {key}, lo, {sums} FROM de{i} GROUP BY {key}, lo)",
        ]
        for k in range(3):
            cells = [f"a{r}{q} - a{r}{k} / a{k}{k} * a{k}{q} AS a{r}{q}" if r > k else f"a{r}{q}" for r in p for q in p] + [f"r{r} - a{r}{k} / a{k}{k} * r{k} AS r{r}" if r > k else f"r{r}" for r in p]
            out.append(f"no{i}_{k + 1} AS MATERIALIZED (SELECT {key}, lo, {', '.join(cells)} FROM no{i}_{k})")
        out += [
            f"so{i} AS (SELECT *, (r0 - a01 * b1 - a02 * b2 - a03 * b3) / a00 AS b0 FROM (SELECT *, (r1 - a12 * b2 - a13 * b3) / a11 AS b1 FROM (SELECT *, (r2 - a23 * b3) / a22 AS b2 FROM (SELECT *, r3 / a33 AS b3 FROM no{i}_3))))",
            f"re{i} AS MATERIALIZED (SELECT {key}, lo, hi, pos, t, v - b0 * x0 - b1 * x1 - b2 * x2 - b3 * x3 AS e FROM de{i} JOIN so{i} USING ({key}, lo))",
            f"pa{i} AS MATERIALIZED (SELECT *, sum(e) OVER (PARTITION BY {key}, lo ORDER BY pos) / (sqrt(sum(e * e) OVER (PARTITION BY {key}, lo) / (hi - lo - 4)) * sqrt(hi - lo)) AS w FROM re{i})",
            f"st{i} AS (SELECT {key}, lo, hi, max(abs(w)) AS statistic, arg_max(pos, row(abs(w), -pos)) FILTER (pos >= lo + {least - 1} AND pos <= hi - {least + 1}) AS idx, arg_max(t, row(abs(w), -pos)) FILTER (pos >= lo + {least - 1} AND pos <= hi - {least + 1}) AS time FROM pa{i} GROUP BY ALL)",
            f"br{i} AS MATERIALIZED (SELECT * FROM (SELECT *, {bridge('statistic')} AS p_value FROM st{i}) WHERE hi - lo >= {2 * least} AND p_value < {alpha})",
            f"seg{i + 1} AS MATERIALIZED (SELECT {key}, lo, idx + 1 AS hi FROM br{i} UNION ALL SELECT {key}, idx + 1, hi FROM br{i})",
        ]
    out.append(f"cus AS (SELECT {key}, hi AS n FROM seg0)")
    out.append("brk AS (" + " UNION ALL ".join(f"SELECT {key}, idx, time FROM br{i}" for i in range(levels)) + ")")
    return ",\n".join(out)


def _kruger() -> dict[str, object]:
    """WGS 84 and the coefficients of Krüger's series to the fourth order of the third flattening n (Karney 2011)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    return {
        "e": (f * (2 - f)) ** 0.5,
        "r": 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "a": (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280),
        "b": (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280),
    }


def utm(rel: str, key: str, source: int, target: int) -> str:
    """moved(key, x, y): places of rel(key, x, y) of one southern zone in another. Conformal and geographic latitude differ by a fixed point of twelve steps."""
    k = _kruger()
    e, r = f"{k['e']!r}::DOUBLE", f"{k['r']!r}::DOUBLE"
    inner = lambda c, g, h: " ".join(f"- {v!r}::DOUBLE * {g}({2 * j} * xi) * {h}({2 * j} * eta)" for j, v in enumerate(c, 1))
    outer = lambda c, g, h: " ".join(f"+ {v!r}::DOUBLE * {g}({2 * j} * xi) * {h}({2 * j} * eta)" for j, v in enumerate(c, 1))
    steps = ",\n".join(f"la{i + 1} AS (SELECT {key}, lon, c, tanh(c + {e} * atanh({e} * s)) AS s FROM la{i})" for i in range(12))
    central = lambda zone: f"({zone % 100} * 6 - 183)"
    return f"""co AS (SELECT {key}, (x - 500000) / {r} AS eta, (y - 10000000) / {r} AS xi FROM {rel}),
cp AS (SELECT {key}, eta {inner(k['b'], 'cos', 'sinh')} AS p, xi {inner(k['b'], 'sin', 'cosh')} AS q FROM co),
cq AS (SELECT {key}, atanh(sin(q) / cosh(p)) AS c, degrees(atan2(sinh(p), cos(q))) + {central(source)} AS lon FROM cp),
la0 AS (SELECT {key}, lon, c, tanh(c) AS s FROM cq),
{steps},
ga AS (SELECT {key}, radians(lon - {central(target)}) AS lam, sinh(atanh(s) - {e} * atanh({e} * s)) AS tau FROM la12),
gb AS (SELECT {key}, atan2(tau, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tau * tau + cos(lam) * cos(lam))) AS eta FROM ga),
moved AS (SELECT {key}, 500000 + {r} * (eta {outer(k['a'], 'cos', 'sinh')}) AS x, 10000000 + {r} * (xi {outer(k['a'], 'sin', 'cosh')}) AS y FROM gb)"""
