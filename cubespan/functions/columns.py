"""Column expressions: everything here is planned by Catalyst and runs without Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of the Sentinel-2 scene classification that hide the ground.
SCL_MASKED = (0, 1, 3, 8, 9, 10, 11)


def finite(v: Column) -> Column:
    """v, or null where it is null, NaN or infinite."""
    v = v.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def _days(year: Column) -> Column:
    return F.when(is_leap(year), F.lit(366.0)).otherwise(F.lit(365.0))


def fractional_year(ts: Column) -> Column:
    """Of a timestamp or date: the year and the part of it that has passed."""
    year = F.year(ts)
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = seconds.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return year.cast("double") + ((F.dayofyear(ts) - 1).cast("double") + micros.cast("double") / F.lit(86400e6)) / _days(year)


def fractional_year_iso(iso: Column) -> Column:
    """Of an ISO 8601 text, null if it is malformed. An offset is ignored, and a day up to 31 is taken in any month."""
    part = lambda a, n: F.substring(iso, a, n)
    number = lambda c, pattern: F.when(c.rlike(pattern), c.try_cast("double"))
    year, month, day = (number(part(a, n), r"^[+]?\d+$" if n == 2 else r"^[+-]?\d+$").cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    before = F.element_at(F.array(*map(F.lit, (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334))), F.when(month.between(1, 12), month).otherwise(1))
    doy = before + day + F.when((month > 2) & is_leap(year), 1).otherwise(0)
    hour = part(12, 2).try_cast("double")
    minute = F.coalesce(part(15, 2).try_cast("double"), F.lit(0.0))
    second = F.coalesce(F.regexp_extract(F.substring(iso, 18, 1 << 20), r"^[0-9.]*", 0).try_cast("double"), F.lit(0.0))
    clock = F.when(F.length(iso) > 10, (hour * 3600 + minute * 60 + second) / 86400.0).otherwise(0.0)
    good = (F.length(iso) >= 10) & (part(5, 1) == "-") & (part(8, 1) == "-") & month.between(1, 12) & day.between(1, 31) & ((F.length(iso) == 10) | part(11, 1).isin("T", " "))
    return F.when(good, year.cast("double") + (doy.cast("double") - 1.0 + clock) / _days(year))


def nodata_to_null(v: Column, nodata: Column | float | None) -> Column:
    """Null where v is exactly the no-data value."""
    if nodata is None:
        return v
    return F.when(v.isNotNull() & ~v.eqNullSafe(nodata if isinstance(nodata, Column) else F.lit(float(nodata))), v)


def rescale(v: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    return v if (scale, offset) == (1.0, 0.0) else v * F.lit(scale) + F.lit(offset)


def ndvi(nir: Column, red: Column) -> Column:
    return finite(F.try_divide(nir - red, nir + red))


def scl_clear(scl: Column) -> Column:
    """Whether the scene classification lets the ground be seen."""
    return ~scl.isin(*SCL_MASKED)


def _continued(terms: Column, step) -> Column:
    """b1 + a1 / (b2 + a2 / ...), from the last term back: step(f, k) makes it one term longer in front."""
    return F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), step)


def normal_two_sided(z: Column) -> Column:
    """2 P(Z > abs z), to about 13 digits: the series of the error function near zero, the continued fraction of its complement beyond."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(x.alias("term"), x.alias("acc")),
        lambda a, n: F.struct((a["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (a["acc"] + a["term"] * 2 * x * x / (2 * n + 1)).alias("acc")),
        lambda a: a["acc"],
    )
    near = 1 - F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * terms
    far = F.exp(-x * x) / (F.lit(math.sqrt(math.pi)) * (x + 0.5 / _continued(F.lit(160), lambda f, k: x + (k + 1) / 2.0 / f)))
    return F.when(x < 1.8, near).when(x < 28.0, far).when(x.isNotNull(), 0.0)


def _beta_fraction(a: Column, b: Column, x: Column, terms: Column) -> Column:
    """The continued fraction of the incomplete beta function."""

    def step(f: Column, k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) / f

    return 1 / _continued(terms, step)


def _gamma_ratio(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a): the asymptotic series at a + 16, brought back by a product."""
    n = a + 16
    series = 0.5 * F.log(n) - 1 / (8 * n) + 1 / (192 * F.pow(n, F.lit(3))) - 1 / (640 * F.pow(n, F.lit(5))) + 17 / (14336 * F.pow(n, F.lit(7)))
    out = F.exp(series)
    for i in range(16):
        out = out * ((a + i) / (a + i + 0.5))
    return out


def student_t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value, to about 11 digits at any t: the incomplete beta function of df / (df + t * t), or its complement where that is small."""
    n = df.cast("double")
    a, half, tt = n / 2, F.lit(0.5), t * t
    x, y = n / (n + tt), tt / (n + tt)
    front = F.exp(a * -F.log1p(tt / n)) * F.sqrt(y) * _gamma_ratio(a) / F.lit(math.sqrt(math.pi))
    terms = F.lit(60) + (4 * F.sqrt(n)).cast("int")
    tail = front / a * _beta_fraction(a, half, x, terms)
    middle = 1 - front * 2 * _beta_fraction(half, a, y, terms)
    return F.when(tt == float("inf"), 0.0).when(tt > 3 * n / (n + 2), F.greatest(F.lit(0.0), tail)).when(tt > 0, middle).when(tt == 0, 1.0)


def bridge_p_value(s: Column) -> Column:
    """Chance that the largest absolute value of a Brownian bridge exceeds s."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, j: a + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * s * s))
    return F.when(s > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).when(s.isNotNull(), 1.0)


def trend_label(p: Column, z: Column, alpha: float) -> Column:
    return F.when(p < alpha, F.when(z > 0, "increasing").otherwise("decreasing")).when(p.isNotNull(), "no trend")


def amplitude(cos_coef: Column, sin_coef: Column) -> Column:
    return F.hypot(cos_coef, sin_coef)


def phase(cos_coef: Column, sin_coef: Column) -> Column:
    return F.atan2(sin_coef, cos_coef)


def harmonic_predict(fit: Column, t: Column) -> Column:
    """Value of a harmonic fit (a struct with intercept, slope, period and components) at t."""
    return F.aggregate(
        fit["components"],
        fit["intercept"] + fit["slope"] * t,
        lambda a, c: a + c["cos_coef"] * F.cos(F.lit(2 * math.pi) * c["harmonic"] / fit["period"] * t) + c["sin_coef"] * F.sin(F.lit(2 * math.pi) * c["harmonic"] / fit["period"] * t),
    )
