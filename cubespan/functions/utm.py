"""Universal Transverse Mercator as column expressions, by Krüger's series to the fourth order of the third flattening."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS 84 and UTM.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Coefficients of Krüger's series (Karney 2011, equations 35 and 36).
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACKWARD = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)


def is_utm(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def _meridian(epsg: Column) -> Column:
    return F.radians(((epsg % 100) * 6 - 183).cast("double"))


def _northing0(epsg: Column) -> Column:
    return F.when(epsg >= 32700, F.lit(FALSE_NORTHING)).otherwise(F.lit(0.0))


def forward(df: DataFrame, lon: str, lat: str, epsg: str, x: str = "x", y: str = "y") -> DataFrame:
    """df with easting and northing, x and y, of degrees in a UTM zone. Steps are columns of their own, so nothing is computed twice."""
    lam, s = F.radians(lon) - _meridian(F.col(epsg)), F.sin(F.radians(lat))
    df = df.withColumns({"__cl": F.cos(lam), "__sl": F.sin(lam), "__tau": F.sinh(F.atanh(s) - _E * F.atanh(_E * s))})
    df = df.withColumns({"__xi": F.atan2(F.col("__tau"), F.col("__cl")), "__eta": F.asinh(F.col("__sl") / F.sqrt(F.col("__tau") * F.col("__tau") + F.col("__cl") * F.col("__cl")))})
    xi, eta = F.col("__xi"), F.col("__eta")
    e, n = eta, xi
    for j, a in enumerate(_FORWARD, 1):
        e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return df.withColumns({x: FALSE_EASTING + SCALE * _RADIUS * e, y: _northing0(F.col(epsg)) + SCALE * _RADIUS * n}).drop("__cl", "__sl", "__tau", "__xi", "__eta")


def backward(df: DataFrame, x: str, y: str, epsg: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with longitude and latitude in degrees of a place in a UTM zone."""
    df = df.withColumns({"__eta": (F.col(x) - FALSE_EASTING) / (SCALE * _RADIUS), "__xi": (F.col(y) - _northing0(F.col(epsg))) / (SCALE * _RADIUS)})
    xi, eta = F.col("__xi"), F.col("__eta")
    e, k = eta, xi
    for j, b in enumerate(_BACKWARD, 1):
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        k = k - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    df = df.withColumns({"__e": e, "__k": k})
    df = df.withColumn("__c", F.atanh(F.sin("__k") / F.cosh("__e"))).withColumn("__s", F.tanh("__c"))
    # The conformal latitude is undone by fixed-point steps, each of which gains more than two digits.
    for _ in range(6):
        df = df.withColumn("__s", F.tanh(F.col("__c") + _E * F.atanh(_E * F.col("__s"))))
    out = {lon: F.degrees(_meridian(F.col(epsg)) + F.atan2(F.sinh("__e"), F.cos("__k"))), lat: F.degrees(F.asin("__s"))}
    return df.withColumns(out).drop("__eta", "__xi", "__e", "__k", "__c", "__s")


def reproject(df: DataFrame, x: str, y: str, source: str, target: str) -> DataFrame:
    """df with x and y, places of one zone, in another."""
    return forward(backward(df, x, y, source, "__lon", "__lat"), "__lon", "__lat", target, x, y).drop("__lon", "__lat")
