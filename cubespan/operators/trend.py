"""Trends of many series. long: keys, ti, t, v; packed: keys, ts, vs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubespan.functions import columns as C


def ols(long: DataFrame, keys: Sequence[str], origin: float = 0.0) -> DataFrame:
    """keys and slope, intercept, r_squared, std_err, p_value, n, by built-in aggregates alone.

    origin is taken from the times while sums are made and put back into the intercept: with years as times
    2000 or so keeps digits. Series with fewer than three observations or equal times give null.
    """
    keys = list(keys)
    t, v = C.finite(F.col("t")) - F.lit(float(origin)), C.finite(F.col("v"))
    own = long.select(*keys, t.alias("__t"), v.alias("__v"))
    both = F.col("__t").isNotNull() & F.col("__v").isNotNull()
    a = own.groupBy(*keys).agg(
        F.count(F.when(both, 1)).alias("n"),
        F.regr_slope("__v", "__t").alias("b"),
        F.regr_intercept("__v", "__t").alias("a"),
        F.regr_sxx("__v", "__t").alias("xx"),
        F.regr_sxy("__v", "__t").alias("xy"),
        F.regr_syy("__v", "__t").alias("yy"),
    )
    usable = (F.col("n") >= 3) & (F.col("xx") > 0)
    rest = F.greatest(F.lit(0.0), F.col("yy") - F.col("b") * F.col("xy"))
    err = F.sqrt(rest / (F.col("n") - 2) / F.col("xx"))
    p = F.when(F.col("std_err") > 0, C.student_t_two_sided(F.col("slope") / F.col("std_err"), F.col("n") - 2)).when(F.col("slope") == 0, 1.0).otherwise(F.when(F.col("slope").isNotNull(), 0.0))
    fit = a.select(
        *keys,
        F.when(usable, F.col("b")).alias("slope"),
        F.when(usable, F.col("a") - F.col("b") * F.lit(float(origin))).alias("intercept"),
        F.when(usable, F.when(F.col("yy") > 0, 1 - rest / F.col("yy")).otherwise(1.0)).alias("r_squared"),
        F.when(usable, err).alias("std_err"),
        "n",
    )
    return fit.select(*keys, "slope", "intercept", "r_squared", "std_err", p.alias("p_value"), "n")


def pairs(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, t1, v1, t2, v2: every pair of observations of a series in the order (t, ti), as a join on the key with a condition on the place.

    It makes n(n-1)/2 rows of a series with n: for short series and for SQL; the packed functions need no such table.
    """
    keys = list(keys)
    own = long.select(*keys, "t", "ti", C.finite(F.col("v")).alias("v")).where("v IS NOT NULL")
    own = own.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("t", "ti")))
    a = own.select(*keys, F.col("t").alias("t1"), F.col("v").alias("v1"), F.col("pos").alias("p1"))
    b = own.select(*keys, F.col("t").alias("t2"), F.col("v").alias("v2"), F.col("pos").alias("p2"))
    return a.join(b, keys).where("p1 < p2").drop("p1", "p2")


def theil_sen_sql(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, slope, intercept, n without Python, from pairs()."""
    keys = list(keys)
    usable = long.withColumn("v", C.finite(F.col("v"))).withColumn("t", C.finite(F.col("t"))).where("v IS NOT NULL AND t IS NOT NULL")
    slopes = pairs(usable, keys).where("t1 <> t2").groupBy(*keys).agg(F.median((F.col("v2") - F.col("v1")) / (F.col("t2") - F.col("t1"))).alias("slope"))
    middles = usable.groupBy(*keys).agg(F.median("v").alias("mv"), F.median("t").alias("mt"), F.count("v").alias("n"))
    return slopes.join(middles, keys).select(*keys, "slope", (F.col("mv") - F.col("slope") * F.col("mt")).alias("intercept"), "n")


def mann_kendall_sql(long: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """keys, s, var_s, z, tau, p_value, trend, n without Python: pairs() for s, two aggregations for the ties."""
    keys = list(keys)
    own = long.select(*keys, "t", "ti", C.finite(F.col("v")).alias("v")).where("v IS NOT NULL")
    s = pairs(own, keys).groupBy(*keys).agg(F.sum(F.signum(F.col("v2") - F.col("v1"))).alias("s"))
    g = F.col("g").cast("double")
    ties = own.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("g")).groupBy(*keys).agg(F.sum("g").alias("n"), F.sum(g * (g - 1) * (2 * g + 5)).alias("tied"))
    n = F.col("n").cast("double")
    var = (n * (n - 1) * (2 * n + 5) - F.col("tied")) / 18.0
    out = ties.where("n >= 3").join(s, keys).select(*keys, "s", var.alias("var_s"), "n")
    z = F.when((F.col("s") != 0) & (F.col("var_s") > 0), (F.col("s") - F.signum("s")) / F.sqrt("var_s")).otherwise(0.0)
    out = out.withColumn("z", z).withColumn("tau", F.col("s") / (n * (n - 1) / 2)).withColumn("p_value", C.normal_two_sided(F.col("z")))
    return out.select(*keys, "s", "var_s", "z", "tau", "p_value", C.trend_label(F.col("p_value"), F.col("z"), alpha).alias("trend"), "n")
