"""The CUSUM of residuals of a straight line, by window functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubespan.functions import columns as C


def cusum_path(long: DataFrame, keys: Sequence[str], origin: float = 0.0) -> DataFrame:
    """keys, t, ti, k (0 for the first finite observation), n, w: the scaled cumulative sum of residuals."""
    keys = list(keys)
    own = long.select(*keys, C.finite(F.col("t")).alias("t"), "ti", C.finite(F.col("v")).alias("v")).where("t IS NOT NULL AND v IS NOT NULL")
    fit = own.groupBy(*keys).agg(F.regr_slope("v", F.col("t") - origin).alias("b"), F.regr_intercept("v", F.col("t") - origin).alias("a"), F.count("v").alias("n"))
    order = Window.partitionBy(*keys).orderBy("t", "ti")
    upto, all_ = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    rest = own.join(fit, keys).withColumn("e", F.col("v") - F.col("a") - F.col("b") * (F.col("t") - origin))
    rest = rest.withColumn("sse", F.sum(F.col("e") * F.col("e")).over(all_)).withColumn("sum", F.sum("e").over(upto)).withColumn("k", F.row_number().over(order) - 1)
    w = F.when(F.col("sse") > 0, F.col("sum") / (F.sqrt(F.col("sse") / (F.col("n") - 2)) * F.sqrt(F.col("n").cast("double")))).otherwise(0.0)
    return rest.where("n > 2").select(*keys, "t", "ti", "k", "n", w.alias("w"))


def cusum_statistic(long: DataFrame, keys: Sequence[str], origin: float = 0.0, min_segment: int = 12) -> DataFrame:
    """keys, n, statistic, p_value and the place a first break would have: k and t where w is largest with min_segment observations on both sides, the first on ties."""
    keys = list(keys)
    path = cusum_path(long, keys, origin)
    inner = (F.col("k") >= min_segment - 1) & (F.col("k") <= F.col("n") - min_segment - 1)
    best = lambda c: F.max_by(F.when(inner, F.col(c)), F.when(inner, F.struct(F.abs("w"), -F.col("k"))))
    out = path.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.abs("w")).alias("statistic"), best("k").alias("split_index"), best("t").alias("split_time"))
    return out.where(F.col("n") >= min_segment).select(*keys, "n", "statistic", C.bridge_p_value(F.col("statistic")).alias("p_value"), "split_index", "split_time")


