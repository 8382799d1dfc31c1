"""Period composites of a stream of observations.

A batch cube's bins begin at its first slice; a stream doesn't know it, so the origin is given. The time of a
composite is the mean of the times that were observed. Median is exact only over whole series, so streams
have mean, minimum and maximum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespan.errors import InvalidParameter
from cubespan.functions import columns as C

REDUCERS = {"mean": F.avg, "min": F.min, "max": F.max}


def composite(stream: DataFrame, keys: Sequence[str], period: str, method: str = "mean", timestamp: str = "ts", value: str = "v", late: str = "1 day", start: str = "0 seconds") -> DataFrame:
    """keys, begin, t, v: a row for each series and window of the length period once it is older than late.

    stream: keys, timestamp and value. Works on batch DataFrames, too.
    """
    if method not in REDUCERS:
        raise InvalidParameter(f"a stream has no {method!r} composite")
    own = stream.withColumns({"__v": C.finite(F.col(value)), "__t": C.fractional_year(F.col(timestamp))})
    if stream.isStreaming:
        own = own.withWatermark(timestamp, late)
    out = own.groupBy(*keys, F.window(timestamp, period, startTime=start)).agg(F.avg("__t").alias("t"), REDUCERS[method]("__v").alias("v"))
    return out.select(*keys, F.col("window.start").alias("begin"), "t", "v")
