"""Analyses made of several operators: breaks and what happened around them, area means, recovery of known signals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespan.functions import kernels
from cubespan.operators.cube import TCube


def first_breaks(cube: TCube, band: int | str = 0, least: int = 20, n_harmonics: int = 0, alpha: float = 0.05) -> DataFrame:
    """keys, first_break of series with least observations or more that have a break."""
    packed = cube.pack(band).where(F.size("vs") >= least)
    from cubespan.functions import registry

    return packed.select(*cube.keys, registry.break_map(alpha, n_harmonics)("ts", "vs").alias("m")).select(*cube.keys, "m.first_break").where("first_break IS NOT NULL")


def drop_magnitude(cube: TCube, breaks: DataFrame, width: float, band: int | str = 0) -> DataFrame:
    """keys, first_break, magnitude: the mean in (break, break + width] less the mean in (break - width, break]."""
    own = cube.where_band(band).join(breaks, list(cube.keys))
    t, b = F.col("t"), F.col("first_break")
    after = F.avg(F.when((t > b) & (t <= b + width), F.col("v")))
    before = F.avg(F.when((t > b - width) & (t <= b), F.col("v")))
    return own.groupBy(*cube.keys, "first_break").agg((after - before).alias("magnitude"))


def post_event_slope(cube: TCube, breaks: DataFrame, wait: float, least: int, band: int | str = 0) -> DataFrame:
    """keys, slope: Theil-Sen from wait after the break on, of series with least observations or more there."""
    from cubespan.functions import registry

    late = cube.where_band(band).join(breaks, list(cube.keys)).where(F.col("t") > F.col("first_break") + wait)
    packed = TCube(late.select(*cube.keys, "band", "ti", "t", "v"), cube.slices, cube.bands, cube.keys).pack(band).where(F.size("vs") >= least)
    return packed.select(*cube.keys, registry.theil_sen()("ts", "vs")["slope"].alias("slope"))


def summary(cube: TCube, breaks: DataFrame, width: float, window: tuple[float, float], band: int | str = 0) -> DataFrame:
    """One row: pixels, broken, median_time, in_window (share of breaks in the window), median_drop."""
    pixels = cube.where_band(band).agg(F.count_distinct(*cube.keys).alias("pixels"))
    drop = drop_magnitude(cube, breaks, width, band)
    found = drop.agg(F.count(F.lit(1)).alias("broken"), F.median("first_break").alias("median_time"), F.avg(F.col("first_break").between(*window).cast("double")).alias("in_window"), F.median("magnitude").alias("median_drop"))
    return pixels.crossJoin(found)


def extremes(cube: TCube, breaks: DataFrame, width: float, band: int | str = 0) -> DataFrame:
    """One row: the key with the strongest drop, and the one with the highest mean among those without a break. For cubes with one key."""
    (key,) = cube.keys
    drop = drop_magnitude(cube, breaks, width, band).agg(F.min_by(key, F.struct("magnitude", key)).alias("strongest"))
    calm = cube.where_band(band).join(breaks, [key], "left_anti").groupBy(key).agg(F.avg("v").alias("a"))
    return drop.crossJoin(calm.agg(F.max_by(key, F.struct(F.col("a"), -F.col(key))).alias("healthiest")))


def area_mean(cube: TCube, band: int | str = 0) -> DataFrame:
    """t, mean, n over all series."""
    return cube.where_band(band).groupBy("t").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def pre_post(cube: TCube, event: float, band: int | str = 0) -> DataFrame:
    """One row: the means of the area means before an event, and from it on."""
    a = area_mean(cube, band)
    return a.agg(F.avg(F.when(F.col("t") < event, F.col("mean"))).alias("before"), F.avg(F.when(F.col("t") >= event, F.col("mean"))).alias("after"))


def recovery(spark: SparkSession, repetitions: int = 300, sigmas: Sequence[float] = (0.02, 0.05, 0.08, 0.14), steps: Sequence[float] = (0.1, 0.25, 0.3), seed: int = 1, gaps: Sequence[float] = (0.1,)) -> DataFrame:
    """sigma, step, gap and, over seeded repetitions: bias and error of the slope, power of the trend test, false alarms, detections and the median error of the break's time.

    A series has 72 months, a slope of 0.02 a year, an annual cycle of 0.2, a share of gaps and, for the break, a step down after three years.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, sigma, step, share in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = np.random.default_rng([seed, i])
                t = np.arange(72) / 12.0
                noise = r.normal(0, sigma, 72)
                gap = r.random(72) < share
                slow = np.where(gap, np.nan, 0.02 * t + noise)
                calm = np.where(gap, np.nan, 0.2 * np.cos(2 * np.pi * t) + noise)
                broken = np.where(gap, np.nan, calm - step * (t >= 3))
                alarm = kernels.detect_breaks(t, calm, n_harmonics=1).breaks
                hit = kernels.detect_breaks(t, broken, n_harmonics=1).breaks
                near = min((abs(x.time - 3) for x in hit), default=None)
                out.append((sigma, step, share, kernels.theil_sen(t, slow).slope - 0.02, kernels.mann_kendall(slow).p_value < 0.05, bool(alarm), near is not None and near < 0.5, near))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k < 7 else pa.array(c, pa.float64()) for k, c in enumerate(zip(*out, strict=True))], names=["sigma", "step", "gap", "off", "found", "alarm", "hit", "near"])

    grid = spark.range(repetitions).crossJoin(F.broadcast(spark.createDataFrame([(float(s), float(d), float(g)) for s in sigmas for d in steps for g in gaps], "sigma double, step double, gap double")))
    runs = grid.repartition(8).mapInArrow(run, "sigma double, step double, gap double, off double, found boolean, alarm boolean, hit boolean, near double")
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return runs.groupBy("sigma", "step", "gap").agg(F.avg("off").alias("bias"), F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("rmse"), rate("found").alias("power"), rate("alarm").alias("false_alarms"), rate("hit").alias("detections"), F.median("near").alias("time_error"))
