"""The temporal cube: observations of many series on one time axis.

long holds the observations: the keys of a series (y and x by default), band, ti (number of the time slice), t and v. slices
is the time axis (ti, t), bands the band names in order. Missing is null; NaN and infinite values become null
when a cube is made. Series need not have a row for every slice: densify() adds the missing ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from cubespan.errors import BandOutOfRange, DimensionMismatch, InvalidChunkSize, InvalidParameter
from cubespan.functions import columns as C
from cubespan.functions import registry
from cubespan.operators import breaks, trend
from cubespan.operators.packed import AXIS_BOUND, PackedCube

METHODS: dict[str, Callable[[Column], Column]] = {"median": F.median, "mean": F.avg, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class TCube:
    long: DataFrame
    slices: DataFrame
    bands: tuple[str, ...]
    keys: tuple[str, ...] = ("y", "x")

    # Making one

    @classmethod
    def from_long(cls, df: DataFrame, bands: Sequence[str] | None = None, slices: DataFrame | None = None, keys: Sequence[str] = ("y", "x")) -> TCube:
        """df: keys, t, v and, if there are several, band and ti. Without ti the slices are the distinct times."""
        own = df if "band" in df.columns else df.withColumn("band", F.lit((bands or ["value"])[0]))
        own = own.withColumn("t", C.finite(F.col("t"))).withColumn("v", C.finite(F.col("v"))).where("t IS NOT NULL")
        if "ti" not in own.columns:
            # One time a slice; the number is the time itself in the order of doubles, so no global numbering is needed.
            own = own.withColumn("ti", F.lit(0))
        names = tuple(bands) if bands is not None else tuple(r[0] for r in own.select("band").distinct().orderBy("band").collect())
        axis = slices if slices is not None else own.select("ti", "t").distinct()
        return cls(own.select(*keys, "band", "ti", "t", "v"), axis, names, tuple(keys))

    @classmethod
    def from_packed(cls, df: DataFrame, bands: Sequence[str] | None = None, keys: Sequence[str] = ("y", "x")) -> TCube:
        """df: keys, band, ts, vs. Arrays of different lengths, or times that descend, fail when the cube is read."""
        def checked(condition: Column, message: str, then: Column) -> Column:
            return F.when(condition, then).otherwise(F.raise_error(F.lit(message)).cast("array<struct<ts:double,vs:double>>"))

        ascend = F.forall(F.sequence(F.lit(1), F.greatest(F.size("ts"), F.lit(1))), lambda i: (i >= F.size("ts")) | (F.get("ts", i - 1) <= F.get("ts", i)))
        zipped = F.arrays_zip("ts", "vs").cast("array<struct<ts:double,vs:double>>")
        both = checked(F.size("ts") == F.size("vs"), "times and values differ in number", checked(ascend, "times must ascend", zipped))
        return cls.from_long(df.select(*keys, *(["band"] if "band" in df.columns else []), F.posexplode(both).alias("ti", "p")).select("*", F.col("p.ts").alias("t"), F.col("p.vs").alias("v")).drop("p"), bands, keys=keys)

    @classmethod
    def from_numpy(cls, spark: SparkSession, data: np.ndarray, time: np.ndarray, bands: Sequence[str]) -> TCube:
        """data: (band, y, x, time)."""
        data, time = np.asarray(data, np.float64), np.asarray(time, np.float64)
        if data.ndim != 4 or data.shape[0] != len(bands) or data.shape[3] != len(time):
            raise DimensionMismatch(f"data {data.shape} for {len(bands)} bands and {len(time)} times")
        b, y, x, k = (i.ravel() for i in np.indices(data.shape))
        flat = pa.table({"band": pa.array(np.asarray(bands, object)[b], pa.string()), "y": pa.array(y.astype(np.int32)), "x": pa.array(x.astype(np.int32)), "ti": pa.array(k.astype(np.int32)), "t": time[k], "v": pa.array(data.ravel(), from_pandas=True)})
        axis = spark.createDataFrame([(i, float(t)) for i, t in enumerate(time)], "ti int, t double")
        if not flat.num_rows:
            return cls.from_long(spark.createDataFrame([], "band string, y int, x int, ti int, t double, v double"), bands, axis)
        return cls.from_long(spark.createDataFrame(flat), bands, axis)

    # Looking at it

    @property
    def dims(self) -> tuple[int, ...]:
        """Bands, extent of each key (largest + 1), slices."""
        top = self.long.agg(*(F.max(k) for k in self.keys)).first()
        return (len(self.bands), *(int(m) + 1 if m is not None else 0 for m in top), self.slices.count())

    @property
    def time(self) -> list[float]:
        """The axis, on the driver."""
        return [r.t for r in self.slices.orderBy("t", "ti").collect()]

    def to_numpy(self) -> np.ndarray:
        """(band, y, x, time) with NaN for missing, on the driver."""
        axis = pa.Table.from_pylist([{"ti": r.ti, "t": r.t, "k": k} for k, r in enumerate(self.slices.orderBy("t", "ti").collect())], pa.schema([("ti", pa.int64()), ("t", pa.float64()), ("k", pa.int64())]))
        out = np.full((*self.dims[:-1], axis.num_rows), np.nan)
        band = F.element_at(F.create_map(*(x for k, b in enumerate(self.bands) for x in (F.lit(b), F.lit(k)))), F.col("band"))
        got = self.long.where("v IS NOT NULL").select(band.alias("b"), *(F.col(k).cast("long").alias(f"k{i}") for i, k in enumerate(self.keys)), F.col("ti").cast("long").alias("ti"), "t", "v").toArrow()
        got = got.join(axis, ["ti", "t"], join_type="inner")
        out[tuple(got[c].to_numpy() for c in ("b", *(f"k{i}" for i in range(len(self.keys))), "k"))] = got["v"].to_numpy()
        return out

    def band_name(self, band: int | str) -> str:
        if isinstance(band, str) and band in self.bands:
            return band
        if isinstance(band, int) and not isinstance(band, bool) and 0 <= band < len(self.bands):
            return self.bands[band]
        raise BandOutOfRange(band, len(self.bands))

    def where_band(self, band: int | str) -> DataFrame:
        return self.long.where(F.col("band") == self.band_name(band))

    def series(self, band: int | str, *key: int) -> DataFrame:
        """(ti, t, v) of one series in order."""
        own = self.where_band(band)
        for name, k in zip(self.keys, key, strict=True):
            own = own.where(F.col(name) == k)
        return own.select("ti", "t", "v").orderBy("t", "ti")

    def where_time(self, condition: Column | str) -> TCube:
        """The part of the cube whose slices meet a condition on ti and t."""
        return replace(self, long=self.long.where(condition), slices=self.slices.where(condition))

    def with_values(self, v: Column) -> TCube:
        """The cube with other values, an expression over the columns of long."""
        return replace(self, long=self.long.withColumn("v", C.finite(v)))

    def iter_series(self, band: int | str):
        """Rows (keys, ts, vs) in the order of the keys, streamed to the driver."""
        return self.pack(band).orderBy(*self.keys).toLocalIterator()

    def axis(self) -> list | None:
        """The rows (ti, t) of the slices, or None where there are more than the driver should hold."""
        found = self.slices.select("ti", "t").limit(AXIS_BOUND + 1).collect()
        return found if len(found) <= AXIS_BOUND else None

    def dense(self) -> PackedCube:
        """The cube with one row a series, for axes of bounded length."""
        axis = self.axis()
        if axis is None:
            raise InvalidParameter(f"the axis has more than {AXIS_BOUND} slices")
        return PackedCube.from_cube(self, axis)

    def densify(self) -> TCube:
        """A row for every series and slice; what was missing is null. One shuffle on the keys for an axis of bounded length."""
        axis = self.axis()
        if axis is not None:
            full = PackedCube.from_cube(self, axis).to_cube()
            number = self.long.schema["ti"].dataType
            return replace(self, long=full.long.withColumn("ti", F.col("ti").cast(number)))
        pixels = self.long.select(*self.keys, "band").distinct()
        full = pixels.join(self.slices.select("ti", "t").hint("shuffle_replicate_nl"))
        have = self.long.select(*self.keys, "band", "ti", F.col("t"), "v")
        return replace(self, long=full.join(have, [*self.keys, "band", "ti", "t"], "left"))

    # Series as arrays

    def pack(self, band: int | str) -> DataFrame:
        """keys, ts, vs: finite observations in the order (t, ti); series without one have empty arrays. One shuffle on the keys."""
        own = self.where_band(band)
        item = F.when(F.col("v").isNotNull(), F.struct("t", "ti", "v"))
        p = own.groupBy(*self.keys).agg(F.array_sort(F.collect_list(item)).alias("p"))
        return p.select(*self.keys, F.col("p.t").alias("ts"), F.col("p.v").alias("vs"))

    def map_series(self, band: int | str, kernel: Callable[[np.ndarray, np.ndarray], object], returns: str, name: str = "value") -> DataFrame:
        """keys and what kernel(t, v) gives for each series; an estimator's data error gives null."""
        return self.pack(band).select(*self.keys, registry.over_series(kernel, returns)("ts", "vs").alias(name))

    def _estimate(self, band: int | str, f) -> DataFrame:
        return self.pack(band).select(*self.keys, f("ts", "vs").alias("__r")).select(*self.keys, "__r.*")

    def linear_trend(self, band: int | str = 0, origin: float = 0.0) -> DataFrame:
        return trend.ols(self.where_band(band), self.keys, origin)

    def theil_sen(self, band: int | str = 0, method: str = "packed") -> DataFrame:
        """method sql joins pairs instead of running Python."""
        if method == "sql":
            return trend.theil_sen_sql(self.where_band(band), self.keys)
        return self._estimate(band, registry.theil_sen())

    def mann_kendall(self, band: int | str = 0, alpha: float = 0.05, method: str = "packed") -> DataFrame:
        if method == "sql":
            return trend.mann_kendall_sql(self.where_band(band), self.keys, alpha)
        return self._estimate(band, registry.mann_kendall(alpha))

    def harmonic(self, band: int | str = 0, period: float = 1.0, n_harmonics: int = 2) -> DataFrame:
        return self._estimate(band, registry.harmonic_regression(period, n_harmonics))

    def breaks(self, band: int | str = 0, alpha: float = 0.05, n_harmonics: int = 0, period: float = 1.0, min_segment: int = 12) -> DataFrame:
        return self._estimate(band, registry.detect_breaks(alpha, n_harmonics, period, min_segment))

    def cusum(self, band: int | str = 0, origin: float = 0.0, min_segment: int = 12) -> DataFrame:
        return breaks.cusum_statistic(self.where_band(band), self.keys, origin, min_segment)

    def trend_map(self, band: int | str = 0, method: str = "theil_sen", origin: float = 0.0) -> DataFrame:
        """keys, slope, p_value. theil_sen: its slope with the p-value of Mann-Kendall, each null by itself; ols: both of the regression."""
        if method == "ols":
            return self.linear_trend(band, origin).select(*self.keys, "slope", "p_value")
        if method != "theil_sen":
            raise ValueError(f"unknown method {method!r}")
        return self._estimate(band, registry.trend_map())

    def break_map(self, band: int | str = 0, n_harmonics: int = 0, alpha: float = 0.05, period: float = 1.0) -> DataFrame:
        """keys, count, first_break."""
        return self._estimate(band, registry.break_map(alpha, n_harmonics, period))

    # Tiles

    def tiles(self, *size: int) -> DataFrame:
        """long with the first key values of the tile that a row lies in (y0, x0); tiles at the edge are smaller."""
        if len(size) != len(self.keys) or any(s < 1 for s in size):
            raise InvalidChunkSize(f"tiles of {size}")
        return self.long.withColumns({f"{k}0": (F.floor(F.col(k) / s) * s).cast(self.long.schema[k].dataType) for k, s in zip(self.keys, size, strict=True)})

    def map_tiles(self, size: Sequence[int], f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
        """f for the rows of each tile, all bands and times."""
        return self.tiles(*size).groupBy(*(f"{k}0" for k in self.keys)).applyInArrow(f, schema)

    # Time

    def composite(self, window: str | float = "monthly", method: str = "median", dense: bool = False) -> TCube:
        """Slices that belong together become one.

        window: same_time (equal times), monthly (a twelfth), period:<width>, or a width. Groups and their times
        come from the axis, not from a series: the time is the mean of the member slices' times, and bins begin at
        the first slice. Bins without slices don't exist. dense: a series without observations in a group has a
        null there; else it has no row.
        """
        if method not in METHODS:
            raise KeyError(f"bad method {method!r}")
        width = window_width(window)
        if width is None:
            group, axis = F.col("t"), self.slices
        else:
            # The axis is made once: it gives the first bin as well as the times of all.
            axis = self.slices.persist(StorageLevel.MEMORY_AND_DISK)
            first = axis.agg(F.min("t")).first()[0]
            group = F.floor((F.col("t") - F.lit(0.0 if first is None else first)) / F.lit(width)).cast("long")
        groups = axis.withColumn("g", group).groupBy("g").agg(F.avg("t").alias("t"), F.min("ti").alias("__ti"))
        number = F.col("__ti") if width is None else F.col("g")
        reduced = self.long.withColumn("g", group).groupBy(*self.keys, "band", "g").agg(METHODS[method](F.col("v")).alias("v"))
        if width is None:
            # Equal times: a group's time is its own.
            out = reduced.join(groups.drop("t"), "g").select(*self.keys, "band", number.alias("ti"), F.col("g").alias("t"), "v")
        else:
            small = groups.limit(AXIS_BOUND + 1).count() <= AXIS_BOUND
            out = reduced.join(F.broadcast(groups) if small else groups.hint("merge"), "g").select(*self.keys, "band", number.alias("ti"), "t", "v")
        cube = replace(self, long=out, slices=groups.select(number.alias("ti"), "t"))
        return cube.densify() if dense else cube

    def gapfill(self, max_gap: float | None = None) -> TCube:
        """Nulls between two observations whose times differ by max_gap at most are interpolated in time; edges stay. Slices without a row stay so: densify() first."""
        own = Window.partitionBy(*self.keys, "band")
        at = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
        # Both frames grow from the start of their order, so each is one pass; a frame that shrinks would be summed anew for every row.
        before = F.last(at, ignorenulls=True).over(own.orderBy("t", "ti").rowsBetween(Window.unboundedPreceding, 0))
        after = F.last(at, ignorenulls=True).over(own.orderBy(F.desc("t"), F.desc("ti")).rowsBetween(Window.unboundedPreceding, 0))
        own = self.long.withColumns({"__a": before, "__b": after})
        width = F.col("__b.t") - F.col("__a.t")
        fill = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col("t") - F.col("__a.t")) / width
        use = (width > 0) & (F.lit(True) if max_gap is None else width <= F.lit(float(max_gap)))
        return replace(self, long=own.withColumn("v", F.when(F.col("v").isNotNull(), F.col("v")).when(use, fill)).drop("__a", "__b"))

    def band_math(self, name: str, f: Callable[..., Column], *bands: str) -> TCube:
        """A cube with one band: f of the values of others, where they are on the same slice."""
        own = self.long.where(F.col("band").isin(*map(self.band_name, bands)))
        pick = [F.max(F.when(F.col("band") == b, F.col("v"))).alias(f"__{i}") for i, b in enumerate(bands)]
        wide = own.groupBy(*self.keys, "ti", "t").agg(*pick)
        v = C.finite(f(*(F.col(f"__{i}") for i in range(len(bands)))))
        return replace(self, long=wide.select(*self.keys, F.lit(name).alias("band"), "ti", "t", v.alias("v")), bands=(name,))


def window_width(window: str | float) -> float | None:
    """The width of a composite's bins, or None for slices of equal times."""
    if window == "same_time":
        return None
    if window == "monthly":
        return 1 / 12
    try:
        width = float(window.removeprefix("period:")) if isinstance(window, str) and window.startswith("period:") else float(window)
    except ValueError:
        raise ValueError(f"bad window {window!r}") from None
    if not math.isfinite(width) or width <= 0:
        raise InvalidParameter(f"a period must be finite and positive, not {width}")
    return width
