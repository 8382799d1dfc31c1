"""A dense cube: one row a series, its values as one array on the cube's axis.

The axis lies on the driver (it has a bound, AXIS_BOUND slices); values are arrays of its length with null for
missing. Composites, gap filling and maps then need no shuffle: they are numpy over Arrow batches of many series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespan.errors import BandOutOfRange
from cubespan.functions import registry

if TYPE_CHECKING:
    from cubespan.operators.cube import TCube

#: Slices that an axis on the driver may have.
AXIS_BOUND = 1 << 17


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of one length as rows, missing as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    if len(flat) != len(column) * width:
        raise ValueError(f"series that don't have {width} slices")
    return flat.reshape(len(column), width)


def lists(rows: np.ndarray) -> pa.Array:
    """Rows as a list column, NaN as null."""
    flat = np.ascontiguousarray(rows).reshape(-1)
    values = pa.array(flat, mask=~np.isfinite(flat))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), values)


def over_rows(f: Callable[[np.ndarray], np.ndarray], width: int):
    """An Arrow function of a list column from a function of a matrix of series."""

    @F.arrow_udf(returnType="array<double>")
    def run(values: pa.Array) -> pa.Array:
        return lists(f(matrix(values, width)))

    return run


def reduce_groups(v: np.ndarray, groups: list[np.ndarray], method: str) -> np.ndarray:
    """A column for each group of columns; NaN doesn't count. Groups of one size are done together."""
    out = np.full((len(v), len(groups)), np.nan)
    sizes = np.array([len(g) for g in groups])
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        own = v[:, np.concatenate([groups[k] for k in at])].reshape(len(v), len(at), n)
        count = np.isfinite(own).sum(axis=2)
        if method == "mean":
            got = np.nansum(own, axis=2) / np.maximum(count, 1)
        else:
            # NaN goes to the end.
            own = np.sort(own, axis=2)
            last = np.maximum(count - 1, 0)
            pick = lambda k: np.take_along_axis(own, k[:, :, None], 2)[:, :, 0]  # noqa: E731, B023
            got = pick(np.zeros_like(last)) if method == "min" else pick(last) if method == "max" else (pick(last // 2) + pick(np.maximum(count, 1) // 2)) / 2
            if method == "median" and (last // 2 != np.maximum(count, 1) // 2).any():
                got = np.where(last // 2 == np.maximum(count, 1) // 2, pick(last // 2), got)
        out[:, at] = np.where(count > 0, got, np.nan)
    return out


def fill(v: np.ndarray, t: np.ndarray, max_gap: float | None) -> np.ndarray:
    """Rows with gaps between finite neighbours, whose times differ by max_gap at most, interpolated."""
    m, n = v.shape
    if not n:
        return v
    good, place = np.isfinite(v), np.arange(n)
    before = np.maximum.accumulate(np.where(good, place, -1), axis=1)
    after = np.minimum.accumulate(np.where(good, place, n)[:, ::-1], axis=1)[:, ::-1]
    row, col = np.nonzero(~good & (before >= 0) & (after < n))
    a, z = before[row, col], after[row, col]
    width = t[z] - t[a]
    use = (width > 0) & (True if max_gap is None else width <= max_gap)
    row, col, a, z, width = row[use], col[use], a[use], z[use], width[use]
    out = v.copy()
    out[row, col] = v[row, a] + (v[row, z] - v[row, a]) * (t[col] - t[a]) / width
    return out


@dataclass(frozen=True)
class PackedCube:
    """rows: keys, band, vs. ti and time: the axis, ascending in time."""

    rows: DataFrame
    ti: np.ndarray
    time: np.ndarray
    bands: tuple[str, ...]
    keys: tuple[str, ...]

    @classmethod
    def from_cube(cls, cube: TCube, axis: list) -> PackedCube:
        """axis: the rows (ti, t) of the cube's slices. One shuffle, on the keys."""
        axis = sorted(axis, key=lambda r: (r.t, r.ti))
        ti, time = np.array([r.ti for r in axis], np.int64), np.array([r.t for r in axis], np.float64)
        # A place is told by number and time; lexsort lets a binary search find both.
        order = np.lexsort((time, ti))
        known = np.rec.fromarrays([ti[order], time[order]], names="ti,t")

        @F.arrow_udf(returnType="array<double>")
        def spread(items: pa.Array) -> pa.Array:
            flat = items.flatten()
            owner = np.repeat(np.arange(len(items)), np.diff(items.offsets.to_numpy()))
            wanted = np.rec.fromarrays([flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.float64)], names="ti,t")
            out = np.full((len(items), len(order)), np.nan)
            if len(wanted):
                out[owner, order[np.searchsorted(known, wanted)]] = flat.field(2).to_numpy(zero_copy_only=False).astype(np.float64)
            return lists(out)

        item = F.when(F.col("v").isNotNull(), F.struct(F.col("ti").cast("long").alias("ti"), "t", "v"))
        packed = cube.long.groupBy(*cube.keys, "band").agg(F.collect_list(item).alias("__p"))
        return cls(packed.select(*cube.keys, "band", spread("__p").alias("vs")), ti, time, cube.bands, cube.keys)

    def to_cube(self) -> TCube:
        """The same cube in rows, one for each series and slice."""
        from cubespan.operators.cube import TCube

        spark = self.rows.sparkSession
        slices = spark.createDataFrame(list(zip(self.ti.tolist(), self.time.tolist(), strict=True)), "ti long, t double")
        out = self.rows.select(*self.keys, "band", F.posexplode("vs").alias("__k", "v"))
        at = lambda x: F.get(F.lit(x), F.col("__k"))
        return TCube(out.select(*self.keys, "band", at(self.ti).alias("ti"), at(self.time).alias("t"), "v"), slices, self.bands, self.keys)

    def composite(self, window: str | float = "monthly", method: str = "median") -> PackedCube:
        """Slices that belong together become one; groups and their times come from the axis."""
        from cubespan.operators.cube import METHODS, window_width

        if method not in METHODS:
            raise KeyError(f"bad method {method!r}")
        width = window_width(window)
        if not len(self.time):
            return self
        g = self.time if width is None else np.floor((self.time - self.time[0]) / width)
        values, first = np.unique(g, return_index=True)
        groups = np.split(np.arange(len(g)), first[1:])
        number = np.array([self.ti[k].min() for k in groups]) if width is None else values.astype(np.int64)
        reduced = over_rows(lambda v: reduce_groups(v, groups, method), len(self.time))
        return replace(self, rows=self.rows.withColumn("vs", reduced("vs")), ti=number, time=np.array([self.time[k].mean() for k in groups]))

    def gapfill(self, max_gap: float | None = None) -> PackedCube:
        """Nulls between two observations are interpolated in time; edges stay."""
        t = self.time
        return replace(self, rows=self.rows.withColumn("vs", over_rows(lambda v: fill(v, t, max_gap), len(t))("vs")))

    def _estimate(self, band: int | str, f) -> DataFrame:
        name = self.bands[band] if isinstance(band, int) and not isinstance(band, bool) and 0 <= band < len(self.bands) else band
        if name not in self.bands:
            raise BandOutOfRange(band, len(self.bands))
        own = self.rows.where(F.col("band") == name)
        return own.select(*self.keys, f(F.lit(self.time), F.col("vs")).alias("__r")).select(*self.keys, "__r.*")

    def trend_map(self, band: int | str = 0, method: str = "theil_sen") -> DataFrame:
        """keys, slope, p_value."""
        if method not in ("theil_sen", "ols"):
            raise ValueError(f"unknown method {method!r}")
        return self._estimate(band, registry.trend_map() if method == "theil_sen" else registry.ols_map())

    def break_map(self, band: int | str = 0, n_harmonics: int = 0, alpha: float = 0.05, period: float = 1.0) -> DataFrame:
        """keys, count, first_break."""
        return self._estimate(band, registry.break_map(alpha, n_harmonics, period))
