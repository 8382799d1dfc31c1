"""From scenes to maps: stack, composite, fill gaps, estimate, write."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from cubespan.operators.packed import PackedCube
from cubespan.operators.scenes import StackConfig, StackedCube, stack
from cubespan.sources import geotiff, rasters


@dataclass(frozen=True)
class Maps:
    """gapfill: None for none, zero or less for gaps of any width."""

    composite: str | None = None
    composite_method: str = "median"
    gapfill: float | None = None
    band: str | None = None
    trend: str | None = None
    breaks: bool = False
    break_harmonics: int = 0
    break_alpha: float = 0.05


def run(items: DataFrame, grids: DataFrame, pixels: DataFrame, cfg: StackConfig, maps: Maps, output: str | None = None, failed: DataFrame | None = None, tiffs: Mapping[str, str] | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """A report, and the maps by name (slope, p_value, count, first_break).

    With output all are written below it as Parquet; tiffs gives paths of GeoTIFFs on the driver's machine by name.
    """
    stacked = stack(items, grids, pixels, cfg, failed)
    cube = stacked.cube
    # Scenes are few, so the axis is short: one shuffle makes the cube dense, and all that follows stays in its rows.
    axis = cube.axis()
    dense = PackedCube.from_cube(cube, axis) if axis is not None else None
    if maps.composite:
        if dense:
            dense = dense.composite(maps.composite, maps.composite_method)
        else:
            cube = cube.composite(maps.composite, maps.composite_method, dense=True)
    if maps.gapfill is not None:
        gap = maps.gapfill if maps.gapfill > 0 else None
        dense, cube = (dense.gapfill(gap), cube) if dense else (None, cube.gapfill(gap))
    source, band = dense or cube, maps.band or cfg.assets[0]
    found: dict[str, DataFrame] = {}
    if maps.trend:
        grid = source.trend_map(band, maps.trend)
        found |= {k: grid.select("y", "x", k) for k in ("slope", "p_value")}
    if maps.breaks:
        grid = source.break_map(band, maps.break_harmonics, maps.break_alpha)
        found |= {k: grid.select("y", "x", k) for k in ("count", "first_break")}
    written = []
    x0, dx, y0, dy = stacked.transform
    for name, grid in found.items():
        if output:
            geotiff.write_map(grid, name, f"{output}/{name}", {"x0": x0, "dx": dx, "y0": y0, "dy": dy, "epsg": stacked.epsg, "shape": list(stacked.shape)})
            written.append(f"{output}/{name}")
        if path := (tiffs or {}).get(name):
            geotiff.write_tiff(grid, name, path, stacked.shape, x0=x0, dx=dx, y0=y0, dy=dy, epsg=stacked.epsg)
            written.append(path)
    return summary(stacked, dense.time.tolist() if dense else cube.time, written), found


def from_catalog(items: DataFrame, cfg: StackConfig, maps: Maps, tiffs: Mapping[str, str] | None = None, output: str | None = None, **reading) -> tuple[dict, dict[str, DataFrame]]:
    """run() for a catalogue's items, whose files are read here; reading: open_ and sign of rasters.load()."""
    cfg.validate()
    grids, pixels, failed = rasters.load(items, cfg, **reading)
    # The box has cut the scenes already.
    return run(items, grids, pixels, replace(cfg, bbox=None), maps, output, failed, tiffs)


def summary(stacked: StackedCube, time: list[float], written: list[str]) -> dict:
    bands = stacked.cube.bands
    scenes = [{"id": r.item_id, "datetime": r.datetime, "time": r.t, "cloud_cover": r.cloud_cover} for r in stacked.slices.orderBy("ti").collect()]
    return {
        "scenes": scenes,
        "skipped": [f"{r.item_id}: {r.reason}" for r in stacked.skipped.orderBy("item_id").collect()],
        "dims": {"bands": len(bands), "height": stacked.shape[0], "width": stacked.shape[1], "times": len(time)},
        "bands": list(bands),
        "time_range": [time[0] if time else None, time[-1] if time else None],
        "epsg": stacked.epsg,
        "maps_written": written,
    }
