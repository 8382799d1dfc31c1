"""Rasters of a catalogue's items: headers first, then the window that a box covers, read in ranges of bytes.

A file that can't be opened or decoded gives a row with an error instead of failing the job; its scene is skipped.
"""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespan.operators import scenes
from cubespan.sources import geotiff
from cubespan.sources.folders import new_path

GRIDS = "item_id string, asset string, href string, x0 double, dx double, y0 double, dy double, ny int, nx int, epsg int, nodata double, error string"
PIXELS = "item_id string, asset string, row int, col int, dn double, error string"
_GRID = ["item_id", "asset", "x0", "dx", "y0", "dy", "ny", "nx", "epsg", "nodata"]


def open_href(href: str) -> geotiff.Reader:
    """Ranges of a file: a path, file: or http(s):."""
    if href.startswith(("http://", "https://")):

        def read_at(at: int, size: int) -> bytes:
            request = urllib.request.Request(href, headers={"Range": f"bytes={at}-{at + size - 1}"})
            with urllib.request.urlopen(request, timeout=60) as r:
                # A server without ranges sends all of it.
                return r.read() if r.status == 206 else r.read()[at : at + size]

        return read_at
    path = urllib.request.url2pathname(href.removeprefix("file:").replace("///", "/", 1)) if href.startswith("file:") else href

    def read_file(at: int, size: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(at)
            return f.read(size)

    return read_file


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def load(items: DataFrame, cfg: scenes.StackConfig, open_: Callable[[str], geotiff.Reader] = open_href, sign: Callable[[str], str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grids, pixels, failed) of the items' assets as stack() takes them, only the part that the box covers.

    items: those of a catalogue. Scenes that dates or clouds rule out aren't read. Headers and pixels are written
    to the shared folder, a task for each file, so nothing is fetched twice and a lost executor costs its files.
    """
    overview, assets = cfg.overview, list(cfg.assets)
    named = items.select("item_id", F.explode(F.map_keys("assets")).alias("asset"), F.lit(None).cast("int").alias("epsg"))
    usable = scenes.judged(items, named, cfg).where("reason IS NULL")
    files = items.join(usable.select("item_id"), "item_id", "left_semi").select("item_id", F.explode("assets").alias("asset", "href")).where(F.col("asset").isin(*assets) & F.col("href").isNotNull())
    tasks = max(1, cfg.max_items * len(assets))

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, asset, href in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    where = sign(href) if sign else href
                    _, tags, r = geotiff.header(geotiff.buffered(open_(where)), overview)
                    rows.append((item, asset, where, r.x0, r.dx, r.y0, r.dy, tags[geotiff.HEIGHT][0], tags[geotiff.WIDTH][0], r.epsg, r.nodata, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((item, asset, href, *[None] * 8, _said(e)))
            if rows:
                yield _batch(GRIDS, rows)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIXELS.split(", ")]
        for b in batches:
            for item, asset, href, *window in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    r = geotiff.read_window(geotiff.buffered(open_(href)), overview, tuple(window))
                except Exception as e:  # noqa: BLE001
                    yield _batch(PIXELS, [(item, asset, None, None, None, _said(e))])
                    continue
                for row, col, part in geotiff.cells(r.data.astype(np.float64)):
                    told = [pa.DictionaryArray.from_arrays(np.zeros(len(part), np.int32), [x]).dictionary_decode() for x in (item, asset)]
                    yield pa.RecordBatch.from_arrays([*told, row, col, pa.array(part, from_pandas=True), pa.nulls(len(part), pa.string())], names=names)

    def kept(df: DataFrame, what: str) -> DataFrame:
        path = new_path(df.sparkSession, what)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    found = kept(files.repartition(tasks, "item_id", "asset").mapInArrow(headers, GRIDS), "headers")
    grids = found.where("error IS NULL").drop("error")
    if cfg.bbox is None:
        met = grids.withColumns({"r0": F.lit(0), "r1": F.col("ny"), "c0": F.lit(0), "c1": F.col("nx")})
    else:
        met = scenes.windows(items, grids, cfg.bbox)
    read = kept(met.select("item_id", "asset", "href", "r0", "r1", "c0", "c1").repartition(tasks, "item_id", "asset").mapInArrow(windows, PIXELS), "pixels")
    failed = found.where("error IS NOT NULL").select("item_id", "error").unionByName(read.where("error IS NOT NULL").select("item_id", "error"))
    return scenes.cropped(met, _GRID), read.where("error IS NULL").drop("error"), failed
