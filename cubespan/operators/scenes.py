"""Stacks: scenes with grids of their own become one cube on a reference grid.

items: item_id, datetime (ISO text), cloud_cover, epsg. grids: a row for each item and asset with x0, dx, y0,
dy (outer corner and step), ny, nx, epsg, nodata. pixels: item_id, asset, row, col, dn.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespan.errors import ConfigError, EmptyStack
from cubespan.functions import columns as C
from cubespan.functions import utm
from cubespan.operators.cube import TCube


@dataclass(frozen=True)
class StackConfig:
    assets: Sequence[str]
    bbox: Sequence[float] | None = None
    datetime: str | None = None
    max_items: int = 100
    max_cloud_cover: float | None = None
    scale: float = 1.0
    offset: float = 0.0
    cross_zone_mosaic: bool = True
    overview: int | None = None

    def validate(self) -> None:
        if not self.assets:
            raise ConfigError("at least one asset is needed")
        if self.bbox is not None and not (len(self.bbox) == 4 and self.bbox[0] < self.bbox[2] and self.bbox[1] < self.bbox[3]):
            raise ConfigError("the box has to be west, south, east, north")
        if self.datetime is not None and not self.datetime.strip():
            raise ConfigError("datetime is empty")


@dataclass(frozen=True)
class StackedCube:
    """slices: ti, item_id, datetime, t, cloud_cover; skipped: item_id, reason; transform: x0, dx, y0, dy; shape: rows and columns."""

    cube: TCube
    slices: DataFrame
    skipped: DataFrame
    transform: tuple[float, float, float, float]
    epsg: int | None
    shape: tuple[int, int] = field(default=(0, 0))


def judged(items: DataFrame, grids: DataFrame, cfg: StackConfig, failed: DataFrame | None = None) -> DataFrame:
    """The first max_items items in the order of their datetime texts, with t, scene_epsg and reason: null if the item can be used whatever the reference. failed: item_id, error of scenes that couldn't be read."""
    first = items.orderBy(F.col("datetime").asc_nulls_first(), "item_id").limit(cfg.max_items)
    have = grids.where(F.col("asset").isin(*cfg.assets)).groupBy("item_id").agg(F.collect_set("asset").alias("have"), F.min("epsg").alias("grid_epsg"))
    own = first.join(have, "item_id", "left").withColumn("t", C.fractional_year_iso(F.col("datetime")))
    if failed is None:
        own = own.withColumn("__error", F.lit(None).cast("string"))
    else:
        own = own.join(failed.groupBy("item_id").agg(F.min("error").alias("__error")), "item_id", "left")
    lacking = F.array_except(F.array(*map(F.lit, cfg.assets)), F.coalesce("have", F.array().cast("array<string>")))
    reason = F.when(F.col("datetime").isNull(), "no datetime given").when(F.col("t").isNull(), F.concat(F.lit("datetime '"), "datetime", F.lit("' can't be read")))
    if cfg.max_cloud_cover is not None:
        cc = F.col("cloud_cover")
        reason = reason.when(F.coalesce(cc, F.lit(0.0)) > cfg.max_cloud_cover, F.concat(F.lit("cloud cover "), F.round(cc).cast("int"), F.lit(f"% > {cfg.max_cloud_cover:.0f}%")))
    reason = reason.when(F.col("__error").isNotNull(), F.col("__error")).when(F.size(lacking) > 0, F.concat(F.lit("asset '"), F.get(lacking, 0), F.lit("' is missing")))
    return own.withColumn("reason", reason).drop("__error").withColumn("scene_epsg", F.coalesce("epsg", "grid_epsg"))


def windows(items: DataFrame, grids: DataFrame, bbox: Sequence[float]) -> DataFrame:
    """grids with r0, r1, c0 and c1, the whole pixels of each that a box in degrees covers.

    The box is brought to an item's coordinate system, else to its grid's; without either, or in degrees, it is
    taken as it is. Grids in other systems than UTM stay whole; grids that the box doesn't meet go.
    """
    w, s, e, n = map(float, bbox)
    edge = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x in (w, (w + e) / 2, e) for y in (s, (s + n) / 2, n)))
    crs = F.coalesce("item_epsg", "epsg")
    own = grids.join(items.select("item_id", F.col("epsg").alias("item_epsg")), "item_id", "left").withColumn("crs", crs)
    at = own.select("item_id", "asset", "crs", F.when(utm.is_utm(F.col("crs")), F.col("crs")).alias("zone"), F.explode(edge).alias("p")).select("*", "p.lon", "p.lat")
    at = utm.forward(at, "lon", "lat", "zone", "px", "py")
    degrees = F.col("crs").isNull() | (F.col("crs") == 4326)
    at = at.withColumns({"px": F.when(degrees, F.col("lon")).otherwise(F.col("px")), "py": F.when(degrees, F.col("lat")).otherwise(F.col("py"))})
    box = at.groupBy("item_id", "asset").agg(F.min("px").alias("xa"), F.max("px").alias("xb"), F.min("py").alias("ya"), F.max("py").alias("yb"))
    met = own.join(box, ["item_id", "asset"])

    def span(a: str, b: str, origin: str, step: str, size: str) -> tuple[Column, Column]:
        one, two = ((F.col(c) - F.col(origin)) / F.col(step) for c in (a, b))
        # Places within a millionth of a pixel's edge count as on it.
        lo, hi = F.floor(F.least(one, two) + 1e-6), F.ceil(F.greatest(one, two) - 1e-6)
        return F.coalesce(F.greatest(lo, F.lit(0)), F.lit(0)).cast("int"), F.coalesce(F.least(hi, F.col(size)), F.col(size)).cast("int")

    (c0, c1), (r0, r1) = span("xa", "xb", "x0", "dx", "nx"), span("ya", "yb", "y0", "dy", "ny")
    return met.withColumns({"c0": c0, "c1": c1, "r0": r0, "r1": r1}).where("c1 > c0 AND r1 > r0")


def cropped(met: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The grids of windows()."""
    cut = {"x0": F.col("x0") + F.col("c0") * F.col("dx"), "y0": F.col("y0") + F.col("r0") * F.col("dy"), "nx": F.col("c1") - F.col("c0"), "ny": F.col("r1") - F.col("r0")}
    return met.withColumns(cut).select(*columns)


def clip(items: DataFrame, grids: DataFrame, pixels: DataFrame, bbox: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """grids and pixels of the part that a box covers."""
    met = windows(items, grids, bbox)
    window = met.select("item_id", "asset", "c0", "c1", "r0", "r1")
    inside = pixels.join(window, ["item_id", "asset"]).where("row >= r0 AND row < r1 AND col >= c0 AND col < c1")
    moved = inside.withColumns({"row": (F.col("row") - F.col("r0")).cast("int"), "col": (F.col("col") - F.col("c0")).cast("int")})
    return cropped(met, grids.columns), moved.select(*pixels.columns)


def stack(items: DataFrame, grids: DataFrame, pixels: DataFrame, cfg: StackConfig, failed: DataFrame | None = None) -> StackedCube:
    """The cube of all usable items. The first usable one in time gives the grid, by its first asset, and the coordinate system.

    Pixels are taken by nearest neighbour. A scene of another UTM zone is sampled bilinearly at the places
    of the reference pixels; other coordinate systems are skipped. Items and grids are small
    tables (a row a scene); with a box only its part of every scene is used; pixels are joined once, on item, asset, row and column.
    """
    cfg.validate()
    if cfg.bbox is not None:
        grids, pixels = clip(items, grids, pixels, cfg.bbox)
    every = judged(items, grids, cfg, failed).cache()
    assets = [a for a in cfg.assets]
    lead = every.where("reason IS NULL").join(grids.where(F.col("asset") == assets[0]).drop("epsg"), "item_id").orderBy("datetime", "item_id").first()
    if lead is None:
        raise EmptyStack("no scene could be read: " + "; ".join(f"{r.item_id}: {r.reason}" for r in every.select("item_id", "reason").collect()))
    known = F.lit(lead.epsg).cast("int")
    if cfg.cross_zone_mosaic:
        differ = (F.col("scene_epsg") != known) & ~(utm.is_utm(F.col("scene_epsg")) & utm.is_utm(known))
        why = F.concat(F.lit("EPSG "), "scene_epsg", F.lit(f" -> {lead.epsg} (not UTM)"))
    else:
        differ = F.col("epsg") != known
        why = F.concat(F.lit("EPSG "), "epsg", F.lit(f" isn't that of the reference, {lead.epsg}, and zones aren't joined"))
    every = every.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(differ, why))
    slices = every.where("reason IS NULL").withColumn("ti", F.row_number().over(Window.orderBy("datetime", "item_id")) - 1)
    slices = slices.select("ti", "item_id", "datetime", "t", "cloud_cover", "scene_epsg")

    scenes = slices.join(grids.where(F.col("asset").isin(*assets)).drop("epsg"), "item_id")
    cells = grids.sparkSession.range(lead.ny * lead.nx).select(F.floor(F.col("id") / lead.nx).cast("int").alias("y"), (F.col("id") % lead.nx).cast("int").alias("x"))
    # The product of reference pixels and scenes is the cube itself: every place of it is a row.
    wanted = cells.join(F.broadcast(scenes))
    wanted = wanted.withColumns({"px": F.lit(lead.x0) + (F.col("x") + 0.5) * F.lit(lead.dx), "py": F.lit(lead.y0) + (F.col("y") + 0.5) * F.lit(lead.dy), "from": known})
    other = F.coalesce(F.col("scene_epsg") != known, F.lit(False)) if cfg.cross_zone_mosaic and lead.epsg is not None else F.lit(False)
    wanted = wanted.withColumn("other", other)
    if not slices.where(other).isEmpty():
        moved = utm.reproject(wanted.withColumns({"rx": F.col("px"), "ry": F.col("py")}), "rx", "ry", "from", "scene_epsg")
        wanted = moved.withColumns({"px": F.when(F.col("other"), F.col("rx")).otherwise(F.col("px")), "py": F.when(F.col("other"), F.col("ry")).otherwise(F.col("py"))})
    u, v = (F.col("px") - F.col("x0")) / F.col("dx"), (F.col("py") - F.col("y0")) / F.col("dy")
    wanted = wanted.select("ti", "t", "item_id", "asset", "y", "x", "nodata", "other", u.alias("u"), v.alias("v"))
    left, top = F.col("u") - 0.5, F.col("v") - 0.5
    fu, fv = left - F.floor(left), top - F.floor(top)
    corner = lambda dv, du, w: F.struct((F.floor(top) + dv).cast("int").alias("row"), (F.floor(left) + du).cast("int").alias("col"), w.cast("double").alias("w"))
    near = F.array(F.struct(F.floor("v").cast("int").alias("row"), F.floor("u").cast("int").alias("col"), F.lit(1.0).alias("w")))
    four = F.array(corner(0, 0, (1 - fu) * (1 - fv)), corner(0, 1, fu * (1 - fv)), corner(1, 0, (1 - fu) * fv), corner(1, 1, fu * fv))
    sampled = wanted.select("ti", "t", "item_id", "asset", "y", "x", "nodata", F.explode(F.when(F.col("other"), four).otherwise(near)).alias("s"))
    sampled = sampled.select("ti", "t", "item_id", "asset", "y", "x", "nodata", F.col("s.row").alias("row"), F.col("s.col").alias("col"), F.col("s.w").alias("w"))
    joined = sampled.join(pixels.select("item_id", "asset", "row", "col", F.col("dn").cast("double").alias("dn")), ["item_id", "asset", "row", "col"], "left")
    value = C.rescale(C.finite(C.nodata_to_null(F.col("dn"), F.col("nodata"))), cfg.scale, cfg.offset)
    # A corner that is missing makes the place missing, unless it has no weight.
    part = F.when(F.col("w") > 0, F.coalesce(value * F.col("w"), F.lit(float("nan")))).otherwise(0.0)
    cube_rows = joined.groupBy(F.col("asset").alias("band"), "y", "x", "ti", "t").agg(F.sum(part).alias("v"))
    cube = TCube.from_long(cube_rows, bands=assets, slices=slices.select("ti", "t"))
    skipped = every.where("reason IS NOT NULL").select("item_id", "reason")
    return StackedCube(cube, slices.drop("scene_epsg"), skipped, (lead.x0, lead.dx, lead.y0, lead.dy), lead.epsg if lead.epsg is not None else lead.scene_epsg, (lead.ny, lead.nx))
