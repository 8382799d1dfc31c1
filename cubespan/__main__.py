"""python -m cubespan trend|harmonic|breaks FILE, or stack with a catalogue or item files."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cubespan")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("trend", "harmonic", "breaks"):
        q = sub.add_parser(name)
        q.add_argument("input")
        if name != "harmonic":
            q.add_argument("--alpha", type=float, default=0.05)
        if name != "trend":
            q.add_argument("--period", type=float, default=1.0)
            q.add_argument("--harmonics", type=int, default=2 if name == "harmonic" else 0)
        if name == "breaks":
            q.add_argument("--min-segment", type=int, default=12)
    listed = lambda kind: lambda text: [kind(x) for x in text.split(",")]
    q = sub.add_parser("stack", help="scenes of a catalogue, or of ITEMS (item collections in JSON), to maps")
    q.add_argument("--catalog", default="pc", help="pc, es or the URL of an API")
    q.add_argument("--collection", default="sentinel-2-l2a")
    q.add_argument("--datetime", help="a range of dates; needed for a search")
    q.add_argument("--items", help="item collections instead of a search")
    q.add_argument("--pixels", help="a folder with Parquet tables grids and pixels instead of the items' files")
    q.add_argument("--assets", type=listed(str), default=["B04"], metavar="A,B")
    q.add_argument("--bbox", type=listed(float), metavar="WEST,SOUTH,EAST,NORTH")
    q.add_argument("--max-cloud", type=float)
    q.add_argument("--limit", type=int, default=100)
    q.add_argument("--overview", type=int)
    q.add_argument("--scale", type=float, default=1.0)
    q.add_argument("--offset", type=float, default=0.0)
    q.add_argument("--no-cross-zone", action="store_true")
    q.add_argument("--composite", choices=("same-time", "monthly"))
    q.add_argument("--composite-method", default="median", choices=("median", "mean", "min", "max"))
    q.add_argument("--gapfill", type=float)
    q.add_argument("--band")
    q.add_argument("--stat", choices=("theil-sen", "ols"), default="theil-sen")
    q.add_argument("--output", help="GeoTIFF of slopes")
    q.add_argument("--pvalue-output")
    q.add_argument("--breaks-output", help="GeoTIFF of the number of breaks")
    q.add_argument("--first-break-output")
    q.add_argument("--break-harmonics", type=int, default=1)
    q.add_argument("--break-alpha", type=float, default=0.05)
    q.add_argument("--tables", help="a folder for the maps as Parquet")
    return p


def stack_command(a: argparse.Namespace) -> dict:
    from pyspark.sql import SparkSession

    from cubespan.errors import ConfigError
    from cubespan.operators.scenes import StackConfig
    from cubespan.plans import stack
    from cubespan.sources import stac

    cfg = StackConfig(a.assets, a.bbox, a.datetime, a.limit, a.max_cloud, a.scale, a.offset, not a.no_cross_zone, a.overview)
    cfg.validate()
    if not a.items and not (a.bbox and a.datetime):
        raise ConfigError("a search needs --bbox and --datetime")
    tiffs = {k: v for k, v in (("slope", a.output), ("p_value", a.pvalue_output), ("count", a.breaks_output), ("first_break", a.first_break_output)) if v}
    wanted = lambda *names: bool(a.tables) or any(n in tiffs for n in names)
    maps = stack.Maps(a.composite and a.composite.replace("-", "_"), a.composite_method, a.gapfill, a.band, a.stat.replace("-", "_") if wanted("slope", "p_value") else None, wanted("count", "first_break"), a.break_harmonics, a.break_alpha)
    spark = SparkSession.builder.appName("cubespan").getOrCreate()
    items = stac.read_items(spark, a.items) if a.items else stac.search(spark, a.catalog, a.collection, a.bbox, a.datetime, a.limit)
    if a.pixels:
        return stack.run(items, spark.read.parquet(f"{a.pixels}/grids"), spark.read.parquet(f"{a.pixels}/pixels"), cfg, maps, a.tables, tiffs=tiffs)[0]
    sign = stac.signed if a.catalog == "pc" and not a.items else None
    return stack.from_catalog(items, cfg, maps, tiffs, a.tables, sign=sign)[0]


def main(argv: list[str] | None = None) -> int:
    from cubespan.plans import reports
    from cubespan.sources import series

    a = parser().parse_args(argv)
    if a.command == "stack":
        out = stack_command(a)
    else:
        with open(a.input) as f:
            t, v = series.parse_series(f.read())
        if a.command == "trend":
            out = reports.trend(a.input, t, v, a.alpha)
        elif a.command == "harmonic":
            out = reports.harmonic(a.input, t, v, a.period, a.harmonics)
        else:
            out = reports.breaks(a.input, t, v, a.alpha, a.harmonics, a.period, a.min_segment)
    print(series.report(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
