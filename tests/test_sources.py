"""Files in, files out, stacks and the command line."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubespan import errors
from cubespan.__main__ import main
from cubespan.operators import scenes
from cubespan.plans import queries, stack, studies
from cubespan.sources import geotiff, series, stac


def test_parse_series():
    assert series.parse_series("1\n2\n\n3") == ([0, 1, 2], [1, 2, 3])
    t, v = series.parse_series("t,v\n0, 1.5\n1,NA\n2,oops\n3,inf\n")
    assert t == [0, 1, 2, 3] and v[0] == 1.5 and math.isnan(v[1]) and math.isnan(v[2]) and v[3] == math.inf
    assert series.parse_series("NA\n5")[1] == [5]
    assert math.isnan(series.parse_series("\nvalue\n5")[1][0])
    for text, message in (("1,2,3", "3 columns in line 1"), ("0,1\nx,2", "time 'x' in line 2"), ("", "no line of data"), ("head", "no line of data")):
        with pytest.raises(ValueError, match=message):
            series.parse_series(text)


@pytest.mark.parametrize("text", ["1\n2\n\n3", "t,v\n0, 1.5\n1,NA\n2,oops\n3,inf\n", "NA\n5", "\nvalue\n5", "1e3\n-.5\n1_0\n1d\n", "\t0\t,\u00a01.5 \r\n\t1 ,\tNA\t\r\n", "1\n2\x0c\n3\u2028\n4"])
def test_csv_on_spark_agrees(spark, tmp_path, text):
    (tmp_path / "a.csv").write_text(text)
    t, v = series.parse_series(text)
    got = sorted((r.ti, r.t, r.v) for r in series.read_series_csv(spark, f"file://{tmp_path}/a.csv").collect())
    assert [g[1] for g in got] == t and all(a == b or (a is None and math.isnan(b)) for (_, _, a), b in zip(got, v))


@pytest.mark.parametrize(("text", "message"), [("1,2,3", "3 columns in line 1"), ("0,1\nx,2", "time 'x' in line 2"), ("\n \n", "no line of data"), ("head", "no line of data")])
def test_bad_csv_on_spark(spark, tmp_path, text, message):
    (tmp_path / "a.csv").write_text(text)
    with pytest.raises(Exception, match=message):
        series.read_series_csv(spark, f"file://{tmp_path}/a.csv").collect()


def test_json_series_and_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"t": [0, 1, 2], "y": [1.5, null, 3]}')
    assert [(r.ti, r.t, r.v) for r in series.read_series_json(spark, f"file://{tmp_path}/a.json").orderBy("ti").collect()] == [(0, 0, 1.5), (1, 1, None), (2, 2, 3)]
    assert json.loads(series.report({"a": math.nan, "b": [math.inf, 1.0]})) == {"a": None, "b": [None, 1.0]}
    assert json.loads(spark.range(1).select(series.report_column("id").alias("j")).first().j) == {"id": 0}


def test_command_line(tmp_path, capsys):
    f = tmp_path / "s.csv"
    f.write_text("\n".join(f"{k / 12},{1 + 0.1 * k + (3 if k > 30 else 0) + 0.1 * math.sin(k * 7)}" for k in range(60)))
    for command, keys in ((["trend"], {"ols", "theil_sen", "mann_kendall"}), (["harmonic", "--harmonics", "1"], {"components", "period", "rmse"}), (["breaks", "--alpha", "0.1"], {"breaks", "statistic", "alpha"})):
        assert main([command[0], str(f), *command[1:]]) == 0
        assert keys <= set(json.loads(capsys.readouterr().out))


@pytest.mark.parametrize("kind", ["uint8", "int16", "float32", "float64"])
def test_geotiff_reader(kind):
    import struct
    import zlib

    data = (np.arange(35).reshape(5, 7) * 3 % 100).astype(kind)
    code, bits = {"u": 1, "i": 2, "f": 3}[np.dtype(kind).kind], np.dtype(kind).itemsize * 8
    blocks = []
    for y in (0, 4):
        for x in (0, 4):
            tile = np.zeros((4, 4), kind)
            part = data[y : y + 4, x : x + 4]
            tile[: part.shape[0], : part.shape[1]] = part
            if code != 3:
                tile[:, 1:] = np.diff(tile, axis=1)
            blocks.append(zlib.compress(tile.tobytes()))
    at, offsets = 8, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    more = at
    body = b"".join(blocks) + struct.pack("<4I", *offsets) + struct.pack("<4I", *map(len, blocks))
    tags = [(256, 4, 1, 7), (257, 4, 1, 5), (258, 3, 1, bits), (259, 3, 1, 8), (277, 3, 1, 1), (317, 3, 1, 2 if code != 3 else 1), (322, 3, 1, 4), (323, 3, 1, 4), (324, 4, 4, more), (325, 4, 4, more + 16), (339, 3, 1, code)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    raw = b"II*\0" + struct.pack("<I", 8 + len(body)) + body + ifd
    assert (geotiff.read(raw).data == data).all()


def test_geotiff_round_trip(spark, tmp_path):
    data = np.array([[1.5, np.nan, 3], [4, 5, 6]])
    raw = geotiff.write(geotiff.Raster(data, 500000.0, 10.0, 7e6, -10.0, 32719))
    back = geotiff.read(raw)
    assert np.array_equal(back.data, data.astype("f4"), equal_nan=True) and (back.x0, back.dx, back.y0, back.dy, back.epsg) == (500000, 10, 7e6, -10, 32719)
    (tmp_path / "a.tif").write_bytes(raw)
    got = geotiff.read_pixels(spark, f"file://{tmp_path}/a.tif")
    assert sorted((r.row, r.col, r.v) for r in got.where("v IS NOT NULL").collect()) == [(0, 0, 1.5), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, 6)]
    assert geotiff.read_grids(spark, f"file://{tmp_path}/a.tif").first()[1:8] == (500000, 10, 7e6, -10, 2, 3, 32719)
    grid = got.select(F.col("row").alias("y"), F.col("col").alias("x"), "v")
    assert np.array_equal(geotiff.map_raster(grid, "v", (2, 3)).data, data, equal_nan=True)
    geotiff.write_map(grid, "v", f"file://{tmp_path}/m", {"epsg": 1})
    assert spark.read.parquet(f"file://{tmp_path}/m/map").count() == 6 and json.loads(spark.read.text(f"file://{tmp_path}/m/grid").first()[0]) == {"epsg": 1}
    with pytest.raises(ValueError, match="no TIFF"):
        geotiff.read(b"nothing")


FEATURE = {"id": "a", "collection": "c", "properties": {"datetime": "2024-01-01T00:00:00Z", "eo:cloud_cover": 5.0, "proj:code": "EPSG:32719"}, "assets": {"red": {"href": "u"}}}


def test_stac(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"type": "FeatureCollection", "features": [FEATURE, {"id": "b", "properties": {"proj:epsg": 32718}, "assets": {}}]}))
    got = {r.item_id: r for r in stac.read_items(spark, f"file://{tmp_path}/i.json").collect()}
    assert (got["a"].epsg, got["a"].cloud_cover, got["a"].assets) == (32719, 5.0, {"red": "u"}) and got["b"].epsg == 32718 and got["b"].datetime is None
    asked = []

    def fetch(url, body):
        asked.append((url, body))
        return {"features": [FEATURE] * 2, "links": [{"rel": "next", "href": "http://x/2", "method": "POST", "body": {"token": 2}}]}

    df = stac.search(spark, "http://x", "c", [0, 0, 1, 1], "2024", max_items=3, fetch=fetch)
    assert df.count() == 3 and asked[0][0] == "http://x/search" and asked[1][1]["token"] == 2


def scene(spark, epsg=(32719, 32719), cloud=(1.0, 1.0), dates=("2024-01-01", "2024-02-01"), x0=(500000.0, 500000.0)):
    ids = ["s0", "s1"]
    items = spark.createDataFrame(list(zip(ids, dates, cloud, epsg)), "item_id string, datetime string, cloud_cover double, epsg int")
    grids = spark.createDataFrame([(i, "b", x, 10.0, 7e6, -10.0, 4, 4, None, 0.0) for i, x in zip(ids, x0)], "item_id string, asset string, x0 double, dx double, y0 double, dy double, ny int, nx int, epsg int, nodata double")
    pixels = spark.createDataFrame([(i, "b", r, c, float(10 * r + c + k)) for k, i in enumerate(ids) for r in range(4) for c in range(4)], "item_id string, asset string, row int, col int, dn double")
    return items, grids, pixels


def test_stack(spark):
    s = scenes.stack(*scene(spark), scenes.StackConfig(["b"], scale=2.0, offset=1.0))
    got = {(r.ti, r.y, r.x): r.v for r in s.cube.long.collect()}
    assert len(got) == 32 and got[0, 0, 0] is None and got[0, 1, 2] == 25 and got[1, 0, 0] == 3 and s.epsg == 32719 and s.transform == (500000, 10, 7e6, -10)
    shifted = scenes.stack(*scene(spark, x0=(500000.0, 500010.0)), scenes.StackConfig(["b"]))
    got = {(r.ti, r.y, r.x): r.v for r in shifted.cube.long.collect()}
    assert got[1, 1, 0] is None and got[1, 1, 1] == 11
    cloudy = scenes.stack(*scene(spark, cloud=(None, 80.0)), scenes.StackConfig(["b"], max_cloud_cover=20))
    assert [tuple(r) for r in cloudy.skipped.collect()] == [("s1", "cloud cover 80% > 20%")] and cloudy.slices.count() == 1
    odd = scenes.stack(*scene(spark, dates=("2024-01-01", "soon")), scenes.StackConfig(["b"]))
    assert [r.reason for r in odd.skipped.collect()] == ["datetime 'soon' can't be read"]
    off = scenes.stack(*scene(spark, epsg=(32719, 32718)), scenes.StackConfig(["b"], cross_zone_mosaic=False))
    assert "zones aren't joined" in off.skipped.first().reason
    other = scenes.stack(*scene(spark, epsg=(32719, 4326)), scenes.StackConfig(["b"]))
    assert "not UTM" in other.skipped.first().reason
    with pytest.raises(errors.EmptyStack, match="no datetime given"):
        scenes.stack(*scene(spark, dates=(None, None)), scenes.StackConfig(["b"]))
    for cfg in (scenes.StackConfig([]), scenes.StackConfig(["b"], bbox=[1, 0, 0, 1]), scenes.StackConfig(["b"], datetime=" ")):
        with pytest.raises(errors.ConfigError):
            cfg.validate()
    with pytest.raises(errors.EmptyStack, match="asset 'x' is missing"):
        scenes.stack(*scene(spark), scenes.StackConfig(["x"]))


def test_stack_of_a_box(spark):
    from cubespan.functions import utm

    corners = spark.createDataFrame([(500010.5, 6999989.5, 32719), (500029.5, 6999970.5, 32719)], "x double, y double, zone int")
    a, b = utm.backward(corners, "x", "y", "zone").orderBy("x").collect()
    s = scenes.stack(*scene(spark), scenes.StackConfig(["b"], bbox=[a.lon, b.lat, b.lon, a.lat]))
    assert s.transform == (500010, 10, 6999990, -10) and s.shape == (2, 2)
    got = {(r.ti, r.y, r.x): r.v for r in s.cube.long.collect()}
    assert got == {(k, y, x): 10.0 * (y + 1) + x + 1 + k for k in range(2) for y in range(2) for x in range(2)}
    with pytest.raises(errors.EmptyStack):
        scenes.stack(*scene(spark), scenes.StackConfig(["b"], bbox=[0, 0, 1, 1]))
    plain = scene(spark, epsg=(None, None))
    degrees = scenes.stack(*plain, scenes.StackConfig(["b"], bbox=[500000, 6999960, 500020, 7000000]))
    assert degrees.shape == (4, 2)


def test_stack_across_zones(spark):
    """A scene of the next zone is a linear field of its own coordinates, so bilinear samples are exact."""
    from cubespan.functions import utm

    place = utm.reproject(spark.createDataFrame([(800000.0, 6200000.0, 32718, 32719)], "x double, y double, a int, b int"), "x", "y", "a", "b").first()
    items = spark.createDataFrame([("r", "2024-01-01", None, 32718), ("o", "2024-02-01", None, 32719)], "item_id string, datetime string, cloud_cover double, epsg int")
    x0, y0 = math.floor(place.x) - 200.0, math.floor(place.y) + 200.0
    grids = spark.createDataFrame([("r", "b", 800000.0, 10.0, 6200000.0, -10.0, 2, 2, None, None), ("o", "b", x0, 10.0, y0, -10.0, 40, 40, None, None)], "item_id string, asset string, x0 double, dx double, y0 double, dy double, ny int, nx int, epsg int, nodata double")
    rows = [("r", "b", r, c, 1.0) for r in range(2) for c in range(2)] + [("o", "b", r, c, x0 + 10 * c + 5 + 3 * (y0 - 10 * r - 5)) for r in range(40) for c in range(40)]
    s = scenes.stack(items, grids, spark.createDataFrame(rows, "item_id string, asset string, row int, col int, dn double"), scenes.StackConfig(["b"]))
    got = {(r.y, r.x): r.v for r in s.cube.long.where("ti = 1").collect()}
    centre = utm.reproject(spark.createDataFrame([(800005.0, 6199995.0, 32718, 32719)], "x double, y double, a int, b int"), "x", "y", "a", "b").first()
    assert got[0, 0] == pytest.approx(centre.x + 3 * centre.y, abs=1e-2) and s.slices.count() == 2


def test_stack_plan(spark, tmp_path):
    report, maps = stack.run(*scene(spark), scenes.StackConfig(["b"]), stack.Maps(composite="monthly", gapfill=0, trend="ols", breaks=True), f"file://{tmp_path}/o")
    assert report["dims"] == {"bands": 1, "height": 4, "width": 4, "times": 2} and len(report["scenes"]) == 2 and len(report["maps_written"]) == 4
    assert set(maps) == {"slope", "p_value", "count", "first_break"} and spark.read.parquet(f"file://{tmp_path}/o/slope/map").count() == 16


def test_recovery(spark):
    r = studies.recovery(spark, 30, sigmas=(0.02,), steps=(0.3,)).first()
    assert abs(r.bias) < 0.01 and r.rmse < 0.01 and r.power > 0.8 and r.false_alarms < 0.2 and r.detections > 0.8


def test_recovery_by_gaps_and_its_registered_grid(spark, monkeypatch):
    few, many = studies.recovery(spark, 30, sigmas=(0.05,), steps=(0.3,), gaps=(0.1, 0.4)).orderBy("gap").collect()
    assert (few.gap, many.gap) == (0.1, 0.4) and few.rmse < many.rmse and few.detections >= many.detections
    asked = {}
    monkeypatch.setattr(studies, "recovery", lambda spark, **grid: asked.update(grid))
    queries.monte_carlo(spark, "")
    assert asked["repetitions"] == 300 and {0.02, 0.05, 0.14} <= set(asked["sigmas"]) and len(asked["sigmas"]) == 8
    assert list(asked["steps"]) == pytest.approx([0.1 + 0.05 * k for k in range(9)]) and tuple(asked["gaps"]) == (0.1, 0.4)


def lzw_coded(data):
    """The TIFF variant of LZW, highest bit first."""
    words, out, width, w = {bytes([k]): k for k in range(256)}, [(256, 9)], 9, b""
    n = 258
    for k in range(len(data)):
        c = data[k : k + 1]
        if w + c in words:
            w += c
            continue
        out.append((words[w], width))
        words[w + c] = n
        n += 1
        width = max(width, (n).bit_length())
        if n == 4094:
            out.append((256, width))
            words, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        w = c
    out += [(words[w], width)] if w else []
    out.append((257, max(9, min(12, (n + 1).bit_length())) if w else width))
    bits = "".join(f"{c:0{b}b}" for c, b in out)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaaaaaaa", bytes(range(256)) * 40, bytes((k * k) % 251 for k in range(9000))])
def test_lzw(data):
    assert geotiff.lzw(lzw_coded(data)) == data


def test_predictors_and_big_tiff():
    import struct
    import zlib

    data = np.linspace(-5, 9, 35).reshape(5, 7).astype("f4")
    planes = data.astype(">f4").view(np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    block = zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((5, 1), np.uint8)).astype(np.uint8).tobytes())
    tags = [(256, 4, 7), (257, 4, 5), (258, 3, 32), (259, 3, 8), (273, 16, 16), (277, 3, 1), (278, 4, 5), (279, 16, len(block)), (317, 3, 3), (339, 3, 3)]
    ifd = struct.pack("<Q", len(tags)) + b"".join(struct.pack("<HHQQ", tag, kind, 1, x) for tag, kind, x in tags) + struct.pack("<Q", 0)
    raw = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16 + len(block)) + block + ifd
    assert (geotiff.read(raw).data == data).all()
    asked = []
    r = geotiff.read_window(lambda at, size: asked.append((at, size)) or raw[at : at + size], None, (1, 3, 2, 6))
    assert (r.data == data[1:3, 2:6]).all() and (r.x0, r.y0) == (2, -1)


def test_windows_take_few_blocks():
    data = np.arange(4000 * 50, dtype="f4").reshape(4000, 50)
    raw, asked = geotiff.write(geotiff.Raster(data, 0.0, 1.0, 0.0, -1.0)), []
    r = geotiff.read_window(geotiff.buffered(lambda at, size: asked.append(size) or raw[at : at + size]), None, (1000, 1010, 5, 9))
    assert (r.data == data[1000:1010, 5:9]).all() and sum(asked) < len(raw) / 3


def test_stack_from_files(spark, tmp_path, capsys):
    """Items in JSON, GeoTIFFs in windows, a broken file and clouds skipped, maps as GeoTIFFs."""
    from cubespan.functions import utm

    features = []
    for k in range(16):
        data = np.add.outer(np.arange(6), np.arange(8)) * 1.0 + k * (1 + (k > 7))
        (tmp_path / f"s{k}.tif").write_bytes(geotiff.write(geotiff.Raster(data, 500000.0, 10.0, 7e6, -10.0, 32719)) if k != 5 else b"II broken")
        features.append({"id": f"s{k:02d}", "collection": "c", "properties": {"datetime": f"20{20 + k // 12}-{k % 12 + 1:02d}-15T00:00:00Z", "eo:cloud_cover": 90.0 if k == 6 else 1.0}, "assets": {"b": {"href": f"{tmp_path}/s{k}.tif"}, "other": {"href": "nowhere"}}})
    features[9]["assets"]["b"]["href"] = f"{tmp_path}/none.tif"
    (tmp_path / "items.json").write_text(json.dumps({"features": features}))
    corners = spark.createDataFrame([(500010.5, 6999989.5, 32719), (500049.5, 6999970.5, 32719)], "x double, y double, zone int")
    a, b = utm.backward(corners, "x", "y", "zone").orderBy("x").collect()
    outputs = {k: str(tmp_path / f"{k}.tif") for k in ("output", "pvalue-output", "breaks-output", "first-break-output")}
    assert main(["stack", "--items", f"file://{tmp_path}/items.json", "--assets", "b", f"--bbox={a.lon},{b.lat},{b.lon},{a.lat}", "--max-cloud", "50", "--break-harmonics", "0", *(f"--{k}={v}" for k, v in outputs.items())]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["dims"] == {"bands": 1, "height": 2, "width": 4, "times": 13} and report["epsg"] == 32719 and len(report["maps_written"]) == 4
    assert [x.split(":")[0] for x in report["skipped"]] == ["s05", "s06", "s09"] and "no TIFF" in report["skipped"][0] and "cloud" in report["skipped"][1]
    slope = geotiff.read((tmp_path / "output.tif").read_bytes())
    assert slope.data.shape == (2, 4) and (slope.x0, slope.y0, slope.epsg) == (500010, 6999990, 32719)
    t = [x["time"] for x in report["scenes"]]
    from cubespan.functions import kernels

    v = [k * (1 + (k > 7)) for k in range(16) if k not in (5, 6, 9)]
    assert slope.data == pytest.approx(kernels.theil_sen(t, v).slope, rel=1e-5)
    counts = geotiff.read((tmp_path / "breaks-output.tif").read_bytes()).data
    assert (counts == len(kernels.detect_breaks(np.array(t), np.array(v, float)).breaks)).all()
    with pytest.raises(errors.ConfigError):
        main(["stack", "--assets", "b"])


def test_empty_search_is_an_error(spark):
    with pytest.raises(errors.EmptyStack, match="nothing of c"):
        stac.search(spark, "http://x", "c", [0, 0, 1, 1], "2024", fetch=lambda url, body: {"features": []})
    assert stac.signed("http://a/b?c", fetch=lambda url, body: {"href": url}) == "https://planetarycomputer.microsoft.com/api/sas/v1/sign?href=http%3A%2F%2Fa%2Fb%3Fc"
