"""The cube, its operators and its SQL forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubespan import errors
from cubespan.functions import columns as C
from cubespan.functions import kernels, registry, utm
from cubespan.operators.cube import TCube

NAN = math.nan


@pytest.fixture(scope="module")
def ramp(spark):
    """t * (1 + y + x) on 2 by 2 pixels, with one gap and an infinite value."""
    y, x, t = np.indices((2, 2, 6))
    data = (t * (1.0 + y + x))[None]
    data[0, 1, 1, 2], data[0, 0, 1, 3] = NAN, math.inf
    return TCube.from_numpy(spark, data, np.arange(6.0), ["b1"])


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_shape(spark, ramp):
    assert ramp.dims == (1, 2, 2, 6) and ramp.bands == ("b1",) and ramp.time == [0, 1, 2, 3, 4, 5]
    back = ramp.to_numpy()
    assert back.shape == (1, 2, 2, 6) and back[0, 1, 0].tolist() == [0, 2, 4, 6, 8, 10] and np.isnan(back[0, 1, 1, 2]) and np.isnan(back[0, 0, 1, 3])
    assert [(r.ti, r.v) for r in ramp.series(0, 1, 0).collect()] == [(k, 2.0 * k) for k in range(6)]
    assert [(r.y, r.x) for r in ramp.iter_series(0)] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    for band in (1, -1, "no", True):
        with pytest.raises(errors.BandOutOfRange):
            ramp.where_band(band)
    with pytest.raises(errors.DimensionMismatch):
        TCube.from_numpy(spark, np.zeros((1, 2, 2, 3)), np.arange(2), ["b"])


def test_empty_cube(spark):
    cube = TCube.from_numpy(spark, np.zeros((1, 0, 0, 0)), np.zeros(0), ["b"])
    assert cube.dims == (1, 0, 0, 0) and cube.composite("monthly").long.count() == 0 and cube.trend_map().count() == 0


def test_packed(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0], [5.0, NAN])], "y int, x int, ts array<double>, vs array<double>")
    assert rows(TCube.from_packed(df, ["b"]).long, "ti", "t", "v") == [(0, 1.0, 5.0), (1, 2.0, None)]
    for ts, vs in (([1.0], [1.0, 2.0]), ([2.0, 1.0], [1.0, 2.0])):
        bad = spark.createDataFrame([(0, 0, ts, vs)], "y int, x int, ts array<double>, vs array<double>")
        with pytest.raises(Exception, match="times"):
            TCube.from_packed(bad, ["b"]).long.collect()


def test_trends_agree_with_kernels(spark):
    r = np.random.default_rng(3)
    data = np.round(r.normal(0, 1, (1, 3, 3, 40)).cumsum(axis=3), 1)
    data[r.random(data.shape) < 0.2] = NAN
    data[0, 0, 0, 2:], data[0, 0, 1] = NAN, NAN
    t = 2020 + np.arange(40) / 12
    cube = TCube.from_numpy(spark, data, t, ["b"])

    def plain(kernel):
        out = {}
        for y in range(3):
            for x in range(3):
                try:
                    out[y, x] = kernel(t, data[0, y, x])
                except errors.CubeError:
                    out[y, x] = None
        return out

    want = plain(kernels.linear_trend)
    for q in cube.linear_trend(0, origin=2020).collect():
        w = want[q.y, q.x]
        assert (q.slope is None) == (w is None)
        if w:
            assert (q.slope, q.intercept, q.r_squared, q.std_err, q.p_value, q.n) == pytest.approx((w.slope, w.intercept, w.r_squared, w.std_err, w.p_value, w.n), rel=1e-8)
    sen, mk = plain(kernels.theil_sen), plain(lambda t, v: kernels.mann_kendall(v))
    for method in ("packed", "sql"):
        for q in cube.theil_sen(0, method).where("slope IS NOT NULL").collect():
            assert (q.slope, q.intercept, q.n) == pytest.approx((sen[q.y, q.x].slope, sen[q.y, q.x].intercept, sen[q.y, q.x].n))
        for q in cube.mann_kendall(0, 0.05, method).where("s IS NOT NULL").collect():
            w = mk[q.y, q.x]
            assert (q.s, q.var_s, q.z, q.tau, q.p_value, q.n) == pytest.approx((w.s, w.var_s, w.z, w.tau, w.p_value, w.n), abs=1e-12) and q.trend == w.trend
    m = {(q.y, q.x): q for q in cube.trend_map().collect()}
    assert len(m) == 9 and m[0, 1].slope is None and m[0, 0].p_value is None
    assert m[2, 2].slope == pytest.approx(sen[2, 2].slope)
    with pytest.raises(ValueError, match="unknown method"):
        cube.trend_map(0, "x")
    assert {(q.y, q.x): q.slope for q in cube.trend_map(0, "ols").collect()}[2, 2] == pytest.approx(want[2, 2].slope)


def test_harmonic_and_breaks(spark):
    t = np.arange(72) / 12
    season = 1 + 0.8 * np.sin(2 * np.pi * t) + 0.01 * np.cos(np.arange(72) * 7.0)
    data = np.stack([season, season + 2.0 * (t >= 3)]).reshape(1, 1, 2, 72)
    cube = TCube.from_numpy(spark, data, t, ["b"])
    fit = {r.x: r for r in cube.harmonic(0, 1.0, 1).collect()}
    assert fit[0].components[0].sin_coef == pytest.approx(0.8, abs=0.01) and fit[0].n == 72
    maps = {r.x: r for r in cube.break_map(0, n_harmonics=1).collect()}
    assert maps[0]["count"] == 0 and maps[0].first_break is None and maps[1]["count"] == 1 and maps[1].first_break == pytest.approx(35 / 12, abs=0.1)
    found = {r.x: r for r in cube.breaks(0, n_harmonics=1).collect()}
    assert len(found[1].breaks) == 1 and found[1].statistic > found[0].statistic
    with pytest.raises(errors.InvalidParameter):
        cube.breaks(0, min_segment=1)
    w = kernels.cusum(t, data[0, 0, 1], 0, 1.0)
    c = {r.x: r for r in cube.cusum().collect()}[1]
    assert (c.statistic, c.p_value) == pytest.approx(w[:2])


def test_composites(spark):
    t, v = [2024, 2024.01, 2024.02, 2024.09, 2024.10], [1.0, 9.0, 2.0, 4.0, 6.0]
    cube = TCube.from_numpy(spark, np.array(v).reshape(1, 1, 1, 5), np.array(t), ["b"])
    got = rows(cube.composite("monthly", "median").long, "t", "v")
    assert got == [(pytest.approx(2024.01), 2.0), (pytest.approx(2024.095), 5.0)]
    for method, want in (("mean", 4.0), ("min", 1.0), ("max", 9.0)):
        assert rows(cube.composite(1 / 12, method).long, "t", "v")[0][1] == want
    tiles = TCube.from_numpy(spark, np.array([[1, NAN, 3.0], [NAN, 3.0, NAN]])[None, None], np.array([0.0, 0.0, 1.0]), ["b"])
    assert rows(tiles.composite("same_time", "mean").long, "x", "t", "v") == [(0, 0.0, 1.0), (0, 1.0, 3.0), (1, 0.0, 3.0), (1, 1.0, None)]
    gone = TCube.from_numpy(spark, np.array([NAN, 3, NAN, NAN]).reshape(1, 1, 1, 4), np.array([0.0, 0, 1, 1]), ["b"])
    assert rows(gone.composite("same_time", "mean").long, "t", "v") == [(0.0, 3.0), (1.0, None)]
    with pytest.raises(KeyError):
        cube.composite("monthly", "mode")
    with pytest.raises(ValueError, match="bad window"):
        cube.composite("period:x")
    with pytest.raises(errors.InvalidParameter):
        cube.composite("period:-1")


def test_groups_come_from_the_axis(spark):
    sparse = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 0, 0.9, 2.0), (0, 1, 0.9, 4.0), (0, 1, 1.1, 6.0)], "y int, x int, t double, v double")
    got = rows(TCube.from_long(sparse, ["b"]).composite(1.0, "mean").long, "x", "t", "v")
    assert got == [(0, pytest.approx(0.45), 1.5), (1, pytest.approx(0.45), 4.0), (1, pytest.approx(1.1), 6.0)]
    dense = rows(TCube.from_long(sparse, ["b"]).composite(1.0, "mean", dense=True).long, "x", "ti", "v")
    assert [d[:2] for d in dense] == [(0, 0), (0, 1), (1, 0), (1, 1)] and dense[1][2] is None


def test_gapfill(spark):
    cube = TCube.from_numpy(spark, np.array([NAN, 1, NAN, 5, NAN, NAN, 8, NAN]).reshape(1, 1, 1, 8), np.arange(8.0), ["b"])
    assert [v for _, v in rows(cube.gapfill().long, "ti", "v")] == [None, 1, 3, 5, 6, 7, 8, None]
    assert [v for _, v in rows(cube.gapfill(2).long, "ti", "v")] == [None, 1, 3, 5, None, None, 8, None]


def test_tiles(spark, ramp):
    big = TCube.from_numpy(spark, np.zeros((1, 5, 4, 1)), np.zeros(1), ["b"])
    assert big.tiles(2, 3).select("y0", "x0").distinct().count() == 6
    import pyarrow as pa

    sums = ramp.map_tiles((1, 2), lambda part: pa.table({"y": part["y0"][:1], "n": pa.array([part.num_rows])}), "y int, n long")
    assert rows(sums, "y", "n") == [(0, 12), (1, 12)]
    for size in ((0, 1), (1,)):
        with pytest.raises(errors.InvalidChunkSize):
            ramp.tiles(*size)


def test_band_math_and_selection(spark):
    data = np.array([[4.0, 1.0], [2.0, -1.0]]).reshape(2, 1, 1, 2)
    cube = TCube.from_numpy(spark, data, np.arange(2.0), ["nir", "red"])
    assert rows(cube.band_math("ndvi", C.ndvi, "nir", "red").long, "ti", "v") == [(0, pytest.approx(1 / 3)), (1, None)]
    assert cube.where_time("t < 1").dims == (2, 1, 1, 1)
    assert rows(cube.with_values(F.col("v") * 2).long.where("band = 'red'"), "ti", "v") == [(0, 4.0), (1, -2.0)]


def test_sql_functions(spark, ramp):
    names = registry.register(spark)
    assert {"theil_sen", "linear_trend", "detect_breaks"} <= set(names)
    ramp.pack(0).createOrReplaceTempView("packed")
    got = spark.sql("SELECT y, x, theil_sen(ts, vs).slope AS s, linear_trend(ts, vs).p_value AS p, mann_kendall(ts, vs).trend AS m FROM packed ORDER BY y, x").collect()
    assert [r.s for r in got] == [1, 2, 2, 3] and all(r.p < 1e-6 for r in got) and {r.m for r in got} == {"increasing", "no trend"} - ({"no trend"} if all(r.m == "increasing" for r in got) else set())


def test_filters_reach_the_scan(spark, tmp_path):
    df = spark.range(100).selectExpr("id % 5 AS user_id", "CAST(id AS DOUBLE) AS t", "CAST(id AS DOUBLE) AS v", "'b' AS band", "id AS ti", "id AS unused")
    df.write.parquet(f"{tmp_path}/p")
    cube = TCube.from_long(spark.read.parquet(f"{tmp_path}/p"), ["b"], keys=("user_id",))
    plan = cube.theil_sen().where("user_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,3)" in plan and "unused" not in plan


@pytest.mark.parametrize(("iso", "want"), [("2023-07-02T12:00:00Z", 2023.5), ("2024-03-01", 2024 + 60 / 366), ("2023-12-31T00:00:00Z", 2023 + 364 / 365), ("2023-02-31", 2023 + 61 / 365), ("2023-01-01 06:30", 2023 + 6.5 / 24 / 365), ("2023-01-01T00:00:30.5+05:00", 2023 + 30.5 / 86400 / 365), ("", None), ("2024", None), ("2024-13-01", None), ("not-a-date", None), ("2024-01-01X00:00", None), ("2024-01-32", None), (None, None)])
def test_fractional_year_iso(spark, iso, want):
    got = spark.createDataFrame([(iso,)], "s string").select(C.fractional_year_iso(F.col("s"))).first()[0]
    assert got == (want if want is None else pytest.approx(want, abs=1e-9))


def test_fractional_year(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2023-07-02 12:00:00' AS a, DATE'2024-03-01' AS b, TIMESTAMP_NTZ'2024-12-31 23:59:59.999999' AS c")
    assert tuple(df.select(*(C.fractional_year(F.col(k)) for k in "abc")).first()) == pytest.approx((2023.5, 2024 + 60 / 366, 2025 - 1e-6 / 86400 / 366), abs=1e-12)


def test_p_value_columns(spark):
    df = spark.range(1, 60).select(F.col("id"), (F.col("id") / 9).alias("x"))
    for r in df.select("id", "x", C.normal_two_sided(F.col("x")).alias("n"), C.student_t_two_sided(F.col("x"), F.col("id")).alias("t"), C.bridge_p_value(F.col("x")).alias("b")).collect():
        assert r.n == pytest.approx(2 * kernels.norm_sf(r.x), abs=1e-13) and r.t == pytest.approx(kernels.student_t_two_sided(r.x, r.id), abs=1e-12) and r.b == pytest.approx(kernels.bridge_p_value(r.x), abs=1e-12)


def test_utm(spark):
    df = spark.createDataFrame([(-70.65, -33.45, 32719), (9.0, 48.0, 32632), (3.0, 0.0, 32631)], "lon double, lat double, zone int")
    there = utm.forward(df, "lon", "lat", "zone")
    back = utm.backward(there, "x", "y", "zone", "lon2", "lat2").collect()
    assert all((r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-9) for r in back)
    assert (back[2].x, back[2].y) == pytest.approx((500000, 0), abs=1e-6) and back[1].y == pytest.approx(5316300, abs=2000)
    twice = utm.reproject(utm.reproject(there.withColumn("other", F.lit(32718)), "x", "y", "zone", "other"), "x", "y", "other", "zone").collect()
    assert (twice[0].x, twice[0].y) == pytest.approx((back[0].x, back[0].y), abs=1e-3)


def test_tails_of_p_values(spark):
    """Relative accuracy far out: against the complementary error function and the incomplete beta function."""
    z = [k / 8 for k in range(0, 12 * 8 + 1)]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    for r in df.select("z", C.normal_two_sided(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-12)
    grid = [(t, d) for t in [0.0, 0.001, 0.3, 1.0, 1.7, 1.74, 3.0, 9.0, 40.0, 80.0, 100.0] for d in (1, 2, 3, 4, 5, 10, 30, 99, 1000, 100_000)]
    for r in spark.createDataFrame(grid, "t double, d int").select("t", "d", C.student_t_two_sided(-F.col("t"), F.col("d")).alias("p")).collect():
        assert r.p == pytest.approx(kernels.student_t_two_sided(r.t, r.d), rel=1e-9 if r.d < 1000 else 1e-7) and 0 <= r.p <= 1
    odd = spark.createDataFrame([(None,), (math.inf,)], "x double").select(C.normal_two_sided(F.col("x")).alias("n"), C.student_t_two_sided(F.col("x"), F.lit(5)).alias("s")).collect()
    assert [tuple(r) for r in odd] == [(None, None), (0.0, 0.0)]


def test_packed_cube_is_the_cube(spark):
    r = np.random.default_rng(12)
    data = np.round(r.normal(0, 3, (2, 4, 5, 31)), 1)
    data[r.random(data.shape) < 0.4] = NAN
    data[1, 2, 2] = NAN
    t = np.sort(np.round(2020 + r.random(31) * 2, 2))
    t[5], t[6] = t[4], t[4]
    cube = TCube.from_numpy(spark, data, t, ["a", "b"])
    assert np.array_equal(cube.dense().to_cube().to_numpy(), data, equal_nan=True)
    full = cube.densify()
    assert full.long.count() == data.size and full.long.schema["ti"].dataType == cube.long.schema["ti"].dataType
    for method in ("median", "mean", "min", "max"):
        for window in ("same_time", "monthly", 0.3):
            want = cube.composite(window, method, dense=True)
            got = cube.dense().composite(window, method).to_cube()
            assert got.time == pytest.approx(want.time, rel=1e-12)
            assert got.to_numpy() == pytest.approx(want.to_numpy(), rel=1e-12, nan_ok=True)
    for gap in (None, 0.1):
        assert cube.dense().gapfill(gap).to_cube().to_numpy() == pytest.approx(cube.gapfill(gap).to_numpy(), rel=1e-12, nan_ok=True)
        assert cube.dense().gapfill(gap).to_cube().to_numpy()[0, 1, 1] == pytest.approx(kernels.gapfill(t, data[0, 1, 1], gap), rel=1e-12, nan_ok=True)
    for method in ("theil_sen", "ols"):
        assert rows(cube.dense().trend_map("b", method).dropna(), "y", "x", "slope") == [pytest.approx(x) for x in rows(cube.trend_map("b", method, origin=2020).dropna(), "y", "x", "slope")]
    assert rows(cube.dense().break_map(1), "y", "x", "count") == rows(cube.break_map(1), "y", "x", "count")
    with pytest.raises(errors.BandOutOfRange):
        cube.dense().trend_map("c")
