"""The queries of the driver contract, each with its DuckDB text where SQL can express it.

Numbers are rounded alike on both sides; adding 0.0 makes negative zero positive.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespan.functions import columns as C
from cubespan.functions import registry, utm
from cubespan.operators import scenes, trend
from cubespan.plans import fixtures, oracle, studies
from cubespan.plans.oracle import rounded
from cubespan.sources import folders, series

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: A week, in years of 2024.
WEEK, WEEK_SQL = 7 / 366, "7.0::DOUBLE / 366.0::DOUBLE"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return add


def R(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


# Projections and filters


@query("SELECT event_id, value AS v FROM events WHERE value IS NOT NULL AND isfinite(value) AND event_id % 10 <> 7")
def finite_filter(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("v", F.when(F.col("event_id") % 10 == 7, float("nan")).otherwise(F.col("value")))
    return e.select("event_id", C.finite(F.col("v")).alias("v")).where("v IS NOT NULL")


@query(f"SELECT event_id, {oracle.year_part('ts')} AS t FROM events")
def fractional_year(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", C.fractional_year(F.col("ts")).alias("t"))


@query(f"SELECT event_id, {rounded(oracle.year_part('ts'), 9)} AS t, NULL::DOUBLE AS bad FROM events")
def fractional_year_iso(spark: SparkSession, d: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return _events(spark, d).select("event_id", R(C.fractional_year_iso(iso), 9).alias("t"), C.fractional_year_iso(F.concat(F.lit("x"), iso)).alias("bad"))


@query("SELECT DISTINCT year(o_orderdate) AS y, year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0 AS leap FROM orders")
def is_leap(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.year("o_orderdate").cast("long").alias("y")).distinct()
    return o.select("y", C.is_leap(F.col("y")).alias("leap"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(nullif(l_quantity, 7.0) * 0.5::DOUBLE + -1.0::DOUBLE, 6) + 0.0::DOUBLE AS v FROM lineitem")
def rescale_mask(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", R(C.rescale(C.nodata_to_null(F.col("l_quantity"), 7.0), 0.5, -1.0)).alias("v"))


@query("SELECT event_id, value AS cloud_cover FROM events WHERE coalesce(CASE WHEN event_id % 10 <> 7 THEN value END, 0) <= 100")
def cloud_filter(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    cover = F.when(F.col("event_id") % 10 != 7, F.col("value"))
    return e.where(F.coalesce(cover, F.lit(0.0)) <= 100).select("event_id", F.col("value").alias("cloud_cover"))


@query(f"WITH {oracle.EVENTS} SELECT y, x, ti, {rounded('t', 9)} AS t, v FROM e WHERE band = 'click'")
def band_select(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.event_bands(spark, d).where_band("click").select("y", "x", "ti", R("t", 9).alias("t"), "v")


@query(f"WITH {oracle.EVENTS} SELECT ti, {rounded('t', 9)} AS t, v FROM e WHERE band = 'click' AND y = 0 AND x = 3")
def pixel_series(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.event_bands(spark, d).series("click", 0, 3).select("ti", R("t", 9).alias("t"), "v")


@query(f"WITH {oracle.EVENTS} SELECT count(DISTINCT band) AS bands, max(y) + 1 AS height, max(x) + 1 AS width, (SELECT count(*) FROM (SELECT DISTINCT ti, t FROM e)) AS times FROM e")
def cube_dims(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([fixtures.event_bands(spark, d).dims], "bands long, height long, width long, times long")


@query(f"WITH {oracle.EVENTS} SELECT y // 4 * 4 AS y0, x // 3 * 3 AS x0, count(*) AS n, count(v) AS n_finite FROM e GROUP BY ALL")
def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.event_bands(spark, d).tiles(4, 3).groupBy("y0", "x0").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_finite"))


@query(f"WITH {oracle.EVENTS} SELECT y // 4 * 4 AS y0, x // 3 * 3 AS x0, {rounded('max(v)')} AS top FROM e GROUP BY ALL")
def map_tiles(spark: SparkSession, d: str) -> DataFrame:
    def top(part):
        import pyarrow as pa
        import pyarrow.compute as pc

        return pa.table({"y0": part["y0"][:1], "x0": part["x0"][:1], "top": pa.array([pc.max(part["v"]).as_py()], pa.float64())})

    return fixtures.event_bands(spark, d).map_tiles((4, 3), top, "y0 long, x0 long, top double").select("y0", "x0", R("top").alias("top"))


@query(f"WITH {oracle.EVENTS}, w AS (SELECT y, x, floor(t * 100) AS g, avg(v) FILTER (band = 'click') AS a, avg(v) FILTER (band = 'purchase') AS b FROM e GROUP BY ALL) SELECT y, x, CAST(g AS BIGINT) AS ti, {rounded('CASE WHEN a + b <> 0 THEN (a - b) / (a + b) END')} AS v FROM w WHERE a IS NOT NULL OR b IS NOT NULL")
def ndvi(spark: SparkSession, d: str) -> DataFrame:
    cube = fixtures.event_bands(spark, d)
    own = cube.where_time("true").long.where(F.col("band").isin("click", "purchase")).groupBy("y", "x", "band", F.floor(F.col("t") * 100).alias("ti")).agg(F.avg("v").alias("v"))
    coarse = type(cube).from_long(own.withColumn("t", F.col("ti").cast("double")).where("v IS NOT NULL"), bands=["click", "purchase"])
    return coarse.band_math("ndvi", C.ndvi, "click", "purchase").long.select("y", "x", "ti", R("v").alias("v"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN CAST(l_quantity AS INTEGER) % 12 NOT IN (0, 1, 3, 8, 9, 10, 11) THEN l_extendedprice END AS v FROM lineitem")
def scl_mask(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.when(C.scl_clear(F.col("l_quantity").cast("int") % 12), F.col("l_extendedprice")).alias("v"))


# Special functions


@query(f"SELECT i, {rounded('log10(' + oracle.normal_tail('(i / 50.0::DOUBLE)') + ')', 7)} AS normal, {rounded('log10(' + oracle.student_tail('(i / 6.0::DOUBLE)', '(i % 40 + 1)') + ')', 7)} AS student, {rounded(oracle.bridge('(i / 200.0::DOUBLE)'), 9)} AS bridge FROM (SELECT unnest(range(0, 601)) AS i)")
def p_values(spark: SparkSession, d: str) -> DataFrame:
    """z up to 12 and t up to 100, as logarithms, so that the tails count."""
    i = F.col("i")
    return spark.range(601).withColumnRenamed("id", "i").select("i", R(F.log10(C.normal_two_sided(i / 50.0)), 7).alias("normal"), R(F.log10(C.student_t_two_sided(i / 6.0, i % 40 + 1)), 7).alias("student"), R(C.bridge_p_value(i / 200.0), 9).alias("bridge"))


# Time


#: Quantities by supplier and flag of return, at the days of shipping: several a day.
_QUANTITIES = f"li AS (SELECT l_suppkey, l_returnflag AS band, l_orderkey * 10 + l_linenumber AS ti, {oracle.year_part('l_shipdate')} - 1995.0::DOUBLE AS t, l_quantity AS v FROM lineitem)"


def _composites() -> None:
    for method in ("median", "mean", "min", "max"):
        same = f"WITH {_QUANTITIES}, {oracle.composite('li', 'l_suppkey, band', method, None)} SELECT l_suppkey, band, {rounded('t', 8)} AS t, {rounded('v')} AS v FROM comp"
        period = f"WITH {oracle.EVENTS}, {oracle.composite('e', 'user_id', method, 0.01)} SELECT user_id, {rounded('t', 8)} AS t, {rounded('v')} AS v FROM comp"

        @query(same, f"composite_same_time_{method}")
        def same_time(spark: SparkSession, d: str, method=method) -> DataFrame:
            return fixtures.quantities(spark, d).composite("same_time", method).long.select("l_suppkey", "band", R("t", 8).alias("t"), R("v").alias("v"))

        @query(period, f"composite_period_{method}")
        def run(spark: SparkSession, d: str, method=method) -> DataFrame:
            return fixtures.events(spark, d).composite(0.01, method).long.select("user_id", R("t", 8).alias("t"), R("v").alias("v"))


_composites()


@query(f"WITH {oracle.months()}, {oracle.composite('m', 'l_suppkey', 'median', 1 / 12)} SELECT l_suppkey, {rounded('t', 8)} AS t, v FROM comp")
def composite_monthly(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.months(spark, d).composite("monthly", "median").long.select("l_suppkey", R("t", 8).alias("t"), "v")


_MONTHS_FULL = f"WITH {oracle.months()}, full_ AS (SELECT * FROM (SELECT DISTINCT l_suppkey FROM m), (SELECT DISTINCT ti, t FROM m)), holes AS (SELECT l_suppkey, ti, f.t, CASE WHEN ti % 7 <> 3 THEN v END AS v FROM full_ f LEFT JOIN m USING (l_suppkey, ti))"


@query(f"{_MONTHS_FULL}, {oracle.gapfill('holes', 'l_suppkey', 0.3)}, {oracle.composite('filled', 'l_suppkey', 'median', 0.25)} SELECT l_suppkey, {rounded('t', 8)} AS t, {rounded('v * 0.73105857::DOUBLE', 4)} AS v FROM comp")
def packed_cube(spark: SparkSession, d: str) -> DataFrame:
    """Gap filling and a composite of a dense cube: arrays on the cube's axis. The factor keeps values from lying halfway between two rounded ones."""
    cube = fixtures.months(spark, d)
    dense = cube.with_values(F.when(F.col("ti") % 7 != 3, F.col("v"))).dense()
    return dense.gapfill(0.3).composite(0.25, "median").to_cube().long.select("l_suppkey", R("t", 8).alias("t"), R(F.col("v") * 0.73105857, 4).alias("v"))


def _gapfill(name: str, gap: float | None) -> None:
    sql = f"WITH {oracle.EVENTS}, {oracle.gapfill('e', 'user_id', gap)} SELECT user_id, ti, {rounded('v')} AS v FROM filled"

    @query(sql, name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fixtures.events(spark, d).gapfill(gap).long.select("user_id", "ti", R("v").alias("v"))


_gapfill("gapfill", None)
_gapfill("gapfill_max_gap", 0.0025)


@query(f"WITH {oracle.months()}, full_ AS (SELECT * FROM (SELECT DISTINCT l_suppkey FROM m), (SELECT DISTINCT ti, t FROM m)) SELECT l_suppkey, f.ti, {rounded('f.t', 9)} AS t, v FROM full_ f LEFT JOIN m USING (l_suppkey, ti)")
def densify(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.months(spark, d).densify().long.select("l_suppkey", "ti", R("t", 9).alias("t"), "v")


@query(f"WITH {oracle.EVENTS}, day AS (SELECT CAST(floor(t * 366) AS BIGINT) AS day, count(v) AS n, {rounded('avg(v)')} AS mean FROM e GROUP BY 1) SELECT * FROM day")
def solar_day(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.events(spark, d).long.groupBy(F.floor(F.col("t") * 366).alias("day")).agg(F.count("v").alias("n"), R(F.avg("v")).alias("mean"))


# Trends

_FIT = ", ".join(f"{rounded(c, n)} AS {c}" for c, n in (("slope", 4), ("intercept", 4), ("r_squared", 6), ("std_err", 4), ("p_value", 6)))


@query(f"WITH {oracle.EVENTS}, {oracle.ols('e', 'user_id')} SELECT user_id, {_FIT}, n FROM fit")
def linear_trend(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.events(spark, d).linear_trend().select("user_id", *(R(c, n).alias(c) for c, n in (("slope", 4), ("intercept", 4), ("r_squared", 6), ("std_err", 4), ("p_value", 6))), "n")


@query(f"WITH {oracle.EVENTS}, q AS (SELECT *, (y * 100 + x) || band AS k FROM e), {oracle.ols('q', 'k')} SELECT k, {_FIT}, n FROM fit")
def linear_trend_short_series(spark: SparkSession, d: str) -> DataFrame:
    """Every band of the events; some series have too few observations."""
    cube = fixtures.event_bands(spark, d)
    fits = [cube.linear_trend(b).withColumn("k", F.concat(F.col("y") * 100 + F.col("x"), F.lit(b))) for b in cube.bands]
    fit = functools.reduce(DataFrame.unionByName, fits)
    return fit.select("k", *(R(c, n).alias(c) for c, n in (("slope", 4), ("intercept", 4), ("r_squared", 6), ("std_err", 4), ("p_value", 6))), "n")


_SEN = f"WITH {oracle.EVENTS}, {oracle.pairs('e', 'user_id')}, {oracle.theil_sen('user_id')} SELECT user_id, {rounded('slope', 4)} AS slope, {rounded('intercept', 4)} AS intercept, n FROM sen"


def _sen(df: DataFrame) -> DataFrame:
    return df.select("user_id", R("slope", 4).alias("slope"), R("intercept", 4).alias("intercept"), "n")


@query(_SEN)
def theil_sen(spark: SparkSession, d: str) -> DataFrame:
    return _sen(fixtures.events(spark, d).theil_sen())


@query(_SEN)
def theil_sen_sql(spark: SparkSession, d: str) -> DataFrame:
    return _sen(fixtures.events(spark, d).theil_sen(method="sql"))


@query(f"WITH {oracle.EVENTS}, {oracle.pairs('e', 'user_id')} SELECT user_id, count(*) AS n, {rounded('sum(v2 - v1)', 2)} AS diff FROM pair GROUP BY user_id")
def pairs_self_join(spark: SparkSession, d: str) -> DataFrame:
    p = trend.pairs(fixtures.events(spark, d).long, ["user_id"])
    return p.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), R(F.sum(F.col("v2") - F.col("v1")), 2).alias("diff"))


_MK_COLUMNS = ", ".join(f"{rounded(c)} AS {c}" for c in ("s", "var_s", "z", "tau", "p_value"))
_MK = f"WITH {oracle.EVENTS}, {oracle.pairs('e', 'user_id')}, {oracle.mann_kendall('user_id')} SELECT user_id, {_MK_COLUMNS}, n FROM mk"


def _mk(df: DataFrame) -> DataFrame:
    return df.select("user_id", *(R(c).alias(c) for c in ("s", "var_s", "z", "tau", "p_value")), "n")


@query(_MK)
def mann_kendall(spark: SparkSession, d: str) -> DataFrame:
    return _mk(fixtures.events(spark, d).mann_kendall())


@query(_MK)
def mann_kendall_sql(spark: SparkSession, d: str) -> DataFrame:
    return _mk(fixtures.events(spark, d).mann_kendall(method="sql"))


@query(f"WITH {oracle.EVENTS}, {oracle.SIGNAL}, {oracle.pairs('s', 'k')}, {oracle.mann_kendall('k')} SELECT k AS user_id, CASE WHEN p_value < 0.05 THEN CASE WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END ELSE 'no trend' END AS trend FROM mk")
def mk_trend_label(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.events(spark, d, fixtures.with_signal()).mann_kendall().select("user_id", "trend")


@query(f"WITH {_QUANTITIES}, {oracle.composite('li', 'l_suppkey, band', 'median', None)}, o AS (SELECT l_suppkey || band AS k, 0 AS ti, t, v FROM comp), {oracle.pairs('o', 'k')}, {oracle.mann_kendall('k')} SELECT k, {_MK_COLUMNS}, n FROM mk")
def mann_kendall_ties(spark: SparkSession, d: str) -> DataFrame:
    cube = fixtures.quantities(spark, d).composite("same_time", "median")
    own = [cube.mann_kendall(b).where("n >= 3").withColumn("k", F.concat(F.col("l_suppkey").cast("string"), F.lit(b))) for b in cube.bands]
    return functools.reduce(DataFrame.unionByName, own).select("k", *(R(c).alias(c) for c in ("s", "var_s", "z", "tau", "p_value")), "n")


@query(f"WITH {oracle.EVENTS}, {oracle.pairs('e', 'user_id')}, {oracle.theil_sen('user_id')}, {oracle.mann_kendall('user_id')} SELECT user_id, {rounded('sen.slope', 4)} AS slope, {rounded('mk.p_value')} AS p_value FROM sen FULL JOIN mk USING (user_id)")
def trend_map_theil_sen(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.events(spark, d).trend_map(method="theil_sen").select("user_id", R("slope", 4).alias("slope"), R("p_value").alias("p_value"))


@query(f"WITH {oracle.EVENTS}, {oracle.ols('e', 'user_id')} SELECT user_id, {rounded('slope', 4)} AS slope, {rounded('p_value')} AS p_value FROM fit")
def trend_map_ols(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.events(spark, d).trend_map(method="ols").select("user_id", R("slope", 4).alias("slope"), R("p_value").alias("p_value"))


@query(
    f"WITH {oracle.months()}, q AS (SELECT l_suppkey AS k, ti, t, v FROM m), {oracle.ols('q', 'k')}, {oracle.pairs('q', 'k')}, {oracle.theil_sen('k')}, {oracle.mann_kendall('k')}, {oracle.harmonic('q', 'k', '1.0::DOUBLE', 2)}, {oracle.breaks('q', 'k')}, "
    f"holes AS (SELECT k, ti, t, CASE WHEN pos % 5 <> 2 THEN v END AS v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, ti) - 1 AS pos FROM q)), {oracle.gapfill('holes', 'k', None)} "
    f"SELECT k AS l_suppkey, {rounded('fit.slope', 3)} AS ols, {rounded('sen.slope', 3)} AS sen, {rounded('mk.s')} AS s, {rounded('b1', 3)} AS harmonic, {rounded('statistic')} AS statistic, {rounded('sum_', 2)} AS filled, {rounded('sen.slope', 3)} AS map_sen, {rounded('mk.p_value')} AS map_sen_p, {rounded('fit.p_value')} AS map_ols_p "
    "FROM fit JOIN sen USING (k) JOIN mk USING (k) JOIN har USING (k) JOIN cus USING (k) JOIN (SELECT k, sum(v) AS sum_ FROM filled GROUP BY k) USING (k)"
)
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """All functions that register() gives to SQL."""
    registry.register(spark)
    fixtures.months(spark, d).pack(0).createOrReplaceTempView("cubespan_packed")
    return spark.sql("""
        SELECT l_suppkey, round(linear_trend(ts, vs).slope, 3) + 0.0D AS ols, round(theil_sen(ts, vs).slope, 3) + 0.0D AS sen, round(mann_kendall(ts, vs).s, 6) + 0.0D AS s, round(harmonic_regression(ts, vs).slope, 3) + 0.0D AS harmonic,
               round(detect_breaks(ts, vs).statistic, 6) + 0.0D AS statistic, round(aggregate(gapfill_linear(ts, holes), 0.0D, (a, x) -> a + coalesce(x, 0.0D)), 2) + 0.0D AS filled,
               round(trend_map_theil_sen(ts, vs).slope, 3) + 0.0D AS map_sen, round(trend_map_theil_sen(ts, vs).p_value, 6) + 0.0D AS map_sen_p, round(trend_map_ols(ts, vs).p_value, 6) + 0.0D AS map_ols_p
        FROM (SELECT *, transform(vs, (x, i) -> if(i % 5 <> 2, x, NULL)) AS holes FROM cubespan_packed)""")


@query(f"WITH {oracle.EVENTS} SELECT user_id, {rounded('max(v) - min(v)')} AS spread FROM e GROUP BY user_id")
def map_series(spark: SparkSession, d: str) -> DataFrame:
    out = fixtures.events(spark, d).map_series(0, lambda t, v: float(v.max() - v.min()) if len(v) else None, "double", "spread")
    return out.select("user_id", R("spread").alias("spread"))


# Harmonics and breaks


def _harmonic(name: str, k: int) -> None:
    """Every number of the fit."""
    parts = [(f"{c}{h}", n, e) for h in range(1, k + 1) for c, n, e in (("cos", 5, f"b{2 * h}"), ("sin", 5, f"b{2 * h + 1}"), ("amplitude", 5, f"sqrt(b{2 * h} * b{2 * h} + b{2 * h + 1} * b{2 * h + 1})"), ("phase", 5, f"atan2(b{2 * h + 1}, b{2 * h})"))]
    whole = [("slope", 3, "b1"), ("intercept", 4, "b0 - b1 * centre"), ("r_squared", 6, "CASE WHEN yy = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - sse / yy) END"), ("rmse", 5, "sqrt(sse / n)")]
    sql = f"WITH {oracle.EVENTS}, {oracle.harmonic('e', 'user_id', WEEK_SQL, k)} SELECT user_id, {', '.join(f'{rounded(e, n)} AS {c}' for c, n, e in whole + parts)}, n FROM har JOIN rest USING (user_id)"

    @query(sql, name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        fit = fixtures.events(spark, d).harmonic(0, WEEK, k)
        part = lambda c: F.col("components")[int(c[-1]) - 1][{"cos": "cos_coef", "sin": "sin_coef"}.get(c[:-1], c[:-1])]
        return fit.where("n IS NOT NULL").select("user_id", *(R(c, n).alias(c) for c, n, _ in whole), *(R(part(c), n).alias(c) for c, n, _ in parts), "n")


_harmonic("harmonic_k1", 1)
_harmonic("harmonic_k2", 2)


@query(f"WITH {oracle.EVENTS}, {oracle.harmonic('e', 'user_id', WEEK_SQL, 1)} SELECT user_id, {rounded(f'b0 + b1 * (0.05::DOUBLE - centre) + b2 * cos(2 * pi() / ({WEEK_SQL}) * 0.05::DOUBLE) + b3 * sin(2 * pi() / ({WEEK_SQL}) * 0.05::DOUBLE)', 5)} AS fitted FROM har")
def harmonic_predict(spark: SparkSession, d: str) -> DataFrame:
    fit = fixtures.events(spark, d).pack(0).select("user_id", registry.harmonic_regression(WEEK, 1)("ts", "vs").alias("fit")).where("fit IS NOT NULL")
    return fit.select("user_id", R(C.harmonic_predict(F.col("fit"), F.lit(0.05)), 5).alias("fitted"))


_SIGNAL = f"WITH {oracle.EVENTS}, {oracle.SIGNAL}, {oracle.breaks('s', 'k')}"


@query(f"{_SIGNAL} SELECT k AS user_id, n, {rounded('statistic')} AS statistic, {rounded('p_value')} AS p_value FROM cus")
def cusum_statistic(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.events(spark, d, fixtures.with_signal()).cusum().select("user_id", "n", R("statistic").alias("statistic"), R("p_value").alias("p_value"))


@query(f"{_SIGNAL} SELECT k AS user_id, idx AS split_index, {rounded('time', 9)} AS split_time FROM cus WHERE n >= 24 AND p_value < 0.05")
def first_break(spark: SparkSession, d: str) -> DataFrame:
    c = fixtures.events(spark, d, fixtures.with_signal()).cusum().where("n >= 24 AND p_value < 0.05")
    return c.select("user_id", F.col("split_index").cast("long").alias("split_index"), R("split_time", 9).alias("split_time"))


@query(f"{_SIGNAL} SELECT k AS user_id, idx AS index, {rounded('time', 9)} AS time, {rounded('statistic')} AS statistic, {rounded('p_value')} AS p_value FROM brk")
def detect_breaks(spark: SparkSession, d: str) -> DataFrame:
    b = fixtures.events(spark, d, fixtures.with_signal()).breaks().select("user_id", F.explode("breaks").alias("b"))
    return b.select("user_id", F.col("b.index").cast("long").alias("index"), R("b.time", 9).alias("time"), R("b.statistic").alias("statistic"), R("b.p_value").alias("p_value"))


@query(f"{_SIGNAL} SELECT c.k AS user_id, CAST(count(b.idx) AS DOUBLE) AS count, {rounded('min(b.time)', 9)} AS first_break FROM cus c LEFT JOIN brk b ON b.k = c.k GROUP BY c.k")
def break_map(spark: SparkSession, d: str) -> DataFrame:
    m = fixtures.events(spark, d, fixtures.with_signal()).break_map()
    return m.where("count IS NOT NULL").select("user_id", "count", R("first_break", 9).alias("first_break"))


@query(f"WITH {oracle.months(True)}, q AS (SELECT l_suppkey AS k, ti, t, v FROM m), {oracle.harmonic_breaks('q', 'k', '1.0::DOUBLE')} SELECT c.k AS l_suppkey, CAST(count(b.idx) AS DOUBLE) AS count, {rounded('min(b.time)', 9)} AS first_break FROM cus c LEFT JOIN brk b ON b.k = c.k GROUP BY c.k")
def break_map_harmonic(spark: SparkSession, d: str) -> DataFrame:
    m = fixtures.months(spark, d, step=True).break_map(0, n_harmonics=1, period=1.0)
    return m.where("count IS NOT NULL").select("l_suppkey", "count", R("first_break", 9).alias("first_break"))


# Studies

_STEP = f"WITH {oracle.months(True)}, q AS (SELECT l_suppkey AS k, ti, t, v FROM m), {oracle.breaks('q', 'k')}, fb AS (SELECT k, min(time) AS bt FROM brk GROUP BY k)"
_DROP = f"{_STEP}, dr AS (SELECT q.k, bt, avg(v) FILTER (t > bt AND t <= bt + 0.3) - avg(v) FILTER (t > bt - 0.3 AND t <= bt) AS drop_ FROM q JOIN fb USING (k) GROUP BY q.k, bt)"


@query(f"{_STEP} SELECT k AS l_suppkey, {rounded('bt', 9)} AS first_break FROM fb JOIN (SELECT k FROM q GROUP BY k HAVING count(v) >= 20) USING (k)")
def first_break_map(spark: SparkSession, d: str) -> DataFrame:
    return studies.first_breaks(fixtures.months(spark, d, step=True), least=20).select("l_suppkey", R("first_break", 9).alias("first_break"))


@query(f"{_DROP} SELECT k AS l_suppkey, {rounded('drop_', 4)} AS magnitude FROM dr")
def drop_magnitude(spark: SparkSession, d: str) -> DataFrame:
    cube = fixtures.months(spark, d, step=True)
    return studies.drop_magnitude(cube, studies.first_breaks(cube, least=20), 0.3).select("l_suppkey", R("magnitude", 4).alias("magnitude"))


@query(f"{_STEP}, late AS (SELECT q.k, q.ti, q.t, q.v FROM q JOIN fb USING (k) WHERE t > bt + 0.05), enough AS (SELECT * FROM late WHERE k IN (SELECT k FROM late WHERE v IS NOT NULL GROUP BY k HAVING count(*) >= 6)), {oracle.pairs('enough', 'k')}, {oracle.theil_sen('k')} SELECT k AS l_suppkey, {rounded('slope', 3)} AS slope FROM sen")
def post_event_slope(spark: SparkSession, d: str) -> DataFrame:
    cube = fixtures.months(spark, d, step=True)
    return studies.post_event_slope(cube, studies.first_breaks(cube, least=20), 0.05, 6).select("l_suppkey", R("slope", 3).alias("slope"))


@query(f"{_DROP} SELECT (SELECT count(DISTINCT k) FROM q) AS pixels, count(*) AS broken, {rounded('median(bt)', 9)} AS median_time, {rounded('avg(CASE WHEN bt BETWEEN 0.3 AND 0.6 THEN 1.0::DOUBLE ELSE 0 END)')} AS in_window, {rounded('median(drop_)', 4)} AS median_drop FROM dr")
def break_summary(spark: SparkSession, d: str) -> DataFrame:
    cube = fixtures.months(spark, d, step=True)
    s = studies.summary(cube, studies.first_breaks(cube, least=20), 0.3, (0.3, 0.6))
    return s.select("pixels", "broken", R("median_time", 9).alias("median_time"), R("in_window").alias("in_window"), R("median_drop", 4).alias("median_drop"))


@query(f"{_DROP} SELECT arg_min(k, row(drop_, k)) AS strongest, (SELECT arg_max(k, row(a, -k)) FROM (SELECT k, avg(v) AS a FROM q WHERE k NOT IN (SELECT k FROM fb) GROUP BY k)) AS healthiest FROM dr")
def extremes(spark: SparkSession, d: str) -> DataFrame:
    cube = fixtures.months(spark, d, step=True)
    return studies.extremes(cube, studies.first_breaks(cube, least=20), 0.3)


@query(f"WITH {oracle.months(True)} SELECT {rounded('t', 9)} AS t, {rounded('avg(v)', 4)} AS mean, count(v) AS n FROM m GROUP BY t")
def area_mean_series(spark: SparkSession, d: str) -> DataFrame:
    return studies.area_mean(fixtures.months(spark, d, step=True)).select(R("t", 9).alias("t"), R("mean", 4).alias("mean"), "n")


@query(f"WITH {oracle.months(True)}, a AS (SELECT t, avg(v) AS v FROM m GROUP BY t) SELECT {rounded('avg(v) FILTER (t < 0.5)', 4)} AS before, {rounded('avg(v) FILTER (t >= 0.5)', 4)} AS after FROM a")
def pre_post_change(spark: SparkSession, d: str) -> DataFrame:
    return studies.pre_post(fixtures.months(spark, d, step=True), 0.5).select(R("before", 4).alias("before"), R("after", 4).alias("after"))


@query()
def monte_carlo(spark: SparkSession, d: str) -> DataFrame:
    return studies.recovery(spark, repetitions=300, sigmas=(0.02, 0.04, 0.05, 0.06, 0.08, 0.1, 0.12, 0.14), steps=[k / 20 for k in range(2, 11)], gaps=(0.1, 0.4))


# Scenes


def _scenes(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Five scenes of 12 by 12 pixels: two on one grid, one shifted by a pixel, one twice as coarse, one too cloudy."""
    ids = spark.range(5).withColumnRenamed("id", "s")
    name = F.concat(F.lit("scene"), "s")
    items = ids.select(name.alias("item_id"), F.concat(F.lit("2024-0"), F.col("s") + 1, F.lit("-15T00:00:00Z")).alias("datetime"), F.when(F.col("s") == 4, 90.0).when(F.col("s") < 3, 10.0).alias("cloud_cover"), F.lit(32719).alias("epsg"))
    coarse = F.col("s") == 3
    shift = F.when(F.col("s") == 2, 10.0).otherwise(0.0)
    grids = ids.select(name.alias("item_id"), F.lit("red").alias("asset"), (F.lit(500000.0) + shift).alias("x0"), F.when(coarse, 20.0).otherwise(10.0).alias("dx"), F.lit(7000000.0).alias("y0"), F.when(coarse, -20.0).otherwise(-10.0).alias("dy"), F.lit(12).alias("ny"), F.lit(12).alias("nx"), F.lit(None).cast("int").alias("epsg"), F.lit(0.0).alias("nodata"))
    cell = spark.range(5 * 144).select(F.floor(F.col("id") / 144).alias("s"), F.floor(F.col("id") % 144 / 12).cast("int").alias("row"), (F.col("id") % 12).cast("int").alias("col"))
    pixels = cell.select(name.alias("item_id"), F.lit("red").alias("asset"), "row", "col", ((F.col("row") * 31 + F.col("col") * 7 + F.col("s") * 13) % 50).cast("double").alias("dn"))
    return items, grids, pixels


_SCENES = """WITH cell AS (SELECT CAST(s AS INTEGER) AS ti, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT unnest(range(0, 4)) AS s), (SELECT unnest(range(0, 12)) AS y), (SELECT unnest(range(0, 12)) AS x)),
src AS (SELECT *, CASE WHEN ti = 3 THEN y // 2 ELSE y END AS r, CASE WHEN ti = 3 THEN x // 2 WHEN ti = 2 THEN x - 1 ELSE x END AS c FROM cell),
dn AS (SELECT *, CASE WHEN c >= 0 THEN nullif((r * 31 + c * 7 + ti * 13) % 50, 0) END AS dn FROM src)"""


@query(f"{_SCENES} SELECT ti, y, x, round(dn * 0.01::DOUBLE - 0.1::DOUBLE, 6) + 0.0::DOUBLE AS v FROM dn")
def scene_align_nearest(spark: SparkSession, d: str) -> DataFrame:
    # The fifth scene is cut by number, not by its clouds.
    cfg = scenes.StackConfig(["red"], max_items=4, scale=0.01, offset=-0.1)
    return scenes.stack(*_scenes(spark), cfg).cube.long.select("ti", "y", "x", R("v").alias("v"))


@query("SELECT 'scene4' AS item_id, 'cloud cover 90% > 50%' AS reason")
def stack_skipped(spark: SparkSession, d: str) -> DataFrame:
    return scenes.stack(*_scenes(spark), scenes.StackConfig(["red"], max_cloud_cover=50.0)).skipped


@query(f"WITH s AS (SELECT s_suppkey, CAST(400000 + s_suppkey % 997 * 200 AS DOUBLE) AS x, CAST(6200000 + s_suppkey % 991 * 500 AS DOUBLE) AS y FROM supplier), {oracle.utm('s', 's_suppkey', 32719, 32718)} SELECT s_suppkey, {rounded('x', 3)} AS x, {rounded('y', 3)} AS y FROM moved")
def utm_reproject(spark: SparkSession, d: str) -> DataFrame:
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.lit(400000.0) + F.col("s_suppkey") % 997 * 200).alias("x"), (F.lit(6200000.0) + F.col("s_suppkey") % 991 * 500).alias("y"))
    moved = utm.reproject(s.withColumns({"from": F.lit(32719), "to": F.lit(32718)}), "x", "y", "from", "to")
    return moved.select("s_suppkey", R("x", 3).alias("x"), R("y", 3).alias("y"))


@query(f"WITH {oracle.EVENTS} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, ti) - 1 AS ti, {rounded('t', 9)} AS t, v FROM e")
def csv_series(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file for each user, with a header, padding, CRLF, blank lines and NA, is written to the shared folder and read."""
    path = folders.new_path(spark, "csv-series")
    e = fixtures.events(spark, d).long
    line = F.concat(F.lit("\t"), F.col("t").cast("string"), F.lit(" ,\t"), F.coalesce(F.col("v").cast("string"), F.lit("NA")), F.lit(" \r\n"))
    lines = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "ti", line.alias("line")))).alias("p"))
    lines.select("user_id", F.concat(F.lit("t,v\r\n \r\n"), F.array_join("p.line", "")).alias("value")).write.partitionBy("user_id").text(path)
    read = series.read_series_csv(spark, f"{path}/*/*.txt")
    return read.select(F.regexp_extract("file", r"user_id=(\d+)", 1).cast("long").alias("user_id"), F.col("ti").cast("long").alias("ti"), R("t", 9).alias("t"), "v")
