"""Cubes made of the tables of the driver contract.

events: a series for each user, at the times of its events; a tenth of the values is missing. months: a series
for each supplier with the mean price of each month, summed in cents so that it doesn't depend on the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespan.functions import columns as C
from cubespan.operators.cube import TCube

#: Times are years since then.
ORIGIN = 2024.0


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = C.fractional_year(F.col("ts")) - ORIGIN
    return e.select((F.floor(F.col("user_id") / 10)).cast("long").alias("y"), (F.col("user_id") % 10).alias("x"), "user_id", F.col("event_type").alias("band"), F.col("event_id").alias("ti"), t.alias("t"), F.when(F.col("event_id") % 10 != 7, F.col("value")).alias("v"))


def events(spark: SparkSession, sf_dir: str, value: Column | None = None) -> TCube:
    """One band; value: an expression over user_id, t and v."""
    rows = event_rows(spark, sf_dir)
    v = rows if value is None else rows.withColumn("v", value)
    return TCube.from_long(v.drop("band", "y", "x"), bands=["value"], keys=("user_id",))


def event_bands(spark: SparkSession, sf_dir: str) -> TCube:
    """A band for each type of event, on a grid of users ten wide."""
    rows = event_rows(spark, sf_dir)
    return TCube.from_long(rows.drop("user_id"), keys=("y", "x"))


def quantities(spark: SparkSession, sf_dir: str) -> TCube:
    """A series for each supplier and flag of return (the band): quantities at the days of shipping, several a day."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    own = li.select("l_suppkey", F.col("l_returnflag").alias("band"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ti"), (C.fractional_year(F.col("l_shipdate")) - 1995.0).alias("t"), F.col("l_quantity").alias("v"))
    return TCube.from_long(own, keys=("l_suppkey",))


def with_signal() -> Column:
    """The values of events with a step for a third of the users and a slope for another."""
    step = F.when((F.col("user_id") % 3 == 0) & (F.col("t") >= 0.04), 300.0).otherwise(0.0)
    return F.col("v") + step + F.when(F.col("user_id") % 3 == 1, 2000.0 * F.col("t")).otherwise(0.0)


def months(spark: SparkSession, sf_dir: str, step: bool = False) -> TCube:
    """step: from the middle of 1995 on, prices of every second supplier are lower."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    own = li.groupBy("l_suppkey", month.cast("long").alias("ti")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 100.0).alias("v"))
    t = F.col("ti") / 12.0 - 1995.0
    v = F.col("v") - F.when((F.col("l_suppkey") % 2 == 0) & (t >= 0.5), 60000.0).otherwise(0.0) if step else F.col("v")
    return TCube.from_long(own.select("l_suppkey", "ti", t.alias("t"), v.alias("v")), bands=["price"], keys=("l_suppkey",))
