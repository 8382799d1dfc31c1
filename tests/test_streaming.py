import datetime as dt

import pytest

from cubespan import errors
from cubespan.streaming import composites


def test_stream_equals_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(k % 3, day + dt.timedelta(hours=7 * k), float("nan") if k % 10 == 7 else float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, v double")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    end = spark.createDataFrame([(9, dt.datetime(2024, 6, 1), 0.0), (9, dt.datetime(2024, 6, 2), 0.0)], "id long, ts timestamp, v double")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = composites.composite(stream, ["id"], "5 days", late="60 days").writeStream.format("memory").queryName("composites").outputMode("append").start()
    try:
        q.processAllAvailable()
        end.write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
        end.write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
        got = {(r.id, r.begin, round(r.t, 9), r.v) for r in spark.table("composites").collect() if r.id != 9}
    finally:
        q.stop()
    want = {(r.id, r.begin, round(r.t, 9), r.v) for r in composites.composite(df, ["id"], "5 days").collect()}
    assert got == want and len(got) > 10


def test_no_median(spark):
    with pytest.raises(errors.InvalidParameter):
        composites.composite(spark.range(1), ["id"], "1 day", "median")
