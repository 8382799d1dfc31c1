"""Single series in CSV and JSON files, and JSON reports."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|infinity)", re.IGNORECASE)


def parse_value(field: str) -> float:
    """A number, or NaN for whatever isn't one."""
    return float(field) if _NUMBER.fullmatch(field) else math.nan


def _rows(text: str) -> list[tuple[int, list[str]]]:
    """Line numbers and trimmed fields of the lines that aren't blank; lines end with LF or CRLF only."""
    cut = [(k, [f.strip() for f in line.split(",")]) for k, line in enumerate(re.split(r"\r?\n", text), 1)]
    return [(k, fields) for k, fields in cut if fields != [""]]


def parse_series(text: str) -> tuple[list[float], list[float]]:
    """Times and values of a CSV text.

    One column holds values, at the times 0, 1, 2 and so on; two hold times and values. Blank lines don't count.
    The first line is a header if none of its fields is a number or empty. Values that aren't numbers are missing;
    a time that isn't one is an error, and so is a text without data.
    """
    rows = _rows(text)
    if rows and rows[0][0] == 1 and all(f and math.isnan(parse_value(f)) for f in rows[0][1]):
        del rows[0]
    if not rows:
        raise ValueError("the text has no line of data")
    for number, fields in rows:
        if len(fields) > 2:
            raise ValueError(f"{len(fields)} columns in line {number}, where one or two can be")
        if len(fields) == 2 and math.isnan(parse_value(fields[0])):
            raise ValueError(f"the time {fields[0]!r} in line {number} is no number")
    times = [parse_value(fields[0]) if len(fields) == 2 else float(k) for k, (_, fields) in enumerate(rows)]
    return times, [parse_value(fields[-1]) for _, fields in rows]


def _value(field: Column) -> Column:
    word = F.lower(field)
    infinite = F.when(word.isin("-inf", "-infinity"), F.lit(float("-inf"))).when(word.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
    return F.when(field.rlike(NUMBER), F.coalesce(infinite, field.try_cast("double")))


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, ti, t, v) of all CSV files of path, one series each, with the rules of parse_series(). Bad lines and files without data fail when they are read; Spark leaves out files of no bytes, so these give no series."""
    return parsed(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def parsed(texts: DataFrame) -> DataFrame:
    """(file, ti, t, v) of whole CSV texts (file, value). A file is parsed as one array, so nothing is shuffled."""
    trim = lambda f: F.regexp_replace(f, r"(?U)^\s+|\s+$", "")
    line = lambda s, k: F.struct(k.alias("line"), F.transform(F.split(s, ",", -1), trim).alias("f"))
    cut = F.filter(F.transform(F.split(F.coalesce("value", F.lit("")), r"\r?\n", -1), line), lambda r: ~((F.size(r["f"]) == 1) & (r["f"][0] == "")))
    known = F.transform(cut, lambda r: F.struct(r["line"].alias("line"), r["f"].alias("f"), F.transform(r["f"], _value).alias("x")))
    header = lambda r: (r["line"] == 0) & F.forall(r["x"], lambda x: x.isNull()) & F.forall(r["f"], lambda f: f != "")
    files = texts.select("file", F.filter(known, lambda r: ~header(r)).alias("rows"))
    empty = F.raise_error(F.concat(F.lit("no line of data in "), F.col("file").cast("string"))).cast(files.schema["rows"].dataType)
    own = files.select("file", F.posexplode(F.when(F.size("rows") > 0, F.col("rows")).otherwise(empty)).alias("ti", "r")).select("file", "ti", "r.*")
    at = F.concat(F.lit(" in line "), F.col("line") + 1)
    wide = F.raise_error(F.concat(F.size("f"), F.lit(" columns"), at, F.lit(", where one or two can be"))).cast("double")
    untimed = F.raise_error(F.concat(F.lit("the time '"), F.col("f")[0], F.lit("'"), at, F.lit(" is no number"))).cast("double")
    t = F.when(F.size("f") == 1, F.col("ti").cast("double")).when(F.size("f") > 2, wide).when(F.col("x")[0].isNull(), untimed).otherwise(F.col("x")[0])
    return own.select("file", "ti", t.alias("t"), F.element_at("x", -1).alias("v"))


def read_series_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, ti, t, v) of JSON files {"t": [...], "y": [...]}; null is missing."""
    own = spark.read.schema("t array<double>, y array<double>").option("multiLine", True).json(path)
    own = own.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.arrays_zip("t", "y")).alias("ti", "p"))
    return own.select("file", "ti", F.col("p.t").alias("t"), F.col("p.y").alias("v"))


def plain(x: object) -> object:
    """x as JSON takes it: numbers that are not finite become null."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, list | tuple) else x


def report(x: dict) -> str:
    return json.dumps(plain(x), indent=2)


def report_column(*columns: str) -> Column:
    """The columns as one JSON text; numbers that aren't finite have to be null already."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
