"""Readers of monthly climate indices in text files: (index_name, date, value), missing months left out.

Lines are told apart by what they hold, not by number: a data line begins with a year, so preambles, headers and footers
of any length fall away. A value that is no number is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import exists
from ..operators.fields import sentinel_to_null


def _double(token: Column) -> Column:
    return token.try_cast("double")


def _tokens(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "\\t", " ")), r"\s+").alias("w")).where(F.get("w", F.lit(0)).rlike("^[0-9]+$"))


def read_wide(spark: SparkSession, path: str | Sequence[str], least_tokens: int = 2) -> DataFrame:
    """(year, m1..m12) of lines ``YEAR v1 ... v12``; tokens after the 13th are ignored, absent ones null."""
    rows = _tokens(spark, path).where(F.size("w") >= least_tokens)
    return rows.select(F.get("w", F.lit(0)).try_cast("int").alias("year"), *(_double(F.get("w", F.lit(m))).alias(f"m{m}") for m in range(1, 13))).where("year IS NOT NULL")


def read_fixed_width(spark: SparkSession, path: str | Sequence[str], year_width: int = 5, width: int = 7) -> DataFrame:
    """(year, m1..m12) of lines with a year in the first columns and twelve columns of one width."""
    line = F.col("value")
    cells = [_double(F.trim(F.substring(line, year_width + 1 + width * k, width))).alias(f"m{k + 1}") for k in range(12)]
    year = F.trim(F.substring(line, 1, year_width))
    return spark.read.text(path).where(year.rlike("^[0-9]{4}$")).select(year.try_cast("int").alias("year"), *cells)


def wide_to_monthly(wide: DataFrame, name: str, above: float = -900.0, sentinels: Sequence[float] = ()) -> DataFrame:
    """Months with a value over ``above`` that is no sentinel; pass each file's own sentinels, of either sign."""
    cells = F.array(*[F.col(f"m{m}") for m in range(1, 13)])
    rows = wide.select("year", F.posexplode(cells).alias("k", "value"))
    value = sentinel_to_null(F.col("value"), *sentinels)
    rows = rows.select(F.lit(name).alias("index_name"), F.make_date("year", F.col("k") + 1, F.lit(1)).alias("date"), value.alias("value"))
    return rows.where((F.col("value") > above) & ~F.isnan("value"))


def read_long(spark: SparkSession, path: str | Sequence[str], name: str, above: float = -99.0, sentinels: Sequence[float] = ()) -> DataFrame:
    """Lines ``YEAR MONTH VALUE`` after a preamble of any kind."""
    rows = _tokens(spark, path).where(F.get("w", F.lit(0)).rlike("^[0-9]{4}$") & F.get("w", F.lit(1)).rlike("^(0?[1-9]|1[0-2])$"))
    value = sentinel_to_null(_double(F.get("w", F.lit(2))), *sentinels)
    rows = rows.select(F.lit(name).alias("index_name"), F.make_date(F.get("w", F.lit(0)).cast("int"), F.get("w", F.lit(1)).cast("int"), F.lit(1)).alias("date"), value.alias("value"))
    return rows.where((F.col("value") > above) & ~F.isnan("value"))


def read_table(spark: SparkSession, path: str | Sequence[str], name: str, column: int = 4) -> DataFrame:
    """Lines ``YR MON TOTAL ClimAdjust ANOM``: the column of that number, counted from 0."""
    rows = _tokens(spark, path).where(F.get("w", F.lit(1)).rlike("^(0?[1-9]|1[0-2])$"))
    rows = rows.select(F.lit(name).alias("index_name"), F.make_date(F.get("w", F.lit(0)).cast("int"), F.get("w", F.lit(1)).cast("int"), F.lit(1)).alias("date"), _double(F.get("w", F.lit(column))).alias("value"))
    return rows.where("value IS NOT NULL AND NOT isnan(value)")


def read_present(spark: SparkSession, files: dict[str, tuple[str, Callable[[SparkSession, str, str], DataFrame]]]) -> tuple[DataFrame, list[str]]:
    """(rows of all indices whose file is there, names of those without one). ``files``: name to (path, reader), where a
    reader takes (spark, path, name). Without any file there are no rows."""
    parts, missing = [], []
    for name, (path, reader) in files.items():
        if exists(spark, path):
            parts.append(reader(spark, path, name).select("index_name", "date", "value"))
        else:
            missing.append(name)
    out = spark.createDataFrame([], "index_name string, date date, value double")
    for x in parts:
        out = out.unionByName(x)
    return out, missing
