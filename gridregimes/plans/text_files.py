"""Index series written as the text files that climate services publish, for the readers of gridregimes.sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import folder


def _write(lines: DataFrame, name: str, header: str, footer: str) -> list[tuple[str, str]]:
    """One folder for each index, with a header and a footer of text around the lines."""
    path = folder(lines.sparkSession, name)
    lines = lines.select("index_name", "line")
    names = [r[0] for r in lines.select("index_name").distinct().orderBy("index_name").collect()]  # a few
    around = lines.select("index_name").distinct().select("index_name", F.explode(F.array(F.lit(header), F.lit(footer))).alias("line"))
    lines.unionByName(around).write.partitionBy("index_name").text(path)
    from urllib.parse import quote

    return [(n, f"{path}/index_name={quote(n, safe=' ')}") for n in names]


def _wide(index: DataFrame, cell: Column, missing: str, glue: str) -> DataFrame:
    months = [F.coalesce(F.max(F.when(F.month("date") == m, cell)), F.lit(missing)) for m in range(1, 13)]
    rows = index.groupBy("index_name", F.year("date").alias("year")).agg(F.array(*months).alias("cells"))
    return rows.select("index_name", F.concat(F.col("year").cast("string"), F.lit(glue), F.array_join("cells", glue)).alias("line"))


def write_wide(index: DataFrame) -> list[tuple[str, str]]:
    return _write(_wide(index, F.format_string("%.3f", F.round("value", 3)), "-999.9", "  "), "wide", "Years 1990 to 2001", "  -999.9\nMissing values: -999.9")


def write_fixed(index: DataFrame) -> list[tuple[str, str]]:
    cell = F.lpad(F.format_string("%.2f", F.round("value", 2)), 7, " ")
    rows = _wide(index, cell, " -999.9", "")
    return _write(rows.withColumn("line", F.concat(F.lit(" "), "line")), "fixed", " YEAR   DJF    JFM", "  footer\n 2 lines")


def write_long(index: DataFrame) -> list[tuple[str, str]]:
    line = F.format_string("%d %d %.3f", F.year("date"), F.month("date"), F.round("value", 3))
    return _write(index.select("index_name", line.alias("line")), "long", "An index of 12 months\nYEAR MONTH INDEX", "2050 1 -99.90")


def write_table(index: DataFrame) -> list[tuple[str, str]]:
    line = F.format_string(" %d %2d 0.0 1.0 %.3f", F.year("date"), F.month("date"), F.round("value", 3))
    return _write(index.select("index_name", line.alias("line")), "table", "YR MON TOTAL ClimAdjust ANOM", "")
