"""Readers and writers of fields, labels and result tables, in formats that Spark reads and writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import exists
from ..operators.fields import nan_to_null
from .places import coordinate_cell, update_places, with_cells

LABELS = ["time", "bmu_i", "bmu_j", "node_id", "year", "month"]


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that are there, in any store Spark reads."""
    return [p for p in paths if exists(spark, p)]


def read_field(spark: SparkSession, paths: Sequence[str], variable: str, prefer: Sequence[str] = (), places: str | None = None) -> DataFrame:
    """(variable, time, [level,] cell_id, lat, lon, value) of Parquet files of one variable, one row for each time and cell.

    Files that are missing are skipped; none at all is a FileNotFoundError. The value column is the first preferred name
    that is there, else the first column that is no coordinate. NaN becomes null. Unless the files have a cell_id, it
    comes from the dictionary in the folder ``places``, which learns new places, or else from the coordinates alone; so a
    place has one cell_id whatever files are read together. Rows of one time and place are one.
    """
    there = existing(spark, paths)
    if not there:
        raise FileNotFoundError(f"no file of {variable} among {len(paths)}")
    df = spark.read.parquet(*there)
    axes = [c for c in ("time", "level", "cell_id", "lat", "lon") if c in df.columns]
    name = next((c for c in prefer if c in df.columns), None) or next(c for c in df.columns if c not in axes)
    out = df.select(F.lit(variable).alias("variable"), *(F.col(c).cast("date") if c == "time" else F.col(c) for c in axes), F.col(name).cast("double").alias("value"))
    if "cell_id" not in axes:
        out = with_cells(out, update_places(out, places)) if places else out.withColumn("cell_id", coordinate_cell(F.col("lat"), F.col("lon")))
        out = out.select("variable", *[c for c in ("time", "level") if c in axes], "cell_id", "lat", "lon", "value")
    return nan_to_null(out, "value").dropDuplicates(["variable", *(c for c in ("time", "level", "cell_id", "lat", "lon") if c in out.columns)])


def write_field(df: DataFrame, path: str) -> None:
    df.withColumn("year", F.year("time")).repartition("variable", "year").write.mode("overwrite").partitionBy("variable", "year").parquet(path)


def read_checked_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> DataFrame:
    """A CSV table with a header; ValueError naming the required columns it lacks."""
    header = spark.read.option("header", True).csv(path).columns
    if lost := [c for c in required if c not in header]:
        raise ValueError(f"{path} lacks {', '.join(lost)}")
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_checked_csv(spark, path, "time date, bmu_i int, bmu_j int, node_id int, year int, month int", LABELS)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def label_table(assigned: DataFrame) -> DataFrame:
    """Assignments (time, node_id, bmu_i, bmu_j) with the columns that label files have."""
    return assigned.select("time", "bmu_i", "bmu_j", "node_id", F.year("time").alias("year"), F.month("time").alias("month"))


def dated_labels(labels: DataFrame, first: str, last: str, months: tuple[int, ...] = (6, 7, 8)) -> DataFrame:
    """(time, node_id) of labels (place from 1, node_id) that lack dates: the place counts days of the season.

    ValueError if there are not as many labels as days.
    """
    spark = labels.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("time")).where(F.month("time").isin(*months))
    days = days.withColumn("place", F.row_number().over(Window.orderBy("time")))  # days of some decades
    if (a := days.count()) != (b := labels.count()):
        raise ValueError(f"{b} labels for {a} days")
    return labels.join(F.broadcast(days), "place").select("time", "node_id")
