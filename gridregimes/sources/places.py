"""Places that keep their number: a stored dictionary of axis codes that only grow, and fields bucketed by cell.

A dictionary is a Parquet folder (axis, place, code). A place that is there keeps its code whatever is read later, so
tables from different reads can be joined by cell_id. One job at a time may add to a dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sizes import small
from ..functions.storage import exists

#: A cell's number is its code of lat times this, plus its code of lon.
ROW = 1 << 31


def coordinate_cell(lat: Column, lon: Column) -> Column:
    """A cell's number by its coordinates alone, in whole millionths of a degree: places nearer than that are one.

    Coordinates that are no degrees (beyond 90 and 360) get a negative number, their hash.
    """
    y, x = F.round((lat + 90) * 1_000_000).cast("long"), F.round((lon + 360) * 1_000_000).cast("long")
    other = F.xxhash64(F.round(lat, 6) + 0.0, F.round(lon, 6) + 0.0)
    return F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 360), y * ROW + x).otherwise(other.bitwiseOR(F.lit(-(1 << 63))))


def update_places(df: DataFrame, folder: str) -> DataFrame:
    """The dictionary in ``folder`` after the places of ``df`` (lat, lon) that it lacks have been added, in ascending order."""
    spark = df.sparkSession
    places = F.array(*[F.struct(F.lit(x).alias("axis"), (F.col(x).cast("double") + 0.0).alias("place")) for x in ("lat", "lon")])
    found = df.select(F.explode(places).alias("p")).select("p.*").where("place IS NOT NULL").distinct()
    stored = _stored(spark, folder)
    top = stored.groupBy("axis").agg((F.max("code") + 1).alias("top"))
    rank = F.row_number().over(Window.partitionBy("axis").orderBy("place")) - 1  # a row for each new place on an axis
    new = found.join(stored, ["axis", "place"], "left_anti").join(top, "axis", "left").select("axis", "place", (rank + F.coalesce("top", F.lit(0))).cast("long").alias("code"))
    new.coalesce(1).write.mode("append").parquet(folder)
    return _stored(spark, folder)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    schema = "axis string, place double, code long"
    return spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)


def with_cells(df: DataFrame, places: DataFrame) -> DataFrame:
    """``df`` (lat, lon) with cell_id by a dictionary that has all of its places."""
    out = df
    for name in ("lat", "lon"):
        codes = places.where(F.col("axis") == name).select(F.col("place").alias(f"{name}_place"), F.col("code").alias(f"{name}_code"))
        out = out.join(small(codes, 16), F.col(name).cast("double") + 0.0 == F.col(f"{name}_place"), "left").drop(f"{name}_place")
    return out.withColumn("cell_id", F.col("lat_code") * ROW + F.col("lon_code")).drop("lat_code", "lon_code")


def write_cells(df: DataFrame, name: str, buckets: int = 64, folder: str | None = None) -> None:
    """A field as the table ``name``, bucketed by cell and sorted by time: one file for each bucket, in ``folder`` if given
    and in the warehouse otherwise.

    Windows and groups of a cell then need no exchange, with whatever else is among their keys.
    """
    writer = df.repartition(buckets, "cell_id").write.mode("overwrite").format("parquet").bucketBy(buckets, "cell_id").sortBy("cell_id", "time")
    (writer.option("path", folder) if folder else writer).saveAsTable(name)
