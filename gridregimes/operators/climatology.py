"""Climatologies that grow by merging: counts, means and squared deviations by cell and calendar month, kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import exists

KEYS = ["variable", "month", "cell_id"]
STATE = "variable string, month int, cell_id long, lat double, lon double, n long, mean double, m2 double, last date"


def state_of(df: DataFrame) -> DataFrame:
    """(variable, month, cell_id, lat, lon, n, mean, m2, last) of a field: values there are, their mean, the sum of squared
    deviations from it, and the last time with a row. Missing values count for nothing but ``last``."""
    m2 = F.var_pop("value") * F.count("value")
    cols = [F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.count("value").alias("n"), F.avg("value").alias("mean"), m2.alias("m2"), F.max("time").alias("last")]
    return df.groupBy("variable", F.month("time").alias("month"), "cell_id").agg(*cols)


def merge_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """The state of both parts' rows together, from their states alone."""
    b = b.select(*[F.col(c).alias(f"_{c}") for c in b.columns])
    both = a.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS], "full")
    na, nb = F.coalesce("n", F.lit(0)), F.coalesce("_n", F.lit(0))
    n, delta = na + nb, F.col("_mean") - F.col("mean")
    mean = F.when(nb == 0, F.col("mean")).when(na == 0, F.col("_mean")).otherwise(F.col("mean") + delta * nb / n)
    m2 = F.when(nb == 0, F.col("m2")).when(na == 0, F.col("_m2")).otherwise(F.col("m2") + F.col("_m2") + delta * delta * na * nb / n)
    either = [F.coalesce(c, f"_{c}").alias(c) for c in (*KEYS, "lat", "lon")]
    return both.select(*either, n.alias("n"), mean.alias("mean"), m2.alias("m2"), F.greatest("last", "_last").alias("last"))


def update_climatology(df: DataFrame, folder: str) -> DataFrame:
    """The state kept in ``folder`` after the rows of ``df`` later than all it has seen are merged; older rows are left out.

    Rows that were merged are never read again, and a year given twice counts once. Each state is a new table beside the
    last one (``v0``, ``v1``, ...), so a job that breaks off leaves the old one; one job at a time may write.
    """
    spark = df.sparkSession
    k = _version(spark, folder)
    if k < 0:
        new = state_of(df)
    else:
        kept = spark.read.schema(STATE).parquet(f"{folder}/v{k}")
        seen = kept.agg(F.max("last")).first()[0]
        new = merge_states(kept, state_of(df.where(F.col("time") > F.lit(seen)) if seen else df))
    new.write.parquet(f"{folder}/v{k + 1}")
    return spark.read.schema(STATE).parquet(f"{folder}/v{k + 1}")


def _version(spark: SparkSession, folder: str) -> int:
    """The last state that was written to its end."""
    k = 0
    while exists(spark, f"{folder}/v{k}/_SUCCESS"):
        k += 1
    return k - 1


def climatology_of(state: DataFrame) -> DataFrame:
    """(variable, month, cell_id, lat, lon, value), as of the whole field."""
    return state.select(*KEYS, "lat", "lon", F.col("mean").alias("value"))


def anomaly_by_state(df: DataFrame, state: DataFrame, standardise: bool = False) -> DataFrame:
    """Value less the state's mean for its cell and month; with ``standardise`` over the population deviation.

    The field meets the state by one equi-join, without a window; a cell and month that the state lacks gives null.
    """
    own = state.select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.col("mean").alias("_mean"), F.sqrt(F.try_divide("m2", F.col("n").cast("double"))).alias("_std"))
    on = [F.col("variable").eqNullSafe(F.col("_variable")), F.col("cell_id").eqNullSafe(F.col("_cell_id")), F.month("time") == F.col("_month")]
    out = F.col("value") - F.col("_mean")
    if standardise:
        out = out / F.nullif(F.col("_std"), F.lit(0.0))
    return df.join(own, on, "left").withColumn("value", out).select(*df.columns)
