"""Composites: means of fields over the days of each pattern, at zero and other lags, with tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small
from ..functions.special import pearson, t_pvalue

KEYS = ["variable", "node_id", "cell_id"]


def missing_days(field: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` (or lagged labels) whose day has no row in the field."""
    return labels.join(field.select("time").distinct(), "time", "left_anti")


def _check_days(field: DataFrame, labels: DataFrame) -> None:
    if lost := missing_days(field, labels).select(F.min("time")).first()[0]:
        raise ValueError(f"labelled days are missing in the field, the first of them {lost}")


def _on_days(field: DataFrame, labels: DataFrame, strict: bool) -> DataFrame:
    """The field's rows on the labels' days. Labels of a usual size are broadcast, so the field is not shuffled by day."""
    if strict:
        _check_days(field, labels)
    return field.join(small(labels, 64), "time")


def align(field: DataFrame, labels: DataFrame, strict: bool = False) -> DataFrame:
    """Field rows of labelled days, with node_id. ``strict``: a label day without any field row is an error."""
    return _on_days(field, labels.select("time", "node_id"), strict)


def lagged_labels(labels: DataFrame, lags: DataFrame) -> DataFrame:
    """(node_id, lag_name, lag_days, time): the label day moved by each lag. ``lags`` has a few rows."""
    moved = labels.select("node_id", F.col("time").alias("day")).crossJoin(small(lags, 64))
    return moved.select("node_id", "lag_name", "lag_days", F.date_add("day", F.col("lag_days").cast("int")).alias("time"))


def composite(rows: DataFrame, keys: list[str] = KEYS, least: int = 2) -> DataFrame:
    """n, mean, std (sample) and coordinates by ``keys``; groups of fewer than ``least`` values left out."""
    out = rows.groupBy(*keys).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return out.where(F.col("n") >= least)


def lead_lag(field: DataFrame, labels: DataFrame, lags: DataFrame, least: int = 2, strict: bool = False) -> DataFrame:
    """Composites by node and lag, tested against zero. Days that the field lacks are left out (:func:`missing_days` of
    :func:`lagged_labels` tells them), or an error if ``strict``."""
    rows = _on_days(field, lagged_labels(labels, lags), strict)
    return with_ttest(composite(rows, ["variable", "node_id", "lag_name", "lag_days", "cell_id"], least))


def with_ttest(out: DataFrame, against: str | None = None) -> DataFrame:
    """Adds t and p (two-sided, n - 1 degrees) of the mean against a column or zero; null if nothing varies."""
    mean = F.col("mean") - (F.col(against) if against else F.lit(0.0))
    t = F.try_divide(mean, F.nullif(F.col("std"), F.lit(0.0)) / F.sqrt(F.col("n").cast("double")))
    return out.withColumn("t", t).withColumn("p", t_pvalue(F.col("t"), F.col("n") - 1))


def composite_against_climatology(field: DataFrame, labels: DataFrame, climatology: DataFrame, least: int = 2, strict: bool = False) -> DataFrame:
    """Composites by node with the cell's climatology (variable, cell_id, value) and a test against it; ``strict`` as in :func:`align`."""
    clim = climatology.select("variable", "cell_id", F.col("value").alias("climatology"))
    return with_ttest(composite(align(field, labels, strict), least=least).join(clim, ["variable", "cell_id"]), "climatology")


def composite_against_own_mean(field: DataFrame, labels: DataFrame, least: int = 2, strict: bool = False) -> DataFrame:
    """The same against the cell's mean over all of the field's days, which is read and shuffled once for both.

    A day may have several labels; its rows count once for the cell's mean. Sums are made before the shuffle, so it moves
    a row for each cell and node that a task has seen.
    """
    if strict:
        _check_days(field, labels)
    once = F.row_number().over(Window.partitionBy("time").orderBy("node_id")) == 1
    days = small(labels.select("time", "node_id", once.alias("once"), F.lit(True).alias("labelled")), 64)
    own = F.when(F.coalesce("once", F.lit(True)), F.col("value"))
    cols = [F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.sum(own).alias("_sum"), F.count(own).alias("_count")]
    cell = Window.partitionBy("variable", "cell_id")
    found = field.join(days, "time", "left").groupBy(*KEYS, "labelled").agg(*cols)
    found = found.withColumn("climatology", F.try_divide(F.sum("_sum").over(cell), F.sum("_count").over(cell))).drop("_sum", "_count")
    found = found.where(F.col("labelled") & (F.col("n") >= least)).drop("labelled")
    return with_ttest(found, "climatology")


def significant(out: DataFrame, alpha: float = 0.05) -> DataFrame:
    return out.withColumn("significant", F.col("p") < alpha)


def phase_difference(field: DataFrame, index: DataFrame, threshold: float = 1.0, by: str = "year") -> DataFrame:
    """Mean over positive less mean over negative phase for each cell, with Welch's test. ``index``: (year, value).

    Phases are index >= threshold and <= -threshold. Nulls of either group are left out; a test needs two values in each.
    """
    phase = F.when(F.col("i") >= threshold, 1).when(F.col("i") <= -threshold, -1)
    phases = index.select(F.col(by).alias("y"), F.col("value").alias("i")).select("y", phase.alias("phase")).where("phase IS NOT NULL")
    rows = field.join(phases, F.year("time") == F.col("y"))
    a, b = (F.when(F.col("phase") == s, F.col("value")) for s in (1, -1))
    out = rows.groupBy("variable", "cell_id").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.count(a).alias("n_pos"), F.count(b).alias("n_neg"), F.avg(a).alias("m_pos"), F.avg(b).alias("m_neg"), F.var_samp(a).alias("v_pos"), F.var_samp(b).alias("v_neg"))
    u, v = (F.try_divide(F.col(f"v_{s}"), F.nullif(F.col(f"n_{s}"), F.lit(0))) for s in ("pos", "neg"))
    out = out.withColumns({"difference": F.col("m_pos") - F.col("m_neg"), "t": F.try_divide(F.col("m_pos") - F.col("m_neg"), F.nullif(F.sqrt(u + v), F.lit(0.0)))})
    dof = F.try_divide((u + v) * (u + v), F.nullif(u * u / F.nullif(F.col("n_pos") - 1, F.lit(0)) + v * v / F.nullif(F.col("n_neg") - 1, F.lit(0)), F.lit(0.0)))
    return out.withColumn("dof", dof).withColumn("p", t_pvalue(F.col("t"), F.col("dof")))


def correlation_map(field: DataFrame, index: DataFrame, check_length: bool = True, names: list[str] | None = None) -> DataFrame:
    """Pearson's r of each cell with an index (time, value); null where the cell lacks a value or does not vary.

    ``names``: columns that tell several indices apart; each gives a map. With ``check_length`` the numbers of different times must agree, or ValueError("Time dimension mismatch").
    """
    if check_length:
        times = field.select("time", F.lit(0).alias("side")).unionByName(index.select("time", F.lit(1).alias("side"))).distinct()
        a, b = times.select(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).first()
        if a != b:
            raise ValueError(f"Time dimension mismatch: {a} and {b}")
    names = names or []
    rows = field.join(small(index.select("time", *names, F.col("value").alias("i")), 64), "time")
    r = F.when(F.count("value") == F.count(F.lit(1)), pearson(F.col("value"), F.col("i")))
    return rows.groupBy("variable", *names, "cell_id").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), r.alias("r"), F.count(F.lit(1)).alias("n"))
