"""Exact percentiles of groups of any size: histograms narrow down where the wanted ranks are, so no task holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Steps of a histogram, and values of a group that are few enough to be looked at one by one.
STEPS, FEW = 1024, 1 << 17


def exact_percentile(rows: DataFrame, keys: list[str], value: str, q: float, name: str = "percentile") -> DataFrame:
    """(keys, ``name``): the percentile with linear interpolation, the same to the last digit as Spark's ``percentile``.

    A pass counts values by step of each group's range and keeps, for the step that has the wanted rank, its least and
    greatest value as the next range; passes go on until a range has ``FEW`` values at most or a single one, two or three
    in all. Nulls are left out; a group without values has a null.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("v"))
    position = F.lit(q) * (F.col("n") - 1)
    state = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = state.select(*keys, "n", position.alias("position"), F.floor(position).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "low", "high", F.lit(None).cast("double").alias("x0"), F.lit(None).cast("double").alias("x1"))
    state = stored(state, "ranks")
    while (wide := state.where(F.col("x0").isNull() & (F.col("inside") > FEW) & (F.col("low") < F.col("high")))).limit(1).count():
        state = stored(_narrowed(rows, state, wide, keys), "ranks")
    rest = state.where("x0 IS NULL AND inside > 0")
    each = _within(rows, rest, keys).groupBy(*keys, "v", "rank", "below").agg(F.count(F.lit(1)).alias("m"))
    upto = F.col("below") + F.sum("m").over(Window.partitionBy(*keys).orderBy("v"))
    each = each.withColumn("upto", upto)
    last = each.groupBy(*keys).agg(F.min(F.when(F.col("upto") > F.col("rank"), F.col("v"))).alias("x0"), F.min(F.when(F.col("upto") > F.col("rank") + 1, F.col("v"))).alias("x1"))
    found = state.where("x0 IS NOT NULL").select(*keys, "x0", "x1").unionByName(last)
    own = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("x0").alias("_x0"), F.coalesce("x1", "x0").alias("_x1"))
    out = state.join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    between = (F.col("rank") + 1 - F.col("position")) * F.col("_x0") + (F.col("position") - F.col("rank")) * F.col("_x1")
    same = (F.col("position") == F.col("rank")) | (F.col("_x0") == F.col("_x1"))
    return out.select(*keys, F.when(same, F.col("_x0")).otherwise(between).alias(name))


def _within(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in their group's range. Spark knows the size of the stored ranges, and broadcasts them where they are small."""
    own = state.select(*[F.col(k).alias(f"_{k}") for k in keys], "low", "high", "rank", "below")
    return rows.join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("v").between(F.col("low"), F.col("high"))]).drop(*[f"_{k}" for k in keys])


def _narrowed(rows: DataFrame, state: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """The state after one pass over the groups of ``wide``."""
    step = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * STEPS), F.lit(STEPS - 1))
    counts = _within(rows, wide, keys).groupBy(*keys, "rank", "below", step.alias("step")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
    w = Window.partitionBy(*keys).orderBy("step")  # a row for each step
    counts = counts.withColumns({"before": F.col("below") + F.sum("m").over(w) - F.col("m"), "next": F.lead("least").over(w)})
    chosen = counts.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("m")))
    ends = F.col("before") + F.col("m") == F.col("rank") + 1  # the next rank is the next step's least value
    chosen = chosen.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("before").alias("_below"), F.col("m").alias("_inside"), F.col("least").alias("_low"), F.col("most").alias("_high"), F.when(ends, F.col("most")).alias("_x0"), F.when(ends, F.col("next")).alias("_x1"))
    out = state.join(chosen, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return out.select(*keys, "n", "position", "rank", *[F.coalesce(f"_{c}", c).alias(c) for c in ("below", "inside", "low", "high")], *[F.coalesce(f"_{c}", c).alias(c) for c in ("x0", "x1")])
