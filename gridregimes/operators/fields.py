"""Operators on fields: rows (variable, time, cell_id, lat, lon, value). A missing value is null or a row that is not there.

``cell_id`` is the integer key of every window and group: one hash by it serves all windows of a job. lat and lon ride
along, one pair for each cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small
from ..functions.storage import stored

CELL = ["variable", "cell_id"]


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def sentinel_to_null(value: Column, *sentinels: float, tolerance: float = 1e-9) -> Column:
    """Null where the value is one of the sentinels."""
    hit = reduce(lambda a, b: a | b, [F.abs(value - s) <= tolerance for s in sentinels], F.lit(False))
    return F.when(~hit, value)


def select_level(df: DataFrame, level: float) -> DataFrame:
    return df.where(F.col("level") == level).drop("level")


def box(df: DataFrame, lon0: float, lon1: float, lat0: float, lat1: float) -> DataFrame:
    """Rows in the box, both ends of both axes included, whatever the order of the bounds."""
    return df.where(F.col("lat").between(min(lat0, lat1), max(lat0, lat1)) & F.col("lon").between(min(lon0, lon1), max(lon0, lon1)))


def years(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of the years, as a range of dates, which reaches the scan."""
    return df.where((F.col("time") >= F.make_date(F.lit(first), F.lit(1), F.lit(1))) & (F.col("time") < F.make_date(F.lit(last + 1), F.lit(1), F.lit(1))))


def season(df: DataFrame, *months: int) -> DataFrame:
    return df.where(F.month("time").isin(*months))


def zero_fill(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.coalesce("value", F.lit(0.0)))


def _complete(df: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose ``key`` has a value for every ``other`` of its variable."""
    all_ = df.groupBy("variable").agg(F.countDistinct(other).alias("n_all"))  # a row for each variable
    whole = df.groupBy("variable", key).agg(F.count("value").alias("n")).join(F.broadcast(all_), "variable").where("n = n_all")
    return df.join(whole.select("variable", key), ["variable", key], "left_semi")


def complete_cells(df: DataFrame) -> DataFrame:
    return _complete(df, "cell_id", "time")


def complete_times(df: DataFrame) -> DataFrame:
    return _complete(df, "time", "cell_id")


def monthly_climatology(df: DataFrame) -> DataFrame:
    """(variable, month, cell_id, lat, lon, value): mean over the values of each calendar month."""
    return df.groupBy("variable", F.month("time").alias("month"), "cell_id").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.avg("value").alias("value"))


def monthly_anomaly(df: DataFrame, standardise: bool = False) -> DataFrame:
    """Value less its cell's mean for the calendar month; with ``standardise`` divided by the population deviation."""
    w = Window.partitionBy(*CELL, F.month("time"))
    out = F.col("value") - F.avg("value").over(w)
    if standardise:
        out = out / F.nullif(F.stddev_pop("value").over(w), F.lit(0.0))
    return df.withColumn("value", out)


def time_mean(df: DataFrame, propagate: bool = True) -> DataFrame:
    """Mean of each cell over time; null if a value is missing and ``propagate``."""
    mean = F.avg("value")
    mean = F.when(F.count("value") == F.count(F.lit(1)), mean) if propagate else mean
    return df.groupBy(*CELL).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), mean.alias("value"))


def monthly_means(df: DataFrame) -> DataFrame:
    """Mean of each cell in each month, dated at the month's last day."""
    month = F.last_day("time").alias("time")
    return df.groupBy("variable", month, "cell_id").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.avg("value").alias("value"))


def low_pass(df: DataFrame, width: int = 10) -> DataFrame:
    """Centred running mean over ``width`` rows of each cell by time; null unless all of them have a value.

    An even width reaches one row further back than ahead: 10 covers rows -5 to 4.
    """
    return low_pass_window(df, CELL, width)


def low_pass_blocks(df: DataFrame, width: int = 10, months: tuple[int, ...] | None = None, block: Column | None = None) -> DataFrame:
    """:func:`low_pass`, by blocks of a cell's history: a task never holds more of it than a block and its borders.

    Blocks are calendar months unless ``block`` says otherwise (a column that does not fall over time). Each block's
    border rows are sent to the blocks that need them, the next ones with rows, however far off. With ``months`` only rows
    of these months are computed and returned; of the other blocks only border rows go on.
    """
    back, ahead = width // 2, (width - 1) // 2
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*CELL, "_block"]
    blocks = df.withColumn("_block", F.trunc("time", "month") if block is None else block)
    sizes = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"))  # a row for each block
    w = Window.partitionBy(*key)
    rows = blocks.repartition(n, *key).withColumns({"_first": F.row_number().over(w.orderBy("time")) - 1, "_last": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("_last", F.col("_last") - 1 - F.col("_first"))  # rows after this one in its block
    wanted = F.month("_block").isin(*months) if months is not None and block is None else F.lit(True)

    def near(reach: int, blocks: Column) -> Column:
        """The next blocks and the rows between them and this one, as long as these are fewer than ``reach``."""
        start = F.struct(F.lit(0).cast("long").alias("gap"), F.array().cast(f"array<struct<to:{'date' if block is None else 'bigint'},gap:bigint>>").alias("to"))

        def add(acc: Column, x: Column) -> Column:
            to = F.when((acc["gap"] < reach) & x["wanted"], F.concat(acc["to"], F.array(F.named_struct(F.lit("to"), x["_block"], F.lit("gap"), acc["gap"])))).otherwise(acc["to"])
            return F.named_struct(F.lit("gap"), acc["gap"] + x["_size"], F.lit("to"), to)

        return F.aggregate(blocks, start, add)["to"]

    one = F.struct("_block", "_size", wanted.alias("wanted"))
    order = Window.partitionBy(*CELL).orderBy("_block")
    later, sooner = F.collect_list(one).over(order.rowsBetween(1, max(back, 1))), F.collect_list(one).over(order.rowsBetween(-max(ahead, 1), -1))
    targets = sizes.select(*key, near(back, later).alias("_later"), near(ahead, F.reverse(sooner)).alias("_sooner"))
    border = rows.where((F.col("_first") < ahead) | (F.col("_last") < back)).join(targets, key)
    to = F.concat(F.filter("_later", lambda x: F.col("_last") + x["gap"] < back), F.filter("_sooner", lambda x: F.col("_first") + x["gap"] < ahead))
    names = df.columns
    lent = border.select(*names, F.explode(F.transform(to, lambda x: x["to"])).alias("_block"), F.lit(False).alias("_own")).repartition(n, *key)
    own = rows.where(wanted).select(*names, "_block", F.lit(True).alias("_own"))
    found = low_pass_window(own.unionByName(lent), key, width)
    return found.where("_own").select(*names)


def low_pass_window(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("time").rowsBetween(-(width // 2), (width - 1) // 2)
    return df.withColumn("value", F.when(F.count("value").over(w) == width, F.avg("value").over(w)))


def anomaly_from_means(df: DataFrame) -> DataFrame:
    """:func:`monthly_anomaly` by a join with the cells' means, which are added up before anything moves."""
    means = df.groupBy(*CELL, F.month("time").alias("_month")).agg(F.avg("value").alias("_mean")).withColumnsRenamed({c: f"_{c}" for c in CELL})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CELL] + [F.month("time") == F.col("_month")]
    return df.join(means, on).withColumn("value", F.col("value") - F.col("_mean")).select(*df.columns)


def seasonal_low_pass_anomaly(df: DataFrame, months: tuple[int, ...] = (6, 7, 8), width: int = 10, drop: str = "cells") -> DataFrame:
    """Anomaly, low pass, then the season's months; gaps dropped last.

    ``drop="cells"`` first leaves out cells that have no value at all, then times that lack a cell; ``"times"`` only the
    times. The low pass goes by blocks: of the other months only border rows and row counts go on.
    """
    out = stored(low_pass_blocks(anomaly_from_means(df), width, months), "low_pass")
    if drop == "cells":
        seen = out.groupBy(*CELL).agg(F.count("value").alias("n")).where("n > 0")
        out = out.join(seen.select(*CELL), CELL, "left_semi")
    return complete_times(out)


def axes(df: DataFrame) -> DataFrame:
    """(axis, place): the different lats and lons, found in one pass over two columns and kept."""
    places = F.array(*[F.struct(F.lit(x).alias("axis"), F.col(x).alias("place")) for x in ("lat", "lon")])
    return stored(df.select(F.explode(places).alias("p")).select("p.*").distinct(), "axes")


def coarsen(df: DataFrame, n: int = 10) -> DataFrame:
    """Mean over blocks of n x n axis places, ragged last blocks left out; coordinates are the blocks' means."""
    w = Window.partitionBy("axis").orderBy("place")  # a row for each place on an axis
    ranked = axes(df).withColumn("block", F.floor((F.row_number().over(w) - 1) / n))
    whole = Window.partitionBy("axis", "block")
    blocks = stored(ranked.select("*", F.count(F.lit(1)).over(whole).alias("n"), F.avg("place").over(whole).alias("mean")).where(F.col("n") == n), "blocks")

    def side(name: str) -> DataFrame:
        own = blocks.where(F.col("axis") == name)
        return small(own.select(F.col("place").alias(name), F.col("block").alias(f"{name}_block"), F.col("mean").alias(f"{name}_mean")), 24, kept=True)

    out = df.join(side("lat"), "lat").join(side("lon"), "lon")
    key = F.col("lat_block") * 1_000_000 + F.col("lon_block")
    return out.groupBy("variable", "time", key.alias("cell_id")).agg(F.first("lat_mean").alias("lat"), F.first("lon_mean").alias("lon"), F.avg("value").alias("value"))


def nearest_regrid(df: DataFrame, lats: DataFrame, lons: DataFrame) -> DataFrame:
    """The field at each target (lat, lon): value of the nearest source place on each axis, beyond the edges too.

    A target halfway between two places takes the lower one. On each axis targets and places stand in one sorted row, and
    a target takes the nearer of the last place before it and the next one; so the field is scanned once more only, for
    two small equi-joins. cell_id becomes the rank of the target place.
    """
    targets = [t.select(F.lit(name).alias("axis"), F.col(name).cast("double").alias("place")).distinct() for name, t in (("lat", lats), ("lon", lons))]
    both = axes(df).withColumn("place", F.col("place").cast("double")).withColumn("target", F.lit(False)).unionByName(targets[0].unionByName(targets[1]).withColumn("target", F.lit(True)))
    w = Window.partitionBy("axis").orderBy("place", "target")
    source = F.when(~F.col("target"), F.col("place"))
    before = F.last(source, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(source, True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    both = both.withColumns({"before": before, "after": after}).where("target")
    lower = F.round(F.col("place") - F.col("before"), 9) <= F.round(F.col("after") - F.col("place"), 9)
    near = F.when(F.col("after").isNull() | lower, F.col("before")).otherwise(F.col("after"))
    matched = stored(both.select("axis", "place", near.alias("near"), (F.row_number().over(Window.partitionBy("axis").orderBy("place")) - 1).alias("rank")), "matched")

    def side(name: str) -> DataFrame:
        own = matched.where(F.col("axis") == name)
        return small(own.select(F.col("near").alias(name), F.col("place").alias(f"{name}_to"), F.col("rank").alias(f"{name}_rank")), 24, kept=True)

    out = df.join(side("lat"), "lat").join(side("lon"), "lon")
    key = (F.col("lat_rank") * 1_000_000 + F.col("lon_rank")).cast("long")
    return out.select("variable", "time", key.alias("cell_id"), F.col("lat_to").alias("lat"), F.col("lon_to").alias("lon"), "value")


def vectors(df: DataFrame) -> DataFrame:
    """(variable, time, features): values of each time in the order of lat and lon; times that lack a cell left out."""
    cells = F.array_sort(F.collect_list(F.struct("lat", "lon", "value")))
    return complete_times(df).groupBy("variable", "time").agg(F.transform(cells, lambda x: x["value"]).alias("features"))


def cell_table(df: DataFrame) -> DataFrame:
    """(variable, place, cell_id, lat, lon): places in a vector, from 0."""
    cells = df.groupBy(*CELL).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"))
    return cells.withColumn("place", F.row_number().over(Window.partitionBy("variable").orderBy("lat", "lon")) - 1)


def from_vectors(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Vectors back as a field; ``cells`` as from :func:`cell_table`."""
    out = rows.select(*[c for c in rows.columns if c != "features"], F.posexplode("features").alias("place", "value"))
    return out.join(cells, ["variable", "place"]).drop("place")


def target_grid(lat0: float, lat1: float, lon0: float, lon1: float, step: float, df: DataFrame) -> DataFrame:
    """(lat, lon) of a regular grid, both ends included."""

    def line(a: float, b: float, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(int(round((b - a) / step))))).alias(name)

    spark = df.sparkSession
    lat = spark.range(1).select(line(lat0, lat1, "i")).select((F.lit(lat0) + F.col("i") * step).alias("lat"))
    lon = spark.range(1).select(line(lon0, lon1, "j")).select((F.lit(lon0) + F.col("j") * step).alias("lon"))
    return lat.crossJoin(F.broadcast(lon))
