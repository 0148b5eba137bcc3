"""Annual and monthly series: seasons, counts, correlations, trends. A series is (key columns, year or t, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import by_series, grid_sums, sign_sums
from ..functions.special import binomial_pvalue, correlation_pvalue, erfc, pearson

SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
#: (lag, season of the index, years that its label is moved by) for counts of a summer. The code that these lags come
#: from moves DJF of lag 2 by +1, against what it states; pass +1 to reproduce that.
SEASON_LAGS = [(-2, "DJF", 0), (-1, "MAM", 0), (0, "JJA", 0), (1, "SON", 0), (2, "DJF", -1)]


def season_of(month: Column) -> Column:
    out = None
    for name, months in SEASONS.items():
        out = F.when(month.isin(*months), name) if out is None else out.when(month.isin(*months), name)
    return out


def seasonal_means(index: DataFrame, djf: str = "available") -> DataFrame:
    """(index_name, season, year, value) of monthly (index_name, date, value). December counts in the next year's DJF.

    ``djf="strict"``: a DJF needs all of its three months; ``"available"`` takes those there are.
    """
    rows = index.select("index_name", "value", season_of(F.month("date")).alias("season"), (F.year("date") + (F.month("date") == 12).cast("int")).alias("year"))
    out = rows.groupBy("index_name", "season", "year").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    if djf == "strict":
        out = out.withColumn("value", F.when((F.col("season") != "DJF") | (F.col("n") == 3), F.col("value")))
    return out.drop("n")


def seasons_wide(seasonal: DataFrame) -> DataFrame:
    """(index_name, year, djf, mam, jja, son): the full outer join of the four seasons' tables, in one shuffle; gaps null."""
    cells = [F.max(F.when(F.col("season") == s, F.col("value"))).alias(s.lower()) for s in SEASONS]
    return seasonal.groupBy("index_name", "year").agg(*cells)


def strict_djf(index: DataFrame) -> DataFrame:
    """DJF by the previous year's row of a year-by-month table: (December before + January + February) / 3, else null."""
    months = {m: F.max(F.when(F.month("date") == m, F.col("value"))) for m in (12, 1, 2)}
    wide = index.groupBy("index_name", F.year("date").alias("year")).agg(*(v.alias(f"m{m}") for m, v in months.items()))
    w = Window.partitionBy("index_name").orderBy("year")
    before = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("m12").over(w))
    return wide.select("index_name", "year", ((before + F.col("m1") + F.col("m2")) / 3).alias("value"))


def annual_means(index: DataFrame, first: int, last: int, months: tuple[int, ...] = tuple(range(1, 13)), whole: bool = False) -> DataFrame:
    """(index_name, year, value): mean over the months of each year; with ``whole`` only if all have a value."""
    rows = index.where(F.year("date").between(first, last) & F.month("date").isin(*months))
    out = rows.groupBy("index_name", F.year("date").alias("year")).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return (out.where(F.col("n") == len(months)) if whole else out).drop("n")


def node_year_counts(labels: DataFrame, nodes: int = 9) -> DataFrame:
    """(year, node_id, count) with zeros: every node in every year that has a label."""
    spine = labels.select(F.year("time").alias("year")).distinct().select("year", F.explode(F.sequence(F.lit(1), F.lit(nodes))).alias("node_id"))
    found = labels.groupBy(F.year("time").alias("year"), "node_id").agg(F.count(F.lit(1)).alias("count"))
    return spine.join(found, ["year", "node_id"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def frequent_nodes(counts: DataFrame, p: float = 1 / 9) -> DataFrame:
    """Adds pval: probability of so many days or more of the year's, each being the node's with chance ``p``."""
    days = F.sum("count").over(Window.partitionBy("year"))
    return counts.withColumn("days", days).withColumn("pval", binomial_pvalue(F.col("count"), F.col("days"), p)).drop("days")


def node_frequency(labels: DataFrame) -> DataFrame:
    """(node_id, count, percent of all days)."""
    out = labels.groupBy("node_id").agg(F.count(F.lit(1)).alias("count"))
    return out.withColumn("percent", 100 * F.col("count") / F.sum("count").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def bin_counts(counts: DataFrame, edges: list[int], labels: list[str] | None = None) -> DataFrame:
    """(node_id, bin, label, count): sums over right-open bins of years, zero for bins without years."""
    labels = labels or [f"{a}-{b - 1}" for a, b in zip(edges, edges[1:])]
    bins = F.array(*[F.struct(F.lit(k).alias("bin"), F.lit(x).alias("label")) for k, x in enumerate(labels)])
    where = None
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = (F.col("year") >= a) & (F.col("year") < b)
        where = F.when(inside, k) if where is None else where.when(inside, k)
    sums = counts.groupBy("node_id", where.alias("bin")).agg(F.sum("count").alias("count"))
    spine = counts.select("node_id").distinct().select("node_id", F.explode(bins).alias("b")).select("node_id", "b.*")
    return spine.join(sums, ["node_id", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def bin_text(binned: DataFrame) -> DataFrame:
    """(node_id, decadal_counts): "label:sum;..." with three decimals."""
    cells = F.array_sort(F.collect_list(F.struct("bin", F.format_string("%s:%.3f", "label", F.col("count").cast("double")).alias("s"))))
    return binned.groupBy("node_id").agg(F.array_join(F.transform(cells, lambda x: x["s"]), ";").alias("decadal_counts"))


def confusion(a: DataFrame, b: DataFrame, key: str, values: list[int]) -> DataFrame:
    """Counts of (a's label, b's label) pairs, wide by b's. Both: (key, label)."""
    rows = a.select(key, F.col("label").alias("a")).join(b.select(key, F.col("label").alias("b")), key)
    return rows.groupBy("a").pivot("b", values).count().fillna(0)


def correlate(x: DataFrame, y: DataFrame, x_keys: list[str], y_keys: list[str], on: str = "year", least: int = 5) -> DataFrame:
    """correlation, p_value and N of each pair of an x and a y series over common years; pairs with fewer left out.

    y holds the index series: small, and joined by year.
    """
    rows = x.select(*x_keys, on, F.col("value").alias("x")).join(y.select(*y_keys, on, F.col("value").alias("y")), on).where("x IS NOT NULL AND y IS NOT NULL")
    out = rows.groupBy(*x_keys, *y_keys).agg(pearson(F.col("x"), F.col("y")).alias("correlation"), F.count(F.lit(1)).alias("N")).where(F.col("N") >= least)
    return out.withColumn("p_value", correlation_pvalue(F.col("correlation"), F.col("N")))


def lagged_seasons(seasonal: DataFrame, lags: list[tuple[int, str, int]] = SEASON_LAGS) -> DataFrame:
    """(index_name, lag, season, year, value): each lag's season under the year that it is paired with."""
    spark = seasonal.sparkSession
    table = spark.createDataFrame(lags, "lag int, season string, shift int")
    return seasonal.join(F.broadcast(table), "season").select("index_name", "lag", "season", (F.col("year") + F.col("shift")).alias("year"), "value")


def significant_wide(corr: DataFrame, names: list[str], alpha: float = 0.05) -> DataFrame:
    """node by index: r where p < alpha, else null."""
    return corr.groupBy("node_id").pivot("index_name", names).agg(F.first(F.when(F.col("p_value") < alpha, F.col("correlation"))))


def strong(corr: DataFrame, least: float = 0.3) -> DataFrame:
    return corr.where(F.abs("correlation") > least).orderBy(F.abs("correlation").desc())


def moving_average(series: DataFrame, keys: list[str], width: int = 10, order: str = "year") -> DataFrame:
    """Centred moving average by place; ends without a full window left out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    out = series.withColumn("value", F.when(F.count("value").over(w) == width, F.avg("value").over(w)))
    return out.where("value IS NOT NULL")


def z_score(series: DataFrame, keys: list[str], ddof: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys)
    deviation = F.stddev_samp("value").over(w) if ddof else F.stddev_pop("value").over(w)
    return series.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(w), F.nullif(deviation, F.lit(0.0))))


def with_place(series: DataFrame, keys: list[str], order: str = "year") -> DataFrame:
    """Adds t: place in the series from 0."""
    return series.withColumn("t", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("double"))


def detrend(series: DataFrame, keys: list[str], order: str = "year") -> DataFrame:
    """Value less the least-squares line over its place in the series."""
    rows = with_place(series, keys, order)
    line = rows.groupBy(*keys).agg(F.regr_slope("value", "t").alias("b"), F.regr_intercept("value", "t").alias("a"))
    return rows.join(line, keys).withColumn("value", F.col("value") - (F.col("a") + F.col("b") * F.col("t"))).drop("a", "b", "t")


def lag1(series: DataFrame, keys: list[str], order: str = "year") -> DataFrame:
    """(keys, r1): correlation of the series with itself one row earlier."""
    before = F.lag("value").over(Window.partitionBy(*keys).orderBy(order))
    return series.withColumn("before", before).groupBy(*keys).agg(pearson(F.col("value"), F.col("before")).alias("r1"))


#: Rows of a series up to which one task counts its pairs, and parts of a longer one by time and by value.
LONG, PARTS = 1 << 18, 256


def _number(order: str, kind: str) -> Column:
    """A column of time as a number in the same order."""
    return F.unix_date(order) if kind == "date" else F.unix_micros(order) if kind.startswith("timestamp") else F.col(order)


def _part(x: Column, cuts: Column) -> Column:
    """Twice the number of cuts below ``x``, and one more for a cut's own value: parts in order, equal values together."""
    steps = F.array(*[F.lit(1 << k) for k in range((PARTS - 1).bit_length() - 1, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= F.size(cuts)) & (F.get(cuts, n + step - 1) < x), n + step).otherwise(n))
    return 2 * below + F.coalesce((F.get(cuts, below) == x).cast("int"), F.lit(0))


def sign_sum(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, S) of rows (keys, t, value): pairs of later and higher less pairs of later and lower values, ties left out.

    A task takes whole series, and counts in n log n steps. A series over ``LONG`` rows is cut by time and by value:
    pairs within a part of time and those within a part of value are counted part by part, those within both are taken
    off once, and those within neither come from the table of counts of parts by parts. So no task has more rows of it
    than a part; equal values that many rows share are a part of their own, which has no pairs to count.
    """
    rows = rows.withColumn("t", _number("t", dict(rows.dtypes)["t"]).cast("double"))
    long = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG).select(*[F.col(k).alias(f"_{k}") for k in keys])

    def pairs(values: dict[str, np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.arange(len(bounds) - 1), [sign_sums(values["t"], values["value"], bounds)]

    if not long.limit(1).count():
        return by_series(rows, keys, ["t", "value"], pairs, "S double")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    at = [i / PARTS for i in range(1, PARTS)]
    cuts = rows.join(long, same, "left_semi").groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[F.array_sort(F.array_distinct(F.percentile_approx(x, at))).alias(f"{x}_cuts") for x in ("t", "value")])
    placed = rows.join(cuts, same, "left").drop(*[f"_{k}" for k in keys])
    short = F.col("t_cuts").isNull()
    placed = placed.select(*keys, "t", "value", *[F.when(short, 0).otherwise(_part(F.col(x), F.col(f"{x}_cuts"))).alias(name) for x, name in (("t", "row"), ("value", "col"))], short.alias("short"))
    even = {x: F.col(x) % 2 == 0 for x in ("row", "col")}
    of_row = F.when(F.col("short") | even["row"], F.struct(F.lit(1).alias("sign"), F.when(F.col("short"), -1).otherwise(F.col("row")).alias("r"), F.lit(-1).alias("c")))
    of_col = F.when(~F.col("short") & even["col"], F.struct(F.lit(1).alias("sign"), F.lit(-2).alias("r"), F.col("col").alias("c")))
    of_both = F.when(~F.col("short") & even["row"] & even["col"], F.struct(F.lit(-1).alias("sign"), F.col("row").alias("r"), F.col("col").alias("c")))
    parts = placed.select(*keys, "t", "value", F.inline(F.filter(F.array(of_row, of_col, of_both), lambda x: x.isNotNull())))

    within = by_series(parts, [*keys, "sign", "r", "c"], ["t", "value"], pairs, "s double").select(*keys, (F.col("sign") * F.col("s")).alias("s"))
    table = placed.where("NOT short").groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("count"))
    across = by_series(table, keys, ["row", "col"], grid_sums, "s double")
    return within.unionByName(across).groupBy(*keys).agg(F.sum("s").alias("S"))


def mann_kendall(series: DataFrame, keys: list[str], order: str = "year", alpha: float | None = None) -> DataFrame:
    """S, var_S (ties corrected), Z (continuity corrected), p_value and trend; nulls for fewer than three values.

    S comes from :func:`sign_sum`. trend follows the sign of Z, or is "no trend" for p >= alpha.
    """
    rows = series.where("value IS NOT NULL").select(*keys, F.col(order).alias("t"), "value")
    s = sign_sum(rows, keys)
    ties = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("m"))
    m = F.col("m")
    sizes = ties.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(m * (m - 1) * (2 * m + 5)).alias("tied"))
    n = F.col("n")
    enough = n >= 3
    out = sizes.join(s, keys, "left").withColumn("S", F.when(enough, F.col("S"))).withColumn("var_S", F.when(enough, (n * (n - 1) * (2 * n + 5) - F.col("tied")) / 18))
    z = F.when(F.col("S") > 0, F.try_divide(F.col("S") - 1, F.nullif(F.sqrt("var_S"), F.lit(0.0)))).when(F.col("S") < 0, F.try_divide(F.col("S") + 1, F.nullif(F.sqrt("var_S"), F.lit(0.0)))).when(F.col("S") == 0, 0.0)
    out = out.withColumn("Z", z).withColumn("p_value", erfc(F.abs("Z") / F.sqrt(F.lit(2.0))))
    sign = F.when(F.col("Z") > 0, "increasing").when(F.col("Z") < 0, "decreasing").when(F.col("Z") == 0, "no trend")
    if alpha is not None:
        sign = F.when(F.col("p_value") >= alpha, "no trend").otherwise(sign)
    return out.withColumn("trend", sign).drop("tied")


def ols_trend(series: DataFrame, keys: list[str], order: str = "year") -> DataFrame:
    """slope, intercept, r, p_value and n of the least-squares line over ``order``."""
    x, y = F.col(order).cast("double"), F.col("value")
    out = series.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), pearson(x, y).alias("r"), F.count(y).alias("n"))
    return out.withColumn("p_value", correlation_pvalue(F.col("r"), F.col("n")))


def smoothed_trend(series: DataFrame, keys: list[str], width: int = 10, alpha: float = 0.05, order: str = "year") -> DataFrame:
    """slope, p_value, significant of the moving average; 0, 1 and false where it has three values or fewer."""
    smooth = moving_average(series, keys, width, order)
    found = ols_trend(smooth, keys, order).select(*keys, "slope", "n").join(mann_kendall(smooth, keys, order).select(*keys, "p_value"), keys)
    out = series.select(*keys).distinct().join(found, keys, "left").withColumn("enough", F.coalesce(F.col("n") > 3, F.lit(False)))
    out = out.withColumns({"slope": F.when(F.col("enough"), F.col("slope")).otherwise(0.0), "p_value": F.when(F.col("enough"), F.col("p_value")).otherwise(1.0)})
    return out.select(*keys, "slope", "p_value", (F.col("p_value") < alpha).alias("significant"))
