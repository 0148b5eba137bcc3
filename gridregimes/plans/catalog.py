"""Queries of the library over the driver's tables, and the same in SQL for DuckDB.

Computed numbers are rounded on both sides, so that the order of additions does not show. Trained and searched results
(maps, clusters, fitted models, kriging) have no SQL; tests hold them against closed forms.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.storage import folder, stored
from ..operators import climatology, composites, fields, kriging, patterns, series, spectra
from ..sources import indices as index_files
from ..sources import places, tables
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "t1_composite_ttest"
#: The eleven lags in days, out to a year either way.
LAGS = [("m365", -365), ("m180", -180), ("m90", -90), ("m60", -60), ("m30", -30), ("zero", 0), ("p30", 30), ("p60", 60), ("p90", 90), ("p180", 180), ("p365", 365)]
EDGES = [1995, 1997, 1999, 2001, 2002]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def out(df: DataFrame, *keys: str, **places: int) -> DataFrame:
    """The key columns, and the others rounded to so many places."""
    return df.select(*keys, *(F.round(c, n).alias(c) for c, n in places.items()))


# Sources and sinks


@query(f"WITH {fx.SQL_INDEX} SELECT index_name, date, round(value, 3) AS value FROM index_ WHERE round(value, 3) > -900")
def io4_wide_text(spark, sf_dir):
    """Each index written as lines of a year and twelve months, and read back (IO4, IO5)."""
    from .text_files import write_wide

    parts = [index_files.wide_to_monthly(index_files.read_wide(spark, path), name, sentinels=(-99.9, 99.9)) for name, path in write_wide(fx.indices(spark, sf_dir))]
    return union(parts)


@query(f"WITH {fx.SQL_INDEX} SELECT index_name, date, round(value, 3) AS value FROM index_ WHERE round(value, 3) > -99")
def io6_long_text(spark, sf_dir):
    """Each index written as lines of year, month, value after a preamble, and read back (IO6, IO7)."""
    from .text_files import write_long

    return union([index_files.read_long(spark, path, name) for name, path in write_long(fx.indices(spark, sf_dir))])


@query(f"WITH {fx.SQL_INDEX} SELECT index_name, date, round(value, 3) AS value, FALSE AS missing FROM index_ WHERE round(value, 3) > -99 UNION ALL SELECT unnest(['NAO', 'SOI']), NULL, NULL, TRUE")
def io6_present_indices(spark, sf_dir):
    """Index files that are there, and the names of two that are not (IO6, S1)."""
    from .text_files import write_long

    files = {name: (path, index_files.read_long) for name, path in write_long(fx.indices(spark, sf_dir))}
    files |= {name: (f"{folder(spark, 'none')}/{name}", index_files.read_long) for name in ("NAO", "SOI")}
    found, missing = index_files.read_present(spark, files)
    lost = spark.createDataFrame([(x,) for x in missing], "index_name string").select("index_name", F.lit(None).cast("date").alias("date"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("missing"))
    return found.withColumn("missing", F.lit(False)).unionByName(lost)


@query(f"WITH {fx.SQL_INDEX} SELECT index_name, date, round(value, 3) AS value FROM index_")
def io8_table_text(spark, sf_dir):
    """Each index written as the last of five columns, and read back (IO8)."""
    from .text_files import write_table

    return union([index_files.read_table(spark, path, name) for name, path in write_table(fx.indices(spark, sf_dir))])


@query(f"WITH {fx.SQL_INDEX} SELECT index_name, date, round(value, 2) AS value FROM index_ WHERE round(value, 2) > -900")
def io9_fixed_width_text(spark, sf_dir):
    """Each index written in columns of fixed width, and read back (IO9)."""
    from .text_files import write_fixed

    return union([index_files.wide_to_monthly(index_files.read_fixed_width(spark, path), name) for name, path in write_fixed(fx.indices(spark, sf_dir))])


@query(f"WITH {fx.sql_field()} SELECT variable, time, lat, lon, round(value, 6) AS value FROM field WHERE year(time) BETWEEN 1996 AND 1997")
def io1_yearly_files(spark, sf_dir):
    """The field written by year, and read from the files of two years, one that is missing left out (IO1 to IO3)."""
    path = folder(spark, "field")
    tables.write_field(fx.field(spark, sf_dir), path)
    found = tables.read_field(spark, [f"{path}/variable=quantity/year={y}" for y in (1996, 1997, 1890)], "quantity", ["uwnd", "u"])
    return out(found, "variable", "time", "lat", "lon", value=6)


_W1 = "CAST(round(CAST(round(value, 9) AS DECIMAL(18, 9)), 6) AS DOUBLE) AS value"
_LOW = "a AS (SELECT time, cell_id, value - avg(value) OVER (PARTITION BY cell_id, month(time)) AS value FROM field), l AS (SELECT time, cell_id, CASE WHEN count(value) OVER w = 10 THEN avg(value) OVER w END AS value FROM a WINDOW w AS (PARTITION BY cell_id ORDER BY time ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))"
_PLACES = ", ".join(f"{x}_c AS (SELECT {x}, row_number() OVER (ORDER BY sooner DESC, {x}) - 1 AS code FROM (SELECT {x}, bool_or(year(time) <= mid) AS sooner FROM field, h GROUP BY {x}))" for x in ("lat", "lon"))


@query(f"WITH {fx.sql_field()}, h AS (SELECT (min(year(time)) + max(year(time))) // 2 AS mid FROM field), {_PLACES}, {_LOW}, k AS (SELECT DISTINCT cell_id AS old, lat, lon FROM field) SELECT time, CAST(lat_c.code * 2147483648 + lon_c.code AS BIGINT) AS cell_id, {_W1} FROM l JOIN k ON cell_id = old JOIN lat_c ON k.lat = lat_c.lat JOIN lon_c ON k.lon = lon_c.lon")
def io3_bucketed_cells(spark, sf_dir):
    """The field without cell numbers, read in two halves with one dictionary of places, kept as a table bucketed by cell;
    its anomaly and low pass need no exchange (IO1 to IO3, A2, W1)."""
    import uuid

    df = fx.field(spark, sf_dir)
    path, known, name = folder(spark, "field"), folder(spark, "places"), f"cells_{uuid.uuid4().hex[:12]}"
    tables.write_field(df.drop("cell_id"), path)
    all_years = sorted(r[0] for r in spark.read.parquet(path).select("year").distinct().collect())  # a row for each year
    mid = (all_years[0] + all_years[-1]) // 2 if all_years else 0
    halves = [[f"{path}/variable=quantity/year={y}" for y in all_years if (y <= mid) == first] for first in (True, False)]
    found = union([tables.read_field(spark, x, "quantity", places=known) for x in halves if x])
    places.write_cells(found, name, 8, folder(spark, "cells"))
    atexit.register(lambda: _drop_table(spark, name))
    low = fields.low_pass(fields.monthly_anomaly(spark.table(name)))
    return low.select("time", "cell_id", F.round(F.round("value", 9).cast("decimal(18,9)"), 6).cast("double").alias("value"))


def _drop_table(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the JVM has gone already
        pass


@query(f"WITH {fx.SQL_LABELS} SELECT time, CAST((node_id - 1) % 3 + 1 AS INTEGER) AS bmu_i, CAST((node_id - 1) // 3 + 1 AS INTEGER) AS bmu_j, node_id, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month FROM labels_")
def io10_label_file(spark, sf_dir):
    """Labels written as CSV, and read back with their columns checked (IO10, IO11)."""
    own = fx.labels(spark, sf_dir).withColumns({"bmu_i": ((F.col("node_id") - 1) % 3 + 1).cast("int"), "bmu_j": (F.floor((F.col("node_id") - 1) / 3) + 1).cast("int")})
    path = folder(spark, "labels")
    tables.write_table(tables.label_table(own), path, "csv")
    return tables.read_labels(spark, path)


@query(f"WITH {fx.SQL_DAYS}, s AS (SELECT time, row_number() OVER (ORDER BY time) AS place FROM (SELECT CAST(unnest(generate_series(DATE '1950-01-01', DATE '2149-12-31', INTERVAL 1 DAY)) AS DATE) AS time) WHERE month(time) IN (6, 7, 8)), d AS (SELECT row_number() OVER (ORDER BY time) AS place FROM days) SELECT s.time, CAST(place % 9 + 1 AS INTEGER) AS node_id FROM s JOIN d USING (place)")
def io12_dated_labels(spark, sf_dir):
    """Labels that only have a place, given the days of as many summers from 1950 on as there are labels (IO12)."""
    from datetime import date, timedelta

    from pyspark.sql import Window

    days = fx.labels(spark, sf_dir).select(F.row_number().over(Window.orderBy("time")).alias("place"))  # a row for each day
    summers, more = divmod(days.count() - 1, 92)
    last = date(1950 + summers, 6, 1) + timedelta(more)
    return tables.dated_labels(days.withColumn("node_id", (F.col("place") % 9 + 1).cast("int")), "1950-01-01", str(last))


# Fields


@query(f"WITH {fx.sql_field()} SELECT time, cell_id, round(value, 6) AS value FROM field WHERE lat BETWEEN -10 AND 60 AND lon BETWEEN 100 AND 160 AND month(time) IN (6, 7, 8) AND year(time) BETWEEN 1996 AND 2000")
def f2_box_years_season(spark, sf_dir):
    """box, years and season; F1 by a level column."""
    df = fields.select_level(fx.field(spark, sf_dir).withColumn("level", F.lit(850.0)), 850.0)
    return out(fields.season(fields.years(fields.box(df, 100, 160, 60, -10), 1996, 2000), 6, 7, 8), "time", "cell_id", value=6)


@query(f"WITH {fx.SQL_INDEX} SELECT index_name, date, round(CASE WHEN month(date) = 3 THEN NULL ELSE value END, 4) AS value, round(coalesce(CASE WHEN month(date) = 3 THEN NULL ELSE value END, 0), 4) AS filled FROM index_")
def f5_sentinel(spark, sf_dir):
    """a sentinel becomes null, and null 0."""
    df = fx.indices(spark, sf_dir).withColumn("value", F.when(F.month("date") == 3, -99.9).otherwise(F.col("value")))
    df = df.withColumn("value", fields.sentinel_to_null(F.col("value"), -99.9, 99.9))
    both = fields.zero_fill(df.withColumn("kept", F.col("value"))).select("index_name", "date", F.col("kept").alias("value"), F.col("value").alias("filled"))
    return out(both, "index_name", "date", value=4, filled=4)


@query(f"WITH {fx.sql_field(by='week')}, c AS (SELECT cell_id FROM field GROUP BY cell_id HAVING count(value) = (SELECT count(DISTINCT time) FROM field)), t AS (SELECT time FROM field GROUP BY time HAVING count(value) = (SELECT count(DISTINCT cell_id) FROM field)) SELECT 'cells' AS kept, count(*) AS n_rows, round(coalesce(sum(value), 0), 4) AS total FROM field WHERE cell_id IN (SELECT cell_id FROM c) UNION ALL SELECT 'times', count(*), round(coalesce(sum(value), 0), 4) FROM field WHERE time IN (SELECT time FROM t)")
def f8_complete(spark, sf_dir):
    """F8: cells present at all times, times present in all cells."""
    df = fx.field(spark, sf_dir, by="week")
    kinds = {"cells": fields.complete_cells(df), "times": fields.complete_times(df)}
    return union([x.agg(F.lit(k).alias("kept"), F.count(F.lit(1)).alias("n_rows"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total")) for k, x in kinds.items()])


@query(f"WITH {fx.sql_field(by='week')}, t AS (SELECT time FROM field GROUP BY time HAVING count(value) = (SELECT count(DISTINCT cell_id) FROM field)) SELECT time, cell_id, lat, lon, round(value, 6) AS value FROM field WHERE time IN (SELECT time FROM t)")
def f12_vectors_and_back(spark, sf_dir):
    """one vector for each whole week, and the field back."""
    df = fx.field(spark, sf_dir, by="week")
    return out(fields.from_vectors(fields.vectors(df), fields.cell_table(df)), "time", "cell_id", "lat", "lon", value=6)


@query(f"WITH {fx.sql_field()} SELECT CAST(month(time) AS INTEGER) AS month, cell_id, lat, lon, round(avg(value), 6) AS value FROM field GROUP BY ALL")
def a1_climatology(spark, sf_dir):
    return out(fields.monthly_climatology(fx.field(spark, sf_dir)), "month", "cell_id", "lat", "lon", value=6)


@query(f"WITH {fx.sql_field()} SELECT time, cell_id, round(value - avg(value) OVER (PARTITION BY cell_id, month(time)), 6) AS value FROM field")
def a2_anomaly(spark, sf_dir):
    """A2, J5. Some anomalies end in a 5 at the seventh place exactly; rounded as decimals, without the last bits that the
    order of additions leaves, they come out the same in every run. In SQL these bits decide."""
    found = fields.monthly_anomaly(fx.field(spark, sf_dir))
    return found.select("time", "cell_id", F.round(F.round("value", 12).cast("decimal(24,12)"), 6).cast("double").alias("value"))


@query(f"WITH {fx.sql_field()} SELECT time, cell_id, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) AS value FROM field WINDOW w AS (PARTITION BY cell_id, month(time))")
def a3_standardised_anomaly(spark, sf_dir):
    return out(fields.monthly_anomaly(fx.field(spark, sf_dir), standardise=True), "time", "cell_id", value=6)


@query(f"WITH {fx.sql_field()} SELECT time, cell_id, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) AS value FROM field WINDOW w AS (PARTITION BY cell_id, month(time))")
def a3_merged_climatology(spark, sf_dir):
    """A1 to A3 by a stored climatology to which one year after the other is merged, without reading those before."""
    df = stored(fx.field(spark, sf_dir), "field")
    path = folder(spark, "climatology")
    state = None
    for year in sorted(r[0] for r in df.select(F.year("time")).distinct().collect()):  # a few years
        state = climatology.update_climatology(fields.years(df, year, year), path)
    state = climatology.update_climatology(df, path) if state is None else state
    return out(climatology.anomaly_by_state(df, state, standardise=True), "time", "cell_id", value=6)


@query(f"WITH {fx.sql_field()} SELECT cell_id, lat, lon, round(CASE WHEN count(value) = count(*) THEN avg(value) END, 6) AS value FROM field GROUP BY ALL")
def a4_time_mean(spark, sf_dir):
    return out(fields.time_mean(fx.field(spark, sf_dir)), "cell_id", "lat", "lon", value=6)


@query(f"WITH {fx.sql_field()}, m AS (SELECT last_day(time) AS time, cell_id, avg(value) AS value FROM field GROUP BY ALL) SELECT time, cell_id, round(value - avg(value) OVER (PARTITION BY cell_id, month(time)), 6) AS value FROM m")
def a5_monthly_anomaly(spark, sf_dir):
    return out(fields.monthly_anomaly(fields.monthly_means(fx.field(spark, sf_dir))), "time", "cell_id", value=6)


@query(f"WITH {fx.sql_field()}, la AS (SELECT lat, (row_number() OVER (ORDER BY lat) - 1) // 2 AS b FROM (SELECT DISTINCT lat FROM field)), lo AS (SELECT lon, (row_number() OVER (ORDER BY lon) - 1) // 2 AS b FROM (SELECT DISTINCT lon FROM field)), lb AS (SELECT b, avg(lat) AS lat FROM la GROUP BY b HAVING count(*) = 2), ob AS (SELECT b, avg(lon) AS lon FROM lo GROUP BY b HAVING count(*) = 2) SELECT field.time, CAST(lb.b * 1000000 + ob.b AS BIGINT) AS cell_id, lb.lat, ob.lon, round(avg(value), 6) AS value FROM field JOIN la ON field.lat = la.lat JOIN lo ON field.lon = lo.lon JOIN lb ON la.b = lb.b JOIN ob ON lo.b = ob.b GROUP BY ALL")
def a6_coarsen(spark, sf_dir):
    return out(fields.coarsen(fx.field(spark, sf_dir), 2), "time", "cell_id", "lat", "lon", value=6)


@query(f"WITH {fx.sql_field()}, {_LOW} SELECT time, cell_id, {_W1} FROM l")
def w1_low_pass_blocks(spark, sf_dir):
    """W1 by blocks of months with borders lent to the next ones: a cell's history is not one task."""
    found = fields.low_pass_blocks(fields.anomaly_from_means(fx.field(spark, sf_dir)))
    return found.select("time", "cell_id", F.round(F.round("value", 9).cast("decimal(18,9)"), 6).cast("double").alias("value"))


@query(f"WITH {fx.sql_field()}, {_LOW} SELECT time, cell_id, {_W1} FROM l")
def w1_low_pass(spark, sf_dir):
    """W1. Many means end in a 5 at the seventh place exactly, so they are rounded as decimals, which has one law everywhere."""
    found = fields.low_pass(fields.monthly_anomaly(fx.field(spark, sf_dir).repartition("cell_id")))
    return found.select("time", "cell_id", F.round(F.round("value", 9).cast("decimal(18,9)"), 6).cast("double").alias("value"))


@query(f"WITH {fx.sql_field(by='week')}, {_LOW}, j AS (SELECT * FROM l WHERE month(time) IN (6, 7, 8)), s AS (SELECT cell_id FROM j GROUP BY cell_id HAVING count(value) > 0), k AS (SELECT * FROM j WHERE cell_id IN (SELECT cell_id FROM s)), t AS (SELECT time FROM k GROUP BY time HAVING count(value) = (SELECT count(DISTINCT cell_id) FROM k)) SELECT time, cell_id, round(value, 6) AS value FROM k WHERE time IN (SELECT time FROM t)")
def wa_seasonal_low_pass(spark, sf_dir):
    """Anomaly, low pass, season, gaps (first stages of the classification)."""
    return out(fields.seasonal_low_pass_anomaly(fx.field(spark, sf_dir, by="week")), "time", "cell_id", value=6)


@query(f"WITH {fx.sql_field()}, ta AS (SELECT CAST(i * 15 - 30 AS DOUBLE) AS t FROM range(8) r(i)), tb AS (SELECT CAST(95 + i * 25 AS DOUBLE) AS t FROM range(5) r(i)), la AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, (SELECT lat FROM (SELECT DISTINCT lat FROM field) ORDER BY abs(lat - t), lat LIMIT 1) AS s FROM ta), lo AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, (SELECT lon FROM (SELECT DISTINCT lon FROM field) ORDER BY abs(lon - t), lon LIMIT 1) AS s FROM tb) SELECT time, CAST(la.k * 1000000 + lo.k AS BIGINT) AS cell_id, la.t AS lat, lo.t AS lon, round(value, 6) AS value FROM field JOIN la ON field.lat = la.s JOIN lo ON field.lon = lo.s")
def j6_nearest_regrid(spark, sf_dir):
    lats = spark.range(8).select((F.col("id") * 15 - 30).cast("double").alias("lat"))
    lons = spark.range(5).select((F.col("id") * 25 + 95).cast("double").alias("lon"))
    return out(fields.nearest_regrid(fx.field(spark, sf_dir), lats, lons), "time", "cell_id", "lat", "lon", value=6)


# Composites

_COMPOSITE = "c AS (SELECT node_id, cell_id, lat, lon, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM field JOIN labels_ USING (time) GROUP BY ALL HAVING count(value) >= 2), m AS (SELECT cell_id, avg(value) AS climatology FROM field GROUP BY cell_id), z AS (SELECT *, (mean - climatology) / nullif(std / sqrt(n), 0) AS t FROM c JOIN m USING (cell_id))"


@query(f"WITH {fx.sql_field()}, {fx.SQL_LABELS}, {_COMPOSITE}, p AS (SELECT *, {fx.sql_t('t', '(n - 1)')} AS p FROM z) SELECT node_id, cell_id, lat, lon, n, round(mean, 6) AS mean, round(std, 6) AS std, round(climatology, 6) AS climatology, round(t, 5) AS t, round(p, 6) AS p, round(p, 6) < 0.05 AS significant FROM p")
def t1_composite_ttest(spark, sf_dir):
    """Node composites tested against the climatology."""
    df = fx.field(spark, sf_dir)
    found = composites.composite_against_own_mean(df, fx.labels(spark, sf_dir))
    found = out(found, "node_id", "cell_id", "lat", "lon", "n", mean=6, std=6, climatology=6, t=5, p=6)
    return composites.significant(found)


@query(f"WITH {fx.sql_field()}, {fx.SQL_LABELS} SELECT node_id, cell_id, lat, lon, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM field JOIN labels_ USING (time) GROUP BY ALL HAVING count(value) >= 2")
def j1_strict_composite(spark, sf_dir):
    """J1 strict: composites of labels that must all have their day in the field."""
    rows = composites.align(fx.field(spark, sf_dir), fx.labels(spark, sf_dir), strict=True)
    return out(composites.composite(rows), "node_id", "cell_id", "lat", "lon", "n", mean=6, std=6)


_LAGS_SQL = ", ".join(f"('{a}', {b})" for a, b in LAGS)


@query(f"WITH {fx.sql_field()}, {fx.SQL_SKEWED}, lags AS (SELECT * FROM (VALUES {_LAGS_SQL}) v(lag_name, lag_days)), c AS (SELECT node_id, lag_name, CAST(lag_days AS INTEGER) AS lag_days, cell_id, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std FROM field JOIN (SELECT node_id, lag_name, lag_days, time + CAST(lag_days AS INTEGER) AS time FROM labels_, lags) USING (time) GROUP BY ALL HAVING count(value) >= 2), z AS (SELECT *, mean / nullif(std / sqrt(n), 0) AS t FROM c) SELECT node_id, lag_name, lag_days, cell_id, n, round(mean, 6) AS mean, round(std, 6) AS std, round(t, 5) AS t, round({fx.sql_t('t', '(n - 1)')}, 6) AS p FROM z")
def a17_lead_lag(spark, sf_dir):
    """Composites at lags, tested against zero."""
    lags = spark.createDataFrame(LAGS, "lag_name string, lag_days int")
    found = composites.lead_lag(fx.field(spark, sf_dir), fx.labels(spark, sf_dir, skew=True), lags)
    return out(found, "node_id", "lag_name", "lag_days", "cell_id", "n", mean=6, std=6, t=5, p=6)


@query(f"WITH {fx.SQL_DAYS}, {fx.SQL_SKEWED.removeprefix(fx.SQL_DAYS + ', ')}, lags AS (SELECT * FROM (VALUES {_LAGS_SQL}) v(lag_name, lag_days)), m AS (SELECT node_id, lag_name, CAST(lag_days AS INTEGER) AS lag_days, time + CAST(lag_days AS INTEGER) AS time FROM labels_, lags) SELECT node_id, lag_name, lag_days, CAST(time AS DATE) AS time FROM m WHERE CAST(time AS DATE) NOT IN (SELECT time FROM days)")
def s5_days_without_field(spark, sf_dir):
    """The lagged days of labels that the field lacks, which lead and lag composites leave out."""
    lags = spark.createDataFrame(LAGS, "lag_name string, lag_days int")
    moved = composites.lagged_labels(fx.labels(spark, sf_dir, skew=True), lags)
    return composites.missing_days(fx.field(spark, sf_dir), moved).select("node_id", "lag_name", "lag_days", "time")


_YEAR_INDEX = "yi AS (SELECT CAST(year(time) AS INTEGER) AS year, (count(*) * 37 % 11) / 2.5 - 2 AS value FROM days WHERE month(time) <= 7 GROUP BY ALL)"


def year_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = fx.labels(spark, sf_dir).where(F.month("time") <= 7)
    return days.groupBy(F.year("time").alias("year")).agg(F.count(F.lit(1)).alias("n")).select("year", (F.col("n") * 37 % 11 / 2.5 - 2).alias("value"))


@query(f"WITH {fx.sql_field()}, {fx.SQL_DAYS}, {_YEAR_INDEX}, g AS (SELECT cell_id, count(CASE WHEN v.value >= 1 THEN f.value END) AS n_pos, count(CASE WHEN v.value <= -1 THEN f.value END) AS n_neg, avg(CASE WHEN v.value >= 1 THEN f.value END) - avg(CASE WHEN v.value <= -1 THEN f.value END) AS difference, var_samp(CASE WHEN v.value >= 1 THEN f.value END) AS vp, var_samp(CASE WHEN v.value <= -1 THEN f.value END) AS vn FROM field f JOIN yi v ON year(f.time) = v.year WHERE v.value >= 1 OR v.value <= -1 GROUP BY cell_id), u AS (SELECT *, vp / nullif(n_pos, 0) AS a, vn / nullif(n_neg, 0) AS b FROM g), z AS (SELECT *, difference / nullif(sqrt(a + b), 0) AS t, (a + b) * (a + b) / nullif(a * a / nullif(n_pos - 1, 0) + b * b / nullif(n_neg - 1, 0), 0) AS dof FROM u) SELECT cell_id, n_pos, n_neg, round(difference, 6) AS difference, round(t, 5) AS t, round(dof, 3) AS dof, round({fx.sql_t('t', 'dof')}, 6) AS p FROM z")
def t3_phase_difference(spark, sf_dir):
    """Positive less negative years with Welch's test."""
    found = composites.phase_difference(fx.field(spark, sf_dir), year_index(spark, sf_dir))
    return out(found, "cell_id", "n_pos", "n_neg", difference=6, t=5, dof=3, p=6)


@query(f"WITH {fx.sql_field(by='month')}, {fx.SQL_INDEX}, i AS (SELECT index_name, date AS time, value AS i FROM index_) SELECT index_name, cell_id, lat, lon, round(CASE WHEN count(value) = count(*) THEN {fx.sql_r('value', 'i')} END, 6) AS r, count(*) AS n FROM field JOIN i USING (time) GROUP BY index_name, cell_id, lat, lon")
def a19_correlation_map(spark, sf_dir):
    """Maps of all indices, over the months that they have."""
    index = fx.indices(spark, sf_dir).select("index_name", F.col("date").alias("time"), "value")
    field = fx.field(spark, sf_dir, by="month").join(index.select("time").distinct(), "time", "left_semi")
    return out(composites.correlation_map(field, index, names=["index_name"]), "index_name", "cell_id", "lat", "lon", "n", r=6)


# Series


@query(f"WITH {fx.SQL_INDEX} SELECT index_name, CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) <= 5 THEN 'MAM' WHEN month(date) <= 8 THEN 'JJA' ELSE 'SON' END AS season, CAST(year(date) + (month(date) = 12)::INTEGER AS INTEGER) AS year, round(avg(value), 5) AS value FROM index_ GROUP BY ALL")
def a7_seasonal_means(spark, sf_dir):
    """Seasons, December counted in the next year."""
    return out(series.seasonal_means(fx.indices(spark, sf_dir)), "index_name", "season", "year", value=5)


@query(f"WITH {fx.SQL_INDEX}, w AS (SELECT index_name, CAST(year(date) AS INTEGER) AS year, max(CASE WHEN month(date) = 12 THEN value END) AS d, max(CASE WHEN month(date) = 1 THEN value END) AS j, max(CASE WHEN month(date) = 2 THEN value END) AS f FROM index_ GROUP BY ALL) SELECT a.index_name, a.year, round((b.d + a.j + a.f) / 3, 5) AS value FROM w a LEFT JOIN w b ON a.index_name = b.index_name AND a.year = b.year + 1")
def a9_strict_djf(spark, sf_dir):
    """A9, W4."""
    return out(series.strict_djf(fx.indices(spark, sf_dir)), "index_name", "year", value=5)


@query(f"WITH {fx.SQL_INDEX} SELECT index_name, CAST(year(date) AS INTEGER) AS year, round(avg(value), 5) AS value FROM index_ WHERE year(date) BETWEEN 1996 AND 2001 GROUP BY ALL HAVING count(value) = 12")
def a10_annual_means(spark, sf_dir):
    return out(series.annual_means(fx.indices(spark, sf_dir), 1996, 2001, whole=True), "index_name", "year", value=5)


@query(f"WITH {fx.SQL_INDEX} SELECT index_name, CAST(year(date) AS INTEGER) AS year, round(avg(value), 5) AS value FROM index_ WHERE month(date) IN (6, 7, 8) GROUP BY ALL")
def a11_summer_means(spark, sf_dir):
    return out(series.annual_means(fx.indices(spark, sf_dir), 1900, 2100, (6, 7, 8)), "index_name", "year", value=5)


_COUNTS = "counts AS (SELECT y.year, n.node_id, count(l.time) AS count FROM (SELECT DISTINCT CAST(year(time) AS INTEGER) AS year FROM labels_) y CROSS JOIN (SELECT CAST(i AS INTEGER) AS node_id FROM range(1, 10) r(i)) n LEFT JOIN labels_ l ON year(l.time) = y.year AND l.node_id = n.node_id GROUP BY ALL)"


def counts(spark: SparkSession, sf_dir: str, skew: bool = False) -> DataFrame:
    return series.node_year_counts(fx.labels(spark, sf_dir, skew))


def count_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(spark, sf_dir).select("node_id", "year", F.col("count").cast("double").alias("value"))


_MONTHS = "series_ AS (SELECT node_id, CAST(year(time) * 12 + month(time) AS INTEGER) AS month, CAST(count(*) AS DOUBLE) AS value FROM labels_ GROUP BY ALL)"


def month_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = (F.year("time") * 12 + F.month("time")).alias("month")
    return fx.labels(spark, sf_dir).groupBy("node_id", month).agg(F.count(F.lit(1)).cast("double").alias("value"))


@query(f"WITH {fx.SQL_SKEWED}, {_COUNTS}, d AS (SELECT *, sum(count) OVER (PARTITION BY year) AS days FROM counts) SELECT year, node_id, count, round({fx.sql_binomial('count', 'days', 1 / 9)}, 6) AS pval FROM d")
def t5_yearly_counts(spark, sf_dir):
    """Zero-filled counts with the binomial test."""
    return out(series.frequent_nodes(counts(spark, sf_dir, skew=True)), "year", "node_id", "count", pval=6)


@query(f"WITH {fx.SQL_SKEWED} SELECT node_id, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM labels_ GROUP BY node_id")
def a13_node_frequency(spark, sf_dir):
    return out(series.node_frequency(fx.labels(spark, sf_dir, skew=True)), "node_id", "count", percent=6)


_BINS = "b AS (SELECT * FROM (VALUES (0, '1995-1996', 1995, 1997), (1, '1997-1998', 1997, 1999), (2, '1999-2000', 1999, 2001), (3, '2001-2001', 2001, 2002)) v(bin, label, y0, y1)), bc AS (SELECT n.node_id, b.bin, b.label, CAST(coalesce(sum(c.count), 0) AS BIGINT) AS count FROM (SELECT DISTINCT node_id FROM counts) n CROSS JOIN b LEFT JOIN counts c ON c.node_id = n.node_id AND c.year >= b.y0 AND c.year < b.y1 GROUP BY ALL)"


@query(f"WITH {fx.SQL_LABELS}, {_COUNTS}, {_BINS} SELECT node_id, string_agg(label || ':' || printf('%.3f', CAST(count AS DOUBLE)), ';' ORDER BY bin) AS decadal_counts FROM bc GROUP BY node_id")
def a14_binned_counts(spark, sf_dir):
    return series.bin_text(series.bin_counts(counts(spark, sf_dir), EDGES))


@query(f"WITH {fx.SQL_LABELS}, o AS (SELECT time, CAST(1 + day(time) % 3 AS INTEGER) AS k FROM days) SELECT node_id AS a, count(*) FILTER (WHERE k = 1) AS \"1\", count(*) FILTER (WHERE k = 2) AS \"2\", count(*) FILTER (WHERE k = 3) AS \"3\" FROM labels_ JOIN o USING (time) GROUP BY node_id")
def a15_confusion(spark, sf_dir):
    own = fx.labels(spark, sf_dir)
    other = own.select("time", (1 + F.dayofmonth("time") % 3).alias("label"))
    return series.confusion(own.withColumnRenamed("node_id", "label"), other, "time", [1, 2, 3])


_SEASONAL = "seasonal AS (SELECT index_name, CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) <= 5 THEN 'MAM' WHEN month(date) <= 8 THEN 'JJA' ELSE 'SON' END AS season, CAST(year(date) + (month(date) = 12)::INTEGER AS INTEGER) AS year, avg(value) AS value FROM index_ GROUP BY ALL)"
_CORR = f"r0 AS (SELECT node_id, index_name, {fx.sql_r('CAST(c.count AS DOUBLE)', 's.value')} AS r, count(*) AS n FROM counts c JOIN (SELECT * FROM seasonal WHERE season = 'JJA') s USING (year) GROUP BY ALL HAVING count(*) >= 5), corr AS (SELECT node_id, index_name, r, n, {fx.sql_r_p('r', 'n')} AS p FROM r0)"


def summer_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = series.seasonal_means(fx.indices(spark, sf_dir)).where("season = 'JJA'")
    return series.correlate(count_series(spark, sf_dir), index, ["node_id"], ["index_name"])


@query(f"WITH {fx.SQL_LABELS}, {_COUNTS}, {fx.SQL_INDEX}, {_SEASONAL}, {_CORR} SELECT node_id, index_name, round(r, 6) AS correlation, round(p, 6) AS p_value, n AS \"N\" FROM corr")
def t4_correlations(spark, sf_dir):
    """Counts against index series over common years."""
    return out(summer_correlations(spark, sf_dir), "node_id", "index_name", "N", correlation=6, p_value=6)


@query(f"WITH {fx.SQL_LABELS}, {_COUNTS}, {fx.SQL_INDEX}, {_SEASONAL}, lags AS (SELECT * FROM (VALUES (-2, 'DJF', 0), (-1, 'MAM', 0), (0, 'JJA', 0), (1, 'SON', 0), (2, 'DJF', -1)) v(lag, season, shift)), s AS (SELECT index_name, lag, season, year + shift AS year, value FROM seasonal JOIN lags USING (season)), r0 AS (SELECT node_id, index_name, CAST(lag AS INTEGER) AS lag, season, {fx.sql_r('CAST(c.count AS DOUBLE)', 's.value')} AS r, count(*) AS n FROM counts c JOIN s USING (year) GROUP BY ALL HAVING count(*) >= 5) SELECT node_id, index_name, lag, season, round(r, 6) AS correlation, round({fx.sql_r_p('r', 'n')}, 6) AS p_value, n AS \"N\" FROM r0")
def j4_lagged_correlations(spark, sf_dir):
    """Counts against index seasons at five lags."""
    index = series.lagged_seasons(series.seasonal_means(fx.indices(spark, sf_dir)))
    found = series.correlate(count_series(spark, sf_dir), index, ["node_id"], ["index_name", "lag", "season"])
    return out(found, "node_id", "index_name", "lag", "season", "N", correlation=6, p_value=6)


_NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"WITH {fx.SQL_LABELS}, {_COUNTS}, {fx.SQL_INDEX}, {_SEASONAL}, {_CORR} SELECT node_id, " + ", ".join(f"round(max(CASE WHEN index_name = '{n}' AND p < 0.05 THEN r END), 6) AS \"{n}\"" for n in _NAMES) + " FROM corr GROUP BY node_id")
def f6_significant_wide(spark, sf_dir):
    wide = series.significant_wide(summer_correlations(spark, sf_dir), _NAMES)
    return wide.select("node_id", *(F.round(F.col(f"`{n}`"), 6).alias(n) for n in _NAMES))


@query(f"WITH {fx.SQL_LABELS}, {_COUNTS}, {fx.SQL_INDEX}, {_SEASONAL}, {_CORR} SELECT node_id, index_name, round(r, 6) AS correlation FROM corr WHERE abs(r) > 0.3 AND node_id IN (1, 5, 8)")
def f7_strong(spark, sf_dir):
    """Strong correlations of some nodes."""
    rows = summer_correlations(spark, sf_dir).where(F.col("node_id").isin(1, 5, 8))
    return out(series.strong(rows), "node_id", "index_name", correlation=6)


@query(f"WITH {fx.SQL_INDEX}, {_SEASONAL}, " + ", ".join(f"{s}_ AS (SELECT index_name, year, round(value, 5) AS {s} FROM seasonal WHERE season = '{s.upper()}')" for s in ("djf", "mam", "jja", "son")) + " SELECT index_name, year, djf, mam, jja, son FROM djf_ FULL JOIN mam_ USING (index_name, year) FULL JOIN jja_ USING (index_name, year) FULL JOIN son_ USING (index_name, year)")
def j7_seasons_wide(spark, sf_dir):
    """The seasons of each index by year, gaps null."""
    return out(series.seasons_wide(series.seasonal_means(fx.indices(spark, sf_dir))), "index_name", "year", djf=5, mam=5, jja=5, son=5)


@query(f"WITH {fx.SQL_LABELS}, {_MONTHS}, m AS (SELECT node_id, month, count(value) OVER w AS n, avg(value) OVER w AS value FROM series_ WINDOW w AS (PARTITION BY node_id ORDER BY month ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)) SELECT node_id, month, round(value, 6) AS value FROM m WHERE n = 10")
def w2_moving_average(spark, sf_dir):
    return out(series.moving_average(month_series(spark, sf_dir), ["node_id"], order="month"), "node_id", "month", value=6)


@query(f"WITH {fx.SQL_EVENTS}, b AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY event_type ORDER BY day) AS x FROM event_series) SELECT event_type, round({fx.sql_r('x', 'y')}, 6) AS r1 FROM b GROUP BY event_type")
def w3_lag1(spark, sf_dir):
    return out(series.lag1(fx.event_series(spark, sf_dir), ["event_type"], "day"), "event_type", r1=6)


@query(f"WITH {fx.SQL_INDEX} SELECT index_name, date, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS z1, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) AS z0 FROM index_ WINDOW w AS (PARTITION BY index_name)")
def w7_z_scores(spark, sf_dir):
    df = fx.indices(spark, sf_dir)
    both = series.z_score(df.withColumn("raw", F.col("value")), ["index_name"], 1).withColumnsRenamed({"value": "z1", "raw": "value"})
    return out(series.z_score(both, ["index_name"], 0).withColumnRenamed("value", "z0"), "index_name", "date", z1=6, z0=6)


_PLACED = "pl AS (SELECT event_type, day, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS DOUBLE) AS t FROM event_series), ln AS (SELECT event_type, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM pl GROUP BY event_type), dt AS (SELECT event_type, day, t, value - (a + b * t) AS value FROM pl JOIN ln USING (event_type))"


@query(f"WITH {fx.SQL_EVENTS}, {_PLACED} SELECT event_type, day, round(value, 6) AS value FROM dt")
def w8_detrend(spark, sf_dir):
    return out(series.detrend(fx.event_series(spark, sf_dir), ["event_type"], "day"), "event_type", "day", value=6)


def sql_mann_kendall(rows: str, key: str, order: str, more: str = "") -> str:
    """CTEs of Mann-Kendall over a relation (key, order, value)."""
    return f"""mk0 AS (SELECT a.{key}, sum(sign(b.value - a.value)) AS s FROM {rows} a JOIN {rows} b ON a.{key} = b.{key} AND a.{order} < b.{order} GROUP BY ALL),
        mk1 AS (SELECT {key}, sum(m) AS n, sum(m * (m - 1) * (2 * m + 5)) AS tied FROM (SELECT {key}, value, count(*) AS m FROM {rows} GROUP BY ALL) GROUP BY {key}),
        mk2 AS (SELECT {key}, n, CASE WHEN n >= 3 THEN s END AS s, CASE WHEN n >= 3 THEN (n * (n - 1) * (2 * n + 5) - tied) / 18.0 END AS v FROM mk1 LEFT JOIN mk0 USING ({key})),
        mk3 AS (SELECT *, CASE WHEN s > 0 THEN (s - 1) / nullif(sqrt(v), 0) WHEN s < 0 THEN (s + 1) / nullif(sqrt(v), 0) WHEN s = 0 THEN 0.0 END AS z FROM mk2),
        mk AS (SELECT {key}, n, s, v, z, {fx.sql_erfc('(abs(z) / sqrt(2))')} AS p FROM mk3)"""


_TREND = "CASE WHEN z > 0 THEN 'increasing' WHEN z < 0 THEN 'decreasing' WHEN z = 0 THEN 'no trend' END AS trend"


@query(f"WITH {fx.SQL_LABELS}, {_MONTHS}, {sql_mann_kendall('series_', 'node_id', 'month')} SELECT node_id, CAST(s AS DOUBLE) AS \"S\", round(v, 4) AS \"var_S\", round(z, 5) AS \"Z\", round(p, 6) AS p_value, {_TREND} FROM mk")
def t6_mann_kendall(spark, sf_dir):
    found = series.mann_kendall(month_series(spark, sf_dir), ["node_id"], "month")
    return out(found, "node_id", "S", "trend", var_S=4, Z=5, p_value=6)


@query(f"WITH {fx.SQL_LABELS}, {_COUNTS}, {_BINS}, q AS (SELECT node_id, bin, CAST(count AS DOUBLE) AS value FROM bc), {sql_mann_kendall('q', 'node_id', 'bin')} SELECT node_id, CAST(s AS DOUBLE) AS \"S\", round(z, 5) AS \"Z\", round(p, 6) AS p_value, {_TREND} FROM mk")
def t7_binned_trend(spark, sf_dir):
    binned = series.bin_counts(counts(spark, sf_dir), EDGES).select("node_id", "bin", F.col("count").cast("double").alias("value"))
    return out(series.mann_kendall(binned, ["node_id"], "bin"), "node_id", "S", "trend", Z=5, p_value=6)


@query(f"WITH {fx.SQL_LABELS}, {_MONTHS}, o AS (SELECT node_id, regr_slope(value, month) AS b, regr_intercept(value, month) AS a, {fx.sql_r('CAST(month AS DOUBLE)', 'value')} AS r, count(*) AS n FROM series_ GROUP BY node_id) SELECT node_id, n, round(b, 6) AS slope, round(a, 3) AS intercept, round({fx.sql_r_p('r', 'n')}, 6) AS p_value FROM o")
def t8_ols_trend(spark, sf_dir):
    return out(series.ols_trend(month_series(spark, sf_dir), ["node_id"], "month"), "node_id", "n", slope=6, intercept=3, p_value=6)


@query(f"WITH {fx.SQL_LABELS}, {_MONTHS}, m AS (SELECT node_id, month, count(value) OVER w AS n, round(avg(value) OVER w, 9) AS value FROM series_ WINDOW w AS (PARTITION BY node_id ORDER BY month ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)), k AS (SELECT node_id, month, value FROM m WHERE n = 10), {sql_mann_kendall('k', 'node_id', 'month')}, o AS (SELECT node_id, regr_slope(value, month) AS b FROM k GROUP BY node_id) SELECT node_id, round(CASE WHEN n > 3 THEN b ELSE 0 END, 6) AS slope, round(CASE WHEN n > 3 THEN p ELSE 1 END, 6) AS p_value, CASE WHEN n > 3 THEN p < 0.05 ELSE FALSE END AS significant FROM mk JOIN o USING (node_id)")
def t9_smoothed_trend(spark, sf_dir):
    return out(series.smoothed_trend(month_series(spark, sf_dir), ["node_id"], order="month"), "node_id", "significant", slope=6, p_value=6)


# Spectra

_DFT = "c0 AS (SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS DOUBLE) AS t, value - avg(value) OVER (PARTITION BY event_type) AS x, count(*) OVER (PARTITION BY event_type) AS n FROM {rows}), c1 AS (SELECT event_type, k, n, sum(x * cos(2 * pi() * k * t / n)) AS re, sum(x * sin(2 * pi() * k * t / n)) AS im FROM c0, range(0, 1000) r(k) WHERE k <= greatest(n // 2, 1) GROUP BY ALL), pg AS (SELECT event_type, k, n, (re * re + im * im) / n AS power FROM c1 WHERE {kept})"
_PG = _DFT.format(rows="event_series", kept="k > 0 AND 2 * k <= n AND k * (n / 2.0) >= n")


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.periodogram(fx.event_series(spark, sf_dir), ["event_type"], "day")


@query(f"WITH {fx.SQL_EVENTS}, {_PG} SELECT event_type, k, round(k / n, 6) AS frequency, round(n / k, 6) AS period, round(power, 5) AS power FROM pg")
def t10_periodogram(spark, sf_dir):
    return out(spectrum(spark, sf_dir).withColumn("k", F.col("k").cast("long")), "event_type", "k", frequency=6, period=6, power=5)


@query(f"WITH {fx.SQL_EVENTS}, {_PG}, b AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY event_type ORDER BY day) AS x FROM event_series), ar AS (SELECT event_type, greatest(least(coalesce({fx.sql_r('x', 'y')}, 0), 0.99), -0.99) AS r, var_samp(y) AS v FROM b GROUP BY event_type), rd AS (SELECT event_type, k, power, v * (1 - r * r) / (1 + r * r - 2 * r * cos(2 * pi() * k / n)) AS red FROM pg JOIN ar USING (event_type)) SELECT event_type, k, round(red, 5) AS red, round(red * -ln(0.05), 5) AS level95, power > red * -ln(0.05) AS significant FROM rd")
def t11_red_noise(spark, sf_dir):
    found = spectra.red_noise(spectrum(spark, sf_dir), fx.event_series(spark, sf_dir), ["event_type"], "day")
    return out(found.withColumn("k", F.col("k").cast("long")), "event_type", "k", "significant", red=5, level95=5)


@query(f"WITH {fx.SQL_EVENTS}, {_PLACED}, un AS (SELECT event_type, day, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS value FROM dt WINDOW w AS (PARTITION BY event_type)), {_DFT.format(rows='un', kept='2 * k < n')}, b AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY event_type ORDER BY day) AS x FROM un), ar AS (SELECT event_type, {fx.sql_r('x', 'y')} AS r FROM b GROUP BY event_type) SELECT event_type, k, round(power, 6) AS power, round((1 - r * r) / (1 + r * r - 2 * r * cos(2 * pi() * k / n)), 6) AS red, round(-ln(0.05) * (1 - r * r) / (1 + r * r - 2 * r * cos(2 * pi() * k / n)), 6) AS level95 FROM pg JOIN ar USING (event_type)")
def t12_normalised_spectrum(spark, sf_dir):
    found = spectra.normalised_spectrum(fx.event_series(spark, sf_dir), ["event_type"], "day")
    return out(found.withColumn("k", F.col("k").cast("long")), "event_type", "k", power=6, red=6, level95=6)


@query(f"WITH {fx.SQL_EVENTS}, {_PG}, rk AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY power DESC, k DESC) AS i FROM pg) SELECT event_type, " + ", ".join(f"round(max(CASE WHEN i = {i} THEN n / k END), 6) AS peak{i}_period, round(max(CASE WHEN i = {i} THEN power END), 5) AS peak{i}_power" for i in (1, 2, 3)) + " FROM rk GROUP BY event_type")
def w5_peaks(spark, sf_dir):
    places = {f"peak{i}_{c}": n for i in (1, 2, 3) for c, n in (("period", 6), ("power", 5))}
    return out(spectra.peaks(spectrum(spark, sf_dir), ["event_type"]), "event_type", **places)


@query(f"WITH {fx.SQL_EVENTS}, {_PG}, g0 AS (SELECT event_type, max(power) / sum(power) AS g, count(*) AS m FROM pg GROUP BY event_type), g1 AS (SELECT event_type, g, greatest(0, least(1, list_sum([(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1)) * pow(greatest(1 - j * g, 0), m - 1) for j in range(1, least(CAST(floor(1 / g) AS BIGINT), m) + 1)]))) AS p FROM g0) SELECT event_type, round(g, 6) AS g, round(p, 5) AS p, p < 0.05 AS reject FROM g1")
def t13_fisher_g(spark, sf_dir):
    return out(spectra.fisher_g(spectrum(spark, sf_dir), ["event_type"]), "event_type", "reject", g=6, p=5)


@query(f"WITH {fx.SQL_EVENTS}, xy AS (SELECT a.event_type, b.event_type AS other, day, a.value AS x, b.value AS y FROM event_series a JOIN event_series b USING (day)), q AS (SELECT event_type, other, row_number() OVER (PARTITION BY event_type, other ORDER BY day) AS t, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, count(*) OVER w AS n, stddev_pop(x) OVER w * stddev_pop(y) OVER w AS s FROM xy WINDOW w AS (PARTITION BY event_type, other)) SELECT a.event_type, a.other, CAST(b.t - a.t AS INTEGER) AS lag, round(sum(b.x * a.y) / nullif(a.s, 0) / a.n, 6) AS correlation, round(1.96 / sqrt(a.n), 6) AS band FROM q a JOIN q b ON a.event_type = b.event_type AND a.other = b.other GROUP BY a.event_type, a.other, b.t - a.t, a.n, a.s")
def t14_cross_correlation(spark, sf_dir):
    x = fx.event_series(spark, sf_dir)
    found = spectra.cross_correlation(x, x.withColumnRenamed("event_type", "other"), ["event_type"], ["other"], order="day")
    return out(found, "event_type", "other", "lag", correlation=6, band=6)


@query(f"WITH {fx.SQL_EVENTS}, {_PLACED}, sc AS (SELECT round(1 + j * 0.1, 6) AS scale FROM range(70) r(j)), e AS (SELECT event_type, CAST(t AS INTEGER) AS t, value, CAST(count(*) OVER (PARTITION BY event_type) AS INTEGER) AS n FROM dt), k AS (SELECT e.*, scale, CAST(least(floor(round(scale * 10, 6)), n) AS INTEGER) AS m FROM e, sc), p AS (SELECT event_type, scale, t + CAST(i AS INTEGER) - (m - 1) // 2 AS t, n, value * 2 / (sqrt(3 * scale) * pow(pi(), 0.25)) * (1 - pow((i - (m - 1) / 2.0) / scale, 2)) * exp(-pow((i - (m - 1) / 2.0) / scale, 2) / 2) AS v FROM k, range(100) r(i) WHERE i < m) SELECT event_type, scale, CAST(t AS INTEGER) AS t, round(sum(v), 5) AS value FROM p WHERE t >= 0 AND t < n GROUP BY ALL")
def t15_wavelet(spark, sf_dir):
    return out(spectra.ricker_transform(fx.event_series(spark, sf_dir), ["event_type"], "day"), "event_type", "scale", "t", value=5)


@query(f"WITH {fx.SQL_EVENTS}, {_PG} SELECT event_type, CASE WHEN 12 * k >= n AND 8 * k <= n THEN 'decadal' WHEN 7 * k >= n AND 2 * k <= n THEN 'interannual' ELSE 'other' END AS band, round(sum(power), 4) AS power FROM pg GROUP BY ALL")
def t16_band_power(spark, sf_dir):
    return out(spectra.band_power(spectrum(spark, sf_dir), ["event_type"]), "event_type", "band", power=4)


# Patterns

_UNIT = "un AS (SELECT vec_id AS id, [x / sqrt(list_sum([y * y for y in CAST(embedding AS DOUBLE[])])) for x in CAST(embedding AS DOUBLE[])] AS f, label FROM embeddings)"
_BMU = f"{_UNIT}, d AS (SELECT a.id, CAST(b.id + 1 AS INTEGER) AS node_id, list_distance(a.f, b.f) AS d FROM un a JOIN un b ON b.id < 9), rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, node_id) AS i FROM d), bm AS (SELECT id, node_id, d FROM rk WHERE i = 1)"


def unit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.normalise(fx.embeddings(spark, sf_dir))


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_samples(spark, sf_dir).where("id < 9").select((F.col("id") + 1).cast("int").alias("node_id"), F.col("features").alias("weights"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    book = np.array([r.weights for r in prototypes(spark, sf_dir).orderBy("node_id").collect()])  # nine rows
    return patterns.assign(unit_samples(spark, sf_dir), book, 3)


@query(f"WITH {_UNIT} SELECT id, round(list_sum(f), 6) AS total, round(sqrt(list_sum([x * x for x in f])), 6) AS length FROM un")
def c1_normalise(spark, sf_dir):
    rows = unit_samples(spark, sf_dir)
    return out(rows.select("id", F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"), patterns.norm(F.col("features")).alias("length")), "id", total=6, length=6)


@query(f"WITH {_BMU} SELECT id, node_id, CAST((node_id - 1) % 3 + 1 AS INTEGER) AS bmu_i, CAST((node_id - 1) // 3 + 1 AS INTEGER) AS bmu_j, round(d, 6) AS distance FROM bm")
def c3_best_matching_unit(spark, sf_dir):
    return out(assigned(spark, sf_dir), "id", "node_id", "bmu_i", "bmu_j", distance=6)


@query(f"WITH {_BMU} SELECT id, node_id, round(d, 6) AS distance FROM bm")
def c3_best_matching_unit_joined(spark, sf_dir):
    """The same without Python: a join with the nine prototypes."""
    return out(patterns.assign_sql(unit_samples(spark, sf_dir), prototypes(spark, sf_dir)), "id", "node_id", distance=6)


@query(f"WITH {_BMU} SELECT CAST(n.i AS INTEGER) AS node_id, count(bm.id) AS count, round(coalesce(avg(d), 0), 6) AS error FROM range(1, 10) n(i) LEFT JOIN bm ON bm.node_id = n.i GROUP BY n.i UNION ALL SELECT 0, count(*), round(avg(d), 6) FROM bm")
def c4_quantization_error(spark, sf_dir):
    return out(patterns.quantization_error(assigned(spark, sf_dir), 9), "node_id", "count", error=6)


#: The map's first weights, drawn from the operator's seed.
_FIRST = ", ".join(f"({k}, {w}::DOUBLE[])" for k, w in enumerate(patterns.first_weights(64, 9, 42).tolist()))
_SOM = f"""WITH RECURSIVE {_UNIT}, w0 AS (SELECT * FROM (VALUES {_FIRST}) v(node, w)),
    b AS (
        SELECT 0 AS step, node, w FROM w0
        UNION ALL
        (WITH bm AS (SELECT un.id, arg_min(b.node, struct_pack(d := list_distance(un.f, b.w), n := b.node)) AS node FROM b, un WHERE b.step < 20 GROUP BY un.id),
        tot AS (SELECT node, i, sum(f[i]) AS v, count(*) AS n FROM bm JOIN un USING (id), range(1, 65) r(i) GROUP BY node, i),
        h AS (SELECT b.step, b.node, i, v, n, exp(-0.5 * (pow(b.node % 3 - tot.node % 3, 2) + pow(b.node // 3 - tot.node // 3, 2)) / pow(greatest(1.5 * pow(0.5 / 1.5, b.step / 19.0), 0.5), 2)) AS h FROM b, tot),
        m AS (SELECT step, node, i, sum(h * v) / sum(h * n) AS v FROM h GROUP BY ALL)
        SELECT step + 1, node, list(v ORDER BY i) FROM (SELECT step, node, i, v / sqrt(sum(v * v) OVER (PARTITION BY node)) AS v FROM m) GROUP BY step, node))
    SELECT un.id, CAST(arg_min(b.node, struct_pack(d := list_distance(un.f, b.w), n := b.node)) + 1 AS INTEGER) AS node_id FROM b, un WHERE b.step = 20 GROUP BY un.id"""


@query(_SOM)
def c2_som_batch(spark, sf_dir):
    """Batch-trained map of the embeddings: each sample's node. The SQL trains the same map from the same first weights."""
    rows = stored(unit_samples(spark, sf_dir).where("features IS NOT NULL"), "samples")
    if not rows.limit(1).count():
        return rows.select("id", F.lit(1).alias("node_id"))
    return patterns.assign(rows, patterns.train_batch(rows), 3).select("id", "node_id")


@query()
def c2_som_online(spark, sf_dir):
    """Sequential training, three steps for each sample; then each sample's node."""
    rows = stored(unit_samples(spark, sf_dir), "samples")
    book = patterns.train_online_blocks(rows, [(0.5, 3 * rows.count())])[0]
    return patterns.assign(rows, book, 3).select("id", "node_id")


@query()
def c5_parameter_search(spark, sf_dir):
    """Nine settings of online training, by first radius and steps, ranked by quantization error."""
    rows = stored(unit_samples(spark, sf_dir), "samples")
    return patterns.search(rows, [0.5, 1.0, 1.5], [2000, 3000, 4000], alpha0=0.5).withColumn("qerror", F.round("qerror", 6))


@query()
def c6_kmeans(spark, sf_dir):
    return patterns.kmeans(fx.embeddings(spark, sf_dir), 9)


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features): mean vector of each label of two samples or more."""
    return patterns.node_means(fx.embeddings(spark, sf_dir), "label")


@query()
def c7_node_clusters(spark, sf_dir):
    """Three clusters of the labels' mean vectors."""
    return patterns.kmeans(label_means(spark, sf_dir), 3).withColumnRenamed("id", "node")


@query("SELECT count(*) AS samples, CAST(9 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced FROM embeddings UNION ALL SELECT count(*), CAST(3 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 2)")
def c6_kmeans_at_rest(spark, sf_dir):
    """In both clusterings every sample is nearest to its own cluster's mean."""
    both = [(fx.embeddings(spark, sf_dir), 9), (label_means(spark, sf_dir), 3)]
    return union([patterns.misplaced(rows, patterns.kmeans(rows, k)) for rows, k in both])


@query("WITH m AS (SELECT label, i, avg(CAST(embedding AS DOUBLE[])[i]) AS v FROM embeddings, range(1, 65) r(i) GROUP BY ALL HAVING count(*) >= 2) SELECT a.label AS a, b.label AS b, round(sum((a.v - b.v) * (a.v - b.v)), 6) AS d2 FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY ALL")
def c9_pair_distances(spark, sf_dir):
    """C8, and the distances that Ward's linkage merges."""
    return out(patterns.pair_distances(label_means(spark, sf_dir)), "a", "b", d2=6)


_WARD = """WITH RECURSIVE m AS (SELECT label, i, avg(CAST(embedding AS DOUBLE[])[i]) AS v FROM embeddings, range(1, 65) r(i) WHERE label IS NOT NULL GROUP BY ALL HAVING count(*) >= 2),
    vec AS (SELECT row_number() OVER (ORDER BY label) - 1 AS id, list(v ORDER BY i) AS v FROM m GROUP BY label),
    w AS (
        SELECT -1 AS step, id, 1 AS n, v, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS d2 FROM vec
        UNION ALL
        (WITH pr AS (
            SELECT x.step, x.id AS a, y.id AS b, 2.0 * x.n * y.n / (x.n + y.n) * pow(list_distance(x.v, y.v), 2) AS d2, x.n + y.n AS n,
                [(x.n * z[1] + y.n * z[2]) / (x.n + y.n) for z in list_zip(x.v, y.v)] AS v
            FROM w x JOIN w y ON x.id < y.id),
        best AS (SELECT * FROM pr ORDER BY d2, a, b LIMIT 1)
        SELECT w.step + 1, w.id, w.n, w.v, NULL, NULL, NULL FROM w, best WHERE w.id <> best.a AND w.id <> best.b
        UNION ALL
        SELECT step + 1, (SELECT count(*) FROM vec) + step + 1, n, v, a, b, d2 FROM best))
    SELECT CAST(step AS INTEGER) AS step, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(sqrt(d2), 6) AS height, CAST(n AS INTEGER) AS size FROM w WHERE a IS NOT NULL"""


@query(_WARD)
def c9_ward_linkage(spark, sf_dir):
    """Merges by squared distances; the SQL goes by means and sizes of clusters instead."""
    return patterns.ward_linkage(label_means(spark, sf_dir)).withColumn("height", F.round("height", 6))


def _top(name: str, matrix: str) -> str:
    """The first eigenvector of a positive matrix (i, j, v): a column of its power 2**16, by repeated squaring."""
    return f"""{name}_p AS (SELECT 0 AS k, i, j, v / (SELECT max(abs(v)) FROM {matrix}) AS v FROM {matrix}
        UNION ALL SELECT k + 1, i, j, v / max(abs(v)) OVER () FROM (SELECT a.k, a.i, b.j, sum(a.v * b.v) AS v FROM {name}_p a JOIN {name}_p b ON a.j = b.i WHERE a.k < 16 GROUP BY ALL)),
    {name} AS (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {name}_p WHERE k = 16 AND j = (SELECT j FROM {name}_p WHERE k = 16 AND i = j ORDER BY v DESC, j LIMIT 1))"""


_PCA = f"""WITH RECURSIVE x AS (SELECT vec_id AS id, i, CAST(embedding AS DOUBLE[])[i] AS v FROM embeddings, range(1, 65) r(i) WHERE embedding IS NOT NULL),
    mu AS (SELECT i, avg(v) AS m, count(*) AS n FROM x GROUP BY i),
    cov AS (SELECT a.i, b.i AS j, (sum(a.v * b.v) - any_value(p.n * p.m * q.m)) / any_value(p.n - 1) AS v FROM x a JOIN x b ON a.id = b.id JOIN mu p ON p.i = a.i JOIN mu q ON q.i = b.i GROUP BY a.i, b.i),
    {_top("first_axis", "cov")},
    own AS (SELECT c.i, c.j, c.v, a.v * b.v AS ab FROM cov c JOIN first_axis a ON a.i = c.i JOIN first_axis b ON b.i = c.j),
    rest AS (SELECT i, j, v - ab * (SELECT sum(v * ab) FROM own) AS v FROM own),
    {_top("second_axis", "rest")}
    SELECT x.id, round(abs(sum(x.v * a.v)), 5) AS x, round(abs(sum(x.v * b.v)), 5) AS y FROM x JOIN first_axis a ON a.i = x.i JOIN second_axis b ON b.i = x.i GROUP BY x.id"""


@query(_PCA)
def c10_embedding(spark, sf_dir):
    """Two principal components but for signs; the SQL finds them by powers of the covariance matrix."""
    return out(patterns.pca2(fx.embeddings(spark, sf_dir)).withColumns({"x": F.abs("x"), "y": F.abs("y")}), "id", x=5, y=5)


@query()
def c10_landmark_embedding(spark, sf_dir):
    """C10 by least stress: landmarks placed against each other, all others by their distances to them."""
    return out(patterns.landmark_scaling(fx.embeddings(spark, sf_dir)), "id", x=4, y=4)


# Variograms and kriging

_POINTS = "pts AS (SELECT CAST(c_nationkey % 3 AS INTEGER) AS node_id, (c_custkey * 37 % 8000) / 100.0 - 20 AS lat, (c_custkey * 91 % 18000) / 100.0 AS lon, c_acctbal / 1000 AS value, c_custkey FROM customer), sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY c_custkey * 7919 % 100003, lat, lon) - 1 AS pid FROM pts) WHERE pid < 500)"
_PAIRS = "pr AS (SELECT a.node_id, 2 * 6371.0 * asin(sqrt(least(greatest(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 0), 1))) AS h, pow(a.value - b.value, 2) / 2 AS g FROM sp a JOIN sp b ON a.node_id = b.node_id AND a.pid < b.pid)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 500 points of each group, as the operator's default and the SQL above have it."""
    c = fx.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = c.select((F.col("c_nationkey") % 3).alias("node_id"), ((k * 37 % 8000) / 100 - 20).alias("lat"), ((k * 91 % 18000) / 100).alias("lon"), (F.col("c_acctbal") / 1000).alias("value"), k.alias("c_custkey"))
    return kriging.sample_points(rows, ["node_id"], 500, F.col("c_custkey") * 7919 % 100003).drop("c_custkey")


@query(f"WITH {_POINTS} SELECT node_id, pid, round(lat, 4) AS lat, round(lon, 4) AS lon, round(value, 6) AS value FROM sp")
def l4_sample(spark, sf_dir):
    return out(points(spark, sf_dir).withColumn("pid", F.col("pid").cast("long")), "node_id", "pid", lat=4, lon=4, value=6)


@query(f"WITH {_POINTS}, {_PAIRS} SELECT node_id, count(*) AS n, round(avg(h), 4) AS mean_h, round(max(h), 4) AS max_h, round(avg(g), 5) AS mean_g FROM pr GROUP BY node_id")
def g1_pairs(spark, sf_dir):
    """G1, J9."""
    found = kriging.pairs(points(spark, sf_dir), ["node_id"]).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("mean_h"), F.max("h").alias("max_h"), F.avg("g").alias("mean_g"))
    return out(found, "node_id", "n", mean_h=4, max_h=4, mean_g=5)


_BINS = "q AS (SELECT node_id, quantile_cont(h, 0.95) AS reach FROM pr GROUP BY node_id), b AS (SELECT node_id, reach, g, CAST(least(floor(h / (reach / 12)), 11) AS INTEGER) AS bin FROM pr JOIN q USING (node_id) WHERE h < reach)"


@query(f"WITH {_POINTS}, {_PAIRS}, {_BINS} SELECT node_id, bin, round((bin + 0.5) * reach / 12, 4) AS h, round(avg(g), 5) AS gamma, count(*) AS n FROM b GROUP BY node_id, bin, reach")
def g2_empirical_variogram(spark, sf_dir):
    return out(kriging.empirical_variogram(points(spark, sf_dir), ["node_id"]), "node_id", "bin", "n", h=4, gamma=5)


_GAMMA = "CASE WHEN model = 'spherical' THEN CASE WHEN h < 3000 THEN 1 + 4 * (1.5 * h / 3000 - 0.5 * pow(h / 3000, 3)) ELSE 5 END WHEN model = 'exponential' THEN 1 + 4 * (1 - exp(-h / 3000)) ELSE 1 + 4 * (1 - exp(-pow(h / 3000, 2))) END"


@query(f"WITH {_POINTS}, {_PAIRS}, m AS (SELECT * FROM (VALUES ('spherical'), ('exponential'), ('gaussian')) v(model)) SELECT node_id, model, round(avg({_GAMMA}), 6) AS gamma FROM pr, m GROUP BY ALL")
def g3_models(spark, sf_dir):
    rows = kriging.pairs(points(spark, sf_dir), ["node_id"]).withColumn("model", F.explode(F.array(*map(F.lit, kriging.MODELS))))
    gamma = kriging.model_gamma(F.col("model"), F.col("h"), F.lit(1.0), F.lit(5.0), F.lit(3000.0))
    return out(rows.groupBy("node_id", "model").agg(F.avg(gamma).alias("gamma")), "node_id", "model", gamma=6)


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kriging.fit_variograms(kriging.empirical_variogram(points(spark, sf_dir), ["node_id"]), ["node_id"])


@query()
def g4_fit(spark, sf_dir):
    """Fitted models, with the one that is best over all."""
    found = fits(spark, sf_dir)
    best = kriging.best_model(found)
    rows = found.join(F.broadcast(best.select(F.col("model").alias("best"))), F.lit(True)).withColumn("chosen", F.col("model") == F.col("best"))
    return out(rows, "node_id", "model", "chosen", nugget=4, sill=4, range_km=1, sse=5)


#: Least squares of each model by sums over bins, for 41 ranges in each of six ever narrower steps.
_FIT = f"""WITH RECURSIVE {_POINTS}, {_PAIRS}, {_BINS},
    vg AS (SELECT node_id, bin, (bin + 0.5) * reach / 12 AS h, avg(g) AS gamma FROM b GROUP BY node_id, bin, reach),
    s AS (
        SELECT 0 AS level, node_id, model, ln(greatest(min(h) * 0.05, 0.001)) AS lo, ln(max(h) * 20) AS hi, NULL::DOUBLE AS sse
        FROM vg, (VALUES ('spherical'), ('exponential'), ('gaussian')) m(model) GROUP BY node_id, model HAVING count(*) >= 3
        UNION ALL
        (WITH tr AS (SELECT s.*, i, exp(lo + (hi - lo) * i / 40) AS reach FROM s, range(41) r(i) WHERE level < 6),
        sh AS (SELECT tr.*, gamma, CASE WHEN model = 'spherical' THEN CASE WHEN h < tr.reach THEN 1.5 * h / tr.reach - 0.5 * pow(h / tr.reach, 3) ELSE 1 END WHEN model = 'exponential' THEN 1 - exp(-h / tr.reach) ELSE 1 - exp(-pow(h / tr.reach, 2)) END AS y FROM tr JOIN vg USING (node_id)),
        m AS (SELECT level, node_id, model, lo, hi, i, sum((1 - y) * (1 - y)) AS aa, sum(y * y) AS ss, sum((1 - y) * y) AS a_s, sum((1 - y) * gamma) AS ag, sum(y * gamma) AS sg, sum(gamma * gamma) AS gg FROM sh GROUP BY ALL),
        c AS (
            SELECT *, (ag * ss - sg * a_s) / (aa * ss - a_s * a_s) AS n, (sg * aa - ag * a_s) / (aa * ss - a_s * a_s) AS t FROM m WHERE aa * ss - a_s * a_s > 1e-12 * aa * ss
            UNION ALL SELECT *, 0, greatest(sg / ss, 1e-6) FROM m WHERE ss > 0
            UNION ALL SELECT *, greatest((ag - 1e-6 * a_s) / aa, 0), 1e-6 FROM m WHERE aa > 0),
        e AS (SELECT level, node_id, model, lo, hi, i, min(gg - 2 * n * ag - 2 * t * sg + n * n * aa + 2 * n * t * a_s + t * t * ss) AS sse FROM c WHERE n >= 0 AND t >= 1e-6 GROUP BY ALL),
        k AS (SELECT level, node_id, model, lo, hi, arg_min(i, struct_pack(sse := sse, i := i)) AS i, min(sse) AS sse FROM e GROUP BY ALL)
        SELECT level + 1, node_id, model, lo + (hi - lo) * greatest(i - 1, 0) / 40, lo + (hi - lo) * least(i + 1, 40) / 40, sse FROM k)),
    f AS (SELECT node_id, model, sse FROM s WHERE level = 6), best AS (SELECT model FROM f GROUP BY model ORDER BY avg(sse), model LIMIT 1)"""


@query(f"{_FIT} SELECT node_id, model, model = (SELECT model FROM best) AS chosen, round(sse, 4) AS sse FROM f")
def g4_least_errors(spark, sf_dir):
    """Each fit's squared error, and the model of the least mean error."""
    found = stored(fits(spark, sf_dir), "fits")
    return out(found.withColumn("chosen", F.col("model") == kriging.best_model(found).first()["model"]), "node_id", "model", "chosen", sse=4)


@query(f"WITH {_POINTS} SELECT node_id, count(*) AS samples, CAST(0 AS BIGINT) AS missed FROM sp GROUP BY node_id")
def g6_kriging_at_samples(spark, sf_dir):
    """Kriged at the places of its own samples, every group gives their values.

    The model is one of short reach. Under a model that is smooth over a long way the 1e-6 on the system's diagonal
    counts, and samples come back smoothed.
    """
    pts = stored(points(spark, sf_dir), "points")
    model = pts.select("node_id").distinct().select("node_id", F.lit("spherical").alias("model"), F.lit(1.0).alias("nugget"), F.lit(5.0).alias("sill"), F.lit(300.0).alias("range_km"))
    kriged = kriging.krige(pts, model, pts.select("lat", "lon").distinct(), ["node_id"])
    both = pts.join(kriged.withColumnRenamed("value", "found"), ["node_id", "lat", "lon"], "left")
    near = F.coalesce(F.abs(F.col("found") - F.col("value")) < 1e-3, F.lit(False))
    return both.groupBy("node_id").agg(F.count(F.lit(1)).alias("samples"), F.sum((~near).cast("long")).alias("missed"))


@query()
def g6_kriging(spark, sf_dir):
    """The samples kriged on the 5 degree grid."""
    found = fits(spark, sf_dir)
    pts = points(spark, sf_dir)
    grid = fields.target_grid(-20.0, 60.0, 0.0, 180.0, 5.0, pts)
    return out(kriging.krige(pts, kriging.use_model(found, kriging.best_model(found)), grid, ["node_id"]), "node_id", "lat", "lon", value=4)


@query(f"WITH {fx.sql_field(by='month')}, ta AS (SELECT CAST(5 * i - 20 AS DOUBLE) AS t FROM range(17) r(i)), tb AS (SELECT CAST(5 * i AS DOUBLE) AS t FROM range(37) r(i)), la AS (SELECT t, (SELECT lat FROM (SELECT DISTINCT lat FROM field) ORDER BY abs(lat - t), lat LIMIT 1) AS s FROM ta), lo AS (SELECT t, (SELECT lon FROM (SELECT DISTINCT lon FROM field) ORDER BY abs(lon - t), lon LIMIT 1) AS s FROM tb) SELECT time, la.t AS lat, lo.t AS lon, round(value, 6) AS value FROM field JOIN la ON field.lat = la.s JOIN lo ON field.lon = lo.s")
def g7_target_grid(spark, sf_dir):
    """The monthly field on the 5 degree grid."""
    df = fx.field(spark, sf_dir, by="month")
    grid = fields.target_grid(-20.0, 60.0, 0.0, 180.0, 5.0, df)
    return out(fields.nearest_regrid(df, grid.select("lat"), grid.select("lon")), "time", "lat", "lon", value=6)


def union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return whole
