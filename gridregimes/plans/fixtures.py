"""The driver's tables as fields, labels and index series, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(spark: SparkSession, sf_dir: str, variable: str = "quantity", by: str = "day") -> DataFrame:
    """Daily (or weekly, monthly) mean of a lineitem column on a 5 x 5 grid of nations."""
    column = {"quantity": "l_quantity", "discount": "l_discount", "price": "l_extendedprice"}[variable]
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    day = F.col("l_shipdate").cast("date")
    time = day if by == "day" else F.date_trunc(by, day).cast("date")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", time.alias("time"), F.col(column).alias("v"))
    rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    cell = F.col("n_nationkey").cast("long")
    return rows.groupBy("time", cell.alias("cell_id"), F.col("n_regionkey")).agg(F.avg("v").alias("value")).select(
        F.lit(variable).alias("variable"), "time", "cell_id", (20.0 * F.col("n_regionkey") - 20).cast("double").alias("lat"), (100.0 + 20 * F.floor(F.col("cell_id") / 5)).cast("double").alias("lon"), "value")


def labels(spark: SparkSession, sf_dir: str, skew: bool = False) -> DataFrame:
    """(time, node_id) of each day with a shipment: nodes 1 to 9 by a hash that SQL shares; ``skew`` gives node 9 half."""
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("time")).distinct()
    x = F.unix_date("time").cast("long") * 7919 % 104729
    node = F.least(F.lit(9), 1 + x % 17) if skew else 1 + x % 9
    return days.select("time", node.cast("int").alias("node_id"))


def indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index_name, date, value): monthly mean order value by priority, in units of 997 (a mean of cents then never ends in a 5 to be rounded)."""
    o = table(spark, sf_dir, "orders")
    month = F.date_trunc("month", F.col("o_orderdate").cast("date")).cast("date")
    return o.groupBy(F.col("o_orderpriority").alias("index_name"), month.alias("date")).agg((F.avg("o_totalprice") / 997).alias("value"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, day, value): daily mean."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("value"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def sql_field(variable: str = "quantity", by: str = "day", name: str = "field") -> str:
    column = {"quantity": "l_quantity", "discount": "l_discount", "price": "l_extendedprice"}[variable]
    day = "CAST(l_shipdate AS DATE)" if by == "day" else f"CAST(date_trunc('{by}', CAST(l_shipdate AS DATE)) AS DATE)"
    return f"""{name} AS (SELECT '{variable}' AS variable, {day} AS time, CAST(n_nationkey AS BIGINT) AS cell_id, CAST(20.0 * n_regionkey - 20 AS DOUBLE) AS lat,
        CAST(100.0 + 20 * (n_nationkey // 5) AS DOUBLE) AS lon, avg({column}) AS value
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""


SQL_DAYS = "days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS time FROM lineitem)"
SQL_LABELS = f"{SQL_DAYS}, labels_ AS (SELECT time, CAST(1 + (CAST(time - DATE '1970-01-01' AS BIGINT) * 7919 % 104729) % 9 AS INTEGER) AS node_id FROM days)"
SQL_SKEWED = f"{SQL_DAYS}, labels_ AS (SELECT time, CAST(least(9, 1 + (CAST(time - DATE '1970-01-01' AS BIGINT) * 7919 % 104729) % 17) AS INTEGER) AS node_id FROM days)"
SQL_INDEX = "index_ AS (SELECT o_orderpriority AS index_name, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS date, avg(o_totalprice) / 997 AS value FROM orders GROUP BY ALL)"
SQL_EVENTS = "event_series AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY ALL)"


def sql_t(t: str, dof: str, steps: int = 4000) -> str:
    """Two-sided p of Student's t by Simpson's rule over the angle."""
    a = f"atan(abs({t}) / sqrt({dof}))"
    h = f"((pi() / 2 - {a}) / {steps})"
    total = f"list_sum([(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(greatest(cos({a} + {h} * i), 0), {dof} - 1) for i in range({steps + 1})])"
    return f"(CASE WHEN {t} IS NULL OR {dof} IS NULL OR {dof} <= 0 THEN NULL ELSE 2 * exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi()) * {h} / 3 * {total} END)"


def sql_erfc(x: str, steps: int = 2000) -> str:
    h = f"(greatest(8 - {x}, 0) / {steps})"
    total = f"list_sum([(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({x} + {h} * i, 2)) for i in range({steps + 1})])"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE 2 / sqrt(pi()) * {h} / 3 * {total} END)"


def sql_binomial(k: str, n: str, p: float) -> str:
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))"
    return f"(CASE WHEN {k} <= 0 THEN 1.0 ELSE list_sum([{term} for i in range(CAST({k} AS BIGINT), CAST({n} AS BIGINT) + 1)]) END)"


def sql_r(x: str, y: str) -> str:
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END), 0))"


def sql_r_p(r: str, n: str) -> str:
    t = f"({r} * sqrt({n} - 2) / sqrt(1 - {r} * {r}))"
    return f"(CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN abs({r}) >= 1 - 1e-12 THEN 0 ELSE {sql_t(t, f'({n} - 2)')} END)"
