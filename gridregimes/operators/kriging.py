"""Variograms of composite maps, models fitted to them, and ordinary kriging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import small
from ..functions.storage import stored
from .percentiles import exact_percentile

EARTH_KM = 6371.0
MODELS = ("spherical", "exponential", "gaussian")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s, c = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * c * c
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def sample_points(points: DataFrame, keys: list[str], n: int = 500, rank: Column | None = None) -> DataFrame:
    """At most ``n`` points of each group, by a hash of their place: the same whatever the partitions. Adds pid from 0."""
    rank = F.xxhash64("lat", "lon", F.lit(42)) if rank is None else rank
    w = Window.partitionBy(*keys).orderBy(rank, "lat", "lon")
    ranked = points.where("value IS NOT NULL").withColumn("pid", F.row_number().over(w))
    # a bound on the rank itself lets each task cut its groups before the shuffle
    return ranked.where(F.col("pid") <= n).withColumn("pid", F.col("pid") - 1)


#: Points of a block: two blocks of a group meet in one group of rows.
BLOCK = 256


def pairs(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, g): distance and half squared difference of each two points (pid from 0, without gaps) of a group.

    Points go by blocks of pid: block i meets block j of its group for i <= j, as rows of their own key, so a large group
    spreads over as many tasks as it has pairs of blocks, and each pair is met once.
    """
    n = points.groupBy(*keys).agg((F.floor(F.max("pid") / BLOCK) + 1).alias("_blocks")).withColumnsRenamed({k: f"_{k}" for k in keys})
    own = points.join(small(n, 64), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).withColumn("_own", F.floor(F.col("pid") / BLOCK))
    cols = ("pid", "lat", "lon", "value")
    left = own.select(*keys, *cols, F.col("_own").alias("_i"), F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1)).alias("_j"))
    right = own.select(*[F.col(k).alias(f"{k}_2") for k in keys], *(F.col(c).alias(f"{c}_2") for c in cols), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_own"))).alias("_i2"), F.col("_own").alias("_j2"))
    on = [F.col(k).eqNullSafe(F.col(f"{k}_2")) for k in keys] + [F.col("_i") == F.col("_i2"), F.col("_j") == F.col("_j2")]
    rows = left.join(right, on).where("pid < pid_2")
    d = F.col("value") - F.col("value_2")
    return rows.select(*keys, haversine(F.col("lat"), F.col("lon"), F.col("lat_2"), F.col("lon_2")).alias("h"), (d * d / 2).alias("g"))


def empirical_variogram(points: DataFrame, keys: list[str], bins: int = 12) -> DataFrame:
    """(keys, bin, h, gamma, n): means over equal right-open bins up to the 95th percentile of distances.

    Pairs are made again for each pass rather than kept: only points are stored and moved.
    """
    rows = pairs(stored(points, "points"), keys)
    reach = small(exact_percentile(rows, keys, "h", 0.95, "reach"), 64)
    rows = rows.join(reach, keys).where("h < reach")
    width = F.col("reach") / bins
    rows = rows.withColumn("bin", F.least(F.floor(F.col("h") / width), F.lit(bins - 1)).cast("int"))
    out = rows.groupBy(*keys, "bin").agg(F.first("reach").alias("reach"), F.avg("g").alias("gamma"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "bin", ((F.col("bin") + 0.5) * F.col("reach") / bins).alias("h"), "gamma", "n")


def model_gamma(model: Column, h: Column, nugget: Column, sill: Column, reach: Column) -> Column:
    x = h / reach
    spherical = F.when(h < reach, nugget + (sill - nugget) * (1.5 * x - 0.5 * x * x * x)).otherwise(sill)
    return F.when(model == "spherical", spherical).when(model == "exponential", nugget + (sill - nugget) * (1 - F.exp(-x))).when(model == "gaussian", nugget + (sill - nugget) * (1 - F.exp(-x * x)))


def _shape(model: str, x: np.ndarray) -> np.ndarray:
    if model == "spherical":
        return np.where(x < 1, 1.5 * x - 0.5 * x**3, 1.0)
    return 1 - np.exp(-x if model == "exponential" else -x * x)


def _linear(s: np.ndarray, gamma: np.ndarray) -> tuple[float, float, float]:
    """Best (nugget >= 0, sill >= 1e-6, sse) of gamma = nugget (1 - s) + sill s."""
    a = np.stack([1 - s, s], axis=1)
    best, *_ = np.linalg.lstsq(a, gamma, rcond=None)
    tries = [best] if best[0] >= 0 and best[1] >= 1e-6 else []
    for i, edge in ((0, 0.0), (1, 1e-6)):
        other, rest = a[:, 1 - i], gamma - edge * a[:, i]
        v = max(float(other @ rest / max(other @ other, 1e-300)), 1e-6 if i == 0 else 0.0)
        tries.append(np.array([edge, v] if i == 0 else [v, edge]))
    sse = [float(((a @ t - gamma) ** 2).sum()) for t in tries]
    k = int(np.argmin(sse))
    return float(tries[k][0]), float(tries[k][1]), sse[k]


def fit_model(model: str, h: np.ndarray, gamma: np.ndarray) -> tuple[float, float, float, float]:
    """(nugget, sill, range, sse): for a range the rest is linear, so only the range is searched, ever more finely."""
    lo, hi = np.log(max(h.min() * 0.05, 1e-3)), np.log(h.max() * 20)
    for _ in range(6):
        grid = np.linspace(lo, hi, 41)
        sse = [_linear(_shape(model, h / np.exp(r)), gamma)[2] for r in grid]
        k = int(np.argmin(sse))
        lo, hi = grid[max(k - 1, 0)], grid[min(k + 1, 40)]
    reach = float(np.exp(grid[k]))
    return (*_linear(_shape(model, h / reach), gamma)[:2], reach, sse[k])


def fit_variograms(variogram: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model, nugget, sill, range_km, sse) of each model for each group of three bins or more; a dozen rows each."""
    types = ", ".join(f"{k} {variogram.schema[k].dataType.simpleString()}" for k in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 3:
            return pd.DataFrame(columns=[*keys, "model", "nugget", "sill", "range_km", "sse"])
        pdf = pdf.sort_values("bin")
        rows = [(*pdf[keys].iloc[0], m, *fit_model(m, pdf["h"].to_numpy(), pdf["gamma"].to_numpy())) for m in MODELS]
        return pd.DataFrame(rows, columns=[*keys, "model", "nugget", "sill", "range_km", "sse"])

    return variogram.groupBy(*keys).applyInPandas(fit, f"{types}, model string, nugget double, sill double, range_km double, sse double")


def best_model(fits: DataFrame) -> DataFrame:
    """One row (model, mean_sse): least mean error over all groups. ValueError if no group has a fit."""
    best = fits.groupBy("model").agg(F.avg("sse").alias("mean_sse")).orderBy("mean_sse", "model").first()
    if best is None:
        raise ValueError("Variogram fit failed: no group has three bins")
    return fits.sparkSession.createDataFrame([tuple(best)], "model string, mean_sse double")


def use_model(fits: DataFrame, best: DataFrame) -> DataFrame:
    """Each group's parameters of the model that is best over all."""
    return fits.join(F.broadcast(best.select("model")), "model")


def krige(points: DataFrame, fits: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lat, lon, value): ordinary kriging of each group's sample at all targets (lat, lon).

    A task solves one group's system once, for the dual weights of its sample (500 points at most); predictions are a
    join of targets with weighted points and a sum.
    """
    types = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    rows = points.join(fits, keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        lat, lon = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy())
        a = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
        h = 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(a, 0, 1)))
        nugget, sill, reach, model = (pdf[c].iloc[0] for c in ("nugget", "sill", "range_km", "model"))
        k = np.ones((n + 1, n + 1))
        k[:n, :n] = sill - (nugget + (sill - nugget) * _shape(model, h / reach))
        k[np.arange(n), np.arange(n)] = sill - nugget + 1e-6
        k[n, n] = 0
        dual = np.linalg.solve(k, np.r_[pdf["value"].to_numpy(), 0.0])
        return pdf[[*keys, "lat", "lon", "model", "nugget", "sill", "range_km"]].assign(dual=dual[:n], mean=dual[n])

    dual = rows.groupBy(*keys).applyInPandas(solve, f"{types}, lat double, lon double, model string, nugget double, sill double, range_km double, dual double, mean double")
    at = dual.crossJoin(small(targets.select(F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon")), 16))
    cov = F.col("sill") - model_gamma(F.col("model"), haversine(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")), F.col("nugget"), F.col("sill"), F.col("range_km"))
    out = at.groupBy(*keys, "to_lat", "to_lon").agg((F.sum(cov * F.col("dual")) + F.first("mean")).alias("value"))
    return out.select(*keys, F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"), "value")
