"""Spectra and lagged correlations of series by fast transforms, and wavelets by a join with their kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grouped import by_length, by_series
from .series import detrend, lag1, with_place, z_score


def periodogram(series: DataFrame, keys: list[str], order: str = "year", least_period: float = 2.0, longest: float | None = None) -> DataFrame:
    """(keys, k, n, frequency, period, power) with power |DFT of the series less its mean|^2 / n, without frequency 0.

    Periods run from ``least_period`` to ``longest`` (half the series if not given), both included.
    """
    out = ordinates(series, keys, order)
    longest_ = F.lit(longest) if longest else F.col("n") / 2
    kept = (F.col("k") > 0) & (F.col("k") * least_period <= F.col("n")) & (F.col("k") * longest_ >= F.col("n"))
    return out.where(kept).select(*keys, "k", "n", "frequency", (F.col("n") / F.col("k")).alias("period"), "power")


def ordinates(series: DataFrame, keys: list[str], order: str = "year") -> DataFrame:
    """(keys, k, n, frequency, power) for k from 0 to n / 2 (1 at least)."""
    return by_series(series.select(*keys, F.col(order).alias("t"), "value"), keys, ["t"], _powers, "k int, n long, frequency double, power double")


def _powers(values: dict[str, np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A transform for all series of one length together; a missing value adds nothing."""
    parts = []
    for own, at in by_length(bounds):
        x = values["value"][at]
        n, there = at.shape[1], ~np.isnan(x)
        found = there.sum(1, keepdims=True)
        x = np.where(there, x - np.divide(np.where(there, x, 0).sum(1, keepdims=True), found, where=found > 0, out=np.zeros(found.shape)), 0)
        k = np.arange(max(n // 2, 1) + 1)
        power = np.abs(np.fft.rfft(x, axis=1)[:, k % n if n == 1 else k]) ** 2 / n
        power[found[:, 0] == 0] = np.nan
        parts.append((np.repeat(own, len(k)), np.tile(k, len(own)), np.full(power.size, n), np.tile(k / n, len(own)), power.ravel()))
    own, *columns = (np.concatenate(x) for x in zip(*parts))
    return own, columns


def red_noise(spectrum: DataFrame, series: DataFrame, keys: list[str], order: str = "year") -> DataFrame:
    """Adds red (AR(1) spectrum of the series), level95 and significant to a periodogram.

    red = var (1 - r^2) / (1 + r^2 - 2 r cos 2 pi f), r at lag 1 within 0.99, sample variance; level95 = red chi2 / 2.
    """
    r = F.greatest(F.least(F.coalesce("r1", F.lit(0.0)), F.lit(0.99)), F.lit(-0.99))
    ar = lag1(series, keys, order).select(*keys, r.alias("r1")).join(series.groupBy(*keys).agg(F.var_samp("value").alias("var")), keys)
    f = F.cos(F.lit(2 * math.pi) * F.col("frequency"))
    red = F.col("var") * (1 - F.col("r1") * F.col("r1")) / (1 + F.col("r1") * F.col("r1") - 2 * F.col("r1") * f)
    out = spectrum.join(ar, keys).withColumn("red", red).withColumn("level95", F.col("red") * (-math.log(0.05)))
    return out.withColumn("significant", F.col("power") > F.col("level95")).drop("var")


def normalised_spectrum(series: DataFrame, keys: list[str], order: str = "year") -> DataFrame:
    """(keys, k, n, frequency, power, r1, red, level95) of the detrended series at unit population variance.

    Frequencies are those from 0 to below 1/2: k < n / 2. red is the plain AR(1) shape, level95 that times chi2 / 2 at 95 %.
    """
    unit = z_score(detrend(series, keys, order), keys, ddof=0)
    spectrum = ordinates(unit, keys, order).where("2 * k < n")
    r = lag1(unit, keys, order)
    f = F.cos(F.lit(2 * math.pi) * F.col("frequency"))
    shape = (1 - F.col("r1") * F.col("r1")) / (1 + F.col("r1") * F.col("r1") - 2 * F.col("r1") * f)
    return spectrum.join(r, keys).withColumn("red", shape).withColumn("level95", F.col("red") * (-math.log(0.05)))


def peaks(spectrum: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """(keys, peak1_period, peak1_power, ...) of the strongest ordinates; of equal ones the higher frequency first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("power").desc(), F.col("k").desc()))
    rows = spectrum.withColumn("rank", rank).where(F.col("rank") <= top)
    cells = [F.max(F.when(F.col("rank") == i, F.col(c))).alias(f"peak{i}_{c}") for i in range(1, top + 1) for c in ("period", "power")]
    return rows.groupBy(*keys).agg(*cells)


def fisher_g(spectrum: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """g = strongest share of all power, its p by Fisher's sum, and whether it is rejected; null for n < 2 or no power."""
    out = spectrum.groupBy(*keys).agg(F.max("power").alias("top"), F.sum("power").alias("total"), F.count(F.lit(1)).cast("double").alias("m"))
    ok = (F.col("m") >= 2) & (F.col("total") > 0)
    out = out.withColumn("g", F.when(ok, F.try_divide(F.col("top"), F.nullif(F.col("total"), F.lit(0.0)))))
    last = F.least(F.floor(F.try_divide(F.lit(1.0), F.col("g"))), F.col("m")).cast("int")

    def add(acc: Column, k: Column) -> Column:
        c = acc["c"] * (F.col("m") - k + 1) / k  # binomial coefficient, one factor on
        sign = F.when(k % 2 == 1, 1.0).otherwise(-1.0)
        return F.struct(c.alias("c"), (acc["s"] + sign * c * F.pow(F.greatest(1 - k * F.col("g"), F.lit(0.0)), F.col("m") - 1)).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1), last), F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s")), add)["s"]
    out = out.withColumn("p", F.when(F.col("g").isNotNull(), F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))))
    return out.select(*keys, "g", "p", (F.col("p") < alpha).alias("reject"))


def cross_correlation(x: DataFrame, y: DataFrame, x_keys: list[str], y_keys: list[str], max_lag: int | None = None, order: str = "year") -> DataFrame:
    """(keys, lag, correlation, band) over common ``order``: sum of x(t + lag) y(t) / (sx sy n), population deviations.

    All lags from -(n - 1) to n - 1, or those within ``max_lag``; pairs beyond are not made. band is 1.96 / sqrt(n).
    """
    rows = x.select(*x_keys, order, F.col("value").alias("x")).join(y.select(*y_keys, order, F.col("value").alias("y")), order)
    keys = [*x_keys, *y_keys]
    rows = rows.select(*keys, F.col(order).alias("t"), "x", "y")

    def kernel(values: dict[str, np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        parts = []
        for own, at in by_length(bounds):
            n = at.shape[1]
            (a, sa, has_a), (b, sb, has_b) = (_centred(values[c][at]) for c in ("x", "y"))
            reach = n - 1 if max_lag is None else min(max_lag, n - 1)
            lag = np.arange(-reach, reach + 1)
            total, pairs = _products(a, b)[:, lag], np.rint(_products(has_a, has_b)[:, lag])
            s = (sa * sb)[:, None]
            found = np.divide(total, s * n, where=(s > 0) & (pairs > 0), out=np.full(total.shape, np.nan))
            parts.append((np.repeat(own, len(lag)), np.tile(lag, len(own)), np.full(total.size, n), found.ravel()))
        own, *columns = (np.concatenate(x) for x in zip(*parts))
        return own, columns

    out = by_series(rows, keys, ["t"], kernel, "lag int, n long, correlation double")
    return out.select(*keys, "lag", "correlation", (1.96 / F.sqrt(F.col("n").cast("double"))).alias("band"))


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values less their series' mean (0 where missing), population deviations (0 for a constant), and what is there."""
    there = ~np.isnan(x)
    n = np.maximum(there.sum(1, keepdims=True), 1)
    centred = np.where(there, x - np.where(there, x, 0).sum(1, keepdims=True) / n, 0)
    constant = np.where(there, x, np.inf).min(1) >= np.where(there, x, -np.inf).max(1)
    return centred, np.where(constant, 0, np.sqrt((centred**2).sum(1) / n[:, 0])), there.astype(float)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over t of a(t + lag) b(t) at place lag, negative lags from the end: a padded product of transforms."""
    size = 1 << int(2 * a.shape[1] - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)


def ricker_transform(series: DataFrame, keys: list[str], order: str = "year", first: float = 1.0, last: float = 7.9, step: float = 0.1) -> DataFrame:
    """(keys, scale, t, value): detrended series convolved with Ricker wavelets, as long as the series.

    A kernel has min(10 scale, n) points, centred; the convolution keeps the middle part.
    """
    rows = with_place(detrend(series, keys, order), keys, order).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    rows = rows.select(*keys, F.col("t").cast("int").alias("t"), "value", F.col("n").cast("int").alias("n"))
    count = int(round((last - first) / step))
    scales = F.explode(F.sequence(F.lit(0), F.lit(count))).alias("j")
    rows = rows.select(*keys, "t", "value", "n", scales).withColumn("scale", F.round(F.lit(first) + F.col("j") * step, 6))
    m = F.least(F.floor(F.round(F.col("scale") * 10, 6)), F.col("n")).cast("int")
    rows = rows.withColumn("m", m).select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    x = F.col("i") - (F.col("m") - 1) / 2.0
    u = (x / F.col("scale")) * (x / F.col("scale"))
    kernel = F.lit(2 / math.pi**0.25) / F.sqrt(3 * F.col("scale")) * (1 - u) * F.exp(-u / 2)
    at = F.col("t") + F.col("i") - F.floor((F.col("m") - 1) / 2).cast("int")
    rows = rows.select(*keys, "scale", at.alias("t"), "n", (F.col("value") * kernel).alias("v")).where("t >= 0 AND t < n")
    return rows.groupBy(*keys, "scale", "t").agg(F.sum("v").alias("value"))


def band_power(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, band, power): decadal for periods of 8 to 12, interannual for 2 to 7."""
    k, n = F.col("k"), F.col("n")
    band = F.when((12 * k >= n) & (8 * k <= n), "decadal").when((7 * k >= n) & (2 * k <= n), "interannual").otherwise("other")
    return spectrum.groupBy(*keys, band.alias("band")).agg(F.sum("power").alias("power"))
