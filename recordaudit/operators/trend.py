"""Smoothed trends and plot limits of a result table by augmentation size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SHARE = 0.3
ROBUST_PASSES = 3


def _local_fit(x: np.ndarray, y: np.ndarray, trust: np.ndarray, share: float) -> np.ndarray:
    """Weighted straight line around every point, tricube weights over the nearest share."""
    n = len(x)
    k = max(2, int(share * n + 1e-10))
    gap = np.abs(x[:, None] - x[None, :])
    reach = np.sort(gap, axis=1)[:, k - 1:k]
    with np.errstate(divide="ignore", invalid="ignore"):
        closeness = np.where(reach > 0, gap / reach, np.where(gap > 0, 1.0, 0.0))
    weight = np.where(closeness < 1, (1 - closeness ** 3) ** 3, 0.0) * trust[None, :]
    mass = weight.sum(axis=1)
    total = np.where(mass > 0, mass, 1.0)
    mean_x, mean_y = weight @ x / total, weight @ y / total
    off = x[None, :] - mean_x[:, None]
    spread = (weight * off ** 2).sum(axis=1)
    joint = (weight * off * y[None, :]).sum(axis=1)
    flat = spread <= 1e-12 * max(1.0, np.ptp(x)) ** 2
    slope = np.where(flat, 0.0, joint / np.where(flat, 1.0, spread))
    return np.where(mass > 0, mean_y + slope * (x - mean_x), y)  # no trusted point near: keep y


def lowess(x: np.ndarray, y: np.ndarray, share: float = SHARE, passes: int = ROBUST_PASSES) -> np.ndarray:
    """Locally weighted regression at every x with bisquare re-weighting of outliers.

    Residuals that are rounding noise next to the spread of y count as 0. If most are 0, the others are
    outliers and get no weight.
    """
    trust = np.ones(len(x))
    fitted = _local_fit(x, y, trust, share)
    noise = 1e-10 * max(float(np.ptp(y)), float(np.max(np.abs(y)))) if len(y) else 0.0
    for _ in range(passes):
        residual = np.abs(y - fitted)
        residual = np.where(residual <= noise, 0.0, residual)
        middle = np.median(residual)
        if middle == 0:
            trust = (residual == 0).astype(float)
        else:
            trust = np.where(residual < 6 * middle, (1 - (residual / (6 * middle)) ** 2) ** 2, 0.0)
        fitted = _local_fit(x, y, trust, share)
    return fitted


def lowess_trend(results: DataFrame, model: str, x: str, y: str, share: float = SHARE) -> DataFrame:
    """(model, x, y, trend). One group holds one model's sizes: first reduced to one row per size."""
    points = results.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(model, x).agg(F.avg(y).alias(y))

    def smooth(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(x, ignore_index=True)
        trend = lowess(rows[x].to_numpy(dtype=float), rows[y].to_numpy(dtype=float), share)
        return pd.DataFrame({model: rows[model], x: rows[x].astype(float), y: rows[y], "trend": trend})

    return points.groupBy(model).applyInPandas(smooth, f"{model} string, {x} double, {y} double, trend double")


def axis_extent(results: DataFrame, metric: str, baseline: Column) -> DataFrame:
    """Limits of a plot axis: the metric's range with the baseline and 5 % margin."""
    return results.agg(F.greatest(F.max(metric), baseline).alias("high"),
                       F.least(F.min(metric), baseline).alias("low")).withColumn(
        "margin", (F.col("high") - F.col("low")) * 0.05)
