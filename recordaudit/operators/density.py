"""Histogram and kernel density curves per model and feature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

HISTOGRAM_BINS = 80
GRID_POINTS = 200
GRID_CUT = 3
MAX_SERIES = 10_000


def _long(df: DataFrame, model: str, columns) -> DataFrame:
    return df.select(model, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [model], list(columns), "feature", "value").where(F.col("value").isNotNull())


def _series_stats(long: DataFrame, model: str) -> list:
    """One row per model and feature; the number of models is checked."""
    stats = long.groupBy(model, "feature").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_samp("value").alias("sd"),
        F.count("*").alias("n")).limit(MAX_SERIES + 1).collect()
    if len(stats) > MAX_SERIES:
        raise ValueError(f"more than {MAX_SERIES} curves: is {model} really the model column?")
    return stats


def _small(df: DataFrame, rows: list, schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # at most MAX_SERIES rows


def histogram_density(df: DataFrame, model: str, columns, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(model, feature, bin, bin_start, n, density): equal-width bins of each set's own range."""
    long = _long(df, model, columns)
    edges = []
    for r in _series_stats(long, model):
        low, high = (r.low, r.high) if r.low < r.high else (r.low - 0.5, r.high + 0.5)
        edges.append((r[model], r.feature, low, (high - low) / bins, high - low, float(r.n)))
    edges = _small(df, edges, f"{model} string, feature string, low double, width double, span double, total double")
    placed = long.join(edges, [model, "feature"]).withColumn("bin", F.least(
        F.floor((F.col("value") - F.col("low")) / F.col("span") * bins), F.lit(bins - 1)).cast("int"))
    counted = placed.groupBy(model, "feature", "bin").agg(F.count("*").alias("n"))
    return counted.join(edges, [model, "feature"]).select(
        model, "feature", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"), "n",
        (F.col("n") / (F.col("total") * F.col("width"))).alias("density"))


def kde_density(df: DataFrame, model: str, columns, bandwidth_factor: float = 1.0) -> DataFrame:
    """(model, feature, point, x, density): Gaussian kernels, Scott's bandwidth, 200 grid points.

    The grid reaches three bandwidths beyond the data. Each task adds up the kernels of its own
    distinct values, so only grid-sized partial sums are shuffled.
    """
    long = _long(df, model, columns)
    grids = {}
    for r in _series_stats(long, model):
        if r.n < 2 or not r.sd:
            continue  # no spread, no curve
        width = r.sd * float(r.n) ** -0.2 * bandwidth_factor
        grids[(r[model], r.feature)] = (
            width, float(r.n), np.linspace(r.low - GRID_CUT * width, r.high + GRID_CUT * width, GRID_POINTS))

    def partial_sums(batches):
        sums = {}
        for batch in batches:
            for series, rows in batch.groupby([model, "feature"]):
                if series not in grids:
                    continue
                width, _, grid = grids[series]
                total = sums.setdefault(series, np.zeros(GRID_POINTS))
                for start in range(0, len(rows), 4096):
                    part = rows.iloc[start:start + 4096]
                    gap = (grid[None, :] - part["value"].to_numpy()[:, None]) / width
                    total += part["n"].to_numpy(dtype=float) @ np.exp(-0.5 * gap ** 2)
        for (name, feature), total in sums.items():
            yield pd.DataFrame({model: name, "feature": feature,
                                "point": np.arange(GRID_POINTS, dtype="int32"), "total": total})

    counts = long.groupBy(model, "feature", "value").agg(F.count("*").alias("n"))
    sums = counts.mapInPandas(partial_sums, f"{model} string, feature string, point int, total double")
    axes = _small(df, [(m, f, float(g[0]), float((g[-1] - g[0]) / (GRID_POINTS - 1)),
                        float(n * w * np.sqrt(2 * np.pi))) for (m, f), (w, n, g) in grids.items()],
                  f"{model} string, feature string, start double, step double, scale double")
    return sums.groupBy(model, "feature", "point").agg(F.sum("total").alias("total")).join(
        axes, [model, "feature"]).select(
        model, "feature", "point", (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        (F.col("total") / F.col("scale")).alias("density"))
