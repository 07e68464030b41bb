"""Principal components of the real rows and where the candidates fall on them."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, Window as W, functions as F

from recordaudit.operators.encode import minmax_scale
from recordaudit.operators.prep import fill_zero


def scale_for_components(real: DataFrame, candidates: DataFrame, columns) -> tuple[DataFrame, DataFrame]:
    """Nulls become 0, then min-max scaling fitted on real rows."""
    real, candidates = fill_zero(real, columns), fill_zero(candidates, columns)
    return minmax_scale(real, real, columns), minmax_scale(candidates, real, columns)


def _fit(scaled_real: DataFrame, columns, k: int):
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_features").transform(scaled_real)
    fit = PCA(k=k, inputCol="_features", outputCol="_projected").fit(vectors)
    loadings = fit.pc.toArray()
    # Fix the sign: the largest loading of each component is positive.
    largest = np.abs(loadings).argmax(axis=0)
    loadings = loadings * np.sign(loadings[largest, np.arange(k)])
    return loadings, fit.explainedVariance.toArray()


def pca_explained(scaled_real: DataFrame, columns) -> DataFrame:
    """(component, ratio, cumulative) for all components; one row per feature."""
    columns = list(columns)
    _, ratios = _fit(scaled_real, columns, len(columns))
    rows = [(i + 1, float(r)) for i, r in enumerate(ratios)]
    table = scaled_real.sparkSession.createDataFrame(rows, "component int, ratio double")
    return cumulative_variance(table)


def cumulative_variance(ratios: DataFrame) -> DataFrame:
    """Running sum of the ratios; as many rows as features."""
    order = W.orderBy("component").rowsBetween(W.unboundedPreceding, W.currentRow)
    return ratios.withColumn("cumulative", F.sum("ratio").over(order))


def pca_project(scaled_real: DataFrame, tables: list[DataFrame], columns, keep, k: int = 2) -> list[DataFrame]:
    """First k components fitted on real rows, applied to each table; the real mean is subtracted."""
    columns = list(columns)
    loadings, ratios = _fit(scaled_real, columns, k)
    centre = scaled_real.agg(*[F.avg(c).alias(c) for c in columns]).first()

    def component(j):
        terms = [(F.col(c) - centre[c]) * float(loadings[i, j]) for i, c in enumerate(columns)]
        return reduce(lambda a, b: a + b, terms).alias(f"pc{j + 1}")

    shares = [F.bround(F.lit(float(r)) * 100, 1).alias(f"pc{j + 1}_variance_pct") for j, r in enumerate(ratios)]
    return [t.select(*keep, *[component(j) for j in range(k)], *shares) for t in tables]


def operational_points(real: DataFrame, candidates: DataFrame, model: str, x: str, y: str) -> DataFrame:
    """(model, x, y) of all real and candidate rows."""
    return real.select(F.lit("real").alias(model), x, y).unionByName(candidates.select(model, x, y))


def operational_corr(points: DataFrame, model: str, x: str, y: str) -> DataFrame:
    """Correlation and slope of two attributes per model, and the gap to the real rows."""
    per_model = points.groupBy(model).agg(F.count("*").alias("rows"), F.corr(x, y).alias("correlation"),
                                          F.regr_slope(y, x).alias("slope"))
    everywhere = W.partitionBy(F.lit(1))  # one row per model
    real = F.max(F.when(F.col(model) == "real", F.col("correlation"))).over(everywhere)
    return per_model.withColumn("gap_to_real", F.abs(F.col("correlation") - real))
