"""Distance of candidates to the closest real record, and signs of copying."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordaudit.operators.encode import fill_real_median, fitted, real_medians, standard_scale
from recordaudit.operators.neighbours import BoxIndex, nearest
from recordaudit.operators.ranges import exact_quantiles

COPY_DISTANCE = 0.05


def scaled_features(real: DataFrame, candidates: DataFrame, key: str, columns, model: str = "model"):
    """Numeric columns of both tables: nulls → real median, scaled by real mean and deviation."""
    columns = list(columns)
    medians = real_medians(real, columns)
    filled = fill_real_median(real, medians, columns)
    other = fill_real_median(candidates, medians, columns)
    return (standard_scale(filled, filled, columns).select(key, *columns),
            standard_scale(other, filled, columns).select(key, model, *columns))


def nearest_real(real: DataFrame | BoxIndex, candidates: DataFrame, key: str, columns, model: str = "model") -> DataFrame:
    """(key, model, dcr) for scaled tables, or for an index of the real one."""
    found = nearest(candidates, real, key, columns)
    return candidates.select(key, model).join(found.select(key, F.col("distance").alias("dcr")), key)


def nearest_other_real(real: DataFrame, key: str, columns, index: BoxIndex | None = None) -> DataFrame:
    """(key, dcr): distance of each real row to the closest other real row."""
    return nearest(real, index or real, key, columns, exclude_self=True).select(key, F.col("distance").alias("dcr"))


def dcr_stats(dcr: DataFrame, model: str = "model") -> DataFrame:
    """Mean, median, minimum, maximum and the share of likely copies per model."""
    simple = dcr.groupBy(model).agg(
        F.count("*").alias("rows"), F.avg("dcr").alias("mean_dcr"), F.min("dcr").alias("min_dcr"),
        F.max("dcr").alias("max_dcr"), F.count_if(F.col("dcr") < COPY_DISTANCE).alias("copies"))
    median = exact_quantiles(dcr, model, "dcr", [0.5]).select(model, F.col("dcr").alias("median_dcr"))
    return simple.join(median, model).withColumn("copies_pct", F.col("copies") / F.col("rows") * 100)


def dcr_ratio(stats: DataFrame, baseline: DataFrame) -> DataFrame:
    """Compare with the mean distance between real rows; a ratio below 1 is flagged.

    Where every real row has an equal one the ratio is infinite, or NaN for candidates that are copies throughout.
    """
    base = fitted(baseline.agg(F.avg("dcr").alias("mean")))["mean"]
    mean = F.col("mean_dcr")
    without = F.when(mean > 0, float("inf")).when(mean == 0, float("nan"))
    return (
        stats.withColumn("baseline_dcr", base)
        .withColumn("dcr_ratio", F.when(base == 0, without).otherwise(mean / base))
        .withColumn("suspected", F.col("dcr_ratio") < 1)
    )
