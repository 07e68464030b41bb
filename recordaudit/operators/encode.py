"""Turning records into numbers: codes, epoch seconds, filling and scaling fitted on real rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordaudit.functions.scalars import DATETIME_TYPES, as_number, epoch_seconds
from recordaudit.operators import ranges
from recordaudit.operators.prep import assert_all_numeric, drop_features
from recordaudit.session import written

UNSEEN = -1


def ordinal_dictionary(real: DataFrame, columns) -> DataFrame:
    """(column_name, value, code): position of each distinct real value in sorted order.

    The values stay distributed and are ranked in ranges. The table is written by column, so
    each later join sees the true size of its own dictionary.
    """
    columns = list(columns)
    values = written(
        real.select(*[F.col(c).cast("string").alias(c) for c in columns])
        .unpivot([], columns, "column_name", "value")
        .where(F.col("value").isNotNull()).distinct())
    ranged = ranges.with_range(values, "column_name", "value",
                               ranges.text_bounds(values, "column_name", "value"))
    ranked = ranges.running(ranged.withColumn("_one", F.lit(1).cast("bigint")), ["column_name"], ["value"],
                            {"code": "_one"}, before=True)
    return written(ranked.select("column_name", "value", "code"), ["column_name"])


def ordinal_encode(df: DataFrame, dictionary: DataFrame, columns) -> DataFrame:
    """Replace each column by its code; a value that real rows never had becomes -1."""
    order = df.columns
    for c in columns:
        codes = dictionary.where(F.col("column_name") == c).select(
            F.col("value").alias(f"_{c}_value"), F.col("code").alias(f"_{c}_code"))
        df = df.join(codes, F.col(c).cast("string") == F.col(f"_{c}_value"), "left")
        df = df.withColumn(c, F.coalesce(F.col(f"_{c}_code"), F.lit(UNSEEN).cast("bigint"))).drop(
            f"_{c}_value", f"_{c}_code")
    return df.select(*order)


def datetimes_to_epoch(df: DataFrame) -> DataFrame:
    names = [f.name for f in df.schema.fields if f.dataType.typeName() in DATETIME_TYPES]
    return df.withColumns({c: epoch_seconds(c) for c in names}) if names else df


def prepare_for_prediction(real: DataFrame, candidates: DataFrame, encoded, dropped=(), without=(),
                           dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same encoding for both tables, fitted on real rows.

    ``without`` names the columns (keys, model) that are carried along unencoded.
    """
    encoded = [c for c in encoded if c in real.columns and c in candidates.columns and c not in dropped]
    if dictionary is None:
        dictionary = ordinal_dictionary(real, encoded)
    prepared = []
    for df in (real, candidates):
        df = drop_features(df, dropped)
        df = datetimes_to_epoch(ordinal_encode(df, dictionary, encoded))
        prepared.append(assert_all_numeric(df, without))
    return prepared[0], prepared[1]


# ---------------------------------------------------------------- fitted on real rows

def minmax_params(real: DataFrame, columns) -> DataFrame:
    """One row of minima and maxima, all columns in one pass."""
    return real.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def std_params(real: DataFrame, columns) -> DataFrame:
    """One row of means and population standard deviations."""
    return real.agg(*[f(c).alias(f"{c}_{n}") for c in columns
                      for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def fitted(params: DataFrame) -> dict[str, Column]:
    """The values of a one-row table as literals.

    One row, as wide as the schema. Literals keep later plans small; a scalar subquery per use
    would repeat the whole fitting plan in every scaled column.
    """
    return {name: F.lit(value) for name, value in params.first().asDict().items()}


def _or_one(width: Column) -> Column:
    return F.when(width == 0, 1.0).otherwise(width)


def minmax_scale(df: DataFrame, real: DataFrame, columns) -> DataFrame:
    """(x - min) / (max - min) of real rows, not clipped; a constant column is divided by 1."""
    fit = fitted(minmax_params(real, columns))
    return df.withColumns({
        c: (F.col(c) - fit[f"{c}_min"]) / _or_one(fit[f"{c}_max"] - fit[f"{c}_min"]) for c in columns})


def standard_scale(df: DataFrame, real: DataFrame, columns) -> DataFrame:
    """(x - mean) / population deviation of real rows; a constant column is divided by 1."""
    fit = fitted(std_params(real, columns))
    return df.withColumns({
        c: (F.col(c) - fit[f"{c}_mean"]) / _or_one(fit[f"{c}_std"]) for c in columns})


def real_medians(real: DataFrame, columns) -> DataFrame:
    """One row with the exact median of every column."""
    types = dict(real.dtypes)
    long = real.select(*[as_number(c, types[c]).alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value")
    halves = ranges.exact_quantiles(long, "column_name", "value", [0.5])
    return halves.agg(*[F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(c) for c in columns])


def fill_real_median(df: DataFrame, medians: DataFrame, columns) -> DataFrame:
    """Replace nulls by the real median."""
    fit = fitted(medians)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), fit[c]) for c in columns})
