"""Row and column preparation: filters, labels, projections and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

CANCELLED = "C"
RARE = "D"


def require(df: DataFrame, columns) -> None:
    """Spark ignores absent columns in ``drop``; a wrong name must be an error instead."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")


def drop_cancelled(df: DataFrame, status: str = "status") -> DataFrame:
    """Remove cancelled rows; rows with unknown status stay."""
    return df.where(~F.col(status).eqNullSafe(CANCELLED))


def cancelled_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows before, removed and after, in one pass."""
    gone = F.col(status).eqNullSafe(CANCELLED)
    return df.agg(F.count("*").alias("rows_before"), F.count_if(gone).alias("rows_removed"),
                  F.count_if(~gone).alias("rows_after"))


def binary_label(df: DataFrame, label: str, status: str = "status") -> DataFrame:
    """1 for the rare class, 0 for anything else, null included."""
    return df.withColumn(label, F.when(F.col(status).eqNullSafe(RARE), 1).otherwise(0))


def drop_features(df: DataFrame, columns) -> DataFrame:
    require(df, columns)
    return df.drop(*columns)


def simplify(df: DataFrame, label: str, dropped, status: str = "status") -> DataFrame:
    """Drop cancelled rows, add the label, drop the columns that are not modelled."""
    return drop_features(binary_label(drop_cancelled(df, status), label, status), dropped)


def rare_class(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label) == 1)


def project_order(df: DataFrame, columns) -> DataFrame:
    require(df, columns)
    return df.select(*columns)


def common_columns(df: DataFrame, other: DataFrame) -> list[str]:
    theirs = set(other.columns)
    return [c for c in df.columns if c in theirs]


def restrict_to(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order."""
    return df.select(*common_columns(like, df))


def numeric_columns(df: DataFrame, without=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in without]


def select_numeric(df: DataFrame, keep=()) -> DataFrame:
    return df.select(*keep, *numeric_columns(df, without=keep))


def fill_zero(df: DataFrame, columns) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def assert_all_numeric(df: DataFrame, without=()) -> DataFrame:
    """Pass the table through, or raise with the names of the columns that are not numeric."""
    wrong = [f.name for f in df.schema.fields
             if f.name not in without and not isinstance(f.dataType, NumericType)]
    if wrong:
        raise ValueError(f"non-numeric columns remain: {wrong}")
    return df


def stack_real_and_candidates(real: DataFrame, candidates: DataFrame, tag: str = "source") -> DataFrame:
    """Stack both tables by name with a constant tag: real 1, candidate 0."""
    return real.withColumn(tag, F.lit(1)).unionByName(candidates.withColumn(tag, F.lit(0)))
