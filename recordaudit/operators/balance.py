"""Shares of delayed, on-time and unknown rows per data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordaudit.functions.scalars import round_pct


def class_balance(df: DataFrame, model: str, labels: dict[str, str]) -> DataFrame:
    """Counts and percentages of each delay label (short name → column) per model, in one pass."""
    n = F.count("*")
    measures = [n.alias("n")]
    for short, column in labels.items():
        late, on_time = F.count_if(F.col(column) == 1), F.count_if(F.col(column) == 0)
        measures += [late.alias(f"delayed_{short}"), on_time.alias(f"on_time_{short}"),
                     F.count_if(F.col(column).isNull()).alias(f"unknown_{short}"),
                     round_pct(late, n).alias(f"delayed_{short}_pct"),
                     round_pct(on_time, n).alias(f"on_time_{short}_pct")]
    return df.groupBy(model).agg(*measures)


def value_counts(df: DataFrame, model: str, columns: list[str]) -> DataFrame:
    """Rows per value of each label column, unknown included, sorted by value."""
    long = df.select(model, *columns).unpivot([model], columns, "feature", "value")
    return long.groupBy(model, "feature", "value").agg(F.count("*").alias("n")).orderBy(model, "feature", "value")
