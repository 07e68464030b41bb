"""Classification metrics from a scored table (label, prediction, score), per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordaudit.operators import ranges


def confusion_counts(scored: DataFrame, by: list[str], label: str = "label",
                     prediction: str = "prediction", rows: str | None = None) -> DataFrame:
    """One row per group with tp, fp, fn and tn; a row of ``scored`` counts once, or as many times as ``rows`` says."""
    actual, predicted = F.col(label) == 1, F.col(prediction) == 1

    def count(which: Column) -> Column:
        return F.count_if(which) if rows is None else F.coalesce(F.sum(F.when(which, F.col(rows))), F.lit(0))

    return scored.groupBy(*by).agg(
        count(actual & predicted).alias("tp"), count(~actual & predicted).alias("fp"),
        count(actual & ~predicted).alias("fn"), count(~actual & ~predicted).alias("tn"))


def confusion_matrix(scored: DataFrame, by: list[str], label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """One row per actual class, one column per predicted class."""
    return scored.groupBy(*by, label).pivot(prediction, [0, 1]).count().fillna(0, ["0", "1"]).withColumnsRenamed(
        {"0": "predicted_0", "1": "predicted_1"})


def _share(part: Column, whole: Column) -> Column:
    """A ratio that is 0 when nothing can be counted."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def f1() -> Column:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _share(2 * tp, 2 * tp + fp + fn)


def balanced_accuracy() -> Column:
    """Mean recall of the classes that occur."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    classes = F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)
    return (_share(tp, tp + fn) + _share(tn, tn + fp)) / classes


def mcc() -> Column:
    """Matthews correlation; 0 when a margin is empty."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return _share(tp * tn - fp * fn, spread)


def classification_report(counts: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class, their plain and weighted means, and accuracy."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def of(hit, wrong, missed):
        return _share(hit, hit + wrong), _share(hit, hit + missed), _share(2 * hit, 2 * hit + wrong + missed)

    ones, zeros = of(tp, fp, fn), of(tn, fn, fp)
    n1, n0 = tp + fn, tn + fp
    names = ("precision", "recall", "f1")

    def row(title, values, support):
        return F.struct(F.lit(title).alias("class"), *[v.alias(n) for n, v in zip(names, values)],
                        support.alias("support"))

    plain = tuple((a + b) / 2 for a, b in zip(zeros, ones))
    weighted = tuple(_share(a * n0 + b * n1, n0 + n1) for a, b in zip(zeros, ones))
    accuracy = _share(tp + tn, n0 + n1)
    rows = F.array(row("0", zeros, n0), row("1", ones, n1), row("macro avg", plain, n0 + n1),
                   row("weighted avg", weighted, n0 + n1), row("accuracy", (accuracy,) * 3, n0 + n1))
    return counts.select(*by, F.inline(rows))


def average_precision(scored: DataFrame, by: str, label: str = "label", score: str = "score", rows: str | None = None) -> DataFrame:
    """Precision summed over the recall gained at each distinct score, from high to low; ``rows`` as in ``confusion_counts``."""
    n, hits = (F.count("*"), F.sum(label)) if rows is None else (F.sum(rows), F.sum(F.col(label) * F.col(rows)))
    counts = scored.groupBy(by, score).agg(n.alias("n"), hits.alias("hits"))
    falling = counts.withColumn("_order", -F.col(score))
    bounds = ranges.numeric_bounds(scored.withColumn("_order", -F.col(score)), by, "_order")
    steps = ranges.running(
        ranges.with_range(falling, by, "_order", bounds), [by], ["_order"],
        {"n_upto": "n", "hits_upto": "hits"}, totals={"positives": "hits"})
    gain = _share(F.col("hits"), F.col("positives")) * F.col("hits_upto") / F.col("n_upto")
    return steps.groupBy(by).agg(F.sum(gain).alias("average_precision"))
