"""Seeded splits and folds, class weights and augmentation of the training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordaudit.operators.encode import fitted
from recordaudit.operators.ranges import before_share, hash_rank


def stratified_split(df: DataFrame, label: str, key: str, seed, train_share: float = 0.7) -> DataFrame:
    """Add ``is_train``: the first 70 % of each class in hash order."""
    return df.withColumn("is_train", before_share(df, label, key, seed, train_share))


def stratified_kfold(df: DataFrame, by: list[str], key: str, seed, folds: int = 5) -> DataFrame:
    """Add ``fold`` 0 … folds-1, class sizes equal within one row."""
    ranked = hash_rank(df, by, key, seed)
    return ranked.withColumn("fold", (F.col("hash_rank") % folds).cast("int")).drop("hash_rank", "group_size")


def first_of_size(candidates: DataFrame, model: str, key: str, seed, size: int) -> DataFrame:
    """The first ``size`` candidates of each model in hash order; a larger size contains a smaller one."""
    ranked = hash_rank(candidates, [model], key, seed)
    return ranked.where(F.col("hash_rank") < size).drop("hash_rank", "group_size")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes · rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = fitted(counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes")))
    return counts.select(label, "n", (total["rows"] / (total["classes"] * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Attach the balanced weight of a 0/1 label without a join on the label."""
    fit = fitted(df.agg(F.count("*").alias("rows"), F.count_if(F.col(label) == 1).alias("ones")))
    own = F.when(F.col(label) == 1, fit["ones"]).otherwise(fit["rows"] - fit["ones"])
    return df.withColumn(weight, fit["rows"] / (2.0 * own))


def augment_train(train: DataFrame, candidates: DataFrame) -> DataFrame:
    """Real training rows plus candidate rows; the test rows stay real only."""
    return train.unionByName(candidates.select(*train.columns))
