"""Oversampling of the rare class by interpolation between close rare rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from recordaudit.functions.scalars import hash_uniform
from recordaudit.operators.neighbours import nearest
from recordaudit.operators.ranges import hash_rank
from recordaudit.session import written


def smote(train: DataFrame, label: str, key: str, features, seed, k: int = 5) -> DataFrame:
    """New rare rows (key, features, label) that lift the rare class to the size of the other.

    Each new row lies between a rare row and one of its k nearest rare rows. Every rare row gets
    the same number of copies; the remainder goes to the first rows in hash order.
    """
    features = list(features)
    sizes = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    if len(sizes) != 2:
        raise ValueError(f"two classes are needed, found {sorted(sizes)}")
    rare_label = min(sizes, key=sizes.get)
    n_rare, missing = sizes[rare_label], max(sizes.values()) - min(sizes.values())
    if n_rare < 2:
        raise ValueError("the rare class needs at least two rows")
    k = min(k, n_rare - 1)
    rare = written(train.where(F.col(label) == rare_label).select(
        F.col(key).cast("string").alias(key), *[F.col(c).cast("double").alias(c) for c in features]))
    close = nearest(rare, rare, key, features, k, exclude_self=True)
    spots = rare.select(F.col(key).alias("neighbour"), F.array(*features).alias("spot"))
    around = close.join(spots, "neighbour").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "spot"))).alias("around"))
    each, extra = divmod(missing, n_rare)
    copies = F.lit(each) + F.when(F.col("hash_rank") < extra, 1).otherwise(0)
    # The copies are made last, so only rare rows are shuffled.
    base = hash_rank(rare, [], key, seed).join(around, key).withColumn("copies", copies)
    new = base.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    pick = F.floor(hash_uniform(seed, key, F.lit("neighbour"), "copy") * k).cast("int")
    new = new.withColumn("target", F.get("around", pick)["spot"]).withColumn(
        "step", hash_uniform(seed, key, F.lit("step"), "copy"))
    return new.select(
        F.concat_ws("#", key, "copy").alias(key),
        *[(F.col(c) + F.col("step") * (F.get("target", F.lit(i)) - F.col(c))).alias(c)
          for i, c in enumerate(features)],
        F.lit(rare_label).alias(label))
