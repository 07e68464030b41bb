"""Ordered running totals, ranks and exact quantiles without a global sort in one task.

Values are cut into ranges by bounds that are approximate quantiles, so each range holds a
similar share of the rows. Totals per range are summed first (few rows), and the running value
inside a range is offset by the total of the ranges before it. Callers reduce their input to
distinct values beforehand, so a hot value is one row here.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordaudit.functions.scalars import HASH_BITS, hash_bits, hash_uniform
from recordaudit.session import range_count

RANGE = "_range"
SLOT_BITS = 12
FEW_ROWS = 10_000
#: Values sampled per range to place the bounds.
PER_RANGE = 64


def numeric_bounds(df: DataFrame, part: str, value: str) -> dict[str, list]:
    """Range bounds of ``value`` for every ``part`` (a series name; a handful of them)."""
    return _sampled_bounds(df.where(F.col(value).isNotNull()).select(part, value), part, value)


def _sampled_bounds(known: DataFrame, part: str, value: str) -> dict[str, list]:
    """Bounds from about PER_RANGE values per range and part, drawn on the map side.

    A part's values are kept with a chance that follows its count, so what reaches the driver is bounded by parts
    and ranges, however long the column is. Bounds only balance the ranges; results don't depend on them.
    """
    n = range_count(known.sparkSession)
    counts = {row[part]: row["count"] for row in known.groupBy(part).count().collect()}
    if not counts:
        return {}
    chance = F.lit(1.0)
    for name, count in counts.items():
        if count > PER_RANGE * n:
            chance = F.when(F.col(part).eqNullSafe(F.lit(name)), F.lit(PER_RANGE * n / count)).otherwise(chance)
    by_part: dict[str, list] = {}
    for row in known.where(F.rand(17) < chance).collect():
        by_part.setdefault(row[part], []).append(row[value])
    bounds = {}
    for name, values in by_part.items():
        values.sort()
        bounds[name] = sorted({values[i * len(values) // n] for i in range(1, n)})
    return bounds


def text_bounds(distinct: DataFrame, part: str, value: str) -> dict[str, list]:
    """Range bounds for distinct strings of every ``part``, from a sample as for numbers."""
    return _sampled_bounds(distinct.where(F.col(value).isNotNull()).select(part, value), part, value)


def with_range(df: DataFrame, part: str, value: str, bounds: dict[str, list]) -> DataFrame:
    """Add the number of the range each value falls in; ranges are ordered like the values."""

    @F.pandas_udf("int")
    def find(parts: pd.Series, values: pd.Series) -> pd.Series:
        found = np.zeros(len(values), dtype="int32")
        for name, positions in parts.reset_index(drop=True).groupby(parts.to_numpy()).groups.items():
            edges = bounds.get(name, [])
            found[positions] = np.searchsorted(edges, values.to_numpy()[positions], side="right")
        return pd.Series(found)

    # Never null, so that a later join on the range adds no null filter; such a filter would be
    # pushed below the caller's aggregation and run the lookup on every raw row.
    return df.withColumn(RANGE, F.coalesce(find(F.col(part), F.col(value)), F.lit(0)))


def running(df: DataFrame, by: list[str], order: list, measures: dict[str, str],
            how: str = "sum", before: bool = False, totals: dict[str, str] | None = None) -> DataFrame:
    """Running ``sum`` or ``max`` of the measures over ``order`` within ``by``.

    ``df`` carries the range column. ``measures`` maps the new column to its source. With
    ``before`` the current row (rows in strict order) is left out, otherwise peers are included.
    ``totals`` maps further columns to sources that are summed over the whole of ``by``; they come
    from the sums per range, so no join on a possibly hot ``by`` value is needed.
    """
    totals = totals or {}
    combine = {"sum": F.sum, "max": F.max}[how]
    per_range = df.groupBy(*by, RANGE).agg(
        *[combine(source).alias(f"_{name}_base") for name, source in measures.items()],
        *[F.sum(source).alias(name) for name, source in totals.items()])
    earlier = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    bases = per_range.select(
        *by, RANGE,
        *[combine(f"_{name}_base").over(earlier).alias(f"_{name}_base") for name in measures],
        *[F.sum(name).over(W.partitionBy(*by)).alias(name) for name in totals])
    inside = W.partitionBy(*by, RANGE).orderBy(*order)
    inside = (inside.rowsBetween(W.unboundedPreceding, -1) if before
              else inside.rangeBetween(W.unboundedPreceding, W.currentRow))
    joined = df.withColumns(
        {f"_{name}_here": combine(source).over(inside) for name, source in measures.items()}
    ).join(bases, [*by, RANGE])
    for name in measures:
        here, base = F.col(f"_{name}_here"), F.col(f"_{name}_base")
        if how == "sum":
            total = F.coalesce(here, F.lit(0)) + F.coalesce(base, F.lit(0))
        else:
            total = F.greatest(here, base)
        joined = joined.withColumn(name, total).drop(f"_{name}_here", f"_{name}_base")
    return joined


def exact_quantiles(df: DataFrame, part: str, value: str, shares: list[float]) -> DataFrame:
    """Linearly interpolated quantiles of a numeric column for each ``part``.

    Returns (part, share, value, n). Spark's own exact ``percentile`` keeps every distinct value
    of a group in one buffer; here the distinct values stay distributed.
    """
    present = df.where(F.col(value).isNotNull())
    counts = present.groupBy(part, value).agg(F.count("*").alias("_n"))
    ranged = with_range(counts, part, value, numeric_bounds(present, part, value))
    reach = running(ranged, [part], [value], {"_upto": "_n"}, totals={"n": "_n"})
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    place = F.col("share") * (F.col("n") - 1)
    low, high = F.floor(place), F.ceil(place)
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    # A distinct value covers the positions first..last; most values cover no wanted position.
    covers = F.filter(wanted, lambda s: (F.ceil(s * (F.col("n") - 1)) >= first)
                      & (F.floor(s * (F.col("n") - 1)) <= last))
    hits = (
        reach.withColumn("_hits", covers)
        .where(F.size("_hits") > 0)
        .withColumn("share", F.explode("_hits"))
        .withColumn("_low", F.when(low.between(first, last), F.col(value)))
        .withColumn("_high", F.when(high.between(first, last), F.col(value)))
    )
    ends = hits.groupBy(part, "share", "n").agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    weight = place - F.floor(place)
    return ends.select(part, "share",
                       (F.col("_low") + (F.col("_high") - F.col("_low")) * weight).alias(value), "n")


def hash_rank(df: DataFrame, by: list[str], key: str, seed) -> DataFrame:
    """Add ``hash_rank`` (0, 1, 2 … within ``by`` in the order of a hash-uniform number) and
    ``group_size``.

    The uniform number itself gives evenly filled ranges, however large one class is.
    """
    n = range_count(df.sparkSession)
    ranged = (
        df.withColumn("_u", hash_uniform(seed, key))
        .withColumn(RANGE, F.coalesce(F.floor(F.col("_u") * n).cast("int"), F.lit(0)))
        .withColumn("_one", F.lit(1).cast("bigint"))
    )
    ranked = running(ranged, by, ["_u", key], {"hash_rank": "_one"}, before=True,
                     totals={"group_size": "_one"})
    return ranked.drop("_u", "_one", RANGE)


def before_share(df: DataFrame, label: str, key: str, seed, share: float) -> Column:
    """True for the first ``share`` of each class in hash order (as ``hash_rank`` counts them).

    Only the hash of the row at the cut is needed, so no row is shuffled: rows are counted by the
    leading hash bits, and the slot with the cut is counted again by finer bits until a few rows
    are left in it. Each pass reads the label and the key. For a label with a few classes.
    """
    bits = hash_bits(seed, key)
    cuts: dict = {}  # class → [rows before the cut within the slot, shift, slot]
    counted = df.groupBy(label, F.shiftright(bits, HASH_BITS - SLOT_BITS).alias("slot")).count().collect()
    for value in {r[label] for r in counted}:
        n = sum(r["count"] for r in counted if r[label] == value)
        cuts[value] = [int(np.floor(n * share)), HASH_BITS, 0]

    def narrow(rows, shift):
        large = []
        for value in {r[label] for r in rows}:
            for r in sorted((r for r in rows if r[label] == value), key=lambda r: r["slot"]):
                if cuts[value][0] < r["count"]:
                    cuts[value][1:] = [shift, r["slot"]]
                    if r["count"] > FEW_ROWS and shift > 0:
                        large.append(value)
                    break
                cuts[value][0] -= r["count"]
            else:
                cuts[value][1:] = [None, None]  # the whole class is before the cut
        return large

    def in_slots(values):
        return reduce(lambda a, b: a | b, [
            (F.col(label) == v) & (F.shiftright(bits, cuts[v][1]) == cuts[v][2]) for v in values], F.lit(False))

    shift = HASH_BITS - SLOT_BITS
    large = narrow(counted, shift)
    while large:
        finer = max(0, shift - SLOT_BITS)
        large = narrow(df.where(in_slots(large)).groupBy(
            label, F.shiftright(bits, finer).alias("slot")).count().collect(), finer)
        shift = finer
    open_cuts = [v for v, cut in cuts.items() if cut[1] is not None]
    rest = df.where(in_slots(open_cuts)).select(label, bits.alias("bits"), F.col(key).alias("key")).collect()
    first = F.lit(False)
    for value, (position, shift, _) in cuts.items():
        if shift is None:
            first = first | (F.col(label) == value)
            continue
        edge = sorted((r.bits, r.key) for r in rest if r[label] == value)[position]
        first = first | ((F.col(label) == value) & (
            (bits < edge[0]) | ((bits == edge[0]) & (F.col(key) < edge[1]))))
    return first
