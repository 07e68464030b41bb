"""Distances between real and candidate distributions, column by column and pair by pair.

All candidate sets are scored in one job. Rows are first reduced to counts per distinct value or
pair of values on the map side; the real counts are shared by all models.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from recordaudit.functions.scalars import as_number
from recordaudit.operators import ranges
from recordaudit.operators.encode import fitted
from recordaudit.session import written
from recordaudit.sources.schema import Spec

REAL = "real"
UNKNOWN = "(unknown)"
BINS = 10
#: Cells of a pair table that is counted in an array.
DENSE_CELLS = 1 << 16
MAX_MODELS = 10_000
#: Up to this many models, cells have a count column per model.
MODELS_SIDE_BY_SIDE = 64


def stacked(real: DataFrame, candidates: DataFrame, spec: Spec, columns) -> DataFrame:
    """Both tables with a model column; real rows carry the name ``real``."""
    own = real.select(F.lit(REAL).alias(spec.model), *columns)
    return own.unionByName(candidates.select(spec.model, *columns))


def _numbers(real: DataFrame, candidates: DataFrame, spec: Spec, columns) -> DataFrame:
    types = dict(real.dtypes)
    both = stacked(real, candidates, spec, columns)
    return both.select(spec.model, *[as_number(c, types[c]).alias(c) for c in columns])


def model_sizes(both: DataFrame, model: str) -> dict[str, int]:
    """Rows per model: as many entries as there are candidate sets."""
    rows = both.groupBy(model).count().limit(MAX_MODELS + 1).collect()
    if len(rows) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} candidate sets: is {model} really the model column?")
    return {r[model]: r["count"] for r in rows}


def lookup(key, values: dict) -> Column:
    """Value of a small driver-side mapping as an expression."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


# ---------------------------------------------------------------- single columns

def ks_complement(real: DataFrame, candidates: DataFrame, spec: Spec, columns=None) -> DataFrame:
    """1 - largest gap between the cumulative shares, per model and numeric or datetime column.

    The gap can only peak at a candidate value or just before one, so the real cumulative count
    is needed at candidate values only and is computed once for all models. The counts are written once: bounds,
    totals per range and running totals all start from them.
    """
    columns = list(columns or spec.numeric + spec.datetime)
    model = spec.model
    long = _numbers(real, candidates, spec, columns).unpivot(
        [model], columns, "column_name", "value").where(F.col("value").isNotNull())
    counts = written(long.groupBy(model, "column_name", "value").agg(F.count("*").alias("n")))
    steps = ranges.with_range(counts, "column_name", "value", ranges.numeric_bounds(counts, "column_name", "value"))
    is_real = F.col(model) == REAL
    steps = steps.withColumns({"n_real": F.when(is_real, F.col("n")).otherwise(0),
                               "n_cand": F.when(is_real, 0).otherwise(F.col("n"))})
    steps = ranges.running(steps, ["column_name"], ["value"], {"real_upto": "n_real"},
                           totals={"real_total": "n_real"})
    here = W.partitionBy("column_name", ranges.RANGE, "value")
    steps = steps.withColumn("real_here", F.sum("n_real").over(here)).where(~is_real)
    steps = ranges.running(steps, [model, "column_name"], ["value"], {"cand_upto": "n_cand"},
                           totals={"cand_total": "n_cand"})
    at = F.abs(F.col("real_upto") / F.col("real_total") - F.col("cand_upto") / F.col("cand_total"))
    before = F.abs((F.col("real_upto") - F.col("real_here")) / F.col("real_total")
                   - (F.col("cand_upto") - F.col("n_cand")) / F.col("cand_total"))
    return steps.groupBy(model, "column_name").agg((1 - F.max(F.greatest(at, before))).alias("score"))


def _tv_complement(cells: DataFrame, part: str, cell: list[str], model: str, sizes: dict) -> DataFrame:
    """1 - half the summed share differences, from counts per (model, part, cell).

    Cells a model never has contribute their real share; those sum to 1 minus the real share of
    the cells it has, so real cells need not be repeated per model.
    """
    is_real = F.col(model) == REAL
    same_cell = W.partitionBy(part, *cell)
    both = cells.withColumn("n_real", F.sum(F.when(is_real, F.col("n")).otherwise(0)).over(same_cell))
    p_real = F.col("n_real") / F.lit(sizes[REAL])
    p_cand = F.col("n") / lookup(F.col(model), sizes)
    return both.where(~is_real).groupBy(model, part).agg(
        (1 - 0.5 * (1 + F.sum(F.abs(p_real - p_cand) - p_real))).alias("score"))


def _category_cells(real: DataFrame, candidates: DataFrame, spec: Spec, columns) -> tuple[DataFrame, dict]:
    both = stacked(real, candidates, spec, columns)
    text = both.select(spec.model, *[F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)).alias(c) for c in columns])
    long = text.unpivot([spec.model], columns, "column_name", "value")
    return (long.groupBy(spec.model, "column_name", "value").agg(F.count("*").alias("n")),
            model_sizes(both, spec.model))


def tv_complement(real: DataFrame, candidates: DataFrame, spec: Spec, columns=None) -> DataFrame:
    """1 - total variation distance, per model and categorical column; unknown is a category."""
    columns = list(columns or spec.categorical)
    cells, sizes = _category_cells(real, candidates, spec, columns)
    return _tv_complement(cells, "column_name", ["value"], spec.model, sizes)


def column_shapes(real: DataFrame, candidates: DataFrame, spec: Spec) -> DataFrame:
    """Score of every column: (model, column_name, metric, score)."""
    parts = [score(real, candidates, spec).withColumn("metric", F.lit(name)) for score, name, columns in (
        (ks_complement, "KSComplement", spec.numeric + spec.datetime), (tv_complement, "TVComplement", spec.categorical)) if columns]
    return reduce(DataFrame.unionByName, parts).select(spec.model, "column_name", "metric", "score")


# ---------------------------------------------------------------- pairs of columns

def correlation_similarity(real: DataFrame, candidates: DataFrame, spec: Spec) -> DataFrame:
    """1 - |r_real - r_candidate| / 2 for pairs of numeric or datetime columns.

    A few running moments per model and pair, kept in the tasks; rows with a null in a pair are skipped for that pair.
    One aggregate with the moments of all pairs in a row is too wide for Spark to compile.
    """
    columns = list(spec.numeric + spec.datetime)
    pairs = list(combinations(columns, 2))
    both = _numbers(real, candidates, spec, columns)
    each = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b) in enumerate(pairs)])
    moments = both.select(spec.model, F.inline(each)).groupBy(spec.model, "pair").agg(F.corr("a", "b").alias("r"))
    first, second = (F.array(*[F.lit(p[side]) for p in pairs]) for side in (0, 1))
    long = moments.select(spec.model, F.get(first, F.col("pair")).alias("column_a"), F.get(second, F.col("pair")).alias("column_b"), "r")
    is_real = F.col(spec.model) == REAL
    same_pair = W.partitionBy("column_a", "column_b")
    return (
        long.withColumn("r_real", F.max(F.when(is_real, F.col("r"))).over(same_pair)).where(~is_real)
        .withColumn("score", 1 - F.abs(F.col("r_real") - F.col("r")) / 2)
        .select(spec.model, "column_a", "column_b", "r", "r_real", "score")
    )


def _bin(column: str, low: float, high: float) -> Column:
    """Number of the equal-width bin between the real minimum and maximum: 0 below, 11 from the
    maximum on."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    x = F.col(column)
    inner = F.floor((x - low) / (high - low) * BINS) + 1
    return F.when(x < low, 0).when(x >= high, BINS + 1).otherwise(inner).cast("string")


def _pair_cells(pairs: list[tuple[int, int]], models: int):
    """Counts of every pair's cells in batches of (m, code …): (pair, cell, m, n), a cell named by a hash of both codes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m, *columns = (np.asarray(c) for c in batch.columns)
            coded = [np.unique(c, return_inverse=True) for c in columns]
            found: list[tuple[np.ndarray, ...]] = []
            for number, (i, j) in enumerate(pairs):
                (first, a), (second, b) = coded[i], coded[j]
                place = (a * len(second) + b) * models + m
                cells = len(first) * len(second) * models
                if cells <= max(DENSE_CELLS, len(place)):
                    n = np.bincount(place, minlength=cells)
                    at = np.flatnonzero(n)
                    n = n[at]
                else:
                    at, n = np.unique(place, return_counts=True)
                pair, who = np.divmod(at, models)
                left, right = np.divmod(pair, len(second))
                name = (first[left].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ second[right].view(np.uint64)
                name ^= name >> np.uint64(29)  # different pairs of codes have different names, but for chance
                name = name * np.uint64(0xBF58476D1CE4E5B9)
                found.append((np.full(len(at), number, np.int16), (name ^ (name >> np.uint64(32))).view(np.int64), who.astype(np.int32), n))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["pair", "cell", "m", "n"])

    return count


def contingency_similarity(real: DataFrame, candidates: DataFrame, spec: Spec) -> DataFrame:
    """1 - total variation distance of the joint table, for pairs with a categorical column.

    Numeric and datetime columns are cut into ten bins of the real range. Every column becomes one 64-bit code a row; a task
    counts the pair tables of its rows batch by batch (a bincount where a table is small, a sort where it is wide), so
    what is shuffled are cells with counts, not a row per record and pair. One group-by adds the cells of all models
    side by side, and the scores are sums over it.
    """
    types = dict(real.dtypes)
    continuous = list(spec.numeric + spec.datetime)
    columns = [*spec.categorical, *continuous]
    edges = real.agg(*[f(as_number(c, types[c])).alias(f"{c}_{n}") for c in continuous
                       for n, f in (("min", F.min), ("max", F.max))]).first() if continuous else {}
    both = stacked(real, candidates, spec, columns)
    numbers = both.withColumns({c: as_number(c, types[c]) for c in continuous}) if continuous else both
    codes = [F.col(c).cast("string") for c in spec.categorical]
    for c in continuous:
        low, high = edges[f"{c}_min"], edges[f"{c}_max"]
        codes.append(F.lit(None).cast("string") if low is None else _bin(c, low, high))
    sizes = model_sizes(both, spec.model)
    numbered = {m: i for i, m in enumerate(sorted(sizes, key=str))}
    place = lookup(F.coalesce(F.col(spec.model), F.lit("")), {m or "": i for m, i in numbered.items()})
    coded = numbers.select(place.cast("int").alias("m"), *[F.xxhash64(F.coalesce(c, F.lit(UNKNOWN))).alias(f"c{i}") for i, c in enumerate(codes)])
    pairs = [(i, j) for i, j in combinations(range(len(columns)), 2) if i < len(spec.categorical)]
    counted = coded.mapInArrow(_pair_cells(pairs, len(numbered)), "pair short, cell long, m int, n long")
    if len(sizes) <= MODELS_SIDE_BY_SIDE:
        cells = counted.groupBy("pair", "cell").agg(*[
            F.coalesce(F.sum(F.when(F.col("m") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in numbered.values()])
        p_real = F.col(f"n{numbered[REAL]}") / F.lit(sizes[REAL])
        gaps = [F.sum(F.when(F.col(f"n{i}") > 0, F.abs(p_real - F.col(f"n{i}") / F.lit(sizes[m])) - p_real)).alias(f"g{i}")
                for m, i in numbered.items() if m != REAL]
        each = F.array(*[F.struct(F.lit(m).alias(spec.model), (1 - 0.5 * (1 + F.col(f"g{i}"))).alias("score"))
                         for m, i in numbered.items() if m != REAL])
        scores = cells.groupBy("pair").agg(*gaps).select("pair", F.inline(each)) if len(numbered) > 1 else None
    if len(sizes) > MODELS_SIDE_BY_SIDE or len(numbered) < 2:
        names = F.array(*[F.lit(m) for m in numbered])
        cells = counted.groupBy(F.get(names, F.col("m")).alias(spec.model), "pair", "cell").agg(F.sum("n").alias("n"))
        scores = _tv_complement(cells, "pair", ["cell"], spec.model, sizes)
    first = F.array(*[F.lit(columns[i]) for i, _ in pairs])
    second = F.array(*[F.lit(columns[j]) for _, j in pairs])
    return scores.select(spec.model, F.get(first, F.col("pair").cast("int")).alias("column_a"),
                         F.get(second, F.col("pair").cast("int")).alias("column_b"), "score")


def column_pair_trends(real: DataFrame, candidates: DataFrame, spec: Spec) -> DataFrame:
    """Score of every pair: (model, column_a, column_b, metric, score)."""
    correlation = correlation_similarity(real, candidates, spec).withColumn("metric", F.lit("CorrelationSimilarity"))
    contingency = contingency_similarity(real, candidates, spec).withColumn("metric", F.lit("ContingencySimilarity"))
    names = [spec.model, "column_a", "column_b", "metric", "score"]
    return correlation.select(names).unionByName(contingency.select(names))


# ---------------------------------------------------------------- summary scores

def marginal_similarity(real: DataFrame, candidates: DataFrame, spec: Spec) -> DataFrame:
    return column_shapes(real, candidates, spec).groupBy(spec.model).agg(F.avg("score").alias("marginal"))


def bivariate_similarity(real: DataFrame, candidates: DataFrame, spec: Spec) -> DataFrame:
    return column_pair_trends(real, candidates, spec).groupBy(spec.model).agg(F.avg("score").alias("bivariate"))


def overall_similarity(real: DataFrame, candidates: DataFrame, spec: Spec, models=None) -> DataFrame:
    """Marginal, bivariate and their mean per model.

    With a list of models, a model without valid rows scores 0.
    """
    both = marginal_similarity(real, candidates, spec).join(
        bivariate_similarity(real, candidates, spec), spec.model)
    scored = both.withColumn("overall", (F.col("marginal") + F.col("bivariate")) / 2)
    return with_all_models(scored, models, spec.model) if models else scored


def with_all_models(scores: DataFrame, models, model: str) -> DataFrame:
    """One row per listed model; scores of a model without rows are 0."""
    listed = scores.sparkSession.createDataFrame([(m,) for m in models], f"{model} string")
    joined = listed.join(scores, model, "left")
    numbers = [c for c in scores.columns if c != model]
    return joined.select(model, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in numbers])


# ---------------------------------------------------------------- validity and structure

def data_validity(real: DataFrame, candidates: DataFrame, spec: Spec) -> DataFrame:
    """Share of values inside the real range (numbers, known values only) or set (categories)."""
    types = dict(real.dtypes)
    columns = list(spec.numeric + spec.datetime)
    edges = fitted(real.agg(*[f(as_number(c, types[c])).alias(f"{c}_{n}") for c in columns
                              for n, f in (("min", F.min), ("max", F.max))]))
    inside = candidates.groupBy(spec.model).agg(*[
        F.avg(as_number(c, types[c]).between(edges[f"{c}_min"], edges[f"{c}_max"]).cast("double")).alias(c)
        for c in columns])
    ranges_ok = inside.unpivot([spec.model], columns, "column_name", "score").withColumn(
        "metric", F.lit("BoundaryAdherence"))
    cells, _ = _category_cells(real, candidates, spec, list(spec.categorical))
    is_real = F.col(spec.model) == REAL
    known = F.max(is_real.cast("int")).over(W.partitionBy("column_name", "value"))
    sets_ok = (
        cells.withColumn("known", known).where(~is_real).groupBy(spec.model, "column_name")
        .agg((F.sum(F.col("n") * F.col("known")) / F.sum("n")).alias("score"))
        .withColumn("metric", F.lit("CategoryAdherence"))
    )
    names = [spec.model, "column_name", "metric", "score"]
    return ranges_ok.select(names).unionByName(sets_ok.select(names))


def data_structure(real: DataFrame, candidates: DataFrame, without=()) -> DataFrame:
    """Per column: present in both tables, same type, and known values on each side."""
    ours, theirs = dict(real.dtypes), dict(candidates.dtypes)
    names = [c for c in dict.fromkeys([*real.columns, *candidates.columns]) if c not in without]

    def known(df, types, alias):
        counts = df.agg(*[(F.count(c) if c in types else F.lit(None).cast("bigint")).alias(c) for c in names])
        return counts.unpivot([], names, "column_name", alias)

    same = lookup(F.col("column_name"), {c: c in ours and c in theirs and ours[c] == theirs[c] for c in names})
    return known(real, ours, "known_real").join(known(candidates, theirs, "known_candidate"), "column_name").select(
        "column_name", "known_real", "known_candidate", same.alias("same_type"))


def quality_before_after(real: DataFrame, before: DataFrame, after: DataFrame, generated: Spec, spec: Spec) -> DataFrame:
    """Overall similarity on the generated columns before cleaning and on all columns after."""
    first = overall_similarity(real, before, generated).withColumn("stage", F.lit("before"))
    second = overall_similarity(real, after, spec).withColumn("stage", F.lit("after"))
    return first.unionByName(second).select(spec.model, "stage", "marginal", "bivariate", "overall")
