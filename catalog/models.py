"""Metrics on scored rows, forests, configuration selection, the copula and the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import fixtures as fx
from catalog.basics import REL, scratch
from catalog.learning import LEAKAGE_FREE, uniform_sql
from catalog.quality import eigen_sql, number_sql, pools, quality_sql
from catalog.registry import query
from recordaudit.functions import normal, scalars as sc
from recordaudit.functions.scalars import hash_uniform
from recordaudit.operators import balance, copula as co, encode, forest as fo, kernel, metrics, realism, selection as sel, sets, similarity as sim, trend
from recordaudit.plans import prepare, reports, selection_round, sweep
from recordaudit.sources import tables

SQL = fx.with_views
RECURSIVE = fx.with_recursive_views
KEY = fx.KEY

# ---------------------------------------------------------------- metrics on a scored table

SCORED_SQL = f"""with scored as (
  select row_key, model, diverted as label, round(0.75::double * {uniform_sql('row_key', "'score'")}
      + 0.25::double * diverted * {uniform_sql('row_key', "'signal'")}, 2) as score
  from record where status in ('D', 'O')),
predicted as (select *, case when score >= 0.5 then 1 else 0 end as prediction from scored),
counts as (select model, count(*) filter (label = 1 and prediction = 1) as tp, count(*) filter (label = 0 and prediction = 1) as fp,
  count(*) filter (label = 1 and prediction = 0) as fn, count(*) filter (label = 0 and prediction = 0) as tn
  from predicted group by model)"""


def scored_rows(spark, folder) -> DataFrame:
    """Flown rows with a score that leans toward the rare class, two decimals, so with many ties."""
    flown = fx.historical_labels(fx.records(spark, folder))
    score = 0.75 * hash_uniform(fx.SEED, KEY, F.lit("score")) + 0.25 * F.col("label") * hash_uniform(
        fx.SEED, KEY, F.lit("signal"))
    return flown.withColumn("score", F.round(score, 2)).withColumn(
        "prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query("k3_confusion_matrix", SQL(SCORED_SQL + """
select model, label, count(*) filter (prediction = 0) as predicted_0, count(*) filter (prediction = 1) as predicted_1
from predicted group by model, label"""))
def confusion_matrix(spark, folder) -> DataFrame:
    return metrics.confusion_matrix(scored_rows(spark, folder), ["model"])


@query("k4_classification_report", SQL(SCORED_SQL + """, per as (
  select *, tp / (tp + fp) as p1, tp / (tp + fn) as r1, 2 * tp / (2 * tp + fp + fn) as f1,
    tn / (tn + fn) as p0, tn / (tn + fp) as r0, 2 * tn / (2 * tn + fp + fn) as f0, tp + fn as n1, tn + fp as n0 from counts)
select model, '0' as class, round(p0, 6) as precision, round(r0, 6) as recall, round(f0, 6) as f1, n0 as support from per
union all select model, '1', round(p1, 6), round(r1, 6), round(f1, 6), n1 from per
union all select model, 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n0 + n1 from per
union all select model, 'weighted avg', round((p0 * n0 + p1 * n1) / (n0 + n1), 6), round((r0 * n0 + r1 * n1) / (n0 + n1), 6),
  round((f0 * n0 + f1 * n1) / (n0 + n1), 6), n0 + n1 from per
union all select model, 'accuracy', round((tp + tn) / (n0 + n1), 6), round((tp + tn) / (n0 + n1), 6), round((tp + tn) / (n0 + n1), 6), n0 + n1 from per"""))
def classification_report(spark, folder) -> DataFrame:
    counts = metrics.confusion_counts(scored_rows(spark, folder), ["model"])
    return fx.rounded(metrics.classification_report(counts, ["model"]))


@query("k5_f1_balanced_accuracy", SQL(SCORED_SQL + """
select model, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) as balanced_accuracy from counts"""))
def f1_balanced_accuracy(spark, folder) -> DataFrame:
    counts = metrics.confusion_counts(scored_rows(spark, folder), ["model"])
    return fx.rounded(counts.select("model", metrics.f1().alias("f1"), metrics.balanced_accuracy().alias("balanced_accuracy")))


@query("k6_average_precision", SQL(SCORED_SQL + """, steps as (select model, score, count(*) as n, sum(label) as hits from scored group by model, score),
upto as (select *, sum(n) over w as n_upto, sum(hits) over w as hits_upto, sum(hits) over (partition by model) as positives
  from steps window w as (partition by model order by score desc))
select model, round(sum((hits / positives) * (hits_upto / n_upto)), 6) as average_precision from upto group by model"""))
def average_precision(spark, folder) -> DataFrame:
    return fx.rounded(metrics.average_precision(fx.written(scored_rows(spark, folder)), "model"))


MCC_SQL = """(cast(tp as double) * tn - cast(fp as double) * fn)
  / (sqrt(cast(tp + fp as double)) * sqrt(cast(tp + fn as double)) * sqrt(cast(tn + fp as double)) * sqrt(cast(tn + fn as double)))"""


@query("k7_mcc", SQL(SCORED_SQL + f"select model, round({MCC_SQL}, 6) as mcc from counts"))
def mcc(spark, folder) -> DataFrame:
    counts = metrics.confusion_counts(scored_rows(spark, folder), ["model"])
    return fx.rounded(counts.select("model", metrics.mcc().alias("mcc")))


@query("b24_normalise_mcc", SQL(SCORED_SQL + f"select model, round(({MCC_SQL} + 1) / 2, 6) as normalised_mcc from counts"))
def normalise_mcc(spark, folder) -> DataFrame:
    return fx.rounded(mcc_raw(spark, folder).select("model", sc.normalised_mcc("mcc").alias("normalised_mcc")))


def mcc_raw(spark, folder) -> DataFrame:
    counts = metrics.confusion_counts(scored_rows(spark, folder), ["model"])
    return counts.select("model", metrics.mcc().alias("mcc"))


@query("k11_empty_guard", SQL(SCORED_SQL + f"""
select m.model, round(coalesce(2 * tp / (2 * tp + fp + fn), 0), 6) as f1
from (select unnest({[*fx.MODELS, 'Never sampled']}) as model) m left join counts using (model)"""))
def empty_guard(spark, folder) -> DataFrame:
    counts = metrics.confusion_counts(scored_rows(spark, folder), ["model"])
    scores = counts.select("model", metrics.f1().alias("f1"))
    return fx.rounded(sim.with_all_models(scores, [*fx.MODELS, "Never sampled"], "model"))


@query("k13_class_balance_point", SQL("""
select count(*) filter (diverted = 0) - count(*) filter (diverted = 1) as class_balance_point from record where status not in ('C', 'S')"""))
def class_balance_point(spark, folder) -> DataFrame:
    return fo.class_balance_point(fx.historical(fx.records(spark, folder)), "diverted")


# ---------------------------------------------------------------- forests

GENERATED_FEATURES = [c for c in fx.GENERATED if c != "diverted"]
UTILITY_FEATURES = [c for c in LEAKAGE_FREE if c != "diverted"]
JUDGE = fo.Forest(seed=fx.SEED)
EVERY_MODEL = [*fx.MODELS, "Never sampled"]
#: Augmentation sizes of the sweep, as published, and the seven of the other evaluations.
SWEEP_SIZES = (300, 500, 1000, 2000, 5000, 10000, 15000, 20000, 25000, 30000, 35000, 40000, 45000, 50000, 60000, 70000, 80000, 90000,
               100000, 110000, 120000, 130000, 140000, 160000, 180000, 200000)
REPORT_SIZES = (300, 500, 1000, 2000, 5000, 10000, 20000)
#: The same proportions as shares of a candidate set, for scores of the given rows alone.
SIZE_SHARES = tuple(s / REPORT_SIZES[-1] for s in REPORT_SIZES)
#: 182 fits, each on all real training rows and all rows of its size.
SWEEP_JUDGE = fo.Forest(seed=fx.SEED)


def without_nulls(real, candidates, columns):
    """Both tables with the nulls of the given columns replaced by the real median."""
    medians = fx.written(encode.real_medians(real, columns))
    return (encode.fill_real_median(real, medians, columns), encode.fill_real_median(candidates, medians, columns))


def fidelity_tables(spark, folder):
    real, candidates = pools(spark, folder)
    real, candidates = encode.prepare_for_prediction(
        real.select(KEY, *GENERATED_FEATURES), candidates.select(KEY, "model", *GENERATED_FEATURES), fx.ENCODED,
        without=[KEY, "model"])
    real, candidates = without_nulls(real, candidates, ["dep_delta", "arr_delta"])
    return fx.written(real), fx.written(candidates)


def utility_tables(spark, folder):
    full = fx.records(spark, folder)
    _, candidates = pools(spark, folder)
    real, candidates = encode.prepare_for_prediction(
        fx.written(encode.drop_features(fx.historical(full), fx.LEAKAGE)), encode.drop_features(candidates, fx.LEAKAGE), fx.ENCODED, without=[KEY, "model"])
    real, candidates = fx.written(real), fx.written(candidates)
    return without_nulls(real, candidates, ["dep_delta"])


@query("k1_fidelity_cv")
def fidelity_cv(spark, folder) -> DataFrame:
    return fx.rounded(fo.fidelity_cv(*fidelity_tables(spark, folder), KEY, "model", GENERATED_FEATURES, JUDGE))


@query("k2_fidelity_score")
def fidelity_score(spark, folder) -> DataFrame:
    return fx.rounded(fo.fidelity_score(*fidelity_tables(spark, folder), KEY, "model", GENERATED_FEATURES,
                                        EVERY_MODEL, JUDGE))


@query("k8_utility_trtr")
def utility_trtr(spark, folder) -> DataFrame:
    return fx.rounded(fo.utility(*utility_tables(spark, folder), KEY, "model", "diverted", UTILITY_FEATURES, JUDGE, models=[]))


def realism_shares(spark, folder) -> DataFrame:
    """Rows of every model before and after cleaning, and the share in percent."""
    routes = fx.known_routes(spark, folder)
    return fx.written(realism.realism_pct(fx.candidates_generated(fx.rare_records(spark, folder)), routes, REL))


@query("k9_utility_tatr")
def utility_tatr(spark, folder) -> DataFrame:
    scores = fo.utility(*utility_tables(spark, folder), KEY, "model", "diverted", UTILITY_FEATURES, JUDGE)
    return fx.rounded(scores.join(realism_shares(spark, folder), "model", "left"))


@query("k10_utility_score")
def utility_score(spark, folder) -> DataFrame:
    return fx.rounded(fo.utility_score(*utility_tables(spark, folder), KEY, "model", "diverted", UTILITY_FEATURES,
                                       EVERY_MODEL, JUDGE, "mcc"))


# ---------------------------------------------------------------- result tables by size

RESULTS_SQL = """with per_size as (
  select model, 300 * (1 + cast(tail as bigint) % 26) as size_before, count(*) as size_after,
    round(avg(air_time) / 527, 6) as pr_auc, round(avg(taxi_out) / 21, 6) as normalised_mcc
  from cand group by 1, 2),
results as (
  select *, (size_before // 300) % 3 as file_no from per_size
  union all select 'TRTR', null, null, pr_auc, normalised_mcc, file_no from (
    select round(avg(air_time) / 527, 6) as pr_auc, round(avg(taxi_out) / 21, 6) as normalised_mcc from real), (values (0), (1), (2)) f(file_no))"""


def result_files(spark, folder) -> str:
    """A folder of three results, measurements per model and size; each repeats the baseline row."""
    real, candidates = pools(spark, folder)
    marks = [F.round(F.avg("air_time") / 527, 6).alias("pr_auc"), F.round(F.avg("taxi_out") / 21, 6).alias("normalised_mcc")]
    per_size = fx.written(candidates.groupBy(
        "model", (300 * (1 + F.col("tail").cast("bigint") % 26)).alias("size_before")).agg(
        F.count("*").alias("size_after"), *marks))
    base = real.agg(*marks).select(F.lit("TRTR").alias("model"), F.lit(None).cast("bigint").alias("size_before"),
                                   F.lit(None).cast("bigint").alias("size_after"), "pr_auc", "normalised_mcc")
    results = scratch(spark, "sweep")
    for number in range(3):
        own = per_size.where(F.expr("(size_before div 300) % 3") == number)
        tables.sink_table(base.unionByName(own), f"{results}/sweep-{number}", None)
    return results


def sweep_results(spark, folder) -> DataFrame:
    return tables.scan_result_dir(spark, result_files(spark, folder))


@query("c9_order_map_join", SQL(RESULTS_SQL + """, model_rank as (
  select model, row_number() over (order by model desc) - 1 as model_rank from (select distinct model from results where file_no = 0))
select r.model, size_before, cast(model_rank as integer) as model_rank from (select distinct model, size_before from results) r left join model_rank using (model)"""))
def order_map_join(spark, folder) -> DataFrame:
    results = sweep_results(spark, folder)
    return results.select("model", "size_before").distinct().join(appearance(results), "model", "left")


def appearance(results: DataFrame) -> DataFrame:
    """Model order of the first file: the explicit position there is the falling model name."""
    first = results.where("file_no = 0").select("model").distinct()
    position = F.row_number().over(fx.W.orderBy(F.desc("model")))  # one row per model
    return reports.model_order(first.withColumn("position", position), "position")


@query("g2_first_appearance_order", SQL(RESULTS_SQL + """
select model, cast(row_number() over (order by model desc) - 1 as integer) as model_rank from (select distinct model from results where file_no = 0)"""))
def first_appearance_order(spark, folder) -> DataFrame:
    return appearance(sweep_results(spark, folder))


SORTED_SQL = RESULTS_SQL + """, model_rank as (
  select model, cast(row_number() over (order by model desc) - 1 as integer) as model_rank from (select distinct model from results where file_no = 0))
select * from (select distinct model, size_before, size_after, pr_auc, normalised_mcc from results) left join model_rank using (model)
order by model_rank nulls last, size_before nulls last"""


@query("g1_sort_results", SQL(SORTED_SQL))
def sort_results(spark, folder) -> DataFrame:
    results = sweep_results(spark, folder)
    return reports.ordered_results(results.drop("file_no"), appearance(results), "size_before")


@query("k12_augmentation_sweep_table", SQL(SORTED_SQL))
def augmentation_sweep_table(spark, folder) -> DataFrame:
    """Result files stacked, equal rows once, in model and size order."""
    return sort_results(spark, folder)


def swept(spark, folder, sizes) -> DataFrame:
    """Forests trained on real rows plus each set's first rows, cleaned, for all sizes; sets that are too short are continued."""
    full = fx.records(spark, folder)
    routes, places = fx.dimensions(spark, folder)
    filled = sweep.filled_sets(fx.candidates_generated(fx.rare_records(spark, folder)), fx.GEN_SPEC, max(sizes), fx.SEED)
    enriched = fx.written(fx.en.enrich_and_clean(filled, routes, places, REL, [KEY, "model", sweep.PLACE]))
    real, candidates = encode.prepare_for_prediction(
        fx.written(encode.drop_features(fx.historical(full), fx.LEAKAGE)), encode.drop_features(enriched, fx.LEAKAGE), fx.ENCODED, without=[KEY, "model", sweep.PLACE])
    real, candidates = without_nulls(fx.written(real), fx.written(candidates), ["dep_delta"])
    scores = fo.utility(real, candidates, KEY, "model", "diverted", UTILITY_FEATURES, SWEEP_JUDGE, sizes=sizes, place=sweep.PLACE)
    return scores.withColumnsRenamed({"size": "rows_generated", "rows_added": "rows_valid"}).withColumn(
        "realism", sc.round_pct(F.col("rows_valid"), F.col("rows_generated")))


@query("k12_augmentation_sweep")
def augmentation_sweep(spark, folder) -> DataFrame:
    return fx.rounded(swept(spark, folder, SWEEP_SIZES))


BASELINE_SQL = """(select max(pr_auc) from results where model = 'TRTR') as pr_auc_trtr,
  (select max(normalised_mcc) from results where model = 'TRTR') as normalised_mcc_trtr"""


@query("b22_split_baseline_row", SQL(RESULTS_SQL + f"""
select model, size_before, size_after, pr_auc, normalised_mcc, {BASELINE_SQL} from results where model <> 'TRTR'"""))
def split_baseline_row(spark, folder) -> DataFrame:
    return reports.split_baseline(sweep_results(spark, folder).drop("file_no"), ["pr_auc", "normalised_mcc"])


@query("e10_axis_extent", SQL(RESULTS_SQL + """
select round(max(pr_auc), 6) as high, round(min(pr_auc), 6) as low, round((max(pr_auc) - min(pr_auc)) * 0.05::double, 6) as margin from results"""))
def axis_extent(spark, folder) -> DataFrame:
    results = sweep_results(spark, folder)
    base = results.where("model = 'TRTR'").select("pr_auc").first()[0]
    return fx.rounded(trend.axis_extent(results.where("model <> 'TRTR'"), "pr_auc", F.lit(base)))


def lowess_sql(tag: str = "", x: str = "size_before", y: str = "pr_auc", share: float = trend.SHARE, passes: int = trend.ROBUST_PASSES) -> str:
    """Table expressions up to fit{tag}: tricube-weighted lines around every size by a self join, then bisquare passes on the residuals."""
    t = tag
    parts = [f"""points{t} as (select model, cast({x} as double) as x, avg({y}) as y from results
  where model <> 'TRTR' and {x} is not null and {y} is not null group by 1, 2),
marks{t} as (select model, greatest(2, cast(floor({share} * count(*) + 1e-10) as bigint)) as k,
  1e-10::double * greatest(max(y) - min(y), max(abs(y))) as noise, greatest(1.0, max(x) - min(x)) as extent from points{t} group by model),
gaps{t} as (select a.model, a.x, a.y, b.x as bx, b.y as yb, abs(a.x - b.x) as gap,
  row_number() over (partition by a.model, a.x order by abs(a.x - b.x)) as rn from points{t} a join points{t} b on a.model = b.model),
reach{t} as (select model, x, gap as reach from gaps{t} join marks{t} using (model) where rn = k),
near{t} as (select model, x, y, bx, yb, case when reach > 0 then gap / reach when gap > 0 then 1.0::double else 0.0::double end as c
  from gaps{t} join reach{t} using (model, x)),
weights{t} as (select model, x, y, bx, yb, case when c < 1 then power(1 - power(c, 3), 3) else 0.0::double end as w from near{t}),
trust{t}0 as (select model, x as bx, 1.0::double as trust from points{t})"""]
    for i in range(passes + 1):
        end = "" if i == passes else f"_{i}"
        parts.append(f"""w{t}{i} as (select model, x, y, bx, yb, w * trust as w from weights{t} join trust{t}{i} using (model, bx)),
means{t}{i} as (select model, x, sum(w) as mass, sum(w * bx) / sum(w) as mx, sum(w * yb) / sum(w) as my from w{t}{i} group by model, x),
lines{t}{i} as (select model, x, any_value(y) as y, any_value(mass) as mass, any_value(mx) as mx, any_value(my) as my,
  sum(w * power(bx - mx, 2)) as spread, sum(w * (bx - mx) * yb) as joint from w{t}{i} join means{t}{i} using (model, x) group by model, x),
fit{t}{end} as (select model, x, y, case when mass > 0 then my + case when spread <= 1e-12 * power(extent, 2) then 0 else joint / spread end * (x - mx)
  else y end as fitted, noise from lines{t}{i} join marks{t} using (model))""")
        if i < passes:
            parts.append(f"""left{t}{i} as (select model, x, case when abs(y - fitted) <= noise then 0.0::double else abs(y - fitted) end as r from fit{t}{end}),
middle{t}{i} as (select model, median(r) as middle from left{t}{i} group by model),
trust{t}{i + 1} as (select model, x as bx, case when middle = 0 then case when r = 0 then 1.0::double else 0.0::double end
  when r < 6 * middle then power(1 - power(r / (6 * middle), 2), 2) else 0.0::double end as trust from left{t}{i} join middle{t}{i} using (model))""")
    return ", " + ", ".join(parts)


@query("f3_lowess_trend", SQL(RESULTS_SQL + lowess_sql() + """
select model, x as size_before, round(y, 6) as pr_auc, round(fitted, 6) as trend from fit"""))
def lowess_trend(spark, folder) -> DataFrame:
    results = sweep_results(spark, folder).where("model <> 'TRTR'")
    return fx.rounded(trend.lowess_trend(results, "model", "size_before", "pr_auc"))


# ---------------------------------------------------------------- trials

SCORE_TAGS = ("realism", "overall_sim", "fidelity", "utility")


def trial_number(tag: str):
    return hash_uniform(fx.SEED, "p_partkey", F.lit(tag))


def trials(spark, folder) -> DataFrame:
    """Parts seen as tuning trials of three studies, some unfinished, some without a score."""
    fx.pin_utc(spark)
    part = fx.table(spark, folder, "part")
    scored = part.select(
        F.expr("case p_partkey % 3 when 0 then 'TVAE' when 1 then 'CTGAN' else 'CopulaGAN' end").alias("study"),
        F.col("p_partkey").alias("trial"), (300 + 100 * F.floor(trial_number("epochs") * 58)).alias("epochs"),
        (32 * (1 + F.floor(trial_number("dim") * 8))).alias("embedding_dim"),
        (50 * (1 + F.floor(trial_number("batch") * 10))).alias("batch_size"),
        *[F.when(trial_number(f"{t} known") >= 0.05, F.round(trial_number(t), 6)).alias(t) for t in SCORE_TAGS],
        (trial_number("value known") >= 0.1).alias("finished"))
    mean = sum((F.coalesce(F.col(t), F.lit(0.0)) * 0.25 for t in SCORE_TAGS), F.lit(0.0))
    return scored.withColumn("value", F.when(F.col("finished"), F.round(mean, 9))).drop("finished")


def trial_sql(tag: str) -> str:
    return uniform_sql("cast(p_partkey as varchar)", f"'{tag}'")


TRIALS_SQL = f"""with raw as (
  select case p_partkey % 3 when 0 then 'TVAE' when 1 then 'CTGAN' else 'CopulaGAN' end as study, p_partkey as trial,
    cast(300 + 100 * floor({trial_sql('epochs')} * 58) as bigint) as epochs,
    cast(32 * (1 + floor({trial_sql('dim')} * 8)) as bigint) as embedding_dim,
    cast(50 * (1 + floor({trial_sql('batch')} * 10)) as bigint) as batch_size,
    {', '.join(f"case when {trial_sql(t + ' known')} >= 0.05 then round({trial_sql(t)}, 6) end as {t}" for t in SCORE_TAGS)},
    {trial_sql('value known')} >= 0.1 as finished from part),
trials as (select * exclude (finished), case when finished then round(0.0::double + {' + '.join(f'coalesce({t}, 0) * 0.25::double' for t in SCORE_TAGS)}, 9) end as value from raw),
done as (select * replace ({', '.join(f'coalesce({t}, 0) as {t}' for t in SCORE_TAGS)}) from trials where value is not null)"""
# Trials are made up of one table only, so the shared views are not needed.


def done_trials(spark, folder) -> DataFrame:
    return tables.scan_trials(trials(spark, folder))


@query("a6_scan_trials", TRIALS_SQL + "select * from done")
def scan_trials(spark, folder) -> DataFrame:
    return done_trials(spark, folder)


@query("b23_speed_score", TRIALS_SQL + "select study, trial, round(1.0::double / (epochs * embedding_dim / 10000.0::double), 6) as speed from done")
def speed_score(spark, folder) -> DataFrame:
    return fx.rounded(done_trials(spark, folder).select("study", "trial", sc.speed_score("epochs", "embedding_dim").alias("speed")))


SCHEMES_SQL = "schemes(scheme, w1, w2, w3, w4) as (values " + ", ".join(
    f"('{n}', {', '.join(f'{w}::double' for w in ws)})" for n, ws in sel.WEIGHT_SCHEMES.items()) + ")"
BEST_SQL = TRIALS_SQL + f""", {SCHEMES_SQL}, scored as (
  select *, realism * w1 + overall_sim * w2 + fidelity * w3 + utility * w4 as composite from done, schemes),
best as (select * from (select *, row_number() over (partition by study, scheme order by composite desc, trial) as rn from scored) where rn = 1)"""


@query("l1_composite_score", TRIALS_SQL + """
select study, trial, round(realism * 0.25::double + overall_sim * 0.25::double + fidelity * 0.25::double + utility * 0.25::double, 8) as composite from done""")
def composite_score(spark, folder) -> DataFrame:
    return fx.rounded(sel.composite_score(done_trials(spark, folder)).select("study", "trial", "composite"), 8)


@query("e11_best_per_scheme", BEST_SQL + "select study, scheme, trial from best")
def best_per_scheme(spark, folder) -> DataFrame:
    return sel.best_per_scheme(done_trials(spark, folder), "study", "trial").select("study", "scheme", "trial")


@query("l2_weight_sensitivity", BEST_SQL + """
select study, scheme, trial, round(composite, 4) as composite, round(realism, 4) as realism, round(overall_sim, 4) as overall_sim,
  round(fidelity, 4) as fidelity, round(utility, 4) as utility from best""")
def weight_sensitivity(spark, folder) -> DataFrame:
    return sel.weight_sensitivity(done_trials(spark, folder), "study", "trial")


@query("l3_pareto_front", TRIALS_SQL + """, points as (
  select study, trial, value, 1.0::double / (epochs * embedding_dim / 10000.0::double) as speed from done)
select study, trial, value, round(speed, 6) as speed from points a where not exists (
  select 1 from points b where b.study = a.study and b.value >= a.value and b.speed >= a.speed and (b.value > a.value or b.speed > a.speed))""")
def pareto_front(spark, folder) -> DataFrame:
    points = done_trials(spark, folder).select("study", "trial", "value", sc.speed_score("epochs", "embedding_dim").alias("speed"))
    return fx.rounded(sel.pareto_front(points, "study", "trial", "value", "speed"), without=["value"])


PARAMS = ("epochs", "embedding_dim", "batch_size")


@query("l5_param_slices", TRIALS_SQL + ", long as (" + " union all ".join(
    f"select study, '{p}' as param, cast({p} as double) as param_value, value from done" for p in PARAMS) + """)
select study, param, param_value, count(*) as n, round(avg(value), 6) as mean_value, max(value) as best_value from long group by study, param, param_value""")
def param_slices(spark, folder) -> DataFrame:
    return fx.rounded(sel.param_slices(done_trials(spark, folder), "study", PARAMS), without=["best_value"])


@query("l5_param_contour", TRIALS_SQL + "select study, epochs, embedding_dim, count(*) as n, max(value) as best_value from done group by all")
def param_contour(spark, folder) -> DataFrame:
    return sel.param_contour(done_trials(spark, folder), "study", "epochs", "embedding_dim")


@query("l6_study_summary", TRIALS_SQL + """
select t.study, n_trials, d.trial as best_trial, d.value as best_value, d.epochs, d.embedding_dim, d.batch_size
from (select study, count(*) as n_trials from trials group by study) t
join (select *, row_number() over (partition by study order by value desc, trial) as rn from done) d on d.study = t.study and rn = 1""")
def study_summary(spark, folder) -> DataFrame:
    return sel.study_summary(trials(spark, folder), "study", "trial", PARAMS)


@query("g3_best_trial", TRIALS_SQL + """
select study, trial, value from (select *, row_number() over (partition by study order by value desc, trial) as rn from done) where rn = 1""")
def best_trial(spark, folder) -> DataFrame:
    return sel.best_trial(trials(spark, folder), "study", "trial").select("study", "trial", "value")


@query("g4_list_trials", TRIALS_SQL + "select study, trial, value, epochs, embedding_dim, batch_size from trials order by study, trial")
def list_trials(spark, folder) -> DataFrame:
    return sel.list_trials(trials(spark, folder), "study", "trial", ["value", *PARAMS])


@query("f2_running_best", TRIALS_SQL + """
select study, trial, value, max(value) over (partition by study order by trial) as best_so_far from done""")
def running_best(spark, folder) -> DataFrame:
    return sel.running_best(trials(spark, folder), "study", "trial").select("study", "trial", "value", "best_so_far")


@query("f4_rank_first", TRIALS_SQL + """
select study, epochs, trial as first_trial, value as first_value from (
  select *, row_number() over (partition by study, epochs order by value desc, trial) as rn from done) where rn = 1""")
def rank_first(spark, folder) -> DataFrame:
    """The first row of each number of epochs when trials are sorted by falling value."""
    first = sel.rank_first(done_trials(spark, folder), ["study", "epochs"], [F.desc("value"), F.asc("trial")])
    return first.select("study", "epochs", F.col("trial").alias("first_trial"), F.col("value").alias("first_value"))


@query("l4_candidate_eval")
def candidate_eval(spark, folder) -> DataFrame:
    routes = fx.known_routes(spark, folder)
    real, cleaned = pools(spark, folder)
    return fx.rounded(selection_round.candidate_eval(
        fx.candidates_generated(fx.rare_records(spark, folder)), routes, REL, real, cleaned, fx.SPEC, fidelity_tables(spark, folder), GENERATED_FEATURES,
        utility_tables(spark, folder), UTILITY_FEATURES, EVERY_MODEL, JUDGE))


# ---------------------------------------------------------------- copula

def fitted_copula(spark, folder):
    real = fx.written(fx.real_generated(fx.rare_records(spark, folder)))
    return co.copula_fit(real, fx.GEN_SPEC, fx.SEED), real


def polynomial_sql(factors, x: str) -> str:
    """Horner's rule, the highest power first."""
    text = f"{factors[0]}::double"
    for factor in factors[1:]:
        text = f"({text} * {x} + {factor}::double)"
    return text


def normal_cdf_sql(x: str) -> str:
    """The share of a standard normal up to x, through the complementary error function's series."""
    size = f"(abs({x}) / sqrt(2.0::double))"
    t = f"(1 / (1 + {size} / 2))"
    upper = f"({t} * exp(-{size} * {size} + {polynomial_sql(normal.ERFC_SERIES[::-1], t)}) / 2)"
    return f"case when {x} >= 0 then 1 - {upper} else {upper} end"


def normal_quantile_sql(p: str) -> str:
    """The inverse of the normal distribution, by the rational approximation in the centre and in the tails."""
    p = f"least(greatest({p}, 1e-12::double), 1 - 1e-12::double)"
    low = f"least({p}, 1 - {p})"
    reach = f"sqrt(-2 * ln({low}))"
    square = f"(({p} - 0.5) * ({p} - 0.5))"
    tail = f"{polynomial_sql(normal.TAIL_TOP, reach)} / {polynomial_sql(normal.TAIL_BOTTOM, reach)}"
    centre = f"({p} - 0.5) * {polynomial_sql(normal.CENTRE_TOP, square)} / {polynomial_sql(normal.CENTRE_BOTTOM, square)}"
    return f"case when {low} < {normal.TAIL_START}::double then case when {p} < 0.5 then {tail} else -({tail}) end else {centre} end"


def marginals_sql() -> str:
    """Kernel distribution functions on their lattices, category intervals and shares of unknown values of the generated real rows."""
    numbers = fx.GEN_SPEC.numeric + fx.GEN_SPEC.datetime
    longs = " union all ".join(f"select row_key, '{c}' as c, {number_sql(c)} as v from own" for c in numbers)
    cats = " union all ".join(f"select row_key, '{c}' as c, cast({c} as varchar) as v, {uniform_sql('row_key', f"'{c}'")} as u from own"
                              for c in fx.GEN_SPEC.categorical)
    near = kernel.REACH * kernel.STEPS
    return f""", own as (select * from pool where model = 'real'),
longs as materialized (select * from ({longs}) where v is not null), cats as materialized ({cats}),
shape as materialized (select c, min(v) as low, max(v) as high, stddev_samp(v) * pow(count(*), -0.2::double) as h, count(*) as total from longs group by c),
bins as materialized (select c, floor((v - low) / (h / {kernel.STEPS})) as bin, count(*) as n, sum(v) / count(*) as m
  from longs join shape using (c) group by 1, 2),
lattice as (select distinct c, bin + unnest(range(-{near}, {near} + 2)) as t from bins),
points as (select c, t, low, high, h, total, low + t * (h / {kernel.STEPS}) as x from lattice join shape using (c)),
upto as materialized (select c, t, any_value(x) as x, any_value((x - low) / (high - low)) as place,
    sum(n * ({normal_cdf_sql('((x - m) / h)')})) / any_value(total) as f
  from points join bins using (c) group by c, t),
counted as (select c, v, count(*) as n from cats where v is not null group by c, v),
reach as materialized (select c, v, (upto - n) / total as low, upto / total as high from (
  select c, v, n, sum(n) over (partition by c order by v) as upto, sum(n) over (partition by c) as total from counted))"""


UNKNOWN_SQL = " union all ".join(f"select 'unknown', '{c}', '', round(avg(case when {c} is null then 1.0 else 0.0 end), 4), null from own"
                                 for c in fx.GEN_SPEC.categorical + fx.GEN_SPEC.numeric + fx.GEN_SPEC.datetime)
SCORES_SQL = f""", ends as (select c, x, f, lead(x) over w as x1, lead(f) over w as f1 from upto window w as (partition by c order by x)),
scores as materialized (
  select row_key, l.c, {normal_quantile_sql('p')} as z
  from (select row_key, l.c, f + (v - x) / (x1 - x) * (f1 - f) as p from longs l asof join ends e on l.c = e.c and l.v >= e.x) l
  union all select row_key, c, {normal_quantile_sql('p')} from (
    select row_key, c, low + (high - low) * u as p from cats join reach using (c, v))),
names as (select unnest({list(fx.GEN_SPEC.scored())}) as c),
joint as (select a.c as a, b.c as b, corr(a.z, b.z) as r from scores a join scores b using (row_key) where a.c <> b.c group by 1, 2)"""


@query("m1_copula_fit", SQL(RESULTS_SQL + marginals_sql() + SCORES_SQL + """
select 'bandwidth' as part, c as a, '' as b, round(h / (high - low), 6) as value from shape
union all select 'correlation', x.c, y.c, case when x.c = y.c then 1.0 else round(coalesce(case when isnan(r) then 0 else r end, 0), 4) + 0.0 end
from names x cross join names y left join joint on a = x.c and b = y.c"""))
def copula_fit(spark, folder) -> DataFrame:
    """Bandwidths as shares of each column's range, and the correlations of the normal scores."""
    copula, _ = fitted_copula(spark, folder)
    widths = spark.createDataFrame([("bandwidth", c, "", m.bandwidth / (m.high - m.low)) for c, m in copula.marginals.items()],
                                   "part string, a string, b string, value double")
    joint = copula.correlation_table(spark).select(F.lit("correlation"), "column_a", "column_b", F.round("r", 4))
    return fx.rounded(widths.union(joint))


@query("m1_copula_marginals", SQL(RESULTS_SQL + marginals_sql() + f"""
select 'cdf' as part, c as column_name, cast(cast(t as bigint) as varchar) as key, round(place, 6) + 0.0 as low, round(f, 6) + 0.0 as high from upto
union all select 'interval', c, v, round(low, 4), round(high, 4) from reach
union all {UNKNOWN_SQL}"""))
def copula_marginals(spark, folder) -> DataFrame:
    """The fitted marginals: distribution functions of numbers (place in the known range, share up to it), intervals of
    categories, and the share of unknown values."""
    copula, _ = fitted_copula(spark, folder)
    rows = [("cdf", c, str(int(t)), float((x - m.low) / (m.high - m.low)), float(f))
            for c, m in copula.marginals.items() for t, x, f in zip(m.place, m.points, m.upto)]
    schema = "part string, column_name string, key string, low double, high double"
    intervals = copula.categories.select(F.lit("interval"), "column_name", "value", F.round("low", 4), F.round("high", 4))
    unknown = spark.createDataFrame([("unknown", c, "", round(float(v), 4), None) for c, v in copula.null_share.items()], schema)
    return fx.rounded(spark.createDataFrame(rows, schema).union(intervals).union(unknown))


def nearest_sql(matrix: str, n: int) -> str:
    """Table expressions up to fixed(i, j, r): the symmetric ``matrix`` with its eigenvalues held above zero, as a correlation matrix again."""
    return eigen_sql(matrix, n) + """,
lifted as (select x.i, y.i as j, sum(x.part * y.part * greatest(value, 1e-8::double)) as r
  from loadings x join loadings y using (k) join eigenvalues using (k) group by x.i, y.i),
fixed as materialized (select a.i, a.j, a.r / sqrt(b.r * c.r) as r from lifted a join lifted b on b.i = a.i and b.j = a.i join lifted c on c.i = a.j and c.j = a.j)"""


def cholesky_sql(matrix: str, n: int) -> str:
    """Table expressions up to root(i, j, v): the lower triangular root of ``matrix`` (i, j, r), column by column."""
    parts = [f"root_0 as materialized (select i, 0 as j, r as v from {matrix} where j = 0)"]
    for j in range(1, n):
        parts.append(f"""root_{j} as materialized (
  with dots as (select a.i, sum(a.v * b.v) as s from root_{j - 1} a join root_{j - 1} b on a.j = b.j and b.i = {j} where a.i >= {j} group by a.i)
  select * from root_{j - 1} union all
  select m.i, {j}, (m.r - s) / (select sqrt(1 - s) from dots where i = {j}) from {matrix} m join dots using (i) where m.j = {j})""")
    return ", ".join(parts) + f", root as (select * from root_{n - 1})"


DRAWN = fx.GEN_SPEC.categorical + fx.GEN_SPEC.numeric + fx.GEN_SPEC.datetime


def drawn_sql(size: str) -> str:
    """Table expressions up to draws(draw, columns …): rows of correlated normal scores, taken back through the marginals."""
    numbers = fx.GEN_SPEC.numeric + fx.GEN_SPEC.datetime
    ranks = "order_of(c, i) as (values " + ", ".join(f"('{c}', {i})" for i, c in enumerate(DRAWN)) + ")"
    kept = []
    for c in DRAWN:
        value = f"any_value({'text' if c in fx.GEN_SPEC.categorical else 'number'}) filter (c = '{c}')"
        if c in fx.GEN_SPEC.datetime:
            value = f"make_timestamp(cast(round({value}) as bigint) * 1000000)"
        elif c == "diverted":
            value = f"cast({value} as integer)"
        gone = uniform_sql("cast(draw as varchar)", f"'{c} unknown'")
        kept.append(f"case when {gone} >= (select avg(case when {c} is null then 1.0::double else 0.0::double end) from own) then {value} end as {c}")
    return f""", {ranks},
mat as materialized (select x.i, y.i as j, case when x.i = y.i then 1.0::double else coalesce(case when isnan(r) then 0 else r end, 0) end as r
  from order_of x cross join order_of y left join joint on a = x.c and b = y.c),
{nearest_sql('mat', len(DRAWN))},
{cholesky_sql('fixed', len(DRAWN))},
noise as materialized (select draw, i, {normal_quantile_sql('u')} as z from (
  select draw, i, {uniform_sql('cast(draw as varchar)', 'c')} as u from (select unnest(range({size})) as draw), order_of)),
shares as materialized (select draw, c, {normal_cdf_sql('y')} as u from (
  select draw, r.i, sum(v * z) as y from root r join noise n on n.i = r.j group by 1, 2) join order_of using (i)),
steps as (select c, x, f, lead(x) over w as x1, lead(f) over w as f1 from (select c, f, max(x) as x from upto group by c, f) window w as (partition by c order by f)),
numbers as (select draw, s.c, case when x is null then (select min(x) from upto o where o.c = s.c) when x1 is null then x
    else x + (u - f) / (f1 - f) * (x1 - x) end as number from (select * from shares where c in {numbers}) s asof left join steps t on s.c = t.c and s.u >= t.f),
texts as (select draw, s.c, v as text from (select * from shares where c in {fx.GEN_SPEC.categorical}) s asof join reach r on s.c = r.c and s.u >= r.low),
draws as materialized (select draw, {', '.join(kept)} from (
  select draw, c, number, null as text from numbers union all select draw, c, null, text from texts) group by draw)"""


REAL_ROWS = "(select count(*) from own)"
#: Datetimes are compared in hours and numbers to two digits: the two engines' sums differ in the last bits, which a nearly singular root enlarges.
DRAWN_COLUMNS = ", ".join(f"cast(round(epoch({c}) / 3600) as bigint) as {c}" if c in fx.GEN_SPEC.datetime else f"round({c}, 2) + 0.0 as {c}" if c in fx.GEN_SPEC.numeric else c
                          for c in DRAWN)


def compared(drawn: DataFrame) -> DataFrame:
    hours = {c: F.round(F.unix_seconds(F.col(c).cast("timestamp")) / 3600).cast("bigint") for c in fx.GEN_SPEC.datetime}
    return fx.rounded(drawn.drop("draw").withColumns(hours), 2)


@query("m2_copula_sample", RECURSIVE(RESULTS_SQL + marginals_sql() + SCORES_SQL + drawn_sql(REAL_ROWS) + f"""
select 'draw-' || draw as row_key, {DRAWN_COLUMNS} from draws"""))
def copula_sample(spark, folder) -> DataFrame:
    """As many new rows as there are real ones."""
    copula, real = fitted_copula(spark, folder)
    return compared(co.copula_sample(spark, copula, real.count(), fx.SEED))


@query("m3_multi_size_sample", RECURSIVE(RESULTS_SQL + marginals_sql() + SCORES_SQL + drawn_sql(REAL_ROWS) + f""", wanted as (
  select unnest([n // 4, n // 2, n]) as size from (select {REAL_ROWS} as n))
select 'draw-' || draw as row_key, {DRAWN_COLUMNS}, cast(size as integer) as size from draws join wanted on draw < size"""))
def multi_size_sample(spark, folder) -> DataFrame:
    copula, real = fitted_copula(spark, folder)
    n = real.count()
    return compared(co.multi_size_sample(spark, copula, [n // 4, n // 2, n], fx.SEED))


@query("m4_sample_enrich_clean")
def sample_enrich_clean(spark, folder) -> DataFrame:
    copula, generated = fitted_copula(spark, folder)
    routes, places = fx.dimensions(spark, folder)
    real = fx.written(fx.en.enrich_and_clean(generated, routes, places, REL, [KEY]))
    n = generated.count()
    done = prepare.sample_enrich_clean(copula, real, routes, places, REL, fx.GEN_SPEC, fx.SPEC, [n // 2, n], fx.SEED)
    valid = done.validity.groupBy("model").agg(F.avg("score").alias("validity"))
    after = done.quality.where("stage = 'after'").select("model", F.col("overall").alias("quality_after"))
    before = done.quality.where("stage = 'before'").select("model", F.col("overall").alias("quality_before"))
    return fx.rounded(done.realism.join(valid, "model").join(before, "model").join(after, "model"))


# ---------------------------------------------------------------- report tables

DISPLAY_SQL = """case when model like 'Default %' then '$' || replace(model, 'Default ', '') || '$'
  when model like 'Optimal %' then '$' || replace(model, 'Optimal ', '') || '_{opt.}$'
  when model in ('GC', 'real') then '$' || model || '$' else model end as display, model like 'Optimal%' as is_optimised"""


SIZED_SQL = f"""placed as (
  select row_key, model, row_number() over (partition by model order by {uniform_sql('row_key')}, row_key) - 1 as place,
    count(*) over (partition by model) as among from {{cand}}),
sized as (
  select distinct row_key, model, cast(ceil(share * among) as bigint) as size
  from (select *, unnest([{', '.join(f'{s}::double' for s in SIZE_SHARES)}]) as share from placed) where place < ceil(share * among))"""


def sized(candidates: DataFrame) -> DataFrame:
    return sets.with_sizes(candidates, "model", KEY, fx.SEED, SIZE_SHARES)


@query("n1_realism_report", SQL(f"""with gen as (select * from enriched_all where model <> 'real'), {SIZED_SQL.format(cand='gen')}
select g.model, size, count(*) as rows_generated, count(distance) as rows_valid,
  round_even(count(distance) / count(*) * 100, 1) as realism, {DISPLAY_SQL.replace('model', 'g.model')}
from gen g join sized s on s.row_key = g.row_key and s.model = g.model group by g.model, size"""))
def realism_report(spark, folder) -> DataFrame:
    """Realism of every set at seven sizes."""
    routes = fx.known_routes(spark, folder)
    return reports.named(realism.realism_pct(sized(fx.candidates_generated(fx.rare_records(spark, folder))), routes, REL, ["model", "size"]))


@query("n2_similarity_report", SQL(f"""with {SIZED_SQL.format(cand='cand')},
sets as materialized (select cand.* replace (cand.model || '/' || size as model) from cand join sized using (row_key, model)),
names as (select distinct model || '/' || size as set_name, model as own_model, size from sized), """ + quality_sql(fx.SPEC, "real", "sets") + f"""
select own_model as model, size, round(marginal, 6) as marginal, round(bivariate, 6) as bivariate, round(overall, 6) as overall,
  {DISPLAY_SQL.replace('model', 'own_model')} from overall join names on set_name = model"""))
def similarity_report(spark, folder) -> DataFrame:
    """Similarity of every set at seven sizes."""
    real, candidates = pools(spark, folder)
    return fx.rounded(reports.named(sets.per_set(sim.overall_similarity, real, fx.written(sized(candidates)), fx.SPEC, ["model", "size"])))


@query("n3_fidelity_report")
def fidelity_report(spark, folder) -> DataFrame:
    """Cross-validated scores with display names, and the holdout's report by class, of every set at seven sizes."""
    real, candidates = fidelity_tables(spark, folder)
    by = ["model", "size"]
    candidates = fx.written(sized(candidates))
    scores = fo.fidelity_cv(real, candidates, KEY, by, GENERATED_FEATURES, JUDGE)
    holdout = fo.fidelity_holdout(real, candidates, KEY, by, GENERATED_FEATURES, JUDGE)
    report = metrics.classification_report(fx.written(metrics.confusion_counts(holdout, by)), by)
    report = report.withColumnsRenamed({c: f"holdout_{c}" for c in ("precision", "recall", "f1", "support")})
    return fx.rounded(reports.named(scores.join(report, by)))


@query("n4_utility_report")
def utility_report(spark, folder) -> DataFrame:
    """Every set at seven sizes next to the baseline, with rows before and after cleaning."""
    return fx.rounded(reports.utility_report(swept(spark, folder, REPORT_SIZES)))


@query("n5_class_balance_report", SQL("""
select distinct replace(display, 'real', 'Real') as display, delayed_dep_pct, on_time_dep_pct, delayed_arr_pct, on_time_arr_pct, is_optimised from (
  select case when model like 'Default %' then '$' || replace(model, 'Default ', '') || '$'
    when model like 'Optimal %' then '$' || replace(model, 'Optimal ', '') || '_{opt.}$'
    when model in ('GC', 'real') then '$' || model || '$' else model end as display, model like 'Optimal%' as is_optimised,
  round_even(count(*) filter (dep_delay_label = 1) / count(*) * 100, 1) as delayed_dep_pct,
  round_even(count(*) filter (dep_delay_label = 0) / count(*) * 100, 1) as on_time_dep_pct,
  round_even(count(*) filter (arr_delay_label = 1) / count(*) * 100, 1) as delayed_arr_pct,
  round_even(count(*) filter (arr_delay_label = 0) / count(*) * 100, 1) as on_time_arr_pct
  from clean group by model)"""))
def class_balance_report(spark, folder) -> DataFrame:
    real, candidates = pools(spark, folder)
    both = real.withColumn("model", F.lit("real")).unionByName(candidates)
    shares = balance.class_balance(both, "model", {"dep": "dep_delay_label", "arr": "arr_delay_label"})
    return reports.capital_real(reports.named(shares)).select(
        "display", "delayed_dep_pct", "on_time_dep_pct", "delayed_arr_pct", "on_time_arr_pct", "is_optimised").distinct()


PANELS = [(x, y) for x in ("size_before", "size_after") for y in ("pr_auc", "normalised_mcc")]
PANEL_SQL = " union all ".join(f"""
select model, '{x}' as axis, '{y}' as metric, x as size, round(y, 6) as value, round(fitted + 1e-7::double, 4) as trend,
  (select round(max({y}), 6) from results where model = 'TRTR') as trtr,
  (select round(min({y}) - 0.05::double * (max({y}) - min({y})), 6) from results) as axis_low,
  (select round(max({y}) + 5.5::double * 0.05::double * (max({y}) - min({y})), 6) from results) as axis_high,
  (select count(*) filter (diverted = 0) - count(*) filter (diverted = 1) from record where status not in ('C', 'S')) as class_balance_point,
  {DISPLAY_SQL} from fit_{x}_{y} where model <> 'GC'""" for x, y in PANELS)


@query("n6_augmentation_report", SQL(RESULTS_SQL + "".join(lowess_sql(f"_{x}_{y}", x, y) for x, y in PANELS) + PANEL_SQL))
def augmentation_report(spark, folder) -> DataFrame:
    """Four panels (size before and after cleaning, both metrics): all sizes of all but the excluded model with their
    trend (four digits, moved off the ties, as sums differ in their last bits from run to run), next to the baseline, with the limits of the axis and the rows that would balance the classes."""
    results = fx.written(sweep_results(spark, folder).drop("file_no").distinct())
    base = results.where("model = 'TRTR'").select("pr_auc", "normalised_mcc").first()
    balanced = class_balance_point(spark, folder).first()[0]
    others, panels = results.where("model <> 'TRTR'"), None
    for x, y in PANELS:
        limits = trend.axis_extent(others, y, F.lit(base[y])).first()
        panel = trend.lowess_trend(others, "model", x, y).where(~F.col("model").isin("GC")).select(
            "model", F.lit(x).alias("axis"), F.lit(y).alias("metric"), F.col(x).alias("size"), F.col(y).alias("value"), F.round(F.col("trend") + 1e-7, 4).alias("trend"),
            F.lit(base[y]).alias("trtr"), F.lit(limits.low - limits.margin).alias("axis_low"),
            F.lit(limits.high + 5.5 * limits.margin).alias("axis_high"))
        panels = panel if panels is None else panels.unionByName(panel)
    return fx.rounded(reports.named(panels.withColumn("class_balance_point", F.lit(balanced).cast("bigint"))))
