"""Encoding, filling, scaling, splitting, oversampling and copy detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import fixtures as fx
from catalog.registry import query
from recordaudit.operators import encode, memorization, neighbours, prep, smote as sm, split
from recordaudit.operators.enrich import add_timeline

SQL = fx.with_views
KEY = fx.KEY
DCR_COLUMNS = ("quarter", "day_of_week", "dep_delta", "dep_delay_label", "taxi_out", "taxi_in", "arr_delta",
               "arr_delay_label", "sched_elapsed", "act_elapsed", "air_time", "distance", "diverted")
NUMBERS = fx.SPEC.numeric


def uniform_sql(*parts: str) -> str:
    text = ", ".join([*parts, f"'{fx.SEED}'"])
    return f"(('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::bigint / 4503599627370496.0::double)"


def filled_sql(columns) -> str:
    """Medians of real rows, and both tables with nulls replaced by them."""
    medians = ", ".join(f"median({c}) as {c}" for c in columns)
    fills = ", ".join(f"coalesce(cast({c} as double), (select {c} from med)) as {c}" for c in columns)
    return f"med as (select {medians} from real), filled as (select row_key, model, {fills} from clean)"


def scaled_sql(columns) -> str:
    fits = ", ".join(f"avg({c}) as {c}_mean, stddev_pop({c}) as {c}_std" for c in columns)
    scales = ", ".join(f"({c} - {c}_mean) / (case when {c}_std = 0 then 1 else {c}_std end) as {c}" for c in columns)
    return (f"{filled_sql(columns)}, fit as (select {fits} from filled where model = 'real'), "
            f"scaled as (select row_key, model, {scales} from filled, fit)")


def distance_sql(a: str, b: str, columns) -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in columns) + ")"


# ---------------------------------------------------------------- filling and scaling

@query("b14_fill_real_median", SQL(f"""with {filled_sql(NUMBERS)}
select row_key, model, {', '.join(f'round({c}, 6) as {c}' for c in NUMBERS)} from filled where model <> 'real'"""))
def fill_real_median(spark, folder) -> DataFrame:
    real, candidates = fx.real_and_candidates(spark, folder, write=True)
    medians = encode.real_medians(real, NUMBERS)
    return fx.rounded(encode.fill_real_median(candidates, medians, NUMBERS).select(KEY, "model", *NUMBERS))


@query("e9_minmax_params", SQL("select " + ", ".join(
    f"min({c}) as {c}_min, max({c}) as {c}_max" for c in NUMBERS) + " from real"))
def minmax_params(spark, folder) -> DataFrame:
    return encode.minmax_params(fx.real_and_candidates(spark, folder)[0], NUMBERS)


@query("e9_std_params", SQL("select " + ", ".join(
    f"round(avg({c}), 6) as {c}_mean, round(stddev_pop({c}), 6) as {c}_std" for c in NUMBERS) + " from real"))
def std_params(spark, folder) -> DataFrame:
    return fx.rounded(encode.std_params(fx.real_and_candidates(spark, folder)[0], NUMBERS))


@query("h3_minmax_scale", SQL("""with zero as (select row_key, model, """ + ", ".join(
    f"coalesce({c}, 0) as {c}" for c in NUMBERS) + """ from clean), fit as (select """ + ", ".join(
    f"min({c}) as {c}_min, max({c}) as {c}_max" for c in NUMBERS) + """ from zero where model = 'real')
select row_key, model, """ + ", ".join(
    f"round(({c} - {c}_min) / ({c}_max - {c}_min), 6) as {c}" for c in NUMBERS) + " from zero, fit"))
def minmax_scale(spark, folder) -> DataFrame:
    real, candidates = fx.real_and_candidates(spark, folder, write=True)
    real = prep.fill_zero(real.withColumn("model", F.lit("real")), NUMBERS)
    both = real.unionByName(prep.fill_zero(candidates, NUMBERS))
    return fx.rounded(encode.minmax_scale(both, real, NUMBERS).select(KEY, "model", *NUMBERS))


@query("h4_standard_scale", SQL(f"""with {scaled_sql(DCR_COLUMNS)}
select row_key, model, {', '.join(f'round({c}, 6) + 0.0 as {c}' for c in DCR_COLUMNS)} from scaled where model <> 'real'"""))
def standard_scale(spark, folder) -> DataFrame:
    real, candidates = fx.real_and_candidates(spark, folder, write=True)
    return fx.rounded(memorization.scaled_features(real, candidates, KEY, DCR_COLUMNS)[1])


# ---------------------------------------------------------------- encoding

def codes_sql(columns) -> str:
    parts = [f"code_{c} as (select value, dense_rank() over (order by value) - 1 as code from "
             f"(select distinct {c} as value from real))" for c in columns]
    return ", ".join(parts)


def code_of(c: str, source: str) -> str:
    return f"coalesce((select code from code_{c} where value = {source}.{c}), -1) as {c}"


@query("h1_ordinal_encode", SQL(f"""with {codes_sql(fx.ENCODED)}
select row_key, model, {', '.join(code_of(c, 'clean') for c in fx.ENCODED)} from clean"""))
def ordinal_encode(spark, folder) -> DataFrame:
    real, candidates = fx.real_and_candidates(spark, folder, write=True)
    dictionary = encode.ordinal_dictionary(real, fx.ENCODED)
    both = real.withColumn("model", F.lit("real")).unionByName(candidates)
    return encode.ordinal_encode(both.select(KEY, "model", *fx.ENCODED), dictionary, fx.ENCODED)


LEAKAGE_FREE = KEPT = [c for c in fx.ENRICHED if c not in fx.LEAKAGE]


def prepared_select(source: str) -> str:
    out = []
    for c in KEPT:
        if c in fx.ENCODED:
            out.append(code_of(c, source))
        elif c in fx.SPEC.datetime:
            out.append(f"cast(floor(epoch_us({c}) / 1000000) as bigint) as {c}")
        else:
            out.append(c)
    return ", ".join(out)


PREPARED_SQL = f"""with {codes_sql([c for c in fx.ENCODED if c not in fx.LEAKAGE])}
select row_key, model, {prepared_select('clean')} from clean"""


def prepared(spark, folder):
    real, candidates = fx.real_and_candidates(spark, folder, write=True)
    real = real.withColumn("model", F.lit("real"))
    return encode.prepare_for_prediction(real, candidates, fx.ENCODED, fx.LEAKAGE, without=[KEY, "model"])


@query("h2_prepare_for_prediction", SQL(PREPARED_SQL))
def prepare_for_prediction(spark, folder) -> DataFrame:
    real, candidates = prepared(spark, folder)
    return real.unionByName(candidates)


@query("b15_drop_leakage_cols", SQL("select " + ", ".join(f"count({c}) as {c}" for c in KEPT) + " from cand"))
def drop_leakage_cols(spark, folder) -> DataFrame:
    _, candidates = fx.real_and_candidates(spark, folder)
    kept = prep.drop_features(candidates.drop(KEY, "model"), fx.LEAKAGE)
    return kept.agg(*[F.count(c).alias(c) for c in kept.columns])


@query("b16_assert_all_numeric", SQL(f"select " + ", ".join(f"count({c}) as {c}" for c in KEPT) + f" from ({PREPARED_SQL.replace('with ', 'with ', 1)}) where model = 'real'"))
def assert_all_numeric(spark, folder) -> DataFrame:
    """Passes only when every prepared column is numeric; then counts the known values."""
    real, _ = prepared(spark, folder)
    checked = prep.assert_all_numeric(real, without=[KEY, "model"])
    return checked.agg(*[F.count(c).alias(c) for c in KEPT])


# ---------------------------------------------------------------- splits, weights, oversampling

FLOWN_SQL = "flown as (select row_key, diverted, air_time, taxi_out, taxi_in, distance, act_elapsed, sched_elapsed from record where status not in ('C', 'S'))"
RANKED_SQL = f"""{FLOWN_SQL}, ranked as (select *, count(*) over (partition by diverted) as n,
  row_number() over (partition by diverted order by {uniform_sql('row_key')}, row_key) - 1 as pos from flown)"""


@query("h5_stratified_split", SQL(f"with {RANKED_SQL} select row_key, diverted, pos < floor(n * 0.7::double) as is_train from ranked"))
def stratified_split(spark, folder) -> DataFrame:
    flown = fx.written(fx.historical(fx.records(spark, folder)).select(KEY, "diverted"))
    return split.stratified_split(flown, "diverted", KEY, fx.SEED)


@query("h6_stratified_kfold", SQL(f"with {RANKED_SQL} select row_key, diverted, cast(pos % 5 as integer) as fold from ranked"))
def stratified_kfold(spark, folder) -> DataFrame:
    flown = fx.written(fx.historical(fx.records(spark, folder)).select(KEY, "diverted"))
    return split.stratified_kfold(flown, ["diverted"], KEY, fx.SEED)


SMOTE_COLUMNS = ("taxi_out", "taxi_in", "sched_elapsed", "act_elapsed", "air_time", "distance")


@query("h7_smote", SQL(f"""with {FLOWN_SQL}, fit as (
  select {', '.join(f'avg({c}) as {c}_mean, stddev_pop({c}) as {c}_std' for c in SMOTE_COLUMNS)} from flown
), points as (
  select row_key, diverted, {', '.join(f'({c} - {c}_mean) / {c}_std as {c}' for c in SMOTE_COLUMNS)} from flown, fit
), rare as (
  select *, row_number() over (order by {uniform_sql('row_key')}, row_key) - 1 as pos from points where diverted = 1
), sizes as (
  select count(*) filter (diverted = 1) as n_rare, count(*) filter (diverted = 0) - count(*) filter (diverted = 1) as missing
  from points
), close as (
  select a.row_key, b.row_key as neighbour, row_number() over (
    partition by a.row_key order by round({distance_sql('a', 'b', SMOTE_COLUMNS)}, 9), b.row_key) as rnk
  from rare a, rare b where a.row_key <> b.row_key
), near as (select * from close where rnk <= 5),
copies as (
  select row_key, unnest(generate_series(1, missing // n_rare + case when pos < missing % n_rare then 1 else 0 end)) as copy
  from rare, sizes
), picks as (
  select row_key, copy, cast(floor({uniform_sql('row_key', "'neighbour'", 'cast(copy as varchar)')} * 5) as int) + 1 as pick,
    {uniform_sql('row_key', "'step'", 'cast(copy as varchar)')} as step from copies
)
select p.row_key || '#' || cast(copy as varchar) as row_key,
  {', '.join(f'round(a.{c} + step * (b.{c} - a.{c}), 6) + 0.0 as {c}' for c in SMOTE_COLUMNS)}, 1 as diverted
from picks p join near n on n.row_key = p.row_key and n.rnk = p.pick
  join rare a on a.row_key = p.row_key join rare b on b.row_key = n.neighbour"""))
def smote(spark, folder) -> DataFrame:
    flown = fx.written(fx.historical(fx.records(spark, folder)).select(KEY, "diverted", *SMOTE_COLUMNS))
    scaled = encode.standard_scale(flown, flown, SMOTE_COLUMNS)
    return fx.rounded(sm.smote(scaled, "diverted", KEY, SMOTE_COLUMNS, fx.SEED))


@query("h8_class_weights", SQL(f"""with {FLOWN_SQL}
select diverted, count(*) as n, round((select count(*) from flown) / (2.0::double * count(*)), 6) as weight
from flown group by diverted"""))
def class_weights(spark, folder) -> DataFrame:
    return fx.rounded(split.class_weights(fx.historical(fx.records(spark, folder)), "diverted"))


@query("h9_augment_train", SQL(f"""with {RANKED_SQL}, train as (
  select row_key, diverted from ranked where pos < floor(n * 0.7::double))
select 'trtr' as setting, diverted, count(*) as n from train group by diverted
union all select model, diverted, count(*) from (
  select m.model, t.diverted from train t, (select distinct model from cand) m
  union all select model, 1 from cand) group by model, diverted"""))
def augment_train(spark, folder) -> DataFrame:
    full = fx.records(spark, folder)
    flown = fx.written(fx.historical(full).select(KEY, "diverted"))
    ranked = split.stratified_split(flown, "diverted", KEY, fx.SEED)
    train = fx.written(ranked.where("is_train").select(KEY, "diverted"))
    _, candidates = fx.real_and_candidates(spark, folder, write=True)
    out = train.withColumn("setting", F.lit("trtr"))
    for model in fx.MODELS:
        own = split.augment_train(train, candidates.where(F.col("model") == model))
        out = out.unionByName(own.withColumn("setting", F.lit(model)))
    return out.groupBy("setting", "diverted").agg(F.count("*").alias("n"))


@query("h10_seed_control", SQL(f"select row_key, {uniform_sql('row_key')} as u, {uniform_sql('row_key', chr(39) + 'tag' + chr(39))} as u_tag from record"))
def seed_control(spark, folder) -> DataFrame:
    from recordaudit.functions.scalars import hash_uniform
    return fx.records(spark, folder).select(
        KEY, hash_uniform(fx.SEED, KEY).alias("u"), hash_uniform(fx.SEED, KEY, F.lit("tag")).alias("u_tag"))


# ---------------------------------------------------------------- copy detection

NEAREST_SQL = f"""with {scaled_sql(DCR_COLUMNS)}, dcr as (
  select c.row_key, c.model, round(min({distance_sql('c', 'r', DCR_COLUMNS)}), 9) as dcr
  from scaled c, scaled r where c.model <> 'real' and r.model = 'real' group by c.row_key, c.model
), base as (
  select c.row_key, round(min({distance_sql('c', 'r', DCR_COLUMNS)}), 9) as dcr
  from scaled c, scaled r where c.model = 'real' and r.model = 'real' and c.row_key <> r.row_key group by c.row_key
)"""


def scaled(spark, folder):
    real, candidates = fx.real_and_candidates(spark, folder, write=True)
    return memorization.scaled_features(real, candidates, KEY, DCR_COLUMNS)


def candidate_dcr(spark, folder) -> DataFrame:
    real, candidates = scaled(spark, folder)
    return memorization.nearest_real(real, fx.written(candidates), KEY, DCR_COLUMNS)


@query("c7_nearest_real", SQL(NEAREST_SQL + "select row_key, model, round(dcr, 6) as dcr from dcr"))
def nearest_real(spark, folder) -> DataFrame:
    return fx.rounded(candidate_dcr(spark, folder))


@query("c8_nearest_other_real", SQL(NEAREST_SQL + "select row_key, round(dcr, 6) as dcr from base"))
def nearest_other_real(spark, folder) -> DataFrame:
    return fx.rounded(memorization.nearest_other_real(scaled(spark, folder)[0], KEY, DCR_COLUMNS))


STATS_SQL = NEAREST_SQL + """, stats as (select model, count(*) as rows, avg(dcr) as mean_dcr, median(dcr) as median_dcr,
  min(dcr) as min_dcr, max(dcr) as max_dcr, count(*) filter (dcr < 0.05) as copies,
  count(*) filter (dcr < 0.05) / count(*) * 100 as copies_pct from dcr group by model)"""
STATS_COLUMNS = """model, rows, round(mean_dcr, 6) as mean_dcr, round(median_dcr, 6) as median_dcr,
  round(min_dcr, 6) as min_dcr, round(max_dcr, 6) as max_dcr, copies, round(copies_pct, 6) as copies_pct"""


@query("e6_dcr_stats", SQL(STATS_SQL + f"select {STATS_COLUMNS} from stats"))
def dcr_stats(spark, folder) -> DataFrame:
    return fx.rounded(memorization.dcr_stats(fx.written(candidate_dcr(spark, folder))))


@query("e7_memorized_share", SQL(STATS_SQL + "select model, rows, copies, round(copies_pct, 6) as copies_pct from stats"))
def memorized_share(spark, folder) -> DataFrame:
    stats = memorization.dcr_stats(fx.written(candidate_dcr(spark, folder)))
    return fx.rounded(stats.select("model", "rows", "copies", "copies_pct"))


RATIO_COLUMNS = """round((select avg(dcr) from base), 6) as baseline_dcr,
  round(mean_dcr / (select avg(dcr) from base), 6) as dcr_ratio, mean_dcr / (select avg(dcr) from base) < 1 as suspected"""


def ratio(spark, folder) -> DataFrame:
    real, candidates = scaled(spark, folder)
    real, candidates = fx.written(real), fx.written(candidates)
    index = neighbours.box_index(real, KEY, DCR_COLUMNS, keep=2)  # one index for both searches
    stats = memorization.dcr_stats(fx.written(memorization.nearest_real(index, candidates, KEY, DCR_COLUMNS)))
    return memorization.dcr_ratio(stats, memorization.nearest_other_real(real, KEY, DCR_COLUMNS, index))


@query("e8_dcr_ratio_flag", SQL(STATS_SQL + f"select model, {RATIO_COLUMNS} from stats"))
def dcr_ratio_flag(spark, folder) -> DataFrame:
    return fx.rounded(ratio(spark, folder).select("model", "baseline_dcr", "dcr_ratio", "suspected"))


@query("n7_memorization_report", SQL(STATS_SQL + f"select {STATS_COLUMNS}, {RATIO_COLUMNS} from stats"))
def memorization_report(spark, folder) -> DataFrame:
    return fx.rounded(ratio(spark, folder))
