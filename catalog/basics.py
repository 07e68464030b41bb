"""Sources, scalar functions, joins, dimensions and simple aggregates."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, functions as F

from catalog import fixtures as fx
from catalog.registry import query
from recordaudit.functions import scalars as sc
from recordaudit.operators import balance, enrich as en, prep, realism
from recordaudit.plans import prepare
from recordaudit.session import shared_dir
from recordaudit.sources import schema, tables

REL = fx.RELATIONS
SQL = fx.with_views


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/recordaudit/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks

@query("a1_scan_table", "select l_returnflag, count(*) as n, sum(l_quantity) as quantity "
                        "from lineitem group by l_returnflag")
def scan_table(spark, folder) -> DataFrame:
    lines = tables.scan_table(spark, f"{folder}/lineitem.parquet")
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def variant_rows(full: DataFrame) -> DataFrame:
    """Candidates as (model, state, size) sets."""
    name = F.col("model")
    return full.where(F.col("status") == "S").select(
        fx.KEY, "origin", "destination", "air_time",
        F.when(name == "GC", "GC").otherwise(F.split(name, " ")[1]).alias("model"),
        F.when(name.startswith("Optimal"), "optimal").otherwise("default").alias("state"),
        (500 + 500 * (F.col("l_linenumber") % 3)).cast("bigint").alias("size"))


VARIANT_SQL = """with variants as (
select row_key, origin, destination, air_time, case when model = 'GC' then 'GC' else split_part(model, ' ', 2) end as model,
  case when model like 'Optimal%' then 'optimal' else 'default' end as state,
  cast(500 + 500 * (l_linenumber % 3) as bigint) as size from record where status = 'S')"""


@query("a2_scan_variants", SQL(VARIANT_SQL + """
select * from variants where model in ('TVAE', 'CTGAN') and state = 'optimal' and size in (500, 1000)"""))
def scan_variants(spark, folder) -> DataFrame:
    path = scratch(spark, "variants")
    tables.sink_table(variant_rows(fx.rare_records(spark, folder)), path)
    found = tables.scan_variants(spark, path, ["TVAE", "CTGAN"], ["optimal"], [500, 1000])
    return found.withColumn("size", F.col("size").cast("bigint"))


@query("a3_scan_result_dir", SQL("""
select model, cast(l_linenumber as bigint) as size, count(*) as n, round(avg(air_time), 6) as mean_air_time
from record where status = 'S' group by model, l_linenumber"""))
def scan_result_dir(spark, folder) -> DataFrame:
    per_size = fx.rare_records(spark, folder).where("status = 'S'").groupBy(
        "model", F.col("l_linenumber").cast("bigint").alias("size")).agg(
        F.count("*").alias("n"), F.round(F.avg("air_time"), 6).alias("mean_air_time"))
    results = scratch(spark, "results")
    for odd in (0, 1):
        tables.sink_table(per_size.where(F.col("size") % 2 == odd), f"{results}/part-{odd}", None)
    return tables.scan_result_dir(spark, results).drop("file_no")


SDTYPES = {**{c: "categorical" for c in fx.SPEC.categorical}, **{c: "numerical" for c in fx.SPEC.numeric},
           **{c: "datetime" for c in fx.SPEC.datetime}, **{c: "city" for c in fx.SPEC.location}}


@query("a4_schema_registry", SQL("select column_name, sdtype, known from (" + " union all ".join(
    f"select '{c}' as column_name, '{k}' as sdtype, count({c}) as known from enriched_all where model = 'real'"
    for c, k in SDTYPES.items()) + ")"))
def schema_registry(spark, folder) -> DataFrame:
    """Semantic types from a metadata document, with the number of known values per column."""
    fx.pin_utc(spark)
    path = scratch(spark, "metadata")
    body = {"tables": {"records": {"columns": {c: {"sdtype": k} for c, k in SDTYPES.items()}}}}
    spark.createDataFrame([(json.dumps(body),)], "value string").write.text(path)
    registry = schema.read_metadata(spark, path)
    spec = schema.spec_from_metadata(registry, fx.KEY, "model", "diverted")
    full = fx.rare_records(spark, folder)
    real = en.enrich(fx.real_generated(full), *fx.dimensions(spark, folder), REL, [fx.KEY])
    names = [*spec.scored(), *spec.location]
    known = schema.tag_schema(real, spec).agg(*[F.count(c).alias(c) for c in names])
    counts = known.unpivot([], names, "column_name", "known")
    return registry.select("column_name", "sdtype").join(counts, "column_name")


@query("a5_sink_table", SQL(VARIANT_SQL + "select model, state, size, count(*) as n from variants group by all"))
def sink_table(spark, folder) -> DataFrame:
    path = scratch(spark, "sink")
    tables.sink_table(variant_rows(fx.rare_records(spark, folder)), path)
    return tables.scan_table(spark, path).groupBy(
        "model", "state", F.col("size").cast("bigint").alias("size")).agg(F.count("*").alias("n"))


@query("a7_export_per_model", SQL("select model, count(*) as n, round(sum(air_time), 2) as air_time "
                                  "from record where status = 'S' group by model"))
def export_per_model(spark, folder) -> DataFrame:
    path = scratch(spark, "export")
    tables.export_per_model(fx.rare_records(spark, folder).where("status = 'S'").select("model", fx.KEY, "air_time"), path)
    back = spark.read.schema("row_key string, air_time double, model string").csv(path, header=True)
    return back.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("air_time"), 2).alias("air_time"))


# ---------------------------------------------------------------- filters, labels, projections

NULL_STATUS = "nullif(status, 'O')"


def with_null_status(spark, folder) -> DataFrame:
    return fx.records(spark, folder).withColumn("status", F.expr(NULL_STATUS))


@query("b1_drop_cancelled", SQL(f"""
select count(*) as rows_before, count(*) filter (status = 'C') as rows_removed,
  count(*) filter (coalesce(status, '') <> 'C') as rows_after from (select {NULL_STATUS} as status from record)"""))
def drop_cancelled(spark, folder) -> DataFrame:
    return prep.cancelled_counts(with_null_status(spark, folder))


@query("b1_drop_cancelled_rows", SQL(f"""
select row_key, status from (select row_key, {NULL_STATUS} as status from record) where status is distinct from 'C'"""))
def drop_cancelled_rows(spark, folder) -> DataFrame:
    return prep.drop_cancelled(with_null_status(spark, folder)).select(fx.KEY, "status")


@query("b2_binary_label", SQL("select diverted, count(*) as n from record group by diverted"))
def binary_label(spark, folder) -> DataFrame:
    return prep.binary_label(with_null_status(spark, folder), "diverted").groupBy("diverted").agg(
        F.count("*").alias("n"))


PREPARED_COLUMNS = [c for c in fx.ENRICHED if c not in (
    "quarter", "day_of_week", "dep_delay_label", "arr_delay_label", "wheels_off", "wheels_on", "sched_arr", "act_arr")]


@query("b3_drop_features", SQL(f"""
select row_key, {fx.micros_sql(PREPARED_COLUMNS, ('sched_dep', 'act_dep'))} from record where status <> 'C'"""))
def drop_features(spark, folder) -> DataFrame:
    simple = prep.simplify(fx.records(spark, folder), "diverted", fx.DROPPED)
    return fx.micros(simple.select(fx.KEY, *PREPARED_COLUMNS))


@query("b4_rare_class_slice", SQL("select row_key, diverted from record where status = 'D'"))
def rare_class_slice(spark, folder) -> DataFrame:
    return prep.rare_class(prep.binary_label(fx.records(spark, folder), "diverted"), "diverted").select(
        fx.KEY, "diverted")


@query("b5_project_order", SQL(f"""
select {fx.micros_sql(fx.ENRICHED, fx.SPEC.datetime)} from enriched_all where model = 'real'"""))
def project_order(spark, folder) -> DataFrame:
    full = fx.rare_records(spark, folder)
    return fx.micros(en.enrich(fx.real_generated(full), *fx.dimensions(spark, folder), REL))


@query("b6_gen_cols_projection", SQL(f"""
select {fx.micros_sql(fx.GENERATED, fx.SPEC.datetime)} from cand"""))
def gen_cols_projection(spark, folder) -> DataFrame:
    full = fx.rare_records(spark, folder)
    _, candidates = fx.real_and_candidates(spark, folder)
    return fx.micros(prep.restrict_to(candidates, fx.real_generated(full).drop(fx.KEY)))


@query("b7_rename_columns", SQL("""
select distinct destination as place_id, dest_icao as icao, dest_city as city, dest_state_code as state_code,
  dest_state_name as state_name from record"""))
def rename_columns(spark, folder) -> DataFrame:
    own = [REL.place_column("dest", a) for a in REL.place_attributes]
    side = fx.records(spark, folder).select("destination", *own)
    return en.place_columns(side, REL, "dest", "destination").distinct()


@query("b8_quarter_dow", SQL("""
select cast(quarter(sched_dep) as integer) as quarter, cast(isodow(sched_dep) as integer) as day_of_week, count(*) as n
from record group by 1, 2"""))
def quarter_dow(spark, folder) -> DataFrame:
    return en.add_calendar(fx.records(spark, folder), REL).groupBy("quarter", "day_of_week").agg(
        F.count("*").alias("n"))


@query("b9_ts_plus_minutes", SQL("""
select row_key, epoch_us(act_dep) + cast(taxi_out * 60000000 as bigint) as wheels_off,
  epoch_us(act_dep) + cast((taxi_out + air_time) * 60000000 as bigint) as wheels_on,
  epoch_us(sched_dep) + cast(sched_elapsed * 60000000 as bigint) as sched_arr,
  epoch_us(act_dep) + cast(act_elapsed * 60000000 as bigint) as act_arr from record"""))
def ts_plus_minutes(spark, folder) -> DataFrame:
    timed = en.add_timeline(fx.records(spark, folder), REL)
    return fx.micros(timed.select(fx.KEY, "wheels_off", "wheels_on", "sched_arr", "act_arr"))


@query("b10_delay_label", SQL("""
select row_key, case when dep_delta >= 15 then 1.0::double when dep_delta < 15 then 0.0::double end as dep_delay_label,
  case when arr_delta >= 15 then 1.0::double when arr_delta < 15 then 0.0::double end as arr_delay_label from record"""))
def delay_label(spark, folder) -> DataFrame:
    return en.add_delay_labels(fx.records(spark, folder), REL).select(fx.KEY, "dep_delay_label", "arr_delay_label")


@query("b11_epoch_seconds", SQL("""
select row_key, cast(floor(epoch_us(sched_dep) / 1000000) as bigint) as sched_dep,
  cast(floor((epoch_us(act_dep) + cast(taxi_out * 60000000 as bigint)) / 1000000) as bigint) as wheels_off
from record"""))
def epoch_seconds(spark, folder) -> DataFrame:
    timed = en.add_timeline(fx.records(spark, folder), REL)
    return timed.select(fx.KEY, *[sc.epoch_seconds(c).alias(c) for c in ("sched_dep", "wheels_off")])


@query("b12_select_numeric", SQL("""
select row_key, quarter, day_of_week, dep_delta, dep_delay_label, taxi_out, taxi_in, arr_delta, arr_delay_label,
  sched_elapsed, act_elapsed, air_time, distance, diverted
from (select * replace (cast(quarter as integer) as quarter, cast(day_of_week as integer) as day_of_week) from real)"""))
def select_numeric(spark, folder) -> DataFrame:
    return prep.select_numeric(fx.real_and_candidates(spark, folder)[0], [fx.KEY])


@query("b13_fill_zero", SQL("""
select row_key, coalesce(dep_delta, 0) as dep_delta, coalesce(arr_delta, 0) as arr_delta from cand"""))
def fill_zero(spark, folder) -> DataFrame:
    _, candidates = fx.real_and_candidates(spark, folder)
    return prep.fill_zero(candidates.select(fx.KEY, "dep_delta", "arr_delta"), ["dep_delta", "arr_delta"])


@query("b17_dropna_subset", SQL("select row_key, model, distance from cand"))
def dropna_subset(spark, folder) -> DataFrame:
    full = fx.rare_records(spark, folder)
    routes = fx.known_routes(spark, folder)
    return en.join_routes(fx.candidates_generated(full), routes, REL).dropna(subset=["distance"]).select(
        fx.KEY, "model", "distance")


@query("b18_source_tag", SQL("""
select row_key, case when model = 'real' then 1 else 0 end as source from pool"""))
def source_tag(spark, folder) -> DataFrame:
    full = fx.rare_records(spark, folder)
    return prep.stack_real_and_candidates(
        fx.real_generated(full), fx.candidates_generated(full).drop("model")).select(fx.KEY, "source")


@query("b19_round_pct", SQL("""
select l_suppkey, round_even(count(*) filter (dep_delta >= 15) / count(*) * 100, 1) as delayed_pct from record group by 1"""))
def round_pct(spark, folder) -> DataFrame:
    return fx.records(spark, folder).groupBy("l_suppkey").agg(
        sc.round_pct(F.count_if(F.col("dep_delta") >= 15), F.count("*")).alias("delayed_pct"))


@query("b20_model_display_name", SQL("""
select case when model like 'Default %' then '$' || replace(model, 'Default ', '') || '$'
  when model like 'Optimal %' then '$' || replace(model, 'Optimal ', '') || '_{opt.}$'
  when model in ('GC', 'real') then '$' || model || '$' else model end as display, count(*) as n
from pool group by 1"""))
def model_display_name(spark, folder) -> DataFrame:
    full = fx.rare_records(spark, folder)
    both = fx.candidates_generated(full).select("model").unionByName(
        fx.real_generated(full).select(F.lit("real").alias("model")))
    return both.groupBy(sc.display_name("model").alias("display")).agg(F.count("*").alias("n"))


@query("b21_exclude_models", SQL("""
select model, count(*) as n from cand where model not in ('GC', 'Default TVAE') group by model"""))
def exclude_models(spark, folder) -> DataFrame:
    _, candidates = fx.real_and_candidates(spark, folder)
    return candidates.where(~F.col("model").isin("GC", "Default TVAE")).groupBy("model").agg(F.count("*").alias("n"))


@query("b25_parse_variant_name", SQL("""
select lower(split_part(name, '_', 2)) as synth_type, lower(split_part(name, '_', 4)) as synth_state, count(*) as n
from (select 'synthesizer_' || case when model = 'GC' then 'GC' else split_part(model, ' ', 2) end || '_diversions_' ||
  case when model like 'Optimal%' then 'Optimal' else 'Default' end || '_V' || cast(l_linenumber as varchar) as name
  from record where status = 'S') group by 1, 2"""))
def parse_variant_name(spark, folder) -> DataFrame:
    rows = variant_rows(fx.rare_records(spark, folder))
    named = rows.select(F.concat_ws("_", F.lit("synthesizer"), "model", F.lit("diversions"), F.initcap("state"),
                                    F.concat(F.lit("V"), "size")).alias("name"))
    return named.groupBy(sc.variant_type("name").alias("synth_type"), sc.variant_state("name").alias("synth_state")).agg(
        F.count("*").alias("n"))


# ---------------------------------------------------------------- joins and dimensions

# A route table in which the routes of every origin below 10 have a second distance.
FAN_OUT_SQL = """with fan_out as (
  select * from routes union all select origin, destination, distance + 1 from routes where cast(origin as int) < 10)"""


def fan_out_routes(spark, folder) -> DataFrame:
    routes = fx.known_routes(spark, folder)
    return routes.unionByName(routes.where(F.col("origin").cast("int") < 10).withColumn("distance", F.col("distance") + 1))


@query("c1_route_distance_join", SQL(FAN_OUT_SQL + """
select row_key, model, f.distance from pool left join fan_out f using (origin, destination) where model <> 'real'"""))
def route_distance_join(spark, folder) -> DataFrame:
    full = fx.rare_records(spark, folder)
    return en.join_routes(fx.candidates_generated(full), fan_out_routes(spark, folder), REL).select(fx.KEY, "model", "distance")


@query("c2_airport_join_origin", SQL("""
select row_key, origin_icao, origin_city, origin_state_code, origin_state_name from enriched_all where model <> 'real'"""))
def airport_join_origin(spark, folder) -> DataFrame:
    full = fx.records(spark, folder)
    places = fx.written(en.airport_dimension(full, REL))
    joined = en.join_places(fx.candidates_generated(full), places, REL, "origin", "origin")
    return joined.select(fx.KEY, "origin_icao", "origin_city", "origin_state_code", "origin_state_name")


@query("c3_airport_join_dest", SQL("""
select row_key, dest_icao, dest_city, dest_state_code, dest_state_name from enriched_all where model <> 'real'"""))
def airport_join_dest(spark, folder) -> DataFrame:
    full = fx.records(spark, folder)
    places = fx.written(en.airport_dimension(full, REL))
    joined = en.join_places(fx.candidates_generated(full), places, REL, "dest", "destination")
    return joined.select(fx.KEY, "dest_icao", "dest_city", "dest_state_code", "dest_state_name")


@query("c4_valid_route_semi", SQL(FAN_OUT_SQL + """
select row_key, model from pool where model <> 'real' and (origin, destination) in (select origin, destination from fan_out)"""))
def valid_route_semi(spark, folder) -> DataFrame:
    full = fx.rare_records(spark, folder)
    return en.valid_routes(fx.candidates_generated(full), fan_out_routes(spark, folder), REL).select(fx.KEY, "model")


@query("c5_novel_route_anti", SQL("""
select row_key, model, origin, destination from pool p where model <> 'real' and not exists (
  select 1 from routes r where r.origin = p.origin and r.destination = p.destination)"""))
def novel_route_anti(spark, folder) -> DataFrame:
    full = fx.rare_records(spark, folder)
    routes = fx.known_routes(spark, folder)
    return en.novel_routes(fx.candidates_generated(full), routes, REL).select(
        fx.KEY, "model", "origin", "destination")


@query("c6_enrich_and_clean", SQL(f"""
select row_key, model, {fx.micros_sql(fx.ENRICHED, fx.SPEC.datetime)}
from (select * replace (cast(quarter as integer) as quarter, cast(day_of_week as integer) as day_of_week) from cand)"""))
def enrich_and_clean(spark, folder) -> DataFrame:
    return fx.micros(fx.real_and_candidates(spark, folder)[1])


@query("d1_airport_dimension", SQL("select * from airports"))
def airport_dimension(spark, folder) -> DataFrame:
    return en.airport_dimension(fx.records(spark, folder), REL)


@query("d2_route_dimension", SQL("select * from routes"))
def route_dimension(spark, folder) -> DataFrame:
    return en.route_dimension(fx.route_history(fx.records(spark, folder)), REL)


@query("d3_union_real_synth", SQL("select model, count(*) as n, round(sum(air_time), 2) as air_time from clean group by model"))
def union_real_synth(spark, folder) -> DataFrame:
    real, candidates = fx.real_and_candidates(spark, folder, write=True)
    both = real.withColumn("model", F.lit("real")).unionByName(candidates)
    return both.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("air_time"), 2).alias("air_time"))


@query("d4_distinct_rows", SQL("select distinct carrier, quarter, dep_delay_label, arr_delay_label from "
                               "(select * replace (cast(quarter as integer) as quarter) from clean)"))
def distinct_rows(spark, folder) -> DataFrame:
    real, candidates = fx.real_and_candidates(spark, folder, write=True)
    columns = ["carrier", "quarter", "dep_delay_label", "arr_delay_label"]
    return real.select(columns).unionByName(candidates.select(columns)).distinct()


@query("m5_prepare_tables", SQL("""
select 'all_flown' as table_name, count(*) as n, sum(diverted) as rare, round(avg(distance), 6) as mean_distance
from record where status not in ('C', 'S')
union all select 'rare_generated', count(*), sum(diverted), null from pool where model = 'real'
union all select 'rare_enriched', count(*), sum(diverted), round(avg(distance), 6) from real""").replace(
    "sum(diverted)", "cast(sum(diverted) as bigint)"))
def prepare_tables(spark, folder) -> DataFrame:
    raw = fx.records(spark, folder).where("status <> 'S'")
    done = prepare.prepare_tables(raw, fx.is_route_history(), fx.GENERATED, fx.DROPPED, REL, fx.SPEC)

    def summary(df, name):
        mean = F.round(F.avg("distance"), 6) if "distance" in df.columns else F.lit(None).cast("double")
        return df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"),
                      F.sum("diverted").alias("rare"), mean.alias("mean_distance"))

    return summary(done.flown, "all_flown").unionByName(
        summary(done.rare_generated, "rare_generated")).unionByName(summary(done.rare_enriched, "rare_enriched"))


# ---------------------------------------------------------------- simple aggregates

@query("e1_realism_pct", SQL("""
select model, count(*) as rows_generated, count(distance) as rows_valid,
  round_even(count(distance) / count(*) * 100, 1) as realism from enriched_all
where model <> 'real' group by model"""))
def realism_pct(spark, folder) -> DataFrame:
    full = fx.rare_records(spark, folder)
    routes = fx.known_routes(spark, folder)
    return realism.realism_pct(fx.candidates_generated(full), routes, REL)


@query("e2_realism_fraction", SQL("""
select model, round(avg(case when distance is null then 0.0 else 1.0 end), 6) as realism from enriched_all
where model <> 'real' group by model"""))
def realism_fraction(spark, folder) -> DataFrame:
    full = fx.rare_records(spark, folder)
    routes = fx.known_routes(spark, folder)
    return fx.rounded(realism.realism_fraction(fx.candidates_generated(full), routes, REL))


@query("e3_route_distance_unique", SQL(FAN_OUT_SQL + """
select 'history' as source, count(*) as routes, bool_and(n = 1) as is_unique from (
  select count(distinct distance) as n from routes group by origin, destination)
union all select 'fan_out', count(*), bool_and(n = 1) from (
  select count(distinct distance) as n from fan_out group by origin, destination)"""))
def route_distance_unique(spark, folder) -> DataFrame:
    full = fx.records(spark, folder)
    once = en.route_distance_unique(fx.route_history(full), REL).withColumn("source", F.lit("history"))
    return once.unionByName(
        en.route_distance_unique(fan_out_routes(spark, folder), REL).withColumn("source", F.lit("fan_out")))


@query("e4_class_balance", SQL("""
select model, count(*) as n, count(*) filter (dep_delay_label = 1) as delayed_dep,
  count(*) filter (dep_delay_label = 0) as on_time_dep,
  count(*) filter (dep_delay_label is null) as unknown_dep,
  count(*) filter (arr_delay_label = 1) as delayed_arr, count(*) filter (arr_delay_label = 0) as on_time_arr,
  count(*) filter (arr_delay_label is null) as unknown_arr,
  round_even(count(*) filter (dep_delay_label = 1) / count(*) * 100, 1) as delayed_dep_pct,
  round_even(count(*) filter (dep_delay_label = 0) / count(*) * 100, 1) as on_time_dep_pct,
  round_even(count(*) filter (arr_delay_label = 1) / count(*) * 100, 1) as delayed_arr_pct,
  round_even(count(*) filter (arr_delay_label = 0) / count(*) * 100, 1) as on_time_arr_pct
from clean group by model"""))
def class_balance(spark, folder) -> DataFrame:
    real, candidates = fx.real_and_candidates(spark, folder, write=True)
    both = real.withColumn("model", F.lit("real")).unionByName(candidates)
    return balance.class_balance(both, "model", {"dep": "dep_delay_label", "arr": "arr_delay_label"})


@query("e5_value_counts", SQL("""
select model, 'dep_delay_label' as feature, dep_delay_label as value, count(*) as n from clean group by all
union all select model, 'arr_delay_label', arr_delay_label, count(*) from clean group by all"""))
def value_counts(spark, folder) -> DataFrame:
    real, candidates = fx.real_and_candidates(spark, folder, write=True)
    both = real.withColumn("model", F.lit("real")).unionByName(candidates)
    return balance.value_counts(both, "model", ["dep_delay_label", "arr_delay_label"])


@query("e12_nunique_models", SQL("select count(distinct model) as models from cand"))
def nunique_models(spark, folder) -> DataFrame:
    return fx.real_and_candidates(spark, folder)[1].agg(F.countDistinct("model").alias("models"))
