"""Statistical similarity, validity, densities, components and operational attributes."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from catalog import fixtures as fx
from catalog.registry import query
from recordaudit.operators import density, diversity, similarity as sim
from recordaudit.operators.prep import numeric_columns

SQL = fx.with_views
RECURSIVE = fx.with_recursive_views
SPEC, GEN = fx.SPEC, fx.GEN_SPEC
REPORT_DIGITS = 6


def number_sql(c: str) -> str:
    return f"epoch_us({c}) / 1000000.0::double" if c in SPEC.datetime else f"cast({c} as double)"


def text_sql(c: str) -> str:
    return f"coalesce(cast({c} as varchar), '(unknown)')"


def both_sql(real: str, cand: str) -> str:
    return f"(select * from {real} union all by name select * from {cand})"


def correlation_sql(spec, both: str, tag: str = "") -> str:
    """Table expressions up to corr{tag}: correlations of all pairs of numbers, and their scores."""
    continuous = spec.numeric + spec.datetime
    numbers = ", ".join(f"{number_sql(c)} as {c}" for c in continuous)
    couples = list(combinations(continuous, 2))
    wide = ", ".join(f"corr({a}, {b}) as c{i}" for i, (a, b) in enumerate(couples))
    each = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': c{i}}}" for i, (a, b) in enumerate(couples))
    return f"""corr_wide{tag} as materialized (select model, {wide} from (select model, {numbers} from {both}) group by model),
corr_all{tag} as (select model, p.a as column_a, p.b as column_b, p.r as r from (select model, unnest([{each}]) as p from corr_wide{tag})),
corr{tag} as (
  select s.model, s.column_a, s.column_b, s.r, r.r as r_real, 1 - abs(r.r - s.r) / 2 as score
  from corr_all{tag} s join corr_all{tag} r on r.model = 'real' and r.column_a = s.column_a and r.column_b = s.column_b
  where s.model <> 'real')"""


def quality_sql(spec=SPEC, real: str = "real", cand: str = "cand", tag: str = "") -> str:
    """Table expressions for all column and pair scores; ``tag`` keeps two sets apart."""
    continuous = spec.numeric + spec.datetime
    both = both_sql(real, cand)
    longs = " union all ".join(
        f"select model, '{c}' as column_name, {number_sql(c)} as value from {both}" for c in continuous)
    cats = " union all ".join(
        f"select model, '{c}' as column_name, {text_sql(c)} as value from {both}" for c in spec.categorical)
    edges = ", ".join(f"min({number_sql(c)}) as {c}_min, max({number_sql(c)}) as {c}_max" for c in continuous)
    codes = [f"{text_sql(c)} as {c}" for c in spec.categorical] + [
        f"coalesce(cast(case when {number_sql(c)} < {c}_min then 0 when {number_sql(c)} >= {c}_max then 11 else "
        f"cast(floor(({number_sql(c)} - {c}_min) / ({c}_max - {c}_min) * 10) as int) + 1 end as varchar), '(unknown)') as {c}"
        for c in continuous]
    pairs = [(a, b) for a, b in combinations(spec.categorical + continuous, 2) if a in spec.categorical]
    cells = " union all ".join(
        f"select model, '{a}' as column_a, '{b}' as column_b, {a} as a, {b} as b, count(*) as n from coded{tag} group by all"
        for a, b in pairs)
    return f"""sizes{tag} as (select model, count(*) as total from {both} group by model),
models{tag} as (select model from sizes{tag} where model <> 'real'),
long{tag} as (select * from ({longs}) where value is not null),
grid{tag} as (select distinct column_name, value from long{tag}),
counted{tag} as (select model, column_name, value, count(*) as n from long{tag} group by all),
steps{tag} as (
  select g.column_name, g.value, m.model, coalesce(n, 0) as n
  from grid{tag} g cross join (select model from sizes{tag}) m
  left join counted{tag} c on c.column_name = g.column_name and c.value = g.value and c.model = m.model),
ecdf{tag} as (
  select column_name, value, model, sum(n) over (partition by model, column_name order by value)
    / sum(n) over (partition by model, column_name) as f from steps{tag}),
ks{tag} as (
  select s.model, s.column_name, 1 - max(abs(s.f - r.f)) as score
  from ecdf{tag} s join ecdf{tag} r on r.model = 'real' and r.column_name = s.column_name and r.value = s.value
  where s.model <> 'real' group by s.model, s.column_name),
cat{tag} as (select model, column_name, value, count(*) as n from ({cats}) group by all),
share{tag} as (select c.*, n / total as p from cat{tag} c join sizes{tag} using (model)),
real_by_model{tag} as (select m.model, r.column_name, r.value, r.p from share{tag} r, models{tag} m where r.model = 'real'),
tv{tag} as (
  select coalesce(s.model, r.model) as model, coalesce(s.column_name, r.column_name) as column_name,
    1 - 0.5::double * sum(abs(coalesce(s.p, 0) - coalesce(r.p, 0))) as score
  from (select * from share{tag} where model <> 'real') s full join real_by_model{tag} r
    on s.model = r.model and s.column_name = r.column_name and s.value = r.value group by 1, 2),
{correlation_sql(spec, both, tag)},
edges{tag} as (select {edges} from {real}),
coded{tag} as materialized (select model, {', '.join(codes)} from {both}, edges{tag}),
cells{tag} as ({cells}),
cell_share{tag} as (select c.*, n / total as p from cells{tag} c join sizes{tag} using (model)),
real_cells{tag} as (select m.model, r.column_a, r.column_b, r.a, r.b, r.p from cell_share{tag} r, models{tag} m where r.model = 'real'),
contingency{tag} as (
  select coalesce(s.model, r.model) as model, coalesce(s.column_a, r.column_a) as column_a,
    coalesce(s.column_b, r.column_b) as column_b,
    1 - 0.5::double * sum(abs(coalesce(s.p, 0) - coalesce(r.p, 0))) as score
  from (select * from cell_share{tag} where model <> 'real') s full join real_cells{tag} r
    on s.model = r.model and s.column_a = r.column_a and s.column_b = r.column_b and s.a = r.a and s.b = r.b
  group by 1, 2, 3),
overall{tag} as (
  select m.model, marginal, bivariate, (marginal + bivariate) / 2 as overall from models{tag} m
  join (select model, avg(score) as marginal from (select model, score from ks{tag} union all select model, score from tv{tag}) group by model) using (model)
  join (select model, avg(score) as bivariate from (select model, score from corr{tag} union all select model, score from contingency{tag}) group by model) using (model))"""


QUALITY = "with " + quality_sql()


def pools(spark, folder):
    return fx.real_and_candidates(spark, folder, write=True)


@query("i1_ks_complement", SQL(QUALITY + "select model, column_name, round(score, 6) as score from ks"))
def ks_complement(spark, folder) -> DataFrame:
    return fx.rounded(sim.ks_complement(*pools(spark, folder), SPEC))


@query("i2_tv_complement", SQL(QUALITY + "select model, column_name, round(score, 6) as score from tv"))
def tv_complement(spark, folder) -> DataFrame:
    return fx.rounded(sim.tv_complement(*pools(spark, folder), SPEC))


@query("i3_marginal_similarity", SQL(QUALITY + "select model, round(marginal, 6) as marginal from overall"))
def marginal_similarity(spark, folder) -> DataFrame:
    return fx.rounded(sim.marginal_similarity(*pools(spark, folder), SPEC))


@query("i4_correlation_similarity", SQL(f"with {correlation_sql(SPEC, both_sql('real', 'cand'))}" + """
select model, column_a, column_b, round(r, 6) + 0.0 as r, round(r_real, 6) + 0.0 as r_real, round(score, 6) as score from corr"""))
def correlation_similarity(spark, folder) -> DataFrame:
    return fx.rounded(sim.correlation_similarity(*pools(spark, folder), SPEC))


@query("i5_contingency_similarity", SQL(QUALITY + "select model, column_a, column_b, round(score, 6) as score from contingency"))
def contingency_similarity(spark, folder) -> DataFrame:
    return fx.rounded(sim.contingency_similarity(*pools(spark, folder), SPEC))


@query("i6_bivariate_similarity", SQL(QUALITY + "select model, round(bivariate, 6) as bivariate from overall"))
def bivariate_similarity(spark, folder) -> DataFrame:
    return fx.rounded(sim.bivariate_similarity(*pools(spark, folder), SPEC))


LISTED = (*fx.MODELS, "Never sampled")


@query("i7_overall_similarity", SQL(QUALITY + f"""
select m.model, round(coalesce(marginal, 0), 6) as marginal, round(coalesce(bivariate, 0), 6) as bivariate,
  round(coalesce(overall, 0), 6) as overall
from (select unnest({list(LISTED)}) as model) m left join overall using (model)"""))
def overall_similarity(spark, folder) -> DataFrame:
    return fx.rounded(sim.overall_similarity(*pools(spark, folder), SPEC, LISTED))


@query("i8_column_shape_details", SQL(QUALITY + """
select model, column_name, 'KSComplement' as metric, round(score, 6) as score from ks
union all select model, column_name, 'TVComplement', round(score, 6) from tv"""))
def column_shape_details(spark, folder) -> DataFrame:
    return fx.rounded(sim.column_shapes(*pools(spark, folder), SPEC))


@query("i9_data_validity", SQL("with " + quality_sql() + ", inside as (" + " union all ".join(
    f"select model, '{c}' as column_name, 'BoundaryAdherence' as metric, avg(case when {number_sql(c)} is null then null "
    f"when {number_sql(c)} between {c}_min and {c}_max then 1.0 else 0.0 end) as score from cand, edges group by model"
    for c in SPEC.numeric + SPEC.datetime) + """)
select model, column_name, metric, round(score, 6) as score from inside
union all select s.model, s.column_name, 'CategoryAdherence', round(sum(case when r.n is null then 0 else s.n end) / sum(s.n), 6)
from cat s left join (select * from cat where model = 'real') r using (column_name, value) where s.model <> 'real'
group by s.model, s.column_name"""))
def data_validity(spark, folder) -> DataFrame:
    return fx.rounded(sim.data_validity(*pools(spark, folder), SPEC))


@query("i10_data_structure", SQL(" union all ".join(
    f"select '{c}' as column_name, (select count({c}) from real) as known_real, (select count({c}) from cand) as known_candidate, true as same_type"
    for c in fx.ENRICHED)))
def data_structure(spark, folder) -> DataFrame:
    return sim.data_structure(*pools(spark, folder), without=[fx.KEY, "model"])


@query("i11_quality_before_after", SQL("with raw_cand as (select * from enriched_all where model <> 'real'), "
                                       + quality_sql(GEN, "real", "raw_cand", "_gen") + ", " + quality_sql() + """
select model, 'before' as stage, round(marginal, 6) as marginal, round(bivariate, 6) as bivariate, round(overall, 6) as overall from overall_gen
union all select model, 'after', round(marginal, 6), round(bivariate, 6), round(overall, 6) from overall"""))
def quality_before_after(spark, folder) -> DataFrame:
    real, after = pools(spark, folder)
    before = fx.written(fx.candidates_generated(fx.rare_records(spark, folder)))
    return fx.rounded(sim.quality_before_after(real, before, after, GEN, SPEC))


@query("e13_overall_mean", SQL(QUALITY + "select model, round((marginal + bivariate) / 2, 6) as overall from overall"))
def overall_mean(spark, folder) -> DataFrame:
    return fx.rounded(sim.overall_similarity(*pools(spark, folder), SPEC).select("model", "overall"))


# ---------------------------------------------------------------- densities

DISCRETE = ("quarter", "day_of_week", "dep_delta", "taxi_out", "taxi_in", "arr_delta", "sched_elapsed")
CONTINUOUS = fx.SPEC.numeric


def tagged(spark, folder) -> DataFrame:
    real, candidates = pools(spark, folder)
    return real.withColumn("model", F.lit("real")).unionByName(candidates)


def long_sql(columns) -> str:
    return "long as (" + " union all ".join(
        f"select model, '{c}' as feature, cast({c} as double) as value from clean where {c} is not null" for c in columns) + ")"


@query("i12_histogram_density", SQL(f"""with {long_sql(DISCRETE)}, edges as (
  select model, feature, min(value) as low, max(value) as high, count(*) as total from long group by model, feature)
select model, feature, bin, round(any_value(low) + bin * ((any_value(high) - any_value(low)) / 80), 9) as bin_start, count(*) as n,
  round(count(*) / (any_value(total) * ((any_value(high) - any_value(low)) / 80)), 6) as density
from (select l.model, l.feature, low, high, total, cast(least(floor((value - low) / (high - low) * 80), 79) as int) as bin
  from long l join edges e on e.model = l.model and e.feature = l.feature) group by model, feature, bin"""))
def histogram_density(spark, folder) -> DataFrame:
    bins = density.histogram_density(tagged(spark, folder), "model", DISCRETE)
    return fx.rounded(bins.withColumn("bin_start", F.round("bin_start", 9)), without=["bin_start"])


@query("i13_kde_density", SQL(f"""with {long_sql(CONTINUOUS)}, fit as (
  select model, feature, min(value) as low, max(value) as high, count(*) as total,
    stddev_samp(value) * pow(count(*), -0.2) as h from long group by model, feature),
grid as (select model, feature, h, total, unnest(generate_series(0, 199)) as point, low, high from fit)
select g.model, g.feature, cast(point as int) as point,
  round(any_value(low) - 3 * any_value(h) + point * ((any_value(high) - any_value(low) + 6 * any_value(h)) / 199), 6) + 0.0 as x,
  round(sum(exp(-0.5::double * pow((low - 3 * h + point * ((high - low + 6 * h) / 199) - value) / h, 2)))
    / (any_value(total) * any_value(h) * sqrt(2 * pi())), 6) as density
from grid g join long l on l.model = g.model and l.feature = g.feature group by g.model, g.feature, point"""))
def kde_density(spark, folder) -> DataFrame:
    return fx.rounded(density.kde_density(tagged(spark, folder), "model", CONTINUOUS))


# ---------------------------------------------------------------- components

def eigen_sql(matrix: str, n: int, sweeps: int = 9) -> str:
    """Table expressions up to eigenvalues(k, value) and loadings(k, i, part) of the symmetric ``matrix`` (i, j, r), by Jacobi's rotations.

    A step turns one pair of axes (p, q) so that their joint element becomes 0; ``a`` and ``v`` are the matrix and the product of the
    turns as lists of rows. Needs ``with recursive``.
    """
    pairs = [(p, q) for p in range(n) for q in range(p + 1, n)]
    at = lambda m, i, j: f"{m}[({i}) * {n} + ({j}) + 1]"
    turned = lambda m: (f"list_transform(range({n * n}), lambda x: case x % {n} when p then c * {at(m, f'x // {n}', 'p')} - s * {at(m, f'x // {n}', 'q')} "  # noqa: E731
                        f"when q then s * {at(m, f'x // {n}', 'p')} + c * {at(m, f'x // {n}', 'q')} else {m}[x + 1] end)")
    over = (f"list_transform(range({n * n}), lambda x: case x // {n} when p then c * {at('b', 'p', f'x % {n}')} - s * {at('b', 'q', f'x % {n}')} "
            f"when q then s * {at('b', 'p', f'x % {n}')} + c * {at('b', 'q', f'x % {n}')} else b[x + 1] end)")
    return f"""axes as (select {[p for p, _ in pairs]} as ps, {[q for _, q in pairs]} as qs),
turns as (
  select 0 as step, (select list(r order by i, j) from {matrix}) as a,
    list_transform(range({n * n}), lambda x: case when x // {n} = x % {n} then 1.0::double else 0.0::double end) as v
  union all
  select step, {over} as a, v from (
    select step, p, q, c, s, {turned('a')} as b, {turned('v')} as v from (
      select *, t / sqrt(t * t + 1) as s, 1 / sqrt(t * t + 1) as c from (
        select *, case when abs(apq) < 1e-300 then 0.0::double
          else (case when aqq >= app then 1.0::double else -1.0::double end) / (abs((aqq - app) / (2 * apq)) + sqrt(power((aqq - app) / (2 * apq), 2) + 1)) * sign(apq) end as t
        from (select step + 1 as step, a, v, p, q, {at('a', 'p', 'q')} as apq, {at('a', 'p', 'p')} as app, {at('a', 'q', 'q')} as aqq
          from (select step, a, v, ps[step % {len(pairs)} + 1] as p, qs[step % {len(pairs)} + 1] as q from turns, axes where step < {sweeps * len(pairs)})))))),
solved as materialized (select a, v from turns where step = {sweeps * len(pairs)}),
eigenvalues as materialized (select k, {at('a', 'k', 'k')} as value from solved, (select unnest(range({n})) as k)),
loadings as materialized (select k, i, {at('v', 'i', 'k')} as part from solved, (select unnest(range({n})) as k), (select unnest(range({n})) as i))"""


def component_columns(real: DataFrame) -> list[str]:
    """Every numeric column of the table, by type; one that never changes has no direction."""
    return numeric_columns(real, without=[fx.SPEC.label])


def scaled_pools(spark, folder):
    """Scaled real rows and candidates, and the scaled columns."""
    real, candidates = pools(spark, folder)
    columns = component_columns(real)
    return (*diversity.scale_for_components(real.withColumn("model", F.lit("real")), candidates, columns), columns)


#: Numeric columns of the enriched table in its order, without the label (``component_columns`` finds them by type).
COMPONENT_COLUMNS = [c for c in fx.ENRICHED if c in SPEC.numeric or c in ("quarter", "day_of_week", "dep_delay_label", "arr_delay_label")]


def components_sql() -> str:
    """Table expressions up to scaled rows, ratio(component, ratio) and axis(component, i, part): Jacobi's rotations on the covariances."""
    n = len(COMPONENT_COLUMNS)
    zero = ", ".join(f"cast(coalesce({c}, 0) as double) as {c}" for c in COMPONENT_COLUMNS)
    ends = ", ".join(f"min({c}) as {c}_min, max({c}) as {c}_max" for c in COMPONENT_COLUMNS)
    scaled = ", ".join(f"({c} - {c}_min) / (case when {c}_max = {c}_min then 1 else {c}_max - {c}_min end) as {c}" for c in COMPONENT_COLUMNS)
    cells = ", ".join(f"{{'i': {i}, 'j': {j}, 'r': covar_samp({a}, {b})}}" for i, a in enumerate(COMPONENT_COLUMNS) for j, b in enumerate(COMPONENT_COLUMNS))
    means = ", ".join(f"avg({c})" for c in COMPONENT_COLUMNS)
    return f"""zero as (select row_key, model, {zero} from clean), ends as (select {ends} from zero where model = 'real'),
scaled as materialized (select row_key, model, {scaled} from zero, ends),
centre as materialized (select [{means}] as m from scaled where model = 'real'),
matrix as materialized (select cell.i, cell.j, cell.r from (select unnest([{cells}]) as cell from scaled where model = 'real')),
{eigen_sql('matrix', n)},
ratio as materialized (select cast(row_number() over (order by value desc) as integer) as component, k, value / sum(value) over () as ratio from eigenvalues),
axis as materialized (select component, i, part * sign(first_value(part) over (partition by component order by abs(part) desc, i)) as part
  from loadings join ratio using (k)),
axes_of as materialized (select component, list(part order by i) as parts from axis group by component),
projected as (select row_key, model, {', '.join(f"list_sum(list_transform(range({n}), lambda x: (list_value({', '.join(COMPONENT_COLUMNS)})[x + 1] - m[x + 1]) * p{k}[x + 1])) as pc{k}" for k in (1, 2))}
  from scaled, centre, (select (select parts from axes_of where component = 1) as p1, (select parts from axes_of where component = 2) as p2))"""


@query("j1_pca_explained", RECURSIVE(f"""with {components_sql()}
select component, round(ratio, 6) + 0.0 as ratio, round(sum(ratio) over (order by component), 6) as cumulative from ratio"""))
def pca_explained(spark, folder) -> DataFrame:
    real, _, columns = scaled_pools(spark, folder)
    return fx.rounded(diversity.pca_explained(real, columns))


@query("f1_cumulative_variance", RECURSIVE(f"""with {components_sql()}
select component, round(ratio * 100, 6) + 0.0 as ratio, round(sum(ratio * 100) over (order by component), 6) as cumulative from ratio"""))
def cumulative_variance(spark, folder) -> DataFrame:
    real, _, columns = scaled_pools(spark, folder)
    explained = diversity.pca_explained(real, columns)
    return fx.rounded(diversity.cumulative_variance(explained.select("component", (F.col("ratio") * 100).alias("ratio"))))


@query("j2_pca_project", RECURSIVE(f"""with {components_sql()}
select row_key, model, round(pc1, 6) + 0.0 as pc1, round(pc2, 6) + 0.0 as pc2,
  round_even((select ratio from ratio where component = 1) * 100, 1) as pc1_variance_pct,
  round_even((select ratio from ratio where component = 2) * 100, 1) as pc2_variance_pct from projected"""))
def pca_project(spark, folder) -> DataFrame:
    real, candidates, columns = scaled_pools(spark, folder)
    real_points, points = diversity.pca_project(real, [real, candidates], columns, [fx.KEY, "model"])
    return fx.rounded(real_points.unionByName(points))


@query("j3_diversity_by_model", RECURSIVE(f"""with {components_sql()}
select model, count(*) as rows, round(avg(pc1), 6) + 0.0 as pc1_mean, round(stddev_pop(pc1), 6) as pc1_std,
  round(avg(pc2), 6) + 0.0 as pc2_mean, round(stddev_pop(pc2), 6) as pc2_std from projected group by model"""))
def diversity_by_model(spark, folder) -> DataFrame:
    """Centre and spread of every model on the first two real components."""
    real, candidates, columns = scaled_pools(spark, folder)
    real_points, others = diversity.pca_project(real, [real, candidates], columns, [fx.KEY, "model"])
    return fx.rounded(real_points.unionByName(others).groupBy("model").agg(
        F.count("*").alias("rows"), *[f(c).alias(f"{c}_{n}") for c in ("pc1", "pc2")
                                      for n, f in (("mean", F.avg), ("std", F.stddev_pop))]))


# ---------------------------------------------------------------- operational attributes

@query("j4_operational_scatter", SQL("select model, distance, air_time from clean"))
def operational_scatter(spark, folder) -> DataFrame:
    return diversity.operational_points(*pools(spark, folder), "model", "distance", "air_time")


@query("j5_operational_corr", SQL("""
select model, count(*) as rows, round(corr(distance, air_time), 6) + 0.0 as correlation,
  round(regr_slope(air_time, distance), 6) + 0.0 as slope,
  round(abs(corr(distance, air_time) - (select corr(distance, air_time) from real)), 6) as gap_to_real
from clean group by model"""))
def operational_corr(spark, folder) -> DataFrame:
    points = operational_scatter(spark, folder)
    return fx.rounded(diversity.operational_corr(points, "model", "distance", "air_time"))
