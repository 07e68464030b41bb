import numpy as np
import pytest
from pyspark.sql import functions as F

from recordaudit.operators import density, diversity, similarity as sim
from recordaudit.sources.schema import Spec

SPEC = Spec(key="k", model="model", label="y", categorical=("c", "y"), numeric=("a", "b"), datetime=())


def table(spark, rows, model=None):
    frame = spark.createDataFrame([(f"k{i}", *r) for i, r in enumerate(rows)],
                                  "k string, a double, b double, c string, y int")
    return frame.withColumn("model", F.lit(model)) if model else frame


def rows(seed, n, shift=0.0):
    rng = np.random.default_rng(seed)
    a = (rng.normal(shift, 1, n)).round(1)
    out = []
    for i in range(n):
        out.append((None if i % 17 == 0 else float(a[i]), float(a[i] * 2 + rng.normal()), None if i % 13 == 0 else "xyz"[rng.integers(3)],
                    int(rng.integers(2))))
    return out


@pytest.fixture(scope="module")
def real(spark):
    return table(spark, rows(1, 120))


@pytest.fixture(scope="module")
def candidates(spark):
    odd = [(9.0, -3.0, "new", 1)] * 40  # a hot copy in a third of the rows
    return table(spark, rows(2, 80, 0.5), "one").unionByName(table(spark, rows(3, 80) + odd, "two"))


def test_a_table_is_perfectly_similar_to_itself(spark, real):
    itself = real.withColumn("model", F.lit("self"))
    shapes = sim.column_shapes(real, itself, SPEC).collect()
    assert len(shapes) == 4 and all(r.score == pytest.approx(1) for r in shapes)
    trends = sim.column_pair_trends(real, itself, SPEC).collect()
    assert len(trends) == 6 and all(r.score == pytest.approx(1) for r in trends)
    assert all(r.score == 1 for r in sim.data_validity(real, itself, SPEC).collect())
    assert sim.overall_similarity(real, itself, SPEC).first().overall == pytest.approx(1)


def test_scores_stay_in_bounds_and_ignore_row_order(spark, real, candidates):
    first = sim.overall_similarity(real, candidates, SPEC).collect()
    second = sim.overall_similarity(real.repartition(5), candidates.orderBy("a"), SPEC).collect()
    assert {r.model: round(r.overall, 9) for r in first} == {r.model: round(r.overall, 9) for r in second}
    assert all(0 <= r[c] <= 1 for r in first for c in ("marginal", "bivariate", "overall"))


def test_ks_matches_a_direct_count(spark, real, candidates):
    got = {(r.model, r.column_name): r.score for r in sim.ks_complement(real, candidates, SPEC).collect()}
    for model in ("one", "two"):
        for c in ("a", "b"):
            x = np.array([r[c] for r in real.collect() if r[c] is not None])
            y = np.array([r[c] for r in candidates.where(F.col("model") == model).collect() if r[c] is not None])
            grid = np.concatenate([x, y])
            gap = max(abs((x <= v).mean() - (y <= v).mean()) for v in grid)
            assert got[(model, c)] == pytest.approx(1 - gap)


def shares(values):
    return {v: values.count(v) / len(values) for v in set(values)}


def test_tv_counts_unknown_as_a_category(spark, real, candidates):
    got = {(r.model, r.column_name): r.score for r in sim.tv_complement(real, candidates, SPEC).collect()}
    for model in ("one", "two"):
        p = shares([r.c for r in real.collect()])
        q = shares([r.c for r in candidates.where(F.col("model") == model).collect()])
        expected = 1 - sum(abs(p.get(v, 0) - q.get(v, 0)) for v in p.keys() | q.keys()) / 2
        assert got[(model, "c")] == pytest.approx(expected)


def test_correlation_similarity(spark, real, candidates):
    r = sim.correlation_similarity(real, candidates, SPEC).where("model = 'one'").first()

    def corr(frame):
        pairs = [(x.a, x.b) for x in frame.collect() if x.a is not None and x.b is not None]
        return np.corrcoef(np.array(pairs).T)[0, 1]

    expected = 1 - abs(corr(real) - corr(candidates.where("model = 'one'"))) / 2
    assert r.score == pytest.approx(expected)


def test_contingency_bins_numbers_on_the_real_range(spark, real, candidates):
    got = {(r.model, r.column_a, r.column_b): r.score for r in sim.contingency_similarity(real, candidates, SPEC).collect()}
    known = [r.a for r in real.collect() if r.a is not None]
    edges = np.linspace(min(known), max(known), 11)

    def cells(frame):
        return shares([(r.c, None if r.a is None else int(np.digitize(r.a, edges))) for r in frame.collect()])

    p = cells(real)
    q = cells(candidates.where("model = 'two'"))
    expected = 1 - sum(abs(p.get(v, 0) - q.get(v, 0)) for v in p.keys() | q.keys()) / 2
    assert got[("two", "c", "a")] == pytest.approx(expected, abs=0.02)  # a value on an edge may fall either way


def test_validity_and_structure(spark, real, candidates):
    got = {(r.model, r.column_name): r.score for r in sim.data_validity(real, candidates, SPEC).collect()}
    assert got[("two", "c")] == pytest.approx(80 / 120)
    assert got[("two", "a")] < 1
    structure = {r.column_name: r for r in sim.data_structure(real, candidates.withColumn("y", F.col("y").cast("long")),
                                                             without=["model", "k"]).collect()}
    assert structure["a"].same_type and not structure["y"].same_type


def test_model_without_rows_scores_zero(spark, real, candidates):
    scored = sim.overall_similarity(real, candidates, SPEC, ["one", "never"]).collect()
    assert {r.model for r in scored} == {"one", "never"}
    assert next(r.overall for r in scored if r.model == "never") == 0


def test_histogram_adds_up_to_one(spark, real):
    bins = density.histogram_density(real.withColumn("model", F.lit("m")), "model", ["b"]).collect()
    values = [r.b for r in real.collect()]
    width = (max(values) - min(values)) / 80
    assert sum(r.density for r in bins) * width == pytest.approx(1)
    expected = np.histogram(values, 80)[0]
    assert {r.bin: r.n for r in bins} == {i: n for i, n in enumerate(expected) if n}


def test_kernel_density_matches_the_formula(spark, real):
    curve = sorted(density.kde_density(real.withColumn("model", F.lit("m")), "model", ["b"]).collect(), key=lambda r: r.point)
    values = np.array([r.b for r in real.collect()])
    h = values.std(ddof=1) * len(values) ** -0.2
    for r in (curve[0], curve[77], curve[199]):
        expected = np.exp(-0.5 * ((r.x - values) / h) ** 2).sum() / (len(values) * h * np.sqrt(2 * np.pi))
        assert r.density == pytest.approx(expected)
    assert curve[0].x == pytest.approx(values.min() - 3 * h) and curve[199].x == pytest.approx(values.max() + 3 * h)


def test_components_match_numpy(spark, real, candidates):
    columns = ["a", "b"]
    ours, theirs = diversity.scale_for_components(real, candidates, columns)
    x = np.array([(r.a, r.b) for r in ours.collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(values)[::-1]
    explained = sorted(diversity.pca_explained(ours, columns).collect(), key=lambda r: r.component)
    assert [r.ratio for r in explained] == pytest.approx(list(values[order] / values.sum()))
    assert explained[-1].cumulative == pytest.approx(1)
    projected = diversity.pca_project(ours, [ours, theirs], columns, ["k"])[0].collect()
    axis = vectors[:, order[0]] * np.sign(vectors[np.abs(vectors[:, order[0]]).argmax(), order[0]])
    expected = (x - x.mean(axis=0)) @ axis
    assert sorted(r.pc1 for r in projected) == pytest.approx(sorted(expected))
    assert np.mean([r.pc1 for r in projected]) == pytest.approx(0, abs=1e-9)


def test_operational_gap_of_real_is_zero(spark, real, candidates):
    points = diversity.operational_points(real, candidates, "model", "a", "b")
    got = {r.model: r for r in diversity.operational_corr(points, "model", "a", "b").collect()}
    assert got["real"].gap_to_real == 0 and len(got) == 3
