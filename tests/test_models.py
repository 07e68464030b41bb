import numpy as np
import pytest
from pyspark.sql import functions as F

from recordaudit.functions import normal
from recordaudit.operators import copula as co, forest as fo, kernel, memorization, metrics, selection as sel, trend
from recordaudit.plans import reports
from recordaudit.sources import schema, tables
from recordaudit.sources.schema import Spec

SMALL = fo.Forest(trees=10, seed=45, batch=4)


def scored(spark):
    """Four hits, one false alarm, two misses, three right rejections; scores tie on purpose."""
    rows = [("m", 1, 1, 0.9), ("m", 1, 1, 0.9), ("m", 1, 1, 0.8), ("m", 0, 1, 0.8), ("m", 1, 1, 0.7),
            ("m", 1, 0, 0.4), ("m", 0, 0, 0.4), ("m", 0, 0, 0.3), ("m", 1, 0, 0.2), ("m", 0, 0, 0.1), ("n", 0, 0, 0.5)]
    return spark.createDataFrame(rows, "model string, label int, prediction int, score double")


def test_hand_computed_metrics(spark):
    counts = metrics.confusion_counts(scored(spark), ["model"])
    m = counts.where("model = 'm'").select(
        "tp", "fp", "fn", "tn", metrics.f1().alias("f1"), metrics.balanced_accuracy().alias("ba"), metrics.mcc().alias("mcc")).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (4, 1, 2, 3)
    assert m.f1 == pytest.approx(8 / 11) and m.ba == pytest.approx((4 / 6 + 3 / 4) / 2)
    assert m.mcc == pytest.approx((4 * 3 - 1 * 2) / np.sqrt(5 * 6 * 4 * 5))
    n = counts.where("model = 'n'").select(metrics.f1().alias("f1"), metrics.mcc().alias("mcc")).first()
    assert n.f1 == 0 and n.mcc == 0  # empty margins
    matrix = {r.label: (r.predicted_0, r.predicted_1) for r in metrics.confusion_matrix(scored(spark), ["model"]).where("model = 'm'").collect()}
    assert matrix == {1: (2, 4), 0: (3, 1)}
    report = {r["class"]: r for r in metrics.classification_report(counts, ["model"]).where("model = 'm'").collect()}
    assert report["1"].precision == 0.8 and report["0"].recall == 0.75 and report["accuracy"].f1 == 0.7
    assert report["weighted avg"].support == 10


def test_average_precision_with_ties(spark):
    got = {r.model: r.average_precision for r in metrics.average_precision(scored(spark), "model").collect()}
    rows = scored(spark).where("model = 'm'").collect()
    expected, seen = 0.0, 0.0
    for cut in sorted({r.score for r in rows}, reverse=True):
        above = [r.label for r in rows if r.score >= cut]
        recall = sum(above) / 6
        expected += (recall - seen) * sum(above) / len(above)
        seen = recall
    assert got["m"] == pytest.approx(expected) and got["n"] == 0


def points(spark, n, centre, prefix, model=None):
    rng = np.random.default_rng(len(prefix) + n)
    frame = spark.createDataFrame([(f"{prefix}{i}", *map(float, rng.normal(centre, 1, 3))) for i in range(n)],
                                  "k string, a double, b double, c double")
    return frame.withColumn("model", F.lit(model)) if model else frame


def test_forests_tell_far_candidates_but_not_equal_ones(spark):
    real = points(spark, 150, 0, "r")
    near = points(spark, 150, 0, "near", "near")
    both = near.unionByName(points(spark, 140, 8, "far", "far"))
    got = {r.model: r for r in fo.fidelity_cv(real, both, "k", "model", ["a", "b", "c"], SMALL, folds=3).collect()}
    assert got["far"].f1 > 0.98 and got["far"].balanced_accuracy > 0.98
    assert 0.3 < got["near"].balanced_accuracy < 0.7
    score = {r.model: r.fidelity for r in fo.fidelity_score(
        real, both, "k", "model", ["a", "b", "c"], ["far", "none"], SMALL, folds=3).collect()}
    assert score["none"] == 0 and score["far"] == pytest.approx(1 - got["far"].f1)
    holdout = fo.fidelity_holdout(real, both, "k", "model", ["a", "b", "c"], SMALL, ["far"])
    assert holdout.count() == 290 - (105 + 98)
    with pytest.raises(ValueError, match="accuracy"):
        fo.fidelity_score(real, both, "k", "model", ["a"], ["far"], SMALL, metric="accuracy")


def test_utility_with_and_without_candidates(spark):
    real = points(spark, 160, 0, "z").withColumn("y", F.lit(0)).unionByName(points(spark, 24, 3, "one").withColumn("y", F.lit(1)))
    cand = points(spark, 40, 3, "cand", "m").withColumn("y", F.lit(1))
    got = {(r.model, r.size): r for r in fo.utility(real, cand, "k", "model", "y", ["a", "b", "c"], SMALL, sizes=(10, 40)).collect()}
    assert set(got) == {("TRTR", None), ("m", 10), ("m", 40)}
    assert got[("m", 10)].rows_added == 10
    assert all(r.pr_auc > 0.8 and 0.5 < r.normalised_mcc <= 1 for r in got.values())
    table = reports.utility_report(spark.createDataFrame(list(got.values())))
    assert table.count() == 2 and "overall_gain" in table.columns
    assert fo.class_balance_point(real, "y").first()[0] == 136
    score = fo.utility_score(real, cand, "k", "model", "y", ["a", "b", "c"], ["gone"], SMALL)
    assert score.first().utility == 0


def test_copies_are_flagged(spark):
    real = points(spark, 60, 0, "r")
    copies = real.withColumn("model", F.lit("copy"))
    fresh = points(spark, 50, 0, "fresh", "new")
    ours, theirs = memorization.scaled_features(real, copies.unionByName(fresh), "k", ["a", "b", "c"])
    dcr = memorization.nearest_real(ours, theirs, "k", ["a", "b", "c"])
    stats = memorization.dcr_ratio(memorization.dcr_stats(dcr), memorization.nearest_other_real(ours, "k", ["a", "b", "c"]))
    got = {r.model: r for r in stats.collect()}
    assert got["copy"].mean_dcr == 0 and got["copy"].copies_pct == 100 and got["copy"].suspected
    assert got["new"].mean_dcr > 0 and got["new"].copies == 0
    assert got["new"].median_dcr == pytest.approx(np.median([r.dcr for r in dcr.where("model = 'new'").collect()]))


def trials(spark):
    rng = np.random.default_rng(2)
    rows = [("s", i, round(rng.random(), 1), round(rng.random(), 1), None if i % 5 == 0 else round(rng.random(), 2))
            for i in range(60)]
    return spark.createDataFrame(rows, "study string, trial int, a double, b double, value double")


def test_pareto_front_matches_pairwise_dominance(spark):
    rows = trials(spark).collect()
    expected = {r.trial for r in rows if not any(
        o.a >= r.a and o.b >= r.b and (o.a > r.a or o.b > r.b) for o in rows)}
    front = {r.trial for r in sel.pareto_front(trials(spark), "study", "trial", "a", "b").collect()}
    assert front == expected


def test_running_best_and_best_trial(spark):
    rows = sorted((r for r in trials(spark).collect() if r.value is not None), key=lambda r: r.trial)
    got = {r.trial: r.best_so_far for r in sel.running_best(trials(spark), "study", "trial").collect()}
    assert got == {r.trial: max(o.value for o in rows if o.trial <= r.trial) for r in rows}
    best = sel.best_trial(trials(spark), "study", "trial").first()
    assert best.value == max(r.value for r in rows)
    assert sel.study_summary(trials(spark), "study", "trial", ["a"]).first().n_trials == 60


def test_weight_schemes_and_missing_scores(spark):
    rows = [("s", 1, 0.5, 1.0, None, 0.0, 0.2), ("s", 2, 0.5, 0.0, 0.0, 0.0, 1.0), ("s", 3, None, 1.0, 1.0, 1.0, 1.0),
            ("s", 4, 0.5, 0.0, 0.0, 0.0, 1.0)]
    log = spark.createDataFrame(rows, "study string, trial int, value double, realism double, overall_sim double, fidelity double, utility double")
    done = tables.scan_trials(log)
    assert {r.trial for r in done.collect()} == {1, 2, 4} and done.where("trial = 1").first().overall_sim == 0
    best = {r.scheme: r for r in sel.weight_sensitivity(done, "study", "trial").collect()}
    assert len(best) == 5
    assert best["Utility-heavy"].trial == 2 and best["Utility-heavy"].composite == 0.7  # first of the tie
    assert best["Realism-heavy"].trial == 1 and best["Realism-heavy"].composite == 0.72


def test_lowess_keeps_lines_and_resists_outliers(spark):
    x = np.arange(26.0)
    assert trend.lowess(x, 3 * x + 1) == pytest.approx(3 * x + 1)
    y = 3 * x + 1 + np.random.default_rng(4).normal(0, 1, 26)
    y[12] += 30
    plain, robust = trend.lowess(x, y, 0.6, passes=0), trend.lowess(x, y, 0.6)
    assert abs(robust[12] - 37) < 1.5 < abs(plain[12] - 37)
    results = spark.createDataFrame([("m", float(v), 2 * float(v)) for v in x], ["model", "size", "score"])
    got = trend.lowess_trend(results, "model", "size", "score").collect()
    assert all(r.trend == pytest.approx(r.score, abs=1e-6) for r in got)


SPEC = Spec(key="k", model="model", label="y", categorical=("c",), numeric=("a", "b"), datetime=("t",))


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(9)
    a = rng.gamma(2, 3, 800)
    frame = spark.createDataFrame(
        [(f"k{i}", float(a[i]), None if i % 10 == 0 else float(2 * a[i] + rng.normal()), "xxxxxyyz"[rng.integers(8)], 86400 * int(rng.integers(365)))
         for i in range(800)], "k string, a double, b double, c string, s long").withColumn(
        "t", F.timestamp_seconds("s")).drop("s")
    return frame, co.copula_fit(frame, SPEC, 45)


def test_copula_keeps_marginals_and_dependence(spark, fitted):
    real, copula = fitted
    drawn = co.copula_sample(spark, copula, 2000, 45)
    assert [f.dataType for f in drawn.select("c", "a", "b", "t").schema] == [f.dataType for f in real.select("c", "a", "b", "t").schema]
    rows = drawn.collect()
    assert len(rows) == 2000 and len({r.k for r in rows}) == 2000
    a = np.array([r.a for r in rows])
    own = np.array([r.a for r in real.collect()])
    assert a.min() < own.min() or a.max() > own.max()  # a kernel reaches beyond the known values
    held = np.array([r.a for r in co.copula_sample(spark, copula, 2000, 45, within_range=True).collect()])
    assert held.min() >= own.min() and held.max() <= own.max()
    assert np.median(a) == pytest.approx(np.median(own), rel=0.1)
    known = [(r.a, r.b) for r in rows if r.b is not None]
    assert np.corrcoef(np.array(known).T)[0, 1] > 0.9
    assert 1 - len(known) / 2000 == pytest.approx(0.1, abs=0.03)
    share = sum(r.c == "x" for r in rows) / 2000
    assert share == pytest.approx(real.where("c = 'x'").count() / 800, abs=0.05)


def test_kernel_marginal_equals_a_kernel_on_every_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    skewed = np.concatenate([rng.lognormal(0, 1.5, 700), [400.0] * 200])  # far apart, with a hot value
    frame = spark.createDataFrame([(float(v), 7.0, None if i % 3 else float(i)) for i, v in enumerate(skewed)], "a double, same double, some double").repartition(5)
    h = skewed.std(ddof=1) * len(skewed) ** -0.2
    at = np.linspace(skewed.min() - 3 * h, skewed.max() + 3 * h, 301)
    exact = normal.normal_cdf((at[:, None] - skewed) / h).mean(axis=1)
    found = kernel.kernel_marginals(frame, ["a", "same", "some"])
    assert found["a"].bandwidth == pytest.approx(h) and np.abs(found["a"].cdf(at) - exact).max() < 2e-3
    shares = np.linspace(0.02, 0.98, 49)
    assert np.abs(found["a"].cdf(found["a"].inverse(shares)) - shares).max() < 1e-9
    assert found["same"].inverse(shares).tolist() == [7.0] * 49
    assert found["some"].low == 0 and found["some"].high == 897
    monkeypatch.setattr(kernel, "MAX_BINS", 3)  # bins merged in pairs
    coarse = kernel.kernel_marginals(frame, ["a"])["a"]
    assert coarse.step > found["a"].step and np.abs(coarse.cdf(at) - exact).max() < 0.2
    assert kernel.kernel_marginals(frame.limit(0), ["a"]) == {} and kernel.kernel_marginals(frame, []) == {}


def test_large_dictionaries_are_joined(spark, fitted, monkeypatch):
    real, copula = fitted
    small = sorted(tuple(r) for r in co.copula_sample(spark, copula, 200, 45).collect())
    monkeypatch.setattr(co, "SHIPPED_BYTES", 0)
    assert sorted(tuple(r) for r in co.copula_sample(spark, copula, 200, 45).collect()) == small
    assert np.allclose(co.copula_fit(real, SPEC, 45).correlation, copula.correlation, atol=1e-12)


def test_copula_prefix_and_repeatability(spark, fitted):
    _, copula = fitted
    large = {tuple(r) for r in co.copula_sample(spark, copula, 300, 45).collect()}
    small = {tuple(r) for r in co.copula_sample(spark, copula, 100, 45).collect()}
    assert small < large
    sizes = co.multi_size_sample(spark, copula, [100, 300], 45).groupBy("size").count().collect()
    assert {r["size"]: r["count"] for r in sizes} == {100: 100, 300: 300}


def test_metadata_document(spark, tmp_path):
    path = tmp_path / "meta.json"
    path.write_text('{"tables": {"t": {"columns": {"a": {"sdtype": "numerical"}, "c": {"sdtype": "categorical"},'
                    ' "w": {"sdtype": "datetime"}, "town": {"sdtype": "city", "pii": false}}}}, "relationships": []}')
    registry = schema.read_metadata(spark, str(path))
    spec = schema.spec_from_metadata(registry, "k", "model", "y")
    assert (spec.numeric, spec.categorical, spec.datetime, spec.location) == (("a",), ("c",), ("w",), ("town",))
    tagged = schema.tag_schema(spark.createDataFrame([(1.0, "x")], ["a", "town"]), spec)
    assert tagged.schema["town"].metadata == {"sdtype": "location", "exclude_from_quality": True}


def test_variants_are_pruned_and_unknown_names_raise(spark, tmp_path):
    rows = spark.createDataFrame([("GC", "default", 300, 1), ("TVAE", "optimal", 500, 2)], "model string, state string, size int, x int")
    tables.sink_table(rows, str(tmp_path / "v"))
    found = tables.scan_variants(spark, str(tmp_path / "v"), models=["TVAE"], sizes=[500])
    assert [r.x for r in found.collect()] == [2]
    assert "PartitionFilters: [" in found._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="VAE9"):
        tables.scan_variants(spark, str(tmp_path / "v"), models=["VAE9"])


def test_baseline_row_is_split_off(spark):
    rows = spark.createDataFrame([("TRTR", None, 0.5), ("TRTR", None, 0.5), ("GC", 300, 0.6)], "model string, size int, pr_auc double")
    got = reports.split_baseline(rows, ["pr_auc"]).collect()
    assert [(r.model, r.pr_auc_trtr) for r in got] == [("GC", 0.5)]
    with pytest.raises(ValueError):
        reports.split_baseline(rows.where("model = 'GC'"), ["pr_auc"])
