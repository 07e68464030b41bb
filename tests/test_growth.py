"""Work that has to follow the input: distances per search, readings of the records, aggregates that Spark can compile."""

import numpy as np
import pytest

from recordaudit.operators import memorization, neighbours, similarity as sim
from recordaudit.sources.schema import Spec

SPEC = Spec(key="k", model="model", label="y", categorical=("y",), numeric=tuple(f"x{i}" for i in range(7)), datetime=())


def plain(queries, points, k, own):
    """(query, point, distance) of the k closest, from all pairs."""
    found = []
    for i, q in enumerate(queries):
        square = np.zeros(len(points))
        for axis in range(points.shape[1]):
            square += (q[axis] - points[:, axis]) ** 2
        distance = np.round(np.sqrt(square), neighbours.DIGITS)
        order = [p for p in np.lexsort((np.arange(len(points)), distance)) if own is None or p != own[i]][:k]
        found += [(i, p, distance[p]) for p in order]
    return found


@pytest.mark.parametrize("digits, scale, off", [(None, 1, 0), (0, 1, 0), (1, 1, 1e6), (None, 1e6, 1e9), (None, 1e-8, 0)])
def test_bounds_lose_no_answer(digits, scale, off):
    rng = np.random.default_rng(3)
    points, queries = rng.normal(size=(300, 3)) * scale + off, rng.normal(size=(200, 3)) * scale + off
    if digits is not None:  # many ties
        points, queries = points.round(digits), queries.round(digits)
    queries[:60] = points[:60]  # copies
    for own in (None, np.where(np.arange(200) < 60, np.arange(200), -1)):
        for k in (1, 4):
            found = [*zip(*(part.tolist() for part in neighbours._closest(queries, points, k, own)))]
            assert found == plain(queries, points, k, own)


def test_few_distances_are_computed_term_by_term(monkeypatch):
    seen, exact = [], neighbours._distances
    monkeypatch.setattr(neighbours, "_distances", lambda q, p: (seen.append(len(q)), exact(q, p))[1])
    rng = np.random.default_rng(4)
    neighbours._closest(rng.normal(size=(500, 6)), rng.normal(size=(2000, 6)), 2, None)
    assert 1000 <= sum(seen) < 1100  # two answers a query, of a million pairs


def records(spark, seed, model=None):
    rng = np.random.default_rng(seed)
    rows = [(f"k{i}", *[None if rng.random() < 0.1 else float(v) for v in rng.normal(size=7).round(1)], int(rng.integers(2))) for i in range(150)]
    frame = spark.createDataFrame(rows, "k string, " + ", ".join(f"x{i} double" for i in range(7)) + ", y int")
    return frame if model is None else frame.selectExpr("*", f"'{model}' as model")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ks_starts_from_counts_that_are_written_once(spark):
    scores = sim.ks_complement(records(spark, 1), records(spark, 2, "m"), SPEC)
    assert "ExistingRDD" not in plan(scores)  # no branch of the plan reads records again
    real, other = ([[r[f"x{i}"] for r in records(spark, s).collect() if r[f"x{i}"] is not None] for i in range(7)] for s in (1, 2))
    for row in scores.collect():
        a, b = real[int(row.column_name[1:])], other[int(row.column_name[1:])]
        steps = sorted({*a, *b})
        gap = max(abs(np.mean(np.array(a) <= v) - np.mean(np.array(b) <= v)) for v in steps)
        assert row.score == pytest.approx(1 - gap)


def test_correlation_of_many_pairs_is_compiled(spark):
    real, other = records(spark, 1), records(spark, 2, "m")
    scores = sim.correlation_similarity(real, other, SPEC)
    scores.collect()
    lines = [line for line in plan(scores).split("Initial Plan")[0].splitlines() if "HashAggregate(" in line and "corr" in line]
    assert lines and all("*(" in line for line in lines)  # 21 pairs in one row have too many fields
    own = {s: t.toPandas()[[f"x{i}" for i in range(7)]].astype(float).corr() for s, t in (("real", real), ("m", other))}
    found = scores.collect()
    assert len(found) == 21
    for row in found:
        assert row.r == pytest.approx(own["m"].loc[row.column_a, row.column_b])
        assert row.r_real == pytest.approx(own["real"].loc[row.column_a, row.column_b])


def boxed(spark, monkeypatch, points):
    """An index over ``points`` with groups of 20 rows, and the points as queries in their boxes."""
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 20)
    frame = spark.createDataFrame([(f"p{i:03}", *map(float, p)) for i, p in enumerate(points)], "k string, a double, b double")
    index = neighbours.box_index(frame, "k", ["a", "b"], keep=2)
    return index, neighbours._with_box(frame, "k", ["a", "b"], index.tree, index.trees)


def all_pairs(points, k):
    found = plain(points, points, k, np.arange(len(points)))
    return sorted((f"p{i:03}", f"p{p:03}", d) for i, p, d in found)


def test_a_box_somewhat_over_its_share_is_one_group(spark, monkeypatch):
    points = np.random.default_rng(5).normal(size=(39, 2))
    index, asked = boxed(spark, monkeypatch, points)
    plan_rows = []
    monkeypatch.setattr(neighbours, "written", lambda df, exact=neighbours.written: (lambda t: (plan_rows.append(t), t)[1])(exact(df)))
    neighbours._at_home(asked, index, 1, True)
    plan = next(t for t in plan_rows if "repeats" in t.columns).collect()
    assert plan and all(r.repeats == 1 and r.chunks == 1 for r in plan)


def test_boxes_in_chunks_give_the_answers_of_all_pairs(spark, monkeypatch):
    points = np.random.default_rng(6).normal(size=(150, 2)).round(1)  # ties and copies
    index, asked = boxed(spark, monkeypatch, points)
    monkeypatch.setattr(neighbours, "GROUP_SLACK", 0.25)  # every box has chunks and repeats
    frame = asked.select("k", "a", "b")
    found = neighbours.nearest(frame, index, "k", ["a", "b"], 1, exclude_self=True)
    got = sorted((r.k, r.distance) for r in found.collect())
    assert got == [(k, d) for k, _, d in all_pairs(points, 1)]


def test_other_boxes_give_only_what_is_within_reach(spark, monkeypatch):
    points = np.random.default_rng(7).normal(size=(200, 2))
    index, placed = boxed(spark, monkeypatch, points)
    home = neighbours.written(neighbours._at_home(placed, index, 1, True))
    assert home.count() == 200  # a row per query, with its features, so that nothing is joined back
    reach = {r.k: r.reach for r in home.collect()}
    asked = neighbours._elsewhere(home.drop("best"), index)
    improved = neighbours._improved(neighbours.written(asked), index, 1, True).collect()
    assert all(r.distance <= reach[r.k] for r in improved)
    assert len(improved) < asked.count() / 2
    best = {r.k: r.best[0].distance for r in home.collect() if r.best}
    for r in improved:
        best[r.k] = min(best.get(r.k, np.inf), r.distance)
    assert sorted(best.items()) == [(k, d) for k, _, d in all_pairs(points, 1)]


def test_queries_in_a_box_without_points_are_answered(spark, monkeypatch):
    index, _ = boxed(spark, monkeypatch, np.random.default_rng(8).normal(size=(100, 2)))
    gone = index.placed.where("region <> 0")
    index.placed, index.edges = gone, index.edges.where("region <> 0")
    inside = neighbours.written(neighbours._with_box(
        spark.createDataFrame([(f"q{i}", x, y) for i, (x, y) in enumerate(np.random.default_rng(9).normal(size=(60, 2)).tolist())],
                              "k string, a double, b double"), "k", ["a", "b"], index.tree, None))
    assert inside.where("region = 0").count()
    points = {r.k: (r.a, r.b) for r in gone.collect()}
    found = {r.k: r.distance for r in neighbours.nearest(inside.select("k", "a", "b"), index, "k", ["a", "b"]).collect()}
    nearest = {r.k: min(float(np.hypot(r.a - a, r.b - b)) for a, b in points.values()) for r in inside.collect()}
    assert found == pytest.approx(nearest, abs=1e-8)


def test_ratio_is_given_where_every_real_row_has_a_copy(spark):
    stats = spark.createDataFrame([("copies", 0.0), ("new", 0.5)], "model string, mean_dcr double")
    real = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "k string, dcr double")
    got = {r.model: r for r in memorization.dcr_ratio(stats, real).collect()}
    assert np.isnan(got["copies"].dcr_ratio) and got["new"].dcr_ratio == np.inf
    assert not got["copies"].suspected and not got["new"].suspected
