import numpy as np
import pytest
from pyspark.sql import functions as F

from recordaudit.operators import neighbours, ranges, smote as sm, split


@pytest.fixture(scope="module")
def skewed(spark):
    """One value holds a third of the rows, one part holds most of them."""
    rng = np.random.default_rng(1)
    rows = [("big", 7.0)] * 300 + [("big", float(v)) for v in rng.lognormal(2, 2, 600).round(3)]
    rows += [("small", float(v)) for v in rng.integers(0, 5, 11)] + [("big", None)]
    return spark.createDataFrame(rows, "part string, v double")


def test_exact_quantiles_match_numpy(spark, skewed):
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {(r.part, r.share): r.v for r in ranges.exact_quantiles(skewed, "part", "v", shares).collect()}
    for part in ("big", "small"):
        values = [r.v for r in skewed.where((F.col("part") == part) & F.col("v").isNotNull()).collect()]
        for share in shares:
            assert got[(part, share)] == pytest.approx(np.quantile(values, share))


def test_running_sum_and_max(spark, skewed):
    counts = skewed.where("v is not null").groupBy("part", "v").agg(F.count("*").alias("n"))
    ranged = ranges.with_range(counts, "part", "v", ranges.numeric_bounds(skewed, "part", "v"))
    assert ranged.select(ranges.RANGE).distinct().count() > 4
    rows = ranges.running(ranged, ["part"], ["v"], {"upto": "n"}, totals={"all": "n"}).collect()
    for r in rows:
        expected = sum(o.n for o in rows if o.part == r.part and o.v <= r.v)
        assert r.upto == expected
        assert r["all"] == sum(o.n for o in rows if o.part == r.part)
    tops = ranges.running(ranged, ["part"], ["v"], {"top": "n"}, how="max", before=True).collect()
    for r in tops:
        earlier = [o.n for o in tops if o.part == r.part and o.v < r.v]
        assert r.top == (max(earlier) if earlier else None)


def labelled(spark, zeros=700, ones=33):
    rows = [(f"k{i}", 0 if i < zeros else 1) for i in range(zeros + ones)]
    return spark.createDataFrame(rows, ["k", "y"])


def test_hash_rank_is_a_numbering_and_ignores_partitioning(spark):
    first = split.stratified_kfold(labelled(spark), ["y"], "k", 45)
    second = split.stratified_kfold(labelled(spark).repartition(7, "k"), ["y"], "k", 45)
    assert set(first.collect()) == set(second.select(*first.columns).collect())
    ranked = ranges.hash_rank(labelled(spark), ["y"], "k", 45)
    for label, n in ((0, 700), (1, 33)):
        rows = ranked.where(F.col("y") == label).collect()
        assert sorted(r.hash_rank for r in rows) == list(range(n)) and {r.group_size for r in rows} == {n}


def test_folds_are_balanced_and_split_keeps_shares(spark):
    folds = split.stratified_kfold(labelled(spark), ["y"], "k", 45).groupBy("y", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r.y == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    parts = split.stratified_split(labelled(spark), "y", "k", 45).where("is_train").groupBy("y").count().collect()
    assert {r.y: r["count"] for r in parts} == {0: 489, 1: 23}  # floor(0.7 n) in floating point


@pytest.mark.parametrize("few", [1, 20, 10_000])
def test_split_without_shuffle_equals_the_ranking(spark, monkeypatch, few):
    monkeypatch.setattr(ranges, "FEW_ROWS", few)
    monkeypatch.setattr(ranges, "SLOT_BITS", 3)
    ranked = ranges.hash_rank(labelled(spark), ["y"], "k", 45).collect()
    expected = {r.k for r in ranked if r.hash_rank < np.floor(r.group_size * 0.7)}
    got = split.stratified_split(labelled(spark), "y", "k", 45)
    assert {r.k for r in got.where("is_train").collect()} == expected
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert split.stratified_split(labelled(spark), "y", "k", 45, 1.0).where("is_train").count() == 733


def test_smaller_size_is_contained_in_larger(spark):
    rows = labelled(spark).withColumn("model", F.lit("m"))
    small = {r.k for r in split.first_of_size(rows, "model", "k", 45, 50).collect()}
    large = {r.k for r in split.first_of_size(rows, "model", "k", 45, 200).collect()}
    assert len(small) == 50 and len(large) == 200 and small < large


def test_class_weights(spark):
    weights = {r.y: r.weight for r in split.class_weights(labelled(spark), "y").collect()}
    assert weights == {0: 733 / 1400, 1: 733 / 66}
    attached = split.with_class_weight(labelled(spark), "y").select("y", "weight").distinct().collect()
    assert {r.y: r.weight for r in attached} == weights


def brute(queries, points, k, exclude):
    out = {}
    for name, q in queries.items():
        pairs = sorted((round(float(np.linalg.norm(np.subtract(q, p))), 9), other)
                       for other, p in points.items() if not (exclude and other == name))
        out[name] = pairs[:k]
    return out


def frame(spark, points):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in points.items()], "k string, a double, b double, c double")


@pytest.mark.parametrize("k,exclude,regions", [(1, False, 4096), (1, True, 4096), (4, True, 4096), (1, False, 3), (4, True, 3)])
def test_nearest_is_exact_with_many_boxes_hot_points_and_clusters(spark, monkeypatch, k, exclude, regions):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 24)
    monkeypatch.setattr(neighbours, "REGIONS", regions)  # 3: fewer than boxes, so that regions have trees of their own
    monkeypatch.setattr(neighbours, "REGION_ROWS", 50)
    rng = np.random.default_rng(3)
    points = {f"p{i}": rng.normal(0, 1, 3).round(3) for i in range(250)}
    points.update({f"h{i}": (0.5, 0.5, 0.5) for i in range(130)})  # a third are copies of one point
    points.update({f"f{i}": (50 + i / 100, 50, 50) for i in range(20)})
    queries = points if exclude else {**{f"q{i}": rng.normal(0, 2, 3) for i in range(100)},
                                      **{f"w{i}": (0.5, 0.5, 0.5) for i in range(50)}}
    found = neighbours.nearest(frame(spark, queries), frame(spark, points), "k", ["a", "b", "c"], k, exclude).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.k, r["rank"])):
        got.setdefault(r.k, []).append((r.distance, r.neighbour))
    expected = brute(queries, points, k, exclude)
    assert got.keys() == expected.keys()
    for name in expected:
        assert [d for d, _ in got[name]] == pytest.approx([d for d, _ in expected[name]], abs=1e-8)
        assert [n for _, n in got[name]] == [n for _, n in expected[name]]


def test_boxes_beyond_the_first_tree_are_rows_of_tables(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 8)
    monkeypatch.setattr(neighbours, "REGIONS", 4)
    rng = np.random.default_rng(9)
    points = {f"p{i}": rng.uniform(0, 1, 3) for i in range(400)}
    index = neighbours.box_index(frame(spark, points), "k", ["a", "b", "c"])
    assert len(index.regions) == 7  # the square root of 50 boxes, and what the driver holds
    sizes = [r.n for r in index.edges.collect()]
    assert sum(sizes) == 400 and len(sizes) > 25
    assert max(sizes) < 64
    assert neighbours.box_index(frame(spark, points).limit(0), "k", ["a", "b", "c"]).regions.empty


def test_distance_to_itself_is_zero(spark):
    points = {f"p{i}": (i, i * i % 7, 1) for i in range(40)}
    found = neighbours.nearest(frame(spark, points), frame(spark, points), "k", ["a", "b", "c"])
    assert {r.distance for r in found.collect()} == {0.0}


def test_smote_fills_up_on_segments(spark):
    rng = np.random.default_rng(5)
    rows = [(f"z{i}", *map(float, rng.normal(0, 1, 2)), 0) for i in range(83)]
    rare = {f"r{i}": rng.normal(4, 1, 2) for i in range(12)}
    rows += [(name, *map(float, p), 1) for name, p in rare.items()]
    train = spark.createDataFrame(rows, "k string, a double, b double, y int")
    new = sm.smote(train, "y", "k", ["a", "b"], 45).collect()
    assert len(new) == 83 - 12 and {r.y for r in new} == {1}
    assert len({r.k for r in new}) == len(new)
    near = brute({n: p for n, p in rare.items()}, rare, 5, True)
    for r in new:
        base, _ = r.k.split("#")
        start, here = np.array(rare[base]), np.array([r.a, r.b])
        on = False
        for _, other in near[base]:
            span = np.array(rare[other]) - start
            step = (here - start) @ span / (span @ span)
            on |= -1e-9 <= step <= 1 and np.allclose(start + step * span, here)
        assert on
    again = sm.smote(train.repartition(3), "y", "k", ["a", "b"], 45).collect()
    assert {(r.k, round(r.a, 9)) for r in again} == {(r.k, round(r.a, 9)) for r in new}
