import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordaudit.operators import encode, enrich as en, realism
from recordaudit.sources.schema import Relations

REL = Relations(
    origin="o", destination="d", distance="miles", scheduled="t", place_attributes=("city",),
    origin_prefix="o", destination_prefix="d", timeline=(("off", "t", "wait"), ("on", "off", "air")),
    delay_labels=(("late", "wait"),),
    output=("o", "o_city", "d", "d_city", "quarter", "day_of_week", "t", "wait", "late", "off", "on", "air", "miles"))


@pytest.fixture(scope="module")
def history(spark):
    rows = [("A", "Aville", "B", "Bville", 10.0), ("A", "Aville", "B", "Bville", 10.0), ("B", "Btown", "A", "Other", 10.0),
            ("C", "Cville", "A", "Aville", None)]
    return spark.createDataFrame(rows, "o string, o_city string, d string, d_city string, miles double")


@pytest.fixture(scope="module")
def asked(spark):
    noon = dt.datetime(2024, 5, 6, 12)
    rows = [(1, "A", "B", noon, 20.0, 60.5), (2, "B", "C", noon, None, 5.0), (3, "C", "A", noon, 3.0, 5.0)]
    return spark.createDataFrame(rows, "id int, o string, d string, t timestamp, wait double, air double")


def test_origin_rows_win_in_the_place_dimension(spark, history):
    places = {r.place_id: r.city for r in en.airport_dimension(history, REL).collect()}
    assert places == {"A": "Aville", "B": "Btown", "C": "Cville"}


def test_dimensions_from_one_scan_equal_the_separate_ones(spark, history):
    routes, places = en.history_dimensions(history, F.col("o") != "C", REL)
    assert {tuple(r) for r in routes.collect()} == {("A", "B", 10.0), ("B", "A", 10.0)}
    assert set(places.collect()) == set(en.airport_dimension(history, REL).select(*places.columns).collect())


def test_several_distances_fan_out_but_do_not_inflate_realism(spark, asked):
    routes = spark.createDataFrame([("A", "B", 10.0), ("A", "B", 11.0)], "o string, d string, miles double")
    assert en.join_routes(asked, routes, REL).count() == 4
    score = realism.realism_pct(asked.withColumn("model", F.lit("m")), routes, REL).first()
    assert (score.rows_generated, score.rows_valid, score.realism) == (3, 1, 33.3)
    unique = en.route_distance_unique(routes, REL).first()
    assert (unique.routes, unique.is_unique) == (1, False)


def test_semi_and_anti_join_share_the_rows(spark, history, asked):
    routes = en.route_dimension(history, REL)
    valid = {r.id for r in en.valid_routes(asked, routes, REL).collect()}
    novel = {r.id for r in en.novel_routes(asked, routes, REL).collect()}
    assert valid == {1} and novel == {2, 3}  # C→A has no known distance


def test_enrich_and_clean(spark, history, asked):
    routes, places = en.history_dimensions(history, F.lit(True), REL)
    full = {r.id: r for r in en.enrich(asked, routes, places, REL, ["id"]).collect()}
    assert full[2].late is None and full[2].off is None and full[2].on is None
    assert full[1].late == 1.0 and full[1].quarter == 2 and full[1].day_of_week == 1
    assert full[1].on - full[1].t == dt.timedelta(minutes=80, seconds=30)
    assert full[1].d_city == "Btown"
    assert [r.id for r in en.enrich_and_clean(asked, routes, places, REL, ["id"]).collect()] == [1]


def test_codes_follow_sorted_real_values_and_unseen_is_minus_one(spark):
    names = [f"v{i:03d}" for i in range(300)]
    real = spark.createDataFrame([(n, str(i % 3)) for i, n in enumerate(names)], ["a", "b"])
    cand = spark.createDataFrame([("v010", "2"), ("zzz", "9"), (None, "0")], "a string, b string")
    dictionary = encode.ordinal_dictionary(real, ["a", "b"])
    got = [tuple(r) for r in encode.ordinal_encode(cand, dictionary, ["a", "b"]).collect()]
    assert sorted(got) == sorted([(10, 2), (-1, -1), (-1, 0)])
    own = encode.ordinal_encode(real, dictionary, ["a"]).select("a").collect()
    assert sorted(r.a for r in own) == list(range(300))


def test_prepare_rejects_text_that_is_left(spark):
    real = spark.createDataFrame([("x", "city", 1.0)], "a string, town string, n double")
    with pytest.raises(ValueError, match="town"):
        encode.prepare_for_prediction(real, real, ["a"])
    ours, theirs = encode.prepare_for_prediction(real, real, ["a"], dropped=["town"])
    assert ours.first() == theirs.first()


def test_scaling_is_fitted_on_real_and_constants_do_not_divide_by_zero(spark):
    real = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], ["x", "c"])
    other = spark.createDataFrame([(7.0, 6.0)], ["x", "c"])
    low = encode.minmax_scale(other, real, ["x", "c"]).first()
    assert (low.x, low.c) == (3.0, 1.0)
    std = encode.standard_scale(other, real, ["x", "c"]).first()
    assert (std.x, std.c) == (5.0, 1.0)  # population deviation 1


def test_real_median_fills_nulls(spark):
    values = [1.0, 2.0, 2.0, 9.0, None]
    real = spark.createDataFrame([(v,) for v in values], "x double")
    medians = encode.real_medians(real, ["x"])
    assert medians.first().x == np.median([1, 2, 2, 9])
    other = spark.createDataFrame([(None,), (4.0,)], "x double")
    assert sorted(r.x for r in encode.fill_real_median(other, medians, ["x"]).collect()) == [2.0, 4.0]
