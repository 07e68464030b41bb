import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordaudit.functions import scalars as sc
from recordaudit.functions.normal import normal_cdf, normal_quantile
from recordaudit.operators import balance, prep


def one(spark, expression, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values))
    return frame.select(expression.alias("x")).first()["x"]


def test_weekday_starts_on_monday(spark):
    assert one(spark, sc.iso_weekday("t"), t=dt.datetime(2024, 1, 1)) == 1
    assert one(spark, sc.iso_weekday("t"), t=dt.datetime(2024, 1, 7)) == 7


def test_minutes_may_be_fractional_and_negative(spark):
    start = dt.datetime(2024, 1, 1)
    assert one(spark, sc.plus_minutes("t", "m"), t=start, m=1.25) == start + dt.timedelta(seconds=75)
    assert one(spark, sc.plus_minutes("t", "m"), t=start, m=-0.5) == start - dt.timedelta(seconds=30)


def test_minutes_and_label_of_null_are_null(spark):
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 1), None)], "t timestamp, m double")
    row = frame.select(sc.plus_minutes("t", "m").alias("a"), sc.delay_label("m").alias("b")).first()
    assert row.a is None and row.b is None


@pytest.mark.parametrize("delta,label", [(15.0, 1.0), (14.99, 0.0), (-3.0, 0.0)])
def test_delay_label_threshold(spark, delta, label):
    assert one(spark, sc.delay_label("d"), d=delta) == label


def test_epoch_seconds_floor_before_1970(spark):
    frame = spark.sql("select timestamp'1969-12-31 23:59:59.5' as t")
    assert frame.select(sc.epoch_seconds("t").alias("x")).first().x == -1


def test_display_names(spark):
    names = ["Default TVAE", "Optimal CTGAN", "GC", "real", "TRTR"]
    frame = spark.createDataFrame([(n,) for n in names], ["n"])
    got = [r.x for r in frame.select(sc.display_name("n").alias("x")).collect()]
    assert got == ["$TVAE$", "$CTGAN_{opt.}$", "$GC$", "$real$", "TRTR"]


def test_percent_rounds_half_to_even(spark):
    frame = spark.createDataFrame([(5, 4000), (15, 4000)], ["a", "b"])  # 0.125 and 0.375 percent
    got = [r.x for r in frame.select(F.bround(F.col("a") / F.col("b") * 100, 2).alias("x")).collect()]
    assert got == [0.12, 0.38]


def test_hash_uniform_matches_its_definition(spark):
    got = one(spark, sc.hash_uniform(45, "k", F.lit("tag")), k="abc")
    assert got == int(hashlib.md5(b"abc|tag|45").hexdigest()[:13], 16) / 2 ** 52


def test_variant_name_and_speed(spark):
    name = "synthesizer_TVAE_diversions_Optimal_V0"
    assert one(spark, sc.variant_type("n"), n=name) == "tvae"
    assert one(spark, sc.variant_state("n"), n=name) == "optimal"
    frame = spark.createDataFrame([(500, 128)], ["e", "d"])
    assert frame.select(sc.speed_score("e", "d").alias("x")).first().x == pytest.approx(1 / 6.4)


def test_normal_functions_are_inverse():
    p = np.linspace(0.001, 0.999, 999)
    assert np.abs(normal_cdf(normal_quantile(p)) - p).max() < 1e-6
    assert normal_quantile(np.array([0.975]))[0] == pytest.approx(1.959964, abs=1e-5)


def statuses(spark):
    return spark.createDataFrame([(1, "C"), (2, "D"), (3, None), (4, "O")], "id int, status string")


def test_unknown_status_is_kept_and_labelled_zero(spark):
    kept = prep.binary_label(prep.drop_cancelled(statuses(spark)), "y")
    assert {(r.id, r.y) for r in kept.collect()} == {(2, 1), (3, 0), (4, 0)}
    counts = prep.cancelled_counts(statuses(spark)).first()
    assert (counts.rows_before, counts.rows_removed, counts.rows_after) == (4, 1, 3)


def test_absent_column_is_an_error(spark):
    with pytest.raises(ValueError, match="wing"):
        prep.drop_features(statuses(spark), ["status", "wing"])
    with pytest.raises(ValueError, match="status"):
        prep.assert_all_numeric(statuses(spark))
    assert prep.assert_all_numeric(statuses(spark), without=["status"]) is not None


def test_simplify_and_projections(spark):
    simple = prep.simplify(statuses(spark), "y", ["status"])
    assert simple.columns == ["id", "y"]
    assert prep.rare_class(simple, "y").count() == 1
    assert prep.restrict_to(statuses(spark), simple).columns == ["id"]
    assert prep.select_numeric(statuses(spark)).columns == ["id"]
    both = prep.stack_real_and_candidates(simple, simple.select("y", "id"))
    assert sorted(r.source for r in both.collect()) == [0, 0, 0, 1, 1, 1]


def test_class_balance_counts_unknown(spark):
    frame = spark.createDataFrame([("m", 1.0), ("m", 0.0), ("m", None), ("m", 0.0)], "model string, dep double")
    row = balance.class_balance(frame, "model", {"dep": "dep"}).first()
    assert (row.delayed_dep, row.on_time_dep, row.unknown_dep, row.on_time_dep_pct) == (1, 2, 1, 50.0)
    counts = {r.value: r.n for r in balance.value_counts(frame, "model", ["dep"]).collect()}
    assert counts == {None: 1, 0.0: 2, 1.0: 1}
