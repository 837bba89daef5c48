from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cellclock.functions import cleaning, clock, geo, losses, scaling
from cellclock.grid import Grid
from cellclock.names import all_band_pairs, canonical_name, lag_columns, lag_name
from cellclock.operators.differences import band_difference


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_ceil_ignores_seconds_and_keeps_multiples(spark):
    assert one(spark, clock.ceil_clock(ts("2020-05-01 00:10:45"))) == datetime(2020, 5, 1, 0, 10)
    assert one(spark, clock.ceil_clock(ts("2020-05-01 00:11:00"))) == datetime(2020, 5, 1, 0, 20)
    assert one(spark, clock.ceil_clock(ts("2020-12-31 23:51:00"))) == datetime(2021, 1, 1)
    assert one(spark, clock.floor_clock(ts("2020-05-01 00:19:59"))) == datetime(2020, 5, 1, 0, 10)


@pytest.mark.parametrize("text", ["2020-05-01-00-10", "2020/5/1/0/10", "2020/5/1:0h10; Band Missing: B04B"])
def test_three_time_notations(spark, text):
    assert one(spark, clock.parse_slot(F.lit(text))) == datetime(2020, 5, 1, 0, 10)


def test_unreadable_time_is_null(spark):
    assert one(spark, clock.parse_slot(F.lit("2020-13-41-00-10"))) is None
    assert one(spark, clock.parse_slot(F.lit("nothing"))) is None


def test_cell_rounding_modes_differ_left_of_the_grid(spark):
    g = Grid(101.0, 24.0, 0.5, 0.5, 4, 4)
    lon, lat = F.lit(100.75), F.lit(24.25)
    assert [one(spark, c) for c in g.cell(lon, lat)] == [-1, -1]
    assert [one(spark, c) for c in g.cell(lon, lat, "truncate")] == [0, 0]


def test_names():
    assert lag_name("B", 0) == "B_t+0"
    assert lag_columns(["A", "B"], [-1, 0]) == ["A_t-1", "A_t+0", "B_t-1", "B_t+0"]
    assert lag_columns(["A", "D"], [-1, 0], ["D"], time_major=True) == ["A_t-1", "D", "A_t+0"]
    assert [canonical_name(x) for x in ("N1B(20)", "B05B_30p", "W2B_t+1", "row")] == [
        "B04B_t-2", "B05B_t-3", "B09B_t+1", "row",
    ]
    assert len(all_band_pairs()) == 45


def test_flag_follows_the_given_sentinel(spark):
    df = spark.createDataFrame([(1, -5.0), (2, 3.0), (3, None)], "id int, x double")
    out = cleaning.sentinel_with_mask(df, "x", -5.0, 0.0, "ok").orderBy("id").collect()
    assert [(r["x"], r["ok"]) for r in out] == [(0.0, 0), (3.0, 1), (None, 1)]


def test_drop_missing_takes_nan_and_null_and_ignores_absent(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0)], "id int, x double")
    assert [r["id"] for r in cleaning.drop_missing(df, ["x", "zzz"]).collect()] == [3]


def test_scaler_registry_refuses(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(KeyError):
        scaling.apply_scaler(df, ["x"], "NoScaler")
    with pytest.raises(ValueError):
        scaling.apply_scaler(df, ["x"], "MinMaxScaler", [1.0])
    with pytest.raises(ValueError):
        scaling.apply_scaler(df, ["x"], "MaxScaler", [0.0])


def test_guarded_minmax(spark):
    assert one(spark, scaling.scale_minmax(F.lit(7.0), 3.0, 3.0)) == 0.5
    assert one(spark, scaling.scale_minmax(F.lit(7.0), 5.0, 9.0)) == 0.5
    assert one(spark, scaling.scale_minmax(F.lit(1e-10), 0.0, 1e-11)) == pytest.approx(1e-10 / 1.1e-10)


def test_bce_is_stable_for_large_logits(spark):
    assert one(spark, losses.bce_with_logits(F.lit(800.0), F.lit(0))) == 800.0
    assert one(spark, losses.bce_with_logits(F.lit(-800.0), F.lit(0))) == 0.0


def test_haversine_quarter_circle(spark):
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) == pytest.approx(10007.543, abs=1e-3)


def test_band_difference_skips_malformed(spark):
    df = spark.createDataFrame([(5.0, 2.0)], "`A_t-1` double, `B_t-1` double")
    out = band_difference(df, ["A-B", "A", "A-B-C", "A-Z"], [-1])
    assert out.columns == ["A_t-1", "B_t-1", "A-B_t-1"] and out.first()[2] == 3.0


def test_digamma_and_p_value(spark):
    from cellclock.functions.special import beta_inc, digamma

    assert one(spark, digamma(F.lit(1))) == pytest.approx(-0.5772156649015329, abs=1e-11)
    assert one(spark, digamma(F.lit(4))) == pytest.approx(1 + 1 / 2 + 1 / 3 - 0.5772156649015329, abs=1e-11)
    # t with 2 degrees of freedom: P(|T| > t) = 1 - t / sqrt(2 + t^2)
    r = 0.6
    t = r * (2 / (1 - r * r)) ** 0.5
    assert beta_inc(1.0, 0.5, 1 - r * r) == pytest.approx(1 - t / (2 + t * t) ** 0.5, abs=1e-12)
