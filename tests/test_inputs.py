"""Sensor series, crop responses, class labels, process-model files and input tables on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from furrow.functions import crops
from furrow.operators import assembly, national, series


def _series(spark, values, kind="double"):
    return spark.createDataFrame([("k", t, v) for t, v in enumerate(values)], f"k string, t int, v {kind}")


def test_sentinels_are_filled_before_the_clip(spark):
    got = series.sensor_series(_series(spark, [None, -0.4, 9.0, 0.2, float("nan")]), ["k"], "t", "v", "ndvi").orderBy("t").collect()
    # filled from the raw -0.4, not from the limit 0.1 that it is held to
    assert [r.v for r in got] == pytest.approx([0.1, 0.1, 0.1, 0.2, 0.2])
    other = series.sensor_series(_series(spark, [-0.4, None, 1.0]), ["k"], "t", "v", "ndvi").orderBy("t").collect()
    assert [r.v for r in other] == pytest.approx([0.1, 0.3, 1.0])


def test_percent_is_told_by_the_greatest_reading(spark):
    assert [r.v for r in series.sensor_series(_series(spark, [40.0, 1.0, 120.0]), ["k"], "t", "v", "fpar").orderBy("t").collect()] == pytest.approx([0.4, 0.01, 0.01])
    assert [r.v for r in series.sensor_series(_series(spark, [0.4, float("nan"), 1.03]), ["k"], "t", "v", "fpar").orderBy("t").collect()] == pytest.approx([0.4, 0.715, 1.0])


def test_a_series_without_readings_stays_null(spark):
    assert {r.v for r in series.sensor_series(_series(spark, [None, None]), ["k"], "t", "v", "ssm").collect()} == {None}
    assert series.sensor_series(_series(spark, []), ["k"], "t", "v", "fpar").count() == 0
    assert [r.v for r in series.soil_moisture(_series(spark, [None, -1.0, None, 3.0]), ["k"], "t", "v").orderBy("t").collect()] == [0.0, 0.0, 1.0, 3.0]


def test_masked_steps_have_no_weight(spark):
    df = spark.createDataFrame([("k", t, float(v), o) for t, (v, o) in enumerate([(1, True), (2, True), (50, False), (60, False), (70, False), (9, True)])], "k string, t int, v double, o boolean")
    got = series.masked_moving_average(df, ["k"], "t", "v", "o", 3).orderBy("t").collect()
    assert [r.trend for r in got] == [1.5, 1.5, 2.0, 0.0, 9.0, 9.0]
    assert got[2].rest == 48.0


def test_a_bin_without_days_is_null(spark):
    df = spark.createDataFrame([("k", "2001-01-05"), ("k", "2001-01-20"), ("k", "2001-03-01")], "k string, day string").withColumn("day", F.to_date("day"))
    got = series.binned_encodings(df, ["k"], "day", F.lit(None).cast("date"), F.lit(None).cast("date"), "monthly").orderBy("period").collect()
    assert [str(r.period) for r in got] == ["2001-01-01", "2001-02-01", "2001-03-01"]
    assert got[1].doy_sin is None and got[0].season_sin == 0.0
    assert got[0].doy_cos == pytest.approx((math.cos(2 * math.pi * 5 / 365) + math.cos(2 * math.pi * 20 / 365)) / 2)


def _assimilated(t, p, r, maize):
    low, best, high, gamma, kc, share, half = (8, 33, 45, 0, None, 0.4, 400) if maize else (0, 22, 37, 42.75, 404.9, 0.7, 300)
    warmth = 0.0 if not low < t < high else (high - t) / (high - best) * ((t - low) / (best - low)) ** ((best - low) / (high - best))
    par, ci = 0.48 * r, share * 400
    carbox = 150 * warmth * (1 if maize else (ci - gamma) / (ci + kc))
    light = 0.1 * par * warmth * (ci - gamma) / (4 * ci + 8 * gamma)
    return 0.0 if carbox + light == 0 else 2 * carbox * light / (carbox + light) * par / (par + 100) * p / (p + half)


def test_assimilation_against_a_plain_loop(spark):
    rows = [(float(t), float(p), float(r)) for t in (-3, 0, 8, 15, 22, 33, 40, 45) for p in (0, 120, 900) for r in (0, 300, 2500)]
    df = spark.createDataFrame(rows, "t double, p double, r double")
    for crop in ("Maize", "barley"):
        got = df.select("t", "p", "r", crops.assimilation_index(F.col("t"), F.col("p"), F.col("r"), crop).alias("a")).collect()
        assert [r.a for r in got] == pytest.approx([_assimilated(r.t, r.p, r.r, crop == "Maize") for r in got], rel=1e-6, abs=1e-9)
    empty = spark.createDataFrame([(None, 1.0, 1.0), (float("nan"), 1.0, 1.0)], "t double, p double, r double")
    assert [r.a for r in empty.select(crops.assimilation_index(F.col("t"), F.col("p"), F.col("r"), "wheat").alias("a")).collect()] == [0.0, 0.0]


def test_class_labels(spark):
    df = spark.createDataFrame([(None,), (-9,), (1,), (4,), (5,), (8,), (12,)], "r int")
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in crops.suitability(F.col("r")).items()]).collect()]
    assert [x[2] for x in got] == ["unknown", "unknown", "high", "high", "low", "low", "high"]
    assert got[1][0] is None and got[2][1] == "Very high (SI > 85)" and got[6][1] == "unrecognized class code 12"
    df = spark.createDataFrame([(None,), (0,), (31,), (9,), (30,)], "r int")
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in crops.climate_code(F.col("r")).items()]).collect()]
    assert [x[:3] for x in got] == [(None, "NoData", "NoData")] * 3 + [(9, "Csb", "C"), (30, "EF", "E")]


def test_national_file_only_without_a_regional_one(spark):
    regional = spark.createDataFrame([
        ("m", "A", "b.csv", "2001-05-01", 1.0, "r1"), ("m", "A", "a.csv", "20000501", 2.0, "r1"), ("m", "A", "a.csv", "bad", 3.0, "r1"), ("m", "B", "a.csv", "2000", None, "r2"),
    ], "crop string, country string, file string, date string, v double, region string")
    whole = spark.createDataFrame([("m", x, "n.csv", "2000", 9.0) for x in "ABC"], "crop string, country string, file string, date string, v double")
    got = {tuple(r) for r in national.process_series(regional, whole, "v", [2000, 2001]).collect()}
    assert got == {("m", "A", "region", "r1", 2000, 2.0), ("m", "C", "country", None, 2000, 9.0)}  # B's file is chosen but has no value


def test_national_evaluation_by_hand(spark):
    model = {2000: 1.0, 2001: 2.0, 2002: 3.0, 2003: 4.0, 2004: 5.0}
    means = {2000: 2.0, 2001: 4.0, 2002: 6.0, 2003: 7.0, 2004: 11.0}
    obs = spark.createDataFrame([(c, r, y, v + r - 1) for c in "AB" for r in (0, 1, 2) for y, v in means.items()] + [("A", 3, 2004, None)], "country string, region int, year int, y double")
    lines = spark.createDataFrame([("A", r, y, v + 10 * r) for r in (0, 1) for y, v in model.items()] + [("B", 0, 2000, 1.0), ("B", 0, 2004, 1.0)], "country string, region int, year int, y_pred double")
    got = national.evaluation(obs, lines, [2000, 2001, 2002], [2003], [2004]).collect()
    assert [r.country for r in got] == ["A"]  # B has one train year
    r = got[0]
    assert r.n == 1 and r.rmse == pytest.approx(1.0)  # line 2 x: 10 against 11
    assert r.rmse_ref_climatology == pytest.approx(11 - 4.75) and r.rmse_ref_rolling3 == pytest.approx(11 - 17 / 3)
    assert r.rmse_ref_ols == pytest.approx(11 - (4.75 + 1.7 * 2.5)) and r.rmse_ref_trend == pytest.approx(11 - (5 + (2 + 5 / 3) / 2 * 2.5))
    assert r.skill_rmse_vs_climatology == pytest.approx(1 - 1 / 6.25)


def test_constant_model_is_moved_by_its_mean_error(spark):
    obs = spark.createDataFrame([("A", 0, y, float(y - 1990)) for y in range(2000, 2005)], "country string, region int, year int, y double")
    flat = spark.createDataFrame([("A", 0, y, 3.0) for y in range(2000, 2005)], "country string, region int, year int, y_pred double")
    r = national.evaluation(obs, flat, [2000, 2001, 2002], [2003], [2004]).first()
    assert r.mae == pytest.approx(3.0)  # 11 is predicted


def test_residual_goes_on_top_of_the_trend(spark):
    train = spark.createDataFrame([(1.0,), (5.0,)], "y double")
    frame = spark.createDataFrame([(0.5, 4.0), (None, 4.0)], "residual double, ref_trend double")
    assert [r.y_pred for r in national.add_trend(frame, train).collect()] == [5.0, None]
    assert national.add_trend(frame, train.where("y < 2")).first().y_pred == 4.5


def test_region_features_and_key_sets(spark):
    soil = spark.createDataFrame([("X", 1, 0.5, 2001, "a"), ("X", 1, None, 2002, "b"), ("X", 2, float("nan"), 2001, "c")], "country string, region int, awc double, year int, note string")
    rain = spark.createDataFrame([("X", 1, 3), ("X", 3, 5), ("Y", 1, 7)], "country string, region int, awc int")
    targets = spark.createDataFrame([("X", 1), ("X", 1), ("X", 2), ("Y", 1), ("Z", 9)], "country string, region int")
    got = {tuple(r) for r in assembly.region_features({"soil": soil, "rain": rain}, targets).collect()}
    assert got == {("X", 1, 0.5, 3.0), ("X", 2, None, None), ("Y", 1, None, 7.0)}
    a = spark.createDataFrame([(1, 1), (1, 1), (1, None)], "g int, k int")
    b = spark.createDataFrame([(1, None), (1, 2), (1, 3)], "g int, k int")
    assert tuple(assembly.key_overlap(a, b, ["g", "k"], ["g"]).first()) == (1, 1, 1, 2, 0.25)
    assert assembly.key_overlap(a.limit(0), b.limit(0), ["g", "k"]).first().jaccard is None


def test_prediction_rows_of_uneven_arrays(spark):
    batches = spark.createDataFrame([("r", 2001, [7, 8, 9], [1.0, 2.0, 3.0], [0.5, 0.6], [[0.1, 0.9]]), ("r", 2002, [1], [1.0], [], None), ("r", 2003, None, [4.0], [5.0], None)],
                                    "run_id string, year int, regions array<int>, targets array<double>, preds array<double>, quantiles array<array<double>>")
    got = [tuple(r) for r in assembly.prediction_rows(batches, ["run_id"], [0.1, 0.9]).orderBy("year", "y_pred").collect()]
    assert got == [("r", 2001, 7, 1.0, 0.5, 0.1, 0.9), ("r", 2001, 8, 2.0, 0.6, None, None), ("r", 2003, None, 4.0, 5.0, None, None)]


def test_last_label_of_a_region_counts(spark):
    suit = spark.createDataFrame([("a", 1, 3), ("a", 2, 4), ("a", 3, None)], "region string, line int, raw_class_code int")
    clim = spark.createDataFrame([("a", 1, "maize", "Cfa"), ("a", 2, "maize", "NoData"), ("b", 1, "wheat", "Dfb")], "region string, line int, crop string, climate_label string")
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "region string")
    got = {tuple(r) for r in assembly.label_lookups(rows, suit, clim, "maize").collect()}
    assert got == {("a", 4.0, "Cfa"), ("b", None, None), (None, None, None)}
    assert [r.years for r in assembly.dataset_years(spark.createDataFrame([("m", "A", 2002), ("m", "A", 2000), ("m", "A", 2002), ("m", "A", None)], "crop string, country string, year int")).collect()] == [[2000, 2002]]
