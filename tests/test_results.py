"""Result tables and helpers that no query exercises, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.operators import comparison, results, series
from furrow.sources import tables


def test_metric_columns_and_order(spark):
    df = spark.createDataFrame([(1, "x", 0.5, 2.0, 3, "B0", 1.0)], "run_id int, crop string, zeta double, rmse double, seed int, arm string, r2 double")
    assert results.metric_columns(df, ["crop"]) == ["zeta", "rmse", "r2"]
    assert results.ordered(df, ["arm", "crop"]).columns == ["arm", "crop", "r2", "rmse", "run_id", "seed", "zeta"]


def test_runs_without_an_arm_are_left_out(spark):
    first = spark.createDataFrame([(1, 5, "B1"), (1, 4, "B0"), (None, 1, "B9")], "run_id int, k int, arm string")
    second = spark.createDataFrame([("1", 0, "B7", "wheat"), ("2", 0, None, "maize"), ("3", 2, "B2", "maize")], "run_id string, k int, arm string, crop string")
    who = results.run_identities([first, second], ["arm", "crop"], "k")
    assert {r.run_id: (r.arm, r.crop) for r in who.collect()} == {"1": ("B0", None), "2": (None, "maize"), "3": ("B2", "maize")}
    rows = spark.createDataFrame([(1, 0.1), (2, 0.2), (9, 0.3)], "run_id int, y double")
    assert [(r.run_id, r.arm) for r in results.with_identity(rows, who).collect()] == [("1", "B0")]


def test_summary_and_years(spark):
    scored = spark.createDataFrame([(2000, 1.0), (2001, 2.0), (None, 1.5)], "year int, rmse double")
    whole, years = results.summary_and_years(scored, {"timestamp": F.lit("t"), "run_id": F.lit("r"), "crop": F.lit("maize")})
    assert whole.columns == ["timestamp", "run_id", "crop", "rmse"] and [r.rmse for r in whole.collect()] == [1.5]
    assert years.columns == ["timestamp", "run_id", "year", "crop", "rmse"] and years.count() == 2


def test_process_metrics_of_odd_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", 0.0, 0.05), ("a", nan, 1.0), ("a", 1.0, None), ("b", 1.0, nan), ("c", 4.0, 4.0)], "g string, y double, y_pred double")
    got = {r.g: r for r in results.process_metrics(df, ["g"], refs={"own": "y"}).collect()}
    assert (got["a"].n, got["a"].mape, got["a"].within_1pct, got["a"].within_0p1abs, got["a"].rmse_ref_own) == (2, 50.0, 0.0, 0.5, 0.0)
    assert (got["b"].n, got["b"].rmse, got["c"].r2, got["c"].within_1pct) == (0, None, None, 1.0)


def test_pivot_and_checkpoint(spark):
    df = spark.createDataFrame([(1, "SQ1", "lim", 2), (1, "SQ1", "lim", 5), (1, "SQ2", "hi", 7)], "p int, q string, l string, v int")
    assert results.pivot_suffixed(df, ["p"], dimension="q", level="l", value="v", dimensions=["SQ1", "SQ2"], levels=["lim", "hi"]).first().asDict() == {"p": 1, "sq1_lim": 5, "sq1_hi": None, "sq2_lim": None, "sq2_hi": 7}
    files = spark.createDataFrame([("a", "x-loss=0.50.ckpt"), ("a", "b-loss=0.5.ckpt"), ("a", "last.ckpt"), ("z", "none")], "k string, name string")
    assert [tuple(r) for r in results.best_checkpoint(files, ["k"]).collect()] == [("a", "b-loss=0.5.ckpt", 0.5)]


def test_sensor_rows_are_rescaled_and_clipped(spark):
    df = spark.createDataFrame([("p", 1, 50.0), ("p", 2, 120.0), ("p", 3, -5.0), ("s", 1, 0.4), ("s", 2, None)], "k string, t int, v double")
    got = {(r.k, r.t): r.v for r in series.clean_sensor(df, ["k"], "v", (0.0, 1.5), (0.0, 1.0), percent_above=1.5).collect()}
    assert got == {("p", 1): 0.5, ("p", 2): 1.0, ("p", 3): None, ("s", 1): 0.4, ("s", 2): None}


def test_padding_marks_what_is_missing(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 3, 7.0), ("b", 9, 1.0)], "k string, t int, v double")
    got = sorted((r.k, r.step, r.v, r.observed) for r in series.pad(df, ["k"], "t", "v", 2).collect())
    assert got == [("a", 0, 5.0, True), ("a", 1, 6.0, True), ("b", 0, 1.0, True), ("b", 1, 0.0, False)]


def test_columns_without_a_query(spark):
    df = spark.createDataFrame([(5.0, "lstm", 3.0, 1.0), (20.0, "tree", -1.0, 2.0), (45.0, None, 0.5, 0.25)], "t double, m string, a double, b double")
    rows = df.select("t", c.beta_response(F.col("t"), 5, 20, 40).alias("beta"), c.model_family(F.col("m"), {"lstm": "deep"}).alias("family"), c.sorted_quantiles(F.col("a"), F.col("b")).alias("q")).collect()
    assert [r.beta for r in rows] == [0.0, pytest.approx(1.0), 0.0] and [r.family for r in rows] == ["deep", "other", "other"]
    assert [r.q for r in rows] == [[1.0, 3.0], [0.0, 2.0], [0.25, 0.5]]


def test_prediction_files_and_resume(spark, tmp_path):
    (tmp_path / "a_run1.csv").write_text("region,y\nr1,1.5\nr2,oops\n")
    (tmp_path / "b_run2.csv").write_text("region,y\nr3,2\n")
    rows = tables.read_predictions(spark, str(tmp_path / "*.csv"), "region string, y double")
    assert {(r.region, r.y, r.file) for r in rows.collect()} == {("r1", 1.5, "a_run1.csv"), ("r3", 2.0, "b_run2.csv")}
    done = spark.createDataFrame([("r3",), ("r3",)], "region string")
    assert [r.region for r in tables.new_keys_only(rows, done, ["region"]).collect()] == ["r1"]
    runs = spark.createDataFrame([("x", 30, 0.6), ("x", 60, 0.8), ("x", 90, 0.9), ("y", 30, 0.1)], "k string, origin int, auc double")
    assert {r.k: r.earliest_origin for r in comparison.earliest_useful(runs, ["k"]).collect()} == {"x": 60, "y": None}
