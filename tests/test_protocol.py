"""Ranking, assembly, contract and bias operators on hand-made rows."""

from datetime import date

import numpy as np
from pyspark.sql import functions as F

from furrow.operators import assembly, comparison, contract, evaluation, ranking, reference, tiers
from furrow.plans import registry


def test_year_bootstrap_of_one_year_has_no_interval(spark):
    rows = spark.createDataFrame([(2000, 1.0, 1.5, 2.0), (2000, 2.0, 2.5, 3.0), (2001, None, 1.0, 1.0)], "year int, y double, y_pred double, y_base double")
    got = {r.metric: r for r in ranking.year_bootstrap(rows, draws=50).collect()}
    assert got["rmse"].delta == -0.5 and got["rmse"].ci_lo is None and got["rmse"].n_boot_eff == 0
    assert ranking.year_bootstrap(rows.limit(0), draws=50).count() == 0


def test_year_bootstrap_repeats_and_holds_the_point(spark):
    rng = np.random.default_rng(1)
    rows = [(t, float(y), float(y + rng.normal(0, 1)), float(y + rng.normal(0, 2))) for t in range(8) for y in rng.normal(10, 3, 20)]
    f = spark.createDataFrame(rows, "year int, y double, y_pred double, y_base double")
    first, again = (sorted(ranking.year_bootstrap(f.repartition(n), draws=200).toPandas().round(9).itertuples(index=False)) for n in (1, 7))
    assert first == again
    rmse = {r.metric: r for r in first}["rmse"]
    a = np.array(rows)
    want = np.sqrt(np.mean((a[:, 1] - a[:, 2]) ** 2)) - np.sqrt(np.mean((a[:, 1] - a[:, 3]) ** 2))
    assert abs(rmse.delta - want) < 1e-8 and rmse.ci_lo < rmse.delta < rmse.ci_hi < 0 and rmse.n_boot_eff == 200


def test_verdicts_need_all_three(spark):
    deltas = spark.createDataFrame([("a", "rmse", -1.0), ("b", "rmse", 1.0), ("c", "rmse", -1.0), ("a", "r2", 0.5)], "place string, metric string, delta double")
    ci = spark.createDataFrame([("a", "rmse", -2.0, -0.5), ("b", "rmse", 0.5, 2.0), ("a", "r2", 0.1, 0.9)], "place string, metric string, ci_lo double, ci_hi double")
    tests = spark.createDataFrame([("rmse", 0.01), ("r2", None)], "metric string, p_value double")
    got = {(r.place, r.metric): r for r in ranking.verdicts(deltas, ci, tests, cell=["place", "metric"], panel=["metric"]).collect()}
    assert {k for k, r in got.items() if r.is_win} == {("a", "rmse")}
    assert got["c", "rmse"].boot_excludes_0 is None and got["b", "rmse"].boot_excludes_0 and not got["b", "rmse"].beats_b0_direction
    assert got["a", "r2"].beats_b0_direction and not got["a", "r2"].is_win
    shift = spark.createDataFrame([("a", "near")], "place string, shift_class string")
    rows = {(r.metric, r.shift_class): r for r in ranking.by_shift(ranking.verdicts(deltas, ci, tests, cell=["place", "metric"], panel=["metric"]), shift, place=["place"], keys=["metric"], name="place").collect()}
    assert rows["rmse", "unknown"].places == "b;c" and rows["rmse", "unknown"].n_wins == 0 and rows["rmse", "near"].n_wins == 1 and rows["rmse", "near"].class_rank == 1


def test_target_dates_of_a_leap_year(spark):
    rows = spark.createDataFrame([(1, date(2020, 2, 20), date(2020, 3, 5)), (2, date(2020, 3, 5), date(2020, 2, 1)), (3, None, date(2020, 12, 31)), (4, date(2020, 1, 1), None)], "id int, sos date, cutoff date")
    days = assembly.target_dates(rows, "daily").groupBy("id").agg(F.count("*").alias("n"), F.min("target").alias("first"), F.max("target").alias("last")).collect()
    assert {r.id: (r.n, r.first, r.last) for r in days} == {1: (14, date(2020, 2, 20), date(2020, 3, 5)), 3: (365, date(2020, 1, 1), date(2020, 12, 31))}
    first = assembly.target_dates(rows, "dekad", share=0.5).where("id = 1").collect()
    assert [(r.position, r.target) for r in first] == [(0, date(2020, 2, 20))]
    months = assembly.target_dates(rows, "monthly").where("id = 3").orderBy("position").collect()
    assert [r.target for r in months] == [date(2020, m, 1) for m in range(1, 13)]
    tenth = [r.target for r in assembly.target_dates(rows, "dekad").where("id = 3").orderBy("position").collect()]
    assert len(tenth) == 36 and tenth[-1] == date(2020, 12, 31)


def test_regional_bias_falls_back(spark):
    rows = [("a", float(k), 2.0 * k + 1) for k in (1, 2, 3)] + [("b", 5.0, 9.0), ("zero", 0.0, 3.0)]
    fit = spark.createDataFrame(rows, "region string, y_pred double, y double")
    got = {r.region: r for r in reference.regional_bias(fit).collect()}
    slope = np.polyfit([1, 2, 3, 5], [3, 5, 7, 9], 1)[0]
    assert abs(got["a"].slope - 2) < 1e-9 and abs(got["b"].slope - slope) < 1e-9 and "zero" not in got
    few = {r.region: (r.slope, r.intercept) for r in reference.regional_bias(fit.where("region = 'b'")).collect()}
    assert few == {"b": (1.0, 4.0)}
    moved = reference.correct_by_region(spark.createDataFrame([("b", -50.0), ("c", 1.0)], "region string, y_pred double"), reference.regional_bias(fit))
    assert [r.corrected for r in moved.collect()] == [0.0]


def test_contract_rest(spark):
    seasons = spark.createDataFrame([("10", "20"), ("300", "40"), (None, "5"), ("x", "5")], "sos string, eos string")
    assert contract.season_order(seasons).collect()[0].invalid_rows == 1
    values = spark.createDataFrame([("1.5", "2"), ("0.2", "oops")], "a string, b string")
    assert {r.column: (r.largest, r.warning) for r in contract.scale_warning(values, {"a": 1.0, "b": 1.0}).collect()} == {"a": (1.5, True), "b": (2.0, False)}
    assert {r.column: r.warning for r in contract.scale_warning(values.limit(0), {"a": 1.0}).collect()} == {"a": False}
    years = lambda *y: (spark.createDataFrame([(str(x),) for x in y] or [(None,)], "year string"), "year")
    got = {r.file: r.ok for r in contract.year_overlap({"yield": years(2000, 2001, "bad"), "meteo": years(2001, 2002), "ndvi": years(1990), "soil": years()}).collect()}
    assert got == {"yield": True, "meteo": True, "ndvi": False, "soil": True}


def test_pools_common_keys_and_padding(spark):
    rows = spark.createDataFrame([("a", y) for y in range(2000, 2005)] + [("b", 2000), ("b", 2001)], "g string, year int")
    got = {(r.g, r.year): r.pool for r in assembly.pools(rows, by=["g"]).collect()}
    assert got == {("a", 2000): "train", ("a", 2001): "train", ("a", 2003): "test", ("a", 2004): "test"}
    other = rows.where("year = 2001")
    assert [t.count() for t in assembly.common_keys([rows, other], ["g", "year"])] == [2, 2]
    assert [t.count() for t in assembly.common_keys([rows, other.where("g = 'z'")], ["g", "year"])] == [7, 0]
    series = spark.createDataFrame([(1, 0, 2.0, True), (1, 1, 4.0, True), (1, 2, 99.0, False), (2, 0, 7.0, None)], "id int, t int, x double, mask boolean")
    assert {(r.id, r.t): r.x for r in assembly.fill_padding(series, ["id"], ["x"]).collect()} == {(1, 0): 2.0, (1, 1): 4.0, (1, 2): 3.0, (2, 0): 0.0}


def test_generalisation_without_extremes_and_moments_without_rows(spark):
    rows = spark.createDataFrame([("a", 2000, 1.0, 1.2, 1.1, 5.0), ("b", 2000, 2.0, 2.1, 2.2, 5.0)], "region string, year int, y double, y_pred double, ref_trend double, ref_sigma double")
    got = tiers.generalisation(rows).collect()
    assert [(r.partition, r.n, r.base_rate_extreme, r.r_sp) for r in got] == [("in_domain", 2, None, 1.0)]
    late = spark.createDataFrame([(1.0, False), (3.0, False), (2.0, True), (float("nan"), True)], "v double, late boolean")
    m = comparison.moments(late, value="v", group="late").collect()[0]
    assert (m.n_train, m.n_test, m.mean_train) == (2, 1, None)
    band = evaluation.residual_band(rows, rows.where("year = 1990")).collect()
    assert [r.low_conf for r in band] == [None, None]


def test_the_panel_is_computed_once(spark, sf):
    plan = registry.queries()["reference_forecasts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in plan and "Scan ExistingRDD" in plan
