"""The evaluation protocol and its smaller parts on hand-made rows."""

import pytest

from furrow.operators import protocol


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(f"r{i}", 2000 + t, 10.0 + i + t % 3, 10.5 + i + (t * i) % 2, 9.0 + i, 12.0 + i) for i in range(5) for t in range(12)]
    f = spark.createDataFrame(rows, "region string, year int, y double, y_pred double, q10 double, q90 double")
    return f.where("year >= 2009"), f.where("year < 2008").select("region", "year", "y"), f.where("year = 2008")


def test_only_the_tiers_asked_for(spark, frames):
    test, train, val = frames
    levels = {0.1: "q10", 0.9: "q90"}
    made = protocol.prepare(test, train, val, levels=levels)
    assert {"ref_gated", "trend_q10", "climatology_q90", "rolling3_q10", "q10_conf", "conformal_margin", "anom_low"} <= set(made.columns) and made.count() == test.count()
    got = protocol.evaluate(made, ["accuracy", "uncertainty"], levels=levels).collect()
    assert {r.tier for r in got} == {"accuracy", "uncertainty"}
    names = {r.metric for r in got}
    assert {f"skill_crps_vs_{k}" for k in protocol.REFERENCES} | {f"rmse_ref_{k}" for k in protocol.REFERENCES} | {"picp_conformal", "conformal_margin"} <= names
    plain = protocol.prepare(test, train)
    assert {r.tier for r in protocol.evaluate(plain, ["uncertainty", "operational"]).collect()} == {"operational"}
    assert protocol.evaluate(plain, ["uncertainty"]).count() == 0
    with pytest.raises(ValueError, match="unknown tiers: accurate"):
        protocol.evaluate(plain, ["accurate"])
    low = {r.metric: r.value for r in protocol.evaluate(plain, ["operational"]).collect()}
    assert low["badyear_1sig_auc_low"] is None and "shortfall_capture" in low


def test_rows_without_a_driver_stay(spark, frames):
    test, train, _ = frames
    flags = spark.createDataFrame([("r0", 2009, 1), ("r1", 2009, 0)], "region string, year int, driver_extreme int")
    made = protocol.flagged(protocol.prepare(test, train), flags)
    assert made.count() == test.count()
    rows = {(r.partition, r.metric): r.value for r in protocol.evaluate(made, ["generalisation"]).collect()}
    assert rows["in_domain", "n"] == test.count() and rows["extreme_driver", "n"] == 1 and rows["in_domain", "agreement_rate"] is None
    assert rows["extreme_driver", "base_rate_extreme"] == pytest.approx(1 / test.count())


def test_small_tables(spark):
    folds = spark.createDataFrame([(1, 2001, 4.0), (1, 2000, 2.0), (2, 2002, 6.0)], "fold int, year int, rmse double")
    r = protocol.first_test_year(folds, ["rmse"]).first()
    assert (r.folds, r.rmse_mean, r.rmse_std_pop) == (2, 4.0, 2.0)
    rows = spark.createDataFrame([("a", 2000, 1.0, None), ("b", 2000, 3.0, 7.0), ("c", 2000, None, 8.0), ("a", 2001, 1.0, None)], "region string, year int, y double, y_pred double")
    assert [tuple(r) for r in protocol.national_model(rows).collect()] == [(2000, 2.0, 7.0, 2)]
    ranking = spark.createDataFrame([("x", "rmse", 1.0, 2.0), ("y", "rmse", 3.0, None)], "place string, metric string, value double, base double")
    shift = spark.createDataFrame([("x", "far", 0.9, None)], "place string, shift_class string, auc double, auc_debiased double").withColumn("n_shifted", protocol.F.lit(2))
    got = {r.shift_class: r for r in protocol.shift_context(ranking, shift, place=["place"], keys=["metric"]).collect()}
    assert (got["far"].mean_m_arm, got["far"].mean_auc, got["far"].mean_auc_debiased, got["far"].mean_n_shifted) == (1.0, 0.9, None, 2.0)
    assert (got["unknown"].mean_m_arm, got["unknown"].mean_m_b0, got["unknown"].mean_auc) == (3.0, None, None)


def test_file_report_ends_early(spark):
    rows = spark.createDataFrame([("a", "2000", "1"), ("a", "2000", "x"), ("b", "2003", "9"), ("c", "oops", None)], "adm_id string, harvest_year string, value string")
    files = {"yield": rows, "gone": None, "short": rows.drop("value"), "none": rows.where("false"), "free": rows}
    required = {k: ["adm_id", "value"] for k in files}
    report = {r.file: r for r in protocol.file_report(files, required, unique={"yield": ["adm_id", "harvest_year"]}, years={"yield": "harvest_year"}, bounds={"yield": {"value": (0.0, 5.0)}}).collect()}
    r = report["yield"]
    assert (r.row_count, r.duplicate_rows, r.bad_years, r.first_year, r.last_year, r.missing_years, r.violations, r.status) == (4, 1, 1, 2000, 2003, "2001,2002", 2, "failed")
    assert {k: v.status for k, v in report.items()} == {"yield": "failed", "gone": "absent", "short": "missing columns", "none": "empty", "free": "ok"}
    assert report["short"].missing == "value" and report["gone"].row_count is None and report["free"].duplicate_rows == 0
