"""Queries of the whole evaluation: prepared frame, all tiers, shift context, first test years, national model, file reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.operators import protocol, splits
from furrow.plans.protocol import _RANKED, _TOLERANCE, _ranked
from furrow.plans.registry import _DRIVERS, _FOLDS, _FOUR, _GATE, _MARGIN, _PIN, _POINT, _QS, _QUANT, FRAME, PANEL, REF, R, _driver_flags, frame, query, rounded, settled_panel, table

_LEVELS = {t: q for q, t in _QS}
_BANDS = {"trend": "ref_gated", "ols": "ref_trend", "climatology": "ref_climatology", "rolling3": "ref_rolling3"}


def _band(center: str, k: int) -> str:
    return f"({center} + zq[{k}] * ref_sigma)"


def _crps(center: str | None = None, names: dict | None = None) -> str:
    """CRPS of the own quantiles, of others in their place, or of a band around a reference."""
    q = [(_band(center, k) if center else (names or {}).get(n, n), t) for k, (n, t) in enumerate(_QS, 1)]
    return "avg(2 * (" + " + ".join(_PIN(x, t) for x, t in q) + ") / 3)"


def _within(low: str, high: str) -> str:
    return f"avg(CASE WHEN y BETWEEN {low} AND {high} THEN 1.0 ELSE 0.0 END)"


_ERRORS = {"rmse": "sqrt(avg((y - {0}) ** 2))", "mae": "avg(abs(y - {0}))"}
_ACCURACY = ", ".join([
    _POINT, *[R(e.format(x), f"{n}_ref_{k}") for k, x in _FOUR.items() for n, e in _ERRORS.items()],
    *[R(f"1 - {e.format('y_pred')} / {e.format(x)}", f"skill_{n}_vs_{k}") for k, x in _FOUR.items() for n, e in _ERRORS.items()], _TOLERANCE,
])
_CONF = {"q10": "q10_conf", "q90": "q90_conf"}
_UNCERTAINTY = ", ".join([
    _QUANT, "0.8::DOUBLE AS picp_nominal", *[R(_crps(x), f"crps_ref_{k}") for k, x in _BANDS.items()], *[R(f"1 - {_crps()} / {_crps(x)}", f"skill_crps_vs_{k}") for k, x in _BANDS.items()],
    *[R(_within(_band(x, 1), _band(x, 3)), f"picp_ref_{k}") for k, x in _BANDS.items()], *[R(f"avg({_band(x, 3)} - {_band(x, 1)})", f"width_ref_{k}") for k, x in _BANDS.items()],
    R(_within("q10_conf", "q90_conf"), "picp_conformal"), R("avg(q90_conf - q10_conf)", "width_conformal"), R(_crps(names=_CONF), "crps_conformal"), R("any_value(margin)", "conformal_margin"),
])
_RMSE = "sqrt(avg((y - y_pred) ** 2))"
_SAFE = "CASE WHEN ref_sigma > 0 THEN ref_sigma ELSE 1 END"

_SQL = f"""WITH {REF}, {_GATE}, {_MARGIN}, {_DRIVERS},
cf AS (
  SELECT four.*, y - ref_trend AS a, y_pred - ref_trend AS b, margin, greatest(q10 - margin, 0) AS q10_conf, q90 + margin AS q90_conf, fl.driver_extreme AS flag
  FROM four LEFT JOIN fl ON fl.region = four.region AND fl.year = four.year, margin),
acc AS (SELECT {_ACCURACY} FROM cf), unc AS (SELECT {_UNCERTAINTY} FROM cf),
bound AS (SELECT quantile_cont(CAST(flag AS DOUBLE), 0.9) AS v FROM cf),
parts AS (
  SELECT *, 'in_domain' AS part FROM cf UNION ALL SELECT *, 'extreme_label' FROM cf WHERE a < -ref_sigma UNION ALL SELECT cf.*, 'extreme_driver' FROM cf, bound WHERE flag >= v),
sp AS (SELECT quantile_cont(r, 0.5) AS r_sp FROM (SELECT CASE WHEN count(*) >= 2 THEN corr(y, y_pred) END AS r FROM cf GROUP BY year)),
tm AS (SELECT quantile_cont(r, 0.5) AS r_tm FROM (SELECT CASE WHEN count(*) >= 3 THEN corr(y, y_pred) END AS r FROM cf GROUP BY region)),
an AS (SELECT corr(u, v) AS r_an FROM (SELECT y - avg(y) OVER (PARTITION BY region) AS u, y_pred - avg(y) OVER (PARTITION BY region) AS v FROM cf)),
agree AS (SELECT CAST(count(*) FILTER (WHERE coalesce(a < -ref_sigma, false) AND coalesce(flag = 1, false)) AS DOUBLE) / nullif(count(*) FILTER (WHERE coalesce(a < -ref_sigma, false) OR coalesce(flag = 1, false)), 0) AS rate FROM cf),
m AS (
  SELECT part, CAST(count(*) AS DOUBLE) AS n, {_RMSE} AS rmse, 1 - {_RMSE} / nullif(sqrt(avg((y - ref_gated) ** 2)), 0) AS skill, CASE WHEN count(*) >= 3 THEN corr(a, b) END AS r_an, stddev_pop(b) / nullif(stddev_pop(a), 0) AS spread,
    1 - sum((a - b) ** 2) / nullif(var_pop(a) * count(*), 0) AS r2_an, sqrt(avg((a - b) ** 2)) / avg(abs(a)) AS nrmse_an FROM parts GROUP BY part),
gen AS (
  SELECT part, CASE WHEN part <> 'in_domain' THEN n / (SELECT count(*) FROM cf) END AS base_rate_extreme, n, rmse, skill AS skill_rmse_vs_trend, m.r_an AS r_an_detrended, spread AS anomaly_spread_ratio,
    {', '.join(f"CASE WHEN part = 'in_domain' THEN {x} END AS {k}" for x, k in (('r_sp', 'r_sp'), ('r_tm', 'r_tm'), ('an.r_an', 'r_an_window'), ('r2_an', 'r2_an'), ('nrmse_an', 'nrmse_an')))},
    CASE WHEN part = 'extreme_driver' THEN rate END AS agreement_rate FROM m, sp, tm, an, agree),
l AS (SELECT k, a < -k * ref_sigma AS e, b < -k * ref_sigma AS al, round(-b / ({_SAFE}), 9) AS s1, round(-(q10 - ref_trend) / ({_SAFE}), 9) AS s2 FROM cf, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) AS t(k)),
mid AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY s1) + (count(*) OVER (PARTITION BY k, s1) - 1) / 2.0::DOUBLE AS r1, rank() OVER (PARTITION BY k ORDER BY s2) + (count(*) OVER (PARTITION BY k, s2) - 1) / 2.0::DOUBLE AS r2 FROM l),
t AS (SELECT k, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE e) AS DOUBLE) AS e, count(*) FILTER (WHERE al) AS al, count(*) FILTER (WHERE e AND al) AS h, sum(r1) FILTER (WHERE e) AS r1, sum(r2) FILTER (WHERE e) AS r2 FROM mid GROUP BY k),
ops AS (
  SELECT k, e / n AS base_rate, CASE WHEN e > 0 AND e < n THEN coalesce(h / nullif(al, 0), 0) END AS precision, CASE WHEN e > 0 AND e < n THEN h / e END AS recall, CASE WHEN e > 0 AND e < n THEN coalesce(2 * h / nullif(al + e, 0), 0) END AS f1,
    (r1 - e * (e + 1) / 2) / nullif(e * (n - e), 0) AS auc, (r2 - e * (e + 1) / 2) / nullif(e * (n - e), 0) AS auc_low FROM t),
cap AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(-b) / nullif(avg(-a), 0) AS c FROM cf WHERE a <= (SELECT quantile_cont(a, 0.1) FROM cf) + 1e-12),
long AS (
  SELECT 'accuracy' AS tier, 'all' AS partition, metric, value FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM acc) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(*)))
  UNION ALL SELECT 'uncertainty', 'all', metric, value FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM unc) UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(*)))
  UNION ALL SELECT 'generalisation', part, metric, value FROM gen UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE part)))
  UNION ALL SELECT 'operational', 'all', 'badyear_' || CASE k WHEN 0.5 THEN '0.5' ELSE '1' END || 'sig_' || metric, value FROM ops UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE k)))
  UNION ALL SELECT 'operational', 'all', 'shortfall_n', n FROM cap UNION ALL SELECT 'operational', 'all', 'shortfall_capture', c FROM cap)
SELECT tier, partition, metric, {R('value', 'value')} FROM long"""


@query(_SQL)
def evaluation_protocol(spark, sf_dir):
    """All metrics of the four tiers in one table: four references with a band each, conformal quantiles of 1999's scores, driver flags; the gate is at |z| > 0.5."""
    p = settled_panel(spark, sf_dir)
    f = frame(spark, sf_dir, p)
    made = protocol.prepare(f.where("year >= 2000"), p.where("year <= 1999"), f.where("year = 1999"), levels=_LEVELS, z_limit=0.5)
    return rounded(protocol.evaluate(protocol.flagged(made, _driver_flags(spark, sf_dir)), levels=_LEVELS))


@query(f"""WITH RECURSIVE {_RANKED}, s AS (SELECT n_nationkey AS region, ['far', 'near', 'none'][n_nationkey % 4 + 1] AS shift_class, 0.5 + n_nationkey / 100.0::DOUBLE AS auc, n_nationkey / 100.0::DOUBLE AS auc_debiased, CASE WHEN n_nationkey % 8 > 0 THEN n_nationkey % 5 END AS n_shifted FROM nation WHERE n_nationkey % 4 <> 3)
SELECT metric, arm, coalesce(shift_class, 'unknown') AS shift_class, count(*) AS n, {R('avg(r.value)', 'mean_m_arm')}, {R('avg(base)', 'mean_m_b0')}, {', '.join(R(f'avg({x})', f'mean_{x}') for x in ('auc', 'auc_debiased', 'n_shifted'))}
FROM ranked r LEFT JOIN s USING (region) GROUP BY ALL""")
def shift_context(spark, sf_dir):
    """Regions stand for countries; every fourth has no shift class."""
    key = F.col("n_nationkey").cast("int")
    shift = table(spark, sf_dir, "nation").where(key % 4 != 3).select(
        F.col("n_nationkey").alias("region"), F.element_at(F.array(*map(F.lit, ("far", "near", "none"))), key % 4 + 1).alias("shift_class"),
        (F.lit(0.5) + key / 100).alias("auc"), (key / 100).alias("auc_debiased"), F.when(key % 8 > 0, key % 5).alias("n_shifted"),
    )
    return rounded(protocol.shift_context(_ranked(spark, sf_dir), shift, place=["region"], keys=["metric", "arm"]))


@query(f"""WITH {FRAME}, {_FOLDS}, f AS (SELECT fold, year, sqrt(avg((y - y_pred) ** 2)) AS rmse, avg(abs(y - y_pred)) AS mae FROM frame JOIN folds ON year > train_end GROUP BY 1, 2),
g AS (SELECT fold, arg_min(rmse, year) AS rmse, arg_min(mae, year) AS mae FROM f GROUP BY fold)
SELECT count(*) AS folds, {', '.join(R(f'{e}({x})', f'{x}_{n}') for x in ('rmse', 'mae') for n, e in (('mean', 'avg'), ('std_pop', 'stddev_pop')))} FROM g""")
def first_test_years(spark, sf_dir):
    p = settled_panel(spark, sf_dir)
    y, y_pred = F.col("y"), F.col("y_pred")
    scored = splits.later_rows(splits.walk_forward(p, folds=3), frame(spark, sf_dir, p)).groupBy("fold", "year").agg(c.rmse(y, y_pred).alias("rmse"), c.mae(y, y_pred).alias("mae"))
    return rounded(protocol.first_test_year(scored, ["rmse", "mae"]))


@query(f"""WITH {PANEL}, m AS (SELECT region, year, y, CASE WHEN region >= year % 3 THEN 100.0::DOUBLE + year END AS y_pred FROM panel)
SELECT year, {R('avg(y)', 'y')}, {R('max(y_pred)', 'y_pred')}, count(y) AS regions FROM m GROUP BY year""")
def national_model(spark, sf_dir):
    """A model that gives one value a year, repeated in the regions' rows; in some years the first regions lack it."""
    rows = settled_panel(spark, sf_dir).withColumn("y_pred", F.when(F.col("region") >= F.col("year") % 3, F.lit(100.0) + F.col("year")))
    return rounded(protocol.national_model(rows))


@query("""WITH orders_ AS (
  SELECT 'yield' AS file, count(*) AS row_count, '' AS missing, count(*) - count(DISTINCT (o_custkey, year(o_orderdate))) AS duplicate_rows, CAST(0 AS BIGINT) AS bad_years, CAST(min(year(o_orderdate)) AS INTEGER) AS first_year,
    CAST(max(year(o_orderdate)) AS INTEGER) AS last_year, '' AS missing_years, count(*) FILTER (WHERE o_totalprice > 300000 OR o_totalprice < 0) AS violations, 'failed' AS status FROM orders)
SELECT * FROM orders_
UNION ALL SELECT 'soil', count(*), '', 0, 0, -1, -1, '', 0, 'ok' FROM nation
UNION ALL SELECT 'location', -1, 'latitude,longitude', -1, -1, -1, -1, '-', -1, 'missing columns'
UNION ALL SELECT 'ndvi', -1, '', -1, -1, -1, -1, '-', -1, 'absent'
UNION ALL SELECT 'fpar', 0, '', 0, 0, -1, -1, '', 0, 'empty'""")
def file_reports(spark, sf_dir):
    """Orders as the yield file of customers and years, nations as soil and as a location file that lacks its columns; what a file doesn't have is -1 or a dash."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("adm_id"), F.year("o_orderdate").alias("harvest_year"), F.col("o_totalprice").alias("yield"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("adm_id"), F.col("n_regionkey").alias("awc"))
    files: dict[str, DataFrame | None] = {"yield": orders, "soil": nation, "location": nation, "ndvi": None, "fpar": nation.where("adm_id < 0")}
    required = {"yield": ["adm_id", "harvest_year", "yield"], "soil": ["adm_id", "awc"], "location": ["adm_id", "latitude", "longitude"], "ndvi": ["adm_id"], "fpar": ["adm_id"]}
    report = protocol.file_report(files, required, unique={"yield": ["adm_id", "harvest_year"], "soil": ["adm_id"]}, years={"yield": "harvest_year"}, bounds={"yield": {"yield": (0.0, 300000.0)}, "soil": {"awc": (0.0, 100.0)}})
    return report.na.fill(-1).na.fill("-")
