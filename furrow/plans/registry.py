"""Named queries over the synthetic tables, each beside its SQL.

Bindings: ``panel`` is the mean order value (thousands) by nation and year; ``frame`` predicts a year by
the year before, with quantiles 10 % around; ``daily`` is lineitem by supplier nation and ship day, read
as temperature, precipitation and radiation. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d
from furrow.operators import comparison, contract, evaluation, features, multiyear, order, ranking, reference, series, shift, spectral, splits, tiers
from furrow.session import settled
from furrow.sources import tables
from furrow.streaming import events

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

PANEL = """panel AS (
  SELECT c_nationkey AS region, CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice) / 1000, 9) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
FRAME = PANEL + """, frame AS (
  SELECT p.region, p.year, p.y, b.y AS y_pred, b.y * 0.9::DOUBLE AS q10, b.y AS q50, b.y * 1.1::DOUBLE AS q90
  FROM panel p JOIN panel b ON p.region = b.region AND p.year = b.year + 1)"""
DAILY = """daily AS (
  SELECT s_nationkey AS region, CAST(l_shipdate AS DATE) AS day, round(avg(l_quantity), 9) AS tavg, min(l_quantity) - 5 AS tmin, max(l_quantity) AS tmax,
    round(100 * avg(l_discount), 9) AS prec, round(100 * avg(l_tax), 9) AS rad
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
REF = FRAME + """, train AS (SELECT * FROM panel WHERE year <= 1999),
fit AS (
  SELECT region, avg(y) AS climatology, avg(y) FILTER (WHERE newest <= 3) AS rolling3,
    CASE WHEN count(*) >= 5 THEN coalesce(regr_slope(y, year), 0) ELSE 0 END AS slope, avg(year) AS my, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY year DESC) AS newest FROM train) GROUP BY region),
coef AS (SELECT *, climatology - slope * my AS intercept FROM fit),
rest AS (SELECT t.region, t.y, coef.n, t.y - intercept - slope * t.year AS e FROM train t JOIN coef USING (region)),
own AS (SELECT region, CASE WHEN max(n) >= 5 THEN stddev_samp(e) END AS sigma FROM rest GROUP BY region),
whole AS (SELECT avg(y) AS overall, stddev_samp(e) AS pooled FROM rest),
zs AS (SELECT quantile_cont(e / coalesce(sigma, pooled), [0.1, 0.5, 0.9]) AS zq FROM rest JOIN own USING (region), whole),
ref AS (
  SELECT f.*, coalesce(climatology, overall) AS ref_climatology, coalesce(rolling3, overall) AS ref_rolling3, coalesce(intercept + slope * f.year, overall) AS ref_trend,
    coalesce(sigma, pooled) AS ref_sigma, f.year - 1999 AS horizon, zq
  FROM frame f LEFT JOIN coef USING (region) LEFT JOIN own USING (region), whole, zs WHERE f.year >= 2000),
anom AS (SELECT *, y - ref_trend AS anom_true, y_pred - ref_trend AS anom_pred FROM ref)"""


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where it has one."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return rows.groupBy(F.col("c_nationkey").alias("region"), F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice") / 1000, 9).alias("y"))


def settled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel (a row per region and year), computed once for plans that read it several times."""
    return settled(panel(spark, sf_dir))


def frame(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """Predictions of the panel ``p``, or of one settled here: the lag joins it with itself."""
    rows = features.lags(settled_panel(spark, sf_dir) if p is None else p, steps=(1,)).where("lag_1 IS NOT NULL").withColumnRenamed("lag_1", "y_pred")
    return rows.withColumns({"q10": F.col("y_pred") * d(0.9), "q50": F.col("y_pred"), "q90": F.col("y_pred") * d(1.1)})


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    rows = line.join(supplier, line.l_suppkey == supplier.s_suppkey).groupBy(F.col("s_nationkey").alias("region"), F.to_date("l_shipdate").alias("day"))
    mean = lambda x: F.round(x, 9)
    return rows.agg(mean(F.avg("l_quantity")).alias("tavg"), (F.min("l_quantity") - 5).alias("tmin"), F.max("l_quantity").alias("tmax"), mean(100 * F.avg("l_discount")).alias("prec"), mean(100 * F.avg("l_tax")).alias("rad"))


def referenced(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """The test years with reference forecasts fitted on the years to 1999."""
    p = settled_panel(spark, sf_dir) if p is None else p
    return reference.attach(frame(spark, sf_dir, p).where("year >= 2000"), p.where("year <= 1999"))


def with_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return referenced(spark, sf_dir).withColumns({"anom_true": F.col("y") - F.col("ref_trend"), "anom_pred": F.col("y_pred") - F.col("ref_trend")})


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, minus zero to zero."""
    return df.select(*[(F.round(n, 6) + d(0)).alias(n) if t == "double" else n for n, t in df.dtypes])



def _y() -> tuple[Column, Column]:
    return F.col("y"), F.col("y_pred")


def R(x: str, name: str) -> str:
    return f"round({x}, 6) + 0 AS {name}"


_POINT = ", ".join([
    "count(y) AS n", R("avg((y - y_pred) ** 2)", "mse"), R("sqrt(avg((y - y_pred) ** 2))", "rmse"), R("avg(abs(y - y_pred))", "mae"), R("avg(abs(y - y_pred) / greatest(abs(y), 2.220446049250313e-16))", "mape"),
    R("avg(2 * abs(y - y_pred) / (abs(y) + abs(y_pred) + 1e-8))", "smape"), R("sqrt(avg((y - y_pred) ** 2)) / avg(y)", "nrmse"), R("1 - sum((y - y_pred) ** 2) / (var_pop(y) * count(*))", "r2"),
])


@query(f"WITH {PANEL} SELECT region, year, {R('y', 'y')} FROM panel")
def panel_build(spark, sf_dir):
    return rounded(panel(spark, sf_dir))


@query(f"WITH {REF} SELECT year, count(*) AS n, {R('sqrt(avg((y - y_pred) ** 2))', 'rmse')}, {R('sqrt(avg((y - ref_climatology) ** 2))', 'ref_rmse')}, {R('1 - sqrt(avg((y - y_pred) ** 2)) / sqrt(avg((y - ref_climatology) ** 2))', 'skill')}, {R('1 - sum((y - y_pred) ** 2) / (var_pop(y) * count(*))', 'r2')} FROM ref GROUP BY ROLLUP (year)")
def naive_skill_by_year(spark, sf_dir):
    y, p = _y()
    ref = c.rmse(y, F.col("ref_climatology"))
    return rounded(evaluation.by_scope(referenced(spark, sf_dir), {"n": F.count(y), "rmse": c.rmse(y, p), "ref_rmse": ref, "skill": c.skill(c.rmse(y, p), ref), "r2": c.r2(y, p)}))


@query(f"WITH {FRAME} SELECT year, {_POINT} FROM frame GROUP BY ROLLUP (year)")
def point_metrics_by_year(spark, sf_dir):
    return rounded(evaluation.by_scope(frame(spark, sf_dir), c.point_metrics(*_y())))


@query(f"WITH {FRAME}, m AS (SELECT year, {_POINT} FROM frame GROUP BY ROLLUP (year)) UNPIVOT (SELECT year, CAST(n AS DOUBLE) AS n, mse, rmse, mae, mape, smape, nrmse, r2 FROM m) ON n, mse, rmse, mae, mape, smape, nrmse, r2 INTO NAME metric VALUE value")
def metric_battery_long(spark, sf_dir):
    return rounded(evaluation.long(evaluation.by_scope(frame(spark, sf_dir), c.point_metrics(*_y())), ["year"]))


@query(f"WITH {FRAME} SELECT {', '.join(R(f'avg(CASE WHEN abs(y - y_pred) / greatest(abs(y), 1e-8) <= {s} THEN 1.0 ELSE 0.0 END)', f'within_{round(100 * s)}pct') for s in (0.01, 0.05, 0.1, 0.2))}, {', '.join(R(f'avg(CASE WHEN abs(y - y_pred) <= {s} THEN 1.0 ELSE 0.0 END)', n) for s, n in ((0.1, 'within_abs_0_1'), (0.5, 'within_abs_0_5')))} FROM frame")
def tolerance_accuracy(spark, sf_dir):
    return rounded(frame(spark, sf_dir).agg(*[v.alias(k) for k, v in c.tolerance_metrics(*_y()).items()]))


_REFS = ("climatology", "rolling3", "trend")


@query(f"WITH {REF} SELECT {', '.join(R(f'1 - sqrt(avg((y - y_pred) ** 2)) / sqrt(avg((y - ref_{r}) ** 2))', f'skill_rmse_{r}') + ', ' + R(f'1 - avg(abs(y - y_pred)) / avg(abs(y - ref_{r}))', f'skill_mae_{r}') for r in _REFS)} FROM ref")
def skill_vs_references(spark, sf_dir):
    y, p = _y()
    out = {f"skill_{n}_{r}": c.skill(f(y, p), f(y, F.col(f"ref_{r}"))) for r in _REFS for n, f in (("rmse", c.rmse), ("mae", c.mae))}
    return rounded(referenced(spark, sf_dir).agg(*[v.alias(k) for k, v in out.items()]))


@query(f"WITH {FRAME} SELECT year, {R('sqrt(avg((y - y_pred) ** 2)) / (max(y) - min(y) + 1e-6) * 100', 'range_nrmse')} FROM frame GROUP BY ROLLUP (year)")
def legacy_range_nrmse(spark, sf_dir):
    return rounded(evaluation.by_scope(frame(spark, sf_dir), {"range_nrmse": c.range_nrmse(*_y())}))


_SPATIAL = f"spatial AS (SELECT year, count(*) AS n, corr(y, y_pred) AS r, sqrt(avg((y - y_pred) ** 2)) AS rmse, sqrt(avg((y - y_pred) ** 2)) / avg(y) AS nrmse, 100 * avg(2 * abs(y - y_pred) / (abs(y) + abs(y_pred) + 1e-8)) AS smape, 1 - sum((y - y_pred) ** 2) / (var_pop(y) * count(*)) AS r2 FROM frame GROUP BY year HAVING count(*) >= 2)"
_TEMPORAL = "temporal AS (SELECT region, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(y, y_pred) END AS r, sqrt(avg((y - y_pred) ** 2)) AS rmse, avg(abs(y - y_pred)) AS mae, sqrt(avg((y - y_pred) ** 2)) / avg(y) AS nrmse, 1 - sum((y - y_pred) ** 2) / (var_pop(y) * count(*)) AS r2 FROM frame GROUP BY region)"


@query(f"WITH {FRAME}, {_SPATIAL} SELECT year, n, {R('r', 'r')}, {R('rmse', 'rmse')}, {R('nrmse', 'nrmse')}, {R('smape', 'smape')}, {R('r2', 'r2')} FROM spatial")
def spatial_corr_by_year(spark, sf_dir):
    return rounded(evaluation.spatial(frame(spark, sf_dir)))


@query(f"WITH {FRAME}, {_SPATIAL} SELECT {R('quantile_cont(r, 0.5)', 'median_r')}, count(r) AS n_r FROM spatial")
def spatial_corr_median(spark, sf_dir):
    return rounded(evaluation.median_r(evaluation.spatial(frame(spark, sf_dir))))


@query(f"WITH {FRAME}, {_TEMPORAL} SELECT region, n, {R('r', 'r')}, {R('rmse', 'rmse')}, {R('mae', 'mae')}, {R('nrmse', 'nrmse')}, {R('r2', 'r2')} FROM temporal")
def temporal_corr_by_region(spark, sf_dir):
    return rounded(evaluation.temporal(frame(spark, sf_dir)))


@query(f"WITH {FRAME}, {_TEMPORAL} SELECT {R('quantile_cont(r, 0.5)', 'median_r')}, count(r) AS n_r FROM temporal")
def temporal_corr_median(spark, sf_dir):
    return rounded(evaluation.median_r(evaluation.temporal(frame(spark, sf_dir))))


_ANOM = f"SELECT count(*) AS n, {R('corr(a, b)', 'r_an')}, {R('1 - sum((a - b) ** 2) / (var_pop(a) * count(*))', 'r2_an')}, {R('sqrt(avg((a - b) ** 2)) / avg(abs(a))', 'nrmse_an')}, {R('stddev_pop(a)', 'std_true')}, {R('stddev_pop(b)', 'std_pred')}"


@query(f"WITH {FRAME} {_ANOM} FROM (SELECT y - avg(y) OVER (PARTITION BY region) AS a, y_pred - avg(y) OVER (PARTITION BY region) AS b FROM frame)")
def anomaly_window_ref(spark, sf_dir):
    return rounded(evaluation.anomalies(frame(spark, sf_dir)))


@query(f"WITH {REF} {_ANOM} FROM (SELECT anom_true AS a, anom_pred AS b FROM anom)")
def anomaly_external_ref(spark, sf_dir):
    return rounded(evaluation.anomalies(referenced(spark, sf_dir), ref="ref_trend"))


_PIN = lambda q, t: f"greatest({t} * (y - {q}), ({t} - 1) * (y - {q}))"
_QS = (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))
_QUANT = ", ".join([
    *[R(f"avg({_PIN(q, t)})", f"pinball_{q}") for q, t in _QS], R("avg(2 * (" + " + ".join(_PIN(q, t) for q, t in _QS) + ") / 3)", "crps"), R("avg(CASE WHEN y BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END)", "picp"),
    R("avg(q90 - q10) / (max(y) - min(y))", "pinaw"), R("avg(q90 - q10 + 10 * (greatest(q10 - y, 0) + greatest(y - q90, 0)))", "winkler"), R("avg(q90 - q10)", "width"),
    *[R(f"avg(CASE WHEN y <= {q} THEN 1.0 ELSE 0.0 END)", f"coverage_{q}") for q, _ in _QS], R("(" + " + ".join(f"abs(avg(CASE WHEN y <= {q} THEN 1.0 ELSE 0.0 END) - {t})" for q, t in _QS) + ") / 3", "calibration_error"),
])


@query(f"WITH {FRAME} SELECT year, {_QUANT} FROM frame GROUP BY ROLLUP (year)")
def quantile_metrics(spark, sf_dir):
    return rounded(evaluation.by_scope(frame(spark, sf_dir), evaluation.quantile_metrics(F.col("y"), {t: F.col(q) for q, t in _QS})))


_MARGIN = """scores AS (SELECT greatest(q10 - y, y - q90) AS s, row_number() OVER (ORDER BY greatest(q10 - y, y - q90)) AS k FROM frame WHERE year = 1999),
level AS (SELECT count(*) AS n, (count(*) - 1) * least(1.0::DOUBLE, ceil((count(*) + 1) * 0.8::DOUBLE) / count(*)) AS pos FROM scores),
margin AS (
  SELECT any_value(n) AS n, max(CASE WHEN k = CAST(floor(pos) AS BIGINT) + 1 THEN s END) + (any_value(pos) - floor(any_value(pos))) * (max(CASE WHEN k = CAST(ceil(pos) AS BIGINT) + 1 THEN s END) - max(CASE WHEN k = CAST(floor(pos) AS BIGINT) + 1 THEN s END)) AS margin
  FROM scores, level)"""


@query(f"WITH {FRAME}, {_MARGIN} SELECT n, {R('margin', 'margin')} FROM margin")
def conformal_margin(spark, sf_dir):
    return rounded(evaluation.conformal_margin(frame(spark, sf_dir).where("year = 1999")))


@query(f"WITH {FRAME}, {_MARGIN} SELECT region, year, {R('greatest(q10 - margin, 0)', 'q10_conf')}, {R('q90 + margin', 'q90_conf')} FROM frame, margin WHERE year >= 2000")
def conformalized_band(spark, sf_dir):
    f = frame(spark, sf_dir)
    return rounded(evaluation.conformalize(f.where("year >= 2000"), evaluation.conformal_margin(f.where("year = 1999"))).select("region", "year", "q10_conf", "q90_conf"))


@query(f"WITH {REF}, e AS (SELECT *, anom_true < -0.5::DOUBLE * ref_sigma AS event, rank() OVER (ORDER BY round(-anom_pred / CASE WHEN ref_sigma > 0 THEN ref_sigma ELSE 1 END, 9)) + (count(*) OVER (PARTITION BY round(-anom_pred / CASE WHEN ref_sigma > 0 THEN ref_sigma ELSE 1 END, 9)) - 1) / 2.0 AS rk FROM anom) SELECT count(*) FILTER (WHERE event) AS n_events, count(*) AS n, {R('(sum(rk) FILTER (WHERE event) - count(*) FILTER (WHERE event) * (count(*) FILTER (WHERE event) + 1) / 2.0) / (count(*) FILTER (WHERE event) * count(*) FILTER (WHERE NOT event))', 'auc')} FROM e")
def badyear_auc_midrank(spark, sf_dir):
    f = with_anomalies(spark, sf_dir).select((F.col("anom_true") < -d(0.5) * F.col("ref_sigma")).alias("event"), F.round(-F.col("anom_pred") / F.when(F.col("ref_sigma") > 0, F.col("ref_sigma")).otherwise(d(1)), 9).alias("score"))
    return rounded(order.auc(f, score="score", event="event"))


@query(f"WITH {REF}, e AS (SELECT CAST(anom_true < -0.5::DOUBLE * ref_sigma AS INTEGER) AS e, CAST(anom_pred < -0.5::DOUBLE * ref_sigma AS INTEGER) AS a FROM anom), t AS (SELECT count(*) AS n, sum(e) AS e, sum(a) AS a, sum(e * a) AS h FROM e) SELECT n, {R('e / n', 'base_rate')}, {R('coalesce(h / nullif(a, 0), 0)', 'precision')}, {R('h / e', 'recall')}, {R('coalesce(2 * h / nullif(a + e, 0), 0)', 'f1')} FROM t")
def badyear_prf(spark, sf_dir):
    return rounded(evaluation.bad_years(with_anomalies(spark, sf_dir)))


@query(f"WITH {REF}, b AS (SELECT quantile_cont(anom_true, 0.1) AS bound FROM anom) SELECT count(*) AS n, {R('avg(-anom_pred) / avg(-anom_true)', 'capture')} FROM anom, b WHERE anom_true <= bound")
def shortfall_capture(spark, sf_dir):
    return rounded(evaluation.shortfall_capture(with_anomalies(spark, sf_dir)))


@query(f"WITH {REF} SELECT region, year, {', '.join(R(x, x) for x in ('ref_climatology', 'ref_rolling3', 'ref_trend', 'ref_sigma'))}, CAST(horizon AS INTEGER) AS horizon, {', '.join(R(f'ref_trend + zq[{k}] * ref_sigma', f'ref_{q}') for k, (q, _) in enumerate(_QS, 1))} FROM ref")
def reference_forecasts(spark, sf_dir):
    return rounded(referenced(spark, sf_dir).select("region", "year", "ref_climatology", "ref_rolling3", "ref_trend", "ref_sigma", "horizon", "ref_q10", "ref_q50", "ref_q90"))


@query(f"WITH {REF} SELECT {R('1 - avg(2 * (' + ' + '.join(_PIN(q, t) for q, t in _QS) + ') / 3) / avg(2 * (' + ' + '.join(_PIN(f'(ref_trend + zq[{k}] * ref_sigma)', t) for k, (q, t) in enumerate(_QS, 1)) + ') / 3)', 'crps_skill')} FROM ref")
def crps_skill_vs_reference(spark, sf_dir):
    y = F.col("y")
    return rounded(referenced(spark, sf_dir).agg(c.skill(c.crps(y, {t: F.col(q) for q, t in _QS}), c.crps(y, {t: F.col(f"ref_{q}") for q, t in _QS})).alias("crps_skill")))


@query(f"WITH {PANEL}, s AS (SELECT a.region, quantile_cont((b.y - a.y) / (b.year - a.year), 0.5) AS slope FROM panel a JOIN panel b ON a.region = b.region AND a.year < b.year GROUP BY a.region), m AS (SELECT region, quantile_cont(CAST(year AS DOUBLE), 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM panel GROUP BY region) SELECT region, {R('slope', 'slope')}, {R('my - slope * mx', 'intercept')} FROM m JOIN s USING (region)")
def theil_sen(spark, sf_dir):
    return rounded(reference.theil_sen(panel(spark, sf_dir)))


@query(f"""WITH {PANEL}, r AS (SELECT region, year AS x, y AS v, row_number() OVER (PARTITION BY region ORDER BY year DESC) AS back FROM panel),
w AS (SELECT region, x, v, k AS length FROM r, range(5, 11) AS t(k) WHERE back <= k AND back <= 10),
sz AS (SELECT region, length, count(*) AS n, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept FROM w GROUP BY ALL HAVING count(*) = length),
ss AS (SELECT a.region, a.length, sum(sign(b.v - a.v)) AS s FROM w a JOIN w b ON a.region = b.region AND a.length = b.length AND a.x < b.x GROUP BY ALL),
tt AS (SELECT region, length, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT region, length, v, count(*) AS t FROM w GROUP BY ALL) GROUP BY ALL),
z AS (SELECT region, length, slope, intercept, round((s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18.0::DOUBLE), 9) AS z FROM sz JOIN ss USING (region, length) JOIN tt USING (region, length)),
k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY abs(z) DESC, length) AS o FROM z WHERE abs(z) > 0.5)
SELECT region, CAST(length AS INTEGER) AS length, {R('z', 'z')}, {R('slope', 'slope')}, {R('intercept', 'intercept')} FROM k WHERE o = 1""")
def mann_kendall_windows(spark, sf_dir):
    """With a low limit on |z|: seven years of random orders hold no trend at the usual one."""
    return rounded(reference.mann_kendall(panel(spark, sf_dir), z_limit=0.5))


@query(f"WITH {FRAME} SELECT region, {R('avg(y) - avg(y_pred)', 'bias_offset')}, {R('avg(y) / avg(y_pred)', 'factor')}, {R('regr_slope(y, y_pred)', 'slope')}, {R('regr_intercept(y, y_pred)', 'intercept')} FROM frame WHERE year <= 1999 GROUP BY region")
def bias_by_region(spark, sf_dir):
    return rounded(reference.bias_table(frame(spark, sf_dir).where("year <= 1999"), by=("region",)).withColumnRenamed("offset", "bias_offset"))


@query(f"""WITH {FRAME}, m AS (SELECT quantile_cont(y_pred, [x / 20.0::DOUBLE FOR x IN range(0, 21)]) AS qp, quantile_cont(y, [x / 20.0::DOUBLE FOR x IN range(0, 21)]) AS qy FROM frame WHERE year <= 1999),
a AS (SELECT region, year, y_pred, qp, qy, greatest(1, least(20, len(list_filter(qp, lambda q: q <= y_pred)))) AS k FROM frame, m WHERE year >= 2000)
SELECT region, year, {R('qy[k] + least(greatest(CASE WHEN qp[k + 1] > qp[k] THEN (y_pred - qp[k]) / (qp[k + 1] - qp[k]) ELSE 0 END, 0), 1) * (qy[k + 1] - qy[k])', 'mapped')} FROM a""".replace("quantile_cont(y_pred, [x / 20.0::DOUBLE FOR x IN range(0, 21)])", "quantile_cont(y_pred, [" + ", ".join(str(k / 20) for k in range(21)) + "])").replace("quantile_cont(y, [x / 20.0::DOUBLE FOR x IN range(0, 21)])", "quantile_cont(y, [" + ", ".join(str(k / 20) for k in range(21)) + "])"))
def bias_quantile_map(spark, sf_dir):
    f = frame(spark, sf_dir)
    return rounded(reference.quantile_map(f.where("year >= 2000"), f.where("year <= 1999")).select("region", "year", "mapped"))


@query(f"WITH {PANEL}, r AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS b FROM (SELECT DISTINCT year FROM panel)) SELECT year, CASE WHEN b <= 2 THEN 'test' WHEN b <= 3 THEN 'val' ELSE 'train' END AS split FROM r")
def fixed_split(spark, sf_dir):
    return splits.fixed_split(panel(spark, sf_dir))


_FOLDS = "folds AS (SELECT row_number() OVER (ORDER BY year) AS fold, year - 1 AS train_end, year AS test_year FROM (SELECT DISTINCT year FROM panel) WHERE year >= 1999)"


@query(f"WITH {PANEL}, {_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, CAST(train_end AS INTEGER) AS train_end, test_year FROM folds")
def walk_forward_folds(spark, sf_dir):
    return splits.walk_forward(panel(spark, sf_dir), folds=3)


@query(f"WITH {FRAME}, {_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, year, count(*) AS n, {R('sqrt(avg((y - y_pred) ** 2))', 'rmse')} FROM frame JOIN folds ON year > train_end GROUP BY 1, 2")
def walk_forward_future_metrics(spark, sf_dir):
    p = settled_panel(spark, sf_dir)
    return rounded(splits.later_rows(splits.walk_forward(p, folds=3), frame(spark, sf_dir, p)).groupBy("fold", "year").agg(F.count("*").alias("n"), c.rmse(*_y()).alias("rmse")))


@query(f"WITH {PANEL}, t AS (SELECT DISTINCT year FROM panel WHERE year >= 2000) SELECT a.year, CAST(b.year AS INTEGER) AS lag_year FROM t a JOIN t b ON b.year BETWEEN a.year - 3 AND a.year - 1")
def lag_leakage_years(spark, sf_dir):
    return splits.leaking_years(splits.fixed_split(panel(spark, sf_dir)))


@query(f"WITH {PANEL}, p AS (SELECT * FROM panel WHERE (region + year) % 3 <> 0), b AS (SELECT region, min(year) AS a, max(year) AS z FROM p GROUP BY region) SELECT region, CAST(y AS INTEGER) AS missing FROM (SELECT region, unnest(range(a, z + 1)) AS y FROM b) g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.region = g.region AND p.year = g.y)")
def year_gaps(spark, sf_dir):
    return splits.year_gaps(panel(spark, sf_dir).where("(region + year) % 3 <> 0"), key="region")


@query(f"WITH {PANEL} SELECT p.region, p.year, {R('p.y', 'y')}, {R('a.y', 'lag_1')}, {R('b.y', 'lag_2')}, {R('c.y', 'lag_3')} FROM panel p LEFT JOIN panel a ON p.region = a.region AND p.year = a.year + 1 LEFT JOIN panel b ON p.region = b.region AND p.year = b.year + 2 LEFT JOIN panel c ON p.region = c.region AND p.year = c.year + 3")
def lag_features_keyed(spark, sf_dir):
    return rounded(features.lags(panel(spark, sf_dir)))


@query(f"""WITH {DAILY}, g AS (SELECT *, greatest(least(tavg, 30) - 10, 0) AS gdd FROM daily),
s AS (SELECT *, sum(gdd) OVER w AS cum_gdd, sum(prec) OVER w AS cum_prec, sum(rad) OVER w AS cum_rad FROM g WINDOW w AS (PARTITION BY region, year(day) ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT region, day, {R('gdd', 'gdd')}, {R('cum_gdd', 'cum_gdd')}, {R('cum_prec', 'cum_prec')}, {R('cum_rad', 'cum_rad')}, {R('0.48::DOUBLE * cum_rad * exp(-((tavg - 25) ** 2) / 98.0::DOUBLE) * prec / (prec + 300 + 1e-9)', 'rue_index')} FROM s""")
def seasonal_sums(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("year", F.year("day"))
    return rounded(features.seasonal_sums(rows, ["region", "year"], "day", "maize").select("region", "day", "gdd", "cum_gdd", "cum_prec", "cum_rad", "rue_index"))


@query(f"WITH {DAILY} SELECT region, CAST(year(day) AS INTEGER) AS year, count(*) FILTER (WHERE tmax > 35) AS heat_days, count(*) FILTER (WHERE tmin < 0) AS frost_days, count(*) FILTER (WHERE tmin < 5) AS cold_days, count(*) FILTER (WHERE prec < 1) AS dry_days, count(*) FILTER (WHERE prec > 10) AS wet_days, {R('count(*) FILTER (WHERE tmax > 35) / greatest(count(tavg), 1)', 'heat_share')}, {R('count(*) FILTER (WHERE prec < 1) / greatest(count(tavg), 1)', 'dry_share')} FROM daily GROUP BY 1, 2")
def heat_stress_counts(spark, sf_dir):
    return rounded(features.stress_counts(daily(spark, sf_dir).withColumn("year", F.year("day")), ["region", "year"], "maize"))


_TWO_PI = "6.283185307179586::DOUBLE"
_PLACE = "least(greatest(date_diff('day', make_date(year(day), 3, 1), day) / 214.0::DOUBLE, 0), 1)"


@query(f"WITH {DAILY} SELECT region, day, " + ", ".join(R(f"{f}({_TWO_PI} * {v})", f"{k}_{f}") for k, v in (("doy", "(dayofyear(day) / 365.0::DOUBLE)"), ("month", "((month(day) - 1) / 12.0::DOUBLE)"), ("season", _PLACE)) for f in ("sin", "cos")) + " FROM daily")
def calendar_encodings(spark, sf_dir):
    first = F.make_date(F.year("day"), F.lit(3), F.lit(1))
    last = F.make_date(F.year("day"), F.lit(10), F.lit(1))
    return rounded(daily(spark, sf_dir).select("region", "day", *[v.alias(k) for k, v in c.calendar_encodings(F.col("day"), first, last).items()]))


_LABELS = ("Cfa", "BSh", "Aw", "ET", "NoData", "Xyz", "D")


@query("WITH l AS (SELECT n_nationkey, ['Cfa', 'BSh', 'Aw', 'ET', 'NoData', 'Xyz', 'D'][n_nationkey % 7 + 1] AS label FROM nation) SELECT n_nationkey, label, CASE label WHEN 'Cfa' THEN 3 WHEN 'BSh' THEN 2 WHEN 'Aw' THEN 1 WHEN 'ET' THEN 5 END AS climate_group, CASE label WHEN 'Cfa' THEN 1 WHEN 'BSh' THEN 6 WHEN 'Aw' THEN 4 WHEN 'ET' THEN 7 END AS climate_moisture, CASE label WHEN 'Cfa' THEN 1 WHEN 'BSh' THEN 5 WHEN 'Aw' THEN 0 WHEN 'ET' THEN 0 WHEN 'Xyz' THEN 0 END AS climate_heat FROM l")
def climate_decode(spark, sf_dir):
    labels = F.array(*map(F.lit, _LABELS))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(labels, F.col("n_nationkey") % 7 + 1).alias("label"))
    return features.decode(rows, c.climate_ordinals(F.col("label")))


@query(f"WITH {PANEL}, s AS (SELECT avg(y) AS m, stddev_pop(y) AS s FROM panel WHERE year <= 1999) SELECT region, year, {R('(y - m) / s', 'y')} FROM panel, s")
def zscore_train_only(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(features.apply_scale(p, features.fit_scale(p.where("year <= 1999"), ["y"]), ["y"]))


@query(f"WITH {PANEL}, g AS (SELECT region, year, CASE WHEN (region + year) % 4 <> 0 THEN y END AS y FROM panel), m AS (SELECT avg(y) AS m FROM g WHERE year <= 1999) SELECT region, year, {R('coalesce(y, m)', 'y')} FROM g, m")
def train_mean_impute(spark, sf_dir):
    g = panel(spark, sf_dir).withColumn("y", F.when((F.col("region") + F.col("year")) % 4 != 0, F.col("y")))
    return rounded(features.impute_mean(g, g.where("year <= 1999"), ["y"]))


@query(f"WITH {PANEL}, w AS (SELECT *, exp(-(2001 - year) / 10.0::DOUBLE) AS w FROM panel) SELECT region, year, {R('w / avg(w) OVER ()', 'weight')} FROM w")
def exp_weights(spark, sf_dir):
    return rounded(features.year_weights(panel(spark, sf_dir)).select("region", "year", "weight"))


_GAPPY = DAILY + """, ends AS (SELECT region, min(day) AS a, max(day) AS b FROM daily GROUP BY region),
cal AS (SELECT region, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
gap AS (SELECT cal.region, cal.day, CASE WHEN dayofyear(cal.day) % 5 <> 0 THEN tavg END AS tavg, row_number() OVER (PARTITION BY cal.region ORDER BY cal.day) AS pos FROM cal LEFT JOIN daily USING (region, day)),
near AS (
  SELECT *, last_value(CASE WHEN tavg IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS pa, last_value(tavg IGNORE NULLS) OVER p AS va,
    first_value(CASE WHEN tavg IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS pb, first_value(tavg IGNORE NULLS) OVER f AS vb
  FROM gap WINDOW p AS (PARTITION BY region ORDER BY day ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY region ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir).select("region", "day", "tavg")
    full = series.reindex(rows, series.calendar(rows, ["region"], "day"), ["region"], "day")
    return full.withColumn("tavg", F.when(F.dayofyear("day") % 5 != 0, F.col("tavg")))


@query(f"WITH {_GAPPY} SELECT region, day, {R('coalesce(tavg, va + (vb - va) * (pos - pa) / nullif(pb - pa, 0), va, vb)', 'tavg')} FROM near")
def interpolate_linear(spark, sf_dir):
    return rounded(series.interpolate(gappy(spark, sf_dir), ["region"], "day", "tavg"))


@query(f"WITH {_GAPPY} SELECT region, day, {R('coalesce(va, vb)', 'tavg')} FROM near")
def ffill_bfill(spark, sf_dir):
    return rounded(series.fill(gappy(spark, sf_dir), ["region"], "day", "tavg"))


def _resample_sql(key: str) -> str:
    return f"WITH {DAILY}, k AS (SELECT *, min(day) OVER (PARTITION BY region) AS a FROM daily) SELECT region, CAST({key} AS DATE) AS period, {R('avg(tavg)', 'tavg')}, {R('max(tmax)', 'tmax')} FROM k GROUP BY 1, 2"


def _resample(spark, sf_dir, period):
    return rounded(series.resample(daily(spark, sf_dir), ["region"], "day", {"tavg": F.avg("tavg"), "tmax": F.max("tmax")}, period))


@query(_resample_sql("day + CAST((8 - isodow(day)) % 7 AS INTEGER)"))
def resample_weekly_mon(spark, sf_dir):
    return _resample(spark, sf_dir, "weekly")


@query(_resample_sql("a + CAST(10 * (date_diff('day', a, day) // 10) AS INTEGER)"))
def resample_dekad(spark, sf_dir):
    return _resample(spark, sf_dir, "dekad")


@query(_resample_sql("date_trunc('month', day)"))
def resample_month(spark, sf_dir):
    return _resample(spark, sf_dir, "monthly")


@query(f"""WITH {DAILY}, p AS (SELECT region, day, tavg, row_number() OVER w AS pos, count(*) OVER (PARTITION BY region) AS n, first_value(tavg) OVER w AS fv, last_value(tavg) OVER (PARTITION BY region ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv,
  sum(tavg) OVER (PARTITION BY region ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM daily WINDOW w AS (PARTITION BY region ORDER BY day)),
t AS (SELECT *, (s + greatest(4 - pos, 0) * fv + greatest(pos + 3 - n, 0) * lv) / 7.0::DOUBLE AS trend FROM p) SELECT region, day, {R('trend', 'trend')}, {R('tavg - trend', 'rest')} FROM t""")
def moving_average_decomp(spark, sf_dir):
    return rounded(series.moving_average(daily(spark, sf_dir), ["region"], "day", "tavg", 7).select("region", "day", "trend", "rest"))


@query(f"WITH {DAILY} SELECT region, day, {R('(tavg - avg(tavg) OVER w) / sqrt(var_pop(tavg) OVER w + 1e-8)', 'normed')} FROM daily WINDOW w AS (PARTITION BY region)")
def instance_norm(spark, sf_dir):
    return rounded(series.instance_norm(daily(spark, sf_dir), ["region"], "tavg").select("region", "day", "normed"))


@query(f"WITH {DAILY} SELECT region, day, {R('tavg - last_value(tavg) OVER (PARTITION BY region ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)', 'anchored')} FROM daily")
def last_value_anchor(spark, sf_dir):
    return rounded(series.anchor_last(daily(spark, sf_dir), ["region"], "day", "tavg").select("region", "day", "anchored"))


@query(f"WITH {DAILY}, p AS (SELECT *, (row_number() OVER (PARTITION BY region ORDER BY day) - 1) // 8 AS token FROM daily) SELECT region, CAST(token AS BIGINT) AS token, {R('avg(tavg)', 'mean')}, true AS observed FROM p GROUP BY 1, 2")
def avg_pool_tokens(spark, sf_dir):
    return rounded(series.pool(daily(spark, sf_dir), ["region"], "day", "tavg", 8))


@query(f"""WITH {DAILY}, s AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY day) AS step, tavg FROM daily), b AS (SELECT *, floor((step - 1) * 4 / max(step) OVER (PARTITION BY region)) AS part FROM s)
SELECT region, {', '.join(R(f'avg(tavg) FILTER (WHERE part = {k})', f'bin_{k}') for k in range(4))}, {R('avg(tavg)', 'mean')}, {R('stddev_pop(tavg)', 'std')}, min(tavg) AS low, max(tavg) AS high, {R('regr_slope(tavg, step)', 'slope')}, arg_max(tavg, step) AS "last" FROM b GROUP BY region""")
def masked_channel_summary(spark, sf_dir):
    from pyspark.sql import Window

    rows = daily(spark, sf_dir).withColumn("step", F.row_number().over(Window.partitionBy("region").orderBy("day")))
    return rounded(features.channel_summary(rows, ["region"], "step", "tavg"))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)")
def duplicate_keys(spark, sf_dir):
    return contract.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""SELECT 'o_totalprice' AS "column", CAST(0 AS BIGINT) AS non_numeric, count(*) FILTER (WHERE o_totalprice < 1000) AS below_min, count(*) FILTER (WHERE o_totalprice > 400000) AS above_max FROM orders
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS DOUBLE) IS NULL), 0, 0 FROM orders""")
def numeric_rules(spark, sf_dir):
    return contract.numeric_rules(table(spark, sf_dir, "orders"), {"o_totalprice": (1000.0, 400000.0), "o_orderpriority": (None, None)})


@query("SELECT (SELECT count(*) FROM orders) AS row_count, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)) AS duplicate_rows, (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS violations, (SELECT count(*) = count(DISTINCT o_orderkey) AND count(*) FILTER (WHERE o_totalprice < 0) = 0 FROM orders) AS ok")
def contract_summary(spark, sf_dir):
    return contract.summary(table(spark, sf_dir, "orders"), ["o_orderkey"], {"o_totalprice": (0.0, None)}, ["o_orderkey", "o_totalprice"])


_RUNS = FRAME + ", runs AS (SELECT region, year AS seed, arm, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse FROM (SELECT region, year, y, y_pred AS p, 'B1' AS arm FROM frame UNION ALL SELECT region, year, y, avg(y) OVER (PARTITION BY year) AS p, 'B0' AS arm FROM frame) GROUP BY ALL)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    f = frame(spark, sf_dir)
    both = f.select("region", "year", "y", F.col("y_pred").alias("p"), F.lit("B1").alias("arm")).unionByName(f.select("region", "year", "y", F.avg("y").over(Window.partitionBy("year")).alias("p"), F.lit("B0").alias("arm")))
    return both.groupBy("region", F.col("year").alias("seed"), "arm").agg(c.mae(F.col("y"), F.col("p")).alias("mae"), c.rmse(F.col("y"), F.col("p")).alias("rmse"))


@query(f"WITH {_RUNS}, m AS (SELECT region, arm, avg(mae) AS mae, avg(rmse) AS rmse FROM runs GROUP BY ALL), l AS (UNPIVOT m ON mae, rmse INTO NAME metric VALUE value) SELECT a.region, a.metric, a.arm, {R('b.value', 'base')}, {R('a.value', 'value')}, {R('a.value - b.value', 'delta')} FROM l a JOIN l b ON a.region = b.region AND a.metric = b.metric WHERE a.arm = 'B1' AND b.arm = 'B0'")
def point_deltas(spark, sf_dir):
    return rounded(comparison.deltas(runs(spark, sf_dir), ["region"], metrics=["mae", "rmse"]))


#: The exact signed-rank test: sign choices counted by their rank sum, one rank a step (a panel has no ties and at most 50 regions).
WILCOXON = """m AS (SELECT region, arm, avg(mae) AS mae, avg(rmse) AS rmse FROM runs GROUP BY ALL), l AS (UNPIVOT m ON mae, rmse INTO NAME metric VALUE value),
diffs AS (SELECT a.metric, a.value - b.value AS v FROM l a JOIN l b ON a.region = b.region AND a.metric = b.metric WHERE a.arm = 'B1' AND b.arm = 'B0' AND abs(a.value - b.value) > 1e-12),
rks AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY abs(v)) AS rk FROM diffs),
signed AS (SELECT metric, count(*) AS n, least(sum(CASE WHEN v > 0 THEN rk ELSE 0 END), sum(CASE WHEN v < 0 THEN rk ELSE 0 END)) AS stat FROM rks GROUP BY metric),
ways AS (
  SELECT 0 AS k, 0 AS total, 1.0::DOUBLE AS c
  UNION ALL SELECT k + 1, total + x * (k + 1), sum(c) FROM ways, (VALUES (0), (1)) AS t(x) WHERE k < 50 GROUP BY k, total + x * (k + 1)),
wilcoxon AS (
  SELECT metric, n, CAST(stat AS DOUBLE) AS statistic, CASE WHEN n >= 3 THEN least(1.0::DOUBLE, 2 * (SELECT sum(c) FROM ways WHERE k = n AND total <= stat) / 2.0::DOUBLE ** n) END AS p_value
  FROM signed)"""


@query(f"WITH RECURSIVE {_RUNS}, {WILCOXON} SELECT metric, n, {R('statistic', 'statistic')}, {R('p_value', 'p_value')} FROM wilcoxon")
def wilcoxon_panel(spark, sf_dir):
    return rounded(comparison.wilcoxon(comparison.deltas(runs(spark, sf_dir), ["region"], metrics=["mae", "rmse"]), ["metric"], "delta"))


_CI = """e AS (SELECT year, count(*) AS n, sum((y - y_pred) ** 2) AS s1, sum((y - ref_climatology) ** 2) AS s2 FROM ref GROUP BY year),
slots AS (SELECT draw, years, unnest(range(1, len(years) + 1)) AS k FROM (SELECT list(year ORDER BY year) AS years FROM e), range(1000) AS r(draw)),
picked AS (SELECT draw, years[1 + CAST('0x' || substr(md5(draw || '-' || k || '-7'), 1, 8) AS BIGINT) % len(years)] AS year FROM slots),
b AS (SELECT draw, sqrt(sum(s1) / sum(n)) - sqrt(sum(s2) / sum(n)) AS x FROM picked JOIN e USING (year) GROUP BY draw)"""


@query(f"WITH {REF}, {_CI} SELECT {R('(SELECT sqrt(sum(s1) / sum(n)) - sqrt(sum(s2) / sum(n)) FROM e)', 'delta')}, {R('quantile_cont(x, 0.025)', 'low')}, {R('quantile_cont(x, 0.975)', 'high')}, count(x) AS draws FROM b")
def bootstrap_ci(spark, sf_dir):
    """The RMSE difference of the predictions and the climatology, over 1000 draws of years."""
    both = ranking.year_bootstrap(referenced(spark, sf_dir).withColumn("y_base", F.col("ref_climatology"))).where("metric = 'rmse'")
    return rounded(both.select("delta", F.col("ci_lo").alias("low"), F.col("ci_hi").alias("high"), F.col("n_boot_eff").alias("draws")))


_SHIFT = FRAME + """, v AS (SELECT region, y, year >= 2000 AS late FROM panel), n AS (SELECT region, y, count(*) FILTER (WHERE late) AS a, count(*) FILTER (WHERE NOT late) AS b FROM v GROUP BY ALL),
f AS (SELECT *, sum(a) OVER w / sum(a) OVER (PARTITION BY region) - sum(b) OVER w / sum(b) OVER (PARTITION BY region) AS gap, lead(y) OVER (PARTITION BY region ORDER BY y) AS nxt FROM n WINDOW w AS (PARTITION BY region ORDER BY y ROWS UNBOUNDED PRECEDING)),
st AS (SELECT region, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2, max(abs(gap)) AS ks, greatest(max(gap), 0) + greatest(max(-gap), 0) AS kuiper, coalesce(sum(abs(gap) * (nxt - y)), 0) AS wasserstein FROM f GROUP BY region)"""


@query(f"WITH {_SHIFT} SELECT region, n1, n2, {R('ks', 'ks')}, {R('kuiper', 'kuiper')}, {R('wasserstein', 'wasserstein')} FROM st")
def distribution_shift(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("late", F.col("year") >= 2000)
    return rounded(comparison.two_sample(rows, value="y", group="late", by=["region"]))


@query(f"""WITH RECURSIVE {_SHIFT}, lattice AS (
  SELECT region, n1, n2, ks, 0 AS step, 0 AS i, 1.0::DOUBLE AS share FROM st
  UNION ALL
  SELECT region, n1, n2, ks, step + 1, i + t.x, sum(share * CASE t.x WHEN 1 THEN n1 - i ELSE n2 - step + i END / CAST(n1 + n2 - step AS DOUBLE))
  FROM lattice, (VALUES (0), (1)) AS t(x)
  WHERE step < n1 + n2 AND CASE t.x WHEN 1 THEN n1 - i ELSE n2 - step + i END > 0 AND abs((i + t.x) / CAST(n1 AS DOUBLE) - (step + 1 - i - t.x) / CAST(n2 AS DOUBLE)) < ks - 1e-9
  GROUP BY region, n1, n2, ks, step, i + t.x),
stayed AS (SELECT region, sum(share) AS share FROM lattice WHERE step = n1 + n2 GROUP BY region)
SELECT st.region, n1, n2, {R('ks', 'ks')}, {R('1 - coalesce(share, 0)', 'ks_p')} FROM st LEFT JOIN stayed USING (region)""")
def ks_significance(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("late", F.col("year") >= 2000)
    return rounded(comparison.ks_p(comparison.two_sample(rows, value="y", group="late", by=["region"])).select("region", "n1", "n2", "ks", "ks_p"))


@query(f"""WITH {_SHIFT}, l AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.155::DOUBLE + 0.24::DOUBLE / sqrt(n1 * n2 / (n1 + n2))) * kuiper AS lam FROM st),
p AS (SELECT region, CASE WHEN any_value(lam) < 0.4 THEN 1 ELSE least(greatest(sum(2 * (4 * j * j * lam * lam - 1) * exp(-2 * j * j * lam * lam)), 0), 1) END AS p FROM l, range(1, 101) AS t(j) GROUP BY region),
k AS (SELECT region, round(p, 9) AS p FROM p), r AS (SELECT *, row_number() OVER (ORDER BY p, region) AS rk, count(*) OVER () AS m FROM k)
SELECT region, {R('p', 'kuiper_p')}, {R('least(min(p * m / rk) OVER (ORDER BY p, region ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)', 'q_value')} FROM r""")
def kuiper_false_discovery(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("late", F.col("year") >= 2000)
    p = comparison.kuiper_p(comparison.two_sample(rows, value="y", group="late", by=["region"])).select("region", F.round("kuiper_p", 9).alias("kuiper_p"))
    return rounded(order.false_discovery(p, p="kuiper_p"))


@query("WITH m AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY ALL), s AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n) FILTER (WHERE t = p) AS h, sum(n) FILTER (WHERE t = 0) AS t0, sum(n) FILTER (WHERE t = 1) AS t1, sum(n) FILTER (WHERE p = 0) AS p0, sum(n) FILTER (WHERE p = 1) AS p1, coalesce(sum(n) FILTER (WHERE t = 0 AND p = 0), 0) AS h0, coalesce(sum(n) FILTER (WHERE t = 1 AND p = 1), 0) AS h1, sum((t - p) ** 2 * n) AS d2 FROM m) "
       f"SELECT n, {R('h / n', 'accuracy')}, {R('(2 * h0 / (t0 + p0) + 2 * h1 / (t1 + p1)) / 2', 'macro_f1')}, {R('(2 * h0 / (t0 + p0) * t0 + 2 * h1 / (t1 + p1) * t1) / n', 'weighted_f1')}, {R('1 - d2 / ((t0 * p1 + t1 * p0) / n)', 'kappa')}, {R('d2 / n', 'distance')} FROM s")
def classification_scores(spark, sf_dir):
    return rounded(evaluation.classification(table(spark, sf_dir, "labels"), true="quality", pred="toxic", classes=(0, 1)))


@query(f"""WITH {PANEL}, m AS (SELECT avg(y) AS m FROM panel WHERE year <= 1999), a AS (SELECT t.region, t.year, t.y, greatest(5 + 0.9::DOUBLE * coalesce(l.y, m), 0) AS y_pred FROM panel t LEFT JOIN panel l ON t.region = l.region AND l.year = 1999, m WHERE t.year = 2000),
b AS (SELECT t.region, t.year, t.y, greatest(5 + 0.9::DOUBLE * coalesce(a.y_pred, m), 0) AS y_pred FROM panel t LEFT JOIN a ON t.region = a.region, m WHERE t.year = 2001)
SELECT region, year, {R('y', 'y')}, {R('y_pred', 'y_pred')} FROM a UNION ALL SELECT region, year, {R('y', 'y')}, {R('y_pred', 'y_pred')} FROM b""")
def recursive_lag_batch(spark, sf_dir):
    p = panel(spark, sf_dir)
    return rounded(features.recursive_lag(p.where("year >= 2000"), p.where("year <= 1999"), intercept=5.0, weight=0.9))


@query(f"SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, {R('sum(value)', 'total')} FROM events GROUP BY 1, 2")
def event_tumbling(spark, sf_dir):
    return rounded(events.window_counts(events.with_event_time(table(spark, sf_dir, "events")), by=("event_type",))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    out = events.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("start", "end")})


_WEATHER = "avg_temp max_temp min_temp temp_std gdd total_precip precip_std heat_days frost_days cold_stress_days dry_days wet_days".split()
_SEASONS = DAILY + """, seasons AS (
  SELECT region, CAST(year(day) AS INTEGER) AS year, avg(tavg) AS avg_temp, max(tmax) AS max_temp, min(tmin) AS min_temp, stddev_pop(tavg) AS temp_std, sum(greatest(least(tavg, 30) - 10, 0)) AS gdd,
    sum(prec) AS total_precip, stddev_pop(prec) AS precip_std, count(*) FILTER (WHERE tmax > 35) AS heat_days, count(*) FILTER (WHERE tmin < 0) AS frost_days, count(*) FILTER (WHERE tmin < 5) AS cold_stress_days,
    count(*) FILTER (WHERE prec < 1) AS dry_days, count(*) FILTER (WHERE prec > 10) AS wet_days, max(rad) AS peak, min(day) AS sos, max(day) AS eos
  FROM daily GROUP BY 1, 2)"""


def by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).withColumn("year", F.year("day"))


@query(f"WITH {PANEL}, {_SEASONS} SELECT p.region, p.year, {', '.join(R(f's{k}.{n}::DOUBLE', f'{n}_{k}') for k in (1, 2) for n in _WEATHER)} FROM panel p LEFT JOIN seasons s1 ON p.region = s1.region AND p.year = s1.year + 1 LEFT JOIN seasons s2 ON p.region = s2.region AND p.year = s2.year + 2")
def multi_year_weather(spark, sf_dir):
    seasons = multiyear.weather_summaries(by_season(spark, sf_dir), ["region", "year"], "maize")
    return rounded(multiyear.lookback(panel(spark, sf_dir).select("region", "year"), seasons, _WEATHER).withColumns({f"{n}_{k}": F.col(f"{n}_{k}").cast("double") for k in (1, 2) for n in _WEATHER}))


@query(f"""WITH {DAILY}, r AS (SELECT region, CAST(year(day) AS INTEGER) AS year, rad AS ndvi, prec AS fpar, CASE WHEN dayofyear(day) % 4 <> 0 THEN tavg END AS ssm, day FROM daily),
b AS (SELECT *, count(ssm) OVER (PARTITION BY region, year ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS back FROM r)
SELECT region, year, {', '.join(R(f'{f}({x})', f'{x}_{n}') for x in ('ndvi', 'fpar', 'ssm') for n, f in (('max', 'max'), ('mean', 'avg'), ('integral', 'sum')))}, {R('avg(ssm) FILTER (WHERE back <= 30)', 'ssm_final')} FROM b GROUP BY region, year""")
def multi_year_remote(spark, sf_dir):
    ssm = F.when(F.dayofyear("day") % 4 != 0, F.col("tavg"))
    return rounded(multiyear.remote_summaries(by_season(spark, sf_dir).select("region", "year", "day", F.col("rad").alias("ndvi"), F.col("prec").alias("fpar"), ssm.alias("ssm")), ["region", "year"], "day"))


_CHANGES = ", ".join(f"CAST(s{k}.{n} - s.{n} AS DOUBLE) AS {n}_change_{k}" for k in (1, 2) for n in ("sos", "eos", "length"))


@query(f"WITH {_SEASONS}, ph AS (SELECT region, year, dayofyear(sos) AS sos, dayofyear(eos) AS eos, date_diff('day', sos, eos) AS length FROM seasons) SELECT s.region, s.year, {_CHANGES} FROM ph s LEFT JOIN ph s1 ON s.region = s1.region AND s.year = s1.year + 1 LEFT JOIN ph s2 ON s.region = s2.region AND s.year = s2.year + 2")
def phenology_changes(spark, sf_dir):
    return multiyear.phenology_changes(by_season(spark, sf_dir).groupBy("region", "year").agg(F.min("day").alias("sos"), F.max("day").alias("eos")))


_TRENDED = ("total_precip", "avg_temp", "gdd", "peak")


@query(f"WITH {PANEL}, {_SEASONS} SELECT p.region, p.year, {', '.join(R(f'CASE WHEN count(s.{n}) >= 2 THEN coalesce(regr_slope(s.{n}, s.year), 0) END', f'{n}_trend') for n in _TRENDED)} FROM panel p LEFT JOIN seasons s ON p.region = s.region AND s.year BETWEEN p.year - 3 AND p.year - 1 GROUP BY p.region, p.year")
def multi_year_trends(spark, sf_dir):
    rows = by_season(spark, sf_dir)
    seasons = multiyear.weather_summaries(rows, ["region", "year"], "maize").join(rows.groupBy("region", "year").agg(F.max("rad").alias("peak")), ["region", "year"])
    return rounded(multiyear.trends(panel(spark, sf_dir), seasons, _TRENDED))


@query(f"""WITH {DAILY}, x AS (SELECT region, year(day) AS year, dayofyear(day) - 1 AS step, tavg FROM daily), f AS (SELECT region, year, k, sqrt(sum(tavg * cos(2 * pi() * k * step / 365.0::DOUBLE)) ** 2 + sum(tavg * sin(2 * pi() * k * step / 365.0::DOUBLE)) ** 2) AS a FROM x, range(1, 183) AS t(k) WHERE step < 365 GROUP BY ALL),
m AS (SELECT k, round(avg(a), 6) AS a FROM f GROUP BY k) SELECT CAST(k AS INTEGER) AS frequency, CAST(365 // k AS INTEGER) AS period, a + 0 AS amplitude FROM m ORDER BY a DESC, k LIMIT 5""")
def top_periods(spark, sf_dir):
    rows = by_season(spark, sf_dir).withColumn("step", F.dayofyear("day") - 1)
    return rounded(spectral.top_periods(rows, ["region", "year"], "step", "tavg", 365, 5))


@query(f"""WITH {DAILY}, x AS (SELECT region, CAST(year(day) AS INTEGER) AS year, row_number() OVER (PARTITION BY region, year(day) ORDER BY day) - 1 AS s, count(*) OVER (PARTITION BY region, year(day)) AS n, day, tavg FROM daily),
f AS (SELECT region, year, k, n, sum(tavg * cos(2 * pi() * k * s / n)) AS re, sum(tavg * sin(2 * pi() * k * s / n)) AS im FROM x, range(0, 184) AS t(k) WHERE 2 * k <= n GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY region, year ORDER BY round(sqrt(re ** 2 + im ** 2), 9) DESC, k) AS o FROM f),
g AS (SELECT x.region, x.day, x.tavg, sum(CASE WHEN k = 0 OR 2 * k = x.n THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * s / x.n) + im * sin(2 * pi() * k * s / x.n))) / x.n AS dominant FROM x JOIN b ON x.region = b.region AND x.year = b.year AND o <= 3 GROUP BY x.region, x.day, x.tavg, x.n)
SELECT region, day, {R('dominant', 'dominant')}, {R('tavg - dominant', 'rest')} FROM g""")
def dominant_frequencies(spark, sf_dir):
    return rounded(spectral.split_dominant(by_season(spark, sf_dir), ["region", "year"], "day", "tavg", 3).drop("year"))


_PAIRED = [(a, b) for i, a in enumerate(("tavg", "prec", "rad")) for b in ("tavg", "prec", "rad")[i + 1 :]]


@query(f"WITH {DAILY} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R('avg(r)', 'r')} FROM (SELECT covar_pop({a}, {b}) / ((stddev_samp({a}) + 1e-8::DOUBLE) * (stddev_samp({b}) + 1e-8::DOUBLE)) AS r FROM daily GROUP BY region, year(day))" for a, b in _PAIRED))
def channel_correlation(spark, sf_dir):
    return rounded(spectral.channel_correlation(by_season(spark, sf_dir), ["region", "year"], ["tavg", "prec", "rad"]))


@query(f"""WITH {PANEL}, al AS (SELECT p.region, p.year AS t, q.year AS x, q.y AS v FROM panel p JOIN panel q ON p.region = q.region),
r AS (SELECT region, t, x > t AS aft, CASE WHEN x > t THEN 2 * t - x ELSE x END AS x, v FROM al WHERE x <> t), rk AS (SELECT *, row_number() OVER (PARTITION BY region, t, aft ORDER BY x DESC) AS back FROM r),
w AS (SELECT region, t, aft, x, v, k AS length FROM rk, range(5, 11) AS q(k) WHERE back <= k),
sz AS (SELECT region, t, aft, length, count(*) AS n, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept FROM w GROUP BY ALL HAVING count(*) = length),
ss AS (SELECT a.region, a.t, a.aft, a.length, sum(sign(b.v - a.v)) AS s FROM w a JOIN w b ON a.region = b.region AND a.t = b.t AND a.aft = b.aft AND a.length = b.length AND a.x < b.x GROUP BY ALL),
z AS (SELECT *, round((s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0::DOUBLE), 9) AS z FROM sz JOIN ss USING (region, t, aft, length)),
o AS (SELECT *, intercept + slope * t AS line, row_number() OVER (PARTITION BY region, t, aft ORDER BY abs(z) DESC, length) AS o FROM z WHERE abs(z) > 0.5),
li AS (SELECT region, t, max(line) FILTER (WHERE NOT aft) AS low, max(line) FILTER (WHERE aft) AS high FROM o WHERE o = 1 GROUP BY ALL),
mean AS (SELECT region, t, avg(v) FILTER (WHERE x <> t) AS m, t - max(x) FILTER (WHERE x < t) AS back, min(x) FILTER (WHERE x > t) - t AS ahead FROM al GROUP BY region, t)
SELECT region, t AS year, {R('coalesce((ahead * low + back * high) / (back + ahead), low, high, m)', 'trend')} FROM mean LEFT JOIN li USING (region, t)""")
def gated_trend(spark, sf_dir):
    """The gate is at |z| > 0.5, so that the short panel has lines to blend."""
    p = settled_panel(spark, sf_dir)
    return rounded(reference.gated_trend(p, p, z_limit=0.5))


_TRANSFER = PANEL + """, c AS (SELECT CAST(n_nationkey AS BIGINT) AS region, CAST(n_regionkey AS BIGINT) AS country FROM nation), pc AS (SELECT p.*, country FROM panel p JOIN c ON p.region = c.region),
sc AS (SELECT country, avg(y) AS m, stddev_pop(y) AS s FROM pc WHERE year <= 1999 GROUP BY 1),
fr AS (SELECT a.country AS source, f.country AS target, f.region, f.year, f.y, a.m + a.s * (l.y - b.m) / b.s AS p FROM pc f JOIN pc l ON f.region = l.region AND f.year = l.year + 1 JOIN sc b ON b.country = f.country JOIN sc a ON a.country <> f.country WHERE f.year >= 2000),
tr AS (SELECT * FROM pc WHERE year <= 1999), fit AS (SELECT region, avg(y) AS cl, CASE WHEN count(*) >= 5 THEN coalesce(regr_slope(y, year), 0) ELSE 0 END AS slope, avg(year) AS my, avg(y) FILTER (WHERE o <= 3) AS r3 FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY year DESC) AS o FROM tr) GROUP BY region),
ov AS (SELECT country, avg(y) AS overall FROM tr GROUP BY 1),
j AS (SELECT source, target, year, y, p, coalesce(cl, overall) AS ref_climatology, coalesce(r3, overall) AS ref_rolling3, coalesce(cl + slope * (year - my), overall) AS ref_trend FROM fr LEFT JOIN fit USING (region) JOIN ov ON ov.country = target),
sp AS (SELECT source, target, quantile_cont(r, 0.5) AS spatial_r FROM (SELECT source, target, year, CASE WHEN count(*) >= 2 AND stddev_pop(y) * stddev_pop(p) > 0 THEN covar_pop(y, p) / (stddev_pop(y) * stddev_pop(p)) END AS r FROM j GROUP BY ALL) GROUP BY ALL)"""
_ERR = {"rmse": "sqrt(avg((y - {0}) ** 2))", "mae": "avg(abs(y - {0}))"}


@query(f"WITH {_TRANSFER} SELECT source, target, {_POINT.replace('y_pred', 'p')}, {', '.join(R('1 - ' + e.format('p') + ' / ' + e.format('ref_' + k), f'skill_{n}_{k}') for k in ('climatology', 'rolling3', 'trend') for n, e in _ERR.items())}, "
       f"{R('covar_pop(y - ref_trend, p - ref_trend) / (stddev_pop(y - ref_trend) * stddev_pop(p - ref_trend))', 'r_an')}, {R('1 - sum((y - p) ** 2) / (var_pop(y - ref_trend) * count(*))', 'r2_an')}, {R('any_value(spatial_r)', 'spatial_r')} FROM j JOIN sp USING (source, target) GROUP BY source, target")
def transfer_tier(spark, sf_dir):
    country = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("region"), F.col("n_regionkey").cast("long").alias("target"))
    rows = settled_panel(spark, sf_dir).join(F.broadcast(country), "region")  # one row per nation
    train = rows.where("year <= 1999")
    scale = train.groupBy("target").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))
    lagged = rows.where("year >= 2000").join(rows.select("region", (F.col("year") + 1).alias("year"), F.col("y").alias("lag")), ["region", "year"])
    own = lagged.join(F.broadcast(scale), "target").withColumn("z", (F.col("lag") - F.col("m")) / F.col("s")).drop("m", "s")
    models = own.join(F.broadcast(scale.withColumnRenamed("target", "source")))  # one source per country
    return rounded(evaluation.transfer(models.withColumn("y_pred", F.col("m") + F.col("s") * F.col("z")), train))


@query()
def domain_distance(spark, sf_dir):
    country = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("region"), F.col("n_regionkey").cast("long").alias("country"))
    stats = panel(spark, sf_dir).groupBy(F.col("region").cast("long").alias("region")).agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), F.min("y").alias("low"), F.max("y").alias("high"))
    return rounded(shift.domain_distance(country.join(stats, "region", "left"), ["mean", "std", "low", "high"], draws=100))


@query("""SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (n_nationkey * 7 % 180 - 90)::DOUBLE || ',' || (n_nationkey * 3 % 90)::DOUBLE || ']},"properties":{"nation":"' || n_name || '","region":' || n_regionkey || '}}' AS feature FROM nation WHERE n_nationkey % 5 <> 0""")
def geojson_points(spark, sf_dir):
    key = F.col("n_nationkey").cast("long")
    rows = table(spark, sf_dir, "nation").select((key * 7 % 180 - 90).cast("double").alias("longitude"), (key * 3 % 90).cast("double").alias("latitude"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("region"), F.when(key % 5 != 0, key).alias("code"))
    return tables.geojson_features(rows, ["nation", "region"], label="code")


# --- tiers, drivers, folds

_GATE = """gr AS (SELECT region, year AS x, y AS v, row_number() OVER (PARTITION BY region ORDER BY year DESC) AS back FROM panel WHERE year <= 1999),
gw AS (SELECT region, x, v, k AS length FROM gr, range(5, 11) AS t(k) WHERE back <= k AND back <= 10),
gn AS (SELECT region, length, count(*) AS n, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept FROM gw GROUP BY ALL HAVING count(*) = length),
gs AS (SELECT a.region, a.length, sum(sign(b.v - a.v)) AS s FROM gw a JOIN gw b ON a.region = b.region AND a.length = b.length AND a.x < b.x GROUP BY ALL),
gz AS (SELECT region, length, slope, intercept, round((s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0::DOUBLE), 9) AS z FROM gn JOIN gs USING (region, length)),
gb AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY abs(z) DESC, length) AS o FROM gz WHERE abs(z) > 0.5),
four AS (SELECT r.*, coalesce(gb.intercept + gb.slope * r.year, r.ref_climatology) AS ref_gated FROM ref r LEFT JOIN gb ON gb.region = r.region AND gb.o = 1)"""
_FOUR = {"trend": "ref_gated", "ols": "ref_trend", "climatology": "ref_climatology", "rolling3": "ref_rolling3"}


def with_four_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test years with all four references; the gate is at |z| > 0.5, as in ``gated_trend``."""
    p = settled_panel(spark, sf_dir)
    rows = referenced(spark, sf_dir, p)
    return rows.join(reference.gated_trend(rows, p.where("year <= 1999"), z_limit=0.5).withColumnRenamed("trend", "ref_gated"), ["region", "year"])


@query(f"WITH {REF}, {_GATE} SELECT {_POINT}, " + ", ".join(
    f"{R(e.format(col), f'{n}_ref_{k}')}, {R('1 - ' + e.format('y_pred') + ' / ' + e.format(col), f'skill_{n}_vs_{k}')}" for k, col in _FOUR.items() for n, e in (("rmse", "sqrt(avg((y - {0}) ** 2))"), ("mae", "avg(abs(y - {0}))"))
) + ", " + ", ".join(R(f"avg(CASE WHEN abs(y - y_pred) / greatest(abs(y), 1e-8) <= {s} THEN 1.0 ELSE 0.0 END)", f"within_{round(100 * s)}pct") for s in (0.01, 0.05, 0.1, 0.2)) + ", " + ", ".join(R(f"avg(CASE WHEN abs(y - y_pred) <= {s} THEN 1.0 ELSE 0.0 END)", n) for s, n in ((0.1, "within_abs_0_1"), (0.5, "within_abs_0_5"))) + " FROM four")
def accuracy_tier(spark, sf_dir):
    return rounded(tiers.accuracy(with_four_references(spark, sf_dir), _FOUR))


_REFQ = "(ref_trend + zq[{0}] * ref_sigma)"


@query(f"WITH {REF} SELECT {_QUANT.replace('pinball_q10', 'pinball_q10')}, 0.8::DOUBLE AS picp_nominal, "
       f"{R('avg(2 * (' + ' + '.join(_PIN(_REFQ.format(k), t) for k, (_, t) in enumerate(_QS, 1)) + ') / 3)', 'crps_ref_ols')}, "
       f"{R('1 - avg(2 * (' + ' + '.join(_PIN(q, t) for q, t in _QS) + ') / 3) / avg(2 * (' + ' + '.join(_PIN(_REFQ.format(k), t) for k, (_, t) in enumerate(_QS, 1)) + ') / 3)', 'skill_crps_vs_ols')}, "
       f"{R(f'avg(CASE WHEN y BETWEEN {_REFQ.format(1)} AND {_REFQ.format(3)} THEN 1.0 ELSE 0.0 END)', 'picp_ref_ols')}, {R(f'avg({_REFQ.format(3)} - {_REFQ.format(1)})', 'width_ref_ols')} FROM ref")
def uncertainty_tier(spark, sf_dir):
    levels = {t: q for q, t in _QS}
    return rounded(tiers.uncertainty(referenced(spark, sf_dir), levels, {"ols": {t: f"ref_{q}" for t, q in levels.items()}}))


@query(f"""WITH {REF}, l AS (SELECT k, anom_true < -k * ref_sigma AS e, anom_pred < -k * ref_sigma AS a, round(-anom_pred / CASE WHEN ref_sigma > 0 THEN ref_sigma ELSE 1 END, 9) AS s1, round(-(q10 - ref_trend) / CASE WHEN ref_sigma > 0 THEN ref_sigma ELSE 1 END, 9) AS s2 FROM anom, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) AS t(k)),
m AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY s1) + (count(*) OVER (PARTITION BY k, s1) - 1) / 2.0 AS r1, rank() OVER (PARTITION BY k ORDER BY s2) + (count(*) OVER (PARTITION BY k, s2) - 1) / 2.0 AS r2 FROM l),
t AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE e) AS e, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE e AND a) AS h, sum(r1) FILTER (WHERE e) AS r1, sum(r2) FILTER (WHERE e) AS r2 FROM m GROUP BY k)
SELECT k, n, {R('e / n', 'base_rate')}, {R('CASE WHEN e > 0 AND e < n THEN coalesce(h / nullif(a, 0), 0) END', 'precision')}, {R('CASE WHEN e > 0 AND e < n THEN h / e END', 'recall')}, {R('CASE WHEN e > 0 AND e < n THEN coalesce(2 * h / nullif(a + e, 0), 0) END', 'f1')},
  {R('(r1 - e * (e + 1) / 2.0) / nullif(e * (n - e), 0)', 'auc')}, {R('(r2 - e * (e + 1) / 2.0) / nullif(e * (n - e), 0)', 'auc_low')} FROM t""")
def operational_tier(spark, sf_dir):
    return rounded(tiers.operational(with_anomalies(spark, sf_dir).withColumn("anom_low", F.col("q10") - F.col("ref_trend"))))


@query(f"WITH {REF}, x AS (SELECT *, anom_true < -ref_sigma AS low FROM anom), s AS (SELECT * FROM x WHERE low) SELECT {R('(SELECT avg(CAST(low AS INTEGER)) FROM x)', 'base_rate')}, count(*) AS n, {R('sqrt(avg((y - y_pred) ** 2))', 'rmse')}, {R('1 - sqrt(avg((y - y_pred) ** 2)) / sqrt(avg((y - ref_trend) ** 2))', 'skill_rmse')}, {R('CASE WHEN count(*) >= 3 THEN corr(anom_true, anom_pred) END', 'r_an')}, {R('stddev_pop(anom_pred) / nullif(stddev_pop(anom_true), 0)', 'spread_ratio')} FROM s")
def extreme_stratum(spark, sf_dir):
    return rounded(tiers.extreme(with_anomalies(spark, sf_dir)))


_DRIVERS = DAILY + """, se AS (SELECT region, CAST(year(day) AS INTEGER) AS year, sum(prec) AS prec, avg(tmax) AS tmax FROM daily GROUP BY 1, 2),
en AS (SELECT region, quantile_cont(prec, 0.1) AS p10, quantile_cont(CAST(tmax AS DOUBLE), 0.9) AS p90 FROM se WHERE year <= 1996 GROUP BY region),
fl AS (SELECT se.*, CAST(prec <= p10 OR tmax >= p90 AS INTEGER) AS driver_extreme FROM se LEFT JOIN en USING (region))"""


def _driver_flags(spark, sf_dir):
    seasons = by_season(spark, sf_dir).groupBy("region", "year").agg(F.sum("prec").alias("prec"), F.avg("tmax").cast("double").alias("tmax"))
    return tiers.driver_flags(seasons, seasons.where("year <= 1996"))


@query(f"WITH {_DRIVERS} SELECT region, year, {R('prec', 'prec')}, {R('CAST(tmax AS DOUBLE)', 'tmax')}, driver_extreme FROM fl")
def driver_extremes(spark, sf_dir):
    return rounded(_driver_flags(spark, sf_dir))


@query(f"WITH {PANEL}, {_DRIVERS}, j AS (SELECT driver_extreme = 1 AS a, y < avg(y) OVER (PARTITION BY p.region) AS b FROM panel p JOIN fl ON p.region = fl.region AND p.year = fl.year) SELECT count(*) AS n, {R('count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR b)', 'agreement')} FROM j")
def driver_label_agreement(spark, sf_dir):
    from pyspark.sql import Window

    rows = panel(spark, sf_dir).join(_driver_flags(spark, sf_dir), ["region", "year"])
    rows = rows.select((F.col("driver_extreme") == 1).alias("a"), (F.col("y") < F.avg("y").over(Window.partitionBy("region"))).alias("b"))
    return rounded(rows.agg(F.count("*").alias("n"), tiers.jaccard(F.col("a"), F.col("b")).alias("agreement")))


@query(f"""WITH {FRAME}, {_FOLDS}, f AS (SELECT fold, year, sqrt(avg((y - y_pred) ** 2)) AS rmse FROM frame JOIN folds ON year > train_end GROUP BY 1, 2),
m AS (SELECT year, count(*) AS folds, avg(rmse) AS a, stddev_pop(rmse) AS p, stddev_samp(rmse) AS s FROM f GROUP BY year)
SELECT year, folds, {R('a', 'rmse_mean')}, {R('p', 'rmse_std_pop')}, {R('s', 'rmse_std_samp')} FROM m UNION ALL SELECT NULL, CAST(sum(folds) AS BIGINT), {R('avg(a)', 'rmse_mean')}, NULL, NULL FROM m""")
def walk_forward_aggregate(spark, sf_dir):
    p = settled_panel(spark, sf_dir)
    scored = splits.later_rows(splits.walk_forward(p, folds=3), frame(spark, sf_dir, p)).groupBy("fold", "year").agg(c.rmse(*_y()).alias("rmse"))
    return rounded(tiers.over_folds(scored, ["rmse"]))


_LEADS = (("end", 0), ("quarter", 1), ("middle", 2), ("three-quarter", 3))


@query(f"WITH {DAILY}, s AS (SELECT region, CAST(year(day) AS INTEGER) AS year, max(day) AS eos, date_diff('day', min(day), max(day)) AS length FROM daily GROUP BY 1, 2) SELECT region, year, " + ", ".join(f"eos - CAST(length * {k} // 4 AS INTEGER) AS \"{n.replace('-', '_')}_cutoff\"" for n, k in _LEADS) + ", eos - 30 AS days_30_cutoff FROM s")
def season_cutoffs(spark, sf_dir):
    s = by_season(spark, sf_dir).groupBy("region", "year").agg(F.max("day").alias("eos"), F.datediff(F.max("day"), F.min("day")).alias("length"))
    at = lambda lead: F.date_sub("eos", tiers.cutoff_days(lead, F.col("length")))
    return s.select("region", "year", *[at(n).alias(f"{n.replace('-', '_')}_cutoff") for n, _ in _LEADS], at("30-days").alias("days_30_cutoff"))


@query(f"WITH {FRAME} SELECT region, year, {R('y_pred - y', 'error')}, {R('abs(y_pred - y)', 'abs_error')}, {R('100 * (y_pred - y) / nullif(y, 0)', 'pct_error')} FROM frame")
def prediction_errors(spark, sf_dir):
    return rounded(tiers.errors(frame(spark, sf_dir)).select("region", "year", "error", "abs_error", "pct_error"))


_LATEST = """SELECT o_custkey, max(t) AS "timestamp", arg_max(price, t) AS price FROM (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS t, {0}(o_totalprice) AS price FROM orders WHERE {1} GROUP BY 1, 2) GROUP BY 1"""


@query(f"""WITH o AS ({_LATEST.format('max', "o_orderdate < DATE '1997-01-01'")}), n AS ({_LATEST.format('min', "o_orderdate < DATE '1996-01-01' AND o_custkey % 2 = 0")})
SELECT coalesce(n.o_custkey, o.o_custkey) AS o_custkey, coalesce(n."timestamp", o."timestamp") AS "timestamp", coalesce(n.price, o.price) AS price FROM o FULL JOIN n ON o.o_custkey = n.o_custkey""")
def upsert_latest(spark, sf_dir):
    """Rows of even customers, often with older stamps, put over the rows of all."""
    rows = table(spark, sf_dir, "orders").withColumn("timestamp", F.year("o_orderdate"))
    old = rows.where("o_orderdate < DATE '1997-01-01'").groupBy("o_custkey", "timestamp").agg(F.max("o_totalprice").alias("price"))
    new = rows.where("o_orderdate < DATE '1996-01-01' AND o_custkey % 2 = 0").groupBy("o_custkey", "timestamp").agg(F.min("o_totalprice").alias("price"))
    return comparison.upsert(old, new, ["o_custkey"])
