"""The query of tier intervals; its SQL builds the drawn frames that the operator avoids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.columns import d
from furrow.operators import bootstrap, reference
from furrow.plans.registry import REF, R, frame, query, rounded, settled_panel

#: References fitted to 1997, so that four years are scored.
_REF = REF.replace("year <= 1999", "year <= 1997").replace("year >= 2000", "year >= 1998").replace("f.year - 1999", "f.year - 1997")
_REFS = {"ols": "ref_trend", "climatology": "ref_climatology", "rolling3": "ref_rolling3"}
_SIGMAS = (0.5, 1.0)
_DRAWS = 200
_TAUS = ((0.1, "q10"), (0.5, "q50"), (0.9, "q90"))


def _mean(x: str) -> str:
    return f"avg({x})"


def _share(x: str) -> str:
    return f"avg(CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0 END)"


def _pinball(q: str, t: float) -> str:
    return f"greatest({t}::DOUBLE * (y - {q}), {t - 1:g}::DOUBLE * (y - {q}))"


_ROOT = "sqrt(avg((y - {}) ** 2))"
_SAFE = "CASE WHEN ref_sigma > 0 THEN ref_sigma ELSE 1 END"
_CRPS = " + ".join(f"2 * avg({_pinball(q, t)})" for t, q in _TAUS)
_CRPS_REF = " + ".join(f"2 * avg({_pinball(f'ref_{q}', t)})" for t, q in _TAUS)

_PLAIN = {
    "accuracy/n": "count(*)", "accuracy/mse": "avg((y - p) ** 2)", "accuracy/rmse": _ROOT.format("p"), "accuracy/mae": "avg(abs(y - p))",
    "accuracy/mape": "avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))", "accuracy/smape": "avg(2 * abs(y - p) / (abs(y) + abs(p) + 1e-8))",
    "accuracy/nrmse": _ROOT.format("p") + " / avg(y)", "accuracy/r2": "1 - sum((y - p) ** 2) / (var_pop(y) * count(*))",
    **{f"accuracy/rmse_ref_{k}": _ROOT.format(x) for k, x in _REFS.items()}, **{f"accuracy/skill_rmse_vs_{k}": f"1 - {_ROOT.format('p')} / {_ROOT.format(x)}" for k, x in _REFS.items()},
    **{f"accuracy/mae_ref_{k}": f"avg(abs(y - {x}))" for k, x in _REFS.items()}, **{f"accuracy/skill_mae_vs_{k}": f"1 - avg(abs(y - p)) / avg(abs(y - {x}))" for k, x in _REFS.items()},
    **{f"accuracy/within_{round(100 * t)}pct": _share(f"abs(y - p) / greatest(abs(y), 1e-8) <= {t}") for t in (0.01, 0.05, 0.1, 0.2)},
    **{f"accuracy/within_abs_{str(t).replace('.', '_')}": _share(f"abs(y - p) <= {t}") for t in (0.1, 0.5)},
    **{f"uncertainty/pinball_{q}": _mean(_pinball(q, t)) for t, q in _TAUS}, **{f"uncertainty/coverage_{q}": _share(f"y <= {q}") for _, q in _TAUS},
    "uncertainty/crps": f"({_CRPS}) / 3", "uncertainty/picp": _share("y BETWEEN q10 AND q90"), "uncertainty/width": "avg(q90 - q10)", "uncertainty/pinaw": "avg(q90 - q10) / (max(y) - min(y))",
    "uncertainty/winkler": "avg((q90 - q10) + 10 * (greatest(q10 - y, 0) + greatest(y - q90, 0)))",
    "uncertainty/calibration_error": "(" + " + ".join(f"abs({_share(f'y <= {q}')} - {t}::DOUBLE)" for t, q in _TAUS) + ") / 3",
    "uncertainty/crps_ref_ols": f"({_CRPS_REF}) / 3", "uncertainty/skill_crps_vs_ols": f"1 - ({_CRPS}) / ({_CRPS_REF})", "uncertainty/picp_ref_ols": _share("y BETWEEN ref_q10 AND ref_q90"), "uncertainty/width_ref_ols": "avg(ref_q90 - ref_q10)",
    "generalisation/rmse": _ROOT.format("p"), "generalisation/skill_rmse_vs_trend": f"1 - {_ROOT.format('p')} / {_ROOT.format('ref_trend')}", "generalisation/r_an_detrended": "corr(a, b)",
    "generalisation/r2_an": "1 - sum((a - b) ** 2) / (var_pop(a) * count(*))", "generalisation/nrmse_an": "sqrt(avg((a - b) ** 2)) / avg(abs(a))", "generalisation/anomaly_spread_ratio": "stddev_pop(b) / stddev_pop(a)",
}


def _bad_years(k: float) -> dict[str, str]:
    tag, event, alarm = f"operational/badyear_{k:g}sig", f"(a < -{k}::DOUBLE * ref_sigma)", f"(b < -{k}::DOUBLE * ref_sigma)"
    e, al, h = (f"count(*) FILTER (WHERE {x})" for x in (event, alarm, f"{event} AND {alarm}"))
    when = lambda x: f"CASE WHEN {e} > 0 AND {e} < count(*) THEN coalesce({x}, 0) END"
    ratio = lambda a, b: f"CAST({a} AS DOUBLE) / nullif({b}, 0)"
    return {f"{tag}_events": e, f"{tag}_base_rate": ratio(e, "count(*)"), f"{tag}_precision": when(ratio(h, al)), f"{tag}_recall": when(ratio(h, e)), f"{tag}_f1": when(ratio(f"2 * {h}", f"{al} + {e}"))}


for _k in _SIGMAS:
    _PLAIN |= _bad_years(_k)


def _auc(name: str, score: str, k: float) -> str:
    """Midranks within each draw, then the rank-sum formula."""
    return f"""SELECT draw, arm, '{name}' AS name, (sum(mid) FILTER (WHERE e) - count(*) FILTER (WHERE e) * (count(*) FILTER (WHERE e) + 1) / 2) / nullif(count(*) FILTER (WHERE e) * count(*) FILTER (WHERE NOT e), 0) AS value
  FROM (SELECT draw, arm, e, rank() OVER (PARTITION BY draw, arm ORDER BY s) + (count(*) OVER (PARTITION BY draw, arm, s) - 1) / 2 AS mid
    FROM (SELECT draw, arm, a < -{k}::DOUBLE * ref_sigma AS e, round({score}, 9) AS s FROM f)) GROUP BY ALL"""


_AUCS = [_auc(f"operational/badyear_{k:g}sig_auc{n}", s, k) for k in _SIGMAS for n, s in (("", f"-b / ({_SAFE})"), ("_low", f"-(q10 - ref_trend) / ({_SAFE})"))]
_CORR = "CASE WHEN count(*) >= {} AND max(y) > min(y) AND max(p) > min(p) THEN corr(y, p) END"

_SQL = f"""WITH {_REF},
pair AS (
  SELECT 'arm' AS arm, region, year, y, y_pred AS p, q10, q50, q90, ref_trend, ref_climatology, ref_rolling3, ref_sigma, zq FROM anom
  UNION ALL SELECT 'b0', region, year, y, m, m * 0.9::DOUBLE, m, m * 1.1::DOUBLE, ref_trend, ref_climatology, ref_rolling3, ref_sigma, zq
  FROM (SELECT *, round(avg(y) OVER (PARTITION BY year), 9) AS m FROM anom)),
rich AS (SELECT *, y - ref_trend AS a, p - ref_trend AS b, {', '.join(f'ref_trend + zq[{i + 1}] * ref_sigma AS ref_{q}' for i, (_, q) in enumerate(_TAUS))} FROM pair),
slots AS (SELECT draw, years, unnest(range(1, len(years) + 1)) AS k FROM (SELECT list(DISTINCT year ORDER BY year) AS years FROM rich), range({_DRAWS}) AS r(draw)),
drawn AS (SELECT draw, years[1 + CAST('0x' || substr(md5(draw || '-' || k || '-7'), 1, 8) AS BIGINT) % len(years)] AS year FROM slots UNION ALL SELECT DISTINCT -1, year FROM rich),
f AS (SELECT draw, rich.* FROM drawn JOIN rich USING (year)),
wide AS (SELECT draw, arm, {', '.join(f'CAST({x} AS DOUBLE) AS "{k}"' for k, x in _PLAIN.items())} FROM f GROUP BY draw, arm),
sp AS (SELECT draw, arm, quantile_cont(r, 0.5) AS value FROM (SELECT DISTINCT draw, arm, year, {_CORR.format(2)} AS r FROM f GROUP BY draw, arm, year) GROUP BY draw, arm),
tm AS (SELECT draw, arm, quantile_cont(r, 0.5) AS value FROM (SELECT draw, arm, region, {_CORR.format(3)} AS r FROM f GROUP BY draw, arm, region) GROUP BY draw, arm),
an AS (
  SELECT draw, arm, CASE WHEN stddev_pop(u) > 1e-9 AND stddev_pop(v) > 1e-9 THEN corr(u, v) END AS value
  FROM (SELECT draw, arm, y - avg(y) OVER (PARTITION BY draw, arm, region) AS u, p - avg(p) OVER (PARTITION BY draw, arm, region) AS v FROM f) GROUP BY draw, arm),
tail AS (SELECT draw, arm, a, b, a <= quantile_cont(a, 0.1) OVER (PARTITION BY draw, arm) + 1e-12 AS low FROM f),
cap AS (SELECT draw, arm, avg(-b) / avg(-a) AS value, CAST(count(*) AS DOUBLE) AS n FROM tail WHERE low GROUP BY draw, arm),
long AS (
  SELECT draw, arm, name, value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (draw, arm)) INTO NAME name VALUE value)
  UNION ALL SELECT draw, arm, 'generalisation/r_sp', value FROM sp UNION ALL SELECT draw, arm, 'generalisation/r_tm', value FROM tm UNION ALL SELECT draw, arm, 'generalisation/r_an_window', value FROM an
  UNION ALL SELECT draw, arm, 'operational/shortfall_capture', value FROM cap UNION ALL SELECT draw, arm, 'operational/shortfall_n', n FROM cap
  UNION ALL {' UNION ALL '.join(_AUCS)}),
delta AS (SELECT a.draw, a.name, a.value AS x, b.value AS z FROM long a JOIN long b ON a.draw = b.draw AND a.name = b.name WHERE a.arm = 'arm' AND b.arm = 'b0'),
ends AS (SELECT name, count(x - z) AS n, quantile_cont(x - z, 0.025) AS lo, quantile_cont(x - z, 0.975) AS hi FROM delta WHERE draw >= 0 AND isfinite(x - z) GROUP BY name)
SELECT split_part(d.name, '/', 1) AS tier, split_part(d.name, '/', 2) AS metric, {R('x', 'm_arm')}, {R('z', 'm_b0')}, {R('x - z', 'delta')},
  {R('CASE WHEN n >= 20 THEN lo END', 'ci_lo')}, {R('CASE WHEN n >= 20 THEN hi END', 'ci_hi')}, coalesce(n, 0) AS n_boot_eff
FROM delta d LEFT JOIN ends ON ends.name = d.name WHERE d.draw = -1"""


def scored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Predictions by the year before, and by the mean over regions, with references fitted to 1997."""
    p = settled_panel(spark, sf_dir)
    arm = reference.attach(frame(spark, sf_dir, p).where("year >= 1998"), p.where("year <= 1997"))
    mean = F.round(F.avg("y").over(Window.partitionBy("year")), 9)
    return arm, arm.withColumn("y_pred", mean).withColumns({"q10": F.col("y_pred") * d(0.9), "q50": F.col("y_pred"), "q90": F.col("y_pred") * d(1.1)})


@query(_SQL)
def tier_intervals(spark, sf_dir):
    """Every metric of the four tiers, an arm against the baseline, with intervals over drawn years."""
    arm, base = scored(spark, sf_dir)
    out = bootstrap.tier_bootstrap(arm, base, refs=_REFS, trend="ols", levels={t: q for t, q in _TAUS}, bands={"ols": {t: f"ref_{q}" for t, q in _TAUS}}, sigmas=_SIGMAS, draws=_DRAWS)
    return rounded(out)
