"""Queries of the evaluation protocol, rankings, contract files and sample assembly; bindings as in ``registry``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d
from furrow.operators import assembly, comparison, contract, evaluation, ranking, reference, tiers
from furrow.plans.registry import _MARGIN, _POINT, _QS, _QUANT, _RUNS, DAILY, FRAME, PANEL, REF, WILCOXON, R, daily, frame, panel, query, referenced, rounded, runs, table
from furrow.session import settled

# --- tiers

_AGREE = "sqrt(avg((y - y_pred) ** 2))"


@query(f"""WITH {REF}, b AS (SELECT quantile_cont(q90, 0.9) AS bound FROM anom),
parts AS (
  SELECT *, 'in_domain' AS part FROM anom
  UNION ALL SELECT *, 'extreme_label' FROM anom WHERE anom_true < -ref_sigma
  UNION ALL SELECT anom.*, 'extreme_driver' FROM anom, b WHERE q90 >= bound),
sp AS (SELECT quantile_cont(r, 0.5) AS r_sp FROM (SELECT CASE WHEN count(*) >= 2 THEN corr(y, y_pred) END AS r FROM anom GROUP BY year)),
tm AS (SELECT quantile_cont(r, 0.5) AS r_tm FROM (SELECT CASE WHEN count(*) >= 3 THEN corr(y, y_pred) END AS r FROM anom GROUP BY region)),
an AS (SELECT corr(a, b) AS r_an FROM (SELECT y - avg(y) OVER (PARTITION BY region) AS a, y_pred - avg(y) OVER (PARTITION BY region) AS b FROM anom)),
m AS (
  SELECT part, count(*) AS n, {_AGREE} AS rmse, 1 - {_AGREE} / sqrt(avg((y - ref_trend) ** 2)) AS skill,
    CASE WHEN count(*) >= 3 THEN corr(anom_true, anom_pred) END AS r_an, stddev_pop(anom_pred) / nullif(stddev_pop(anom_true), 0) AS spread,
    1 - sum((anom_true - anom_pred) ** 2) / (var_pop(anom_true) * count(*)) AS r2_an, sqrt(avg((anom_true - anom_pred) ** 2)) / avg(abs(anom_true)) AS nrmse_an
  FROM parts GROUP BY part)
SELECT part AS partition, CASE WHEN part <> 'in_domain' THEN {R('n / (SELECT count(*) FROM anom)', 'x').removesuffix(' AS x')} END AS base_rate_extreme, n, {R('rmse', 'rmse')},
  {R('skill', 'skill_rmse_vs_trend')}, {R('m.r_an', 'r_an_detrended')}, {R('spread', 'anomaly_spread_ratio')},
  {', '.join(R(f"CASE WHEN part = 'in_domain' THEN {x} END", k) for x, k in (('r_sp', 'r_sp'), ('r_tm', 'r_tm'), ('an.r_an', 'r_an_window'), ('r2_an', 'r2_an'), ('nrmse_an', 'nrmse_an')))}
FROM m, sp, tm, an""")
def generalisation_tier(spark, sf_dir):
    return rounded(tiers.generalisation(settled(referenced(spark, sf_dir)), driver="q90"))


_TOLERANCE = ", ".join([
    *[R(f"avg(CASE WHEN abs(y - y_pred) / greatest(abs(y), 1e-8) <= {s} THEN 1.0 ELSE 0.0 END)", f"within_{round(100 * s)}pct") for s in (0.01, 0.05, 0.1, 0.2)],
    *[R(f"avg(CASE WHEN abs(y - y_pred) <= {s} THEN 1.0 ELSE 0.0 END)", n) for s, n in ((0.1, "within_abs_0_1"), (0.5, "within_abs_0_5"))],
])


@query(f"""WITH {FRAME}, a AS (SELECT {_POINT}, {_TOLERANCE} FROM frame), u AS (SELECT {_QUANT}, 0.8::DOUBLE AS picp_nominal FROM frame)
SELECT 'accuracy/' || metric AS name, value FROM (UNPIVOT (SELECT CAST(n AS DOUBLE) AS n, * EXCLUDE (n) FROM a) ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL SELECT 'uncertainty/' || metric, value FROM (UNPIVOT u ON COLUMNS(*) INTO NAME metric VALUE value)""")
def tier_report(spark, sf_dir):
    f = frame(spark, sf_dir)
    return rounded(tiers.report({"accuracy": tiers.accuracy(f, {}), "uncertainty": tiers.uncertainty(f, {t: q for q, t in _QS}, {})}))


@query(f"WITH {FRAME}, {_MARGIN.replace('greatest(q10 - y, y - q90)', 'abs(y - y_pred)')} SELECT region, year, {R('y_pred - margin', 'low_conf')}, {R('y_pred + margin', 'high_conf')} FROM frame, margin WHERE year >= 2000")
def residual_band(spark, sf_dir):
    f = frame(spark, sf_dir)
    return rounded(evaluation.residual_band(f.where("year >= 2000"), f.where("year = 1999")).select("region", "year", "low_conf", "high_conf"))


# --- bias


_FIT = "(year <= 1999 AND (region % 5 <> 0 OR year <= 1996))"  # every fifth region has too few rows


@query(f"""WITH {FRAME}, fit AS (SELECT * FROM frame WHERE {_FIT}),
own AS (SELECT region, count(*) AS n, avg(y) AS my, avg(y_pred) AS mp, regr_slope(y, y_pred) AS b FROM fit GROUP BY region HAVING avg(y_pred) > 0),
whole AS (SELECT regr_slope(y, y_pred) AS b, regr_intercept(y, y_pred) AS a FROM fit),
lines AS (SELECT region, CASE WHEN n >= 3 THEN own.b ELSE whole.b END AS slope, CASE WHEN n >= 3 THEN my - own.b * mp ELSE whole.a END AS intercept FROM own, whole)
SELECT region, year, {R('greatest(slope * y_pred + intercept, 0)', 'corrected')} FROM frame JOIN lines USING (region) WHERE year >= 2000""")
def regional_bias(spark, sf_dir):
    f = frame(spark, sf_dir)
    return rounded(reference.correct_by_region(f.where("year >= 2000"), reference.regional_bias(f.where(_FIT))).select("region", "year", "corrected"))


@query(f"""WITH {FRAME}, t AS (SELECT avg(y) - avg(y_pred) AS o, avg(y) / avg(y_pred) AS f, regr_slope(y, y_pred) AS b, regr_intercept(y, y_pred) AS a FROM frame WHERE year <= 1999)
SELECT region, year, {R('y_pred + o', 'by_mean')}, {R('y_pred * f', 'by_ratio')}, {R('b * y_pred + a', 'by_line')} FROM frame, t WHERE year >= 2000""")
def bias_corrections(spark, sf_dir):
    f = frame(spark, sf_dir)
    return rounded(reference.corrections(f.where("year >= 2000"), f.where("year <= 1999")).select("region", "year", "by_mean", "by_ratio", "by_line"))


@query(f"WITH {FRAME} SELECT year, {R('avg(y)', 'y')}, {R('avg(y_pred)', 'y_pred')}, count(y) AS regions FROM frame GROUP BY year")
def national_means(spark, sf_dir):
    return rounded(reference.national(frame(spark, sf_dir)))


# --- ranking

_PAIR = "pair AS (SELECT region, year, y, y_pred, avg(y) OVER (PARTITION BY year) AS y_base FROM frame)"
_SUMS = "n s s2 a1 a2 b1 b2".split()
_R2 = "1 - {0} / nullif(s2 - s * s / n, 0)"
_BOOT = f"""sums AS (
  SELECT year, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s, sum(y * y) AS s2, sum(abs(y - y_pred)) AS a1, sum((y - y_pred) ** 2) AS a2, sum(abs(y - y_base)) AS b1, sum((y - y_base) ** 2) AS b2
  FROM pair GROUP BY year),
slots AS (SELECT draw, years, unnest(range(1, len(years) + 1)) AS k FROM (SELECT list(year ORDER BY year) AS years FROM sums), range(1000) AS r(draw)),
drawn AS (SELECT draw, years[1 + CAST('0x' || substr(md5(draw || '-' || k || '-7'), 1, 8) AS BIGINT) % len(years)] AS year FROM slots),
weighted AS (
  SELECT draw, {', '.join(f'sum({x}) AS {x}' for x in _SUMS)} FROM drawn JOIN sums USING (year) GROUP BY draw
  UNION ALL SELECT -1, {', '.join(f'sum({x})' for x in _SUMS)} FROM sums),
scored AS ({' UNION ALL '.join(f"SELECT draw, '{m}' AS metric, {e.format('a' + k)} AS a, {e.format('b' + k)} AS b FROM weighted" for m, e, k in (
    ('rmse', 'sqrt({0} / n)', '2'), ('mae', '{0} / n', '1'), ('nrmse', 'sqrt({0} / n) / (s / n)', '2'), ('r2', _R2, '2')))}),
boot AS (
  SELECT metric, max(CASE WHEN draw < 0 THEN a END) AS m_arm, max(CASE WHEN draw < 0 THEN b END) AS m_b0, quantile_cont(a - b, 0.025) FILTER (WHERE draw >= 0) AS ci_lo,
    quantile_cont(a - b, 0.975) FILTER (WHERE draw >= 0) AS ci_hi, count(a - b) FILTER (WHERE draw >= 0) AS n_boot_eff
  FROM scored GROUP BY metric)"""


def _intervals(spark, sf_dir) -> DataFrame:
    f = frame(spark, sf_dir)
    return ranking.year_bootstrap(f.withColumn("y_base", F.avg("y").over(Window.partitionBy("year"))))


@query(f"WITH {FRAME}, {_PAIR}, {_BOOT} SELECT metric, {R('m_arm', 'm_arm')}, {R('m_b0', 'm_b0')}, {R('m_arm - m_b0', 'delta')}, {R('ci_lo', 'ci_lo')}, {R('ci_hi', 'ci_hi')}, n_boot_eff FROM boot")
def bootstrap_metrics(spark, sf_dir):
    """The arm that predicts a year by the one before against the mean of all regions, over 1000 draws of years."""
    return rounded(_intervals(spark, sf_dir))


_RANKED = f"""{_RUNS}, {_PAIR}, {_BOOT}, {WILCOXON},
ranked AS (
  SELECT a.region, a.metric, a.arm, b.value AS base, a.value AS value, a.value - b.value AS delta, ci_lo, ci_hi, p_value, true AS lower_is_better,
    (ci_lo > 0 OR ci_hi < 0) AS boot_excludes_0, a.value < b.value AS beats_b0_direction, (ci_lo > 0 OR ci_hi < 0) AND p_value < 0.05 AND a.value < b.value AS is_win
  FROM l a JOIN l b ON a.region = b.region AND a.metric = b.metric JOIN boot ON boot.metric = a.metric JOIN wilcoxon w ON w.metric = a.metric WHERE a.arm = 'B1' AND b.arm = 'B0')"""


def _ranked(spark, sf_dir) -> DataFrame:
    deltas = comparison.deltas(runs(spark, sf_dir), ["region"], metrics=["mae", "rmse"])
    tests = comparison.wilcoxon(deltas, ["metric"], "delta").select("metric", "p_value")
    return ranking.verdicts(deltas, _intervals(spark, sf_dir).select("metric", "ci_lo", "ci_hi"), tests, cell=["metric"], panel=["metric"])


@query(f"WITH RECURSIVE {_RANKED} SELECT region, metric, arm, {', '.join(R(x, x) for x in ('base', 'value', 'delta', 'ci_lo', 'ci_hi', 'p_value'))}, lower_is_better, boot_excludes_0, beats_b0_direction, is_win FROM ranked")
def ranking_verdicts(spark, sf_dir):
    return rounded(_ranked(spark, sf_dir))


@query(f"""WITH RECURSIVE {_RANKED}, classed AS (SELECT *, ['far', 'near', 'none', 'unknown'][region % 4 + 1] AS shift_class, region % 4 AS k FROM ranked)
SELECT metric, arm, shift_class, CAST(count(DISTINCT region) AS INTEGER) AS n_places, array_to_string(list_sort(list(DISTINCT CAST(region AS VARCHAR))), ';') AS places,
  {R('avg(delta)', 'mean_delta')}, {R('quantile_cont(delta, 0.5)', 'median_delta')}, {R('avg(CAST(beats_b0_direction AS INTEGER))', 'frac_beats_b0')}, count(*) FILTER (WHERE is_win) AS n_wins,
  CAST(CASE WHEN shift_class = 'unknown' THEN 4 ELSE any_value(k) END AS INTEGER) AS class_rank
FROM classed GROUP BY metric, arm, shift_class""")
def shift_strata(spark, sf_dir):
    """Regions stand for countries; every fourth has no shift class."""
    key = F.col("n_nationkey")
    shift = table(spark, sf_dir, "nation").where(key % 4 != 3).select(key.alias("region"), F.element_at(F.array(*map(F.lit, ("far", "near", "none"))), (key % 4 + 1).cast("int")).alias("shift_class"))
    return rounded(ranking.by_shift(_ranked(spark, sf_dir), shift, place=["region"], keys=["metric", "arm"], name="region"))


# --- contract files

_FILES = (("yield", "orders", "year(o_orderdate)"), ("meteo", "lineitem", "year(l_shipdate)"), ("ndvi", "orders", "year(o_orderdate) + 50"))


@query("WITH f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS file, list_sort(list(DISTINCT {y})) AS years FROM {t}" for n, t, y in _FILES) + """),
o AS (SELECT file, years, CASE WHEN file <> 'yield' THEN list_sort(list_intersect(years, (SELECT years FROM f WHERE file = 'yield'))) END AS overlap FROM f)
SELECT file, array_to_string(years, ',') AS years, array_to_string(overlap, ',') AS overlap, coalesce(len(overlap) > 0, true) AS ok FROM o""")
def year_overlap(spark, sf_dir):
    files = {n: (table(spark, sf_dir, t).select(F.expr(y).alias("y")), "y") for n, t, y in _FILES}
    return contract.year_overlap(files).withColumns({x: F.array_join(x, ",") for x in ("years", "overlap")})


@query("SELECT count(*) FILTER (WHERE dayofyear(CAST(o_orderdate AS DATE) + 120) < dayofyear(o_orderdate)) AS invalid_rows, count(*) FILTER (WHERE dayofyear(CAST(o_orderdate AS DATE) + 120) < dayofyear(o_orderdate)) = 0 AS ok FROM orders")
def season_order(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return contract.season_order(table(spark, sf_dir, "orders").select(F.dayofyear(day).alias("sos"), F.dayofyear(F.date_add(day, 120)).alias("eos")))


@query(" UNION ALL ".join(f"SELECT '{x}' AS \"column\", {R(f'CAST(max({x}) AS DOUBLE)', 'largest')}, max({x}) > {m} AS warning FROM lineitem" for x, m in (("l_discount", 0.05), ("l_quantity", 100.0))))
def scale_warning(spark, sf_dir):
    return rounded(contract.scale_warning(table(spark, sf_dir, "lineitem"), {"l_discount": 0.05, "l_quantity": 100.0}))


# --- sample assembly

_CALENDARS = (("daily", 365, 1.0, "true"), ("weekly", 52, 0.5, "isodow(day) = 1"), ("dekad", 36, 0.75, "date_diff('day', coalesce(sos, cutoff), day) % 10 = 0"), ("monthly", 12, 1.0, "dayofmonth(day) = 1"))


@query("""WITH s AS (SELECT n_nationkey AS region, make_date(1996, n_nationkey % 12 + 1, n_nationkey % 28 + 1) AS begin FROM nation),
seasons AS (SELECT region, CASE WHEN region % 5 > 0 THEN begin END AS sos, begin + CAST(150 + 20 * region AS INTEGER) AS cutoff FROM s),
days AS (SELECT region, sos, cutoff, CAST(unnest(generate_series(CAST(coalesce(sos, cutoff - 600) AS TIMESTAMP), CAST(cutoff AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM seasons),
ticks AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS aggregation, {n} AS length, {s}::DOUBLE AS share, region, day FROM days WHERE {on}" for a, n, s, on in _CALENDARS) + """),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aggregation, region ORDER BY day DESC) AS back FROM ticks WHERE NOT (month(day) = 2 AND dayofmonth(day) = 29)) WHERE back <= length),
placed AS (SELECT *, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY aggregation, region) AS n FROM newest WINDOW w AS (PARTITION BY aggregation, region ORDER BY day))
SELECT aggregation, region, CAST(position AS INTEGER) AS position, day AS target FROM placed WHERE position < greatest(1, floor(n * share))""")
def target_calendars(spark, sf_dir):
    key = F.col("n_nationkey").cast("int")
    begin = F.make_date(F.lit(1996), key % 12 + 1, key % 28 + 1)
    seasons = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region"), F.when(key % 5 > 0, begin).alias("sos"), F.date_add(begin, 150 + 20 * key).alias("cutoff"))
    out = [assembly.target_dates(seasons, a, share=s).select(F.lit(a).alias("aggregation"), "region", "position", "target") for a, _, s, _ in _CALENDARS]
    return reduce(DataFrame.unionByName, out)


def _seasonal(spark, sf_dir) -> DataFrame:
    rows = daily(spark, sf_dir).withColumn("year", F.year("day"))
    return rows.withColumns({x: F.col(x).cast("double") for x in ("tmin", "tmax", "tavg", "prec", "rad")})


_CHANNELS = (*((x, "avg", "mean") for x in ("tmin", "tmax", "tavg")), *((x, "sum", "sum") for x in ("prec", "rad")))


@query(f"WITH {PANEL}, {DAILY}, s AS (SELECT region, year(day) AS year, {', '.join(f'{f}(CAST({x} AS DOUBLE)) AS {x}_{n}' for x, f, n in _CHANNELS)} FROM daily WHERE month(day) <> 12 AND year(day) > 1996 GROUP BY 1, 2) "
       f"SELECT p.region, p.year, {R('y', 'y')}, {', '.join(R(f'{x}_{n}', f'{x}_{n}') for x, _, n in _CHANNELS)} FROM panel p LEFT JOIN s ON p.region = s.region AND p.year = s.year")
def tabular_features(spark, sf_dir):
    """Seasons end with November; the first two years have no daily rows."""
    return rounded(assembly.tabular(panel(spark, sf_dir), _seasonal(spark, sf_dir).where("month(day) <> 12 AND year > 1996")))


@query(f"WITH {DAILY} SELECT region, CAST(year(day) AS INTEGER) AS year, " + ", ".join(R(f"avg(CAST({x} AS DOUBLE)) FILTER (WHERE month(day) = {k + 1})", f"{x}_{k}") for x in ("tavg", "prec") for k in range(12)) + " FROM daily GROUP BY 1, 2")
def wide_channels(spark, sf_dir):
    return rounded(assembly.wide(_seasonal(spark, sf_dir), ["region", "year"], F.month("day") - 1, ["tavg", "prec"], 12))


_LEVELS = (("p2_5", 0.025), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p97_5", 0.975))


@query(f"WITH {DAILY}, q AS (SELECT region, year(day) AS year, {', '.join(f'quantile_cont({x}, {v}) AS {x}__{n}' for x in ('tavg', 'prec') for n, v in _LEVELS)} FROM daily GROUP BY 1, 2) SELECT region, {', '.join(R(f'avg({x}__{n})', f'{x}__{n}') for x in ('tavg', 'prec') for n, _ in _LEVELS)} FROM q GROUP BY region")
def region_fingerprint(spark, sf_dir):
    return rounded(assembly.fingerprint(_seasonal(spark, sf_dir), ["tavg", "prec"]))


_POOLS = "pools AS (SELECT p.*, back <= 2 AS test FROM panel p JOIN (SELECT *, row_number() OVER (PARTITION BY region ORDER BY year DESC) AS back, count(*) OVER (PARTITION BY region) AS n FROM (SELECT DISTINCT region, year FROM panel)) USING (region, year) WHERE back <> 3 AND n >= 4)"


@query(f"WITH {PANEL}, {_POOLS} SELECT region, count(*) FILTER (WHERE NOT test) AS n_train, count(*) FILTER (WHERE test) AS n_test, " + ", ".join(R(f"{f}(y) FILTER (WHERE {w})", f"{k}_{n}") for n, w in (("train", "NOT test"), ("test", "test")) for k, f in (("mean", "avg"), ("std", "stddev_pop"))) + " FROM pools GROUP BY region")
def shift_moments(spark, sf_dir):
    rows = assembly.pools(panel(spark, sf_dir), by=["region"])
    return rounded(comparison.moments(rows.withColumn("late", F.col("pool") == "test"), value="y", group="late", by=["region"]))


@query(f"WITH {FRAME}, m AS (SELECT region, year, {_AGREE} AS rmse FROM frame GROUP BY GROUPING SETS ((region, year), (region))) SELECT region, {', '.join(R(f'max(rmse) FILTER (WHERE year = {y})', f'y{y}') for y in range(1996, 2002))}, {R('max(rmse) FILTER (WHERE year IS NULL)', 'overall')} FROM m GROUP BY region")
def metrics_wide_by_year(spark, sf_dir):
    scored = frame(spark, sf_dir).rollup("region", "year").agg(c.rmse(F.col("y"), F.col("y_pred")).alias("rmse")).where("region IS NOT NULL")
    return rounded(assembly.per_year_wide(scored, ["region"], range(1996, 2002), value="rmse"))


@query(f"WITH {PANEL} SELECT region, year, {R('y', 'y')} FROM panel WHERE (region + year) % 3 <> 0 AND (region + year) % 4 <> 0")
def common_pairs(spark, sf_dir):
    """The first of two tables with gaps, cut to the region years that both have."""
    p = panel(spark, sf_dir)
    return rounded(assembly.common_keys([p.where("(region + year) % 3 <> 0"), p.where("(region + year) % 4 <> 0")], ["region", "year"])[0])


@query(f"WITH {PANEL} SELECT region, year, {R('CASE WHEN year % 2 = 0 THEN y ELSE avg(y) FILTER (WHERE year % 2 = 0) OVER (PARTITION BY region) END', 'y')} FROM panel")
def fill_padding(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumns({"mask": F.col("year") % 2 == 0, "y": F.col("y") + d(0)})
    return rounded(assembly.fill_padding(rows, ["region"], ["y"]).drop("mask"))
