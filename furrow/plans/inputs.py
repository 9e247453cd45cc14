"""Queries of sensor series, crop responses, class labels, process-model files, national scores and input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import crops
from furrow.functions.columns import d
from furrow.operators import assembly, national, series
from furrow.plans.registry import DAILY, FRAME, REF, R, daily, frame, query, referenced, rounded, settled_panel, table

# --- series

_NEAR = """near AS (
  SELECT *, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS pa, last_value(v IGNORE NULLS) OVER p AS va,
    first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS pb, first_value(v IGNORE NULLS) OVER f AS vb
  FROM gap WINDOW p AS (PARTITION BY region ORDER BY day ROWS UNBOUNDED PRECEDING),
    f AS (PARTITION BY region ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_FILLED = "coalesce(v, va + (vb - va) * (pos - pa) / nullif(pb - pa, 0), va, vb)"


def _read(spark, sf_dir, scale) -> DataFrame:
    return daily(spark, sf_dir).select(F.col("region").cast("int").alias("region"), "day", (F.col("tavg") * scale).alias("v"))


@query(f"""WITH {DAILY}, read AS (SELECT CAST(region AS INTEGER) AS region, day, CAST(tavg AS DOUBLE) / 40 AS v FROM daily),
gap AS (SELECT region, day, CASE WHEN v BETWEEN -0.5 AND 1.05 THEN v END AS v, row_number() OVER (PARTITION BY region ORDER BY day) AS pos FROM read), {_NEAR}
SELECT region, day, {R(f'least(greatest({_FILLED}, 0.1), 1)', 'v')} FROM near""")
def sensor_ndvi(spark, sf_dir):
    """Daily means read as a vegetation index; some are sentinels."""
    return rounded(series.sensor_series(_read(spark, sf_dir, d(1) / 40), ["region"], "day", "v", "ndvi"))


@query(f"""WITH {DAILY}, read AS (SELECT CAST(region AS INTEGER) AS region, day, CAST(tavg AS DOUBLE) / 48 * CASE WHEN region % 2 = 0 THEN 100 ELSE 1 END AS v FROM daily),
share AS (SELECT region, day, CASE WHEN max(v) OVER (PARTITION BY region) > 1.05 THEN v / 100 ELSE v END AS v FROM read),
gap AS (SELECT region, day, CASE WHEN v BETWEEN -0.1 AND 1.05 THEN v END AS v, row_number() OVER (PARTITION BY region ORDER BY day) AS pos FROM share), {_NEAR}
SELECT region, day, {R(f'least(greatest({_FILLED}, 0), 1)', 'v')} FROM near""")
def sensor_fpar(spark, sf_dir):
    """Every other region reads in percent."""
    scale = d(1) / 48 * F.when(F.col("region") % 2 == 0, d(100)).otherwise(d(1))
    return rounded(series.sensor_series(_read(spark, sf_dir, scale), ["region"], "day", "v", "fpar"))


@query(f"""WITH {DAILY}, gap AS (
  SELECT CAST(region AS INTEGER) AS region, day, CASE WHEN dayofyear(day) % 4 <> 1 THEN CAST(tavg AS DOUBLE) - 20 END AS v, row_number() OVER (PARTITION BY region ORDER BY day) AS pos FROM daily), {_NEAR}
SELECT region, day, {R(f'greatest({_FILLED}, 0)', 'v')} FROM near""")
def soil_moisture(spark, sf_dir):
    rows = daily(spark, sf_dir).select(F.col("region").cast("int").alias("region"), "day", F.when(F.dayofyear("day") % 4 != 1, F.col("tavg").cast("double") - 20).alias("v"))
    return rounded(series.soil_moisture(rows, ["region"], "day", "v"))


@query(f"""WITH {DAILY}, t AS (
  SELECT region, day, tavg, coalesce(avg(CASE WHEN dayofyear(day) % 9 < 3 THEN CAST(tavg AS DOUBLE) END) OVER (PARTITION BY region ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) AS trend FROM daily)
SELECT region, day, {R('trend', 'trend')}, {R('CAST(tavg AS DOUBLE) - trend', 'rest')} FROM t""")
def masked_moving_average(spark, sf_dir):
    rows = daily(spark, sf_dir).select("region", "day", F.col("tavg").cast("double").alias("tavg"), (F.dayofyear("day") % 9 < 3).alias("observed"))
    return rounded(series.masked_moving_average(rows, ["region"], "day", "tavg", "observed", 7).select("region", "day", "trend", "rest"))


_TURNS = {
    "doy": "dayofyear(day) / 365.0::DOUBLE", "month": "(month(day) - 1) / 12.0::DOUBLE",
    "season": "least(greatest(date_diff('day', make_date(year(day), 3, 1), day) / 214.0::DOUBLE, 0), 1)",
}
_BINNED = {f"{k}_{f}": f"avg({f}(6.283185307179586::DOUBLE * ({v})))" for k, v in _TURNS.items() for f in ("sin", "cos")}


@query(f"""WITH {DAILY}, e AS (
  SELECT region, day + CAST((8 - isodow(day)) % 7 AS INTEGER) AS period, {', '.join(f'{v} AS {k}' for k, v in _BINNED.items())} FROM daily WHERE month(day) <> 2 GROUP BY ALL),
ends AS (SELECT region, min(period) AS a, max(period) AS b FROM e GROUP BY region),
bins AS (SELECT region, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS period FROM ends)
SELECT region, period, {', '.join(R(k, k) for k in _BINNED)} FROM bins LEFT JOIN e USING (region, period)""")
def binned_encodings(spark, sf_dir):
    """Weeks of a calendar without February."""
    first, last = (F.make_date(F.year("day"), F.lit(m), F.lit(1)) for m in (3, 10))
    rows = daily(spark, sf_dir).where(F.month("day") != 2).select("region", "day")
    return rounded(series.binned_encodings(rows, ["region"], "day", first, last, "weekly"))


# --- responses and labels


def _assimilation_sql(v: dict) -> str:
    inside, spare = v["inner"] * 400, v["inner"] * 400 - v["compensation"]
    low, best, high = (f"{v[k]}::DOUBLE" for k in ("low", "best", "high"))
    warmth = f"CASE WHEN t > {low} AND t < {high} THEN least(greatest((({high} - t) / ({high} - {best})) * pow((t - {low}) / ({best} - {low}), ({best} - {low}) / ({high} - {best})), 0), 1) ELSE 0 END"
    share = f"{spare / (inside + v['half_rate'])!r}::DOUBLE" if v["half_rate"] else "1"
    return f"""(SELECT 2 * a * j / (a + j + 1e-9) * q / (q + 100) * p / (p + {v['half_rain']}::DOUBLE) FROM (
      SELECT 150 * w * {share} AS a, 0.1::DOUBLE * q * w * {spare / (4 * inside + 8 * v['compensation'])!r}::DOUBLE AS j FROM (SELECT {warmth} AS w)))"""


_MAIZE, _WHEAT = _assimilation_sql(crops.MAIZE), _assimilation_sql(crops.OTHER)


@query(f"""WITH {DAILY}, s AS (
  SELECT region, day, CAST(tavg AS DOUBLE) AS t, sum(CAST(prec AS DOUBLE)) OVER w AS p, 0.48::DOUBLE * sum(CAST(rad AS DOUBLE)) OVER w AS q
  FROM daily WINDOW w AS (PARTITION BY region, year(day) ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT region, day, round(coalesce({_MAIZE}, 0), 4) + 0 AS maize, round(coalesce({_WHEAT}, 0), 4) + 0 AS wheat FROM s""")
def assimilation_index(spark, sf_dir):
    w = Window.partitionBy("region", F.year("day")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily(spark, sf_dir).withColumns({"p": F.sum(F.col("prec").cast("double")).over(w), "q": F.sum(F.col("rad").cast("double")).over(w)})
    both = {k: F.round(crops.assimilation_index(F.col("tavg").cast("double"), F.col("p"), F.col("q"), k), 4) + d(0) for k in ("maize", "wheat")}
    return rows.select("region", "day", *[v.alias(k) for k, v in both.items()])


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)


@query(f"""WITH raw AS (SELECT p_partkey, CAST(CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN -9 ELSE p_partkey % 12 END AS INTEGER) AS r FROM part),
names AS (SELECT * FROM (VALUES {_values(crops.SUITABILITY.items())}) AS t(r, name))
SELECT p_partkey, nullif(r, -9) AS code, CASE WHEN coalesce(r, -9) = -9 THEN 'NoData (outside raster coverage / masked)' ELSE coalesce(name, 'unrecognized class code ' || r) END AS label,
  CASE WHEN coalesce(r, -9) = -9 THEN 'unknown' WHEN r IN (0, 5, 6, 7, 8, 9) THEN 'low' ELSE 'high' END AS confidence
FROM raw LEFT JOIN names USING (r)""")
def suitability_labels(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 13 == 0, None).when(k % 11 == 0, -9).otherwise(k % 12)
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(n) for n, v in crops.suitability(raw).items()])


@query(f"""WITH raw AS (SELECT p_partkey, CAST(CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 33 END AS INTEGER) AS r FROM part),
names AS (SELECT * FROM (VALUES {_values((k, *v) for k, v in crops.CLIMATES.items())}) AS t(r, name, about))
SELECT p_partkey, CASE WHEN name IS NOT NULL THEN r END AS code, coalesce(name, 'NoData') AS label, coalesce(name[1], 'NoData') AS main_group, coalesce(about, 'Outside raster coverage') AS description
FROM raw LEFT JOIN names USING (r)""")
def climate_codes(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 13 != 0, F.col("p_partkey") % 33)
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(n) for n, v in crops.climate_code(raw).items()])


# --- process models and residuals


@query("""WITH reg AS (
  SELECT o_orderstatus AS crop, CAST(c_nationkey AS INTEGER) AS country, 'r' || CAST(o_custkey % 3 AS VARCHAR) AS file, o_custkey AS region, year(o_orderdate) AS year, o_totalprice / 1000.0::DOUBLE AS v
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 4 <> 0),
nat AS (SELECT l_linestatus AS crop, CAST(s_nationkey AS INTEGER) AS country, 'n' AS file, year(l_shipdate) AS year, CAST(l_quantity AS DOUBLE) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
one AS (SELECT * FROM reg SEMI JOIN (SELECT crop, country, min(file) AS file FROM reg GROUP BY ALL) USING (crop, country, file))
SELECT crop, country, 'region' AS level, region, CAST(year AS INTEGER) AS year, round(v, 6) AS v FROM one WHERE year BETWEEN 1996 AND 1998
UNION ALL SELECT crop, country, 'country', NULL, CAST(year AS INTEGER), round(v, 6) FROM nat ANTI JOIN reg USING (crop, country) WHERE year BETWEEN 1996 AND 1998""")
def process_series(spark, sf_dir):
    """Orders as regional files of three out of four nations, lines as national files of all."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    nation = lambda x: F.col(x).cast("int").alias("country")
    day = lambda x: F.col(x).cast("string").alias("date")
    regional = orders.join(customer, orders.o_custkey == customer.c_custkey).where("c_nationkey % 4 <> 0")
    regional = regional.select(F.col("o_orderstatus").alias("crop"), nation("c_nationkey"), F.concat(F.lit("r"), (F.col("o_custkey") % 3).cast("string")).alias("file"), F.col("o_custkey").alias("region"), day("o_orderdate"), (F.col("o_totalprice") / d(1000)).alias("v"))
    whole = line.join(supplier, line.l_suppkey == supplier.s_suppkey).select(F.col("l_linestatus").alias("crop"), nation("s_nationkey"), F.lit("n").alias("file"), day("l_shipdate"), F.col("l_quantity").cast("double").alias("v"))
    return rounded(national.process_series(regional, whole, "v", [1996, 1997, 1998]))


_SKILLS = [(f"rmse_ref_{k}", f"mae_ref_{k}", k) for k in national.REFERENCES]


@query(f"""WITH {FRAME}, z AS (SELECT n_nationkey AS region, CAST(n_regionkey AS INTEGER) AS zone FROM nation),
means AS (SELECT zone, year, avg(y) AS y FROM panel JOIN z USING (region) GROUP BY ALL),
pairs AS (SELECT * FROM means JOIN (SELECT zone, year, arg_min(y_pred, region) AS p FROM frame JOIN z USING (region) GROUP BY ALL) USING (zone, year)),
fit AS (SELECT zone, regr_slope(y, p) AS slope, avg(y) AS my, avg(p) AS mp FROM pairs WHERE year <= 1998 GROUP BY zone HAVING count(*) >= 3),
known AS (SELECT *, max(year) OVER (PARTITION BY zone) AS newest FROM means WHERE year <= 1999),
flat AS (SELECT zone, avg(y) AS climatology, avg(y) FILTER (WHERE year >= newest - 2) AS rolling3, regr_slope(y, year) AS b, avg(year) AS mx, median(year) AS tx, median(y) AS ty FROM known GROUP BY zone),
ts AS (SELECT zone, median((k.y - j.y) / (k.year - j.year)) AS tb FROM known j JOIN known k USING (zone) WHERE j.year < k.year GROUP BY zone),
rows AS (
  SELECT zone, y, greatest(my + slope * (p - mp), 0) AS m, climatology, rolling3, climatology + b * (year - mx) AS ols, ty + tb * (year - tx) AS trend
  FROM pairs JOIN fit USING (zone) JOIN flat USING (zone) JOIN ts USING (zone) WHERE year >= 2000),
s AS (SELECT zone, count(*) AS n, sqrt(avg((y - m) ** 2)) AS rmse, avg(abs(y - m)) AS mae, {', '.join(f'sqrt(avg((y - {k}) ** 2)) AS {a}, avg(abs(y - {k})) AS {b}' for a, b, k in _SKILLS)} FROM rows GROUP BY zone)
SELECT zone, n, {R('rmse', 'rmse')}, {R('mae', 'mae')}, {', '.join(f"{R(a, a)}, {R(b, b)}, {R(f'1 - rmse / {a}', f'skill_rmse_vs_{k}')}, {R(f'1 - mae / {b}', f'skill_mae_vs_{k}')}" for a, b, k in _SKILLS)} FROM s""")
def national_evaluation(spark, sf_dir):
    """Nations as regions of five zones; the model of a zone is the last year's value of its first nation."""
    p = settled_panel(spark, sf_dir)
    zones = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region"), F.col("n_regionkey").cast("int").alias("zone"))
    years = list(range(1990, 1999))
    out = national.evaluation(p.join(zones, "region"), frame(spark, sf_dir, p).join(zones, "region"), years, [1999], list(range(2000, 2010)), by=["zone"])
    return rounded(out.select("zone", "n", "rmse", "mae", *[f"{m}_ref_{k}" for m in ("rmse", "mae") for k in national.REFERENCES], *[f"skill_{m}_vs_{k}" for m in ("rmse", "mae") for k in national.REFERENCES]))


@query(f"""WITH {REF}, s AS (SELECT avg(y) AS m, stddev_pop(y) AS sd FROM train)
SELECT region, year, {R('((y_pred - ref_trend) / 10 + (ref_trend - m) / sd) * sd + m', 'y_pred')} FROM ref, s""")
def residual_trend(spark, sf_dir):
    p = settled_panel(spark, sf_dir)
    rows = referenced(spark, sf_dir, p).withColumn("residual", (F.col("y_pred") - F.col("ref_trend")) / 10).drop("y_pred")
    return rounded(national.add_trend(rows, p.where("year <= 1999")).select("region", "year", "y_pred"))


# --- input tables


@query("""WITH a AS (SELECT s_nationkey % 4 AS country, s_nationkey AS region, avg(CAST(s_acctbal AS DOUBLE)) AS v FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY ALL),
b AS (SELECT c_nationkey % 4 AS country, c_nationkey AS region, avg(CAST(c_acctbal AS DOUBLE)) AS v FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY ALL)
SELECT CAST(country AS INTEGER) AS country, CAST(region AS INTEGER) AS region, round(a.v, 6) AS supply_balance, round(b.v, 6) AS demand_balance
FROM a FULL JOIN b USING (country, region) WHERE region % 7 <> 0""")
def region_features(spark, sf_dir):
    """Means of suppliers and of customers; either lacks some nations, and targets lack others."""
    def rows(name: str, key: str, value: str) -> DataFrame:
        k = F.col(key).cast("int")
        return table(spark, sf_dir, name).select((k % 4).alias("country"), k.alias("region"), F.col(value).alias("balance"), F.lit(1999).alias("year"))

    targets = table(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("int") % 4).alias("country"), F.col("n_nationkey").cast("int").alias("region")).where("region % 7 <> 0")
    sources = {"supply": rows("supplier", "s_nationkey", "s_acctbal").where("region % 3 <> 0"), "demand": rows("customer", "c_nationkey", "c_acctbal").where("region % 5 <> 0")}
    return rounded(assembly.region_features(sources, targets))


@query("""WITH k AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS k, o_orderstatus AS s FROM orders),
j AS (SELECT year, k, a.k IS NOT NULL AND a.s IS NOT NULL AS l, b.s IS NOT NULL AS r FROM (FROM k WHERE s = 'O') a FULL JOIN (FROM k WHERE s = 'F') b USING (year, k))
SELECT year, count(*) FILTER (WHERE l AND r) AS both, count(*) FILTER (WHERE l AND NOT r) AS only_left, count(*) FILTER (WHERE r AND NOT l) AS only_right, round(count(*) FILTER (WHERE l AND r) / count(*), 6) + 0 AS jaccard FROM j GROUP BY year""")
def key_overlap(spark, sf_dir):
    """Customers with open and with finished orders, by year."""
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_custkey", "o_orderstatus")
    return rounded(assembly.key_overlap(rows.where("o_orderstatus = 'O'"), rows.where("o_orderstatus = 'F'"), ["year", "o_custkey"], ["year"]))


@query(f"""SELECT o_orderpriority AS run_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS region, {R('CAST(o_totalprice AS DOUBLE) / 1000', 'y_true')},
  {', '.join(R(f'CAST(o_totalprice AS DOUBLE) / {v}', n) for n, v in (('y_pred', 990), ('q10', 1100), ('q90', 900)))} FROM orders""")
def prediction_rows(spark, sf_dir):
    """Orders packed in batches of a priority and year, and laid out again."""
    value = F.col("o_totalprice").cast("double")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run_id"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 64).alias("batch"), F.struct("o_orderkey", value.alias("v")).alias("r"))
    packed = rows.groupBy("run_id", "year", "batch").agg(F.collect_list("r").alias("r"))
    by = lambda f: F.transform("r", lambda x: f(x["v"]))
    batches = packed.select("run_id", "year", F.col("r.o_orderkey").alias("regions"), by(lambda v: v / 1000).alias("targets"), by(lambda v: v / 990).alias("preds"), by(lambda v: F.array(v / 1100, v / 900)).alias("quantiles"))
    return rounded(assembly.prediction_rows(batches, ["run_id"], [0.1, 0.9]))


@query("""WITH s AS (SELECT s_nationkey AS region, arg_max((s_suppkey % 10)::DOUBLE, s_suppkey) AS code FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1),
c AS (SELECT p_partkey % 25 AS region, arg_max(CASE p_size % 3 WHEN 1 THEN 'Cfa' ELSE 'BSk' END, p_partkey) AS label FROM part WHERE p_partkey % 2 = 0 AND p_size % 3 <> 0 GROUP BY 1)
SELECT c_custkey, code AS suitability_code, label AS climate_label FROM customer LEFT JOIN s ON s.region = c_nationkey LEFT JOIN c ON c.region = c_nationkey""")
def label_lookups(spark, sf_dir):
    k = F.col("s_suppkey")
    suitability = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("region"), k.alias("line"), F.when(k % 4 != 0, k % 10).alias("raw_class_code"))
    size = F.col("p_size") % 3
    climate = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("region"), F.col("p_partkey").alias("line"), F.when(F.col("p_partkey") % 2 == 0, "maize").otherwise("wheat").alias("crop"), F.when(size == 0, "NoData").when(size == 1, "Cfa").otherwise("BSk").alias("climate_label"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("region"))
    return assembly.label_lookups(rows, suitability, climate, "maize").drop("region")


@query("SELECT crop, country, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years FROM (SELECT DISTINCT o_orderstatus AS crop, o_orderpriority AS country, year(o_orderdate) AS year FROM orders) GROUP BY ALL")
def dataset_years(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("crop"), F.col("o_orderpriority").alias("country"), F.year("o_orderdate").alias("year"))
    return assembly.dataset_years(rows).withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ","))
