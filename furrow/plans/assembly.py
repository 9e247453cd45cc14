"""Queries of sample assembly, quarantine, result unions, file choice and array quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.operators import assembly, catalogue
from furrow.plans.registry import DAILY, R, daily, query, rounded, table
from furrow.sources import quarantine
from furrow.streaming import events

# --- samples

_SEASONS = """seasons AS (
  SELECT n_nationkey AS region, y AS year, make_date(y, n_nationkey % 6 + 1, n_nationkey % 28 + 1) AS sos, make_date(y, n_nationkey % 6 + 1, n_nationkey % 28 + 1) + CAST(60 + 3 * n_nationkey AS INTEGER) AS cutoff
  FROM nation, range(1997, 2000) AS t(y))"""


def seasons(spark, sf_dir) -> DataFrame:
    """A season per nation and year: it begins in the first half of the year and lasts two to five months."""
    key = F.col("n_nationkey").cast("int")
    years = table(spark, sf_dir, "nation").select(key.alias("k"), F.explode(F.array(*map(F.lit, range(1997, 2000)))).alias("year"))
    begin = F.make_date("year", F.col("k") % 6 + 1, F.col("k") % 28 + 1)
    return years.select(F.col("k").alias("region"), "year", begin.alias("sos"), F.date_add(begin, 60 + 3 * F.col("k")).alias("cutoff"))


def _dated(spark, sf_dir) -> DataFrame:
    return daily(spark, sf_dir).select(F.col("region").cast("int").alias("region"), F.year("day").alias("year"), "day", *[F.col(x).cast("double").alias(x) for x in ("tavg", "prec")])


@query(f"""WITH {DAILY}, {_SEASONS},
monday AS (SELECT *, sos + CAST((8 - isodow(sos)) % 7 AS INTEGER) AS first FROM seasons),
ticks AS (SELECT region, year, cutoff, CAST(unnest(generate_series(CAST(first AS TIMESTAMP), CAST(cutoff AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS target FROM monday),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY region, year ORDER BY target) - 1 AS INTEGER) AS position FROM ticks WHERE NOT (month(target) = 2 AND dayofmonth(target) = 29)),
means AS (
  SELECT p.region, p.year, p.position, avg(CAST(tavg AS DOUBLE)) AS tavg, avg(CAST(prec AS DOUBLE)) AS prec
  FROM placed p JOIN daily d ON d.region = p.region AND year(d.day) = p.year AND d.day >= p.target AND d.day < p.target + 7 AND d.day <= p.cutoff GROUP BY ALL)
SELECT p.region, p.year, p.position, p.target, m.tavg IS NOT NULL AS mask, {R('m.tavg', 'tavg')}, {R('m.prec', 'prec')}
FROM placed p LEFT JOIN means m USING (region, year, position)""")
def sample_series(spark, sf_dir):
    """Weekly samples, their arrays laid out as rows."""
    made = assembly.samples(seasons(spark, sf_dir), _dated(spark, sf_dir), ["tavg", "prec"], "weekly")
    return rounded(made.select("region", "year", F.posexplode("series").alias("position", "s")).select("region", "year", "position", "s.*"))


_TURN = "6.283185307179586::DOUBLE * dayofyear({0}) / 365"


@query(f"""WITH {_SEASONS}, soil AS (SELECT n_nationkey AS region, n_nationkey / 50.0::DOUBLE AS awc, 1 + n_regionkey / 10.0::DOUBLE AS bulk_density FROM nation WHERE n_nationkey % 7 <> 0)
SELECT region, year, {R('awc', 'awc')}, {R('bulk_density', 'bulk_density')}, CASE WHEN region % 5 <> 0 THEN (region * 3 % 90)::DOUBLE END AS latitude, CASE WHEN region % 5 <> 0 THEN (region * 7 % 180 - 90)::DOUBLE END AS longitude,
  {', '.join(R(f"{f}({_TURN.format(x)})", f'{n}_{f}') for n, x in (('sos', 'sos'), ('eos', '(sos + 150)')) for f in ('sin', 'cos'))}, dayofyear(cutoff)::DOUBLE AS cutoff_day, 150::DOUBLE AS season_length
FROM seasons LEFT JOIN soil USING (region)""")
def sample_statics(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("region", F.col("n_nationkey").cast("int"))
    soil = nation.where("region % 7 <> 0").select("region", (F.col("region") / F.lit(50.0)).alias("awc"), (1 + F.col("n_regionkey") / F.lit(10.0)).alias("bulk_density"))
    place = nation.where("region % 5 <> 0").select("region", (F.col("region") * 3 % 90).alias("latitude"), (F.col("region") * 7 % 180 - 90).alias("longitude"))
    rows = seasons(spark, sf_dir).withColumn("eos", F.date_add("sos", 150))
    return rounded(assembly.statics(rows, soil, place).select("region", "year", "statics.*"))


# --- rows that break a rule

_POINTS = """points AS (
  SELECT CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE 'c' || c_custkey END AS adm_id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / 80 END AS latitude, c_acctbal / 50 AS longitude FROM customer)"""


def points(spark, sf_dir) -> DataFrame:
    """Customers as locations; some have no id, no latitude, or one beyond the poles."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.when(key % 17 == 0, " ").otherwise(F.concat(F.lit("c"), key.cast("string"))).alias("adm_id"), F.when(key % 11 != 0, F.col("c_acctbal") / 80).cast("double").alias("latitude"), (F.col("c_acctbal") / 50).cast("double").alias("longitude")
    )


@query(f"""WITH {_POINTS}, r AS (
  SELECT *, CASE WHEN trim(adm_id) <> '' THEN '' ELSE 'no id;' END || CASE WHEN coalesce(latitude BETWEEN -90 AND 90, false) THEN '' ELSE 'latitude;' END || CASE WHEN coalesce(longitude BETWEEN -180 AND 180, false) THEN '' ELSE 'longitude;' END AS reasons FROM points)
SELECT adm_id, {R('latitude', 'latitude')}, {R('longitude', 'longitude')}, reasons FROM r""")
def quarantined_points(spark, sf_dir):
    """Both outputs of one scan: rows that hold have no reasons."""
    done = quarantine.split(points(spark, sf_dir), {k: v() for k, v in quarantine.POINT_RULES.items()})
    bad = done.bad.withColumn("reasons", F.array_join(F.transform("reasons", lambda r: F.concat(r, F.lit(";"))), ""))
    return rounded(done.good.withColumn("reasons", F.lit("")).unionByName(bad))


# --- results, files, arrays, windows


@query("""WITH a AS (SELECT o_custkey AS k, o_orderpriority AS m, o_orderkey AS o, CAST(o_totalprice AS DOUBLE) AS v, 0 AS side FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT o_custkey, o_orderpriority, o_orderkey, CAST(o_totalprice AS DOUBLE), 1 FROM orders WHERE o_orderkey % 2 = 1)
SELECT k, m, o, v FROM (SELECT *, row_number() OVER (PARTITION BY k, m ORDER BY side, o) AS place FROM (FROM a UNION ALL FROM b)) WHERE place = 1""")
def union_first(spark, sf_dir):
    """Of the orders of a customer and priority the first stays, even keys before odd ones."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("m"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").cast("double").alias("v"))
    return assembly.union_first(rows.where("o % 2 = 0"), rows.where("o % 2 = 1"), ["k", "m"], ["o"])


_CROPS = ("mze", "whe", "bar")
_WATERS = ("rf", "ir", "irx")


@query("""WITH files AS (
  SELECT 'S' || p_partkey % 9 AS mapset, p_partkey AS place, CASE WHEN p_partkey % 13 = 0 THEN 'SSP126' ELSE 'H' END || '.' || (1961 + p_partkey * 30 % 90) || '.' || ['mze', 'whe', 'bar'][p_partkey // 7 % 3 + 1] || '.' || ['rf', 'ir', 'irx'][p_partkey // 5 % 3 + 1] || '.' || p_size AS code
  FROM part),
asks AS (
  SELECT s_suppkey AS id, ['S' || s_suppkey % 11, 'S' || (s_suppkey + 3) % 9] AS sets, CASE WHEN s_suppkey % 4 <> 0 THEN ['mze', 'whe', 'bar'][s_suppkey % 3 + 1] END AS crop,
    CASE WHEN s_suppkey % 5 <> 0 THEN CAST(1961 + s_suppkey * 30 % 150 AS VARCHAR) END AS period, CASE WHEN s_suppkey % 3 = 0 THEN ['irx', 'rf'] ELSE ['ir'] END AS waters FROM supplier),
m AS (SELECT a.*, k, a.sets[k] AS mapset FROM asks a, range(1, 3) AS t(k)),
f AS (
  SELECT m.*, code, place, CASE WHEN period IS NULL OR contains(code, period) THEN 0 ELSE 1 END AS other, coalesce(list_min([i FOR w, i IN waters IF contains(code, '.' || w)]), 99) AS water
  FROM m JOIN files USING (mapset) WHERE code NOT LIKE 'SSP%' AND (crop IS NULL OR contains(code, '.' || crop || '.') OR suffix(code, '.' || crop))),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, other, water, place) AS r FROM f) WHERE r = 1)
SELECT a.id, b.code, b.mapset, CASE WHEN b.water < 99 THEN b.waters[b.water] END AS water,
  CASE WHEN b.code IS NOT NULL THEN CASE a.period WHEN '1961' THEN '_old' WHEN '1991' THEN '_new' ELSE '' END || CASE WHEN b.water < 99 AND b.waters[b.water] = 'ir' THEN '_irrigated' ELSE '' END END AS suffix
FROM asks a LEFT JOIN b USING (id)""")
def chosen_files(spark, sf_dir):
    """Parts stand for the files of a catalogue, suppliers for requests."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    text = lambda x: x.cast("string")
    head = F.when(p % 13 == 0, "SSP126").otherwise("H")
    code = F.concat_ws(".", head, text(1961 + p * 30 % 90), pick(_CROPS, F.floor(p / 7)), pick(_WATERS, F.floor(p / 5)), text(F.col("p_size")))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("S"), text(p % 9)).alias("mapset"), code.alias("code"), p.alias("place"))
    sets = F.array(F.concat(F.lit("S"), text(s % 11)), F.concat(F.lit("S"), text((s + 3) % 9)))
    waters = F.when(s % 3 == 0, F.array(F.lit("irx"), F.lit("rf"))).otherwise(F.array(F.lit("ir")))
    asks = table(spark, sf_dir, "supplier").select(s.alias("id"), sets.alias("sets"), F.when(s % 4 != 0, pick(_CROPS, s)).alias("crop"), F.when(s % 5 != 0, text(1961 + s * 30 % 150)).alias("period"), waters.alias("waters"))
    return catalogue.choose(asks, files, period_names={"1961": "old", "1991": "new"}, water_names={"ir": "irrigated"}).select("id", "code", "mapset", "water", "suffix")


@query(f"SELECT l_orderkey, {', '.join(R(f'quantile_cont(CAST(l_quantity AS DOUBLE), {t})', f'q{round(100 * t)}') for t in (0.1, 0.5, 0.9))} FROM lineitem GROUP BY l_orderkey")
def sample_quantiles(spark, sf_dir):
    """Quantiles of the samples of each order, held as an array (a handful of lines each)."""
    arrays = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("samples"))
    return rounded(arrays.select("l_orderkey", *[q.alias(f"q{round(100 * t)}") for t, q in zip((0.1, 0.5, 0.9), c.array_quantiles(F.col("samples"), (0.1, 0.5, 0.9)))]))


@query(f"""SELECT w AS start, event_type, count(*) AS n, {R('sum(value)', 'total')}
FROM (SELECT event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 12 HOUR, date_trunc('day', ts) + INTERVAL 12 HOUR]) AS w, ts FROM events) WHERE ts >= w AND ts < w + INTERVAL 1 DAY GROUP BY w, event_type""")
def event_sliding(spark, sf_dir):
    """Windows of a day every twelve hours."""
    out = events.window_counts(events.with_event_time(table(spark, sf_dir, "events")), slide="12 hours", by=("event_type",))
    return rounded(out).withColumn("start", F.col("start").cast("timestamp_ntz"))
