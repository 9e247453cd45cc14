"""Queries of result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import results
from furrow.plans.registry import FRAME, R, frame, query, rounded, table


@query("""WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, o_orderkey AS k, o_orderpriority AS arm, o_orderstatus AS crop, 0 AS t FROM orders WHERE o_orderkey % 3 = 0),
b AS (SELECT CAST(o_custkey AS VARCHAR), o_orderkey, o_orderpriority, NULL, 1 FROM orders WHERE o_orderkey % 3 = 1)
SELECT run_id, arm, crop FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, k) AS r FROM (FROM a UNION ALL FROM b)) WHERE r = 1""")
def run_identities(spark, sf_dir):
    """Customers as runs in two tier tables, the second without a crop."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("crop"))
    return results.run_identities([rows.where("k % 3 = 0"), rows.where("k % 3 = 1").drop("crop")], ["arm", "crop"], "k")


_WITHIN = [(f"within_{round(100 * t)}pct", f"y > 0 AND abs(y - p) / y <= {t}") for t in (0.01, 0.05, 0.1, 0.2)] + [(f"within_{str(t).replace('.', 'p')}abs", f"abs(y - p) <= {t}") for t in (0.1, 0.5)]


@query(f"""WITH {FRAME}, f AS (SELECT region, y, CASE WHEN year % 4 <> 3 THEN y_pred END AS p, q90 FROM frame), g AS (SELECT * FROM f WHERE p IS NOT NULL),
m AS (
  SELECT region, count(*) AS n, 1 - sum((y - p) ** 2) / nullif(var_pop(y) * count(*), 0) AS r2, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae, avg((y - p) ** 2) AS mse, sqrt(avg((y - p) ** 2)) / avg(y) AS nrmse,
    100 * avg(abs(y - p) / y) AS mape, 100 * avg(2 * abs(y - p) / (abs(y) + abs(p) + 1e-9)) AS smape, {', '.join(f'avg(CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0 END) AS {k}' for k, x in _WITHIN)} FROM g GROUP BY region),
r AS (SELECT region, sqrt(avg((y - q90) ** 2)) AS rmse_ref_high, avg(abs(y - q90)) AS mae_ref_high FROM f GROUP BY region)
SELECT region, n, {', '.join(R(x, x) for x in ('r2', 'rmse', 'mae', 'mse', 'nrmse', 'mape', 'smape', *(k for k, _ in _WITHIN), 'rmse_ref_high', 'mae_ref_high'))} FROM m JOIN r USING (region)""")
def process_metrics(spark, sf_dir):
    """Predictions that lack every fourth year, beside a reference that has all."""
    rows = frame(spark, sf_dir).withColumn("y_pred", F.when(F.col("year") % 4 != 3, F.col("y_pred")))
    return rounded(results.process_metrics(rows, ["region"], refs={"high": "q90"}))


@query("SELECT l_suppkey, " + ", ".join(f"max(CAST(l_quantity AS DOUBLE)) FILTER (WHERE l_returnflag = '{a}' AND l_linestatus = '{b}') AS {a.lower()}_{b.lower()}" for a in "ANR" for b in "OF") + " FROM lineitem GROUP BY l_suppkey")
def quality_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("double"))
    return results.pivot_suffixed(rows, ["l_suppkey"], dimension="l_returnflag", level="l_linestatus", value="quantity", dimensions="ANR", levels="OF")


@query("""WITH f AS (SELECT p_brand, p_partkey * 37 % 997 AS k, 'model-' || p_partkey || CASE WHEN p_partkey % 5 > 0 THEN '-val_loss=' || (p_partkey * 37 % 997 // 100) || '.' || lpad(CAST(p_partkey * 37 % 100 AS VARCHAR), 2, '0') ELSE '-last' END || '.ckpt' AS name FROM part),
l AS (SELECT p_brand, name, CAST(regexp_extract(name, 'loss=([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS loss FROM f WHERE name LIKE '%loss=%')
SELECT p_brand, name, loss FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY loss, name) AS r FROM l) WHERE r = 1""")
def best_checkpoints(spark, sf_dir):
    """Parts as checkpoint files of brands; every fifth has no loss in its name."""
    k = F.col("p_partkey")
    text = lambda x: x.cast("string")
    tail = F.when(k % 5 > 0, F.concat(F.lit("-val_loss="), text(F.floor(k * 37 % 997 / 100)), F.lit("."), F.lpad(text(k * 37 % 100), 2, "0"))).otherwise(F.lit("-last"))
    return results.best_checkpoint(table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("model-"), text(k), tail, F.lit(".ckpt")).alias("name")), ["p_brand"])
