"""Process-model files with a national fallback, the national evaluation, and predictions of residuals from a trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.columns import d
from furrow.operators import reference, results

REFERENCES = ("trend", "ols", "climatology", "rolling3")


def process_series(regional: DataFrame, national: DataFrame, value: str, years: Sequence[int], *, by: Sequence[str] = ("crop", "country"), region: str = "region", date: str = "date", file: str = "file") -> DataFrame:
    """(by, level, region, year, value): each country's series from its first regional file by name or, without one, from its first national file.

    The year is the first four characters of the date; other years than ``years`` are left out. A chosen file without a
    value in them gives no rows, and no other takes its place. National rows have no region.
    """
    columns = [*by, file, date, value]
    rows = regional.select(*columns, region, F.lit(0).alias("rank_")).unionByName(national.select(*columns, F.lit(1).alias("rank_")), allowMissingColumns=True)
    rows = rows.withColumn("year", F.expr(f"try_cast(substring(`{date}`, 1, 4) AS int)")).withColumn("in_", F.coalesce(F.col("year").isin(*years), F.lit(False)))
    files = rows.groupBy(*by, "rank_", file).agg(F.bool_or(F.col("in_") & F.col(value).isNotNull()).alias("any_"))
    first = files.groupBy(*by).agg(F.min(F.struct("rank_", file, "any_")).alias("f")).where("f.any_").select(*by, "f.rank_", F.col(f"f.{file}").alias(file))
    level = F.when(F.col("rank_") == 0, "region").otherwise("country").alias("level")
    return rows.where("in_").join(first, [*by, "rank_", file]).select(*by, level, region, "year", value)


def evaluation(obs: DataFrame, model: DataFrame, train: Sequence[int], val: Sequence[int], test: Sequence[int], *, by: Sequence[str] = ("country",), region: str = "region", year: str = "year", y: str = "y", p: str = "y_pred") -> DataFrame:
    """(by, n, metrics, rmse_ref_*, mae_ref_*, skill_*): the model against the country's mean observation in the test years.

    A year's model value is that of its smallest region. It is corrected by the line of the train years (moved by the mean error where
    it is constant) and not below 0. The references are fitted on the means of train and val years: Theil-Sen trend, least squares,
    mean, and mean of the three newest calendar years. A country with under three train years or without a test year gives no row.
    """
    keyed = lambda df: df.withColumn("key_", F.struct(*by))
    means = keyed(obs.where(F.col(y).isNotNull())).groupBy("key_", year).agg(F.avg(y).alias("y"))  # a row per country and year from here on
    lines = keyed(model.where(F.col(p).isNotNull())).groupBy("key_", year).agg(F.min_by(p, region).cast("double").alias("p"))
    both = means.join(lines, ["key_", year])
    moved = ~(F.max("p") > F.min("p"))
    slope = F.when(moved, d(1)).otherwise(F.regr_slope("y", "p"))
    fit = both.where(F.col(year).isin(*train)).groupBy("key_").agg(F.count("*").alias("n_"), slope.alias("slope"), F.avg("y").alias("my"), F.avg("p").alias("mp")).where("n_ >= 3")
    fit = fit.select("key_", "slope", (F.col("my") - F.col("slope") * F.col("mp")).alias("intercept"))
    known = means.where(F.col(year).isin(*train, *val)).withColumn("new_", F.max(year).over(Window.partitionBy("key_")))
    flat = known.groupBy("key_").agg(
        F.avg("y").alias("climatology"), F.avg(F.when(F.col(year) >= F.col("new_") - 2, F.col("y"))).alias("rolling3"),
        F.coalesce(F.regr_slope("y", year), d(0)).alias("b"), F.avg(year).alias("mx"),
    )
    middle = reference.theil_sen(known, region="key_", year=year, y="y").select("key_", F.col("slope").alias("ts_b"), F.col("intercept").alias("ts_a"))
    rows = both.where(F.col(year).isin(*test)).join(fit, "key_").join(flat, "key_").join(middle, "key_")
    x = F.col(year)
    rows = rows.select(
        "key_.*", "y", F.greatest(F.col("slope") * F.col("p") + F.col("intercept"), d(0)).alias("y_pred"), "climatology", "rolling3",
        (F.col("climatology") + F.col("b") * (x - F.col("mx"))).alias("ols"), (F.col("ts_a") + F.col("ts_b") * x).alias("trend"),
    )
    out = results.process_metrics(rows, by, refs={k: k for k in REFERENCES})
    skill = lambda m, k: F.when(F.col(f"{m}_ref_{k}") > 0, 1 - F.col(m) / F.col(f"{m}_ref_{k}"))
    return out.withColumns({f"skill_{m}_vs_{k}": skill(m, k) for m in ("rmse", "mae") for k in REFERENCES})


def add_trend(frame: DataFrame, train: DataFrame, *, residual: str = "residual", trend: str = "ref_trend", y: str = "y") -> DataFrame:
    """``frame`` with y_pred: a predicted residual in standard units of the train values, put on top of the trend in the same units and brought back to those of y.

    Train values without spread count with a deviation of 1.
    """
    one = train.agg(F.avg(y).alias("mean_"), F.coalesce(F.nullif(F.stddev_pop(y), d(0)), d(1)).alias("std_"))
    whole = frame.join(F.broadcast(one))  # one row
    standard = F.col(residual) + (F.col(trend) - F.col("mean_")) / F.col("std_")
    return whole.withColumn("y_pred", standard * F.col("std_") + F.col("mean_")).drop("mean_", "std_")
