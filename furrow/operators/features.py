"""Lags, seasonal sums, stress counts, normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d


def lags(panel: DataFrame, *, region: str = "region", year: str = "year", y: str = "y", steps: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``panel`` with lag_k: the value k years before, by key (years have gaps), null if absent."""
    out = panel
    for k in steps:
        out = out.join(panel.select(region, (F.col(year) + k).alias(year), F.col(y).alias(f"lag_{k}")), [region, year], "left")
    return out


def seasonal_sums(daily: DataFrame, keys: Sequence[str], day: str, crop: str) -> DataFrame:
    """gdd, cum_gdd (null from the first gap on), cum_prec, cum_rad (gaps skipped) and the radiation-use index."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("gdd", c.degree_days(F.col("tavg"), crop))
    gap = F.max(F.col("gdd").isNull()).over(w)
    out = out.withColumns({"cum_gdd": F.when(~gap, F.sum("gdd").over(w)), "cum_prec": F.coalesce(F.sum("prec").over(w), d(0)), "cum_rad": F.coalesce(F.sum("rad").over(w), d(0))})
    return out.withColumn("rue_index", c.radiation_use(F.col("cum_rad"), F.col("tavg"), F.col("prec"), crop))


def stress_counts(daily: DataFrame, keys: Sequence[str], crop: str) -> DataFrame:
    """Counts of hot, frost, cold, dry and wet days and two shares of the valid days (at least one)."""
    hot = 35.0 if crop == "maize" else 30.0
    count = lambda x: F.count_if(x)
    valid = F.greatest(F.count("tavg"), F.lit(1)).cast("double")
    return daily.groupBy(*keys).agg(
        count(F.col("tmax") > hot).alias("heat_days"), count(F.col("tmin") < 0).alias("frost_days"), count(F.col("tmin") < 5).alias("cold_days"), count(F.col("prec") < 1).alias("dry_days"),
        count(F.col("prec") > 10).alias("wet_days"), (count(F.col("tmax") > hot) / valid).alias("heat_share"), (count(F.col("prec") < 1) / valid).alias("dry_share"),
    )


def fit_scale(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, mean, std) of the training rows; a std of 0 or none becomes 1."""
    stats = train.agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"m_{n}").alias("mean"), F.coalesce(F.nullif(f"s_{n}", d(0)), d(1)).alias("std")) for n in names])
    return stats.select(F.explode(rows).alias("x")).select("x.*")


def apply_scale(df: DataFrame, stats: DataFrame, names: Sequence[str]) -> DataFrame:
    """z-scores of the named columns; missing values and features without spread become 0."""
    wide = stats.agg(*[f.alias(f"{k}_{n}") for n in names for k, f in (("m", F.max(F.when(F.col("feature") == n, F.col("mean")))), ("s", F.max(F.when(F.col("feature") == n, F.col("std")))))])
    z = lambda n: F.when(F.col(f"s_{n}") < 1e-8, d(0)).otherwise(F.coalesce((F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}"), d(0)))
    return df.join(F.broadcast(wide)).withColumns({n: z(n) for n in names}).select(*df.columns)


def impute_mean(df: DataFrame, train: DataFrame, names: Sequence[str]) -> DataFrame:
    """Missing values take the training mean, or 0 without one."""
    means = train.agg(*[F.avg(n).alias(f"m_{n}") for n in names])
    return df.join(F.broadcast(means)).withColumns({n: F.coalesce(n, f"m_{n}", d(0)) for n in names}).select(*df.columns)


def channel_summary(df: DataFrame, keys: Sequence[str], step: str, value: str, bins: int = 4) -> DataFrame:
    """Per key: means of equal parts of the observed steps, mean, std, extremes, slope over the step, last value."""
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).withColumns({"lo_": F.min(step).over(w), "hi_": F.max(step).over(w)})
    part = F.floor((F.col(step) - F.col("lo_")) * bins / (F.col("hi_") + 1 - F.col("lo_")))
    means = [F.avg(F.when(part == k, F.col(value))).alias(f"bin_{k}") for k in range(bins)]
    return rows.groupBy(*keys).agg(*means, F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.coalesce(F.regr_slope(value, step), d(0)).alias("slope"), F.max_by(value, step).alias("last"))


def year_weights(panel: DataFrame, *, year: str = "year", tau: float = 10.0) -> DataFrame:
    """``panel`` with exponential weights of mean 1."""
    newest = panel.agg(F.max(year).alias("newest_"))
    raw = panel.join(F.broadcast(newest)).withColumn("weight", c.exponential_weight(F.col(year), F.col("newest_"), tau)).drop("newest_")
    return raw.join(F.broadcast(raw.agg(F.avg("weight").alias("mean_")))).withColumn("weight", F.col("weight") / F.col("mean_")).drop("mean_")


def decode(df: DataFrame, labels: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(labels))


def recursive_lag(test: DataFrame, train: DataFrame, *, region: str = "region", year: str = "year", y: str = "y", intercept: float = 0.0, weight: float = 1.0) -> DataFrame:
    """Predictions ``intercept + weight * lag`` year by year, where the lag of a test year is the prediction before it.

    A missing lag takes the training mean; predictions are clipped at 0 before they are passed on. The
    test years (a handful) are steps of one plan.
    """
    years = sorted(r[0] for r in test.select(year).distinct().collect())
    mean = train.agg(F.avg(y).alias("mean_"))
    known, out = train.select(region, F.col(year).alias("at_"), F.col(y).alias("lag_")), None
    for t in years:
        rows = test.where(F.col(year) == t).select(region, year, y)
        lagged = rows.join(known.where(F.col("at_") == t - 1).select(region, "lag_"), region, "left").join(F.broadcast(mean))
        now = lagged.select(region, year, y, F.greatest(d(intercept) + d(weight) * F.coalesce("lag_", "mean_"), d(0)).alias("y_pred"))
        out = now if out is None else out.unionByName(now)
        known = now.select(region, F.col(year).alias("at_"), F.col("y_pred").alias("lag_"))
    return out
