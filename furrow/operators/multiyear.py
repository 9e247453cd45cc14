"""Summaries of earlier seasons: weather, remote sensing, season dates and their trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d

#: Observed days that the end of a season is averaged over.
FINAL_DAYS = 30


def weather_summaries(daily: DataFrame, keys: Sequence[str], crop: str, *, heat_base: bool = False) -> DataFrame:
    """Twelve summaries of a season's observed days; null without temperatures or without rain readings.

    ``heat_base`` counts degree days from the heat threshold, as older feature tables did.
    """
    hot = 35.0 if crop == "maize" else 30.0
    gdd = F.greatest(F.least("tavg", d(c.GDD.get(crop, c.GDD_OTHER)[1])) - d(hot), d(0)) if heat_base else c.degree_days(F.col("tavg"), crop)
    days = lambda x: F.count_if(x).cast("double")
    warm = {"avg_temp": F.avg("tavg"), "max_temp": F.max("tmax"), "min_temp": F.min("tmin"), "temp_std": F.stddev_pop("tavg"), "gdd": F.sum(F.when(F.col("tavg").isNotNull(), gdd))}
    wet = {
        "total_precip": F.sum("prec"), "precip_std": F.stddev_pop("prec"), "heat_days": days(F.col("tmax") > hot), "frost_days": days(F.col("tmin") < 0),
        "cold_stress_days": days(F.col("tmin") < 5), "dry_days": days(F.col("prec") < 1), "wet_days": days(F.col("prec") > 10),
    }
    seen = lambda x, of: F.when((F.count("tavg") > 0) & (F.count(of) > 0), x)
    return daily.groupBy(*keys).agg(*[seen(v, of).alias(k) for block, of in ((warm, "tavg"), (wet, "prec")) for k, v in block.items()])


def remote_summaries(daily: DataFrame, keys: Sequence[str], day: str, *, channels: Sequence[str] = ("ndvi", "fpar", "ssm"), final: str = "ssm", days: int = FINAL_DAYS) -> DataFrame:
    """Peak, mean and integral of each channel, and the mean of the last observed days of ``final``."""
    seen = F.col(final).isNotNull()
    back = F.sum(seen.cast("int")).over(Window.partitionBy(*keys).orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0))
    blocks = [f(x).alias(f"{x}_{n}") for x in channels for n, f in (("max", F.max), ("mean", F.avg), ("integral", F.sum))]
    return daily.withColumn("back_", back).groupBy(*keys).agg(*blocks, F.avg(F.when(seen & (F.col("back_") <= days), F.col(final))).alias(f"{final}_final"))


def lookback(samples: DataFrame, seasons: DataFrame, names: Sequence[str], *, region: str = "region", year: str = "year", steps: Sequence[int] = (1, 2)) -> DataFrame:
    """``samples`` with name_k: the season k years before, by key, null if absent."""
    out = samples
    for k in steps:
        out = out.join(seasons.select(region, (F.col(year) + k).alias(year), *[F.col(n).alias(f"{n}_{k}") for n in names]), [region, year], "left")
    return out


def phenology_changes(seasons: DataFrame, *, region: str = "region", year: str = "year", sos: str = "sos", eos: str = "eos", steps: Sequence[int] = (1, 2)) -> DataFrame:
    """For each season: start, end (days of the year) and length of the season k years before, less its own."""
    dated = seasons.select(region, year, F.dayofyear(sos).alias("sos"), F.dayofyear(eos).alias("eos"), F.datediff(eos, sos).alias("length"))
    names = ("sos", "eos", "length")
    out = lookback(dated, dated, names, region=region, year=year, steps=steps)
    return out.select(region, year, *[(F.col(f"{n}_{k}") - F.col(n)).cast("double").alias(f"{n}_change_{k}") for k in steps for n in names])


def trends(samples: DataFrame, seasons: DataFrame, names: Sequence[str], *, region: str = "region", year: str = "year", window: int = 3) -> DataFrame:
    """(region, year, name_trend): slope over the ``window`` seasons before; 0 without spread, null under two seasons."""
    targets = samples.select(region, year).distinct()
    before = seasons.select(region, F.col(year).alias("x_"), *names)
    rows = targets.select(region, year, F.explode(F.sequence(F.col(year) - window, F.col(year) - 1)).alias("x_")).join(before, [region, "x_"])

    def slope(n: str) -> Column:
        return F.when(F.count(n) >= 2, F.coalesce(F.regr_slope(n, "x_"), d(0)))

    return targets.join(rows.groupBy(region, year).agg(*[slope(n).alias(f"{n}_trend") for n in names]), [region, year], "left")
