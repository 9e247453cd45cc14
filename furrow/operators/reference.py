"""Reference forecasts fitted on training rows, one aggregation per region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.columns import d, ratio
from furrow.operators import order

MIN_TREND_YEARS = 5
LEVELS = (0.1, 0.5, 0.9)


def coefficients(train: DataFrame, *, region: str = "region", year: str = "year", y: str = "y") -> DataFrame:
    """(region, climatology, rolling3, slope, intercept, sigma): sigma null where a region has too few rows."""
    newest = F.row_number().over(Window.partitionBy(region).orderBy(F.desc(year)))
    train = train.where(F.col(y).isNotNull())  # a missing value takes no place among the newest
    rows = train.withColumn("newest", newest)
    long = F.count(y) >= MIN_TREND_YEARS
    slope = F.coalesce(F.when(long, F.regr_slope(y, year)), d(0))
    fit = rows.groupBy(region).agg(F.avg(y).alias("climatology"), F.avg(F.when(F.col("newest") <= 3, F.col(y))).alias("rolling3"), slope.alias("slope"), F.avg(year).alias("mean_year"), F.count(y).alias("n"))
    fit = fit.withColumn("intercept", F.col("climatology") - F.col("slope") * F.col("mean_year"))
    rest = train.join(fit, region).select(region, "n", (F.col(y) - F.col("intercept") - F.col("slope") * F.col(year)).alias("e"))
    own = rest.groupBy(region).agg(F.when(F.max("n") >= MIN_TREND_YEARS, F.stddev_samp("e")).alias("sigma"))
    return fit.join(own, region).select(region, "climatology", "rolling3", "slope", "intercept", "sigma")


def pooled(train: DataFrame, coef: DataFrame, *, region: str = "region", year: str = "year", y: str = "y", levels: Sequence[float] = LEVELS) -> DataFrame:
    """One row: overall mean, pooled sigma, and quantiles of the standardised residuals."""
    e = F.col(y) - F.col("intercept") - F.col("slope") * F.col(year)
    rows = train.join(coef, region).select(F.col(y).alias("y"), e.alias("e"), "sigma")
    sigma = rows.agg(F.stddev_samp("e").alias("pooled_sigma"), F.avg("y").alias("overall"))
    z = rows.join(F.broadcast(sigma)).select(F.when(F.coalesce("sigma", "pooled_sigma") > 0, F.col("e") / F.coalesce("sigma", "pooled_sigma")).alias("z"))
    found = order.percentiles(z, F.col("z"), {f"z{k}": t for k, t in enumerate(levels)})
    return sigma.crossJoin(found.select(F.array(*[f"z{k}" for k in range(len(levels))]).alias("z_levels")))  # one row each


def attach(frame: DataFrame, train: DataFrame, *, region: str = "region", year: str = "year", y: str = "y", levels: Sequence[float] = LEVELS) -> DataFrame:
    """``frame`` with ref_climatology, ref_rolling3, ref_trend, ref_sigma, horizon and ref_q* columns; unseen regions take overall values."""
    coef = coefficients(train, region=region, year=year, y=y)
    whole = pooled(train, coef, region=region, year=year, y=y, levels=levels).crossJoin(train.agg(F.max(year).alias("origin")))  # one row each
    out = frame.join(coef, region, "left").join(F.broadcast(whole))
    out = out.withColumns({
        "ref_climatology": F.coalesce("climatology", "overall"), "ref_rolling3": F.coalesce("rolling3", "overall"),
        "ref_trend": F.coalesce(F.col("intercept") + F.col("slope") * F.col(year), F.col("overall")), "ref_sigma": F.coalesce("sigma", "pooled_sigma"), "horizon": F.col(year) - F.col("origin"),
    })
    out = out.withColumns({f"ref_q{round(100 * t)}": F.col("ref_trend") + F.col("z_levels")[k] * F.col("ref_sigma") for k, t in enumerate(levels)})
    return out.drop("climatology", "rolling3", "slope", "intercept", "sigma", "overall", "pooled_sigma", "z_levels", "origin")


def theil_sen(train: DataFrame, *, region: str = "region", year: str = "year", y: str = "y") -> DataFrame:
    """(region, slope, intercept): median pair slope; under two rows slope 0 and the mean. A region has a row a year."""
    a, b = train.select(region, F.col(year).alias("x1"), F.col(y).alias("y1")), train.select(region, F.col(year).alias("x2"), F.col(y).alias("y2"))
    slopes = a.join(b, region).where("x1 < x2").groupBy(region).agg(F.percentile((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")), 0.5).alias("slope"))
    middle = train.groupBy(region).agg(F.percentile(year, 0.5).alias("mx"), F.percentile(y, 0.5).alias("my"), F.avg(y).alias("mean"))
    out = middle.join(slopes, region, "left")
    return out.select(region, F.coalesce("slope", d(0)).alias("slope"), F.when(F.col("slope").isNull(), F.col("mean")).otherwise(F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"))


def mann_kendall(train: DataFrame, *, region: str = "region", year: str = "year", y: str = "y", least: int = 5, most: int = 10, z_limit: float = 1.959964) -> DataFrame:
    """(region, length, z, slope, intercept) of the trailing window with the most significant trend.

    Windows of ``least`` to ``most`` newest rows are compared by |z| (ties: the shorter), which orders
    them as the p-values do; regions without |z| above the limit are left out.
    """
    back = F.row_number().over(Window.partitionBy(region).orderBy(F.desc(year)))
    rows = train.select(region, F.col(year).alias("x"), F.col(y).alias("v"), back.alias("back")).where(F.col("back") <= most)
    windows = rows.select("*", F.explode(F.sequence(F.greatest(F.col("back"), F.lit(least)), F.lit(most))).alias("length"))
    size = windows.groupBy(region, "length").agg(F.count("*").alias("n"), F.regr_slope("v", "x").alias("slope"), F.regr_intercept("v", "x").alias("intercept")).where("n = length")
    other = windows.select(region, "length", F.col("x").alias("x2"), F.col("v").alias("v2"))
    s = windows.join(other, [region, "length"]).where("x < x2").groupBy(region, "length").agg(F.sum(F.signum(F.col("v2") - F.col("v"))).alias("s"))
    ties = windows.groupBy(region, "length", "v").agg(F.count("*").alias("t")).groupBy(region, "length").agg(F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("ties"))
    n = F.col("n")
    var = (n * (n - 1) * (2 * n + 5) - F.col("ties")) / d(18)
    z = F.round(F.when(var > 0, (F.col("s") - F.signum("s")) / F.sqrt(F.nullif(var, d(0)))).otherwise(d(0)), 9)
    scored = size.join(s, [region, "length"]).join(ties, [region, "length"]).withColumn("z", z).where(F.abs("z") > z_limit)
    best = F.max_by(F.struct("length", "z", "slope", "intercept"), F.struct(F.abs("z"), -F.col("length")))
    return scored.groupBy(region).agg(best.alias("b")).select(region, "b.length", "b.z", "b.slope", "b.intercept")


def bias_table(fit: DataFrame, *, by: Sequence[str] = (), y: str = "y", p: str = "y_pred") -> DataFrame:
    """One row per group: offset, factor, and slope and intercept of y on the prediction."""
    slope = F.regr_slope(y, p)
    return fit.groupBy(*by).agg((F.avg(y) - F.avg(p)).alias("offset"), ratio(F.avg(y), F.avg(p)).alias("factor"), F.coalesce(slope, d(1)).alias("slope"), F.when(slope.isNull(), F.avg(y) - F.avg(p)).otherwise(F.avg(y) - slope * F.avg(p)).alias("intercept"))


def quantile_map(frame: DataFrame, fit: DataFrame, *, y: str = "y", p: str = "y_pred", knots: int = 21) -> DataFrame:
    """``frame`` with ``mapped``: predictions moved from their fit quantiles to those of y, flat outside the range."""
    levels = {f"k{k}": k / (knots - 1) for k in range(knots)}
    own, true = (order.percentiles(fit, F.col(x), levels).select(F.array(*levels).alias(q)) for x, q in ((p, "qp"), (y, "qy")))
    maps = own.crossJoin(true)  # one row each
    at = F.greatest(F.lit(1), F.least(F.lit(knots - 1), F.size(F.filter("qp", lambda q: q <= F.col(p)))))
    x0, x1, y0, y1 = F.element_at("qp", at), F.element_at("qp", at + 1), F.element_at("qy", at), F.element_at("qy", at + 1)
    share = F.least(F.greatest(F.when(x1 > x0, (F.col(p) - x0) / F.nullif(x1 - x0, d(0))).otherwise(d(0)), d(0)), d(1))
    return frame.join(F.broadcast(maps)).withColumn("mapped", y0 + share * (y1 - y0)).drop("qp", "qy")


def gated_trend(samples: DataFrame, train: DataFrame, *, region: str = "region", year: str = "year", y: str = "y", z_limit: float = 1.959964) -> DataFrame:
    """(region, year, trend) for every sample, from the region's training rows of other years.

    The most significant window before the year and the one after it each give a line, and the lines are
    blended by nearness. Without either the region's mean is taken (its own year left out where it has
    others), for an unseen region the mean of all.
    """
    targets = samples.select(region, year).distinct()
    t, x = F.col("t_"), F.col(year)
    all_rows = targets.select(region, F.col(year).alias("t_")).join(train.select(region, year, y), region)
    rows = all_rows.where(x != t).withColumn("after_", x > t)
    # Later years are mirrored at the target: the nearest is the newest then, and a line has the same value at the target.
    windows = rows.select(F.struct(F.col(region).alias("r"), "t_", "after_").alias("side_"), F.when(x > t, 2 * t - x).otherwise(x).alias("x_"), F.col(y).alias("v_"))
    best = mann_kendall(windows, region="side_", year="x_", y="v_", z_limit=z_limit).select("side_.*", (F.col("intercept") + F.col("slope") * F.col("side_.t_")).alias("line"))
    lines = best.groupBy("r", "t_").agg(F.max(F.when(~F.col("after_"), F.col("line"))).alias("low"), F.max(F.when(F.col("after_"), F.col("line"))).alias("high"))
    others = all_rows.groupBy(region, "t_").agg(
        F.coalesce(F.avg(F.when(x != t, F.col(y))), F.avg(y)).alias("mean"), (F.col("t_") - F.max(F.when(x < t, x))).alias("back"), (F.min(F.when(x > t, x)) - F.col("t_")).alias("ahead"),
    )
    out = targets.withColumnRenamed(year, "t_").join(others, [region, "t_"], "left").join(lines.withColumnRenamed("r", region), [region, "t_"], "left")
    out = out.join(F.broadcast(train.agg(F.avg(y).alias("overall"))))
    back, ahead = F.col("back"), F.col("ahead")
    blend = (ahead * F.col("low") + back * F.col("high")) / (back + ahead)
    return out.select(region, F.col("t_").alias(year), F.coalesce(blend, "low", "high", "mean", "overall").alias("trend"))


def regional_bias(fit: DataFrame, *, region: str = "region", y: str = "y", p: str = "y_pred") -> DataFrame:
    """(region, slope, intercept) of y on the prediction, for regions whose mean prediction is above 0.

    A region with under three rows or a constant prediction takes the line of all rows; where these are
    too few or constant as well, the slope is 1 and the intercept the mean error (0 if the mean prediction is 0).
    """
    rows = fit.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    line = [F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(p).alias("mp"), F.regr_slope(y, p).alias("b"), (F.max(p) > F.min(p)).alias("spread")]
    own = rows.groupBy(region).agg(*line).where("mp > 0")
    whole = rows.join(own.select(region), region, "left_semi").agg(*line)
    fits = (F.col("n") >= 3) & F.col("spread")
    whole = whole.select(F.when(fits, F.col("b")).otherwise(d(1)).alias("slope_all"), F.when(fits, F.col("my") - F.col("b") * F.col("mp")).when(F.col("mp") != 0, F.col("my") - F.col("mp")).otherwise(d(0)).alias("intercept_all"))
    out = own.join(F.broadcast(whole))  # one row
    return out.select(region, F.when(fits, F.col("b")).otherwise(F.col("slope_all")).alias("slope"), F.when(fits, F.col("my") - F.col("b") * F.col("mp")).otherwise(F.col("intercept_all")).alias("intercept"))


def correct_by_region(frame: DataFrame, lines: DataFrame, *, region: str = "region", p: str = "y_pred") -> DataFrame:
    """``frame`` with ``corrected``, not below 0; regions without a line are left out."""
    value = F.greatest(F.col("slope") * F.col(p) + F.col("intercept"), d(0))
    return frame.join(lines, region).withColumn("corrected", value).drop("slope", "intercept")


def corrections(frame: DataFrame, fit: DataFrame, *, y: str = "y", p: str = "y_pred") -> DataFrame:
    """``frame`` with by_mean, by_ratio and by_line: predictions moved by the offset, factor and line of all of ``fit``."""
    t, x = bias_table(fit, y=y, p=p), F.col(p)
    out = frame.join(F.broadcast(t))  # one row
    return out.withColumns({"by_mean": x + F.col("offset"), "by_ratio": x * F.col("factor"), "by_line": F.col("slope") * x + F.col("intercept")}).drop("offset", "factor", "slope", "intercept")


def national(rows: DataFrame, *, by: Sequence[str] = (), year: str = "year", y: str = "y", p: str = "y_pred") -> DataFrame:
    """(by, year, y, p, regions): plain means over the regions of a year; years without a value in either are left out."""
    return rows.groupBy(*by, year).agg(F.avg(y).alias(y), F.avg(p).alias(p), F.count(y).alias("regions")).where(F.col(y).isNotNull() & F.col(p).isNotNull())
