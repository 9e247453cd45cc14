"""Evaluation of prediction frames: every metric of a scope in one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d
from furrow.operators import order, reference


def by_scope(frame: DataFrame, metrics: Mapping[str, Column], *, year: str = "year") -> DataFrame:
    """Metrics for every year and overall (year null), in one pass."""
    return frame.rollup(year).agg(*[m.alias(k) for k, m in metrics.items()])


def long(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per metric: keys, metric, value."""
    names = [x for x in wide.columns if x not in keys]
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.value")


def spatial(frame: DataFrame, *, year: str = "year", y: str = "y", p: str = "y_pred") -> DataFrame:
    """Per year: how well regions are told apart; needs two regions."""
    y, p = F.col(y), F.col(p)
    return frame.groupBy(year).agg(F.count(y).alias("n"), c.pearson(y, p).alias("r"), c.rmse(y, p).alias("rmse"), c.nrmse(y, p).alias("nrmse"), (100 * c.smape(y, p)).alias("smape"), c.r2(y, p).alias("r2")).where("n >= 2")


def temporal(frame: DataFrame, *, region: str = "region", y: str = "y", p: str = "y_pred") -> DataFrame:
    """Per region: how well years are told apart; r needs three years with spread."""
    y, p = F.col(y), F.col(p)
    return frame.groupBy(region).agg(F.count(y).alias("n"), c.pearson(y, p, 3).alias("r"), c.rmse(y, p).alias("rmse"), c.mae(y, p).alias("mae"), c.nrmse(y, p).alias("nrmse"), c.r2(y, p).alias("r2"))


def median_r(table: DataFrame) -> DataFrame:
    return table.agg(F.percentile("r", 0.5).alias("median_r"), F.count("r").alias("n_r"))


def anomalies(frame: DataFrame, *, region: str = "region", y: str = "y", p: str = "y_pred", ref: str | None = None) -> DataFrame:
    """One row of anomaly agreement; the reference is a column, or the region's mean in the frame."""
    base = F.col(ref) if ref else F.avg(y).over(Window.partitionBy(region))
    a = frame.select((F.col(y) - base).alias("a"), (F.col(p) - base).alias("b"))
    a_, b_ = F.col("a"), F.col("b")
    return a.agg(F.count("a").alias("n"), c.pearson(a_, b_, 3).alias("r_an"), c.r2(a_, b_).alias("r2_an"), c.ratio(c.rmse(a_, b_), F.avg(F.abs(a_))).alias("nrmse_an"), F.stddev_pop("a").alias("std_true"), F.stddev_pop("b").alias("std_pred"))


def quantile_metrics(y: Column, q: Mapping[float, Column]) -> dict[str, Column]:
    """The uncertainty block of a frame with the quantiles ``q`` (level to column)."""
    low, high = min(q), max(q)
    out = {f"pinball_q{round(100 * t)}": F.avg(c.pinball(y, x, t)) for t, x in q.items()}
    out |= {"crps": c.crps(y, q), "picp": c.coverage(y, q[low], q[high]), "pinaw": c.relative_width(y, q[low], q[high]), "winkler": c.winkler(y, q[low], q[high], 1 - (high - low)), "width": F.avg(q[high] - q[low])}
    return out | {f"coverage_q{round(100 * t)}": c.level_coverage(y, x) for t, x in q.items()} | {"calibration_error": c.calibration_error(y, q)}


def conformal_margin(val: DataFrame, *, y: str = "y", low: str = "q10", high: str = "q90", alpha: float = 0.2) -> DataFrame:
    """(n, margin): the interpolated quantile of the scores at min(1, ceil((n + 1)(1 - alpha)) / n), null without rows."""
    level = lambda n: F.least(d(1), F.ceil(F.round((n + 1) * d(1 - alpha), 9)) / n)
    return order.percentiles(val, F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high)), {"margin": level})


def conformalize(frame: DataFrame, margin: DataFrame, *, low: str = "q10", high: str = "q90") -> DataFrame:
    """``frame`` with both outer quantiles moved by the margin, the lower one not below 0."""
    return frame.join(F.broadcast(margin.select("margin"))).withColumns({f"{low}_conf": F.greatest(F.col(low) - F.col("margin"), d(0)), f"{high}_conf": F.col(high) + F.col("margin")}).drop("margin")


def residual_band(frame: DataFrame, val: DataFrame, *, y: str = "y", p: str = "y_pred", alpha: float = 0.2) -> DataFrame:
    """``frame`` with low_conf and high_conf around a point prediction, by the conformal margin of absolute residuals of ``val``."""
    margin = conformal_margin(val, y=y, low=p, high=p, alpha=alpha)  # the larger of both signs
    return frame.join(F.broadcast(margin.select("margin"))).withColumns({"low_conf": F.col(p) - F.col("margin"), "high_conf": F.col(p) + F.col("margin")}).drop("margin")


def bad_years(frame: DataFrame, *, true: str = "anom_true", pred: str = "anom_pred", sigma: str = "ref_sigma", k: float = 0.5) -> DataFrame:
    """One row: base rate, precision, recall and F1 of anomalies below -k sigma; null if none or all are events."""
    event, alarm = F.col(true) < -d(k) * F.col(sigma), F.col(pred) < -d(k) * F.col(sigma)
    t = frame.select(event.cast("long").alias("e"), alarm.cast("long").alias("a")).agg(F.count("*").alias("n"), F.sum("e").alias("e"), F.sum("a").alias("a"), F.sum(F.col("e") * F.col("a")).alias("h"))
    some = (F.col("e") > 0) & (F.col("e") < F.col("n"))
    none = lambda x: F.coalesce(x, d(0))
    precision, recall = none(c.ratio(F.col("h"), F.col("a"))), none(c.ratio(F.col("h"), F.col("e")))
    f1 = none(c.ratio(2 * precision * recall, precision + recall))
    return t.select("n", c.ratio(F.col("e"), F.col("n")).alias("base_rate"), F.when(some, precision).alias("precision"), F.when(some, recall).alias("recall"), F.when(some, f1).alias("f1"))


def shortfall_capture(frame: DataFrame, *, true: str = "anom_true", pred: str = "anom_pred", share: float = 0.1) -> DataFrame:
    """Mean predicted over mean true shortfall among the lowest ``share`` of true anomalies."""
    bound = order.percentiles(frame, F.col(true), {"bound": share}).select("bound")
    low = frame.join(F.broadcast(bound)).where(F.col(true) <= F.col("bound"))
    return low.agg(F.count("*").alias("n"), c.ratio(F.avg(-F.col(pred)), F.avg(-F.col(true))).alias("capture"))


def classification(frame: DataFrame, *, true: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """One row: accuracy, macro and weighted F1, quadratic kappa, mean class distance, from the counts of pairs."""
    t, p, n = F.col("t"), F.col("p"), F.col("n")
    pairs = frame.select(F.col(true).alias("t"), F.col(pred).alias("p")).groupBy("t", "p").agg(F.count("*").alias("n"))
    out = {"n": F.sum(n), "accuracy": F.sum(F.when(t == p, n).otherwise(0)) / F.sum(n), "distance": F.sum(F.abs(t - p) * n) / F.sum(n), "d2": F.sum((t - p) * (t - p) * n)}
    for k in classes:
        out |= {f"t{k}": F.sum(F.when(t == k, n).otherwise(0)), f"p{k}": F.sum(F.when(p == k, n).otherwise(0)), f"h{k}": F.sum(F.when((t == k) & (p == k), n).otherwise(0))}
    m = pairs.agg(*[v.alias(k) for k, v in out.items()])
    f1 = {k: F.coalesce(c.ratio(2 * F.col(f"h{k}"), F.col(f"t{k}") + F.col(f"p{k}")), d(0)) for k in classes}
    expected = sum(((i - j) ** 2 * F.col(f"t{i}") * F.col(f"p{j}") for i in classes for j in classes), start=d(0)) / F.col("n")
    macro = sum(f1.values(), start=d(0)) / len(classes)
    weighted = sum((f1[k] * F.col(f"t{k}") for k in classes), start=d(0)) / F.col("n")
    return m.select("n", "accuracy", macro.alias("macro_f1"), weighted.alias("weighted_f1"), (1 - c.ratio(F.col("d2"), expected)).alias("kappa"), "distance")


def transfer(frame: DataFrame, train: DataFrame, *, source: str = "source", target: str = "target", region: str = "region", year: str = "year", y: str = "y", p: str = "y_pred") -> DataFrame:
    """One row per source model and other target: errors, skills against the target's own references, spatial and anomaly agreement.

    ``train`` has the target's training rows (target, region, year, y). Rows whose source is the target are left out.
    """
    place = F.struct(F.col(target).alias("t"), F.col(region).alias("r"))
    fit = reference.coefficients(train.select(place.alias("place"), year, y), region="place", year=year, y=y)
    fit = fit.select(F.col("place.t").alias(target), F.col("place.r").alias(region), "climatology", "rolling3", "slope", "intercept")
    overall = train.groupBy(target).agg(F.avg(y).alias("overall"))
    rows = frame.where(F.col(source) != F.col(target)).join(fit, [target, region], "left").join(overall, target, "left")
    refs = {"climatology": F.coalesce("climatology", "overall"), "rolling3": F.coalesce("rolling3", "overall"), "trend": F.coalesce(F.col("intercept") + F.col("slope") * F.col(year), F.col("overall"))}
    rows = rows.select(source, target, region, year, F.col(y).alias("y"), F.col(p).alias("p"), *[v.alias(f"ref_{k}") for k, v in refs.items()])
    a, b = F.col("y"), F.col("p")
    skills = {f"skill_{n}_{k}": c.skill(f(a, b), f(a, F.col(f"ref_{k}"))) for k in refs for n, f in (("rmse", c.rmse), ("mae", c.mae))}
    true, pred = a - F.col("ref_trend"), b - F.col("ref_trend")
    blocks = {**c.point_metrics(a, b), **skills, "r_an": c.pearson(true, pred, 3), "r2_an": c.r2(true, pred)}
    main = rows.groupBy(source, target).agg(*[v.alias(k) for k, v in blocks.items()])
    spatial_r = rows.groupBy(source, target, year).agg(c.pearson(a, b).alias("r")).groupBy(source, target).agg(F.percentile("r", 0.5).alias("spatial_r"))
    return main.join(spatial_r, [source, target])
