"""Tiers of an evaluation: each is a fixed set of metrics over a frame with references, in few aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d
from furrow.operators import evaluation, order


def accuracy(frame: DataFrame, refs: Mapping[str, str], *, by: Sequence[str] = (), y: str = "y", p: str = "y_pred") -> DataFrame:
    """Point metrics, errors of each reference (name to column), skills against it, and tolerance accuracy, in one pass."""
    a, b = F.col(y), F.col(p)
    out = c.point_metrics(a, b)
    for name, column in refs.items():
        r = F.col(column)
        out |= {f"rmse_ref_{name}": c.rmse(a, r), f"mae_ref_{name}": c.mae(a, r), f"skill_rmse_vs_{name}": c.skill(c.rmse(a, b), c.rmse(a, r)), f"skill_mae_vs_{name}": c.skill(c.mae(a, b), c.mae(a, r))}
    out |= c.tolerance_metrics(a, b)
    return frame.groupBy(*by).agg(*[v.alias(k) for k, v in out.items()])


def uncertainty(frame: DataFrame, q: Mapping[float, str], refs: Mapping[str, Mapping[float, str]], *, by: Sequence[str] = (), y: str = "y", conformal: tuple[str, str] | None = None) -> DataFrame:
    """The quantile block, CRPS of each reference band (name to levels' columns) and skill against it, and the conformal band's coverage, width and CRPS."""
    a, own = F.col(y), {t: F.col(x) for t, x in q.items()}
    low, high = min(q), max(q)
    out = {**evaluation.quantile_metrics(a, own), "picp_nominal": d(high - low)}
    for name, band in refs.items():
        ref = {t: F.col(x) for t, x in band.items()}
        out |= {f"crps_ref_{name}": c.crps(a, ref), f"skill_crps_vs_{name}": c.skill(c.crps(a, own), c.crps(a, ref)), f"picp_ref_{name}": c.coverage(a, ref[low], ref[high]), f"width_ref_{name}": F.avg(ref[high] - ref[low])}
    if conformal:
        lo, hi = map(F.col, conformal)
        out |= {"picp_conformal": c.coverage(a, lo, hi), "width_conformal": F.avg(hi - lo), "crps_conformal": c.crps(a, {**own, low: lo, high: hi})}
    return frame.groupBy(*by).agg(*[v.alias(k) for k, v in out.items()])


def operational(frame: DataFrame, *, sigmas: Sequence[float] = (0.5, 1.0), true: str = "anom_true", pred: str = "anom_pred", low: str = "anom_low", sigma: str = "ref_sigma") -> DataFrame:
    """A row per bad-year limit (k standard deviations): base rate, precision, recall, F1, and the AUC of the prediction and of the low quantile.

    Scores are anomalies in standard deviations. All but the AUCs are null where all rows or none are events.
    """
    safe = F.when(F.col(sigma) > 0, F.col(sigma)).otherwise(d(1))
    rows = frame.select(true, pred, low, sigma, safe.alias("safe"), F.explode(F.array(*map(d, sigmas))).alias("k"))
    limit = -F.col("k") * F.col(sigma)
    rows = rows.select("k", (F.col(true) < limit).alias("event"), (F.col(pred) < limit).alias("alarm"), F.round(-F.col(pred) / F.col("safe"), 9).alias("by_pred"), F.round(-F.col(low) / F.col("safe"), 9).alias("by_low"))
    n, e, a, h = F.count("*"), F.count_if("event"), F.count_if("alarm"), F.count_if(F.col("event") & F.col("alarm"))
    t = rows.groupBy("k").agg(n.alias("n"), e.alias("e"), a.alias("a"), h.alias("h"))
    some = (F.col("e") > 0) & (F.col("e") < F.col("n"))
    none = lambda x: F.coalesce(x, d(0))
    precision, recall = none(c.ratio(F.col("h"), F.col("a"))), none(c.ratio(F.col("h"), F.col("e")))
    out = t.select("k", "n", c.ratio(F.col("e"), F.col("n")).alias("base_rate"), F.when(some, precision).alias("precision"), F.when(some, recall).alias("recall"), F.when(some, none(c.ratio(2 * precision * recall, precision + recall))).alias("f1"))
    for name, score in (("auc", "by_pred"), ("auc_low", "by_low")):
        out = out.join(order.auc(rows, score=score, event="event", by=["k"]).select("k", F.col("auc").alias(name)), "k", "left")
    return out


def extreme(frame: DataFrame, *, true: str = "anom_true", pred: str = "anom_pred", sigma: str = "ref_sigma", ref: str = "ref_trend", y: str = "y", p: str = "y_pred") -> DataFrame:
    """One row about the rows below minus one standard deviation: their share of all, number, RMSE, skill, anomaly correlation and spread ratio."""
    low = F.col(true) < -F.col(sigma)
    only = lambda x: F.when(low, F.col(x))
    a, b, t, q = only(y), only(p), only(true), only(pred)
    return frame.agg(
        c.ratio(F.count_if(low), F.count("*")).alias("base_rate"), F.count_if(low).alias("n"), c.rmse(a, b).alias("rmse"), c.skill(c.rmse(a, b), c.rmse(a, only(ref))).alias("skill_rmse"),
        c.pearson(t, q, 3).alias("r_an"), c.ratio(F.stddev_pop(q), F.stddev_pop(t)).alias("spread_ratio"),
    )


def generalisation(frame: DataFrame, *, region: str = "region", year: str = "year", y: str = "y", p: str = "y_pred", trend: str = "ref_trend", ols: str = "ref_trend", sigma: str = "ref_sigma", driver: str | None = None) -> DataFrame:
    """A row per partition: all rows (in_domain), true anomalies under minus one standard deviation (extreme_label), and the
    upper tenth of ``driver`` (extreme_driver).

    A partition without rows has none. The frame is read several times: hand over a written or checkpointed one. Spatial, temporal and in-frame anomaly agreement are of in_domain only, the base
    rate of the extremes only.
    """
    true, pred = F.col(y) - F.col(ols), F.col(p) - F.col(ols)
    tags = [F.lit("in_domain"), F.when(true < -F.col(sigma), F.lit("extreme_label"))]
    if driver:
        frame = frame.join(F.broadcast(order.percentiles(frame, F.col(driver), {"bound_": 0.9}).select("bound_")))  # one row
        tags.append(F.when(F.col(driver) >= F.col("bound_"), F.lit("extreme_driver")))
    rows = frame.select(F.col(region).alias("g"), F.col(year).alias("t"), F.col(y).alias("y"), F.col(p).alias("p"), F.col(trend).alias("r"), true.alias("a"), pred.alias("b"), F.explode(F.array_compact(F.array(*tags))).alias("partition"))
    y_, p_, a, b = (F.col(x) for x in "ypab")
    main = rows.groupBy("partition").agg(
        F.count("*").alias("n"), c.rmse(y_, p_).alias("rmse"), c.skill(c.rmse(y_, p_), c.rmse(y_, F.col("r"))).alias("skill_rmse_vs_trend"), c.pearson(a, b, 3).alias("r_an_detrended"),
        c.ratio(F.stddev_pop(b), F.stddev_pop(a)).alias("anomaly_spread_ratio"), c.r2(a, b).alias("r2_an"), c.ratio(c.rmse(a, b), F.avg(F.abs(a))).alias("nrmse_an"),
    )
    inner = rows.where("partition = 'in_domain'")
    sp = inner.groupBy("t").agg(c.pearson(y_, p_).alias("r")).agg(F.percentile("r", 0.5).alias("r_sp"))
    tm = inner.groupBy("g").agg(c.pearson(y_, p_, 3).alias("r")).agg(F.percentile("r", 0.5).alias("r_tm"))
    an = evaluation.anomalies(inner, region="g", y="y", p="p").select(F.col("r_an").alias("r_an_window"), F.col("n").alias("whole_"))
    out = main.join(F.broadcast(sp)).join(F.broadcast(tm)).join(F.broadcast(an))  # one row each
    whole = F.col("partition") == "in_domain"
    only = [F.when(whole, F.col(x)).alias(x) for x in ("r_sp", "r_tm", "r_an_window", "r2_an", "nrmse_an")]
    return out.select("partition", F.when(~whole, c.ratio(F.col("n"), F.col("whole_"))).alias("base_rate_extreme"), "n", "rmse", "skill_rmse_vs_trend", "r_an_detrended", "anomaly_spread_ratio", *only)


def report(blocks: Mapping[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, name, value): the tables of several tiers as one long table with names ``tier/metric``; keys that a tier lacks are null."""
    out = None
    for tier, block in blocks.items():
        own = [k for k in keys if k in block.columns]
        rows = evaluation.long(block, own).select(*own, F.concat(F.lit(f"{tier}/"), "metric").alias("name"), "value")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def driver_flags(seasons: DataFrame, train: DataFrame, *, region: str = "region", dry: str = "prec", hot: str = "tmax") -> DataFrame:
    """``seasons`` (region, year, sums) with ``driver_extreme``: 1 where the region's season is as dry as its training tenth or as hot as its ninetieth percentile; null for unseen regions."""
    ends = train.groupBy(region).agg(F.percentile(dry, 0.1).alias("p10_"), F.percentile(hot, 0.9).alias("p90_"))  # a region's seasons
    flag = ((F.col(dry) <= F.col("p10_")) | (F.col(hot) >= F.col("p90_"))).cast("int")
    return seasons.join(ends, region, "left").withColumn("driver_extreme", flag).drop("p10_", "p90_")


def jaccard(a: Column, b: Column) -> Column:
    """Rows where both hold over rows where one does; null without any."""
    return c.ratio(F.count_if(a & b), F.count_if(a | b))


def over_folds(metrics: DataFrame, values: Sequence[str], *, fold: str = "fold", year: str = "year") -> DataFrame:
    """A row per year and one overall (year null): means over folds with both standard deviations; overall is the mean of the years' means."""
    years = metrics.groupBy(year).agg(F.count(fold).alias("folds"), *[f(x).alias(f"{x}_{n}") for x in values for n, f in (("mean", F.avg), ("std_pop", F.stddev_pop), ("std_samp", F.stddev_samp))])
    whole = years.agg(F.sum("folds").alias("folds"), *[F.avg(f"{x}_mean").alias(f"{x}_mean") for x in values])
    return years.unionByName(whole, allowMissingColumns=True)


def cutoff_days(lead: str, length: Column, *, swapped: bool = False) -> Column:
    """Days before the season's end at which a forecast is made: ``N-days``, ``end``, or a share of the season's length.

    ``three-quarter`` leaves three quarters of the season and ``quarter`` one; ``swapped`` exchanges the two.
    """
    if lead.endswith("-days"):
        return F.lit(int(lead.removesuffix("-days")))
    shares = {"end": 0, "quarter": 3 if swapped else 1, "middle": 2, "three-quarter": 1 if swapped else 3}
    return F.floor(length * shares[lead] / 4).cast("int")


def errors(frame: DataFrame, *, y: str = "y", p: str = "y_pred") -> DataFrame:
    """``frame`` with error, abs_error and pct_error (null where the truth is 0)."""
    e = F.col(p) - F.col(y)
    return frame.withColumns({"error": e, "abs_error": F.abs(e), "pct_error": 100 * c.ratio(e, F.col(y))})
