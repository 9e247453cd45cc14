"""The whole evaluation of a prediction table: prepare its frame once, then run the tiers that are asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d
from furrow.operators import evaluation, order, reference, tiers
from furrow.session import settled

#: Reference forecasts by name; the anomalies are from ``ols``.
REFERENCES = {"trend": "ref_gated", "ols": "ref_trend", "climatology": "ref_climatology", "rolling3": "ref_rolling3"}
TIERS = ("accuracy", "uncertainty", "generalisation", "operational")


def prepare(test: DataFrame, train: DataFrame, val: DataFrame | None = None, *, levels: Mapping[float, str] | None = None, region: str = "region", year: str = "year", y: str = "y", p: str = "y_pred", z_limit: float = 1.959964) -> DataFrame:
    """``test`` with the four references, a band of quantiles around each, anomalies, and, where ``val`` has rows, conformal outer quantiles.

    Bands are ``ref_q*`` around the line of all years and ``{reference}_q*`` around the others: the reference plus the
    standardised residuals' quantiles times the region's sigma. The margin is kept as ``conformal_margin``.
    """
    rows = reference.attach(test, train, region=region, year=year, y=y, levels=tuple(levels) if levels else reference.LEVELS)
    # a forecast a region and year: the gate is worked out once for each
    gated = reference.gated_trend(rows.select(region, year).distinct(), train, region=region, year=year, y=y, z_limit=z_limit).withColumnRenamed("trend", "ref_gated")
    rows = rows.join(gated, [region, year], "left")
    for t in levels or {}:
        away = F.col(f"ref_q{round(100 * t)}") - F.col("ref_trend")
        rows = rows.withColumns({f"{k}_q{round(100 * t)}": F.col(x) + away for k, x in REFERENCES.items() if k != "ols"})
    rows = rows.withColumns({"anom_true": F.col(y) - F.col("ref_trend"), "anom_pred": F.col(p) - F.col("ref_trend")})
    if levels:
        rows = rows.withColumn("anom_low", F.col(levels[min(levels)]) - F.col("ref_trend"))
        if val is not None:
            low, high = levels[min(levels)], levels[max(levels)]
            margin = order.percentiles(val, F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high)), {"conformal_margin": lambda n: F.least(d(1), F.ceil(F.round((n + 1) * d(max(levels) - min(levels)), 9)) / n)})
            rows = rows.join(F.broadcast(margin.select("conformal_margin")))  # one row
            rows = rows.withColumns({f"{low}_conf": F.greatest(F.col(low) - F.col("conformal_margin"), d(0)), f"{high}_conf": F.col(high) + F.col("conformal_margin")})
    return rows


def flagged(frame: DataFrame, flags: DataFrame, *, region: str = "region", year: str = "year") -> DataFrame:
    """``frame`` with ``driver_extreme`` of its region and year; rows without a driver stay, with null."""
    return frame.join(flags.select(region, year, "driver_extreme"), [region, year], "left")


def evaluate(frame: DataFrame, wanted: Sequence[str] = TIERS, *, levels: Mapping[float, str] | None = None, sigmas: Sequence[float] = (0.5, 1.0), y: str = "y", p: str = "y_pred") -> DataFrame:
    """(tier, partition, metric, value) of the tiers in ``wanted``, over a prepared frame (with ``driver_extreme``, also of its extreme drivers).

    The partition is ``all`` but for the generalisation tier. The uncertainty tier has no rows without ``levels``;
    of an unknown tier's name an error is raised. The frame is settled once for all tiers.
    """
    if unknown := set(wanted) - set(TIERS):
        raise ValueError(f"unknown tiers: {', '.join(sorted(unknown))}")
    frame = settled(frame)
    blocks: list[DataFrame] = []

    def add(tier: str, wide: DataFrame) -> None:
        rows = wide if "partition" in wide.columns else wide.withColumn("partition", F.lit("all"))
        blocks.append(evaluation.long(rows, ["partition"]).select(F.lit(tier).alias("tier"), "partition", "metric", "value"))

    if "accuracy" in wanted:
        add("accuracy", tiers.accuracy(frame, REFERENCES, y=y, p=p))
    if "uncertainty" in wanted and levels:
        names = {t: f"q{round(100 * t)}" for t in levels}
        bands = {k: {t: f"{'ref' if k == 'ols' else k}_{n}" for t, n in names.items()} for k in REFERENCES}
        low, high = levels[min(levels)], levels[max(levels)]
        conformal = (f"{low}_conf", f"{high}_conf") if f"{low}_conf" in frame.columns else None
        block = tiers.uncertainty(frame, levels, bands, y=y, conformal=conformal)
        if conformal:
            block = block.join(F.broadcast(frame.agg(F.max("conformal_margin").alias("conformal_margin"))))  # one row each
        add("uncertainty", block)
    if "generalisation" in wanted:
        driver = "driver_extreme" if "driver_extreme" in frame.columns else None
        block = tiers.generalisation(frame, y=y, p=p, trend="ref_gated", driver=driver)
        if driver:
            label = F.coalesce(F.col("anom_true") < -F.col("ref_sigma"), F.lit(False))
            agreement = frame.agg(tiers.jaccard(label, F.coalesce(F.col(driver) == 1, F.lit(False))).alias("rate_"))
            block = block.join(F.broadcast(agreement)).withColumn("agreement_rate", F.when(F.col("partition") == "extreme_driver", F.col("rate_"))).drop("rate_")
        add("generalisation", block)
    if "operational" in wanted:
        rows = frame if "anom_low" in frame.columns else frame.withColumn("anom_low", F.lit(None).cast("double"))
        found = evaluation.long(tiers.operational(rows, sigmas=sigmas).drop("n"), ["k"])
        tag = F.concat(F.lit("badyear_"), F.regexp_replace(F.col("k").cast("string"), r"\.0$", ""), F.lit("sig_"), "metric")
        blocks.append(found.select(F.lit("operational").alias("tier"), F.lit("all").alias("partition"), tag.alias("metric"), "value"))
        add("operational", evaluation.shortfall_capture(frame).select(F.col("n").alias("shortfall_n"), F.col("capture").alias("shortfall_capture")))
    out = blocks[0] if blocks else frame.sparkSession.createDataFrame([], "tier string, partition string, metric string, value double")
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out


def shift_context(ranking: DataFrame, shift: DataFrame, *, place: Sequence[str], keys: Sequence[str], context: Sequence[str] = ("auc", "auc_debiased", "n_shifted")) -> DataFrame:
    """(keys, shift_class, n, mean_m_arm, mean_m_b0, and a mean per ``context`` column): how both arms do, and how far away the places of a class are.

    Places that ``shift`` doesn't have are 'unknown'; means leave nulls out.
    """
    rows = ranking.join(shift.select(*place, "shift_class", *context), list(place), "left").withColumn("shift_class", F.coalesce("shift_class", F.lit("unknown")))
    means = [F.avg(x).alias(f"mean_{n}") for x, n in (("value", "m_arm"), ("base", "m_b0"), *((x, x) for x in context))]
    return rows.groupBy(*keys, "shift_class").agg(F.count("*").alias("n"), *means)


def first_test_year(metrics: DataFrame, values: Sequence[str], *, fold: str = "fold", year: str = "year") -> DataFrame:
    """One row: the means over folds of each fold's metrics in its first test year, and their population deviations."""
    first = metrics.groupBy(fold).agg(F.min_by(F.struct(*values), year).alias("m"))
    return first.agg(F.count("*").alias("folds"), *[f(F.col("m")[x]).alias(f"{x}_{n}") for x in values for n, f in (("mean", F.avg), ("std_pop", F.stddev_pop))])


def national_model(rows: DataFrame, *, by: Sequence[str] = (), region: str = "region", year: str = "year", y: str = "y", p: str = "y_pred") -> DataFrame:
    """(by, year, y, p, regions): the mean observation of a year beside a model value that holds for the whole country, which is repeated in
    every region's row: the one of the smallest region counts. Years without a value in either are left out."""
    has = F.col(p).isNotNull()
    out = rows.groupBy(*by, year).agg(F.avg(y).alias(y), F.min_by(p, F.when(has, F.col(region))).alias(p), F.count(y).alias("regions"))
    return out.where(F.col(y).isNotNull() & F.col(p).isNotNull())


def file_report(files: Mapping[str, DataFrame | None], required: Mapping[str, Sequence[str]], *, unique: Mapping[str, Sequence[str]] | None = None, years: Mapping[str, str] | None = None, bounds: Mapping[str, Mapping[str, tuple[float | None, float | None]]] | None = None) -> DataFrame:
    """(file, row_count, missing, duplicate_rows, bad_years, first_year, last_year, missing_years, violations, status): a row per contract file.

    ``status`` says where the check of a file ended: absent (None is given), missing columns (no job runs), empty, failed or ok. All rules of a
    file share one aggregation: its rows are grouped by key (all equal without one), and the groups' counts, years and
    broken rules are added up. ``missing_years`` are the years between the first and the last that no row has.
    """
    spark = next(f.sparkSession for f in files.values() if f is not None)
    plain, out = {"row_count": "long", "missing": "string", "duplicate_rows": "long", "bad_years": "long", "first_year": "int", "last_year": "int", "missing_years": "string", "violations": "long", "status": "string"}, []
    for name, df in files.items():
        missing = sorted(set(required[name]) - set(df.columns)) if df is not None else []
        if df is None or missing:
            row = {"missing": ",".join(missing), "status": "missing columns" if missing else "absent"}
            out.append(spark.range(1).select(F.lit(name).alias("file"), *[F.lit(row.get(k)).cast(t).alias(k) for k, t in plain.items()]))
            continue
        year = F.expr(f"try_cast(`{years[name]}` AS int)") if years and name in years else F.lit(None).cast("int")
        broken = F.lit(0)
        for x, (low, high) in ((bounds or {}).get(name) or {}).items():
            v = F.expr(f"try_cast(`{x}` AS double)")
            off = (F.col(x).isNotNull() & v.isNull()) | (v < low if low is not None else F.lit(False)) | (v > high if high is not None else F.lit(False))
            broken = broken + F.when(off, 1).otherwise(0)
        keys = list((unique or {}).get(name) or [])
        rows = df.select(*[F.col(k).alias(f"k_{k}") for k in keys], year.alias("y_"), broken.alias("b_"))
        if keys:
            groups = rows.groupBy(*[f"k_{k}" for k in keys]).agg(F.count("*").alias("n"), F.collect_set("y_").alias("ys"), F.count("y_").alias("dated"), F.sum("b_").alias("b"))
        else:
            groups = rows.select(F.lit(1).alias("n"), F.array_compact(F.array("y_")).alias("ys"), F.when(F.col("y_").isNull(), 0).otherwise(1).alias("dated"), F.col("b_").alias("b"))
        seen = F.array_sort(F.array_distinct(F.flatten(F.collect_set("ys"))))  # distinct years
        t = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum("dated"), F.lit(0)).alias("dated"), F.coalesce(F.sum("b"), F.lit(0)).alias("violations"), seen.alias("ys"))
        first, last = F.array_min("ys"), F.array_max("ys")
        gaps = F.when(F.size("ys") > 0, F.array_except(F.sequence(first, last), F.col("ys")))
        bad = F.col("row_count") - F.col("dated") if years and name in years else F.lit(0)
        failed = (F.col("duplicate_rows") > 0) | (F.col("violations") > 0) | (bad > 0)
        status = F.when(F.col("row_count") == 0, "empty").when(failed, "failed").otherwise("ok")
        out.append(t.select(F.lit(name).alias("file"), F.col("row_count").cast("long").alias("row_count"), F.lit("").alias("missing"), F.col("duplicate_rows").cast("long").alias("duplicate_rows"), bad.cast("long").alias("bad_years"), first.alias("first_year"), last.alias("last_year"), F.coalesce(F.array_join(gaps, ","), F.lit("")).alias("missing_years"), F.col("violations").cast("long").alias("violations"), status.alias("status")))
    whole = out[0]
    for row in out[1:]:
        whole = whole.unionByName(row)
    return whole
