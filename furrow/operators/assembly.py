"""From raw tables to model inputs: target calendars, tabular features, wide and per-region summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.columns import d

#: Periods of a year by aggregation.
PERIODS = {"daily": 365, "weekly": 52, "dekad": 36, "monthly": 12}


def _ticks(aggregation: str, first: Column, last: Column) -> Column:
    """All period dates from ``first`` to ``last``: days, Mondays, every tenth day from ``first``, or first days of months."""
    days = lambda a, n: F.when(a <= last, F.sequence(a, last, F.make_interval(days=F.lit(n)))).otherwise(F.array().cast("array<date>"))
    if aggregation == "weekly":
        return days(F.next_day(F.date_sub(first, 1), "Mon"), 7)
    if aggregation == "monthly":
        months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.make_interval(months=F.lit(1)))
        return F.filter(months, lambda x: x >= first)
    return days(first, {"daily": 1, "dekad": 10}[aggregation])


def target_dates(seasons: DataFrame, aggregation: str, *, start: str = "sos", cutoff: str = "cutoff", share: float = 1.0) -> DataFrame:
    """``seasons`` exploded to (position, target): the period dates a sample is aligned to.

    From the season's start to the cutoff, or, where the start is null, backward over a year and five periods.
    29 February is dropped, then the newest year of periods is kept and of it the first ``share`` (one at
    least). A null cutoff, or one before the start, gives no rows.
    """
    kept = target_array(F.col(start), F.col(cutoff), aggregation, share)
    return seasons.select("*", F.posexplode(kept).alias("position", "target"))


def target_array(start: Column, last: Column, aggregation: str, share: float = 1.0) -> Column:
    """The period dates of :func:`target_dates` as one array; null where there are none to take."""
    length = PERIODS[aggregation]
    step = {"daily": 1, "weekly": 7, "dekad": 10, "monthly": 31}[aggregation]
    back = F.date_sub(last, step * (length + 5))  # a multiple of the step, so that dekads end at the cutoff
    # A year and five periods always hold the newest ``length`` of them once leap days are out.
    ticks = F.when(start.isNull(), _ticks(aggregation, back, last)).when(start <= last, _ticks(aggregation, start, last))
    kept = F.filter(ticks, lambda x: ~((F.month(x) == 2) & (F.dayofmonth(x) == 29)))
    kept = F.slice(kept, F.greatest(F.size(kept) - length + 1, F.lit(1)), length)
    first = F.greatest(F.lit(1), F.floor(F.size(kept) * d(share)).cast("int"))
    return F.slice(kept, 1, first) if share < 1 else kept


def _leap_days(day: Column) -> Column:
    """How many 29ths of February there are up to a day."""
    y = F.year(day)
    before = y - 1
    whole = F.floor(before / 4) - F.floor(before / 100) + F.floor(before / 400)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return whole + F.when(leap & (F.dayofyear(day) >= 60), 1).otherwise(0)


def position(ticks: Column, day: Column, aggregation: str) -> Column:
    """The place of the period of a day in an array of period dates, null outside (and on 29 February of a daily calendar)."""
    first = F.element_at(ticks, 1)
    if aggregation == "daily":
        at = F.datediff(day, first) - (_leap_days(day) - _leap_days(first))
        return F.when((at >= 0) & (at < F.size(ticks)) & ~((F.month(day) == 2) & (F.dayofmonth(day) == 29)), at.cast("int"))
    at = F.size(F.filter(ticks, lambda t: t <= day)) - 1  # 52 dates at most
    begin = F.element_at(ticks, F.greatest(at + 1, F.lit(1)))
    end = F.add_months(begin, 1) if aggregation == "monthly" else F.date_add(begin, {"weekly": 7, "dekad": 10}[aggregation])
    return F.when((at >= 0) & (day < end), at)


def samples(seasons: DataFrame, daily: DataFrame, channels: Sequence[str], aggregation: str, *, keys: Sequence[str] = ("region", "year"), day: str = "day", start: str = "sos", cutoff: str = "cutoff", share: float = 1.0) -> DataFrame:
    """``seasons`` with ``series``: an array on the target calendar of (target, mask, channels), mask false and channels null where a period has no day.

    A period has the mean of its days. Rows are dealt by the keys once: place, period mean and array all follow from
    that exchange. Days outside their season, and seasons without a calendar (series null), add nothing; days of a key without a season are left out.
    A null in a key matches nothing.
    """
    calendar = seasons.withColumn("ticks_", target_array(F.col(start), F.col(cutoff), aggregation, share))
    rows = daily.select(*keys, F.col(day).alias("day_"), *channels).join(calendar.select(*keys, F.col(cutoff).alias("cutoff_"), "ticks_"), list(keys)).where("day_ <= cutoff_")
    placed = rows.withColumn("at_", position(F.col("ticks_"), F.col("day_"), aggregation)).where("at_ IS NOT NULL")
    means = placed.groupBy(*keys, "at_").agg(*[F.avg(x).alias(x) for x in channels])
    taken = means.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at_", F.struct(*channels)))).alias("seen_"))  # a season's periods
    at = lambda k: F.try_element_at("seen_", k)
    series = F.transform("ticks_", lambda t, k: F.struct(t.alias("target"), F.coalesce(at(k).isNotNull(), F.lit(False)).alias("mask"), *[at(k)[x].alias(x) for x in channels]))
    return calendar.join(taken, list(keys), "left").withColumn("series", series).drop("ticks_", "seen_")


def statics(
    samples: DataFrame, soil: DataFrame, location: DataFrame, *, region: str = "region", properties: Sequence[str] = ("awc", "bulk_density"), start: str = "sos", end: str = "eos", cutoff: str = "cutoff"
) -> DataFrame:
    """``samples`` with ``statics``, a struct of doubles: soil properties, latitude, longitude, the calendar as sine and cosine of both day numbers, cutoff day and season length.

    A region without a soil or location row, and a sample without a date, has nulls there. Of several rows of a region the one that sorts first counts.
    """
    one = lambda df, names, tag: df.groupBy(region).agg(F.min(F.struct(*[F.col(n).cast("double").alias(n) for n in names])).alias(tag))
    rows = samples.join(one(soil, properties, "soil_"), region, "left").join(one(location, ("latitude", "longitude"), "place_"), region, "left")
    turn = lambda x: F.dayofyear(x) * d(6.283185307179586) / d(365)
    parts = [F.col("soil_")[n].alias(n) for n in properties] + [F.col("place_")[n].alias(n) for n in ("latitude", "longitude")]
    parts += [f(turn(F.col(x))).alias(f"{n}_{k}") for n, x in (("sos", start), ("eos", end)) for k, f in (("sin", F.sin), ("cos", F.cos))]
    parts += [F.dayofyear(cutoff).cast("double").alias("cutoff_day"), F.datediff(F.col(end), F.col(start)).cast("double").alias("season_length")]
    return rows.withColumn("statics", F.struct(*parts)).drop("soil_", "place_")


def union_first(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Both tables, one row per key: rows of ``old`` come before those of ``new``, then the smallest in ``order``; columns of one table are null in the other's rows.

    Keys compare as they are (null equals null). The least row is found while rows are combined, without a sort of a key's rows.
    """
    both = old.withColumn("side_", F.lit(0)).unionByName(new.withColumn("side_", F.lit(1)), allowMissingColumns=True)
    names = [x for x in both.columns if x not in (*keys, "side_")]
    kept = both.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("side_", *order)).alias("row_"))
    return kept.select(*[k for k in both.columns if k in keys], *[F.col("row_")[n].alias(n) for n in names])


def tabular(samples: DataFrame, daily: DataFrame, *, keys: Sequence[str] = ("region", "year"), means: Sequence[str] = ("tmin", "tmax", "tavg"), sums: Sequence[str] = ("prec", "rad")) -> DataFrame:
    """``samples`` with the means and sums of their season's daily rows (null, not dropped, where there are none)."""
    stats = daily.groupBy(*keys).agg(*[F.avg(x).alias(f"{x}_mean") for x in means], *[F.sum(x).alias(f"{x}_sum") for x in sums])
    return samples.join(stats, list(keys), "left")


def wide(daily: DataFrame, keys: Sequence[str], position: Column, channels: Sequence[str], length: int) -> DataFrame:
    """One row per key with a column per channel and position 0..length-1 (mean of the position's rows; null without any)."""
    rows = daily.withColumn("at_", position)
    return rows.groupBy(*keys).agg(*[F.avg(F.when(F.col("at_") == k, F.col(x))).alias(f"{x}_{k}") for x in channels for k in range(length)])


def quantiles(daily: DataFrame, keys: Sequence[str], columns: Sequence[str], levels: Mapping[str, float]) -> DataFrame:
    """One row per key with ``column__level`` for every column and level; a key holds one season's days."""
    ask = F.array(*map(d, levels.values()))
    out = daily.groupBy(*keys).agg(*[F.percentile(x, ask).alias(x) for x in columns])
    return out.select(*keys, *[F.col(x)[k].alias(f"{x}__{n}") for x in columns for k, n in enumerate(levels)])


def fingerprint(daily: DataFrame, columns: Sequence[str], *, region: str = "region", year: str = "year", levels: Mapping[str, float] | None = None) -> DataFrame:
    """One row per region: the quantiles of each season's days, averaged over seasons."""
    levels = levels or {"p2.5": 0.025, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p97.5": 0.975}
    seasons = quantiles(daily, [region, year], columns, {n.replace(".", "_"): v for n, v in levels.items()})
    return seasons.groupBy(region).agg(*[F.avg(x).alias(x) for x in seasons.columns if x not in (region, year)])


def pools(rows: DataFrame, *, by: Sequence[str] = (), year: str = "year", test: int = 2, val: int = 1) -> DataFrame:
    """``rows`` with ``pool``: 'test' for the newest years of a group, 'train' for those before the ``val`` years between.

    Validation years, and groups of under test + val + 1 years, are left out.
    """
    years = rows.select(*by, year).distinct()
    w = Window.partitionBy(*by)  # one row a year
    ranked = years.withColumns({"back_": F.row_number().over(w.orderBy(F.desc(year))), "n_": F.count("*").over(w)}).where(F.col("n_") >= test + val + 1)
    kept = ranked.where((F.col("back_") <= test) | (F.col("back_") > test + val))
    pool = F.when(F.col("back_") <= test, "test").otherwise("train")
    return rows.join(kept.select(*by, year, pool.alias("pool")), [*by, year])


def common_keys(tables: Sequence[DataFrame], keys: Sequence[str]) -> list[DataFrame]:
    """The tables cut to the keys that all of them have; unchanged if they share none."""
    shared = tables[0].select(*keys).distinct()
    for t in tables[1:]:
        shared = shared.join(t.select(*keys), list(keys), "left_semi")
    return [t.join(shared, list(keys), "left_semi") for t in tables] if not shared.isEmpty() else list(tables)


def per_year_wide(metrics: DataFrame, keys: Sequence[str], years: Sequence[int], *, value: str, year: str = "year") -> DataFrame:
    """One row per key with a column per year, in order, and ``overall`` (the row whose year is null) last."""
    pick = lambda on: F.max(F.when(on, F.col(value)))
    return metrics.groupBy(*keys).agg(*[pick(F.col(year) == y).alias(f"y{y}") for y in sorted(years)], pick(F.col(year).isNull()).alias("overall"))


def fill_padding(series: DataFrame, keys: Sequence[str], channels: Sequence[str], *, mask: str = "mask") -> DataFrame:
    """``series`` with padded steps (mask not true) set to the mean of the sample's real ones, 0 without any."""
    w, real = Window.partitionBy(*keys), F.coalesce(F.col(mask), F.lit(False))
    return series.withColumns({x: F.when(real, F.col(x)).otherwise(F.coalesce(F.avg(F.when(real, F.col(x))).over(w), d(0))) for x in channels})


# --- region features, key sets, lookups

#: Number columns that tell a time and are no features.
TIME_NAMES = ("harvest_year", "year", "date", "dates")


def numeric_features(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """The number columns that neither tell a time nor are in ``skip``, in the table's order; no job runs."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if (t in numbers or t.startswith("decimal")) and n not in (*TIME_NAMES, *skip)]


def region_features(sources: Mapping[str, DataFrame], targets: DataFrame, keys: Sequence[str] = ("country", "region")) -> DataFrame:
    """(keys, ``source_column`` means) of every region of ``targets`` that some source has; null where a source lacks it.

    The sources' rows meet in one aggregation, with partial means before its exchange, in place of a chain of outer joins. NaN is no value.
    """
    rows, names = None, []
    for tag, df in sources.items():
        own = {f"{tag}_{x}": F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")) for x in numeric_features(df, keys)}
        names += own
        part = df.select(*keys, *[v.alias(k) for k, v in own.items()])
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    means = rows.groupBy(*keys).agg(*[F.avg(x).alias(x) for x in names])
    return means.join(targets.select(*keys), list(keys), "left_semi")


def key_sides(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): 'both', 'left' or 'right' for each distinct key of either table; null equals null."""
    both = a.select(*keys, F.lit(1).alias("side_")).unionByName(b.select(*keys, F.lit(2).alias("side_")))
    sides = both.groupBy(*keys).agg(F.bit_or("side_").alias("side_"))
    return sides.select(*keys, F.when(F.col("side_") == 3, "both").when(F.col("side_") == 1, "left").otherwise("right").alias("side"))


def key_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, both, only_left, only_right, jaccard) of two tables' distinct keys, ``by`` being some of them; jaccard is null where both are empty."""
    n = lambda side: F.count(F.when(F.col("side") == side, 1))
    out = key_sides(a, b, keys).groupBy(*by).agg(n("both").alias("both"), n("left").alias("only_left"), n("right").alias("only_right"))
    every = F.col("both") + F.col("only_left") + F.col("only_right")
    return out.withColumn("jaccard", F.when(every > 0, F.col("both") / every))


def prediction_rows(batches: DataFrame, identity: Sequence[str], levels: Sequence[float] = (), *, year: str = "year", regions: str = "regions", targets: str = "targets", preds: str = "preds", quantiles: str = "quantiles") -> DataFrame:
    """(identity, year, region, y_true, y_pred, q*): batches of arrays laid out, a row for each prediction.

    ``quantiles`` is an array of arrays in the order of ``levels``. A batch without predictions gives no rows; a shorter array of
    regions, targets or quantiles gives nulls, and what one has beyond the predictions is left out.
    """
    at = lambda name: F.try_element_at(name, F.col("i_") + 1)
    laid = batches.select("*", F.posexplode(preds).alias("i_", "p_"))
    q = [F.try_element_at(at(quantiles), F.lit(k + 1)).cast("double").alias(f"q{round(100 * t)}") for k, t in enumerate(levels)]
    return laid.select(*identity, F.col(year).cast("int").alias("year"), at(regions).alias("region"), at(targets).cast("double").alias("y_true"), F.col("p_").cast("double").alias("y_pred"), *q)


def label_lookups(samples: DataFrame, suitability: DataFrame, climate: DataFrame, crop: str, *, region: str = "region", order: str = "line") -> DataFrame:
    """``samples`` with suitability_code and climate_label of their region, null without one.

    Of several rows of a region the last in ``order`` counts. Suitability rows without a code, and climate rows of other crops or without data, don't count.
    """
    last = lambda df, x, out: df.groupBy(region).agg(F.max_by(x, order).alias(out))
    code = last(suitability.where("raw_class_code IS NOT NULL").withColumn("code_", F.col("raw_class_code").cast("double")), "code_", "suitability_code")
    label = last(climate.where((F.col("crop") == crop) & F.col("climate_label").isNotNull() & (F.col("climate_label") != "NoData")), "climate_label", "climate_label")
    return samples.join(code, region, "left").join(label, region, "left")


def dataset_years(targets: DataFrame, by: Sequence[str] = ("crop", "country"), *, year: str = "year") -> DataFrame:
    """(by, years): the distinct years of each data set, in order."""
    return targets.where(F.col(year).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_set(F.col(year).cast("int"))).alias("years"))
