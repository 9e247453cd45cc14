"""Daily series: calendars, gap filling, resampling, smoothing. One exchange on the series key serves all windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.columns import calendar_encodings, d


def period_key(day: Column, period: str, start: Column | None = None) -> Column:
    """The label of a day's period: weekly (Monday at or after it), dekad (from the series' start), monthly."""
    if period == "weekly":
        return F.date_add(day, (7 - F.weekday(day)) % 7)
    if period == "dekad":
        return F.date_add(start, (F.floor(F.datediff(day, start) / 10) * 10).cast("int"))
    if period == "monthly":
        return F.trunc(day, "MM").cast("date")
    return day


def calendar(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Every day between the first and last of each key."""
    return df.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias(day))


def reindex(df: DataFrame, days: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """The series on the given days; days without an observation are null, observations off the calendar are lost."""
    return days.join(df, [*keys, day], "left")


def _back(keys: Sequence[str], day: str):
    """From the end to the row: a running frame, where one from the row to the end would be quadratic."""
    return Window.partitionBy(*keys).orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)


def interpolate(df: DataFrame, keys: Sequence[str], day: str, value: str, out: str | None = None) -> DataFrame:
    """Linear gap filling by position; ends take the nearest value."""
    w = Window.partitionBy(*keys).orderBy(day)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), _back(keys, day)
    at = df.withColumn("pos_", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("pos_").alias("p"), F.col(value).alias("v")))
    at = at.withColumns({"a_": F.last(known, True).over(before), "b_": F.last(known, True).over(after)})
    a, b = F.col("a_"), F.col("b_")
    between = a["v"] + (b["v"] - a["v"]) * (F.col("pos_") - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0)).cast("double")
    return at.withColumn(out or value, F.coalesce(F.col(value), between, a["v"], b["v"])).drop("pos_", "a_", "b_")


def fill(df: DataFrame, keys: Sequence[str], day: str, value: str, out: str | None = None) -> DataFrame:
    """The last value before, else the first after."""
    w = Window.partitionBy(*keys).orderBy(day)
    return df.withColumn(out or value, F.coalesce(F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last(value, True).over(_back(keys, day))))


def clean_sensor(df: DataFrame, keys: Sequence[str], value: str, valid: tuple[float, float], clip: tuple[float, float], percent_above: float | None = None) -> DataFrame:
    """Rescale percent to a share where a key's maximum says so, null what is out of range, clip the rest."""
    v = F.col(value)
    if percent_above is not None:
        v = F.when(F.max(v).over(Window.partitionBy(*keys)) > percent_above, v / 100).otherwise(v)
    return df.withColumn(value, F.when(v.between(*valid), F.least(F.greatest(v, d(clip[0])), d(clip[1]))))


#: The range of real readings, beyond which a reading is a sentinel, and the range they are held in.
SENSORS = {
    "fpar": ((-0.1, 1.05), (0.0, 1.0)),
    "ndvi": ((-0.5, 1.05), (0.1, 1.0)),
    "ssm": ((-0.1, 1.05), (0.0, 1.0)),
    "rsm": ((-0.1, 1.05), (0.0, 1.0)),
}


def sensor_series(df: DataFrame, keys: Sequence[str], day: str, value: str, sensor: str) -> DataFrame:
    """Readings of a sensor made whole: sentinels and NaN out, gaps filled linearly by position (ends take the nearest), then clipped.

    Where a key's greatest fpar says percent, all of its readings are divided by 100. A key without a real reading stays null.
    """
    real, held = SENSORS[sensor]
    known = df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")))
    masked = clean_sensor(known, keys, value, real, real, percent_above=real[1] if sensor == "fpar" else None)
    v = F.col(value)
    return interpolate(masked, keys, day, value).withColumn(value, F.when(v.isNotNull(), F.least(F.greatest(v, d(held[0])), d(held[1]))))


def soil_moisture(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Linear gap filling by position, then nothing below 0; there is no upper limit and no sentinel."""
    v = F.col(value)
    return interpolate(df, keys, day, value).withColumn(value, F.when(v.isNotNull(), F.greatest(v, d(0))))


def resample(df: DataFrame, keys: Sequence[str], day: str, aggs: dict[str, Column], period: str) -> DataFrame:
    """One row per key and period."""
    start = F.min(day).over(Window.partitionBy(*keys)) if period == "dekad" else None
    return df.withColumn("period", period_key(F.col(day), period, start)).groupBy(*keys, "period").agg(*[v.alias(k) for k, v in aggs.items()])


def moving_average(df: DataFrame, keys: Sequence[str], day: str, value: str, kernel: int) -> DataFrame:
    """``trend`` (centred mean, the first and last value repeated outside) and ``rest``."""
    w, h = Window.partitionBy(*keys).orderBy(day), kernel // 2
    whole = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, pos = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(w)
    lower, upper = F.greatest(h + 1 - pos, F.lit(0)), F.greatest(pos + h - n, F.lit(0))
    total = F.sum(value).over(w.rowsBetween(-h, h)) + lower * F.first(value).over(whole) + upper * F.last(value).over(whole)
    return df.withColumn("trend", total / d(2 * h + 1)).withColumn("rest", F.col(value) - F.col("trend"))


def masked_moving_average(df: DataFrame, keys: Sequence[str], day: str, value: str, observed: str, kernel: int) -> DataFrame:
    """``trend`` (centred mean of the observed steps among ``kernel``, an odd number; 0 where none is) and ``rest``.

    Steps that aren't observed and those beyond the ends have no weight.
    """
    frame = Window.partitionBy(*keys).orderBy(day).rowsBetween(-(kernel // 2), kernel // 2)
    seen = F.when(F.col(observed) & F.col(value).isNotNull(), F.col(value).cast("double"))
    return df.withColumn("trend", F.coalesce(F.avg(seen).over(frame), d(0))).withColumn("rest", F.col(value) - F.col("trend"))


def binned_encodings(df: DataFrame, keys: Sequence[str], day: str, start: Column, end: Column, period: str) -> DataFrame:
    """(keys, period, encodings): the calendar encodings' mean of a period's days, for every period from a key's first to its last; null in one without a day."""
    made = calendar_encodings(F.col(day), start, end)
    means = resample(df.withColumns(made), keys, day, {k: F.avg(k) for k in made}, period)
    step = {"daily": F.make_interval(days=F.lit(1)), "weekly": F.make_interval(days=F.lit(7)), "dekad": F.make_interval(days=F.lit(10)), "monthly": F.make_interval(months=F.lit(1))}[period]
    bins = means.groupBy(*keys).agg(F.min("period").alias("a_"), F.max("period").alias("b_")).select(*keys, F.explode(F.sequence("a_", "b_", step)).alias("period"))
    return bins.join(means, [*keys, "period"], "left")


def instance_norm(df: DataFrame, keys: Sequence[str], value: str, out: str = "normed") -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.sqrt(F.var_pop(value).over(w) + d(1e-8)))


def anchor_last(df: DataFrame, keys: Sequence[str], day: str, value: str, out: str = "anchored") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(out, F.col(value) - F.last(value, True).over(w))


def pool(df: DataFrame, keys: Sequence[str], day: str, value: str, width: int) -> DataFrame:
    """Mean of each ``width`` steps and whether any was observed."""
    step = F.row_number().over(Window.partitionBy(*keys).orderBy(day)) - 1
    return df.withColumn("token", F.floor(step / width)).groupBy(*keys, "token").agg(F.avg(value).alias("mean"), F.max(F.col(value).isNotNull()).alias("observed"))


def pad(df: DataFrame, keys: Sequence[str], day: str, value: str, length: int) -> DataFrame:
    """Steps 0..length-1 of each key, zeros and observed = false where the series has ended."""
    rows = df.withColumn("step", F.row_number().over(Window.partitionBy(*keys).orderBy(day)) - 1).where(F.col("step") < length)
    steps = df.select(*keys).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return steps.join(rows.select(*keys, "step", value, F.lit(True).alias("seen_")), [*keys, "step"], "left").select(*keys, "step", F.coalesce(value, d(0)).alias(value), F.coalesce("seen_", F.lit(False)).alias("observed"))
