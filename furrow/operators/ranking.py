"""Ranking arms against a baseline: intervals over drawn years, verdicts, and performance by shift class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d

#: Metrics of which more is better; of all others less is.
HIGHER_IS_BETTER = ("r2", "r_an", "r_sp", "r_tm", "picp", "auc")
#: Classes in the order of a report.
SHIFT_ORDER = ("far", "near", "none", "undetermined", "unknown")


def _metrics(n: Column, s: Column, s2: Column, e: Column, e2: Column) -> dict[str, Column]:
    """Metrics of one arm from sums: of y, its square, the absolute and the squared error."""
    rmse, total = F.sqrt(e2 / n), s2 - s * s / n
    return {"rmse": rmse, "mae": e / n, "nrmse": c.ratio(rmse, s / n), "r2": F.when((n >= 2) & (total > 0), 1 - e2 / F.nullif(total, d(0)))}


def year_bootstrap(frame: DataFrame, *, year: str = "year", y: str = "y", a: str = "y_pred", b: str = "y_base", draws: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """(metric, m_arm, m_b0, delta, ci_lo, ci_hi, n_boot_eff): both arms scored on the same drawn years.

    Sums are made per year once; a draw takes as many years as there are, with replacement, by the hash of
    (draw, place, seed), so a lost task draws the same again and the drawn rows never exist. The interval is
    null under two years or under max(20, draws / 10) draws with a value. Rows with a null in y, a or b are left out.
    """
    used = frame.where(F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    ea, eb = F.col(y) - F.col(a), F.col(y) - F.col(b)
    parts = {"n": F.count("*").cast("double"), "s": F.sum(y), "s2": F.sum(F.col(y) * F.col(y)), "a1": F.sum(F.abs(ea)), "a2": F.sum(ea * ea), "b1": F.sum(F.abs(eb)), "b2": F.sum(eb * eb)}
    sums = used.groupBy(year).agg(*[v.alias(k) for k, v in parts.items()])

    def both(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        arm, base = (_metrics(*[F.col(x) for x in ("n", "s", "s2", f"{k}1", f"{k}2")]) for k in "ab")
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), arm[m].alias("m_arm"), base[m].alias("m_b0")) for m in arm])
        return rows.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*").withColumn("delta", F.col("m_arm") - F.col("m_b0"))

    years = sums.agg(F.array_sort(F.collect_list(year)).alias("years"))  # a row a year
    place = lambda k: F.conv(F.substring(F.md5(F.concat_ws("-", F.col("draw"), k, F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")
    slots = F.sequence(F.lit(1), F.size("years"))
    table = frame.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(years.where(F.size("years") >= 2)))
    drawn = table.select("draw", F.explode(F.transform(slots, lambda k: F.element_at("years", (1 + F.pmod(place(k), F.size("years"))).cast("int")))).alias(year))
    weighted = drawn.join(F.broadcast(sums), year).groupBy("draw").agg(*[F.sum(k).alias(k) for k in parts])  # a row a year
    finite = both(weighted, ["draw"]).where(F.col("delta").isNotNull() & ~F.isnan("delta"))
    ends = finite.groupBy("metric").agg(F.percentile("delta", (1 - level) / 2).alias("ci_lo"), F.percentile("delta", (1 + level) / 2).alias("ci_hi"), F.count("*").alias("n_boot_eff"))
    point = both(sums.agg(*[F.sum(k).alias(k) for k in parts]).where("n IS NOT NULL"), [])
    enough = F.col("n_boot_eff") >= max(20, draws // 10)
    out = point.join(ends, "metric", "left")
    return out.select("metric", "m_arm", "m_b0", "delta", F.when(enough, F.col("ci_lo")).alias("ci_lo"), F.when(enough, F.col("ci_hi")).alias("ci_hi"), F.coalesce("n_boot_eff", F.lit(0)).alias("n_boot_eff"))


def verdicts(deltas: DataFrame, intervals: DataFrame, tests: DataFrame, *, cell: Sequence[str], panel: Sequence[str], alpha: float = 0.05, higher: Sequence[str] = HIGHER_IS_BETTER) -> DataFrame:
    """``deltas`` with ci_lo, ci_hi (per ``cell``), p_value (per ``panel``), boot_excludes_0, beats_b0_direction and is_win.

    A win needs an interval without 0, p under ``alpha`` and the better direction. Cells without an
    interval or test stay, with nulls and no win.
    """
    out = deltas.join(intervals, list(cell), "left").join(tests, list(panel), "left")
    excludes = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    known = F.col("ci_lo").isNotNull() & F.col("ci_hi").isNotNull()
    better = F.coalesce(F.when(F.col("metric").isin(*higher), F.col("delta") > 0).otherwise(F.col("delta") < 0), F.lit(False))
    out = out.withColumns({"lower_is_better": ~F.col("metric").isin(*higher), "boot_excludes_0": F.when(known, excludes), "beats_b0_direction": better})
    win = F.col("boot_excludes_0") & (F.col("p_value") < alpha) & F.col("beats_b0_direction")
    return out.withColumn("is_win", F.coalesce(win, F.lit(False)))


def by_shift(ranking: DataFrame, shift: DataFrame, *, place: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    """A row per ``keys`` and shift class: member places, mean and median delta, share of the better direction, wins.

    ``shift`` has ``place`` and shift_class; places it doesn't have are 'unknown'. ``class_rank`` orders the classes.
    """
    rows = ranking.join(shift.select(*place, "shift_class"), list(place), "left").withColumn("shift_class", F.coalesce("shift_class", F.lit("unknown")))
    names = F.array_sort(F.collect_set(F.col(name).cast("string")))  # the places of one class
    out = rows.groupBy(*keys, "shift_class").agg(
        F.size(names).alias("n_places"), F.array_join(names, ";").alias("places"), F.avg("delta").alias("mean_delta"), F.percentile("delta", 0.5).alias("median_delta"),
        F.avg(F.col("beats_b0_direction").cast("double")).alias("frac_beats_b0"), F.count_if("is_win").alias("n_wins"),
    )
    rank = F.array_position(F.array(*map(F.lit, SHIFT_ORDER)), F.col("shift_class"))
    return out.withColumn("class_rank", F.when(rank > 0, rank - 1).otherwise(9).cast("int"))
