"""Comparing runs and distributions: deltas, rank tests, shift statistics, upserts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d
from furrow.operators import order


def deltas(runs: DataFrame, keys: Sequence[str], *, arm: str = "arm", base: str = "B0", metrics: Sequence[str]) -> DataFrame:
    """(keys, arm, metric, base, value, delta): means over seeds against the baseline arm."""
    mean = runs.groupBy(*keys, arm).agg(*[F.avg(m).alias(m) for m in metrics])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    rows = mean.select(*keys, arm, F.explode(pairs).alias("m")).select(*keys, arm, "m.metric", "m.value")
    ref = rows.where(F.col(arm) == base).select(*keys, "metric", F.col("value").alias("base"))
    return rows.where(F.col(arm) != base).join(ref, [*keys, "metric"]).select(*keys, arm, "metric", "base", "value", (F.col("value") - F.col("base")).alias("delta"))


#: Most differences of an exact signed-rank test.
EXACT_RANKS = 50


def _rank_sum_p(n: int, plus: float, ties: float, tied: bool) -> float | None:
    """The two-sided p of a signed-rank sum: exact for few differences without ties, else the normal approximation."""
    if n < 3:
        return None
    if n <= EXACT_RANKS and not tied:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return min(1.0, 2 * ways[: int(min(plus, n * (n + 1) / 2 - plus)) + 1].sum() / 2.0**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return math.erfc(abs(plus - n * (n + 1) / 4) / sd / math.sqrt(2)) if sd else None


def wilcoxon(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, statistic, p_value) of the signed-rank test on differences (zeros left out).

    Exact for up to 50 differences without ties, else the normal approximation with tie correction;
    null under three differences. Ranks come from ranges of the absolute differences; a task sees one row a group.
    """
    v = F.col(value).cast("double")
    real = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (F.abs(v) > 1e-12)
    sized = rows.select(*by, F.when(real, F.round(F.abs(v), 12)).alias("size_"), (v > 0).alias("up_"))
    ranked = order.midranks(sized, "size_", by=by, ups=F.count_if("up_"))
    n = F.col("n")
    sums = ranked.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("ups")).alias("plus"), F.sum(n * n * n - n).cast("double").alias("ties"), (F.max("n") > 1).alias("tied"))
    groups = rows.groupBy(*by).agg(F.lit(0).alias("none_"))
    on = [groups[k].eqNullSafe(sums[k]) for k in by]
    whole = groups.join(sums, on, "left").select(*[groups[k] for k in by], F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("plus", d(0)).alias("plus"), F.coalesce("ties", d(0)).alias("ties"), F.coalesce("tied", F.lit(False)).alias("tied"))

    @F.pandas_udf("double")
    def p_value(n: pd.Series, plus: pd.Series, ties: pd.Series, tied: pd.Series) -> pd.Series:
        return pd.Series([_rank_sum_p(*x) for x in zip(n, plus, ties, tied)], dtype=float)

    statistic = F.when(F.col("n") >= 3, F.least(F.col("plus"), F.col("n") * (F.col("n") + 1) / 2 - F.col("plus")))
    p = p_value("n", "plus", "ties", "tied")
    return whole.select(*by, "n", statistic.alias("statistic"), F.when(F.col("n") >= 3, p).alias("p_value"))


def two_sample(rows: DataFrame, *, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n1, n2, ks, kuiper, wasserstein) of group true against group false.

    Values are counted per distinct value first; running counts give both distribution functions.
    """
    counts = order.counted(rows, value, by=by, a=F.count_if(F.col(group)), b=F.count_if(~F.col(group))).drop("n").withColumn("value_", F.col(value))
    f = order.running(counts, value, ["a", "b"], lows=["value_"], by=by)
    n1, n2 = F.col("a_total"), F.col("b_total")
    gap = c.ratio(F.col("a_before") + F.col("a"), n1) - c.ratio(F.col("b_before") + F.col("b"), n2)
    return f.withColumn("gap", gap).groupBy(*by).agg(
        F.max(n1).alias("n1"), F.max(n2).alias("n2"), F.max(F.abs("gap")).alias("ks"), (F.greatest(F.max("gap"), d(0)) + F.greatest(F.max(-F.col("gap")), d(0))).alias("kuiper"),
        F.coalesce(F.sum(F.abs("gap") * (F.col("value__after") - F.col("value_"))), d(0)).alias("wasserstein"),
    )


#: Largest sample of an exact two-sample test; the series is used beyond.
EXACT_SAMPLE = 10_000


def _ks_exact(n1: int, n2: int, ks: float) -> float:
    """The probability that a random order of both samples has a distance of ``ks`` or more.

    An order is a lattice path of n1 + n2 steps. The share of paths at each place that have stayed inside is
    carried from step to step; what leaves is added up, so small probabilities are exact too.
    """
    reach, whole = round(ks * n1 * n2), n1 + n2
    inside, left = np.zeros(n1 + 1), 0.0
    inside[0], i = 1.0, np.arange(n1 + 1)
    if reach <= 0:
        return 1.0
    for step in range(1, whole + 1):
        j = step - 1 - i  # of the step before
        up, along = inside * np.clip(n1 - i, 0, None), inside * np.clip(n2 - j, 0, None)
        inside = along.copy()
        inside[1:] += up[:-1]
        inside /= whole - step + 1
        out = np.abs(i * n2 - (step - i) * n1) >= reach
        left += inside[out].sum()
        inside[out] = 0.0
    return float(min(1.0, left))


def _ks_series(n1: int, n2: int, ks: float, terms: int = 100) -> float:
    k, rate = np.arange(1, terms + 1), 2 * n1 * n2 / (n1 + n2) * ks * ks
    return float(min(1.0, max(0.0, 2 * ((-1.0) ** (k - 1) * np.exp(-rate * k * k)).sum()))) if rate > 0.08 else 1.0


def ks_p(stats: DataFrame) -> DataFrame:
    """``stats`` with ks_p: the two-sided p of ks, exact for samples up to ``EXACT_SAMPLE``, by the asymptotic series beyond; null where a sample is empty."""

    @F.pandas_udf("double")
    def p_value(n1: pd.Series, n2: pd.Series, ks: pd.Series) -> pd.Series:
        pick = lambda a, b: _ks_exact if max(a, b) <= EXACT_SAMPLE else _ks_series
        return pd.Series([pick(a, b)(*sorted((int(a), int(b))), float(v)) if a and b and v == v and v is not None else None for a, b, v in zip(n1, n2, ks)], dtype=float)

    known = (F.col("n1") > 0) & (F.col("n2") > 0) & F.col("ks").isNotNull()
    return stats.withColumn("ks_p", F.when(known, p_value(F.coalesce("n1", F.lit(0)), F.coalesce("n2", F.lit(0)), F.coalesce("ks", d(0)))))


def moments(rows: DataFrame, *, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_train, n_test, means, population deviations) of group false against group true, null under two finite values in either."""
    v, late = F.col(value).cast("double"), F.col(group)
    rows = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    train, test = F.when(~late, v), F.when(late, v)
    enough = (F.count(train) >= 2) & (F.count(test) >= 2)
    out = {"mean_train": F.avg(train), "mean_test": F.avg(test), "std_train": F.stddev_pop(train), "std_test": F.stddev_pop(test)}
    return rows.groupBy(*by).agg(F.count(train).alias("n_train"), F.count(test).alias("n_test"), *[F.when(enough, x).alias(k) for k, x in out.items()])


def kuiper_p(stats: DataFrame, terms: int = 100) -> DataFrame:
    """``stats`` with kuiper_p, the asymptotic series; 1 below lambda 0.4."""
    n = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")).cast("double"))
    lam = (n + d(0.155) + d(0.24) / n) * F.col("kuiper")
    term = lambda s, j: s + 2 * (4 * j * j * lam * lam - 1) * F.exp(-2 * j * j * lam * lam)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), d(0), lambda s, j: term(s, j.cast("double")))
    return stats.withColumn("kuiper_p", F.when(lam < 0.4, d(1)).otherwise(F.least(F.greatest(series, d(0)), d(1))))


def earliest_useful(runs: DataFrame, by: Sequence[str], *, origin: str = "origin", auc: str = "auc", least: float = 0.7) -> DataFrame:
    """The first origin whose AUC reaches ``least``, null if none does."""
    return runs.groupBy(*by).agg(F.min(F.when(F.col(auc) >= least, F.col(origin))).alias("earliest_origin"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str = "timestamp") -> DataFrame:
    """One row per key (compared as text) over both tables, with the columns of both.

    A new row of the old row's stamp (null equals null) is merged into it, its non-null values first; one of
    any other stamp, older ones too, replaces the row. Within one table the latest stamp of a key counts, null
    the least, and its rows are merged.
    """
    names = [x for x in dict.fromkeys([*old.columns, *new.columns]) if x not in keys]
    as_text = {k: F.col(k).cast("string") for k in keys}

    def latest(df: DataFrame, tag: str) -> DataFrame:
        top = F.max(stamp).over(Window.partitionBy(*as_text.values()))
        rows = df.withColumn("last_", top).where(F.col(stamp).eqNullSafe(F.col("last_")))
        return rows.groupBy(*[v.alias(f"key_{k}") for k, v in as_text.items()]).agg(*[F.first(k).alias(f"{tag}_{k}") for k in keys], *[F.max(x).alias(f"{tag}_{x}") for x in names if x in df.columns], F.lit(True).alias(f"in_{tag}"))

    a, b = latest(old, "old"), latest(new, "new")
    on = [F.col(f"o.key_{k}").eqNullSafe(F.col(f"n.key_{k}")) for k in keys]
    both = a.alias("o").join(b.alias("n"), on, "full")
    same = F.col(f"old_{stamp}").eqNullSafe(F.col(f"new_{stamp}"))

    def value(x: str) -> Column:
        mine = F.col(f"old_{x}") if x in old.columns else F.lit(None)
        fresh = F.col(f"new_{x}") if x in new.columns else F.lit(None)
        return F.when(F.col("in_new").isNull(), mine).when(F.col("in_old").isNotNull() & same, F.coalesce(fresh, mine)).otherwise(fresh).alias(x)

    return both.select(*[F.coalesce(f"new_{k}", f"old_{k}").alias(k) for k in keys], *[value(x) for x in names])
