"""Exact order statistics over any number of rows, without a step that holds them all.

Values are counted first, so copies cost nothing; the distinct ones are dealt by ranges, and each range
adds up its own. What lies before a range follows from the totals of the ranges (a row each), so a rank, a
running sum or a percentile is exact and no task sees more than its range.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d
from furrow.session import settled


def counted(rows: DataFrame, value: str, *, by: Sequence[str] = (), **more: Column) -> DataFrame:
    """(by, value, n and ``more``): a row per distinct value; nulls and NaN are left out."""
    v = F.col(value)
    known = v.isNotNull() & ~F.isnan(v) if dict(rows.dtypes)[value] in ("double", "float") else v.isNotNull()
    return rows.where(known).groupBy(*by, value).agg(F.count("*").alias("n"), *[x.alias(k) for k, x in more.items()])


def running(table: DataFrame, order: str, sums: Sequence[str] = (), *, lows: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """``table`` with ``x_before`` and ``x_total`` for each of ``sums`` (what the group's rows of smaller ``order`` add up to, and
    all of them), and ``x_after`` for each of ``lows`` (the least among rows of larger ``order``, null behind the last).

    ``order`` is distinct within a group. The dealt table is settled in the shared folder.
    """
    dealt = settled(table.repartitionByRange(*by, order).withColumn("part_", F.spark_partition_id()))
    totals = dealt.groupBy(*by, "part_").agg(*[F.sum(x).alias(f"{x}_sum") for x in sums], *[F.min(x).alias(f"{x}_low") for x in lows])
    if by:
        w = Window.partitionBy(*by).orderBy("part_")
        before = [F.coalesce(F.sum(f"{x}_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{x}_base") for x in sums]
        whole = [F.sum(f"{x}_sum").over(Window.partitionBy(*by)).alias(f"{x}_total") for x in sums]
        down = Window.partitionBy(*by).orderBy(F.desc("part_")).rowsBetween(Window.unboundedPreceding, -1)
        ranges = totals.select(*by, "part_", *before, *whole, *[F.min(f"{x}_low").over(down).alias(f"{x}_beyond") for x in lows])
    else:
        ranges = _ranges(totals, sums, lows)
    up = Window.partitionBy(*by, "part_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*by, "part_").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({f"{x}_up": F.coalesce(F.sum(x).over(up), F.lit(0)) for x in sums} | {f"{x}_next": F.min(x).over(back) for x in lows})
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*by, "part_")]
    both = own.alias("o").join((ranges if by else F.broadcast(ranges)).alias("r"), on)
    out = [F.col(f"o.{x}") for x in table.columns]
    for x in sums:
        out += [(F.col(f"{x}_base") + F.col(f"{x}_up")).alias(f"{x}_before"), F.col(f"{x}_total")]
    return both.select(*out, *[F.coalesce(f"{x}_next", f"{x}_beyond").alias(f"{x}_after") for x in lows])


def _ranges(totals: DataFrame, sums: Sequence[str], lows: Sequence[str]) -> DataFrame:
    """The same of a table without groups: its totals are a row for each partition, few enough for the driver."""
    rows = sorted(totals.collect(), key=lambda r: r.part_)
    base, beyond, out = {x: 0 for x in sums}, {x: None for x in lows}, []
    for r in rows:
        out.append({"part_": r.part_, **{f"{x}_base": base[x] for x in sums}})
        base = {x: base[x] + (r[f"{x}_sum"] or 0) for x in sums}
    for r, o in zip(reversed(rows), reversed(out)):
        o |= {f"{x}_total": base[x] for x in sums} | {f"{x}_beyond": beyond[x] for x in lows}
        beyond = {x: min((v for v in (beyond[x], r[f"{x}_low"]) if v is not None), default=None) for x in lows}
    kinds = dict(totals.dtypes)
    schema = ["part_ int", *[f"{x}_{k} {kinds[f'{x}_sum']}" for x in sums for k in ("base", "total")], *[f"{x}_beyond {kinds[f'{x}_low']}" for x in lows]]
    names = [s.split()[0] for s in schema]
    exact = lambda v, n: float(v) if kinds.get(n.rsplit("_", 1)[0] + "_sum") == "double" else v
    return totals.sparkSession.createDataFrame([tuple(exact(o[n], n) for n in names) for o in out], ", ".join(schema))


def percentiles(rows: DataFrame, value: Column, levels: Mapping[str, float | Callable[[Column], Column]], *, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, a column per level): interpolated percentiles of the values that are there; one row without ``by``, with nulls
    where there are none. A level is a number, or a function of the group's count."""
    values = counted(rows.select(*by, value.cast("double").alias("value_")), "value_", by=by)
    ranked = running(values, "value_", ["n"], by=by)
    picks, at = [F.max("n_total").alias("n")], {}
    for k, level in levels.items():
        share = level(F.col("n_total")) if callable(level) else d(level)
        at[k] = share * (F.col("n_total") - 1)
        for side, place in (("low", F.floor(at[k])), ("high", F.ceil(at[k]))):
            here = (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n"))
            picks.append(F.max(F.when(here, F.col("value_"))).alias(f"{k}_{side}"))
        picks.append(F.max(at[k] - F.floor(at[k])).alias(f"{k}_share"))
    found = ranked.groupBy(*by).agg(*picks)
    return found.select(*by, F.coalesce("n", F.lit(0)).alias("n"), *[(F.col(f"{k}_low") + F.col(f"{k}_share") * (F.col(f"{k}_high") - F.col(f"{k}_low"))).alias(k) for k in levels])


def midranks(rows: DataFrame, value: str, *, by: Sequence[str] = (), **more: Column) -> DataFrame:
    """(by, value, n, more, n_before, n_total, rank): a row per distinct value with the mean of its rows' ranks from 1."""
    ranked = running(counted(rows, value, by=by, **more), value, ["n"], by=by)
    return ranked.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / d(2))


def auc(rows: DataFrame, *, score: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_events, n, auc) by midranks; null where all rows or none are events."""
    ranked = midranks(rows, score, by=by, e=F.sum(F.col(event).cast("long")))
    e, n = F.sum("e"), F.sum("n")
    return ranked.groupBy(*by).agg(e.alias("n_events"), n.alias("n"), c.ratio(F.sum(F.col("rank") * F.col("e")) - e * (e + 1) / d(2), e * (n - e)).alias("auc"))


def false_discovery(rows: DataFrame, *, p: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with q_value, the Benjamini-Hochberg minimum from the largest p down; a null p has none and isn't counted."""
    ranked = running(counted(rows, p, by=by), p, ["n"], by=by)
    raw = F.col(p) * F.col("n_total") / (F.col("n_before") + F.col("n"))  # of equal values the last one's rank counts
    least = running(ranked.select(*by, p, raw.alias("raw_")), p, lows=["raw_"], by=by)
    q = least.select(*[F.col(k).alias(f"{k}_q") for k in by], F.col(p).alias("p_q"), F.least("raw_", "raw__after", d(1)).alias("q_value"))
    on = [rows[k].eqNullSafe(q[f"{k}_q"]) for k in by] + [rows[p] == q["p_q"]]
    return rows.join(q, on, "left").select(*[rows[x] for x in rows.columns], "q_value")
