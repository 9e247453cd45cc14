"""Metric expressions as columns, so that one aggregation can hold all of them.

Missing values are null; readers turn NaN into null once. A metric without enough rows is null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
SMAPE_EPS = 1e-8


def d(x: float) -> Column:
    """A double literal (a bare one could become a decimal)."""
    return F.lit(float(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles, null where b is 0 or null."""
    b = b.cast("double")
    return F.when(b != 0, a.cast("double") / b)


# --- point metrics


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def mape(y: Column, p: Column) -> Column:
    """A fraction, not percent."""
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), d(EPS)))


def smape(y: Column, p: Column) -> Column:
    """Between 0 and 2."""
    return F.avg(2 * F.abs(y - p) / (F.abs(y) + F.abs(p) + d(SMAPE_EPS)))


def r2(y: Column, p: Column) -> Column:
    """1 - residual over total squares; null under two rows; of a constant y 1 if there is no residual, else 0."""
    n, rest = F.count(y), F.sum((y - p) * (y - p))
    total = F.var_pop(y) * n
    return F.when(n < 2, None).when(total > 0, 1 - rest / F.nullif(total, d(0))).otherwise(F.when(rest == 0, d(1)).otherwise(d(0)))


def nrmse(y: Column, p: Column) -> Column:
    return ratio(rmse(y, p), F.avg(y))


def range_nrmse(y: Column, p: Column) -> Column:
    """RMSE in percent of the range."""
    return rmse(y, p) / (F.max(y) - F.min(y) + d(1e-6)) * 100


def pearson(y: Column, p: Column, least: int = 2) -> Column:
    """Correlation from moments; null under ``least`` rows or without spread."""
    both = y.isNotNull() & p.isNotNull()
    y, p = F.when(both, y), F.when(both, p)
    spread = F.stddev_pop(y) * F.stddev_pop(p)
    return F.when((F.count(y) >= least) & (spread > 0), F.covar_pop(y, p) / F.nullif(spread, d(0)))


def skill(err: Column, ref: Column) -> Column:
    """1 - err / ref; null where the reference error is missing or 0."""
    return 1 - ratio(err, ref)


def within_relative(y: Column, p: Column, share: float) -> Column:
    return F.avg(F.when(F.abs(y - p) / F.greatest(F.abs(y), d(1e-8)) <= d(share), d(1)).otherwise(d(0)))


def within_absolute(y: Column, p: Column, size: float) -> Column:
    return F.avg(F.when(F.abs(y - p) <= d(size), d(1)).otherwise(d(0)))


def point_metrics(y: Column, p: Column) -> dict[str, Column]:
    return {"n": F.count(y), "mse": mse(y, p), "rmse": rmse(y, p), "mae": mae(y, p), "mape": mape(y, p), "smape": smape(y, p), "nrmse": nrmse(y, p), "r2": r2(y, p)}


def tolerance_metrics(y: Column, p: Column, shares: Sequence[float] = (0.01, 0.05, 0.1, 0.2), sizes: Sequence[float] = (0.1, 0.5)) -> dict[str, Column]:
    return {f"within_{round(100 * s)}pct": within_relative(y, p, s) for s in shares} | {f"within_abs_{s:g}".replace(".", "_"): within_absolute(y, p, s) for s in sizes}


# --- quantile metrics


def pinball(y: Column, q: Column, tau: float) -> Column:
    return F.greatest(d(tau) * (y - q), d(tau - 1) * (y - q))


def crps(y: Column, quantiles: Mapping[float, Column]) -> Column:
    """Twice the mean pinball loss over the levels, averaged over the rows."""
    total = sum((pinball(y, q, t) for t, q in quantiles.items()), start=d(0))
    return F.avg(2 * total / len(quantiles))


def coverage(y: Column, low: Column, high: Column) -> Column:
    return F.avg(F.when(y.between(low, high), d(1)).otherwise(d(0)))


def relative_width(y: Column, low: Column, high: Column) -> Column:
    span = F.max(y) - F.min(y)
    return F.when(span > 0, F.avg(high - low) / F.nullif(span, d(0))).otherwise(d(0))


def winkler(y: Column, low: Column, high: Column, alpha: float) -> Column:
    return F.avg((high - low) + d(2 / alpha) * (F.greatest(low - y, d(0)) + F.greatest(y - high, d(0))))


def level_coverage(y: Column, q: Column) -> Column:
    return F.avg(F.when(y <= q, d(1)).otherwise(d(0)))


def calibration_error(y: Column, quantiles: Mapping[float, Column]) -> Column:
    return sum((F.abs(level_coverage(y, q) - d(t)) for t, q in quantiles.items()), start=d(0)) / len(quantiles)


# --- agronomy

GDD = {"maize": (10.0, 30.0), "wheat": (0.0, 26.0)}
GDD_OTHER = (5.0, 30.0)


def degree_days(tavg: Column, crop: str) -> Column:
    base, upper = GDD.get(crop, GDD_OTHER)
    return F.greatest(F.least(tavg, d(upper)) - d(base), d(0))


def radiation_use(cum_rad: Column, tavg: Column, prec: Column, crop: str) -> Column:
    """Radiation use times a temperature bell and a saturating water term; 0 where undefined."""
    best = 25.0 if crop == "maize" else 20.0
    out = d(0.48) * cum_rad * F.exp(-((tavg - d(best)) * (tavg - d(best))) / d(2 * 49)) * prec / (prec + d(300 + 1e-9))
    return F.coalesce(out, d(0))


def beta_response(t: Column, low: float, best: float, high: float) -> Column:
    """Cardinal-temperature response in [0, 1], 0 outside (low, high)."""
    shape = (high - best) / (best - low)
    out = ((d(high) - t) / d(high - best)) * F.pow((t - d(low)) / d(best - low), d(1 / shape))
    return F.when((t > low) & (t < high), F.least(F.greatest(out, d(0)), d(1))).otherwise(d(0))


def calendar_encodings(day: Column, start: Column, end: Column) -> dict[str, Column]:
    """Sine and cosine of day of year, month and place in the season; the place has zeros where the season isn't known."""
    two_pi = d(6.283185307179586)
    place = F.least(F.greatest(F.datediff(day, start) / F.greatest(F.datediff(end, start), F.lit(1)), d(0)), d(1))
    parts = {"doy": F.dayofyear(day) / d(365), "month": (F.month(day) - 1) / d(12), "season": place}
    out = {f"{k}_{n}": f(two_pi * v) for k, v in parts.items() for n, f in (("sin", F.sin), ("cos", F.cos))}
    known = start.isNotNull() & end.isNotNull()
    return {k: F.when(known, v).otherwise(d(0)) if k.startswith("season") else v for k, v in out.items()}


def exponential_weight(year: Column, newest: Column, tau: float) -> Column:
    return F.exp(-(newest - year) / d(tau))


# --- labels: fixed values of the classifications

#: First letter to main group, second to moisture, third to temperature class.
CLIMATE_GROUP = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5}
CLIMATE_MOISTURE = {"f": 1, "m": 2, "s": 3, "w": 4, "W": 5, "S": 6, "T": 7, "F": 8}
CLIMATE_HEAT = {"a": 1, "b": 2, "c": 3, "d": 4, "h": 5, "k": 6}


def _look(values: Mapping[str, int], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def climate_ordinals(label: Column) -> dict[str, Column]:
    """Three ordinals of a climate label; a label under two letters has none, unknown first or second letters are null, an unknown or absent third is 0."""
    label = F.trim(label)
    known = (F.length(label) >= 2) & ~label.isin("NoData", "None", "nan")
    return {
        "climate_group": F.when(known, _look(CLIMATE_GROUP, F.substring(label, 1, 1))),
        "climate_moisture": F.when(known, _look(CLIMATE_MOISTURE, F.substring(label, 2, 1))),
        "climate_heat": F.when(known, F.coalesce(_look(CLIMATE_HEAT, F.substring(label, 3, 1)), F.lit(0))),
    }


def shift_class(p: Column, effect: Column, alpha: float = 0.05, far: float = 0.25) -> Column:
    return F.when(p.isNull(), "undetermined").when(p >= alpha, "none").when(effect >= far, "far").otherwise("near")


def model_family(name: Column, families: Mapping[str, str]) -> Column:
    return F.coalesce(_look(families, name), F.lit("other"))


def sorted_quantiles(*q: Column) -> Column:
    """The quantiles ascending and not below 0."""
    return F.transform(F.array_sort(F.array(*q)), lambda x: F.greatest(x, d(0)))


def array_quantiles(samples: Column, levels: Sequence[float]) -> list[Column]:
    """Interpolated quantiles of the numbers in an array (nulls and NaN apart); null where it has none."""
    known = F.array_sort(F.transform(F.filter(samples, lambda x: x.isNotNull() & ~F.isnan(x)), lambda x: x.cast("double")))

    def at(level: float) -> Column:
        place = d(level) * (F.size(known) - 1)
        low, high = (F.try_element_at(known, (f(place) + 1).cast("int")) for f in (F.floor, F.ceil))
        return F.when(F.size(known) > 0, low + (place - F.floor(place)) * (high - low))

    return [at(t) for t in levels]
