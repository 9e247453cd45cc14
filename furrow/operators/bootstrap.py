"""Intervals of every tier metric over drawn years, paired between an arm and the baseline.

A draw of whole years is a weight per year, so the drawn rows never exist. What is additive comes from sums
per year; correlations within a region from its moments per year, times the weights; the AUC from the
number of ordered pairs of an event in one year and a non-event in another; the lowest tenth from running counts
per year. Rows are read by Spark aggregations and range-dealt running sums; the driver holds a row per year,
a pair of years or a draw.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.functions.columns import d
from furrow.operators import order
from furrow.session import settled

#: Rows that a task weighs at a time.
BLOCK = 500
#: Relative spread under which values count as constant.
FLAT = 1e-12


def year_weights(years: Sequence[int], draws: int, seed: int) -> np.ndarray:
    """(draws + 1, years): how often each draw takes each year; the first row takes each once.

    A draw takes as many years as there are, by the hash of draw, place and seed.
    """
    out = np.zeros((draws + 1, len(years)))
    out[0] = 1
    for k in range(draws):
        for place in range(1, len(years) + 1):
            out[k + 1, int(hashlib.md5(f"{k}-{place}-{seed}".encode()).hexdigest()[:8], 16) % len(years)] += 1
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(b != 0, a / b, np.nan)


def _additive(f: DataFrame, refs: Mapping[str, str], levels: Mapping[float, str], bands: Mapping[str, Mapping[float, str]], sigmas: Sequence[float]) -> dict:
    """Everything that adds up over rows, as expressions by name."""
    y, p, a, b, s = (F.col(x) for x in ("y", "p", "a", "b", "sigma"))
    square = lambda e: e * e
    flag = lambda x: F.when(x, d(1)).otherwise(d(0))
    out = {"n": d(1), "y": y, "yy": y * y, "se": square(y - p), "ae": F.abs(y - p), "pe": F.abs(y - p) / F.greatest(F.abs(y), d(c.EPS)), "sp": 2 * F.abs(y - p) / (F.abs(y) + F.abs(p) + d(c.SMAPE_EPS))}
    out |= {f"se_{k}": square(y - F.col(x)) for k, x in refs.items()} | {f"ae_{k}": F.abs(y - F.col(x)) for k, x in refs.items()}
    out |= {f"within_{round(100 * t)}pct": flag(F.abs(y - p) / F.greatest(F.abs(y), d(1e-8)) <= d(t)) for t in (0.01, 0.05, 0.1, 0.2)} | {f"within_abs_{t:g}".replace(".", "_"): flag(F.abs(y - p) <= d(t)) for t in (0.1, 0.5)}
    if levels:
        low, high = F.col(levels[min(levels)]), F.col(levels[max(levels)])
        alpha = 1 - (max(levels) - min(levels))
        out |= {f"pinball_q{round(100 * t)}": c.pinball(y, F.col(x), t) for t, x in levels.items()} | {f"coverage_q{round(100 * t)}": flag(y <= F.col(x)) for t, x in levels.items()}
        out |= {"picp": flag(y.between(low, high)), "width": high - low, "winkler": (high - low) + d(2 / alpha) * (F.greatest(low - y, d(0)) + F.greatest(y - high, d(0)))}
        for k, band in bands.items():
            out |= {f"crps_ref_{k}": sum((2 * c.pinball(y, F.col(x), t) for t, x in band.items()), start=d(0)) / len(band), f"picp_ref_{k}": flag(y.between(F.col(band[min(band)]), F.col(band[max(band)]))), f"width_ref_{k}": F.col(band[max(band)]) - F.col(band[min(band)])}
    out |= {"a": a, "b": b, "aa": a * a, "bb": b * b, "e2": square(a - b), "a1": F.abs(a)}
    for i, k in enumerate(sigmas):
        event, alarm = a < -d(k) * s, b < -d(k) * s
        out |= {f"event_{i}": flag(event), f"alarm_{i}": flag(alarm), f"hit_{i}": flag(event & alarm)}
    return out


def _within_regions(f: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(median over regions of the correlation over drawn years, correlation of deviations from the regions' drawn means), a value per draw."""
    years = w.shape[1]
    own = Window.partitionBy("region")
    centred = f.select("region", "t", (F.col("y") - F.avg("y").over(own)).alias("u"), (F.col("p") - F.avg("p").over(own)).alias("v"))
    u, v = F.col("u"), F.col("v")
    moments = centred.groupBy("region", "t").agg(F.count("*").cast("double").alias("n"), F.sum(u).alias("u"), F.sum(v).alias("v"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"))
    parts = ["n", "u", "v", "uu", "vv", "uv"]
    regions = moments.groupBy("region").agg(F.collect_list(F.struct("t", *parts)).alias("m"))  # a struct a year

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(w), 3))
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                lists = batch["m"].iloc[at : at + BLOCK]
                grid = np.zeros((6, years, len(lists)))
                for i, rows in enumerate(lists):
                    for r in rows:
                        grid[:, r["t"], i] = [r[x] for x in parts]
                n, su, sv, uu, vv, uv = (w @ g for g in grid)
                with np.errstate(all="ignore"):
                    cuu, cvv, cuv = uu - su * su / n, vv - sv * sv / n, uv - su * sv / n
                    fine = (n >= 3) & (cuu > FLAT * uu) & (cvv > FLAT * vv)
                    r = cuv / np.sqrt(cuu * cvv)
                sums += np.stack([np.where(n > 0, x, 0).sum(1) for x in (cuu, cvv, cuv)], axis=1)
                draw, _ = np.nonzero(fine)
                yield pd.DataFrame({"draw": draw, "r": r[fine], "cuu": None, "cvv": None, "cuv": None})
        yield pd.DataFrame({"draw": np.arange(len(w)), "r": None, "cuu": sums[:, 0], "cvv": sums[:, 1], "cuv": sums[:, 2]})

    rows = settled(regions.mapInPandas(run, "draw int, r double, cuu double, cvv double, cuv double"))
    r_tm, r_an = np.full(len(w), np.nan), np.full(len(w), np.nan)
    for r in order.percentiles(rows.where("r IS NOT NULL"), F.col("r"), {"median": 0.5}, by=["draw"]).collect():  # a row a draw
        r_tm[r.draw] = r.median
    for r in rows.groupBy("draw").agg(*[F.sum(x).alias(x) for x in ("cuu", "cvv", "cuv")]).collect():
        if r.cuu is not None and r.cuu > FLAT and r.cvv > FLAT:
            r_an[r.draw] = r.cuv / np.sqrt(r.cuu * r.cvv)
    return r_tm, r_an


def _by_year(value, years: int) -> dict:
    """A sum per year, of a value per row."""
    return {f"{name}_{t}": F.sum(F.when(F.col("t") == t, x).otherwise(0)) for name, x in value.items() for t in range(years)}


def _aucs(f: DataFrame, w: np.ndarray, scores: Mapping[str, tuple]) -> dict[str, np.ndarray]:
    """The AUC of each draw by name of (score, event), from pairs of years: events of one above non-events of another, ties by half."""
    years = w.shape[1]
    spec = F.explode(F.array(*[F.struct(F.lit(k).alias("spec"), s.cast("double").alias("score"), e.cast("long").alias("event")) for k, (s, e) in scores.items()]))
    rows = f.select("t", spec.alias("x")).select("t", "x.*").where("score IS NOT NULL AND NOT isnan(score)")
    sums = _by_year({"up": F.col("event"), "down": 1 - F.col("event")}, years)
    counts = rows.groupBy("spec", "score").agg(*[x.alias(k) for k, x in sums.items()])
    below = order.running(counts, "score", [f"down_{t}" for t in range(years)], by=["spec"])
    pairs = [F.sum(F.col("ups") * (F.col(f"down_{t}_before") + F.col(f"down_{t}") / d(2))).alias(f"u_{t}") for t in range(years)]
    events = below.select("*", F.posexplode(F.array(*[f"up_{t}" for t in range(years)])).alias("at", "ups"))
    out = {}
    table = events.groupBy("spec", "at").agg(*pairs, F.sum("ups").alias("events"), F.max(F.array(*[f"down_{t}_total" for t in range(years)])).alias("others")).collect()  # a row per score and year
    for k in scores:
        u, e, o = np.zeros((years, years)), np.zeros(years), np.zeros(years)
        for r in table:
            if r.spec == k:
                u[r["at"]], e[r["at"]], o = [r[f"u_{t}"] or 0 for t in range(years)], r.events, np.array(r.others, float)
        out[k] = _ratio(np.einsum("da,ab,db->d", w, u, w), (w @ e) * (w @ o))
    return out


def _captures(f: DataFrame, w: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(capture, rows) of the rows at or under the ``share`` percentile of true anomalies of each draw."""
    years = w.shape[1]
    known = f.where("a IS NOT NULL AND NOT isnan(a)")
    counts = known.groupBy("a").agg(*[x.alias(k) for k, x in _by_year({"n": F.lit(1), "b": F.col("b")}, years).items()])
    ranked = order.running(counts, "a", [f"n_{t}" for t in range(years)])
    columns = lambda k: [f"{k}_{t}" for t in range(years)]
    whole = known.groupBy("t").count().collect()
    total = w @ np.array([sum(r["count"] for r in whole if r.t == t) for t in range(years)], float)
    at = share * (total - 1)

    def blocks(batches):
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                part = batch.iloc[k : k + BLOCK]
                yield part["a"].to_numpy(), part, w @ part[columns("n")].to_numpy(float).T

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.full(len(w), np.nan), np.full(len(w), np.nan)
        for v, part, many in blocks(batches):
            before = w @ part[[f"n_{t}_before" for t in range(years)]].to_numpy(float).T
            for out, place in ((low, np.floor(at)), (high, np.ceil(at))):
                draw, k = np.nonzero((before <= place[:, None]) & (place[:, None] < before + many))
                out[draw] = v[k]
        yield pd.DataFrame({"draw": np.arange(len(w)), "low": low, "high": high})

    found = ranked.select("a", *columns("n"), *[f"n_{t}_before" for t in range(years)]).mapInPandas(ends, "draw int, low double, high double")
    bound = np.full(len(w), np.nan)
    for r in found.where("NOT isnan(low) OR NOT isnan(high)").groupBy("draw").agg(*[F.max(F.when(~F.isnan(x), F.col(x))).alias(x) for x in ("low", "high")]).collect():
        bound[r.draw] = r.low + (at[r.draw] - np.floor(at[r.draw])) * (r.high - r.low)

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(w), 3))
        for v, part, many in blocks(batches):
            under = v[None, :] <= bound[:, None]
            sums += np.stack([(many * under).sum(1), (many * under) @ v, ((w @ part[columns("b")].to_numpy(float).T) * under).sum(1)], axis=1)
        yield pd.DataFrame({"draw": np.arange(len(w)), "n": sums[:, 0], "a": sums[:, 1], "b": sums[:, 2]})

    out = np.full((2, len(w)), np.nan)
    for r in ranked.select("a", *columns("n"), *columns("b")).mapInPandas(tails, "draw int, n double, a double, b double").groupBy("draw").agg(*[F.sum(x).alias(x) for x in "nab"]).collect():
        out[:, r.draw] = (r.b / r.a if r.n and r.a else np.nan), r.n
    return out[0], out[1]


def _drawn_metrics(frame: DataFrame, years: Sequence[int], w: np.ndarray, refs: Mapping[str, str], trend: str, levels: Mapping[float, str], bands: Mapping[str, Mapping[float, str]], sigmas: Sequence[float], names: Mapping[str, str], share: float) -> dict[tuple[str, str], np.ndarray]:
    """(tier, metric) to its value in each draw; nan where it has none."""
    base = F.col(names["ols"])
    other = {x for x in (*refs.values(), *levels.values(), *(q for band in bands.values() for q in band.values()))}
    place = F.array_position(F.array(*map(F.lit, years)), F.col(names["year"])) - 1
    y, p = F.col(names["y"]), F.col(names["p"])
    f = settled(frame.where(F.col(names["year"]).isin(*years) & y.isNotNull() & p.isNotNull()).select(
        F.col(names["region"]).alias("region"), place.cast("int").alias("t"), y.cast("double").alias("y"), p.cast("double").alias("p"), (y - base).alias("a"), (p - base).alias("b"), F.col(names["sigma"]).alias("sigma"), *[F.col(x).alias(f"x_{x}") for x in sorted(other)],
    ))
    refs, levels = {k: f"x_{x}" for k, x in refs.items()}, {t: f"x_{x}" for t, x in levels.items()}
    bands = {k: {t: f"x_{x}" for t, x in band.items()} for k, band in bands.items()}
    sums = _additive(f, refs, levels, bands, sigmas)
    rows = f.groupBy("t").agg(*[F.sum(x).alias(f"s_{k}") for k, x in sums.items()], F.max("y").alias("top"), F.min("y").alias("bottom"), c.pearson(F.col("y"), F.col("p")).alias("r")).collect()  # a row a year
    table = np.zeros((len(years), len(sums)))
    top, bottom, r_year = (np.full(len(years), np.nan) for _ in range(3))
    for r in rows:
        table[r.t] = [np.nan if r[f"s_{k}"] is None else r[f"s_{k}"] for k in sums]
        top[r.t], bottom[r.t], r_year[r.t] = r.top, r.bottom, np.nan if r.r is None else r.r
    s = dict(zip(sums, (w @ table).T))
    n = s["n"]
    mean = lambda k: _ratio(s[k], n)
    root = lambda k: np.sqrt(mean(k))
    spread = lambda x, xx: np.maximum(xx - _ratio(x * x, n), 0)
    total = spread(s["y"], s["yy"])
    out = {("accuracy", k): v for k, v in {
        "n": n, "mse": mean("se"), "rmse": root("se"), "mae": mean("ae"), "mape": mean("pe"), "smape": mean("sp"), "nrmse": _ratio(root("se"), mean("y")),
        "r2": np.where((n >= 2) & (total > FLAT * s["yy"]), 1 - _ratio(s["se"], total), np.nan),
    }.items()}
    for k in refs:
        for name, own, ref in (("rmse", root("se"), root(f"se_{k}")), ("mae", mean("ae"), mean(f"ae_{k}"))):
            out |= {("accuracy", f"{name}_ref_{k}"): ref, ("accuracy", f"skill_{name}_vs_{k}"): 1 - _ratio(own, ref)}
    out |= {("accuracy", k): mean(k) for k in sums if k.startswith("within_")}
    if levels:
        crps = sum(2 * mean(f"pinball_q{round(100 * t)}") for t in levels) / len(levels)
        seen = w > 0
        span = np.where(seen, top, -np.inf).max(1) - np.where(seen, bottom, np.inf).min(1)
        off = sum(np.abs(mean(f"coverage_q{round(100 * t)}") - t) for t in levels) / len(levels)
        block = {"crps": crps, "pinaw": np.where(span > 0, _ratio(mean("width"), span), 0.0), "calibration_error": off}
        block |= {k: mean(k) for k in sums if k in ("picp", "width", "winkler") or k.startswith(("pinball_", "coverage_", "picp_ref_", "width_ref_", "crps_ref_"))}
        block |= {f"skill_crps_vs_{k}": 1 - _ratio(crps, mean(f"crps_ref_{k}")) for k in bands}
        out |= {("uncertainty", k): v for k, v in block.items()}
    r_tm, r_an = _within_regions(f, w)
    va, vb = spread(s["a"], s["aa"]), spread(s["b"], s["bb"])
    ab = (s["aa"] + s["bb"] - s["e2"]) / 2 - _ratio(s["a"] * s["b"], n)
    fine = (n >= 3) & (va > FLAT * s["aa"]) & (vb > FLAT * s["bb"])
    with np.errstate(all="ignore"):
        drawn = np.where(w > 0, r_year, np.nan)
        r_sp = np.array([np.nanmedian(x) if (x == x).any() else np.nan for x in drawn])
        block = {"r_sp": r_sp, "r_tm": r_tm, "r_an_window": np.where(n >= 3, r_an, np.nan), "r_an_detrended": np.where(fine, ab / np.sqrt(va * vb), np.nan)}
    block |= {"r2_an": np.where((n >= 2) & (va > FLAT * s["aa"]), 1 - _ratio(s["e2"], va), np.nan), "nrmse_an": _ratio(root("e2"), mean("a1")), "anomaly_spread_ratio": np.where(va > FLAT * s["aa"], np.sqrt(_ratio(vb, va)), np.nan)}
    out |= {("generalisation", "rmse"): root("se"), ("generalisation", "skill_rmse_vs_trend"): 1 - _ratio(root("se"), root(f"se_{trend}"))} | {("generalisation", k): v for k, v in block.items()}
    safe = F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(d(1))
    scores = {}
    for i, k in enumerate(sigmas):
        e, al, h = s[f"event_{i}"], s[f"alarm_{i}"], s[f"hit_{i}"]
        some = (e > 0) & (e < n)
        precision, recall = np.nan_to_num(_ratio(h, al)), np.nan_to_num(_ratio(h, e))
        found = {"events": e, "base_rate": _ratio(e, n), "precision": precision, "recall": recall, "f1": np.nan_to_num(_ratio(2 * precision * recall, precision + recall))}
        out |= {("operational", f"badyear_{k:g}sig_{m}"): v if m in ("events", "base_rate") else np.where(some, v, np.nan) for m, v in found.items()}
        event = F.col("a") < -d(k) * F.col("sigma")
        scores[f"badyear_{k:g}sig_auc"] = (F.round(-F.col("b") / safe, 9), event)
        if levels:
            scores[f"badyear_{k:g}sig_auc_low"] = (F.round(-(F.col(levels[min(levels)]) - (F.col("y") - F.col("a"))) / safe, 9), event)
    out |= {("operational", k): v for k, v in _aucs(f, w, scores).items()}
    capture, tail = _captures(f, w, share)
    return out | {("operational", "shortfall_capture"): capture, ("operational", "shortfall_n"): tail}


def tier_bootstrap(
    arm: DataFrame, base: DataFrame, *, refs: Mapping[str, str], trend: str, levels: Mapping[float, str] | None = None, bands: Mapping[str, Mapping[float, str]] | None = None, sigmas: Sequence[float] = (0.5, 1.0), ols: str = "ref_trend", sigma: str = "ref_sigma",
    region: str = "region", year: str = "year", y: str = "y", p: str = "y_pred", draws: int = 1000, seed: int = 7, level: float = 0.95, share: float = 0.1,
) -> DataFrame:
    """(tier, metric, m_arm, m_b0, delta, ci_lo, ci_hi, n_boot_eff) of every metric of the four tiers.

    Both frames are scored on the same drawn years, of those that both have. ``refs`` names reference forecasts' columns,
    ``trend`` the one of them that the generalisation tier's skill is against, ``bands`` reference quantiles. A draw without a
    value in either frame doesn't count; the interval is null under two years or under max(20, draws / 10)
    counting draws. Rows without y or prediction are left out; frames that share no year give no rows.
    """
    both = [{r[0] for r in f.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(year).distinct().collect()} for f in (arm, base)]  # a row a year
    years = sorted(both[0] & both[1] - {None})
    schema = "tier string, metric string, m_arm double, m_b0 double, delta double, ci_lo double, ci_hi double, n_boot_eff long"
    spark = arm.sparkSession
    if not years:
        return spark.createDataFrame([], schema)
    w = year_weights(years, draws if len(years) > 1 else 0, seed)
    names = {"region": region, "year": year, "y": y, "p": p, "ols": ols, "sigma": sigma}
    a, b = (_drawn_metrics(f, years, w, refs, trend, levels or {}, bands or {}, sigmas, names, share) for f in (arm, base))
    out, null = [], lambda v: float(v) if np.isfinite(v) else None
    for key in a:
        change = a[key] - b[key]
        drawn = change[1:][np.isfinite(change[1:])]
        ends = [float(np.percentile(drawn, 100 * q)) for q in ((1 - level) / 2, (1 + level) / 2)] if len(drawn) >= max(20, draws // 10) else [None, None]
        out.append((*key, null(a[key][0]), null(b[key][0]), null(change[0]), *ends, len(drawn)))
    return spark.createDataFrame(out, schema)
