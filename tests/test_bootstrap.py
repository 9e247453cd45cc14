"""Tier intervals against drawn frames that are really built."""

import numpy as np
import pandas as pd
import pytest

from furrow.operators import bootstrap

KEYS = {"refs": {"ols": "ref_trend"}, "trend": "ols", "levels": {0.1: "q10", 0.9: "q90"}, "sigmas": (0.5,)}


def made(seed, bias):
    rng = np.random.default_rng(seed)
    rows = []
    for region in range(17):
        for year in range(2000, 2008):
            for _ in range(1 + (region + year) % 2):
                y = 50 + region + rng.normal(0, 3)
                p = round(y + bias + rng.normal(0, 2), 1)
                rows.append((region, year, y, p, p - 2, p + 2, 50.0 + region, 2.0 + region % 3))
    return pd.DataFrame(rows, columns="region year y y_pred q10 q90 ref_trend ref_sigma".split())


def brute(f):
    a, b = (f.y - f.ref_trend).to_numpy(), (f.y_pred - f.ref_trend).to_numpy()
    event, score = a < -0.5 * f.ref_sigma.to_numpy(), np.round(-b / f.ref_sigma.to_numpy(), 9)
    up, down = score[event][:, None], score[~event][None, :]
    tail = a <= np.quantile(a, 0.1) + 1e-12
    r = lambda g: g.y.corr(g.y_pred) if len(g) >= 3 and g.y.std(ddof=0) > 1e-9 and g.y_pred.std(ddof=0) > 1e-9 else np.nan
    u, v = (f[x] - f.groupby("region")[x].transform("mean") for x in ("y", "y_pred"))
    return {
        "rmse": np.sqrt(((f.y - f.y_pred) ** 2).mean()), "r2": 1 - ((f.y - f.y_pred) ** 2).sum() / ((f.y - f.y.mean()) ** 2).sum(), "pinaw": (f.q90 - f.q10).mean() / (f.y.max() - f.y.min()),
        "r_tm": np.nanmedian([r(g) for _, g in f.groupby("region")]), "r_sp": np.nanmedian([g.y.corr(g.y_pred) for _, g in f.drop_duplicates().groupby("year")]), "r_an_window": np.corrcoef(u, v)[0, 1], "r_an_detrended": np.corrcoef(a, b)[0, 1],
        "badyear_0.5sig_auc": ((up > down) + (up == down) / 2).mean() if event.any() and not event.all() else np.nan, "shortfall_capture": (-b[tail]).mean() / (-a[tail]).mean(), "shortfall_n": tail.sum(),
        "badyear_0.5sig_precision": (event & (b < -0.5 * f.ref_sigma)).sum() / max(1, (b < -0.5 * f.ref_sigma).sum()),
    }


def test_intervals_equal_drawn_frames(spark):
    arm, base = made(1, 0.2), made(2, 1.0)
    draws, years = 40, list(range(2000, 2008))
    w = bootstrap.year_weights(years, draws, 7)
    assert (w.sum(1) == len(years)).all() and (w[0] == 1).all()
    frames = lambda f: [pd.concat([f[f.year == t] for t, m in zip(years, row) for _ in range(int(m))]) for row in w]
    want = [{k: x[k] - z[k] for k in x} for x, z in zip(map(brute, frames(arm)), map(brute, frames(base)))]
    got = {r.metric: r for r in bootstrap.tier_bootstrap(*(spark.createDataFrame(f).repartition(4) for f in (arm, base)), **KEYS, draws=draws).where("NOT (tier = 'generalisation' AND metric = 'rmse')").collect()}
    for k in want[0]:
        drawn = np.array([x[k] for x in want[1:]])
        assert got[k].delta == pytest.approx(want[0][k]), k
        assert (got[k].n_boot_eff, got[k].ci_lo, got[k].ci_hi) == (draws, pytest.approx(np.percentile(drawn, 2.5)), pytest.approx(np.percentile(drawn, 97.5))), k


def test_few_years_and_missing_values(spark):
    arm = spark.createDataFrame(made(1, 0.2))
    one = bootstrap.tier_bootstrap(arm, arm.where("year = 2003").withColumn("y_pred", arm.y_pred + 1), **KEYS, draws=30).collect()
    assert {r.n_boot_eff for r in one} == {0} and {r.ci_lo for r in one} == {None}
    assert {r.metric: r.m_arm for r in one if r.tier == "accuracy"}["n"] == arm.where("year = 2003").count()
    assert bootstrap.tier_bootstrap(arm, arm.where("year > 3000"), **KEYS).count() == 0
    gaps = arm.selectExpr("*").replace(50, None, ["region"]).withColumn("y_pred", arm.y_pred).where("year < 2004")
    holes = gaps.selectExpr("region", "year", "CASE WHEN region = 3 THEN NULL ELSE y END AS y", "CASE WHEN region = 4 THEN NULL ELSE y_pred END AS y_pred", "q10", "q90", "ref_trend", "ref_sigma")
    n = {r.metric: r.m_arm for r in bootstrap.tier_bootstrap(holes, holes, **KEYS, draws=25).collect() if r.tier == "accuracy"}["n"]
    assert n == holes.where("y IS NOT NULL AND y_pred IS NOT NULL").count()
