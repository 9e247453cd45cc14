"""The distributed domain classifier against plain loops over all regions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import order, shift
from tests.test_order import alone


def test_a_bijection_is_one():
    for size in (1, 2, 3, 5, 17, 64, 1000):
        seen = [tuple(shift.bijection(np.arange(size), size, key)) for key in range(4)]
        assert all(sorted(x) == list(range(size)) for x in seen)
        assert size < 10 or len(set(seen)) == 4
    spread = np.array([shift.bijection(np.array([7]), 100, key)[0] for key in range(3000)])
    assert np.bincount(spread, minlength=100).min() > 5


def plain_fit(x, y):
    """Balanced logistic regression by gradient steps of Newton on scaled rows, one classifier."""
    mean, std = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    share = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    penalty, w = np.append(np.ones(x.shape[1]), 0), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (share * (p - y)) + penalty * w)
    return np.append(w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum())


@pytest.fixture(scope="module")
def regions(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{k}{i}", k, float(rng.normal(2 if k == "far" else 0)), None if i == 3 else float(rng.normal()), 4.0) for k, n in (("far", 9), ("a", 14), (None, 7), ("tiny", 2)) for i in range(n)]
    return spark.createDataFrame(rows, "region string, country string, f double, g double, same double").repartition(3)


def test_distances_equal_plain_loops(spark, regions):
    draws, seed, names = 12, 42, ["f", "g", "same"]
    rows = regions.select("*", F.xxhash64("region", F.lit(seed)).alias("h")).toPandas()
    rows["g"] = rows["g"].fillna(rows["g"].median())
    rows["null"] = rows["country"].notna()
    rows = rows.sort_values(["null", "country", "h"], na_position="first").reset_index(drop=True)
    x, n = rows[names].to_numpy(), len(rows)
    got = {r.country: r for r in shift.domain_distance(regions, names, draws=draws, seed=seed).collect()}
    for country in ("far", "a", None):
        own = rows["country"].isna() if country is None else rows["country"] == country
        first, k = int(np.flatnonzero(own)[0]), min(5, int(own.sum()))
        means, stds = [], []
        for b in range(draws + 1):
            fits = shift.Fits(n, *(np.full(k, v) for v in (first, own.sum(), b)), np.arange(k), np.full(k, k), seed)
            y, out = fits.labels(np.arange(n))
            assert (y.sum(0) == own.sum()).all() and (out.sum(1) == 1).all()
            assert b or (y[:, 0] == own).all()
            scores = []
            for f in range(k):
                s, test = (x @ plain_fit(x[~out[:, f]], y[~out[:, f], f])[:-1]).round(9), out[:, f]
                up, down = s[test & y[:, f]][:, None], s[test & ~y[:, f]][None, :]
                scores.append(((up > down) + (up == down) / 2).mean())
            means.append(np.mean(scores))
            stds.append(np.std(scores))
        r = got[country]
        assert (r.auc, r.auc_std, r.auc_null_mean) == (pytest.approx(means[0]), pytest.approx(stds[0]), pytest.approx(np.mean(means[1:])))
        assert r.perm_p == pytest.approx((sum(v >= means[0] - 1e-12 for v in means[1:]) + 1) / (draws + 1))
    assert (got["tiny"].auc, got["tiny"].n_perm) == (None, 0)


def test_no_task_holds_all_regions(spark, regions):
    assert not hasattr(shift, "MAX_REGIONS")
    table = order.running(regions.select(F.struct("country", "region").alias("key_"), F.lit(1).alias("one")), "key_", ["one"])
    assert not alone(table)
    plan = shift.domain_distance(regions, ["f"], draws=3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "FlatMapGroupsInPandas" not in plan
    assert shift.domain_distance(regions.where("false"), ["f"], draws=3).count() == 0
