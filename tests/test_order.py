"""Order statistics, rank tests and the two-sample test against plain loops, over many ranges."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import comparison, evaluation, order, reference


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 500).round(1), np.full(300, 0.25), rng.normal(5, 9, 200)])
    data = [("ab"[i % 3 == 0], None if i % 97 == 0 else float(x), bool(i % 4 == 0)) for i, x in enumerate(v)] + [(None, 1.0, True), (None, 2.0, False), ("a", float("nan"), True)]
    return spark.createDataFrame(data, "g string, v double, e boolean").repartition(5), data


def alone(plan):
    """Exchanges into one task that carry more than partial aggregates."""
    lines = plan._jdf.queryExecution().executedPlan().toString().split("\n")
    return [x for x, below in zip(lines, lines[1:]) if "SinglePartition" in x and "partial_" not in below and "Scan ExistingRDD" not in below]


def finite(data, g=...):
    return [v for k, v, _ in data if (g is ... or k == g) and v is not None and v == v]


def test_percentiles_equal_numpy(rows):
    df, data = rows
    levels = {"low": 0.0, "some": 0.123, "mid": 0.5, "high": 0.975, "top": 1.0, "own": lambda n: 1 / n}
    want = lambda x: [np.percentile(x, 100 * (1 / len(x) if callable(q) else q)) for q in levels.values()]
    got = order.percentiles(df, F.col("v"), levels)
    assert not alone(got) and "percentile(" not in got._jdf.queryExecution().executedPlan().toString()
    row = got.first()
    assert row.n == len(finite(data)) and np.allclose([row[k] for k in levels], want(finite(data)))
    for r in order.percentiles(df, F.col("v"), levels, by=["g"]).collect():
        assert np.allclose([r[k] for k in levels], want(finite(data, r.g)))
    none = order.percentiles(df.where("false"), F.col("v"), {"x": 0.5}).collect()
    assert [(r.n, r.x) for r in none] == [(0, None)]


def test_running_sums_and_the_least_behind(spark):
    table = spark.createDataFrame([(i * 7 % 101, i, i * 13 % 17) for i in range(101)], "k int, s long, m int").repartition(6)
    want, by_key = {}, sorted(table.collect())
    for i, r in enumerate(by_key):
        want[r.k] = (sum(x.s for x in by_key[:i]), sum(x.s for x in by_key), min((x.m for x in by_key[i + 1 :]), default=None))
    assert {r.k: (r.s_before, r.s_total, r.m_after) for r in order.running(table, "k", ["s"], lows=["m"]).collect()} == want
    grouped = order.running(table.withColumn("g", F.col("k") % 2), "k", ["s"], lows=["m"], by=["g"]).collect()
    for r in grouped:
        own = [x for x in by_key if x.k % 2 == r.g]
        assert (r.s_before, r.s_total, r.m_after) == (sum(x.s for x in own if x.k < r.k), sum(x.s for x in own), min((x.m for x in own if x.k > r.k), default=None))


def test_auc_and_midranks(rows):
    df, data = rows
    clean = [(v, e) for _, v, e in data if v is not None and v == v]
    up, down = [v for v, e in clean if e], [v for v, e in clean if not e]
    want = sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))
    got = order.auc(df, score="v", event="e")
    assert got.first().auc == pytest.approx(want) and not alone(got)
    assert {r.g for r in order.auc(df, score="v", event="e", by=["g"]).collect()} == {"a", "b", None}


def test_false_discovery_equals_plain_steps(spark):
    p = [0.01, 0.04, 0.04, 0.2, None, 0.9, 0.03, 1.0]
    df = spark.createDataFrame([(i, x, "g") for i, x in enumerate(p)], "i int, p double, g string")
    known = sorted(x for x in p if x is not None)
    want = {x: min(1.0, min(known[j] * len(known) / (j + 1) for j in range(len(known)) if known[j] >= x)) for x in known}
    for by in ([], ["g"]):
        got = {r.i: r.q_value for r in order.false_discovery(df, p="p", by=by).collect()}
        assert all(got[i] is None if x is None else got[i] == pytest.approx(want[x]) for i, x in enumerate(p))


def brute_signed_rank(v):
    v = [x for x in v if abs(x) > 1e-12]
    sizes = sorted(abs(x) for x in v)
    rank = {s: sum(i + 1 for i, x in enumerate(sizes) if x == s) / sizes.count(s) for s in sizes}
    plus = sum(rank[abs(x)] for x in v if x > 0)
    low = min(plus, len(v) * (len(v) + 1) / 2 - plus)
    hits = sum(sum(r for r, s in zip(rank.values(), signs) if s) <= low for signs in itertools.product([0, 1], repeat=len(v)))
    return len(v), low, min(1.0, 2 * hits / 2 ** len(v))


def test_signed_rank_is_exact_and_keeps_empty_groups(spark):
    groups = {"a": [1.5, -0.25, 3.0, 2.0, -4.5, 0.0, 7.25], "b": [1.0, 2.0], "c": [0.0, None, float("nan")], None: [-1.0, -2.0, -3.0]}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "g string, delta double")
    got = {r.g: r for r in comparison.wilcoxon(df, ["g"], "delta").collect()}
    for k in ("a", None):
        assert (got[k].n, got[k].statistic, pytest.approx(got[k].p_value)) == brute_signed_rank(groups[k])
    assert [(got[k].n, got[k].statistic, got[k].p_value) for k in ("b", "c")] == [(2, None, None), (0, None, None)]
    tied = spark.createDataFrame([("t", float(x)) for x in [1, 1, -1, 2, 2, 3, -2, 5, 5, 6]], "g string, delta double")
    r = comparison.wilcoxon(tied, ["g"], "delta").first()
    plus, ties = 2 + 2 + 5 + 5 + 7 + 8.5 * 2 + 10, 2 * (27 - 3) + (8 - 2)
    sd = math.sqrt(10 * 11 * 21 / 24 - ties / 48)
    assert r.p_value == pytest.approx(math.erfc(abs(plus - 27.5) / sd / math.sqrt(2)))


def ks(a, b):
    return max(abs(sum(x <= t for x in a) / len(a) - sum(x <= t for x in b) / len(b)) for t in [*a, *b])


def test_two_sample_p_equals_enumeration(spark):
    for n1, n2 in ((1, 3), (3, 4), (4, 4), (2, 6)):
        both = list(range(n1 + n2))
        null = [ks(list(pick), [x for x in both if x not in pick]) for pick in itertools.combinations(both, n1)]
        for value in sorted(set(null)):
            assert comparison._ks_exact(n1, n2, value) == pytest.approx(sum(x >= value - 1e-9 for x in null) / len(null))
    assert comparison._ks_exact(800, 900, 0.05) == pytest.approx(comparison._ks_series(800, 900, 0.05), rel=0.15)
    assert comparison._ks_exact(3000, 3000, 0.2) < 1e-40
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 60).round(2), rng.normal(0.4, 1, 45).round(2)
    df = spark.createDataFrame([(float(x), False) for x in b] + [(float(x), True) for x in a] + [(None, True)], "v double, late boolean").repartition(4)
    got = comparison.ks_p(comparison.two_sample(df, value="v", group="late")).first()
    grid = np.unique(np.concatenate([a, b]))
    gap = np.array([(a <= t).mean() - (b <= t).mean() for t in grid])
    assert (got.n1, got.n2) == (60, 45) and got.ks == pytest.approx(np.abs(gap).max()) and got.wasserstein == pytest.approx((np.abs(gap[:-1]) * np.diff(grid)).sum())
    assert got.ks_p == pytest.approx(comparison._ks_exact(45, 60, got.ks))
    one = comparison.ks_p(comparison.two_sample(df.where("late"), value="v", group="late", by=["late"])).first()
    assert one.n2 == 0 and one.ks_p is None


def test_evaluation_has_no_step_over_all_rows(spark):
    rng = np.random.default_rng(1)
    f = spark.createDataFrame([(i % 9, 1990 + i % 7, float(a), float(b), float(b) - 1, float(b) + 1, float(a), float(b), 1.0) for i, (a, b) in enumerate(rng.normal(5, 2, (200, 2)))], "region int, year int, y double, y_pred double, q10 double, q90 double, anom_true double, anom_pred double, ref_sigma double")
    for plan in (evaluation.conformal_margin(f), evaluation.shortfall_capture(f), reference.quantile_map(f, f), reference.pooled(f, reference.coefficients(f)), comparison.two_sample(f.withColumn("late", F.col("year") > 1993), value="y", group="late")):
        assert not alone(plan)
        assert not re.search(r"\bpercentile\(", plan._jdf.queryExecution().executedPlan().toString())
    score = np.maximum(*(np.array([[r.q10 - r.y, r.y - r.q90] for r in f.collect()]).T))
    m = evaluation.conformal_margin(f).first()
    assert (m.n, m.margin) == (200, pytest.approx(np.quantile(score, min(1, math.ceil(201 * 0.8) / 200))))
    assert tuple(evaluation.conformal_margin(f.where("false")).first()) == (0, None)
