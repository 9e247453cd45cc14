"""Every registered query against its SQL twin on the smallest tables, and operators on hand-made rows."""

import json

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.operators import comparison, contract, evaluation, features, multiyear, order, reference, series, shift, spectral, splits, tiers
from furrow.plans import assembly, evaluation as whole_evaluation, inputs, intervals, protocol, registry, results  # noqa: F401
from furrow.sources import tables
from furrow.streaming import events

TABLES = "region nation customer supplier part orders lineitem events labels".split()


@pytest.fixture(scope="module")
def db(sf):
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_twin(spark, sf, db, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(got) == len(want)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for x in columns:
        if a[x].dtype.kind in "fi" and b[x].dtype.kind in "fi":
            assert np.allclose(a[x].astype(float), b[x].astype(float), rtol=0, atol=1.1e-6, equal_nan=True), x
        else:
            assert list(a[x].astype(str)) == list(b[x].astype(str)), x


def test_rows_only(spark, sf):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, sf).count() > 0


def test_point_metrics_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("b", 2.0, 3.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0), ("c", None, 1.0)], "k string, y double, y_pred double")
    got = {r.k: r for r in df.groupBy("k").agg(*[v.alias(n) for n, v in c.point_metrics(F.col("y"), F.col("y_pred")).items()], c.pearson(F.col("y"), F.col("y_pred")).alias("r")).collect()}
    assert got["a"].r2 is None and got["a"].r is None
    assert got["b"].r2 == 0.0 and got["b"].r is None  # a constant y that is missed
    assert got["c"].n == 2 and got["c"].r == pytest.approx(1.0)


def test_skill_against_itself_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0)], "y double, y_pred double")
    y, p = F.col("y"), F.col("y_pred")
    assert df.agg(c.skill(c.rmse(y, p), c.rmse(y, p)).alias("s")).first().s == 0.0
    assert df.agg(c.skill(c.rmse(y, p), c.rmse(y, y)).alias("s")).first().s is None


def test_auc_turns_over(spark):
    df = spark.createDataFrame([(0.1, True), (0.4, False), (0.4, True), (0.9, False), (0.3, False)], "s double, e boolean")
    up, down = (order.auc(df.withColumn("s", F.col("s") * k), score="s", event="e").first().auc for k in (1, -1))
    assert up + down == pytest.approx(1.0)
    assert order.auc(df.where("e"), score="s", event="e").first().auc is None


def test_interpolation_by_position(spark):
    rows = [(1, pd.Timestamp(2020, 1, d).date(), v) for d, v in ((1, None), (2, 1.0), (3, None), (9, None), (10, 7.0), (20, None))]
    got = series.interpolate(spark.createDataFrame(rows, "k int, day date, v double"), ["k"], "day", "v").orderBy("day").collect()
    assert [r.v for r in got] == [1.0, 1.0, 3.0, 5.0, 7.0, 7.0]
    filled = series.fill(spark.createDataFrame(rows, "k int, day date, v double"), ["k"], "day", "v").orderBy("day").collect()
    assert [r.v for r in filled] == [1.0, 1.0, 1.0, 1.0, 7.0, 7.0]


def test_conformal_coverage(spark):
    rng = np.random.default_rng(0)
    y, q = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "q10": q - 0.5, "q90": q + 0.5}))
    m = evaluation.conformal_margin(df).first()
    s = np.maximum(q - 0.5 - y, y - q - 0.5)
    assert m.margin == pytest.approx(np.quantile(s, min(1, np.ceil(51 * 0.8) / 50)))
    assert np.mean(s <= m.margin) >= 0.8
    assert evaluation.conformal_margin(df.where("false")).first().margin is None


def test_wilcoxon_exact(spark):
    v = [1.1, -0.4, 2.2, 3.3, -0.2, 0.9]
    got = comparison.wilcoxon(spark.createDataFrame([("m", x) for x in v], "metric string, d double"), ["metric"], "d").first()
    signs = np.array(np.meshgrid(*[[0, 1]] * 6)).reshape(6, -1).T @ np.arange(1, 7)
    plus = sum(r for r, x in zip(pd.Series(np.abs(v)).rank(), v) if x > 0)
    stat = min(plus, 21 - plus)
    assert got.statistic == stat and got.p_value == pytest.approx(min(1, 2 * np.mean(signs <= stat)))
    assert comparison.wilcoxon(spark.createDataFrame([("m", 1.0)], "metric string, d double"), ["metric"], "d").first().p_value is None


def test_splits(spark):
    years = spark.createDataFrame([(y,) for y in range(2000, 2021)], "year int")
    assert [(r.train_end, r.test_year) for r in splits.walk_forward(years, folds=5).orderBy("fold").collect()] == [(y - 1, y) for y in range(2016, 2021)]
    with pytest.raises(ValueError):
        splits.fixed_split(years.where("year < 2002"))


def test_theil_sen_resists_an_outlier(spark):
    rows = [("a", 2000 + k, 2.0 * k + (50 if k == 4 else 0)) for k in range(9)] + [("b", 2000, 5.0)]
    got = {r.region: r for r in reference.theil_sen(spark.createDataFrame(rows, "region string, year int, y double")).collect()}
    assert got["a"].slope == pytest.approx(2.0) and got["b"].slope == 0.0 and got["b"].intercept == 5.0


def test_mann_kendall_prefers_the_shorter_of_equal_windows(spark):
    rows = [("up", 2000 + k, float(k)) for k in range(12)] + [("flat", 2000 + k, float(k % 2)) for k in range(12)]
    got = reference.mann_kendall(spark.createDataFrame(rows, "region string, year int, y double")).collect()
    assert [(r.region, r.length, r.slope) for r in got] == [("up", 10, pytest.approx(1.0))]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1, 1.0, None), (2, "b", 1, 2.0, "x")], "k int, g string, timestamp int, v double, w string")
    new = spark.createDataFrame([(1, "a", 1, None, "y"), (2, "b", 2, 3.0, None), (3, "c", 1, 4.0, None)], "k int, g string, timestamp int, v double, w string")
    once = comparison.upsert(old, new, ["k", "g"])
    want = [(1, "a", 1, 1.0, "y"), (2, "b", 2, 3.0, None), (3, "c", 1, 4.0, None)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, comparison.upsert(once, new, ["k", "g"]).collect()))


def test_upsert_stamps_and_columns(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 7, "c")], "k int, timestamp int, v string")
    new = spark.createDataFrame([(1, 4, "older", 1), (2, None, None, 2), (4, None, "new", 3)], "k int, timestamp int, v string, more int")
    got = comparison.upsert(old, new, ["k"])
    assert got.columns == ["k", "timestamp", "v", "more"]
    assert sorted(map(tuple, got.collect())) == [(1, 4, "older", 1), (2, None, "b", 2), (3, 7, "c", None), (4, None, "new", 3)]


def test_references_leave_missing_values_out(spark):
    rows = [("a", 2000 + k, float(k)) for k in range(6)] + [("a", 2006, None), ("a", 2007, None)]
    got = reference.coefficients(spark.createDataFrame(rows, "region string, year int, y double")).first()
    assert got.rolling3 == 4.0


def test_cutoffs_and_labels(spark):
    df = spark.range(1).select(F.lit(101).alias("n"), F.lit(" Cfa ").alias("l"), F.lit("nan").alias("m"))
    got = df.select(*[tiers.cutoff_days(x, F.col("n"), swapped=s).alias(f"c{i}") for i, (x, s) in enumerate((("end", False), ("quarter", False), ("three-quarter", False), ("three-quarter", True), ("45-days", False)))]).first()
    assert tuple(got) == (0, 25, 75, 25, 45)
    labels = df.select(c.climate_ordinals(F.col("l"))["climate_group"].alias("a"), c.climate_ordinals(F.col("m"))["climate_heat"].alias("b")).first()
    assert tuple(labels) == (3, None)


def test_contract(spark, tmp_path):
    raw = spark.createDataFrame([("1", "20200101"), ("x", "20200102"), (None, "bad"), ("500", "2020-01-03")], "v string, t string")
    rule = contract.numeric_rules(raw, {"v": (2.0, 100.0)}).first()
    assert tuple(rule) == ("v", 1, 1, 1)
    assert [str(r.day) for r in contract.parse_dates(raw, "t").collect()] == ["2020-01-01", "2020-01-02", "None", "None"]
    assert contract.duplicate_keys(spark.createDataFrame([(None,), (None,), (1,)], "k int"), ["k"]).first()[0] == 1
    with pytest.raises(ValueError):
        contract.summary(raw, ["v"], {}, ["v", "absent"])


def test_sources(spark, tmp_path):
    (tmp_path / "maize/XX").mkdir(parents=True)
    (tmp_path / "maize/XX/yield_maize_XX.csv").write_text("adm_id,harvest_year,yield\nA,2001,3.5\nB,2002,NaN\n")
    df = tables.typed(tables.read_contract(spark, str(tmp_path), "yield", "maize", "XX"), ["yield"])
    assert [(r.adm_id, r["yield"], r.crop) for r in df.collect()] == [("A", 3.5, "maize"), ("B", None, "maize")]
    (tmp_path / "years.json").write_text('{"maize": {"AA": [1,2,3,4,5,6,7,8], "EE": []}}')
    assert [(r.country, len(r.years)) for r in tables.year_index(spark, str(tmp_path / "years.json")).collect()] == [("AA", 8)]
    store, rows = str(tmp_path / "store"), spark.createDataFrame([(1, 1, 2.0)], "k int, timestamp int, v double")
    first = tables.merge_into(spark, store, rows, ["k"])
    second = tables.merge_into(spark, store, rows.withColumn("v", F.lit(5.0)), ["k"], published=first)
    assert [tuple(r) for r in spark.read.parquet(second).collect()] == [(1, 1, 5.0)]
    third = tables.merge_into(spark, store, rows.withColumn("v", F.lit(None).cast("double")), ["k"], published=second)
    assert [tuple(r) for r in spark.read.parquet(third).collect()] == [(1, 1, 5.0)]  # no older version comes back


def test_stream_equals_batch(spark, tmp_path):
    rows = [(r, y, (10.0 * r + y - 1990 if y < 2000 else None)) for r in (1, 2) for y in range(1995, 2003)]
    df = spark.createDataFrame(rows, "region int, year int, y double")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = events.recursive_lag_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), weight=0.9)
    q = stream.writeStream.format("memory").queryName("recursive").outputMode("append").trigger(availableNow=True).start()
    q.processAllAvailable()
    got = sorted((r.region, r.year, round(r.y_pred, 9)) for r in spark.sql("SELECT * FROM recursive").collect())
    batch = features.recursive_lag(df.where("year >= 2000"), df.where("year < 2000"), weight=0.9)
    assert got == sorted((r.region, r.year, round(r.y_pred, 9)) for r in batch.collect())


def test_event_stream_windows(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows.repartition(1).write.parquet(str(tmp_path / "ev"))
    stream = events.window_counts(events.with_event_time(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev"))))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.processAllAvailable()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == rows.count()


def test_one_exchange_for_all_windows_of_a_series(spark, sf):
    plan = series.instance_norm(series.fill(series.interpolate(registry.daily(spark, sf), ["region"], "day", "tavg"), ["region"], "day", "tavg"), ["region"], "tavg")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(region") <= 1 and "CartesianProduct" not in text


def test_gated_trend_against_plain_lines(spark):
    train = spark.createDataFrame([("up", y, 2.0 * (y - 1990)) for y in (*range(1990, 1998), *range(2003, 2011))] + [("two", 2000, 1.0), ("two", 2001, 3.0), ("one", 2000, 7.0)], "region string, year int, y double")
    asked = spark.createDataFrame([("up", 2000), ("up", 1994), ("two", 2000), ("one", 2000), ("new", 2000)], "region string, year int")
    got = {(r.region, r.year): r.trend for r in reference.gated_trend(asked, train).collect()}
    assert got["up", 2000] == pytest.approx(20.0) and got["up", 1994] == pytest.approx(8.0)
    assert got["two", 2000] == 3.0 and got["one", 2000] == 7.0  # its own year goes where there are others
    assert got["new", 2000] == pytest.approx(train.agg(F.avg("y")).first()[0])


def test_domain_distance_tells_far_from_near(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{k}{i}", k, float(rng.normal(6 if k == "far" else 0)), float(rng.normal())) for k, n in (("far", 12), ("a", 14), ("b", 14), ("tiny", 2)) for i in range(n)]
    df = spark.createDataFrame([(*r, None) for r in rows], "region string, country string, f double, g double, empty double")
    got = {r.country: r for r in shift.domain_distance(df, ["f", "g", "empty"], draws=60).collect()}
    assert got["far"].auc > 0.99 and got["far"].shift_class == "far" and got["far"].perm_p == pytest.approx(1 / 61)
    assert got["tiny"].shift_class == "undetermined" and got["tiny"].auc is None and "too few" in got["tiny"].note
    assert got["a"].auc_debiased < got["far"].auc_debiased and got["a"].n_perm == 60
    assert got["far"] == next(r for r in shift.domain_distance(df.repartition(7), ["f", "g", "empty"], draws=60).collect() if r.country == "far")


def test_spectral_finds_a_planted_period(spark):
    t = np.arange(48)
    wave = 5 + 3 * np.sin(2 * np.pi * t / 12) + np.cos(2 * np.pi * t / 4)
    df = spark.createDataFrame([("s", int(i), float(v)) for i, v in zip(t, wave)], "k string, t int, v double")
    assert [(r.frequency, r.period) for r in spectral.top_periods(df, ["k"], "t", "v", 48).collect()] == [(4, 12), (12, 4)]
    parts = spectral.split_dominant(df, ["k"], "t", "v", 2).orderBy("t").toPandas()
    assert np.allclose(parts["dominant"], 5 + 3 * np.sin(2 * np.pi * t / 12)) and np.allclose(parts["dominant"] + parts["rest"], wave)


def test_multi_year_edges(spark):
    rows = [("a", 2000, d, t, t, t, p) for d, t, p in ((1, 12.0, None), (2, None, None), (3, 40.0, None))] + [("a", 2001, 1, None, None, None, 3.0)]
    df = spark.createDataFrame(rows, "region string, year int, day int, tavg double, tmin double, tmax double, prec double")
    got = {r.year: r for r in multiyear.weather_summaries(df, ["region", "year"], "maize").collect()}
    assert got[2000].gdd == 22.0 and got[2000].avg_temp == 26.0 and got[2000].total_precip is None and got[2001].avg_temp is None
    assert multiyear.weather_summaries(df, ["region", "year"], "maize", heat_base=True).where("year = 2000").first().gdd == 0.0
    ssm = spark.createDataFrame([("a", i, float(i) if i % 2 else None) for i in range(100)], "k string, day int, ssm double")
    assert multiyear.remote_summaries(ssm, ["k"], "day", channels=["ssm"]).first().ssm_final == pytest.approx(np.mean(range(41, 100, 2)))


def test_geojson_file_is_one_collection(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 2.5, "a", "x\"y"), (3.0, 4.0, None, "z"), (5.0, 6.0, "b", None)], "longitude double, latitude double, code string, note string")
    tables.write_geojson(df, str(tmp_path / "g"), ["code", "note"], name='la"bels', label="code")
    whole = json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect()))
    assert whole["type"] == "FeatureCollection" and whole["name"] == 'la"bels' and [f["properties"] for f in whole["features"]] == [{"code": "a", "note": 'x"y'}, {"code": "b", "note": None}]
    assert whole["features"][0]["geometry"] == {"type": "Point", "coordinates": [1.5, 2.5]}
