"""Stores, quarantine, sample assembly, catalogue choice, array quantiles and state with timers on hand-made rows."""

import datetime as dt
import hashlib
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.functions import columns as c
from furrow.operators import assembly, catalogue
from furrow.sources import quarantine, store
from furrow.streaming import events


def digests(path):
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(path).rglob("part-*")}


def test_one_partition_is_replaced_and_others_stay(spark, tmp_path):
    rows = spark.createDataFrame([(i, "abc"[i % 3], i % 2) for i in range(30)], "x int, country string, seed int")
    path = str(tmp_path / "t")
    store.overwrite_partitions(rows, path, ["country", "seed"])
    before = digests(path)
    store.overwrite_partitions(spark.createDataFrame([(99, "b", 1)], "x int, country string, seed int"), path, ["country", "seed"])
    after = digests(path)
    same = {k for k in before if after.get(k) == before[k]}
    assert {k for k in before if "country=b/seed=1" not in k} == same
    assert [r.x for r in spark.read.parquet(path).where("country = 'b' AND seed = 1").collect()] == [99] and spark.read.parquet(path).count() == 26


def test_union_keeps_the_first(spark):
    old = spark.createDataFrame([("m", "AT", 1.0, 2), ("m", None, 5.0, 1)], "model string, country string, value double, at int")
    new = spark.createDataFrame([("m", "AT", 9.0, 1, "x"), ("n", "AT", 3.0, 7, "y"), ("n", "AT", 4.0, 6, "z"), ("m", None, 7.0, 0, "w")], "model string, country string, value double, at int, note string")
    got = {(r.model, r.country): (r.value, r.note) for r in assembly.union_first(old, new, ["model", "country"], ["at"]).collect()}
    assert got == {("m", "AT"): (1.0, None), ("m", None): (5.0, None), ("n", "AT"): (4.0, "z")}


def test_cache_hit_miss_and_second_writer(spark, tmp_path):
    cache = store.FeatureCache(spark, str(tmp_path / "cache"))
    a, b = {"crop": "maize", "features": {"gdd", "rue"}, "lag": 2}, {"lag": 2, "features": {"rue", "gdd"}, "crop": "maize"}
    assert cache.key(a) == cache.key(b) != cache.key(a | {"lag": 3}) and cache.get(a) is None
    one, two = spark.range(3), spark.range(5)
    first, second = cache.stage(a, one), cache.stage(b, two)
    assert cache.get(a) is None  # files without a manifest are no table
    assert cache.publish(a, first) and not cache.publish(b, second)
    assert cache.get(b).count() == 3
    assert [p.name for p in (tmp_path / "cache" / cache.key(a)).iterdir() if p.name.startswith(("data", "draft"))] == [first]
    built = []
    assert cache.get_or_build(a, lambda: built.append(1) or two).count() == 3 and not built
    assert cache.get_or_build({"crop": "wheat"}, lambda: built.append(1) or two).count() == 5 and built
    assert (cache.hits, cache.misses) == (2, 3)


def test_bad_rows_are_kept_with_their_reasons(spark, tmp_path):
    (tmp_path / "a.csv").write_text("adm_id,latitude,longitude\nA1,10.5,20\nA2,95,20\n ,1,200\nA3,north,1\nA1,1,1\nA4,,5\n")
    (tmp_path / "b.csv").write_text("adm_id,latitude,longitude\nB1,1,2,3,4\nB2,0,0\n")
    good, bad, counts = quarantine.read_points(spark, str(tmp_path / "*.csv"))
    assert sorted((r.adm_id, r.latitude, r.file) for r in good.collect()) == [("A1", 1.0, "a.csv"), ("A1", 10.5, "a.csv"), ("B2", 0.0, "b.csv")]
    assert {(r.adm_id, tuple(r.reasons)) for r in bad.collect()} == {("A2", ("latitude",)), (" ", ("no id", "longitude")), ("A3", ("malformed",)), ("B1", ("malformed",)), ("A4", ("latitude",))}
    assert {r.corrupt_ for r in bad.where("array_contains(reasons, 'malformed')").collect()} == {"A3,north,1", "B1,1,2,3,4"}
    assert (counts["rows"], counts["kept"], counts["rejected"], counts["malformed"], counts["latitude"]) == (8, 3, 5, 2, 2)
    assert {r.adm_id: r.latitude for r in quarantine.first_points(good, F.struct("file", -F.col("latitude"))).collect()} == {"A1": 10.5, "B2": 0.0}
    none = quarantine.split(spark.createDataFrame([], "x int"), {"positive": F.col("x") > 0})
    assert none.good.count() == none.bad.count() == 0


def test_labels_resume_and_failures(spark):
    points = spark.createDataFrame([("a", 1), ("b", 9), ("c", None), ("d", 2)], "adm_id string, code int")
    codes = spark.createDataFrame([(1, "Af"), (2, "Am")], "code int, label string")
    done = spark.createDataFrame([("d", 2, "kept")], "adm_id string, code int, label string")
    good, bad, counts = quarantine.labelled(points, codes, done)
    assert {(r.adm_id, r.label) for r in good.collect()} == {("a", "Af"), ("d", "kept")}
    assert {(r.adm_id, tuple(r.reasons)) for r in bad.collect()} == {("b", ("unknown code",)), ("c", ("no code",))} and counts["rows"] == 3
    assert quarantine.labelled(points, codes).good.count() == 2


def test_samples_on_a_calendar(spark):
    day = dt.date(2020, 2, 27)
    seasons = spark.createDataFrame([("a", 2020, day, dt.date(2020, 3, 3)), ("b", 2020, dt.date(2020, 5, 1), dt.date(2020, 5, 3)), ("c", 2020, dt.date(2020, 6, 2), dt.date(2020, 6, 1)), ("d", 2020, None, dt.date(2020, 6, 1))], "region string, year int, sos date, cutoff date")
    daily = spark.createDataFrame([("a", 2020, day + dt.timedelta(k), float(k), float(k * k)) for k in (-1, 0, 2, 3, 9)] + [("a", 2020, day, 4.0, None), ("z", 2020, day, 1.0, 1.0), ("c", 2020, day, 1.0, 1.0)], "region string, year int, day date, t double, p double")
    got = {r.region: r.series for r in assembly.samples(seasons, daily, ["t", "p"], "daily").collect()}
    assert [(s.target.day, s.mask, s.t, s.p) for s in got["a"]] == [(27, True, 2.0, 0.0), (28, False, None, None), (1, True, 3.0, 9.0), (2, False, None, None), (3, False, None, None)]
    assert [s.mask for s in got["b"]] == [False] * 3 and got["c"] is None and len(got["d"]) == 365
    weekly = assembly.samples(seasons, daily, ["t"], "weekly").where("region = 'a'").first().series
    assert [(s.target, s.mask, s.t) for s in weekly] == [(dt.date(2020, 3, 2), False, None)]
    dekad = assembly.samples(seasons, daily, ["t"], "dekad").where("region = 'a'").first().series
    assert [(s.target, s.t) for s in dekad] == [(day, np.mean([0, 2, 3, 4]))]
    plan = assembly.samples(seasons, daily, ["t"], "daily")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 0


def test_daily_places_equal_the_calendar(spark):
    seasons = spark.createDataFrame([(i, dt.date(1999 + i % 6, 1 + i % 12, 5), dt.date(2000 + i % 6, 1 + i % 12, 1)) for i in range(24)], "id int, sos date, cutoff date")
    ticks = seasons.withColumn("ticks", assembly.target_array(F.col("sos"), F.col("cutoff"), "daily"))
    rows = ticks.select("id", "ticks", F.posexplode("ticks").alias("k", "day"))
    assert rows.where(~F.coalesce(assembly.position(F.col("ticks"), F.col("day"), "daily") == F.col("k"), F.lit(False))).count() == 0


def test_statics_of_missing_rows(spark):
    s = spark.createDataFrame([("a", dt.date(2021, 4, 1), dt.date(2021, 9, 1), dt.date(2021, 8, 1)), ("b", None, None, None)], "region string, sos date, eos date, cutoff date")
    soil = spark.createDataFrame([("a", 0.2, 1.5), ("a", 0.1, None)], "region string, awc double, bulk_density double")
    place = spark.createDataFrame([("a", 10.0, 20.0)], "region string, latitude double, longitude double")
    got = {r.region: r.statics for r in assembly.statics(s, soil, place).collect()}
    assert (got["a"].awc, got["a"].bulk_density, got["a"].longitude, got["a"].season_length, got["a"].cutoff_day) == (0.1, None, 20.0, 153.0, 213.0)
    assert got["a"].sos_sin == pytest.approx(np.sin(2 * np.pi * 91 / 365)) and set(got["b"]) == {None}


def test_catalogue_prefers_in_order(spark):
    codes = ["H.2020.mze.rf", "H.1980.mze.ir", "SSP126.2020.mze.ir", "H.2020.whe.ir", "H.2020.mze.irx", "plain.2020"]
    files = spark.createDataFrame([("A", x, k) for k, x in enumerate(codes)] + [("B", "H.1980.bar.rf", 0), ("B", "H.1990.bar", 1)], "mapset string, code string, place int")
    asks = [("both", ["A"], "mze", "2020", ["ir", "rf"]), ("relaxed", ["A"], "mze", "1980", ["rf"]), ("period", ["A"], "mze", "1975", ["rf"]), ("second", ["A", "B"], "bar", "2020", []), ("none", ["A"], "rye", None, ["ir"]), ("any", ["A"], None, None, []), ("twice", ["A", "A"], "whe", None, ["zz"])]
    got = {r.id: (r.code, r.water, r.suffix) for r in catalogue.choose(spark.createDataFrame(asks, "id string, sets array<string>, crop string, period string, waters array<string>"), files, period_names={"2020": "new"}, water_names={"ir": "irrigated"}).collect()}
    assert got == {"both": ("H.2020.mze.irx", "ir", "_new_irrigated"), "relaxed": ("H.1980.mze.ir", None, ""), "period": ("H.2020.mze.rf", "rf", ""), "second": ("H.1980.bar.rf", None, "_new"), "none": (None, None, None), "any": ("H.2020.mze.rf", None, ""), "twice": ("H.2020.whe.ir", None, "")}


def _most_rows(node):
    own = node.metrics().get("numOutputRows")
    below = [_most_rows(node.children().apply(k)) for k in range(node.children().size())]
    return max([own.get().value() if own.isDefined() else 0, *below])


def test_catalogue_makes_no_pairs_of_requests_and_files(spark):
    """300 requests that differ and 400 codes that differ, in one mapset: every request gets the first of its period, and no step makes rows of all pairs."""
    files = spark.createDataFrame([("m", f"H.{2000 + k % 40}.mze.rf.{k}", 1000 - k) for k in range(400)], "mapset string, code string, place long")
    asks = spark.createDataFrame([(k, ["none", "m"], None if k % 2 else "mze", str(2000 + k % 50), [None, "ir", "rf"][k % 3 :]) for k in range(300)], "id long, sets array<string>, crop string, period string, waters array<string>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = catalogue.choose(asks, files)
        rows = {r.id: (r.code, r.water) for r in got.collect()}
        most = _most_rows(got._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    last = lambda k: 360 + k % 50 if k % 50 < 40 else 399  # noqa: E731  the first in the listing
    assert rows == {k: (f"H.{2000 + last(k) % 40}.mze.rf.{last(k)}", "rf") for k in range(300)}
    assert most < 10 * (300 + 400)


def test_catalogue_nulls_and_ties(spark):
    files = spark.createDataFrame([("m", None, 0), ("m", "H.2020.mze.ir", 4), ("m", "H.2020.mze.ir", 2), ("m", "H.1990.whe.rf", 3), (None, "H.2020.mze.rf", 1)], "mapset string, code string, place int")
    asks = [("any", ["m"], None, None, None), ("unset", None, None, None, ["rf"]), ("null set", [None], None, None, ["rf"]), ("null water", ["m", "m"], None, None, [None, "rf"]), ("empty", ["m"], "whe", "", [])]
    got = {r.id: (r.code, r.mapset, r.water, r.suffix) for r in catalogue.choose(spark.createDataFrame(asks, "id string, sets array<string>, crop string, period string, waters array<string>"), files).collect()}
    assert got == {"any": ("H.2020.mze.ir", "m", None, ""), "unset": (None,) * 4, "null set": (None,) * 4, "null water": ("H.1990.whe.rf", "m", "rf", ""), "empty": ("H.1990.whe.rf", "m", None, "")}


def test_array_quantiles(spark):
    arrays = [[3.0, 1.0, 2.0], [None, 5.0], [], None, [None], [float("nan"), 1.0, 9.0], [7.0] * 4]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<double>")
    levels = [0.0, 0.1, 0.5, 1.0]
    for r in df.select("i", F.array(*c.array_quantiles(F.col("a"), levels)).alias("q")).collect():
        v = [x for x in arrays[r.i] or [] if x is not None and x == x]
        assert r.q == (pytest.approx(np.quantile(v, levels)) if v else [None] * 4)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run_batches(spark, tmp_path, build, batches, name, mode="append"):
    """One file a batch, one micro-batch after the other."""
    folder, schema = tmp_path / name, "user_id int, ts timestamp, value double"
    at = lambda t: dt.datetime.fromisoformat(f"2024-01-01T{t}:00+00:00")
    spark.createDataFrame([], schema).write.parquet(str(folder))
    stream = build(events.with_event_time(spark.readStream.schema(schema).parquet(str(folder)), delay="10 minutes"))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-check")).start()
    for rows in batches:
        spark.createDataFrame([(u, at(t), float(v)) for u, t, v in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))
        q.processAllAvailable()
    late = events.late_rows(q)
    q.stop()
    return spark.table(name).collect(), late


BATCHES = [[(1, "10:00", 1), (1, "10:20", 2), (2, "10:25", 3)], [(2, "11:30", 4)], [(1, "10:10", 100), (2, "11:25", 5), (3, "11:40", 6)], [(9, "15:00", 0)], [(9, "15:01", 0)]]


def test_a_late_row_is_dropped_and_one_in_time_is_not(spark, tmp_path):
    rows, late = run_batches(spark, tmp_path, lambda e: events.window_counts(e, width="1 hour", slide="30 minutes"), BATCHES, "sliding")
    got = {r.start.strftime("%H:%M"): (r.n, r.total) for r in rows}
    assert late == 2  # one row in two windows
    assert got == {"09:30": (3, 6.0), "10:00": (3, 6.0), "10:30": (1, 5.0), "11:00": (3, 15.0), "11:30": (2, 10.0)}


def test_spells_end_by_timer(rocks, tmp_path):
    rows, late = run_batches(rocks, tmp_path, events.spells, BATCHES, "spells")
    got = sorted((r.user_id, r.start.strftime("%H:%M"), r.end.strftime("%H:%M"), r.n, r.total) for r in rows)
    assert got == [(1, "10:00", "10:20", 2, 3.0), (2, "10:25", "10:25", 1, 3.0), (2, "11:25", "11:30", 2, 9.0), (3, "11:40", "11:40", 1, 6.0)]
    assert late >= 1
