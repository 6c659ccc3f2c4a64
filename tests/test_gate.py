"""Checked writes, stored profiles, the keyed table's writers, and running sums over windows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import gate, lake, learning, profiles, validation

DAY = dt.date(2020, 1, 1)
ROW = "ticker string, date date, x double, y long, note string"


def frame(spark):
    rows = [("A", DAY + dt.timedelta(i), float(i), i % 3, "n") for i in range(20)]
    rows += [("A", DAY, 500.0, 1, None), ("B", DAY, None, 2, None), ("C", DAY, -1.0, None, None)]
    return spark.createDataFrame(rows, ROW)


def test_checks_ride_on_one_write(spark, tmp_path):
    checks = gate.Checks(rules={"x_known": "x is not null"}, bounds={"x": (0, 100)}, unique=("ticker", "date"), required=("x", "gone"), types={"y": "bigint", "x": "int"})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("gate", "gate")
    out = gate.checked_write(frame(spark), f"file://{tmp_path}/w", checks)
    jobs = len(tracker.getJobIdsForGroup("gate"))
    spark.sparkContext.setJobGroup("rest", "rest")
    report = {(r.check, r.column): (r.n, r.ok) for r in out.report.collect()}
    assert not out.success and report["rows", None] == (23, True)
    assert report["x_known", None] == (1, False) and report["x_in_range", None] == (2, False) and report["unique_key", None] == (2, False)
    assert report["has", "gone"] == (1, False) and report["has", "x"] == (0, True) and report["type", "x"] == (1, False) and report["type", "y"] == (0, True)
    assert report["nulls", "note"] == (3, True) and report["incomplete", None] == (3, True) and report["broken", None] == (4, False)
    broken = {(r.ticker, r.x): sorted(r.broken) for r in out.broken.collect()}
    assert broken == {("A", 500.0): ["unique_key", "x_in_range"], ("A", 0.0): ["unique_key"], ("B", None): ["x_known"], ("C", -1.0): ["x_in_range"]}
    assert out.sound.count() == 19 and out.sound.columns == frame(spark).columns
    p = {r.column: r for r in out.profile.collect()}
    assert (p["x"].n, p["x"].min, p["x"].max, p["x"].mean) == (19, 1.0, 19.0, 10.0)
    assert jobs <= 3  # one write with its shuffle by key, in adaptive steps; no scan for the checks


def test_sound_rows_pass_and_drift_is_told(spark, tmp_path):
    rows = frame(spark).where("note is not null")
    first = gate.checked_write(rows, f"file://{tmp_path}/a", gate.Checks(required=("x",), optional=("note",)))
    assert first.success and first.broken.count() == 0
    moved = gate.checked_write(rows.withColumn("x", F.col("x") * 2), f"file://{tmp_path}/b", gate.Checks(), baseline=first.profile)
    told = {r.column for r in moved.report.where("check = 'drift'").collect()}
    assert moved.success and told == {"x.mean", "x.std", "x.max"}
    empty = gate.checked_write(rows.limit(0), f"file://{tmp_path}/c", gate.Checks(rules={"r": "x > 0"}))
    assert not empty.success and empty.report.where("not ok").first().check == "rows"


def test_row_bounds_and_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("A", DAY, 1.0, 50.0, 0.1, 5.0), ("A", None, 1.0, 101.0, None, -1.0)], "ticker string, date date, close double, rsi_14 double, macd double, volume double")
    failed = {r.rule: r.failed for r in validation.violations(rows, validation.FEATURE_BOUNDS).collect()}
    assert failed == {"key_known": 1, "close_known": 0, "macd_known": 1, "rsi_inside": 1, "volume_not_negative": 1}
    asked = spark.createDataFrame([("A", DAY, "up", 1.0, "v"), ("A", DAY, "on", 1.1, None)], "ticker string, date date, direction string, probability double, model_version string")
    failed = {r.rule: r.failed for r in validation.violations(asked, validation.PREDICTION_BOUNDS).collect()}
    assert failed == {"key_known": 0, "direction_known": 1, "probability_inside": 1, "version_known": 1}
    assert set(validation.BAR_BOUNDS) == {"key_known", "open_positive", "high_positive", "low_positive", "close_positive", "volume_not_negative"}
    rejected = validation.rejected(rows, validation.FEATURE_BOUNDS).first()
    assert rejected.broken == ["key_known", "macd_known", "rsi_inside", "volume_not_negative"]
    shares = {r.column: r.share for r in validation.null_shares(rows).collect()}
    assert shares["macd"] == 0.5 and validation.all_null_rows_dropped(rows, ["date", "macd"]).count() == 1
    path = f"file://{tmp_path}/p"
    assert not gate.partition_sound(spark, path, "2020-01-01", ["close"])
    rows.where("date is not null").withColumn("none", F.lit(None).cast("int")).write.partitionBy("date").parquet(path)
    sound = lambda day, *c: gate.partition_sound(spark, path, day, list(c))
    assert sound("2020-01-01", "close") and not sound("2020-01-02", "close") and not sound("2020-01-01", "none") and not sound("2020-01-01", "gone")


def test_profiles_merge_over_any_days(spark, tmp_path):
    rng = random.Random(4)
    rows = [(DAY + dt.timedelta(rng.randrange(400)), rng.gauss(1e6, 3), float(rng.randrange(3000)) if rng.random() > 0.1 else None) for _ in range(30_000)]
    data = spark.createDataFrame(rows, "date date, a double, b double")
    folder = f"file://{tmp_path}/p"
    profiles.store(profiles.daily(data.where("date < DATE '2020-06-01'"), ["a", "b"]), folder)
    profiles.store(profiles.daily(data.withColumn("b", F.col("b") + F.when(F.col("date") < "2020-06-01", 1e9).otherwise(0)), ["a", "b"]), folder)
    assert profiles.stored(spark, folder).select("date", "column").distinct().count() == profiles.stored(spark, folder).count() == 800
    some = data.where("date between DATE '2020-03-01' and DATE '2020-12-31'")
    exact = {r.column: r for r in validation.profile(some, ["a", "b"]).collect()}
    merged = profiles.merged(profiles.stored(spark, folder, "2020-03-01", "2020-12-31"))
    quantiles = {c: some.approxQuantile(c, list(profiles.QUANTILES), 0.0) for c in ("a", "b")}
    for r in merged.collect():
        e = exact[r.column]
        assert (r.n, r.nulls, r.min, r.max) == (e.n, e.nulls, e.min, e.max)
        assert r.mean == pytest.approx(e.mean, rel=1e-12) and r.std == pytest.approx(e.std, rel=1e-9)
        assert abs(r.n_unique - e.n_unique) <= 0.05 * e.n_unique  # three times the sketch's error
        values = sorted(x[0] for x in some.select(r.column).dropna().collect())
        for q in profiles.QUANTILES:
            at = sum(v <= r[f"q_{round(q * 100)}"] for v in values) / len(values)
            assert abs(at - q) <= 0.015, (r.column, q, at, quantiles)
    path = f"file://{tmp_path}/json"
    profiles.write_json(merged, path)
    names = [c for c in merged.columns if not c.startswith("q_")]  # quantiles of one sketch differ from run to run within its error
    assert sorted(map(str, profiles.read_json(spark, path).select(names).collect())) == sorted(map(str, merged.select(names).collect()))
    moved = profiles.drift(spark, folder, ("2020-01-01", "2020-05-31"), ("2020-06-01", None)).where("drifted").collect()
    assert all(r.column == "b" and r.statistic in ("min", "std", "mean", "max") for r in moved)


def test_a_second_writer_keeps_the_first_ones_rows(spark, tmp_path):
    t = lake.LakeTable(spark, f"file://{tmp_path}/t", ["k", "p"], "p")
    of = lambda *rows: spark.createDataFrame(list(rows), "k int, p string, x int")
    t.upsert(of((1, "a", 1)))
    commit, late = t._commit, lake.LakeTable(spark, f"file://{tmp_path}/t", ["k", "p"], "p")
    raced = []

    def slow(*args, **kwargs):
        if not raced:
            raced.append(late.upsert(of((2, "a", 2))))  # another writer commits between this one's read and its commit
        return commit(*args, **kwargs)

    t._commit = slow
    assert t.upsert(of((3, "a", 3))) == 2 and raced == [1]
    assert {(r.k, r.x) for r in t.read().collect()} == {(1, 1), (2, 2), (3, 3)}
    t.ATTEMPTS, raced[:] = 1, []
    with pytest.raises(lake.Conflict):
        t.upsert(of((4, "a", 4)))


def test_reads_list_the_live_folders_only(spark, tmp_path):
    t = lake.LakeTable(spark, f"file://{tmp_path}/t", ["k", "p"], "p")
    for i in range(4):
        t.upsert(spark.createDataFrame([(i, "a", i), (i, "b" if i < 2 else "a", i)], "k int, p string, x int"))
    files = [r[0] for r in t.read().select(F.input_file_name()).collect()]
    assert {f.split("/data/")[1].rsplit("/", 1)[0] for f in files} == {"v=3/p=a", "v=1/p=b"}
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    at = plan.index("PartitionFilters: [")
    assert "v#" in plan[at : at + 200] and "Filter " not in plan.replace("PartitionFilters", "").replace("PushedFilters", "").replace("DataFilters", "")


def test_repeated_source_keys_settle(spark, tmp_path):
    t = lake.LakeTable(spark, f"file://{tmp_path}/t", ["k", "p"], "p")
    rows = spark.createDataFrame([(1, "a", 5, 1), (1, "a", 3, 2), (1, "a", None, 9)], "k int, p string, x int, at int")
    t.upsert(rows)
    assert t.read().first().x == 5
    t.upsert(rows, order=["at"])
    assert t.read().first().at == 9


def test_schema_union_on_migration(spark, tmp_path):
    path = f"{tmp_path}/plain"
    spark.createDataFrame([(1, "a")], "k int, p string").write.parquet(f"file://{path}/one")
    spark.createDataFrame([(2, "b", 0.5)], "k int, p string, y double").write.parquet(f"file://{path}/two")
    t = lake.migrate(spark, f"file://{path}/*", f"file://{tmp_path}/t", ["k", "p"], "p")
    assert {(r.k, r.y) for r in t.read().collect()} == {(1, None), (2, 0.5)}


def test_windows_share_places_by_running_sums(spark):
    rng = random.Random(9)
    rows = [(f"T{i % 2}", i, a := rng.randrange(60), a + rng.randrange(-2, 25)) for i in range(120)] + [("T0", 200, 5, 30_000)]
    windows = spark.createDataFrame(rows, "ticker string, id int, start_idx int, end_idx int")
    cover = {t: [0] * 30_001 for t in ("T0", "T1")}
    for t, _, a, b in rows:
        for i in range(a, b + 1):
            cover[t][i] += 1
    got = {r.id: r.uniqueness for r in learning.uniqueness(windows).collect()}
    for t, i, a, b in rows:
        assert got[i] == pytest.approx(sum(1 / cover[t][k] for k in range(a, b + 1)) / (b - a + 1) if b >= a else 0.0)
    shared = {r.id: r.n_overlapping for r in learning.overlapping(windows).collect()}
    for t, i, a, b in rows:
        want = sum(u == t and c <= b and a <= d and c <= d for u, _, c, d in rows) if a <= b else 1
        assert shared[i] == want


def test_a_stream_merges_its_batches(spark, tmp_path):
    from barloom.streaming import events

    t = lake.LakeTable(spark, f"file://{tmp_path}/t", ["k", "p"], "p")
    for i in range(3):
        spark.createDataFrame([(i, "a", i), (9, "a", i)], "k int, p string, x int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = events.stream_upsert(spark.readStream.schema("k int, p string, x int").parquet(f"{tmp_path}/in"), t, f"{tmp_path}/check")
        query.processAllAvailable()
        query.stop()
    assert {(r.k, r.x) for r in t.read().collect()} == {(0, 0), (1, 1), (2, 2), (9, 2)} and t.version() == 2


def test_silver_rows_are_filled_and_merged(spark, tmp_path):
    from barloom.operators import writing

    t = lake.LakeTable(spark, f"file://{tmp_path}/t", ["article_id", "day"], "day")
    schema = "article_id string, day string, score double, note string"
    first = spark.createDataFrame([("a", "1", "0.5", 7), ("b", "1", "x", 8), (None, "1", "1", 9)], "article_id string, day string, score string, more int")
    first = first.withColumn("score", F.col("score").try_cast("double"))
    assert writing.write_silver(t, first, schema) == 0 and writing.write_silver(t, first.limit(0), schema) is None
    writing.write_silver(t, spark.createDataFrame([("a", "1", 0.9, "n")], schema), schema)
    assert {(r.article_id, r.score, r.note) for r in t.read().collect()} == {("a", 0.9, "n"), ("b", None, None)}
    assert set(t.read().columns) == {"article_id", "day", "score", "note"}
