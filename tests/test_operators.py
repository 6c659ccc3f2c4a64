"""Hand-sized cases: formulas, guards, no look into the future, idempotent upserts."""

import datetime as dt
import math
import uuid

import pytest
from pyspark.sql import functions as F

from barloom.functions import ewm, indicators
from barloom.operators import calendar, columns, lake, learning, loading, predictions, series, texts, trading, validation, walkforward, writing
from barloom.streaming import events

DAY = dt.date(2024, 1, 1)
BAR = "ticker string, date date, open double, high double, low double, close double, volume double"


def bars(spark, closes, ticker="A", volume=1000.0):
    rows = [(ticker, DAY + dt.timedelta(i), c, c + 1, c - 1, c, volume) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, BAR)


def column(frame, name, by="date"):
    return [r[name] for r in frame.orderBy(by).select(by, name).collect()]


def test_next_day_return_and_guards(spark):
    got = column(indicators.target(bars(spark, [100, 110, 105])), "next_day_return")
    assert got[0] == pytest.approx(0.1) and got[1] == pytest.approx(-5 / 110) and got[2] is None
    assert column(indicators.returns(bars(spark, [0, 5])), "return_1d") == [None, None]
    flat = indicators.bollinger(bars(spark, [5] * 25))
    assert set(column(flat, "bb_pct")) == {None} and column(flat, "bb_middle")[18] is None
    assert set(column(indicators.volumes(bars(spark, [5] * 25, volume=0.0)), "volume_ratio")) == {None}
    assert column(indicators.calendar(bars(spark, range(1, 6))), "trading_day_of_month") == [1, 2, 3, 4, 5]


def test_indicators_do_not_see_later_bars(spark):
    closes = [100 + 7 * math.sin(i) + i for i in range(70)]
    whole, part = (ewm.features(bars(spark, closes[:n])).drop("next_day_return") for n in (70, 65))
    cut = DAY + dt.timedelta(64)
    assert sorted(map(str, whole.where(F.col("date") <= F.lit(cut)).collect())) == sorted(map(str, part.collect()))


def test_rsi_needs_losses(spark):
    assert column(ewm.momentum(bars(spark, range(100, 130))), "rsi_14").count(None) + sum(
        x is not None and math.isnan(x) for x in column(ewm.momentum(bars(spark, range(100, 130))), "rsi_14")
    ) == 30


def test_asof_takes_the_same_day_and_never_a_later_one(spark):
    left = bars(spark, [1, 2, 3, 4]).select("ticker", "date")
    right = spark.createDataFrame(
        [("A", DAY + dt.timedelta(1), "x", None), ("A", DAY + dt.timedelta(3), "y", 2), ("B", DAY, "z", 3)],
        "ticker string, date date, v string, w int",
    )
    got = series.asof(left, right, "ticker", "date", ["v", "w"])
    assert [(r.v, r.w) for r in got.orderBy("date").collect()] == [(None, None), ("x", None), ("x", None), ("y", 2)]


def test_gaps(spark):
    days = [dt.date(2024, 1, d) for d in (2, 3, 5, 12)]
    got = series.missing_dates(spark.createDataFrame([("A", d) for d in days], "ticker string, date date"))
    assert [r.missing_date.day for r in got.orderBy("missing_date").collect()] == [4, 8, 9, 10, 11]
    runs = series.missing_ranges(got).orderBy("start_date").collect()
    assert [(r.start_date.day, r.end_date.day, r.n_days) for r in runs] == [(4, 4, 1), (8, 11, 4)]


def test_validation(spark):
    bad = bars(spark, [10, -5]).unionByName(bars(spark, [10]))
    failed = {r.rule: r.failed for r in validation.violations(bad, validation.PRICE_RULES, ["ticker", "date"]).collect()}
    assert failed["close_positive"] == 1 and failed["unique_key"] == 2
    with pytest.raises(validation.ValidationError):
        validation.require(bad, validation.PRICE_RULES)
    assert validation.require(bars(spark, [10]), validation.PRICE_RULES, ["ticker", "date"]).count() == 1
    twice = validation.profile(bars(spark, [20, 40]), ["close"])
    drifted = validation.drift(twice, validation.profile(bars(spark, [10, 20]), ["close"]))
    assert {r.statistic for r in drifted.where("drifted").collect()} == {"mean", "std", "min", "max"}


def test_labels_and_weights(spark):
    flat = bars(spark, [100] * 4).withColumns({"high": F.lit(100.0), "low": F.lit(100.0), "vol": F.lit(0.0)})
    up = flat.withColumn("high", F.when(F.dayofmonth("date") == 3, 101.0).otherwise(F.col("high")))
    got = learning.triple_barrier(up, "vol", horizon=2).orderBy("date").collect()
    assert [r.barrier_outcome for r in got] == ["profit", "profit", "time_loss", "none"]
    assert got[0].upper_barrier_return == pytest.approx(0.0075) and got[0].lower_barrier_return == pytest.approx(0.005)
    windows = [("A", 0, 0, 5), ("A", 1, 10, 15), ("B", 2, 0, 5), ("B", 3, 1, 6), ("B", 4, 2, -1)]
    weights = learning.uniqueness(spark.createDataFrame(windows, "ticker string, id long, start_idx long, end_idx long"))
    w = {r.id: r.uniqueness for r in weights.collect()}
    assert w[0] == w[1] == 1 and 0 < w[2] < 1 and w[4] == 0
    splits = spark.range(1).select(F.explode(learning.walk_forward(100, 30, 10, 3, 5)).alias("s")).select("s.*").collect()
    assert splits[0][:] == (0, 26, 30, 40) and splits[1].train_start == 13


def test_backtest_by_hand(spark):
    frame = bars(spark, [100, 110, 121]).withColumn("weight", F.lit(1.0))
    curve = trading.equity_curve(frame, fee=0, tax=0).orderBy("date").collect()
    assert [round(r.value, 6) for r in curve] == [1.0, 1.1, 1.21]
    cost = trading.equity_curve(frame, fee=0.01, tax=0).orderBy("date").collect()
    assert cost[0].ret == pytest.approx(-0.01)
    trade = trading.trades(frame).collect()
    assert [(r.n_bars, round(r.trade_return, 6)) for r in trade] == [(3, 0.21)]


def test_upsert_versions_and_vacuum(spark, tmp_path):
    t = lake.LakeTable(spark, f"file://{tmp_path}/t", ["ticker", "date"])
    rows = bars(spark, [1, 2, 3]).select("ticker", "date", "close")
    t.upsert(rows)
    t.upsert(rows.where("close = 2").withColumn("close", F.lit(20.0)))
    again = t.upsert(rows.where("close = 2").withColumn("close", F.lit(20.0)).withColumn("note", F.lit("n")))
    assert sorted(r.close for r in t.read().collect()) == [1, 3, 20]
    assert sorted(r.close for r in t.read(0).collect()) == [1, 2, 3] and again == 2
    assert {r.note for r in t.read().collect()} == {None, "n"}
    t.compact()
    assert t.vacuum() == ["v=0", "v=1", "v=2"] and t.vacuum(dry_run=False) and t.read().count() == 3


def test_texts(spark):
    row = spark.range(1).select(
        texts.strip_html(F.lit("<p>a <b>b</b>\n c</p>")).alias("s"), texts.unescape(F.lit("&lt;a&gt; &amp;amp;")).alias("u")
    ).first()
    assert (row.s, row.u) == ("a b c", "<a> &amp;")


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = events.stream(spark, f"{tmp_path}/in", source.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), "weekly_test")
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.table("weekly_test").collect())) == sorted(map(str, events.weekly(source).collect()))


def test_lake_table_keeps_null_partitions_and_one_row_a_key(spark, tmp_path):
    t = lake.LakeTable(spark, f"file://{tmp_path}/t", ["k", "p"], "p")
    schema = "k int, p string, x int"
    t.upsert(spark.createDataFrame([(1, "a", 1), (2, None, 2), (None, None, 3)], schema))
    t.upsert(spark.createDataFrame([(2, None, 20), (2, None, 20), (None, None, 30), (3, "b", 4), (3, "b", 4)], schema), spread=2)
    got = {(r.k, r.p, r.x) for r in t.read().collect()}
    assert got == {(1, "a", 1), (2, None, 20), (None, None, 30), (3, "b", 4)} and t.read().count() == 4
    assert {(r.k, r.x) for r in t.read(0).collect()} == {(1, 1), (2, 2), (None, 3)}
    for i in range(3):
        t.upsert(spark.createDataFrame([(9, "a", i, "new")], f"{schema}, y string"))
    plan = t.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 2  # one scan and the manifest, however many upserts
    assert {(r.k, r.x, r.y) for r in t.read().where("p = 'a'").collect()} == {(1, 1, None), (9, 2, "new")}
    t.compact()
    assert t.vacuum(dry_run=False) and t.read().count() == 5


def test_market_queries_push_the_date_to_one_scan(spark):
    from barloom.operators import market
    from barloom.sources.bars import bars

    plan = market.top_volume(bars(spark, "/root/testdata/sf0.001", 700))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem") <= 2 and "GreaterThanOrEqual(l_shipdate" in plan
    assert "NestedLoop" not in plan


def test_validation_columns_and_empty_views(spark):
    from barloom.operators import columns, loading

    frame = spark.createDataFrame([(1, None, None), (2, "x", None)], "a int, b string, c string")
    assert validation.missing_columns(frame, ["a", "z"]) == ["z"]
    found = {r.column: r.status for r in validation.column_status(frame, optional=("c",)).collect()}
    assert found == {"a": "ok", "b": "ok", "c": "ok"}
    assert {r.column: r.status for r in validation.column_status(frame).collect()}["c"] == "empty"
    empty = loading.unified_view(spark, {"US": None})
    assert empty.count() == 0 and empty.columns[:3] == ["market", "ticker", "date"]
    texts = spark.createDataFrame([("Tue, 05 Mar 2024 10:20:30 GMT",), ("2024-03-05T10:20:30.123Z",), ("03/05/2024",), ("no",)], "t string")
    days = [str(r[0])[:10] for r in texts.select(columns.any_timestamp(texts.t)).collect()]
    assert days == ["2024-03-05"] * 3 + ["None"]
    assert texts.limit(1).select(columns.one_line(F.lit(" a\n\n b\tc "))).first()[0] == "a b c"


def _weighted(spark, closes, weights=None):
    rows = [("A", f"2024-01-{i + 1:02d}", float(c), 1.0 if weights is None else float(weights[i])) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date string, close double, weight double").withColumn("date", F.col("date").cast("date"))


def _weights(frame):
    return [r.weight for r in frame.orderBy("date").collect()]


def test_stops_leave_a_run_and_wait_for_the_next(spark):
    closes, on = [10, 9.5, 8.9, 12.1, 12, 10, 12.5, 13], [1, 1, 1, 1, 0, 1, 1, 1]
    assert _weights(trading.stopped(_weighted(spark, closes, on), stop_loss=0.1)) == [1, 1, 0, 0, 0, 1, 1, 1]
    assert _weights(trading.stopped(_weighted(spark, closes, on), take_profit=0.2)) == [1, 1, 1, 0, 0, 1, 0, 0]
    assert _weights(trading.stopped(_weighted(spark, closes, on))) == on
    short = [-w for w in on]
    assert _weights(trading.stopped(_weighted(spark, closes, short), stop_loss=0.1)) == [-1, -1, -1, 0, 0, -1, 0, 0]
    assert trading.stopped(_weighted(spark, []), 0.1).count() == 0


def test_resampled_weights_change_at_the_ends_of_weeks(spark):
    # 2024-01-01 is a Monday: weeks end at rows 6 and 13 and with the last row
    on = [1, 0, 1, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert _weights(trading.resampled(_weighted(spark, range(1, 16), on), "week")) == [0] * 6 + [1] * 7 + [0] + [1]


def test_grid_puts_the_best_strategy_first(spark):
    class Always(trading.Strategy):
        def __init__(self, w):
            self.w = w

        def weights(self, bars):
            return bars.withColumn("weight", F.lit(self.w))

    found = trading.grid(_weighted(spark, [10, 11, 11.5, 13, 13.1]).drop("weight"), {"none": Always(0.0), "long": Always(1.0), "short": Always(-1.0)})
    rows = found.orderBy("place").collect()
    assert [r.strategy for r in rows] == ["long", "short", "none"]  # never traded: no Sharpe ratio, so last
    assert abs(rows[0].total_return - (13.1 / 10 * (1 - trading.FEE) - 1)) < 1e-3


def _planted(spark, days=60):
    """Two tickers whose label follows from x; the label of each row is settled two days later."""
    rows = [
        (t, DAY + dt.timedelta(i), float((i * 7 + k) % 10), int((i * 7 + k) % 10 >= 5), DAY + dt.timedelta(i + 2))
        for i in range(days) for k, t in enumerate("AB")
    ]
    return spark.createDataFrame(rows, "ticker string, date date, x double, y int, settled date")


def test_walk_forward_learns_a_planted_rule_from_the_past(spark):
    numbered = walkforward.by_date(_planted(spark))
    folds = walkforward.purged_folds(numbered, train=20, test=10, embargo=5, horizon=5)
    assert folds == [(0, 16, 20, 30), (15, 31, 35, 45), (30, 46, 50, 60)]
    answers = walkforward.predicted(numbered, ["x"], "y", folds, "settled", depth=1, rounds=1).cache()
    assert answers.count() == 2 * 30
    assert all(r.actual == r.prediction for r in answers.collect())
    row = walkforward.summary(walkforward.fold_metrics(answers)).first()
    assert (row.folds, row.mean_accuracy, row.std_accuracy, row.mean_precision, row.mean_recall) == (3, 1.0, 0.0, 1.0, 1.0)
    grid = walkforward.grid_search(numbered, ["x"], "y", folds[:1], {"depth": [1], "rounds": [1, 2]}).collect()
    assert sorted((r.params, r.mean_accuracy) for r in grid) == [("depth=1, rounds=1", 1.0), ("depth=1, rounds=2", 1.0)]


def test_retraining_covers_every_later_date_once(spark):
    numbered = walkforward.by_date(_planted(spark, 50))
    assert walkforward.retraining_folds(numbered, train=20, every=12) == [(0, 20, 20, 32), (12, 32, 32, 44), (24, 44, 44, 50)]
    answers = walkforward.predicted(numbered, ["x"], "y", walkforward.retraining_folds(numbered, 20, 12), depth=1, rounds=1)
    assert sorted((r.ticker, r.date) for r in answers.collect()) == [(t, DAY + dt.timedelta(i)) for t in "AB" for i in range(20, 50)]


def test_labels_settled_after_the_fold_opens_are_not_trained_on(spark):
    late = _planted(spark, 40).withColumn("settled", F.lit(DAY + dt.timedelta(99)))
    numbered = walkforward.by_date(late)
    assert walkforward.predicted(numbered, ["x"], "y", [(0, 20, 20, 30)], "settled", depth=1, rounds=1).count() == 0


def test_folds_of_an_empty_frame(spark):
    numbered = walkforward.by_date(_planted(spark, 0))
    assert walkforward.purged_folds(numbered) == [] and walkforward.retraining_folds(numbered) == []
    row = walkforward.summary(walkforward.fold_metrics(walkforward.predicted(numbered, ["x"], "y", []))).first()
    assert (row.folds, row.mean_accuracy) == (0, 0.0)


def test_importances_name_the_planted_feature(spark):
    frame = _planted(spark).withColumn("noise", F.lit(1.0))
    model = learning.train_classifier(frame, ["noise", "x"], "y", depth=1, rounds=1)
    assert [(r.place, r.feature) for r in walkforward.importances(model, ["noise", "x"], k=1).collect()] == [(1, "x")]


def test_overlaps_equal_brute_force(spark):
    spans = [(k, s, s + n) for k, (s, n) in enumerate([(0, 4), (0, 4), (2, 0), (4, 3), (5, -1), (7, 9), (30, 1)])]
    frame = spark.createDataFrame([("A", *s) for s in spans] + [("B", *s) for s in spans], "ticker string, id int, start_idx int, end_idx int")
    wanted = {(t, a[0], b[0]) for t in "AB" for a in spans for b in spans if a[0] == b[0] or a[1] <= b[2] and b[1] <= a[2] and a[1] <= a[2] and b[1] <= b[2]}
    rows = learning.overlaps(frame).collect()
    found = {(r.ticker, r.id, r.other) for r in rows}
    assert len(found) == len(rows) and found | {(t, b, a) for t, a, b in found} == wanted


def test_predictions_that_break_a_rule_are_not_stored(spark, tmp_path):
    table = lake.LakeTable(spark, f"file://{tmp_path}/p", ["ticker", "date"])
    good = spark.createDataFrame([("A", DAY, 0.7, "up")], "ticker string, date date, probability double, direction string")
    assert predictions.store(table, good) == 0
    for bad in (good.withColumn("probability", F.lit(1.0)), good.withColumn("direction", F.lit("flat")), good.unionAll(good)):
        with pytest.raises(validation.ValidationError):
            predictions.store(table, bad)
    assert table.version() == 0


def test_sessions_leave_out_weekends_and_holidays(spark):
    market = spark.createDataFrame([("us", DAY, DAY + dt.timedelta(8))], "market string, a date, b date")
    off = spark.createDataFrame([("us", DAY), ("us", DAY), ("jp", DAY + dt.timedelta(1))], "market string, date date")
    days = calendar.sessions(market, F.col("a"), F.col("b"), off).cache()  # 2024-01-01 is a Monday
    assert days.count() == 9
    assert [r.date.day for r in days.where("is_session").orderBy("date").collect()] == [2, 3, 4, 5, 8, 9]
    assert calendar.between(days, "2024-01-03", "2024-01-08").first().sessions == 4
    assert calendar.last_session(days, "2024-01-07").first().last_session == dt.date(2024, 1, 5)
    assert calendar.last_session(days, "2024-01-01").first().last_session is None
    after = {r.date.day: r.next_session and r.next_session.day for r in calendar.next_session(days).collect()}
    assert after == {1: 2, 2: 3, 3: 4, 4: 5, 5: 8, 6: 8, 7: 8, 8: 9, 9: None}
    b = spark.createDataFrame([("us", "A", dt.date(2024, 1, d)) for d in (2, 4, 5)], "market string, ticker string, date date")
    assert sorted(r.date.day for r in calendar.missing_sessions(b, days).collect()) == [3, 8, 9]
    row = calendar.session_age(b, days, "2024-01-08").first()
    assert (row.last_session.day, row.sessions_behind) == (8, 1)
    assert calendar.session_age(b.limit(0), days, "2024-01-08").first().sessions_behind == 5


def test_name_uuid_is_version_five(spark):
    names = ["", "a", "https://news.example/1", "été"] + [f"transcript_{i}" for i in range(40)]
    frame = spark.createDataFrame([(n,) for n in [*names, None]], "n string")
    found = {r.n: r.u for r in frame.select("n", columns.name_uuid(F.col("n")).alias("u")).collect()}
    for n in names:
        assert found[n] == str(uuid.uuid5(uuid.NAMESPACE_URL, n))


def test_transcripts_keep_order_and_distinct_speakers(spark):
    rows = [(1, 2, "B", "two"), (1, 1, "A", "one"), (1, 3, "A", None), (1, 4, "", "four"), (2, 1, "A", " "), (None, 1, "A", "x")]
    out = columns.transcripts(spark.createDataFrame(rows, "k int, o int, s string, t string"), "k", "o", "s", "t").collect()
    assert [(r.k, r.body, r.participants) for r in out] == [(1, "one\n\ntwo\n\nfour", ["A", "B"])]


def test_frame_hash_forgets_order_but_not_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, s string")
    h = lambda f: columns.frame_hash(f).first().hash
    assert h(a) == h(a.orderBy(F.desc("k"))) == h(a.select("s", "k")) and len(h(a)) == 12
    assert len({h(a), h(a.unionAll(a)), h(a.limit(0)), h(a.fillna("y"))}) == 4


def test_gates_refuse_what_may_not_be_written(spark, tmp_path):
    good = spark.createDataFrame([("A", DAY, 1.0), ("B", DAY, 2.0)], "ticker string, date date, close double")
    t = lake.LakeTable(spark, f"file://{tmp_path}/t", writing.keys_of("bronze/us"))
    gate = lambda f, **k: writing.gated_upsert(t, f, ["ticker", "close"], {"positive": "close > 0"}, ["ticker", "date"], **k)
    assert gate(good, dry_run=True) and t.version() is None
    bad = [good.limit(0), good.drop("close"), good.withColumn("close", F.lit(None).cast("double")), good.withColumn("close", -F.col("close")), good.unionAll(good)]
    assert not any(gate(f) for f in bad) and t.version() is None
    assert gate(good) and t.read().count() == 2
    assert writing.refusals(good.drop("close"), ["close"]) == ["missing column close"]
    assert writing.keys_of("02_silver/news_sentiment") == ["url"] and writing.keys_of("us") == ["ticker", "date"]


def test_new_dates_are_added_and_old_ones_stay(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    rows = spark.createDataFrame([(DAY, 1), (DAY + dt.timedelta(1), 2)], "date date, x int")
    assert writing.write_new_dates(spark, rows.limit(1), path) == 1
    assert writing.write_new_dates(spark, rows.withColumn("x", F.col("x") * 10), path) == 1
    assert writing.write_new_dates(spark, rows, path) == 0
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 20]


def test_typed_columns_and_metadata(spark):
    frame = spark.createDataFrame([("A", "3", 0.5, None)], "Ticker string, n string, score double, note string")
    out = writing.typed(frame, "ticker string, n int, gone date")
    assert out.dtypes == [("ticker", "string"), ("n", "int"), ("gone", "date")] and tuple(out.first()) == ("A", 3, None)
    assert writing.lower_names(frame).columns == ["ticker", "n", "score", "note"]
    assert writing.with_metadata(frame, ["Ticker"]).first().metadata == {"n": "3", "score": "0.5"}
    assert writing.with_metadata(frame.select("n"), ["n"]).first().metadata == {}


def test_synthetic_bars_are_sound_and_repeatable(spark):
    made = loading.synthetic_bars(spark, 3, 400).cache()
    again = loading.synthetic_bars(spark, 3, 400).repartition(5)
    assert made.exceptAll(again).count() == 0 and made.select("ticker", "date").distinct().count() == made.count()
    assert all(r.failed == 0 for r in validation.violations(made, validation.PRICE_RULES, ["ticker", "date"]).collect())
    assert made.where("weekday(date) >= 5").count() == 0 and made.groupBy("ticker").count().count() == 3
    steps = made.select(F.log(F.col("close") / F.col("open")).alias("s")).agg(F.stddev("s").alias("sd")).first().sd
    assert 0.013 < steps < 0.017
