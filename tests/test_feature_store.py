"""Decayed means, the feature graph and the stored features, against pandas and full runs."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import ewm
from barloom.functions.graph import Graph, Step, family
from barloom.operators import enrich, feature_store

DAY = dt.date(2020, 1, 1)
BAR = "ticker string, date date, open double, high double, low double, close double, volume double"


def history(seed, n, gap=3):
    rng = random.Random(seed)
    at, price, rows = DAY, 50.0, []
    for _ in range(n):
        price = max(1.0, price + rng.gauss(0, 1))
        rows.append((f"T{seed}", at, price - 0.5, price + 1, price - 1, price, float(rng.randrange(1, 99))))
        at += dt.timedelta(rng.randrange(1, gap + 1))
    return rows


def test_means_are_those_of_pandas(spark, monkeypatch):
    monkeypatch.setattr(ewm, "STRETCH_DAYS", 17)
    rows = [(k, DAY + dt.timedelta(2 * i), None if (i * k) % 7 == 3 else float((i * 37) % 11 - 5)) for k in (1, 2, 3) for i in range(90)]
    rows += [(4, DAY, None), (5, DAY, 1.0), (6, DAY, None), (6, DAY + dt.timedelta(900), 2.0)]
    frame = spark.createDataFrame(rows, "ticker int, date date, x double")
    wanted = [ewm.by_half_life("h3", "x", 3), ewm.by_half_life("h30", "x", 30), ewm.by_span("s9", "x", 9, False), ewm.Mean("w", "x", 13 / 14, False, 14)]
    got = ewm.means(frame, wanted).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    by = got.groupby("ticker")["x"]
    want = {
        "h3": by.transform(lambda s: s.ewm(halflife=3, ignore_na=True).mean()), "h30": by.transform(lambda s: s.ewm(halflife=30, ignore_na=True).mean()),
        "s9": by.transform(lambda s: s.ewm(span=9, adjust=False, ignore_na=True).mean()),
        "w": by.transform(lambda s: s.ewm(alpha=1 / 14, adjust=False, ignore_na=True, min_periods=14).mean()),
    }
    for name, series in want.items():
        pd.testing.assert_series_equal(got[name], series, check_names=False, rtol=1e-9)


def test_seeded_means_go_on(spark):
    rows = [("A", DAY + dt.timedelta(i), float((i * 7) % 13)) for i in range(50)]
    frame = spark.createDataFrame(rows, "ticker string, date date, x double")
    wanted = [ewm.by_half_life("h", "x", 5), ewm.by_span("s", "x", 9, False)]
    whole = {r.date: r for r in ewm.means(frame, wanted).collect()}
    seed = whole[DAY + dt.timedelta(29)]
    seeds = spark.createDataFrame([("A", seed.h, 30, seed.s, 30)], "ticker string, h double, h__n long, s double, s__n long")
    for r in ewm.means(frame.where(F.col("date") > F.lit(seed.date)), wanted, seeds=seeds).collect():
        assert (r.h, r.s) == (pytest.approx(whole[r.date].h), pytest.approx(whole[r.date].s))


def test_indicators_have_no_python_node(spark):
    frame = spark.createDataFrame(history(1, 70), BAR)
    for made in (ewm.features(frame), ewm.decayed(frame, "close"), ewm.indicator_graph().run(frame, ["return_5d"])):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_graph_runs_the_fewest_steps():
    graph = ewm.indicator_graph()
    names = lambda asked: [s.name for s in graph.plan(asked, ["ticker", "date", "open", "high", "low", "close", "volume"])]
    assert names(["return_5d"]) == ["return_5d"] and names(["macd", "rsi_14", "roc_5"]) == ["momentum", "roc_5"]
    with pytest.raises(ValueError, match="unknown column: nothing"):
        names(["nothing"])
    one = lambda name, needs: Step(name, needs, (name,), lambda f: f)
    ring = Graph([one("a", ("b",)), one("b", ("c",)), one("c", ("a",))])
    with pytest.raises(ValueError, match="need each other"):
        ring.plan(["a"], [])
    with pytest.raises(ValueError, match="given by"):
        Graph([one("a", ()), one("a", ())])
    assert [s.name for s in Graph([one("c", ("b",)), one("b", ("a",)), one("d", ("b", "c"))]).plan(["d"], ["a"])] == ["b", "c", "d"]
    assert "return_5d" in graph.tagged("returns") and graph.rules(["macd"], ["ticker", "date", "close"]) == {"rsi_inside": "rsi_14 is null or rsi_14 between 0 and 100"}


def test_family_and_lineage(spark):
    steps = family(lambda k: F.col("x") * k, ("x",), {"x2": (2,), "x3": (3,)}, ("times",))
    row = Graph(steps).run(spark.createDataFrame([(5,)], "x int"), ["x3"]).first()
    assert row.asDict() == {"x": 5, "x3": 15}
    assert {(r.step, tuple(r.tags)) for r in Graph(steps).lineage(spark).collect()} == {("x2", ("times",)), ("x3", ("times",))}


def _same(a, b):
    a, b = ({(r.ticker, r.date): r.asDict() for r in f.collect()} for f in (a, b))
    assert a.keys() == b.keys()
    for k in a:
        for c, x in a[k].items():
            y = b[k][c]
            assert x == y or (isinstance(x, float) and isinstance(y, float) and x == pytest.approx(y, rel=1e-8, abs=1e-9)), (k, c, x, y)


def test_update_equals_a_full_run(spark, tmp_path):
    rows = [r for s, n in ((1, 200), (2, 150), (3, 90), (4, 20)) for r in history(s, n)]
    rows += [(t, d.replace(year=d.year - 9), *r) for t, d, *r in history(5, 40, gap=2)] + history(5, 30)  # a series with a hole of years
    whole = spark.createDataFrame(rows, BAR)
    news = spark.createDataFrame([(r[0], r[1], (i % 9 - 4) / 7, "positive") for i, r in enumerate(rows) if i % 4 == 0], "ticker string, date date, sentiment_score double, sentiment_label string")
    steps = lambda seeds: enrich.steps(news=news, seeds=seeds)
    full = feature_store.FeatureStore(spark, f"file://{tmp_path}/full", steps)
    full.rebuild(whole)
    store = feature_store.FeatureStore(spark, f"file://{tmp_path}/part", steps)
    late = lambda r: (r[0] == "T1" and r[1] > DAY + dt.timedelta(350)) or (r[0] == "T2" and r[1] > DAY + dt.timedelta(270) and r[6] > 50) or r[0] == "T4"
    late_rows = [r for r in rows if late(r) or (r[0] == "T5" and r[1] > DAY + dt.timedelta(40))]
    store.rebuild(spark.createDataFrame([r for r in rows if r not in late_rows], BAR))
    store.update(whole, spark.createDataFrame(late_rows, BAR).select("ticker", "date"))
    assert {c for c in store.read().columns} == {c for c in full.read().columns}
    _same(store.read(), full.read())


def test_update_touches_later_months_only(spark, tmp_path):
    rows = history(1, 300)
    store = feature_store.FeatureStore(spark, f"file://{tmp_path}/s")
    cut = rows[-5][1]
    store.rebuild(spark.createDataFrame([r for r in rows if r[1] < cut], BAR))
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("month_of=*")}
    store.update(spark.createDataFrame(rows, BAR), spark.createDataFrame([r[:2] for r in rows if r[1] >= cut], "ticker string, date date"))
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("month_of=*")}
    touched = {m for m in after if before.get(m) != after[m]}
    assert min(touched) >= f"month_of={rows[-6][1]:%Y-%m}" and len(touched) <= 2
    assert store.read().count() == 300
    store.update(spark.createDataFrame(rows, BAR), spark.createDataFrame([], "ticker string, date date"))
    assert store.read().count() == 300


def test_load_and_cache(spark, tmp_path):
    store = feature_store.FeatureStore(spark, f"file://{tmp_path}/s", lambda seeds: enrich.steps(seeds=seeds))
    store.rebuild(spark.createDataFrame(history(1, 100) + history(2, 30), BAR))
    got = store.load("2020-03-01", "2020-06-30", names=["rsi_14", "news_count", "vix"])
    rows = got.collect()
    assert {r.ticker for r in rows} == {"T1"} and dict(got.dtypes)["date"] == "timestamp" and [r.date for r in rows] == sorted(r.date for r in rows)
    assert {(r.news_count, r.vix) for r in rows} == {(0, 0.0)}
    assert store.load("1990-01-01", "1990-12-31").collect() == []
    none = feature_store.FeatureStore(spark, f"file://{tmp_path}/none").load("2020-01-01", "2020-02-01", names=["rsi_14"])
    assert none.collect() == [] and none.columns == ["ticker", "date", "rsi_14"] and dict(none.dtypes)["date"] == "timestamp"
    calls = []
    cache = feature_store.Cached(spark, f"file://{tmp_path}/c")
    make = lambda n: calls.append(n) or spark.range(n)
    assert [cache.load("r", make, 3).count(), cache.load("r", make, 3).count(), cache.load("r", make, 4).count()] == [3, 3, 4] and calls == [3, 4]
    cache.clear()
    assert cache.load("r", make, 3).count() == 3 and calls == [3, 4, 3]
