"""Models in force, signals and their history, universes, listings, unions and other columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import columns, history, learning, listing, loading, predictions, scoring, series, texts, trading, universe, walkforward

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    rows = [(t, DAY + dt.timedelta(i), int((i * 7 + k) % 5 < 2), DAY + dt.timedelta(i + 1), float((i * 7 + k) % 5), float(i % 3)) for k, t in enumerate("AB") for i in range(120)]
    numbered = walkforward.by_date(spark.createDataFrame(rows, "ticker string, date date, y int, settled date, f double, g double"))
    folder = f"file://{tmp_path_factory.mktemp('models')}"
    folds = walkforward.retraining_folds(numbered, train=40, every=30)
    return numbered, folds, folder, scoring.register(numbered, ["f", "g"], "y", folds, folder, "settled", depth=2, rounds=2)


def test_no_row_meets_a_model_that_knows_its_date(spark, trained):
    numbered, folds, _, registry = trained
    made = scoring.score(numbered, registry).collect()
    starts = sorted(r.trained_on for r in registry.collect())
    assert len(starts) == 3 and made and all(r.trained_on < r.date for r in made)
    for r in made:
        assert r.trained_on == max(s for s in starts if s < r.date) and 0 <= r.probability <= 1
    assert {(r.ticker, r.date) for r in made} == {(t, DAY + dt.timedelta(i)) for t in "AB" for i in range(120) if DAY + dt.timedelta(i) > starts[0]}
    own = {(r.ticker, r.date): r.probability for r in walkforward.predicted(numbered, ["f", "g"], "y", folds, "settled", depth=2, rounds=2).collect()}
    same = [(r, own[r.ticker, r.date]) for r in made if (r.ticker, r.date) in own]
    assert sum(r.probability == pytest.approx(p) for r, p in same) >= 0.95 * len(same)  # days that two folds could score differ


def test_columns_are_aligned_and_skew_is_counted(spark, trained):
    numbered, _, _, registry = trained
    asked = numbered.select("ticker", "date", F.when(F.col("i") % 10 > 0, F.col("f") * 100).cast("string").alias("f"), F.lit(1).alias("more"))
    assert scoring.score(asked, registry).collect() == []  # g is missing
    found = {(r.feature, r.kind) for r in scoring.skew(asked, registry).collect()}
    assert found == {("f", "null"), ("f", "outside"), ("f", "type"), ("more", "extra"), ("g", "missing")}
    assert scoring.skew(numbered.select("ticker", "date", "f", "g"), registry).collect() == []
    scored = scoring.score(asked.withColumn("g", F.lit("1.0")), registry)
    assert scored.count() == scoring.in_force(asked, registry).where("model_id is not null").join(asked.dropna(), "date").count()


def test_registry_grows_and_models_stay_fresh(spark, trained):
    numbered, folds, folder, registry = trained
    last = max(r.trained_on for r in registry.collect())
    assert scoring.fresh(registry, last + dt.timedelta(3), 3) and scoring.fresh(registry, last + dt.timedelta(4), 3) is None
    assert scoring.fresh(registry, last - dt.timedelta(200), 30) is None
    more = scoring.register(numbered, ["f"], "y", folds[:1], folder, "settled", mode="other", depth=1, rounds=1)
    assert more.count() == 4 and scoring.read_registry(spark, folder).where("mode = 'other'").first().features[0].name == "f"


def test_predictions_are_stored_behind_their_rules(spark, trained, tmp_path):
    from barloom.operators.lake import LakeTable

    numbered, _, _, registry = trained
    table = LakeTable(spark, f"file://{tmp_path}/p", ["ticker", "date", "year"], "year")
    only = registry.where("mode = 'direction'")
    scoring.score_and_store(table, numbered, only)
    again = scoring.score_and_store(table, numbered.where("i > 100"), only)
    assert again == 1 and table.read().count() == scoring.score(numbered, only).count()
    assert scoring.score(numbered.limit(0), only).collect() == []


def test_held_out_rows_end_the_rounds(spark):
    rows = [(float(i % 7), i % 2, i % 5 == 0) for i in range(300)]
    model = learning.train_classifier(spark.createDataFrame(rows, "f double, y int, check boolean"), ["f"], "y", depth=1, rounds=20, held_out="check")
    assert model.stages[-1].getNumTrees < 20


def test_generators(spark):
    bars = spark.createDataFrame([("A", DAY + dt.timedelta(i), float(100 + (i == 25) * 50)) for i in range(30)], "ticker string, date date, close double")
    made = predictions.DistanceGenerator(20, 0.2).signals(bars).collect()
    assert [(r.date, r.action, r.confidence, r.signal_type) for r in made] == [(DAY + dt.timedelta(25), "BUY", 70.0, "sma_distance")]
    told = spark.createDataFrame([("A", DAY + dt.timedelta(25), 0.9), ("B", DAY, 0.1)], "ticker string, date date, probability double")
    best = predictions.scan(bars, [predictions.DistanceGenerator(20, 0.2), predictions.DirectionGenerator(told)]).collect()
    assert [(r.ticker, r.signal_type, r.confidence) for r in best] == [("A", "ml_direction", 90.0)]

    class Bad(predictions.Generator):
        kind = "bad"

        def make(self, bars):
            return bars

    with pytest.raises(ValueError, match="lack"):
        Bad().signals(bars)
    with pytest.raises(TypeError):
        predictions.Generator()


def test_signal_history_is_merged_and_read_back(spark, tmp_path):
    store = history.table(spark, f"file://{tmp_path}/h")
    assert history.load(store, "2020-01-01").collect() == []
    one = spark.createDataFrame([("A", DAY, "k", "BUY", 70.0, 0.5, None), ("B", DAY, "k", "SELL", 60.0, None, "x")], "ticker string, date date, signal_type string, action string, confidence double, gap double, why string")
    assert history.save(store, one.limit(0)) is None and history.save(store, one) == 0
    later = spark.createDataFrame([("A", DAY, "k", "HOLD", 1, 7)], "ticker string, date date, signal_type string, action string, confidence int, other int")
    history.save(store, later)
    got = {r.ticker: r for r in history.load(store, "2020-01-01", gap="double", why="string", other="long").collect()}
    assert (got["A"].action, got["A"].gap, got["A"].other, got["A"].confidence) == ("HOLD", None, 7, 1.0)
    assert (got["B"].action, got["B"].why, got["B"].other, got["B"].reasoning) == ("SELL", "x", None, None)
    assert history.load(store, "2020-01-02").collect() == []


def test_listings_of_odd_shapes(spark):
    bad = ["{", "", None, "[]", '{"data":{}}', '{"data":{"children":{}}}', '{"data":{"children":[]}}', '{"data":{"children":"x"}}']
    good = '{"data":{"children":[{"data":{"title":" T ","selftext":"","created_utc":"86400","score":"9","permalink":"/p","link_flair_text":null}},{},{"data":{"created_utc":99999.5,"score":"many"}},7]}}'
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*bad, good])], "id int, json string")
    found = listing.posts(rows, "json", "id")
    assert {(r.id, r.place) for r in found.collect()} == {(8, k) for k in range(4)}
    got = {r.place: r for r in listing.articles(found, F.lit("r/s"), "https://h", F.lit("1970-01-01").cast("date"), "id").collect()}
    assert (got[0].title, got[0].body, got[0].source_url, str(got[0].published_at)) == ("T", "T", "https://h/p", "1970-01-02 00:00:00")
    assert '"score":9' in got[0].source_metadata and '"score":0' in got[2].source_metadata and "flair" not in got[0].source_metadata
    assert got[1].source_url == "" and len({r.article_id for r in got.values()}) >= 3
    assert listing.articles(found, F.lit("s"), "", F.lit("1970-01-02").cast("date")).where("published_at < '1970-01-02'").count() == 0


def test_universe_by_arrays_and_by_index(spark):
    schema = "symbol string, market string, exchange string, sector string, tags array<string>, active boolean, priority int"
    u = spark.createDataFrame([("a", "m", "X", "S", ["Tech ", "big"], True, 1), ("b", "m", "x", "s", ["big"], True, 5), ("c", "n", "y", "t", [], True, 3), ("d", "m", "x", "s", ["tech"], False, 9)], schema)
    pick = lambda **k: [r.symbol for r in universe.select(u, **k).collect()]
    assert pick(tags_any=["TECH", "big"]) == ["b", "a"] and pick(tags_all=["tech", "BIG "]) == ["a"] and pick(tags_any=[]) == [] and pick(tags_all=[]) == ["b", "c", "a"]
    assert pick(sector="S", active_only=False) == ["d", "b", "a"] and pick(exchange="x", market="M", least_priority=2) == ["b"]
    members = spark.createDataFrame([("m", "a"), (None, "c"), ("n", "b")], "market string, symbol string")
    assert pick(members=members) == ["c", "a"]
    index = universe.tag_index(u)
    assert {r.symbol for r in universe.by_index(index, ["tech", "big"]).collect()} == {"a", "b", "d"}
    assert {r.symbol for r in universe.by_index(index, ["tech", "big", "BIG"], match_all=True).collect()} == {"a"}
    s = {r.market: r for r in universe.statistics(u).collect()}
    assert (s["m"].total, s["m"].active, s["m"].inactive, s["m"].exchanges) == (3, 2, 1, ["X", "x"])


def test_unions_ranks_and_slices(spark):
    a, b = spark.createDataFrame([(1, True)], "x int, y boolean"), spark.createDataFrame([(2.5, "t")], "x float, y string")
    u = loading.concatenated([a, b.select("y", "x"), spark.createDataFrame([(dt.date(2020, 1, 1),)], "d date")])
    assert dict(u.dtypes) == {"x": "double", "y": "string", "d": "date"} and u.count() == 3
    kinds = [({"int", "bigint"}, "bigint"), ({"bigint", "float"}, "double"), ({"decimal(5,2)", "int"}, "double"), ({"date", "timestamp"}, "timestamp"), ({"date", "int"}, "string"), ({"void", "int"}, "int"), ({"boolean", "int"}, "int")]
    assert all(loading.supertype(k) == want for k, want in kinds)
    r = spark.createDataFrame([("d", x) for x in (3, 1, 3, 2, None)], "d string, x int").select("x", columns.average_rank("x", "d").alias("r")).collect()
    assert sorted((x.x or 0, x.r or 0) for x in r) == [(0, 0), (1, 4), (2, 3), (3, 1.5), (3, 1.5)]
    rows = spark.createDataFrame([("A", DAY + dt.timedelta(i)) for i in range(6)], "ticker string, date date")
    assert sorted((x.place, x.date.day) for x in series.slices(rows, {"h": (0, 2), "t": (-1, None)}).collect()) == [("h", 1), ("h", 2), ("t", 6)]
    w = trading.with_weights(rows.withColumn("close", F.lit(1.0)), spark.createDataFrame([("A", DAY, 0.5)], "ticker string, date date, weight double"))
    assert sorted(x.weight for x in w.collect()) == [0, 0, 0, 0, 0, 0.5]


def test_columns_of_texts(spark):
    row = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert row(texts.redact_json(F.lit('{"a":{"My_KEY" : "x\\"y","n":1},"password":-1.5e3,"t":"a \\"key\\": 1","token":[{"v":2}]}'))) == (
        '{"a":{"My_KEY" : "***","n":1},"password":"***","t":"a \\"key\\": 1","token":[{"v":2}]}'
    )
    assert row(texts.redact(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("b"), F.lit("y")))) == {"api_key": "***", "b": "y"}
    assert row(texts.tolerant_json(F.lit("{"), "k int").k) is None
    assert row(columns.item_text(F.lit("t"), F.lit(" s "), F.lit("  "))) == "s" and row(columns.item_text(F.lit(None), F.lit(None), F.lit(None))) == ""
    assert row(columns.balance(F.lit(3), F.lit(1))) == 0.5 and row(columns.balance(F.lit(None).cast("int"), F.lit(0))) == 0
    assert row(universe.tags_of(F.array(F.lit("a | b"), F.lit("|b|"), F.lit("c")))) == ["a", "b", "c"]
