"""Every query with a SQL twin against DuckDB, and the entry points."""

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "year"):
        return str(value)[:10]
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return round(float(value), 5) + 0.0
    return str(value)


def _rows(frame):
    return sorted((tuple(map(_plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    found, wanted = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) == len(wanted) and len(found)
    for a, b in zip(_rows(found), _rows(wanted), strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) <= 2e-5 * max(1, abs(x)) for x, y in zip(a, b, strict=True))


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _dates(spark):
    return sorted(r.date for r in registry.queries()["unified_view"](spark, SF).select("date").distinct().collect())


def test_predictions_without_sql(spark):
    made = registry.queries()["gbt_predictions"](spark, SF).toPandas()
    assert len(made) and made.probability.between(0, 1).all() and not made.duplicated(["ticker", "date"]).any()
    assert ((made.probability >= 0.5) == (made.direction == "up")).all()


def test_retraining_backtest_keeps_to_its_folds(spark):
    rows, days = registry.queries()["retraining_backtest"](spark, SF).toPandas(), _dates(spark)
    every = sorted({r.date for r in registry.queries()["next_day_return"](spark, SF).collect()})
    assert len(rows) and rows.probability.between(0, 1).all() and set(rows.actual) <= {0, 1} and days[0] >= every[0]
    for fold, part in rows.groupby("fold"):
        assert set(part.train_end) == {1000 + 500 * fold} and part.date.min() >= every[1000 + 500 * fold]
    assert ((rows.probability >= 0.5) == (rows.prediction == 1)).all() and not rows.duplicated(["ticker", "date"]).any()


def test_walk_forward_metrics_and_grid(spark):
    one = registry.queries()["walk_forward_metrics"](spark, SF).first()
    assert one.folds >= 1 and all(0 <= one[f"mean_{n}"] <= 1 and one[f"std_{n}"] >= 0 for n in ("accuracy", "precision", "recall"))
    grid = registry.queries()["parameter_grid"](spark, SF).toPandas().sort_values("place")
    assert list(grid.place) == list(range(1, len(grid) + 1)) and grid.mean_accuracy.is_monotonic_decreasing and grid.params.is_unique
    assert set(grid.params) == {f"depth={d}, rounds=2, rate={r}" for d in (1, 2) for r in (0.1, 0.5)}


def test_feature_importance_is_a_ranking(spark):
    rows = registry.queries()["feature_importance"](spark, SF).orderBy("place").collect()
    assert [r.place for r in rows] == [1, 2, 3] and len({r.feature for r in rows}) == 3
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True) and 0 < sum(r.importance for r in rows) <= 1.0001


def test_scored_predictions_know_nothing_of_their_date(spark):
    rows = registry.queries()["scored_predictions"](spark, SF).toPandas()
    assert len(rows) and (rows.trained_on < rows.date).all() and not rows.duplicated(["ticker", "date"]).any()
    assert rows.probability.between(0, 1).all() and ((rows.probability >= 0.5) == (rows.direction == "up")).all()
    skew = registry.queries()["feature_skew"](spark, SF).toPandas()
    assert {"bb_width", "volume_ratio", "row_number"} >= set(skew[skew.kind.isin(["missing", "type", "extra"])].feature) and "missing" in set(skew.kind)


def test_synthetic_bars_are_bars(spark):
    rows = registry.queries()["synthetic_bars"](spark, SF).toPandas()
    assert len(rows) and (rows.high >= rows[["open", "close", "low"]].max(axis=1)).all() and (rows.low <= rows[["open", "close"]].min(axis=1)).all() and (rows.low > 0).all()
