"""Tasks grow in number, not in size, and what several fits share is made once."""

import pytest

from barloom.operators import attribution, learning, walkforward
from barloom.sources import bars as sources


def _numbered(spark):
    rows = spark.range(240).selectExpr(
        "concat('A', id % 8) as ticker", "date_add(date'2020-01-01', cast(id div 8 as int)) as date", "cast(id * 7 % 11 as double) as x",
        "cast(id * 5 % 13 as double) as z",
    )
    return walkforward.by_date(rows.selectExpr("*", "cast(x + z > 11 as int) as y"))


def test_trades_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    few = sources.bars(spark, "/root/testdata/sf0.001").toPandas()
    monkeypatch.setattr(sources, "TASK_ROWS", 100)
    many = sources.bars(spark, "/root/testdata/sf0.001")
    plan = many._jdf.queryExecution().executedPlan().toString()
    n = -(-sources.table(spark, "/root/testdata/sf0.001", "lineitem").count() // 100)
    assert n > 4 and f", {n}), REPARTITION_BY_NUM" in plan
    key = ["market", "ticker", "date"]
    assert many.toPandas().sort_values(key).values.tolist() == few.sort_values(key).values.tolist()


def test_training_rows_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    numbered = _numbered(spark)
    seen = []
    monkeypatch.setattr(learning, "FIT_ROWS", 10)
    monkeypatch.setattr(learning, "train_classifier", lambda rows, *a, **k: seen.append((rows.rdd.getNumPartitions(), rows.count())))
    list(walkforward.fits(numbered, ["x", "z"], "y", [(0, 20, 20, 30)]))
    assert seen == [(16, 160)]


def test_grid_prepares_and_scores_a_fold_once(spark, monkeypatch):
    numbered, folds = _numbered(spark), [(0, 12, 12, 18), (6, 20, 20, 30)]
    grid = {"depth": [1, 2], "rounds": [1, 2], "rate": [0.5]}
    wanted = {}
    for d in (1, 2):
        for r in (1, 2):
            scored = walkforward.predicted(numbered, ["x", "z"], "y", folds, depth=d, rounds=r, rate=0.5)
            wanted[f"depth={d}, rounds={r}, rate=0.5"] = walkforward.summary(walkforward.fold_metrics(scored)).first().asDict()
    asked = []
    counts = attribution.staged_counts
    monkeypatch.setattr(attribution, "staged_counts", lambda rows, paths, *a: asked.append(len(paths)) or counts(rows, paths, *a))
    found = {r.params: r.asDict() for r in walkforward.grid_search(numbered, ["x", "z"], "y", folds, grid).collect()}
    assert asked == [2, 2] and set(found) == set(wanted)
    for name, row in wanted.items():
        assert {k: found[name][k] for k in row} == pytest.approx(row)


def test_stored_files_hold_few_rows(spark, monkeypatch):
    from barloom.operators import lake

    monkeypatch.setattr(lake, "FILE_ROWS", 10)
    made = lake.stored(spark.range(95).coalesce(1))
    assert len(made.inputFiles()) == 10 and made.count() == 95
