"""Shapley values along tree paths, against all sets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import attribution, learning


def expected(nodes, i, x, known):
    """A tree's value where features outside ``known`` follow the training rows."""
    n = nodes[i]
    if n.leftChild < 0:
        return n.prediction
    f, cut = n.split.featureIndex, n.split.leftCategoriesOrThreshold[0]
    if f in known:
        return expected(nodes, n.leftChild if x[f] <= cut else n.rightChild, x, known)
    return sum(nodes[c].rawCount / n.rawCount * expected(nodes, c, x, known) for c in (n.leftChild, n.rightChild))


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    rows = [(k, float(k % 7), float(k * k % 11), float(k % 3), int((k % 7 > 3) != (k * k % 11 > 4) or k % 13 == 0)) for k in range(400)]
    frame = spark.createDataFrame(rows, "id int, a double, b double, c double, y int")
    path = f"file://{tmp_path_factory.mktemp('m')}/m"
    fitted = learning.train_classifier(frame, ["a", "b", "c"], "y", depth=3, rounds=4)
    fitted.write().save(path)
    return frame, path, fitted


def test_values_are_those_of_all_sets(spark, model):
    frame, path, fitted = model
    nodes, weights = {}, {r[0]: r[2] for r in spark.read.parquet(f"{path}/stages/*/treesMetadata").collect()}
    for r in spark.read.parquet(f"{path}/stages/*/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(r.treeID, {})[r.id] = r
    value = lambda x, known: sum(weights[t] * expected(nodes[t], 0, x, known) for t in nodes)
    made = {r.id: r for r in attribution.attributions(frame, path, ["a", "b", "c"], "id").collect()}
    assert len(made) == 400
    for r in frame.where("id < 60").collect():
        x, got = (r.a, r.b, r.c), made[r.id]
        assert got.base == pytest.approx(value(x, set())) and got.margin == pytest.approx(value(x, {0, 1, 2}))
        for f, name in enumerate("abc"):
            others, want = [k for k in range(3) if k != f], 0.0
            for size in range(3):
                for s in itertools.combinations(others, size):
                    share = math.factorial(size) * math.factorial(2 - size) / math.factorial(3)
                    want += share * (value(x, {*s, f}) - value(x, set(s)))
            assert got[f"by_{name}"] == pytest.approx(want, abs=1e-9)


def test_values_add_up_to_the_margin(spark, model):
    frame, path, fitted = model
    made = attribution.attributions(frame.withColumn("a", F.when(F.col("id") != 5, F.col("a"))), path, ["a", "b", "c"], "id")
    scored = {r.id: r.probability for r in learning.probability(fitted.transform(frame)).collect()}
    rows = made.collect()
    assert len(rows) == 399
    for r in rows:
        assert r.base + r.by_a + r.by_b + r.by_c == pytest.approx(r.margin, abs=1e-9)
        assert scored[r.id] == pytest.approx(1 / (1 + math.exp(-2 * r.margin)))


def test_rankings(spark, model):
    frame, path, _ = model
    made = attribution.attributions(frame, path, ["a", "b", "c"], "id")
    rows = made.toPandas()
    sizes = {c: rows[f"by_{c}"].abs().mean() for c in "abc"}
    top = attribution.top_features(attribution.attributions(frame, path, ["a", "b", "c"]), 2).orderBy("place").collect()
    assert [r.feature for r in top] == sorted(sizes, key=lambda c: -sizes[c])[:2] and top[0].mean_size == pytest.approx(max(sizes.values()))
    first = {r.id: r for r in attribution.reasons(made, 1, "id").collect()}
    for r in rows.itertuples():
        assert abs(first[r.id].value) == pytest.approx(max(abs(r.by_a), abs(r.by_b), abs(r.by_c)))
    assert attribution.attributions(frame.limit(0), path, ["a", "b", "c"], "id").collect() == []


def test_a_tree_of_one_leaf():
    assert attribution.shapley([[attribution.Leaf(2.0, (), (), (), ())]], np.ones((3, 2))).tolist() == [[0, 0]] * 3


def test_grid_shares_fits_by_rounds(spark):
    import datetime as dt

    from barloom.operators import walkforward

    day = dt.date(2020, 1, 1)
    rows = [(t, day + dt.timedelta(i), int((i * 7 + k) % 5 < 2 or i % 9 == 0), float((i * 7 + k) % 5), float(i % 3)) for k, t in enumerate("AB") for i in range(120)]
    numbered = walkforward.by_date(spark.createDataFrame(rows, "ticker string, date date, y int, f double, g double"))
    folds = [(0, 40, 45, 80), (30, 75, 80, 120)]
    grid = walkforward.grid_search(numbered, ["f", "g"], "y", folds, {"depth": [1, 2], "rounds": [1, 3], "rate": [0.5]}, parallel=3)
    got = {r.params: r for r in grid.collect()}
    assert sorted(got) == sorted(f"depth={d}, rounds={n}, rate=0.5" for d in (1, 2) for n in (1, 3))
    for params, r in got.items():
        d, n = int(params[6]), int(params.split("rounds=")[1][0])
        alone = walkforward.summary(walkforward.fold_metrics(walkforward.predicted(numbered, ["f", "g"], "y", folds, depth=d, rounds=n, rate=0.5))).first()
        assert (r.folds, r.mean_accuracy, r.std_recall) == (alone.folds, pytest.approx(alone.mean_accuracy), pytest.approx(alone.std_recall)), params
    assert walkforward.grid_search(numbered, ["f", "g"], "y", [], {"depth": [1]}).collect() == []
