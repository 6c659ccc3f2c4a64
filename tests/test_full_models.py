"""Registered model queries fit the reference's whole model: 200 trees of depth 5."""

import pytest

from barloom.operators import attribution, learning, walkforward
from barloom.plans import model_queries, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def asked(monkeypatch):
    """Parameters of each fit; one tree is fitted in place of all."""
    found, train = [], learning.train_classifier

    def fit(*args, **params):
        found.append({k: params[k] for k in ("depth", "rounds", "rate", "share") if k in params})
        return train(*args, **params | {"rounds": 1, "depth": 1})

    monkeypatch.setattr(learning, "train_classifier", fit)
    return found


WHOLE = {"depth": 5, "rounds": 200, "rate": 0.05, "share": 0.9}


def test_feature_importance_fits_the_whole_model(spark, asked):
    registry.queries()["feature_importance"](spark, SF)
    assert asked == [WHOLE]


def test_registered_models_are_whole(spark, asked):
    _, models = model_queries.trained(spark, SF)
    assert len(asked) == models.count() == 3 and all(a == WHOLE for a in asked)


def test_fits_side_by_side_keep_the_order_of_folds(spark):
    rows = spark.range(160).selectExpr("'A' as ticker", "date_add(date'2020-01-01', cast(id as int)) as date", "cast(id % 3 as double) as x", "cast(id % 3 > 1 as int) as y")
    folds = [(s, s + 40, s + 40, s + 60) for s in range(0, 100, 20)]
    made = list(walkforward.fits(walkforward.by_date(rows), ["x"], "y", folds, depth=1, rounds=1))
    assert [(f.fold, f.span) for f in made] == list(enumerate(folds)) and all(f.n_rows == 40 for f in made)


def test_values_of_deep_paths_follow_their_formula():
    import itertools
    import math

    import numpy as np

    leaf = attribution.Leaf(2.0, (0, 2, 1), (-1.0, 0.0, 0.2), (0.5, 1.0, 2.0), (0.3, 0.6, 0.5))
    x = np.random.default_rng(1).uniform(-1.5, 2.5, (200, 4))
    got = attribution.shapley([[leaf]], x)
    inside = {f: (x[:, f] > lo) & (x[:, f] <= hi) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high, strict=True)}
    share = dict(zip(leaf.features, leaf.share, strict=True))
    left = lambda known: math.prod((inside[f].astype(float) if f in known else share[f]) for f in leaf.features) * leaf.value
    for f in leaf.features:
        others = [g for g in leaf.features if g != f]
        want = sum(
            math.factorial(k) * math.factorial(2 - k) / 6 * (left({*s, f}) - left(set(s))) for k in range(3) for s in itertools.combinations(others, k)
        )
        assert np.allclose(got[:, f], want)
    assert not got[:, 3].any()
