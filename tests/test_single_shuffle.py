"""Steps that read and shuffle their rows once."""

import pytest

from barloom.functions import ewm
from barloom.operators import valence


def test_means_shuffle_once(spark):
    rows = spark.range(40).selectExpr("concat('A', id % 3) as ticker", "date_add(date'2020-01-01', cast(id as int) * 40) as date", "cast(id * 7 % 11 as double) as close")
    plan = ewm.momentum(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("sent", [0, 1000])
def test_a_lexicon_of_any_size_gives_the_same_and_shuffles_words_only(spark, monkeypatch, sent):
    texts = spark.createDataFrame([(1, "Good bad not GOOD but bad!"), (2, None), (3, "good " * 50), (4, "else ??")], "k long, t string")
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    monkeypatch.setattr(valence, "SENT_ROWS", 1000)
    wanted = sorted(valence.score(texts, lexicon, "k", "t").collect())
    monkeypatch.setattr(valence, "SENT_ROWS", sent)
    made = valence.score(texts, lexicon, "k", "t")
    assert sorted(made.collect()) == wanted
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any("word" in line and "back" in line for line in plan.splitlines() if " Join " in line)
    assert sent or "_known" in plan
