"""Negatives where most pairs are taken."""

import logging

from graphloom.operators import labels as L
from graphloom.storage import materialize


def _pairs(spark, free):
    pairs = [(f"d{i}", f"p{j}") for i in range(10) for j in range(10)][free:]
    return spark.createDataFrame(pairs, "source_id string, target_id string"), *(spark.createDataFrame([(f"{x}{i}",) for i in range(10)], "entity_id string") for x in "dp")


def test_every_positive_gets_a_negative_in_dense_pools(spark):
    known, s, t = _pairs(spark, 5)
    got = L.negatives(known.limit(40), s, t, known, 1).collect()
    assert len(got) == 40 and {(r.source_id, r.target_id) for r in got} <= {("d0", f"p{j}") for j in range(5)}


def test_a_shortfall_is_reported(spark, caplog):
    known, s, t = _pairs(spark, 0)
    with caplog.at_level(logging.WARNING):
        assert L.negatives(known.limit(4), s, t, known, 1).count() == 0
    assert "only 0 of 4 negatives found in 400 draws" in caplog.text


def test_draws_are_formed_one_by_one_and_never_broadcast_above_the_bound(spark, monkeypatch):
    known, s, t = _pairs(spark, 30)
    want = sorted(map(tuple, L.negatives(known.limit(40), s, t, known, 1).collect()))
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().toString())
        return materialize(df)

    monkeypatch.setattr(L, "FEW", 0, raising=False)
    monkeypatch.setattr(L, "materialize", noted)
    assert sorted(map(tuple, L.negatives(known.limit(40), s, t, known, 1).collect())) == want
    drawn = [x for x in plans if "explode" in x]
    assert len(drawn) > 1 and not any("BroadcastExchange" in x for x in drawn)
