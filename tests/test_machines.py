from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaymark.operators import labels, machines


def masks(n, *on):
    return np.array([i in on for i in range(n)])


def test_peak_counts_from_the_fill_bar():
    close = np.array([20.0, 10.0, 9.5, 8.9, 8.0, 8.0])
    trades, _, _ = machines.rule_trades(close, masks(6, 0), masks(6), masks(6), trail=0.10)
    assert trades[0] == {"signal": 0, "entry": 1, "exit": 4, "reason": "trail"}


def test_trend_suppresses_sell():
    close = np.full(6, 10.0)
    trades, _, _ = machines.rule_trades(close, masks(6, 0), masks(6, 3), masks(6, 2))
    assert trades[0]["reason"] == "open"


def test_buy_on_the_last_bar_is_pending():
    trades, weight, _ = machines.rule_trades(np.full(4, 10.0), masks(4, 3), masks(4), masks(4))
    assert trades[0]["reason"] == "pending" and not weight.any()


def test_sell_leaves_one_bar_later_and_pays_costs():
    close = np.array([10.0, 10.0, 11.0, 12.0, 12.0])
    trades, weight, equity = machines.rule_trades(close, masks(5, 0), masks(5, 2), masks(5), cost=0.0)
    assert trades[0] == {"signal": 0, "entry": 1, "exit": 3, "reason": "sell"}
    assert weight.tolist() == [0, 0, 1, 1, 0]
    assert equity[-1] == pytest.approx(1.2)


def test_ewma_sigma_uses_only_the_past():
    r = np.random.default_rng(1).normal(0, 0.01, 50)
    full = machines.ewma_sigma(r)
    np.testing.assert_allclose(full[:30], machines.ewma_sigma(r[:30]))
    assert np.isnan(full[0]) and full[1] == pytest.approx(abs(r[0]))


def test_hysteresis_waits():
    raw = np.array(["range", "up", "range", "up", "up", "up", "range", "range", "range"], object)
    assert machines.hysteresis(raw, 2, 3).tolist() == ["range"] * 4 + ["up"] * 4 + ["range"]


def test_short_segments_take_the_label_before():
    assert machines.squash_short(["up"] * 5 + ["down"] + ["up"] * 5, 3) == ["up"] * 11
    assert machines.squash_short(["down"] + ["up"] * 4, 2) == ["up"] * 5


def test_event_matching_is_one_to_one(spark):
    events = spark.createDataFrame([("a", 10), ("a", 12)], "code string, bar long")
    alerts = spark.createDataFrame([("a", 8, 0.5), ("a", 10, 0.6), ("a", 21, 0.7), ("a", 30, 0.9)], "code string, bar long, score double")
    found = {r["bar"]: (r["onset"], r["kind"]) for r in labels.event_matches(events, alerts).collect()}
    assert found == {8: (None, "duplicate"), 10: (10, "match"), 21: (12, "match"), 30: (None, "false_alarm")}


def test_event_matching_bears_scores_that_change_in_another_run(spark):
    events = spark.createDataFrame([("a", 10), ("a", 12)], "code string, bar long")
    shaken = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()
    alerts = spark.createDataFrame([("a", 8, 0.5), ("a", 10, 0.6), ("a", 21, 0.7), ("a", 30, 0.9)], "code string, bar long, score double")
    found = {r["bar"]: (r["onset"], r["kind"]) for r in labels.event_matches(events, alerts.withColumn("score", shaken("score"))).collect()}
    assert found == {8: (None, "duplicate"), 10: (10, "match"), 21: (12, "match"), 30: (None, "false_alarm")}


def test_guard_holds_range_until_its_last_bar_has_passed():
    close = np.array([10.0, 9, 9, 9, 11, 11, 11, 9.5, 11])
    mean = np.full(9, 10.0)
    up = ["up"] * 9
    assert machines.guarded(close, mean, up) == ["up", "up", "up", "range", "range", "range", "up", "up", "up"]
    assert machines.guarded(close, mean, [*up[:4], "down", *up[5:]])[4:6] == ["down", "up"]
    mean[4] = np.nan
    assert machines.guarded(close, mean, up)[3:8] == ["range"] * 4 + ["up"]


def test_turnover_is_paid_on_the_bar_of_the_target():
    close = np.full(5, 10.0)
    _, weight, equity = machines.rule_trades(close, masks(5, 0), masks(5), masks(5), cost=0.01)
    assert weight.tolist() == [0, 0, 1, 1, 1] and equity.tolist() == pytest.approx([1, 0.99, 0.99, 0.99, 0.99])


def test_confirmed_tiers():
    from quaymark.operators.regimes import confirmed_tiers

    n, c, d, s = "normal", "cautious", "defensive", "stress"
    assert confirmed_tiers([]) == [] and confirmed_tiers([s, n, n]) == [s, s, n]
    assert confirmed_tiers([n, d, d, n, d, d, d, n, n, n]) == [n, n, n, n, n, n, d, d, n, n]
    assert confirmed_tiers([n, c, c, c, n]) == [n, n, n, c, n]
    # Stress holds for three days, of which its first is one; better days before that don't count.
    assert confirmed_tiers([n, s, s, s, n, n, n, n, n]) == [n, n, n, s, s, s, s, n, n]
    assert confirmed_tiers([n, c, d, s]) == [n, n, n, s]
