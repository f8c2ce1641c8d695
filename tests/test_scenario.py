"""Scenarios against the features of bars with one more bar."""

from __future__ import annotations

import datetime

import numpy as np
from pyspark.sql import functions as F

from quaymark.operators import features, scenario, signals


def walk(seed, n):
    rng = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(rng.normal(0, 0.012, n) - 0.0004))


def test_scenarios_equal_one_more_bar(spark):
    start = datetime.date(2001, 1, 1)
    series = {f"c{k}": walk(k, 240) for k in range(6)}
    rows = [(c, start + datetime.timedelta(i), *[float(x)] * 4, 1.0) for c, s in series.items() for i, x in enumerate(s)]
    bars = spark.createDataFrame(rows, "code string, d date, open double, high double, low double, close double, volume double")
    found = {(r["code"], r["move"]): (r["buy"], r["sell"]) for r in scenario.next_closes(bars).collect()}
    assert len(found) == 6 * 201
    moves = list(range(-100, 101, 10))
    more = []
    for c, s in series.items():
        for m in moves:
            more += [(f"{c}|{m}", start + datetime.timedelta(i), *[float(x)] * 4, 1.0) for i, x in enumerate([*s, s[-1] * (1 + m / 1000)])]
    whole = signals.rule_masks(signals.aux_signals(features.moving_averages(features.multi_scale(spark.createDataFrame(more, bars.schema)))))
    last = whole.where(F.col("d") == F.lit(start + datetime.timedelta(240))).select("code", "ae_buy", "ae_sell").collect()
    want = {(r["code"].split("|")[0], int(r["code"].split("|")[1])): (r["ae_buy"], r["ae_sell"]) for r in last}
    assert {k: found[k] for k in want} == want
    assert any(b or s for b, s in found.values())


def test_trigger_is_where_the_signal_begins(spark):
    edge = scenario._edge(lambda c: 88 <= c <= 95, 100.0)
    assert abs(edge - 95) < 0.01 and scenario._edge(lambda c: False, 100.0) is None
    grid = spark.createDataFrame([("a", m, m in (1, 2, 5)) for m in range(8)], "code string, move long, buy boolean")
    assert sorted((r["first"], r["last"]) for r in scenario.move_ranges(grid, "buy").collect()) == [(1, 2), (5, 5)]
