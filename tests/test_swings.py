"""Swings against drawn turning points and parts of a series; folds and choices against plain loops."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.operators import selection, swings

DAY = dt.date(2020, 1, 1)


def bars(spark, closes, code="A"):
    return spark.createDataFrame([(code, DAY + dt.timedelta(days=i), float(c)) for i, c in enumerate(closes)], "code string, d date, close double")


def zigzag(*levels, n=60):
    return np.concatenate([np.linspace(a, b, n, endpoint=False) for a, b in zip(levels, levels[1:], strict=False)])


def test_drawn_swings_are_found(spark):
    closes = zigzag(100, 140, 90, 95, 93, 150)
    labels = [r["label"] for r in swings.swing_labels(bars(spark, closes)).orderBy("d").collect()]
    runs = [labels[i] for i in range(len(labels)) if i == 0 or labels[i] != labels[i - 1]]
    assert runs[:2] == ["up", "down"] and runs[-1] == "up"
    assert labels[30] == "up" and labels[100] == "down" and labels[-30] == "up"
    assert {r["label"] for r in swings.swing_labels(bars(spark, closes[:50])).collect()} == {"range"}


def test_confirmed_swings_use_no_later_bars(spark):
    rng = np.random.default_rng(7)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 500)) + np.sin(np.arange(500) / 25) * 0.2)
    whole = [tuple(r) for r in swings.confirmed_legs(bars(spark, closes), final=False).collect()]
    assert len(whole) > 5 and {x[3] for x in whole} >= {"up", "down"}
    for n in (60, 137, 300, 499):
        part = [tuple(r) for r in swings.confirmed_legs(bars(spark, closes[:n]), final=False).collect()]
        assert sorted(part) == sorted(x for x in whole if x[4] < n)
    for _, first, last, _, known in whole:
        assert first < last <= known - 15


def test_confirmed_labels_cover_their_legs(spark):
    closes = zigzag(100, 90, 140, 90, 130)
    legs = swings.confirmed_legs(bars(spark, closes)).orderBy("first_bar").collect()
    labels = [r["label"] for r in swings.confirmed_labels(bars(spark, closes)).orderBy("d").collect()]
    for leg in legs:
        assert set(labels[leg["first_bar"] + 1 : leg["last_bar"]]) == {leg["label"]}
    assert labels[0] == "range" and {x["label"] for x in legs} == {"up", "down"}


def slow_folds(n, folds=4, train=160, size=60):
    if n < train + 20:
        cut = max(30, int(n * 0.7))
        return [(cut, n)] if cut < n else []
    step = max(20, min(size, (n - train) // folds))
    return [(s, min(n, s + step)) for s in list(range(train, n, step))[-folds:] if min(n, s + step) - s >= 10]


def test_folds(spark):
    sizes = [20, 30, 31, 100, 179, 180, 181, 200, 239, 240, 400, 405, 1000, 2499]
    rows = spark.createDataFrame([(f"{n:05d}", i) for n in sizes for i in range(n)], "code string, i int")
    found = {}
    for r in selection.fold_table(rows).orderBy("code", "fold").collect():
        found.setdefault(int(r["code"]), []).append((r["start"], r["stop"]))
    assert found == {n: f for n in sizes if (f := slow_folds(n))}


def slow_hold(labels, close, cost):
    wealth, entry, nets, equity = 1.0, None, [], []
    for label, c in zip(labels, close, strict=True):
        if entry is None and label == "up":
            entry = c * (1 + cost)
        elif entry is not None and label != "up":
            nets.append(c * (1 - cost) / entry - 1)
            wealth *= 1 + nets[-1]
            entry = None
        equity.append(wealth if entry is None else wealth * c * (1 - cost) / entry)
    peak = np.maximum.accumulate(equity)
    return len(nets), sum(x > 0 for x in nets), float(np.mean(nets)) if nets else 0.0, equity[-1] - 1, equity[-1] - close[-1] / close[0], float((equity / peak - 1).min())


def test_holding_one_bar_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for fold in range(6):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 50)))
        labels = [None] * 50 if fold == 5 else rng.choice(["up", "down", "range"], 50).repeat(3)[:50].tolist()
        rows += [("A", fold, "m", i, float(c), x) for i, (c, x) in enumerate(zip(close, labels, strict=True))]
        want[fold] = slow_hold(labels, close, 0.001)
    for r in selection.hold_metrics(spark.createDataFrame(rows, "code string, fold int, candidate string, i int, close double, label string")).collect():
        got = (r["n_closed"], r["wins"], r["mean_ret"], r["compound"], r["edge"], r["worst"])
        assert got == pytest.approx(want[r["fold"]], abs=1e-12)


METRICS = "code string, fold int, candidate string, n_closed long, wins long, mean_ret double, compound double, edge double, worst double, exposure double, switches long"


def test_nested_choice_gates_on_the_last_fold(spark):
    def fold(code, k, name, n, wins, mean, edge, worst):
        return (code, k, name, n, wins, mean, 0.0, edge, worst, 0.5, 1)

    rows = []
    for code, last in (("better", (3, 2, 0.02, 0.01, -0.05)), ("worse", (3, 2, -0.01, 0.01, -0.05)), ("idle", (0, 0, 0.0, 0.01, 0.0)), ("deep", (3, 2, 0.02, 0.01, -0.13))):
        rows += [fold(code, k, "a", 4, 3, 0.02, 0.01, -0.1) for k in (0, 1)] + [fold(code, k, "b", 4, 2, 0.03, 0.01, -0.1) for k in (0, 1)]
        rows += [fold(code, k, "c", 9, 9, 0.5, 0.01, -0.3) for k in (0, 1)]  # falls too far
        rows += [fold(code, 2, "a", *last), fold(code, 2, "b", 3, 1, 0.0, 0.0, -0.1), fold(code, 2, "c", 3, 3, 0.1, 0.1, 0.0)]
    rows += [fold("single", 0, "a", 4, 3, 0.02, 0.01, -0.1)]
    metrics = spark.createDataFrame(rows, METRICS)
    codes = ["better", "worse", "idle", "deep", "single"]
    found = {r["code"]: r for r in selection.nested_choice(metrics, spark.createDataFrame([(c, "b") for c in codes], "code string, baseline string"), ["a", "b", "c"]).collect()}
    assert {c: (found[c]["candidate"], found[c]["chosen"], found[c]["reason"]) for c in codes} == {
        "better": ("a", "a", "passed"), "worse": ("a", "b", "failed"), "idle": ("a", "b", "failed"), "deep": ("a", "b", "failed"), "single": ("b", "b", "one_fold"),
    }
    assert found["better"]["posterior"] == pytest.approx((6 + 2.5) / (8 + 5))
    pool = selection.pooled(metrics.where(F.col("fold") < 2))
    assert {r["winner"] for r in selection.best_candidate(pool, ["a", "b", "c"]).collect()} == {"a"}
