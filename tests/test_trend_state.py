"""The filtered trend against matrices, its labels on parts of a series, and confirmation against a loop."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.operators import trend_state as t

DAY = dt.date(2020, 1, 1)


def closes(n=400, seed=1):
    rng = np.random.default_rng(seed)
    sigma = np.where(np.arange(n) // 80 % 2, 0.03, 0.006)
    return 100 * np.exp(np.cumsum(rng.normal(np.sin(np.arange(n) / 40) * 0.004, sigma)))


def plain_filter(y, r):
    """The textbook form with matrices."""
    f, h, q = np.array([[1, 1], [0, 1.0]]), np.array([1.0, 0]), np.diag([r * 0.02, r * 0.001])
    x, p, out = np.array([y[np.isfinite(y)][0], 0.0]), np.diag([r * 100, r * 10]), []
    for v in y:
        x, p = f @ x, f @ p @ f.T + q
        if np.isfinite(v):
            k = p @ h / (h @ p @ h + r)
            x = x + k * (v - h @ x)
            p = (np.eye(2) - np.outer(k, h)) @ p
        out.append((x[1], p[1, 1]))
    return np.array(out).T


def test_filter_equals_the_matrix_form():
    y = np.log(closes(200))
    y[[50, 51, 120]] = np.nan
    slope, var = t.filtered_slope(y, 3e-4)
    want = plain_filter(y, 3e-4)
    np.testing.assert_allclose(slope, want[0], rtol=1e-8, atol=1e-12)
    np.testing.assert_allclose(var, want[1], rtol=1e-7)


def test_confirmation():
    assert t.confirmed(["up", "up", "down", "up", "up", "up", "range", "up", "down", "down", "down"]) == ["range"] * 5 + ["up"] * 5 + ["down"]
    assert t.confirmed(["up", "down"], 1) == ["up", "down"]


def frame(spark, series):
    rows = [(code, DAY + dt.timedelta(days=i), float(c), "down") for code, cs in series.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "code string, d date, close double, other string")


@pytest.mark.parametrize("gated", [True, False])
def test_labels_of_a_part_are_those_of_the_whole(spark, gated):
    cs = closes()
    cutoff = F.lit(DAY + dt.timedelta(days=249))
    whole = frame(spark, {"A": cs})
    models = t.fit(whole, cutoff, gated)
    full = [tuple(r) for r in t.apply(whole, models, "other").orderBy("d").collect()]
    for n in (250, 300):
        part = frame(spark, {"A": cs[:n]})
        assert [tuple(r) for r in t.apply(part, t.fit(part, cutoff, gated), "other").orderBy("d").collect()] == full[:n]
    assert {r[7] for r in full} >= {"up", "range"} and not any(r[8] for r in full)
    assert all(0 <= r[5] <= 1 for r in full) and (max(r[5] for r in full) > 0.9) == gated


def test_fallback_of_unreliable_models(spark):
    rng = np.random.default_rng(5)
    rows = frame(spark, {"few": closes(60), "none": closes(20), "flat": np.full(200, 5.0), "good": closes(300)})
    models = {r["code"]: r for r in t.fit(rows, F.lit(dt.date(2030, 1, 1))).collect()}
    assert {c: m["flag"] for c, m in models.items()} == {"few": "few_returns", "none": "low_n", "flat": "few_returns", "good": None}
    found = t.apply(rows, t.fit(rows, F.lit(dt.date(2030, 1, 1))), "other").collect()
    assert {r["label"] for r in found if r["code"] != "good"} == {"down"} and all(r["fallback"] == (r["code"] != "good") for r in found)
    assert t.observation_variance(np.log(np.full(5, 3.0))) == 1e-4
    y = np.cumsum(rng.normal(0, 0.02, 500))
    assert t.observation_variance(y) == pytest.approx(4e-4, rel=0.25)


def test_confirmed_ups_one_bar_at_a_time(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for code in "ABC":
        held = False
        for i in range(200):
            label, p, bull = rng.choice(["up", "up", "up", "down", "range"]), float(rng.random()), bool(rng.random() < 0.6)
            d = DAY + dt.timedelta(days=i)
            rows.append((code, d, str(label), p, 2.0 if bull else 1.0, 1.5))
            held = label == "up" and (p >= 0.5 if held else p >= 0.6 and bull)
            want[code, d] = str(label) if label != "up" else "up" if held else "range"
    found = t.confirm_up(spark.createDataFrame(rows, "code string, d date, label string, p double, m20 double, m60 double"), "label", "p").collect()
    assert {(r["code"], r["d"]): r["confirmed"] for r in found} == want
