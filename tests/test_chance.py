"""Forecasts, fits and hidden states against plain numpy."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from quaymark.operators import chance


def test_t_distribution():
    x = np.linspace(-60, 60, 400_001)
    density = np.exp(chance.t_log_density(x, np.zeros(1), np.ones(1), 5.0))[:, 0]
    for t in (-2.0, 0.0, 0.7, 3.0):
        assert chance.t5_cdf(np.array([t]))[0] == pytest.approx(np.trapezoid(density[x <= t], x[x <= t]), abs=1e-4)


def test_filter_equals_all_paths():
    """The likelihood and the last state's probabilities from every path of states."""
    rng = np.random.default_rng(1)
    dens, start = rng.uniform(0.1, 1, (6, 3)), np.array([0.5, 0.3, 0.2])
    trans = rng.uniform(0.1, 1, (3, 3))
    trans /= trans.sum(axis=1, keepdims=True)
    ends = np.zeros(3)
    for path in itertools.product(range(3), repeat=6):
        p = start[path[0]] * dens[0, path[0]]
        for i in range(1, 6):
            p *= trans[path[i - 1], path[i]] * dens[i, path[i]]
        ends[path[-1]] += p
    alpha, scale = chance.filtered(dens, trans, start)
    assert np.prod(scale) == pytest.approx(ends.sum())
    np.testing.assert_allclose(alpha[-1], ends / ends.sum())


def test_fit_finds_the_states():
    rng = np.random.default_rng(2)
    r = np.concatenate([rng.normal(0.0005, 0.004, 150), rng.normal(-0.002, 0.03, 100)])
    fit = chance.fit_states(r, 2)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(fit["liks"]))
    assert fit["sigma"][0] < 0.006 < 0.015 < fit["sigma"][1] and (np.diag(fit["trans"]) > 0.9).all()
    assert chance.state_names(np.array([0.0, 0.01, -0.01]), np.array([1.0, 2.0, 3.0])) == ["calm", "volatile_reversal", "bear_grind"]


def test_crossfit_learns_from_earlier_months_only(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2))
    y = rng.random(240) < 1 / (1 + np.exp(-(0.5 + x @ [1.5, -1.0])))
    month = [f"m{i // 60}" for i in range(240)]
    df = spark.createDataFrame([(i, m, float(a), float(b), bool(t)) for i, (m, (a, b), t) in enumerate(zip(month, x, y, strict=True))], "i long, month string, a double, b double, y boolean")
    found = {r["i"]: r["p"] for r in chance.crossfit(df, ["a", "b"], "y", "month").collect()}
    assert all(found[i] is None for i in range(60))
    for k in (1, 2, 3):
        design, beta = np.hstack([np.ones((60 * k, 1)), x[: 60 * k]]), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ beta))
            grad = design.T @ (y[: 60 * k] - p) - [0, beta[1], beta[2]]
            beta += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-9, 1, 1]), grad)
        for i in range(60 * k, 60 * k + 60):
            assert found[i] == pytest.approx(1 / (1 + math.exp(-(beta[0] + x[i] @ beta[1:]))), abs=1e-6)


def test_bootstrap_draws_whole_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [("g", f"b{i % 12:02}", float(v)) for i, v in enumerate(rng.normal(1, 1, 600))]
    found = chance.bootstrap_mean(spark.createDataFrame(rows, "g string, b string, v double"), "g", "b", "v").first()
    values = np.array([v for _, _, v in rows])
    sums = np.array([values[k::12].sum() for k in range(12)])
    drawn = np.random.default_rng(42).integers(0, 12, (400, 12))
    low, high = np.quantile(sums[drawn].sum(axis=1) / 600, [0.025, 0.975])
    assert (found["mean"], found["low"], found["high"]) == (pytest.approx(values.mean()), pytest.approx(low), pytest.approx(high))
