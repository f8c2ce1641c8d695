"""Tail fits against planted parameters and grids; the rules of the board."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from quaymark.operators import tails as t


def pareto(shape, scale, n, seed=1):
    u = np.random.default_rng(seed).random(n)
    return scale * np.expm1(-shape * np.log(u)) / shape if shape else -scale * np.log(u)


def loglik(y, shape, scale):
    if abs(shape) < 1e-12:
        return -len(y) * math.log(scale) - y.sum() / scale
    inside = 1 + shape * y / scale
    return -np.inf if (inside <= 0).any() else -len(y) * math.log(scale) - (1 / shape + 1) * np.log(inside).sum()


@pytest.mark.parametrize("shape", [-0.3, 0.0, 0.2, 0.6, 1.2])
def test_planted_parameters_come_back(shape):
    found = t.pareto_fit(pareto(shape, 0.02, 20_000))
    assert found == pytest.approx((shape, 0.02), abs=0.03)


@pytest.mark.parametrize("seed", range(6))
def test_no_point_of_a_grid_is_likelier(seed):
    y = pareto([-0.4, -0.1, 0.0, 0.15, 0.5, 0.9][seed], 0.01, 57, seed)
    best = loglik(y, *t.pareto_fit(y))
    grid = [loglik(y, a, b) for a in np.linspace(-0.95, 2, 120) for b in np.geomspace(0.001, 0.1, 120)]
    assert best >= max(grid) - 1e-6


def test_few_or_no_peaks():
    assert t.pareto_fit(np.array([1.0, 2.0])) is None and t.pareto_fit(np.zeros(10)) is None
    assert t.fit_side(np.zeros(2), "left")["flags"] == ["low_n"] and t.fit_side(np.zeros(500), "left")["flags"] == ["alpha_unreliable"]
    assert t.hill_index(np.array([1.0, math.e, math.e**2])) == pytest.approx(1.0)


def test_tail_risk_is_that_of_the_distribution():
    rng = np.random.default_rng(2)
    r = rng.standard_t(4, 200_000) * 0.01
    var, cvar = t.tail_risk(t.fit_side(r, "left"))
    assert var == pytest.approx(np.quantile(r, 0.01), rel=0.03) and cvar == pytest.approx(r[r <= np.quantile(r, 0.01)].mean(), rel=0.05)
    fit = t.fit_side(r, "left")
    assert t.loss_at(fit, 0.2) is None and np.mean(-r > t.loss_at(fit, 0.005)) == pytest.approx(0.005, rel=0.06)


def test_kappa_tells_thin_from_fat():
    rng = np.random.default_rng(3)
    gen = np.random.default_rng(0)
    assert t.kappa(rng.normal(size=5000), gen) < 0.05 < 0.2 < t.kappa(rng.standard_t(1.3, 5000), gen)
    assert t.kappa(np.ones(100), gen) is None and t.kappa(rng.normal(size=40), gen) is None


def test_modelled_mean_and_trust():
    rng = np.random.default_rng(4)
    r = rng.standard_t(3, 2000) * 0.01
    left, right = t.fit_side(r, "left"), t.fit_side(r, "right")
    lt, rt = -r[-r > left["threshold"]], r[r > right["threshold"]]
    want = r.mean() - left["n_exceed"] / 2000 * (left["threshold"] + left["scale"] / (1 - left["shape"]) - np.mean(-r[-r > left["threshold"]]))
    want += right["n_exceed"] / 2000 * (right["threshold"] + right["scale"] / (1 - right["shape"]) - rt.mean())
    assert len(lt) == left["n_exceed"] and t.modelled_mean(r, left, right) == pytest.approx(want)
    assert t.shrink(None, None, 300) == 0.35 and t.shrink(4.0, 0.1, 300) == pytest.approx(0.9) and t.shrink(2.5, 0.0, 126) == pytest.approx(0.25)


@pytest.mark.parametrize(
    "args, leg",
    [
        ((2.4, 0.0, -0.01, []), "avoid"), ((5.0, 0.25, -0.01, []), "avoid"), ((5.0, 0.0, -0.06, [], True), "avoid"), ((3.0, 0.2, -0.03, [], True), "safe"),
        ((5.0, 0.0, -0.01, ["alpha_unreliable"]), "risk"), ((5.0, 0.08, -0.02, []), "safe"), ((3.0, 0.0, -0.01, ["bounded_tail_left"]), "safe"),
        ((3.0, 0.0, -0.01, ["bounded_tail_right"]), "risk"), ((5.0, 0.09, -0.01, []), "risk"), ((5.0, None, -0.021, []), "risk"), ((None, None, None, ["low_n"]), "risk"),
    ],
)
def test_legs(args, leg):
    assert t.barbell_leg(*args) == leg


def test_board_of_rows(spark):
    rng = np.random.default_rng(5)
    day = dt.date(2020, 1, 3)
    rows = [("A", day, (rng.standard_t(3, 756) * 0.02).tolist()), ("B", day, (rng.uniform(-1, 1, 500) * 0.004).tolist()), ("C", day, [0.01] * 5), ("D", day, [])]
    frame = spark.createDataFrame(rows, "code string, d date, past array<double>")
    found = {r["code"]: r for r in t.board(frame, ("B",)).collect()}
    again = {r["code"]: r for r in t.board(frame.repartition(3), ("B",)).collect()}
    assert found == again and found["B"]["leg"] in ("safe", "avoid") and found["C"]["leg"] == "risk" and found["C"]["flags"][0] == "low_n" and found["D"]["n"] == 0
    assert found["A"]["cvar"] < found["A"]["var"] < 0 and 0 < found["A"]["shrink"] <= 1
