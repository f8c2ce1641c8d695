"""Volatility fits, paths and barriers against grids, closed forms and other dealings of the rows."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from quaymark.operators import volatility as v


def returns(n=252, seed=1, omega=2e-6, alpha=0.05, gamma=0.1, beta=0.85, nu=6.0):
    rng = np.random.default_rng(seed)
    var, out = omega / (1 - alpha - gamma / 2 - beta), []
    for z in rng.standard_t(nu, n) / math.sqrt(nu / (nu - 2)):
        out.append(math.sqrt(var) * z)
        var = omega + (alpha + gamma * (z < 0)) * out[-1] ** 2 + beta * var
    return np.array(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("skewed", [True, False])
def test_no_point_of_a_grid_is_likelier(seed, skewed):
    r = returns(seed=seed)
    found = v.fit_t(r, skewed)
    p = r * 100
    omega, alpha, lean, whole, nu = (
        x.ravel() for x in np.meshgrid(np.geomspace(1e-4, 2, 9), np.linspace(0, 0.3, 7), np.linspace(0, 1, 5) if skewed else [0.0], np.linspace(0.3, 0.995, 9), [2.5, 4, 6, 10, 40])
    )
    gamma = lean * 0.4
    beta = whole - alpha - gamma / 2
    ok = beta >= 0
    grid = v.likelihoods(p, omega[ok], alpha[ok], gamma[ok], beta[ok], nu[ok])
    assert found["loglik"] >= grid.max() - 1e-3
    assert found["alpha"] >= 0 and found["alpha"] + found["gamma"] >= -1e-12 and found["beta"] >= 0
    assert found["alpha"] + found["gamma"] / 2 + found["beta"] < 1 and found["nu"] > 2 and (skewed or found["gamma"] == pytest.approx(0))


def test_likelihood_one_day_at_a_time():
    r = returns(40) * 100
    omega, alpha, gamma, beta, nu = 0.05, 0.06, 0.1, 0.8, 5.0
    decay = [0.94**i for i in range(40)]
    var = omega + (alpha + gamma / 2 + beta) * sum(d * x * x for d, x in zip(decay, r, strict=True)) / sum(decay)
    total = 0.0
    for x in r:
        z = x / math.sqrt(var)
        total += math.lgamma(3) - math.lgamma(2.5) - 0.5 * math.log(math.pi * 3 * var) - 3 * math.log(1 + z * z / 3)
        var = omega + (alpha + (gamma if x < 0 else 0)) * x * x + beta * var
    assert v.likelihoods(r, *(np.array([x]) for x in (omega, alpha, gamma, beta, nu)))[0] == pytest.approx(total)


def test_long_series_give_back_their_parameters():
    found = v.fit_t(returns(8000, 3), True)
    assert found["beta"] == pytest.approx(0.85, abs=0.06) and found["gamma"] == pytest.approx(0.1, abs=0.05) and found["nu"] == pytest.approx(6, abs=1.2)


def test_chain_of_models():
    r = returns(300)
    assert v.fit_one(r)["model"] == "GJR-t" and v.fit_one(r, ("GARCH-t",))["model"] == "GARCH-t"
    r *= 3
    few = v.fit_one(r[:30])
    assert few["model"] == "RV20" and not few["reliable"] and few["flags"] == ["low_n"] and few["sigma"] == pytest.approx(np.std(r[10:30], ddof=1))
    mad = v.fit_one(r[:9])
    assert mad["model"] == "MAD" and mad["sigma"] == pytest.approx(1.253314 * np.mean(np.abs(r[:9] - np.median(r[:9])))) and v.fit_one(np.zeros(5))["model"] == "none"
    ewma = v.fit_one(r, ())
    var = np.mean(r[:20] ** 2)
    for x in r:
        var = 0.94 * var + 0.06 * x * x
    assert ewma["model"] == "EWMA" and ewma["reliable"] and ewma["sigma"] == pytest.approx(math.sqrt(np.clip(var, 2.5e-5, 2e-2)))
    assert v.fit_one(np.zeros(100))["sigma"] == pytest.approx(math.sqrt(2.5e-5))


def test_distributions():
    assert v.chi2_above(11.0705, 5) == pytest.approx(0.05, abs=1e-5) and v.chi2_above(5.9915, 2) == pytest.approx(0.05, abs=1e-5) and v.chi2_above(9.4877, 4) == pytest.approx(0.05, abs=1e-5)
    for nu, q in ((1, -6.3138), (3, -2.3534), (5, -2.0150), (30, -1.6973)):
        assert v.t_quantile(0.05, nu) == pytest.approx(q, abs=1e-4)
    assert v.t_below(1.3, 7) == pytest.approx(1 - v.t_below(-1.3, 7))
    var, cvar = v.value_at_risk(0.02, None)
    assert var == pytest.approx(-0.02 * 1.644854, abs=1e-6) and cvar == pytest.approx(-0.02 * 2.062713, abs=1e-6)
    x = np.random.default_rng(1).standard_t(5, 2_000_000) / math.sqrt(5 / 3)
    var, cvar = v.value_at_risk(1.0, 5.0)
    assert var == pytest.approx(np.quantile(x, 0.05), abs=0.01) and cvar == pytest.approx(x[x <= var].mean(), abs=0.02)


def test_arch_test_tells_clusters_from_none():
    rng = np.random.default_rng(5)
    assert v.arch_p(returns(1500, 2, alpha=0.25, gamma=0.0, beta=0.7)) < 0.01
    assert np.mean([v.arch_p(rng.normal(size=300)) < 0.05 for _ in range(400)]) < 0.09
    assert v.arch_p(np.ones(50)) is None and v.arch_p(np.ones(3)) is None


def test_first_touch():
    steps = np.array([[0.5, 0.6, -5], [-0.4, -0.7, 9], [0.1, 0.1, 0.1], [1.0, 0, 0], [0, 0, -1.0]])
    assert v.first_touch(steps, 1.0).tolist() == [1, -1, 0, 1, -1]


def test_barrier_of_constant_deviation(spark):
    """Two-sided first passage of a walk: by symmetry equal sides, and no touch as the sine series says."""
    sigma, horizon = 0.01, 64
    fit = {"residuals": None, "path": np.full(horizon, sigma), "sigma": sigma, "nu": None}
    touch = v.first_touch(v.simulate(fit, horizon, 60_000, np.random.default_rng(3)), sigma * math.sqrt(horizon))
    # Discrete steps overshoot by 0.5826 deviations on average, so the barrier is that much wider.
    wide = 1 + 0.5826 / math.sqrt(horizon)
    none = sum(4 / math.pi * (-1) ** k / (2 * k + 1) * math.exp(-((2 * k + 1) ** 2) * math.pi**2 / (8 * wide**2)) for k in range(20))
    assert np.mean(touch == 0) == pytest.approx(none, abs=0.01) and np.mean(touch == 1) == pytest.approx(np.mean(touch == -1), abs=0.01)


def test_paths_do_not_depend_on_the_dealing(spark):
    r = returns(300)
    rows = spark.createDataFrame([("A", dt.date(2020, 1, 3), r.tolist()), ("B", dt.date(2020, 1, 3), r[:40].tolist()), ("C", dt.date(2020, 1, 3), [0.0, 0.0])], "code string, d date, past array<double>")
    fits = v.fit(rows).cache()
    assert {x["code"]: x["model"] for x in fits.collect()} == {"A": "GJR-t", "B": "RV20", "C": "none"}
    held = fits.repartition(7)
    one = sorted(map(tuple, v.paths(fits, 5, 600, block=100).collect()))
    two = sorted(map(tuple, v.paths(held, 5, 600, block=100).coalesce(1).collect()))
    assert one == two and len(one) == 1200
    board = {x["code"]: x for x in v.outlook(v.paths(fits, 5, 600, block=100), fits).collect()}
    totals = np.array([x[4] for x in one if x[0] == "A"])
    assert board["A"]["q05"] == pytest.approx(np.quantile(totals, 0.05)) and board["A"]["p_up"] + board["A"]["p_down"] + board["A"]["p_none"] == pytest.approx(1)
    assert board["A"]["p_up"] == pytest.approx(np.mean([x[5] == 1 for x in one if x[0] == "A"]))
    risk = {x["code"]: x for x in v.risk(fits).collect()}
    assert risk["A"]["cvar"] < risk["A"]["var"] < 0 and set(risk) == {"A", "B"}


def test_hidden_paths_follow_the_states(spark):
    rng = np.random.default_rng(4)
    r = np.concatenate([rng.normal(0.0, 0.004, 150), rng.normal(0.0, 0.03, 100)])
    rows = spark.createDataFrame([("A", dt.date(2020, 1, 3), r.tolist()), ("B", dt.date(2020, 1, 3), r[:150].tolist()), ("C", dt.date(2020, 1, 3), [0.1])], "code string, d date, past array<double>")
    fits = v.fit_hidden(rows).cache()
    found = {x["code"]: x for x in fits.collect()}
    assert not found["C"]["reliable"] and sum(found["A"]["now"]) == pytest.approx(1)
    board = {x["code"]: x for x in v.outlook(v.hidden_paths(fits, 10, 1000)).collect()}
    assert set(board) == {"A", "B"} and board["A"]["q05"] < 3 * board["B"]["q05"] < 0
