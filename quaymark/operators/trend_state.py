"""Trend regimes from a filtered slope, with a volatility gate: parameters are frozen at a cutoff and applied causally.

``fit`` gives a row of parameters for each code from its bars up to the cutoff;
``apply`` joins them to the code's rows and filters those from the first on, so a
label rests on earlier bars and on the frozen parameters only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.operators.chance import fit_states, t_log_density
from quaymark.operators.machines import by_code

#: Noise of level and slope in units of the observation's, and the first variances.
LEVEL, SLOPE, START = 0.02, 0.001, (100.0, 10.0)
WINDOW, LEAST, APART = 756, 80, 1.15
MODEL = "code string, obs_var double, mu array<double>, scale array<double>, trans array<double>, reliable boolean, flag string"
FRAME = "code string, d date, slope double, z double, p_up double, p_rough double, candidate string, label string, fallback boolean"


def observation_variance(log_price: np.ndarray) -> float:
    """Of daily moves: the larger of the median deviation's and half the standard deviation, squared; a default under ten moves."""
    move = np.diff(log_price[np.isfinite(log_price)])
    if len(move) < 10:
        return 1e-4
    spread = float(np.median(np.abs(move - np.median(move))))
    return max(1.4826 * spread, 0.5 * float(np.std(move, ddof=1)), 1e-4) ** 2


def filtered_slope(log_price: np.ndarray, obs_var: float, level: float = LEVEL, slope: float = SLOPE) -> tuple[np.ndarray, np.ndarray]:
    """Slope of a local linear trend and its variance after each price; a missing price lets the variance grow."""
    seen = log_price[np.isfinite(log_price)]
    x, g = float(seen[0]) if len(seen) else 0.0, 0.0
    a, b, c = START[0], 0.0, START[1]  # covariance in units of the observation's variance, so that gains don't depend on it
    slopes, variances = np.empty(len(log_price)), np.empty(len(log_price))
    for i, y in enumerate(log_price):
        x, a, b, c = x + g, a + 2 * b + c + level, b + c, c + slope
        if math.isfinite(y):
            k, m = a / (a + 1), b / (a + 1)
            miss = y - x
            x, g = x + k * miss, g + m * miss
            a, b, c = (1 - k) ** 2 * a + k * k, (1 - k) * (b - m * a) + k * m, m * m * a - 2 * m * b + c + m * m
        slopes[i], variances[i] = g, max(c * obs_var, 1e-12)
    return slopes, variances


def confirmed(candidates: list[str], days: int = 3) -> list[str]:
    """A new state after ``days`` equal candidates in a row, range before any."""
    state, waiting, n, out = "range", "", 0, []
    for c in candidates:
        n = 0 if c == state else n + 1 if c == waiting else 1
        waiting = "" if c == state else c
        if n >= days:
            state, waiting, n = c, "", 0
        out.append(state)
    return out


def normal_below(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])


def rough_probability(returns: np.ndarray, mu: np.ndarray, scale: np.ndarray, trans: np.ndarray, nu: float = 5.0) -> np.ndarray:
    """Probability of the state of larger scale after each return, from even odds; a missing return changes nothing."""
    now, high, out = np.full(len(mu), 1 / len(mu)), int(np.argmax(scale)), np.empty(len(returns))
    dens = np.exp(t_log_density(returns, mu, scale, nu))
    for i, r in enumerate(returns):
        if math.isfinite(r):
            ahead = (now @ trans) * dens[i]
            now = ahead / ahead.sum()
        out[i] = now[high]
    return out


def fit(rows: DataFrame, cutoff: Column, gated: bool = True, nu: float = 5.0) -> DataFrame:
    """One row of parameters a code from the ``WINDOW`` closes up to ``cutoff``.

    With a gate, two states of volatility are fitted; fewer than ``LEAST`` returns, or scales less than ``APART`` times apart, make
    the model unreliable, and so do fewer than 40 closes without one.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = np.log(g["close"].to_numpy(float))[-WINDOW:]
        out = {"code": g["code"].iloc[0], "obs_var": observation_variance(y), "mu": None, "scale": None, "trans": None, "reliable": len(g) >= 40, "flag": None if len(g) >= 40 else "low_n"}
        if gated and out["reliable"]:
            r = np.diff(y)
            if len(r) < LEAST or np.ptp(r) == 0:
                out |= {"reliable": False, "flag": "few_returns"}
            else:
                found = fit_states(r, 2, nu)
                apart = float(found["sigma"].max() / found["sigma"].min())
                out |= {"mu": found["mu"], "scale": found["sigma"], "trans": found["trans"].ravel(), "reliable": apart >= APART, "flag": None if apart >= APART else "not_apart"}
        return pd.DataFrame({k: [v] for k, v in out.items()})

    return by_code(rows.where((F.col("close") > 0) & (F.col("d") <= cutoff)).select("code", "d", "close"), run, MODEL)


def apply(rows: DataFrame, models: DataFrame, fallback: str, up: float = 0.72, rough_up: float = 0.80, days: int = 3, nu: float = 5.0) -> DataFrame:
    """``code, d, slope, z, p_up, p_rough, candidate, label, fallback``: up or down where the slope's probability reaches ``up`` (``rough_up`` while
    the rough state is likelier), confirmed over ``days``; codes without a reliable model have the labels of column ``fallback``."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first = g.iloc[0]
        out = pd.DataFrame({"code": g["code"], "d": g["d"], "slope": None, "z": None, "p_up": None, "p_rough": None, "candidate": None, "label": g["_other"], "fallback": True})
        if not (isinstance(first["reliable"], (bool, np.bool_)) and first["reliable"]):
            return out
        close = g["close"].to_numpy(float)
        y = np.log(np.where(close > 0, close, np.nan))
        slope, var = filtered_slope(y, first["obs_var"])
        z = slope / np.sqrt(var)
        p, rough, need = normal_below(z), np.zeros(len(g)), np.full(len(g), up)
        if first["mu"] is not None:
            mu, scale = (np.asarray(first[c], float) for c in ("mu", "scale"))
            rough = rough_probability(np.append(np.nan, np.diff(y)), mu, scale, np.asarray(first["trans"], float).reshape(len(mu), -1), nu)
            need = np.where(rough >= 0.5, rough_up, up)
        candidate = np.where(1 - p >= need, "down", np.where(p >= need, "up", "range"))
        return out.assign(slope=slope, z=z, p_up=p, p_rough=rough, candidate=candidate, label=confirmed(candidate.tolist(), days), fallback=False)

    joined = rows.select("code", "d", "close", F.col(fallback).alias("_other")).join(models, "code", "left")
    return by_code(joined, run, FRAME)


def confirm_up(rows: DataFrame, label: str, p_up: str, enter: float = 0.60, leave: float = 0.5) -> DataFrame:
    """Add ``confirmed``: an up of ``label`` counts from where ``p_up`` reaches ``enter`` with m20 over m60 until it falls under ``leave``; else it is range.

    A state with two thresholds: the last row beyond either decides, within each run of ups.
    """
    order = Window.partitionBy("code").orderBy("d")
    is_up = F.coalesce(F.col(label) == "up", F.lit(False))
    rows = rows.withColumn("_run", F.sum((~is_up).cast("int")).over(order))
    p = F.coalesce(F.col(p_up), F.lit(0.0))
    mark = F.when(p < leave, False).when((p >= enter) & F.coalesce(F.col("m20") > F.col("m60"), F.lit(False)), True)
    held = F.last(F.when(is_up, mark), ignorenulls=True).over(Window.partitionBy("code", "_run").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    out = F.when(~is_up, F.col(label)).when(F.coalesce(held, F.lit(False)), "up").otherwise("range")
    return rows.withColumn("confirmed", out).drop("_run")
