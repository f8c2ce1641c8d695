"""Distributions of returns: baseline scores, moving volatility, bootstrap intervals, expanding fits, hidden states."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators.machines import by_code

# Coefficients of the normal distribution's approximation (error under 1e-7) and the variance's limits.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
LEAST_VAR, MOST_VAR = 2.5e-5, 2e-2


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a polynomial."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    upper = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1 + upper)).otherwise(0.5 * (1 - upper))


def baseline_scores(rows: DataFrame, name: str, days: int = 60, least: int = 40) -> DataFrame:
    """Add ``mu, sd, nll, pit``: the normal forecast from the ``days`` rows before, today excluded, and how today fits it."""
    past = w.rows_before(days)
    enough = F.count(name).over(past) >= least
    rows = rows.withColumns({"mu": F.when(enough, F.avg(name).over(past)), "sd": F.when(enough, F.stddev_samp(name).over(past))})
    z = (F.col(name) - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))
    rows = rows.withColumn("_z", z)
    nll = F.log("sd") + 0.5 * math.log(2 * math.pi) + 0.5 * F.col("_z") * F.col("_z")
    return rows.withColumns({"nll": nll, "pit": F.when(F.col("_z").isNotNull(), normal_cdf(F.col("_z")))}).drop("_z")


def moving_variance(rows: DataFrame, name: str, decay: float = 0.94, seed: int = 20, least: int = 60) -> DataFrame:
    """``code, d, var, method`` of each row's forecast variance: exponentially weighted from ``least`` returns on, seeded by
    the mean square of the first ``seed``; before that the mean of 20 squares; before that the absolute deviation; within limits."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r = g[name].to_numpy(float)
        known = np.flatnonzero(~np.isnan(r))
        var, method, now = np.full(len(r), np.nan), np.full(len(r), None, object), np.nan
        for k, i in enumerate(known, 1):
            square = r[i] * r[i]
            if k == seed:
                now = float(np.mean(np.square(r[known[:k]])))
            elif k > seed:
                now = decay * now + (1 - decay) * square
            if k >= least:
                var[i], method[i] = now, "ewma"
            elif k >= seed:
                var[i], method[i] = float(np.mean(np.square(r[known[k - seed : k]]))), "rv20"
            else:
                var[i], method[i] = (1.2533 * float(np.mean(np.abs(r[known[:k]])))) ** 2, "mad"
        return pd.DataFrame({"code": g["code"], "d": g["d"], "var": np.clip(var, LEAST_VAR, MOST_VAR), "method": method})[~np.isnan(var)]

    return by_code(rows.select("code", "d", name), run, "code string, d date, var double, method string")


def bootstrap_mean(rows: DataFrame, group: str, block: str, name: str, times: int = 400, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Per group: ``n, mean, low, high`` of a mean, its interval from whole blocks drawn again.

    The rows are added up by block first, so a group's task holds one row a block.
    """
    sums = rows.where(F.col(name).isNotNull()).groupBy(group, block).agg(F.count("*").alias("n"), F.sum(name).alias("s"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(block, ignore_index=True)
        n, s = g["n"].to_numpy(float), g["s"].to_numpy(float)
        drawn = np.random.default_rng(seed).integers(0, len(g), (times, len(g)))
        means = s[drawn].sum(axis=1) / n[drawn].sum(axis=1)
        low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame({group: [g[group][0]], "n": [int(n.sum())], "mean": [s.sum() / n.sum()], "low": [low], "high": [high]})

    return sums.groupBy(group).applyInPandas(run, f"{group} string, n long, mean double, low double, high double")


def promotion_race(rows: DataFrame, least: int = 20) -> DataFrame:
    """Per side and window, the winner of several rules (rule, side, win, month, hit): those of ``least`` scored rows whose
    interval of the hit rate lies above a half, best rate, then most rows, then name."""
    keyed = rows.withColumn("key", F.concat_ws("|", "rule", "side", "win")).withColumn("h", F.col("hit").cast("double"))
    found = bootstrap_mean(keyed, "key", "month", "h")
    parts = F.split("key", r"\|")
    rated = found.select(parts[0].alias("rule"), parts[1].alias("side"), parts[2].alias("win"), "n", "mean", ((F.col("n") >= least) & (F.col("low") > 0.5)).alias("passed"))
    best = rated.where("passed").groupBy("side", "win").agg(F.min(F.struct(-F.col("mean"), -F.col("n"), F.col("rule"))).alias("b"))
    return rated.join(best.select("side", "win", F.col("b.rule").alias("winner")), ["side", "win"], "left")


def crossfit(rows: DataFrame, features: list[str], label: str, month: str, least: int = 30, ridge: float = 1.0, steps: int = 12) -> DataFrame:
    """``rows`` with ``p``: each month's logistic model learns from all months before it.

    Newton steps of all months' models together: a step adds up gradients and
    curvatures of each month's model over the rows of all months before it, so a row is read once for
    each later month in every step; models differ, so no sum serves two of them. Months without ``least`` rows of both classes before get NULL.
    """
    k = len(features) + 1
    known = rows.where(F.col(label).isNotNull())
    x = [F.lit(1.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in features]]
    months = sorted(r[0] for r in known.select(month).distinct().collect())  # a few hundred at most
    counts = {r[month]: (r["n"], r["pos"]) for r in known.groupBy(month).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).collect()}
    beta = {m: np.zeros(k) for m in months}
    able = []
    n = pos = 0
    for m in months:
        if n >= least and 0 < pos < n:
            able.append(m)
        n, pos = n + counts[m][0], pos + counts[m][1]
    data = known.select(F.col(month).alias("m"), F.col(label).cast("double").alias("y"), F.array(*x).alias("x"))
    spark = rows.sparkSession
    for _ in range(steps):
        if not able:
            break
        models = spark.createDataFrame([(m, beta[m].tolist()) for m in able], "model string, b array<double>")
        met = data.join(F.broadcast(models), F.col("m") < F.col("model"))
        score = sum((F.col("x")[i] * F.col("b")[i] for i in range(1, k)), F.col("x")[0] * F.col("b")[0])
        p = 1 / (1 + F.exp(-score))
        sums = met.select("model", "x", (F.col("y") - p).alias("e"), (p * (1 - p)).alias("v")).groupBy("model").agg(
            F.array(*[F.sum(F.col("x")[i] * F.col("e")) for i in range(k)]).alias("g"),
            F.array(*[F.sum(F.col("x")[i] * F.col("x")[j] * F.col("v")) for i in range(k) for j in range(k)]).alias("h"),
        )
        move = 0.0
        penalty = np.diag([1e-9] + [ridge] * (k - 1))
        for r in sums.collect():
            step = np.linalg.solve(np.array(r["h"]).reshape(k, k) + penalty, np.array(r["g"]) - penalty @ beta[r["model"]])
            beta[r["model"]] = beta[r["model"]] + step
            move = max(move, float(np.abs(step).max()))
        if move < 1e-9:
            break
    models = spark.createDataFrame([(m, beta[m].tolist()) for m in able], f"{month} string, _beta array<double>")
    score = sum((x[i] * F.col("_beta")[i] for i in range(1, k)), F.col("_beta")[0])
    return rows.join(F.broadcast(models), month, "left").withColumn("p", F.when(F.col("_beta").isNotNull(), 1 / (1 + F.exp(-score)))).drop("_beta")


def t_log_density(x: np.ndarray, mu: np.ndarray, sigma: np.ndarray, nu: float) -> np.ndarray:
    """Log density of each value in each state."""
    z = (x[:, None] - mu) / sigma
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - np.log(sigma) - (nu + 1) / 2 * np.log1p(z * z / nu)


def filtered(dens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities after each value, and the likelihood factors; scaled, so that nothing underflows."""
    alpha, scale = np.empty_like(dens), np.empty(len(dens))
    now = start
    for i, d in enumerate(dens):
        now = (now if i == 0 else now @ trans) * d
        scale[i] = now.sum()
        now = alpha[i] = now / scale[i]
    return alpha, scale


def fit_states(r: np.ndarray, k: int = 3, nu: float = 5.0, rounds: int = 80, tol: float = 1e-6) -> dict:
    """Hidden states of Student-t returns by expectation maximisation, in order of their scale."""
    size = np.abs(r)
    edges = np.quantile(size, np.linspace(0, 1, k + 1))
    at = np.clip(np.searchsorted(edges, size, side="right") - 1, 0, k - 1)
    mu = np.array([r[at == j].mean() if (at == j).any() else 0.0 for j in range(k)])
    sigma = np.array([max(r[at == j].std(ddof=1), 1e-4) if (at == j).sum() > 1 else 1e-4 for j in range(k)])
    trans, start, last, liks = np.where(np.eye(k) > 0, 0.9, 0.1 / (k - 1)), np.full(k, 1 / k), -np.inf, []
    floor = max(0.15 * float(np.median(size)), 1e-4)
    for _ in range(rounds):
        logs = t_log_density(r, mu, sigma, nu)
        top = logs.max(axis=1, keepdims=True)
        dens = np.exp(logs - top)
        alpha, scale = filtered(dens, trans, start)
        liks.append(float(np.log(scale).sum() + top.sum()))
        beta = np.ones_like(dens)
        for i in range(len(r) - 2, -1, -1):
            beta[i] = trans @ (dens[i + 1] * beta[i + 1]) / scale[i + 1]
        gamma = alpha * beta
        joint = np.einsum("ti,ij,tj->ij", alpha[:-1], trans, dens[1:] * beta[1:] / scale[1:, None])
        start = gamma[0] / gamma[0].sum()
        trans = np.maximum(joint / joint.sum(axis=1, keepdims=True), 1e-3)
        trans /= trans.sum(axis=1, keepdims=True)
        mass = gamma.sum(axis=0)
        mu = gamma.T @ r / mass
        sigma = np.maximum(np.sqrt(np.einsum("tk,tk->k", gamma, np.square(r[:, None] - mu)) / mass), floor)
        order = np.argsort(sigma, kind="stable")
        mu, sigma, start, trans = mu[order], sigma[order], start[order], trans[np.ix_(order, order)]
        if abs(liks[-1] - last) < tol:
            break
        last = liks[-1]
    return {"mu": mu, "sigma": sigma, "trans": trans, "start": start, "liks": liks}


def t5_cdf(t: np.ndarray) -> np.ndarray:
    """Distribution function of Student's t with five degrees of freedom, in closed form."""
    a = np.arctan(t / math.sqrt(5))
    c = np.cos(a)
    return 0.5 + (a + np.sin(a) * (c + 2 / 3 * c**3)) / math.pi


def state_names(mu: np.ndarray, sigma: np.ndarray) -> list[str]:
    """calm is the least scale; of the others the lower mean is bear_grind, the higher volatile_reversal."""
    order = sorted(range(len(mu)), key=lambda i: (sigma[i], i))
    rest = sorted(order[1:], key=lambda i: (mu[i], sigma[i], i))
    names = [""] * len(mu)
    for i, name in zip([order[0], *rest], ["calm", "bear_grind", *["volatile_reversal"] * (len(mu) - 2)], strict=True):
        names[i] = name
    return names


def monthly_states(rows: DataFrame, name: str, window: int = 252, least: int = 60, warm: int = 40) -> DataFrame:
    """``code, d, month, state, p_state, cdf, switch``: each month is scored under a model fitted on the returns before it.

    The filter warms up on the ``warm`` returns before the month and is carried
    from day to day; cdf is the predictive distribution at the day's return, and a
    switch is up from 0.9 and down to 0.1. Months with fewer than ``least`` returns before them are left out. Each
    code's days are one task, and its months are fitted one after another.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g[g[name].notna()].reset_index(drop=True)
        r, month = g[name].to_numpy(float), pd.to_datetime(g["d"]).dt.strftime("%Y-%m").to_numpy()
        out = []
        for m in np.unique(month):
            days = np.flatnonzero(month == m)
            before = r[max(0, days[0] - window) : days[0]]
            if len(before) < least:
                continue
            fit = fit_states(before)
            names = state_names(fit["mu"], fit["sigma"])
            both = np.concatenate((before[-warm:], r[days]))
            dens = np.exp(t_log_density(both, fit["mu"], fit["sigma"], 5.0))
            alpha, _ = filtered(dens, fit["trans"], np.full(len(names), 1 / len(names)))
            ahead = alpha[len(both) - len(days) - 1 : -1] @ fit["trans"]
            cdf = (ahead * t5_cdf((r[days][:, None] - fit["mu"]) / fit["sigma"])).sum(axis=1)
            now = alpha[-len(days) :]
            for i, day in enumerate(days):
                best = int(now[i].argmax())
                side = "up" if cdf[i] >= 0.9 else "down" if cdf[i] <= 0.1 else None
                out.append((g["code"][day], g["d"][day], m, names[best], float(now[i, best]), float(cdf[i]), side))
        return pd.DataFrame(out, columns=["code", "d", "month", "state", "p_state", "cdf", "switch"])

    return by_code(rows.select("code", "d", name), run, "code string, d date, month string, state string, p_state double, cdf double, switch string")
