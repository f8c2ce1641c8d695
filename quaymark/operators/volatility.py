"""Conditional volatility: fits by likelihood, simulated paths, barriers, value at risk.

The work is dealt by rows, not by code: ``fit_rows`` gives each (code, day) to
be judged its own past returns, ``fit`` works on such rows one by one, and
``paths`` turns each fit into blocks of simulated paths, seeded by code, day and
block, so the result is the same however the rows are dealt.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators.chance import LEAST_VAR, MOST_VAR, filtered, fit_states, t_log_density

LEAST, WINDOW, SEED_ROWS, SHORT = 60, 252, 20, 20
YEAR = math.sqrt(252.0)
#: Returns are fitted in percent, so that the variance is about 1.
PERCENT = 100.0
FIT = (
    "code string, d date, model string, sigma double, omega double, alpha double, gamma double, beta double, nu double, "
    "arch_p double, reliable boolean, flags array<string>, path array<double>, residuals array<double>, recent double"
)


def fit_rows(rows: DataFrame, name: str, when: Column, window: int = WINDOW) -> DataFrame:
    """``code, d, past``: the last ``window`` returns up to each day for which ``when`` holds."""
    past = F.collect_list(name).over(w.last_rows(window))
    return rows.where(F.col(name).isNotNull()).withColumns({"past": past, "_at": when}).where("_at").select("code", "d", "past")


def chi2_above(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution."""
    if x <= 0:
        return 1.0
    value = math.erfc(math.sqrt(x / 2)) if df % 2 else math.exp(-x / 2)
    for k in range(df % 2 or 2, df, 2):
        value += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
    return value


def arch_p(r: np.ndarray, lags: int = 5) -> float | None:
    """Ljung-Box p-value of the squared deviations from the mean."""
    if len(r) < lags + 10:
        return None
    a = np.square(r - r.mean())
    a = a - a.mean()
    total, n = float(a @ a), len(a)
    if total <= 0:
        return None
    q = n * (n + 2) * sum(float(a[k:] @ a[:-k] / total) ** 2 / (n - k) for k in range(1, lags + 1))
    return chi2_above(q, lags)


def _unpack(theta: np.ndarray, base: float, skewed: bool) -> tuple[np.ndarray, ...]:
    """Free parameters (rows of five) as omega, alpha, gamma, beta, nu within their bounds.

    Persistence alpha + gamma / 2 + beta lies below one, alpha and alpha + gamma are not negative, nu is above 2.05.
    """
    s = 1 / (1 + np.exp(-np.clip(theta[:, 1:4], -30, 30)))
    whole = 0.9999 * s[:, 0]
    arch = whole * s[:, 1]
    lean = s[:, 2] if skewed else np.full(len(theta), 0.5)
    alpha = 2 * arch * lean
    omega = base * np.exp(np.clip(theta[:, 0], -12, 12)) * (1 - whole)
    return omega, alpha, 2 * arch * (1 - lean) - alpha, whole - arch, 2.05 + np.exp(np.clip(theta[:, 4], -8, 6))


def _variances(r: np.ndarray, omega: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, beta: np.ndarray, start: float) -> np.ndarray:
    """Variance of each day under each candidate, and of the day after the last: one row a day."""
    square, falling = r * r, r < 0
    out = np.empty((len(r) + 1, len(omega)))
    out[0] = omega + (alpha + gamma / 2 + beta) * start
    for t in range(len(r)):
        out[t + 1] = omega + (alpha + gamma if falling[t] else alpha) * square[t] + beta * out[t]
    return out


def likelihoods(r: np.ndarray, omega: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, beta: np.ndarray, nu: np.ndarray) -> np.ndarray:
    """Log likelihood of ``r`` under each candidate: unit-variance Student t times the conditional deviation."""
    head = np.square(r[:75])
    decay = 0.94 ** np.arange(len(head))
    var = _variances(r, omega, alpha, gamma, beta, float(head @ decay / decay.sum()))[:-1]
    const = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * (v - 2)) for v in nu])
    z = np.square(r)[:, None] / (var * (nu - 2))
    return (const - 0.5 * np.log(var) - (nu + 1) / 2 * np.log1p(z)).sum(axis=0)


def maximise(value, start: np.ndarray, free: np.ndarray, rounds: int = 80, tol: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """Climb ``value`` (of rows of parameters) by quasi-Newton steps; gradient and line search are one batch each."""
    x, k = start.astype(float), len(free)
    step = np.zeros((k, len(x)))
    step[np.arange(k), free] = 1e-4
    inverse, lengths = np.eye(k), 0.5 ** np.arange(-1, 13)

    def slope(at: np.ndarray) -> np.ndarray:
        found = value(np.concatenate([at + step, at - step]))
        return (found[:k] - found[k:]) / 2e-4

    best, grad = float(value(x[None])[0]), slope(x)
    for _ in range(rounds):
        move = inverse @ grad
        if move @ grad <= 0:
            inverse, move = np.eye(k), grad
        move = move * min(1.0, 3.0 / max(float(np.abs(move).max()), 1e-12))
        tries = np.repeat(x[None], len(lengths), axis=0)
        tries[:, free] += lengths[:, None] * move
        found = value(tries)
        found = np.where(np.isfinite(found), found, -np.inf)
        at = int(found.argmax())
        gain = found[at] - best
        if gain <= tol:
            return x, best, bool(np.abs(grad).max() < 0.5 or gain > -1e-3)
        moved, before = lengths[at] * move, grad
        x, best = tries[at], float(found[at])
        grad = slope(x)
        y = before - grad
        if (curve := float(moved @ y)) > 1e-10:
            left = np.eye(k) - np.outer(moved, y) / curve
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / curve
    return x, best, False


def fit_t(r: np.ndarray, skewed: bool, horizon: int = SHORT) -> dict | None:
    """GJR (``skewed``) or plain GARCH with Student-t innovations; None if the climb doesn't settle."""
    p = r * PERCENT
    base = float(np.mean(p * p))
    if base <= 0:
        return None
    free = np.array([0, 1, 2, 3, 4] if skewed else [0, 1, 2, 4])

    def value(theta: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return likelihoods(p, *_unpack(theta, base, skewed))

    starts = np.array([[0.0, a, b, 0.0, c] for a in (1.5, 3.0) for b in (-2.5, -1.0) for c in (1.0, 2.0)])
    first = starts[int(np.nan_to_num(value(starts), nan=-np.inf).argmax())]
    theta, best, settled = maximise(value, first, free)
    if not (settled and math.isfinite(best)):
        return None
    omega, alpha, gamma, beta, nu = (float(x[0]) for x in _unpack(theta[None], base, skewed))
    head = np.square(p[:75])
    decay = 0.94 ** np.arange(len(head))
    var = _variances(p, *(np.array([x]) for x in (omega, alpha, gamma, beta)), float(head @ decay / decay.sum()))[:, 0]
    ahead = [var[-1]]
    for _ in range(horizon - 1):
        ahead.append(omega + (alpha + gamma / 2 + beta) * ahead[-1])
    ahead = np.sqrt(np.clip(np.array(ahead) / PERCENT**2, LEAST_VAR, MOST_VAR))
    return {
        "model": "GJR-t" if skewed else "GARCH-t", "sigma": float(ahead[0]), "omega": omega / PERCENT**2, "alpha": alpha, "gamma": gamma, "beta": beta,
        "nu": nu, "path": ahead, "residuals": p / np.sqrt(var[:-1]), "loglik": best,
    }


def fallback(r: np.ndarray, least: int = LEAST, decay: float = 0.94, horizon: int = SHORT) -> dict | None:
    """Exponentially weighted variance; else the deviation of 20 returns; else the mean absolute deviation from the median."""
    sigma, model = None, "EWMA"
    if len(r) >= least:
        square = r * r
        var = float(square[:SEED_ROWS].mean()) or float(square.mean())
        for x in square:
            var = decay * var + (1 - decay) * x
        sigma = math.sqrt(var)
    elif len(r) >= SHORT and (found := float(np.std(r[-SHORT:], ddof=1))) > 0:
        sigma, model = found, "RV20"
    elif len(r) and (found := float(np.mean(np.abs(r - np.median(r))))) > 0:
        sigma, model = found * 1.253314, "MAD"
    if sigma is None:
        return None
    sigma = math.sqrt(min(max(sigma * sigma, LEAST_VAR), MOST_VAR))
    return {"model": model, "sigma": sigma, "path": np.full(horizon, sigma), "residuals": r / sigma}


def fit_one(r: np.ndarray, models: tuple[str, ...] = ("GJR-t", "GARCH-t"), least: int = LEAST) -> dict:
    """The first model of the chain that settles; few returns go to the fallbacks and are not reliable."""
    r, flags = r[np.isfinite(r)], []
    if len(r) < least:
        found = fallback(r, least) or {"model": "none"}
        return found | {"reliable": False, "flags": ["low_n"], "arch_p": None}
    p = arch_p(r)
    for model in models:
        found = fit_t(r, model == "GJR-t")
        if found is not None:
            return found | {"reliable": True, "flags": flags, "arch_p": p}
        flags.append(model)
    found = fallback(r, least) or {"model": "none"}
    return found | {"reliable": found["model"] in ("EWMA", "RV20"), "flags": flags, "arch_p": p}


def fit(rows: DataFrame, models: tuple[str, ...] = ("GJR-t", "GARCH-t"), least: int = LEAST, tasks: int | None = None) -> DataFrame:
    """The fit of each row of ``code, d, past``: parameters, today's forecast deviation, its path over 20 days, residuals.

    ``recent`` is the yearly deviation of the last five returns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FIT.split(", ")]
        for batch in batches:
            out = []
            for code, d, past in zip(batch["code"], batch["d"], batch["past"], strict=True):
                r = np.asarray(past, float)
                recent = float(np.std(r[-5:], ddof=1)) * YEAR if len(r) >= 5 else None
                out.append({"code": code, "d": d, "recent": recent} | fit_one(r, models, least))
            yield pd.DataFrame({c: [row.get(c) for row in out] for c in names})

    dealt = rows.repartition(tasks, "code", "d") if tasks else rows.repartition("code", "d")
    return dealt.mapInPandas(run, FIT)


def _seed(seed: int, code: str, d: object, block: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(str(code).encode()), zlib.crc32(str(d).encode()), block])


def simulate(fit: dict, horizon: int, n: int, gen: np.random.Generator) -> np.ndarray:
    """``n`` paths of daily returns: residuals drawn again, less their mean; their own variance is carried along where the model has one."""
    residuals = fit["residuals"]
    if residuals is not None and len(residuals) >= 5:
        z = gen.choice(np.asarray(residuals, float) - float(np.mean(residuals)), (n, horizon))
    elif fit.get("nu") and fit["nu"] > 2:
        z = gen.standard_t(fit["nu"], (n, horizon)) / math.sqrt(fit["nu"] / (fit["nu"] - 2))
    else:
        z = gen.standard_normal((n, horizon))
    path = np.asarray(fit["path"], float)
    if fit.get("omega") is None or math.isnan(fit["omega"]):
        return z * np.append(path, np.full(max(0, horizon - len(path)), path[0]))[:horizon]
    out, var = np.empty((n, horizon)), np.full(n, np.clip(fit["sigma"] ** 2, LEAST_VAR, MOST_VAR))
    for t in range(horizon):
        a = out[:, t] = np.sqrt(var) * z[:, t]
        var = np.clip(fit["omega"] + (fit["alpha"] + fit["gamma"] * (a < 0)) * a * a + fit["beta"] * var, LEAST_VAR, MOST_VAR)
    return out


def first_touch(steps: np.ndarray, barrier: float) -> np.ndarray:
    """1 where a path reaches the upper barrier first, -1 the lower, 0 neither."""
    total = np.cumsum(steps, axis=1)
    never = steps.shape[1]
    up, down = (np.where((side := hit).any(axis=1), side.argmax(axis=1), never) for hit in (total >= barrier, total <= -barrier))
    return np.where((up < never) & (up <= down), 1, np.where(down < up, -1, 0))


PATHS = "code string, d date, block int, path int, total double, touch int, vol double, barrier double"


def _blocks(fits: DataFrame, n_paths: int, block: int) -> DataFrame:
    """Each fit once for each block of paths, dealt out."""
    return fits.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, (n_paths - 1) // block))))).repartition("code", "d", "block")


def _path_rows(code: str, d: object, k: int, steps: np.ndarray, barrier: float) -> pd.DataFrame:
    vol = steps.std(axis=1, ddof=1) * YEAR if steps.shape[1] > 1 else np.full(len(steps), np.nan)
    return pd.DataFrame(
        {"code": code, "d": d, "block": k, "path": np.arange(len(steps)), "total": steps.sum(axis=1), "touch": first_touch(steps, barrier), "vol": vol, "barrier": barrier}
    )


def paths(fits: DataFrame, horizon: int, n_paths: int = 2000, mult: float = 1.0, seed: int = 12345, block: int = 250) -> DataFrame:
    """A row for each simulated path of each fit: its total return, which barrier it met first, its volatility.

    Barriers lie ``mult`` times the forecast deviation of ``horizon`` days away, on both sides. Fits without a deviation have no paths.
    """
    fits = fits.where(F.col("sigma") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                path = np.asarray(row["path"], float)
                k, n = row["block"], min(block, n_paths - row["block"] * block)
                scale = math.sqrt(float(np.square(path[:horizon]).sum())) if horizon <= len(path) else row["sigma"] * math.sqrt(horizon)
                steps = simulate(row, horizon, n, _seed(seed, row["code"], row["d"], k))
                yield _path_rows(row["code"], row["d"], k, steps, mult * scale)

    return _blocks(fits, n_paths, block).mapInPandas(run, PATHS)


def outlook(found: DataFrame, fits: DataFrame | None = None, spike: float = 1.2) -> DataFrame:
    """Per code and day: shares of paths that meet a barrier first, quantiles of the totals, share of paths ``spike`` times as volatile as of late."""
    if fits is not None:
        found = found.join(fits.select("code", "d", "recent"), ["code", "d"])
    else:
        found = found.withColumn("recent", F.lit(None).cast("double"))
    share = {"p_up": F.col("touch") == 1, "p_down": F.col("touch") == -1, "p_none": F.col("touch") == 0}
    q = F.percentile("total", F.array(*map(F.lit, (0.05, 0.5, 0.95))))
    grown = F.avg(F.when(F.col("recent") > 0, (F.col("vol") > F.col("recent") * spike).cast("double")))
    out = found.groupBy("code", "d").agg(F.count("*").alias("n"), F.first("barrier").alias("barrier"), *[F.avg(c.cast("double")).alias(k) for k, c in share.items()], q.alias("q"), grown.alias("p_spike"))
    return out.select("code", "d", "n", "barrier", *share, *[F.col("q")[i].alias(k) for i, k in enumerate(("q05", "q50", "q95"))], "p_spike")


def t_below(t: float, nu: float) -> float:
    """Distribution function of Student's t, by the continued fraction of the incomplete beta function."""
    x = nu / (nu + t * t)
    if x >= 1:
        return 0.5
    a, b = nu / 2, 0.5
    turn = x > (a + 1) / (a + b + 2)
    if turn:
        a, b, x = b, a, 1 - x
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = h = 1 / (d if abs(d) > tiny else tiny)
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    value = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) * h / a
    tail = 0.5 * (1 - value if turn else value)
    return tail if t < 0 else 1 - tail


def t_quantile(p: float, nu: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_below(mid, nu) < p else (low, mid)
    return (low + high) / 2


def value_at_risk(sigma: float, nu: float | None, level: float = 0.05) -> tuple[float, float]:
    """Quantile of tomorrow's return at ``level``, and its mean beyond: unit-variance Student t, or normal without ``nu``."""
    if nu is not None and nu > 2:
        q = t_quantile(level, nu)
        scale = math.sqrt(nu / (nu - 2))
        density = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * math.log1p(q * q / nu))
        return sigma * q / scale, -sigma * (nu + q * q) / (nu - 1) * density / level / scale
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < level else (low, mid)
    z = (low + high) / 2
    return sigma * z, -sigma * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / level


def risk(fits: DataFrame, level: float = 0.05) -> DataFrame:
    """``code, d, var, cvar``: value at risk of the next day and the mean loss beyond it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [value_at_risk(s, None if n is None or math.isnan(n) else n, level) for s, n in zip(batch["sigma"], batch["nu"], strict=True)]
            yield pd.DataFrame({"code": batch["code"], "d": batch["d"], "var": [x[0] for x in pairs], "cvar": [x[1] for x in pairs]})

    return fits.where(F.col("sigma") > 0).select("code", "d", "sigma", "nu").mapInPandas(run, "code string, d date, var double, cvar double")


STATES = "code string, d date, mu array<double>, scale array<double>, trans array<double>, now array<double>, reliable boolean"


def fit_hidden(rows: DataFrame, k: int = 3, nu: float = 5.0, least: int = LEAST) -> DataFrame:
    """Hidden states fitted to each row of ``code, d, past``, and their probabilities today; too few or constant returns are not reliable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for code, d, past in zip(batch["code"], batch["d"], batch["past"], strict=True):
                r = np.asarray(past, float)
                r = r[np.isfinite(r)]
                if len(r) < least or np.ptp(r) == 0:
                    out.append((code, d, None, None, None, None, False))
                    continue
                found = fit_states(r, k, nu)
                dens = np.exp(t_log_density(r, found["mu"], found["sigma"], nu))
                now = filtered(dens, found["trans"], found["start"])[0][-1]
                out.append((code, d, found["mu"], found["sigma"], found["trans"].ravel(), now, True))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    return rows.repartition("code", "d").mapInPandas(run, STATES)


def hidden_paths(fits: DataFrame, horizon: int, n_paths: int = 2000, mult: float = 1.0, seed: int = 12345, block: int = 250, nu: float = 5.0) -> DataFrame:
    """``paths`` under hidden states: each path starts in a state drawn from today's probabilities and moves on by the transitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                mu, scale, now = (np.asarray(row[c], float) for c in ("mu", "scale", "now"))
                moves = np.cumsum(np.asarray(row["trans"], float).reshape(len(mu), -1), axis=1)
                b, n = row["block"], min(block, n_paths - row["block"] * block)
                gen = _seed(seed, row["code"], row["d"], b)
                state = np.minimum(np.searchsorted(np.cumsum(now / now.sum()), gen.random(n), "right"), len(mu) - 1)
                steps = np.empty((n, horizon))
                for t in range(horizon):
                    steps[:, t] = mu[state] + scale[state] * gen.standard_t(nu, n)
                    state = np.minimum((gen.random(n)[:, None] >= moves[state]).sum(axis=1), len(mu) - 1)
                yield _path_rows(row["code"], row["d"], b, steps, mult * float(now @ scale) * math.sqrt(horizon))

    return _blocks(fits.where("reliable"), n_paths, block).mapInPandas(run, PATHS)
