"""Tails of returns: peaks over a threshold, kappa of sums, the mean with modelled tails, and the leg of a barbell.

Works on rows of ``code, d, past`` (``volatility.fit_rows``), each by itself, so codes and days spread over tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LOOKBACK, LEAST, SHORT = 756, 120, 252
QUANTILE, EXCEED, LEVEL = 0.925, 25, 0.99
SUM_OF, DRAWS = 30, 2000
#: Limits of the legs.
FAT, THIN, KAPPA_FAT, KAPPA_SAFE, LOSS_AVOID, LOSS_SAFE = 2.5, 4.0, 0.25, 0.08, 0.06, 0.02


def pareto_fit(y: np.ndarray) -> tuple[float, float] | None:
    """Shape and scale of the generalised Pareto distribution of ``y`` > 0 by maximum likelihood.

    With t = shape / scale given, the likeliest shape is the mean of log(1 + t y), so one number is searched: over a
    grid on both sides of 0, then within the best cell. Shapes under -1, where the likelihood has no bound, are left out.
    """
    n, top = len(y), float(y.max(initial=0.0))
    if n < 3 or top <= 0:
        return None
    mean = float(y.mean())

    def profile(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            shape = np.log1p(np.outer(t, y)).mean(axis=1)
            value = np.where((np.abs(t) * top < 1e-9), -np.log(mean) - 1, -np.log(shape / t) - shape - 1)
        return np.where((shape > -1) & np.isfinite(value), value, -np.inf), shape

    steps = np.geomspace(1e-6, 1.0, 200)
    grid = np.concatenate([-(1 - 1e-9) / top * steps[::-1], np.array([0.0]), np.geomspace(1e-6, 1e3, 400) / mean])
    for _ in range(8):
        best = int(profile(grid)[0].argmax())
        low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
        grid = np.linspace(low, high, 41)
    t = float(grid[int(profile(grid)[0].argmax())])
    if abs(t) * top < 1e-9:
        return 0.0, mean
    shape = float(np.log1p(t * y).mean())
    return shape, shape / t


def hill_index(y: np.ndarray) -> float | None:
    """Tail index of values in units of the least."""
    y = np.sort(y[y > 0])
    total = float(np.log(y / y[0]).sum()) if len(y) >= 3 else 0.0
    return len(y) / total if total > 0 else None


def fit_side(values: np.ndarray, side: str, q: float = QUANTILE, exceed: int = EXCEED) -> dict:
    """Peaks of ``values`` (losses of a left tail have their sign turned) over the ``q`` quantile.

    Enough peaks are ``exceed``, or what the quantile leaves of a short series, but three. A shape of 0 or less is a bounded tail, whose index is Hill's.
    """
    n = len(values)
    least = min(exceed, max(3, round(n * (1 - q)))) if n else exceed
    out = {"threshold": None, "shape": None, "scale": None, "alpha": None, "n_exceed": 0, "n": n, "reliable": False, "flags": []}
    if n < least:
        return out | {"flags": ["low_n"]}
    x = -values if side == "left" else values
    threshold = float(np.quantile(x, q))
    peaks = x[x > threshold] - threshold
    out |= {"threshold": threshold, "n_exceed": len(peaks), "flags": ["alpha_unreliable"]}
    found = pareto_fit(peaks) if len(peaks) >= least else None
    if found is None:
        return out
    shape, scale = found
    bounded = shape <= 0
    return out | {"shape": shape, "scale": scale, "reliable": True, "alpha": hill_index(peaks) if bounded else 1 / shape, "flags": [f"bounded_tail_{side}"] if bounded else []}


def loss_at(fit: dict, p: float) -> float | None:
    """The loss that is exceeded with probability ``p``; None where that is not in the modelled tail."""
    share = fit["n_exceed"] / fit["n"] if fit["n"] else 0.0
    if not fit["reliable"] or not 0 < p < share:
        return None
    shape, scale = fit["shape"], fit["scale"]
    y = -scale * math.log(p / share) if abs(shape) < 1e-8 else scale / shape * ((p / share) ** -shape - 1)
    return fit["threshold"] + y


def tail_risk(fit: dict, level: float = LEVEL) -> tuple[float | None, float | None]:
    """Value at risk and the mean beyond it, as returns; no mean for shapes of 1 or more."""
    loss = loss_at(fit, 1 - level)
    if loss is None:
        return None, None
    if fit["shape"] >= 1:
        return -loss, None
    return -loss, -(loss + (fit["scale"] + fit["shape"] * (loss - fit["threshold"])) / (1 - fit["shape"]))


def kappa(r: np.ndarray, gen: np.random.Generator, n: int = SUM_OF, draws: int = DRAWS) -> float | None:
    """How slowly the mean deviation of sums of ``n`` draws grows: 0 for thin tails, towards 1 for fat ones."""
    if len(r) < n + 20:
        return None
    one = float(np.abs(r - r.mean()).mean())
    if one <= 0:
        return None
    many = float(np.abs(r[gen.integers(0, len(r), (draws, n))].sum(axis=1) - n * r.mean()).mean())
    if many <= one:
        return 0.0
    return min(max(2 - math.log(n) / math.log(many / one), 0.0), 1.0)


def modelled_mean(r: np.ndarray, left: dict, right: dict) -> float:
    """The mean with the tails' means in place of those seen, by the tails' shares; tails without a mean stay as seen."""
    value = float(r.mean())
    for fit, x, sign in ((left, -r, -1), (right, r, 1)):
        if fit["reliable"] and fit["shape"] < 1:
            seen = x[x > fit["threshold"]]
            value += sign * fit["n_exceed"] / fit["n"] * (fit["threshold"] + fit["scale"] / (1 - fit["shape"]) - float(seen.mean()))
    return value


def shrink(alpha: float | None, k: float | None, n: int) -> float:
    """Factor of trust in a mean: by tail index, kappa and length."""
    value = min(max((alpha - 1) / 3, 0.05), 1.0) if alpha is not None and alpha > 0 else 0.35
    value *= min(max(1 - k, 0.05), 1.0) if k is not None else 1.0
    return value * (n / SHORT if n < SHORT else 1.0)


def barbell_leg(alpha: float | None, k: float | None, cvar: float | None, flags: list[str], defensive: bool = False) -> str:
    """avoid for a fat tail; safe for defensive codes and thin tails of small losses; else, or where little is known, risk."""
    if (alpha is not None and alpha < FAT) or (k is not None and k >= KAPPA_FAT) or (cvar is not None and cvar <= -LOSS_AVOID):
        return "avoid"
    if defensive:
        return "safe"
    if {"low_n", "alpha_unreliable"} & set(flags):
        return "risk"
    thin = "bounded_tail_left" in flags or (alpha is not None and alpha >= THIN)
    return "safe" if thin and (k is None or k <= KAPPA_SAFE) and (cvar is None or cvar >= -LOSS_SAFE) else "risk"


def measures(r: np.ndarray, gen: np.random.Generator, defensive: bool = False) -> dict:
    """All measures of one series of returns."""
    left, right = fit_side(r, "left"), fit_side(r, "right")
    k = kappa(r, gen)
    var, cvar = tail_risk(left)
    flags = (["low_n"] if len(r) < LEAST else []) + [x for x in left["flags"] + right["flags"] if x != "low_n" or len(r) >= LEAST]
    mean = modelled_mean(r, left, right) if len(r) else None
    factor = shrink(left["alpha"], k, len(r))
    return {
        "n": len(r), "alpha_left": left["alpha"], "alpha_right": right["alpha"], "shape_left": left["shape"], "scale_left": left["scale"], "threshold_left": left["threshold"],
        "kappa": k, "var": var, "cvar": cvar, "shadow_mean": mean, "shrink": factor, "leg": barbell_leg(left["alpha"], k, cvar, flags, defensive), "flags": list(dict.fromkeys(flags)),
    }


BOARD = (
    "code string, d date, n long, alpha_left double, alpha_right double, shape_left double, scale_left double, threshold_left double, "
    "kappa double, var double, cvar double, shadow_mean double, shrink double, leg string, flags array<string>"
)


def board(rows: DataFrame, defensive: tuple[str, ...] = (), seed: int = 12345) -> DataFrame:
    """``BOARD`` for each row of ``code, d, past``; draws are seeded by code and day."""
    names = [c.split()[0] for c in BOARD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for code, d, past in zip(batch["code"], batch["d"], batch["past"], strict=True):
                r = np.asarray(past, float)
                gen = np.random.default_rng([seed, zlib.crc32(str(code).encode()), zlib.crc32(str(d).encode())])
                out.append({"code": code, "d": d} | measures(r[np.isfinite(r)], gen, code in defensive))
            yield pd.DataFrame({c: [row[c] for row in out] for c in names})

    return rows.repartition("code", "d").mapInPandas(run, BOARD)
