"""Regime labels with memory: hysteresis on the means, methods by name, switches and their matches, clamped rails."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark import schemas
from quaymark.operators.machines import by_code, ewma_sigma
from quaymark.operators.regimes import raw_regime
from quaymark.operators.runs import majority


def runs_of(flags: np.ndarray) -> np.ndarray:
    """At each row the number of true flags in a row up to it."""
    at = np.arange(1, len(flags) + 1)
    return at - np.maximum.accumulate(np.where(flags, 0, at))


class _Extreme:
    """The highest (sign 1) or lowest (-1) close since a state began, and the move away from it."""

    def __init__(self, sign: int) -> None:
        self.sign, self.at = sign, np.nan

    def moved(self, close: float) -> float:
        if np.isnan(close):
            return 0.0
        self.at = close if np.isnan(self.at) or self.sign * (close - self.at) > 0 else self.at
        return close / self.at - 1 if self.at > 0 else 0.0


def mean20_states(raw: list[str], close: np.ndarray, m20: np.ndarray, m60: np.ndarray, confirm: int = 2) -> list[str]:
    """States that leave a trend on breaks of the short mean.

    Up ends after two closes under the mean or a 6 % fall from its peak, down
    after two above or a 4 % rebound from its trough. A new down after such a
    rebound waits three bars, or as many closes under the mean, and for a close under the old trough.
    """
    above = close > m20
    over, under = runs_of(above), runs_of(~above)
    bull, bear = m20 > m60, m20 < m60
    peak, trough, state, wait, out = _Extreme(1), _Extreme(-1), "range", 0, []
    for i, label in enumerate(raw):
        c = close[i]
        rises = label == "up" and (over[i] >= confirm or bull[i])
        falls = label == "down" and (under[i] >= confirm or bear[i])
        new = state
        if state == "up":
            fallen = peak.moved(c)
            new = "down" if falls else "range" if under[i] >= 2 or fallen <= -0.06 or (label == "range" and under[i] > confirm) else "up"
        elif state == "down":
            risen = trough.moved(c)
            new = "up" if rises else "range" if over[i] >= 2 or risen >= 0.04 or (label == "range" and over[i] >= confirm) else "down"
            wait = 3 if new == "range" else wait
        else:
            wait = max(wait - 1, 0)
            held = (not np.isnan(trough.at) and c > trough.at) or (wait > 0 and under[i] < max(confirm, 3))
            new = "up" if rises else "down" if falls and not held else "range"
        if new != state:
            if new != "range":
                wait = 0
                peak.at, trough.at = (c, np.nan) if new == "up" else (np.nan, c)
            else:
                peak.at = np.nan
                trough.at = np.nan if state == "up" else trough.at
            state = new
        out.append(state)
    return out


def mean60_states(raw: list[str], close: np.ndarray, m20: np.ndarray, m60: np.ndarray, enter: int = 2) -> list[str]:
    """States that follow the order of the means: three bars to leave, ``enter`` to enter, an up only with as many closes above the short one.

    Up also ends after three closes under it or a 12 % fall, down after three above or a 4 % rebound.
    """
    above = close > m20
    over, under = runs_of(above), runs_of(~above)
    bull, bear = runs_of(m20 > m60), runs_of(m20 < m60)
    peak, trough, state, out = _Extreme(1), _Extreme(-1), "range", []
    for i, label in enumerate(raw):
        c, new = close[i], state
        if state == "up":
            fallen = peak.moved(c)
            new = "down" if bear[i] >= 3 else "range" if under[i] >= 3 or fallen <= -0.12 or (label == "range" and bear[i] >= enter) else "up"
        elif state == "down":
            risen = trough.moved(c)
            new = "up" if bull[i] >= 3 and over[i] >= enter else "range" if over[i] >= 3 or risen >= 0.04 or (label == "range" and bull[i] >= enter) else "down"
        elif label == "up" and bull[i] >= enter and over[i] >= enter:
            new = "up"
        elif label == "down" and bear[i] >= enter:
            new = "down"
        if new != state:
            peak.at, trough.at = (c if new == "up" else np.nan), (c if new == "down" else np.nan)
            state = new
        out.append(state)
    return out


def _states(rows: DataFrame, run: Callable) -> DataFrame:
    def labelled(g: pd.DataFrame) -> pd.DataFrame:
        close, m20, m60 = (g[c].to_numpy(float) for c in ("close", "m20", "m60"))
        return pd.DataFrame({"code": g["code"], "d": g["d"], "label": run(g["raw"].fillna("range").tolist(), close, m20, m60)})

    return by_code(rows.select("code", "d", "close", "m20", "m60", "raw"), labelled, schemas.LABELS)


def smoothed(labels: DataFrame, n: int) -> DataFrame:
    """The majority of the last ``n`` labels."""
    return majority(labels, "label", n, "smooth").select("code", "d", F.col("smooth").alias("label"))


def stacked(rows: DataFrame, kind: str = "stack", confirm: int = 3, smooth: int = 3) -> DataFrame:
    """Hysteresis on the short mean, then the majority of the last ``smooth`` labels."""
    return smoothed(_states(raw_regime(rows, kind), lambda raw, c, a, b: mean20_states(raw, c, a, b, confirm)), smooth)


def structured(rows: DataFrame, kind: str = "soft", enter: int = 3, smooth: int = 3) -> DataFrame:
    """Hysteresis on the order of the means, then the majority."""
    return smoothed(_states(raw_regime(rows, kind), lambda raw, c, a, b: mean60_states(raw, c, a, b, enter)), smooth)


def momentum_bands(rows: DataFrame, smooth: int = 5) -> DataFrame:
    """The side of the longer return and of the short mean, range in a narrow band, then the majority: no state is kept."""
    return smoothed(raw_regime(rows, "band").select("code", "d", F.col("raw").alias("label")), smooth)


def hybrid(rows: DataFrame) -> DataFrame:
    """``stacked``, with trends of weak directional moves and small returns taken back, but for an up above the short mean that gains."""
    zero = F.lit(0.0)
    p20, p60 = F.coalesce("p20", zero), F.coalesce("p60", zero)
    weak = (F.coalesce("adx", zero) < 15) & ~((F.abs(p60) >= 0.06) | (F.abs(p20) >= 0.04))
    gains = F.coalesce(F.col("close") > F.col("m20"), F.lit(False)) & (p20 >= 0.02)
    both = stacked(rows).join(rows.select("code", "d", weak.alias("weak"), gains.alias("gains")), ["code", "d"])
    return both.select("code", "d", F.when(F.col("weak") & ~((F.col("label") == "up") & F.col("gains")), "range").otherwise(F.col("label")).alias("label"))


#: Labelling methods by name, each from rows of ``regime_features``; mean20 and mean60 are the states without smoothing.
METHODS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "stacked": stacked,
    "structured": structured,
    "strict": lambda rows: stacked(rows, "strict"),
    "crosses": lambda rows: structured(rows, "cross"),
    "adx_di": lambda rows: stacked(rows, "adx", 2),
    "momentum_bands": momentum_bands,
    "hybrid": hybrid,
    "mean20": lambda rows: _states(rows, mean20_states),
    "mean60": lambda rows: _states(rows, mean60_states),
}


def labels_by(rows: DataFrame, method: str) -> DataFrame:
    """``code, d, label`` by the method of that name."""
    return METHODS[method](rows)


def switch_matches(truth: DataFrame, pred: DataFrame, reach: int = 10) -> DataFrame:
    """``code, bar, match`` for each true switch (code, bar): in order, the nearest predicted one within ``reach`` bars
    that no earlier switch took, the lesser of two as near; NULL for none."""

    def run(key: tuple, t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        free, out = sorted(p["bar"]), []
        for bar in sorted(t["bar"]):
            near = min((x for x in free if abs(x - bar) <= reach), key=lambda x: (abs(x - bar), x), default=None)
            if near is not None:
                free.remove(near)
            out.append((key[0], bar, near))
        return pd.DataFrame(out, columns=["code", "bar", "match"]).astype(object)

    a, b = (x.select(F.col("code").alias("code"), F.col("bar").cast("long").alias("bar")) for x in (truth, pred))
    return a.groupBy("code").cogroup(b.groupBy("code")).applyInPandas(run, "code string, bar long, match long")


def clamped_rails(rows: DataFrame, gap: str, path: str, q: float = 0.95, floor_q: float = 0.5, least: int = 63, least_calm: int = 20, recent: int = 60, wide: float = 0.98) -> DataFrame:
    """``code, d, lower, upper``: rails in units of the moving volatility, held in on calm days.

    On calm days with enough calm residuals: if the rails held more than
    ``wide`` of the recent calm closes, the width is at most the q quantile of
    calm residuals, else at least their ``floor_q`` quantile. ``rows`` have ``vol_state``.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        res, calm = g[gap].to_numpy(float), (g["vol_state"] == "calm").to_numpy()
        sigma = ewma_sigma(res)
        known = sigma > 0
        z = pd.Series(np.abs(res / np.where(known, sigma, np.nan)))
        plain = z.expanding(min_periods=1).quantile(q).where(z.expanding(min_periods=1).count() >= least).to_numpy()
        width = np.full(len(res), np.nan)
        past: list[float] = []
        inside: list[bool] = []
        for i in range(len(res)):
            if calm[i] and not np.isnan(res[i]):
                past.append(abs(res[i]))
            if np.isnan(plain[i]) or not known[i] or np.isnan(g[path].iat[i]):
                continue
            width[i] = plain[i] * sigma[i]
            if calm[i] and len(past) >= least_calm:
                last = inside[-recent:]
                if len(last) >= least_calm and np.mean(last) > wide:
                    width[i] = min(width[i], np.quantile(past, q))
                else:
                    width[i] = max(width[i], np.quantile(past, floor_q))
            if calm[i] and not np.isnan(res[i]):
                inside.append(abs(res[i]) <= width[i])
        mid = g[path].to_numpy(float)
        out = pd.DataFrame({"code": g["code"], "d": g["d"], "lower": mid * np.exp(-width), "upper": mid * np.exp(width)})
        return out.astype(object).where(out.notna(), None)

    return by_code(rows.select("code", "d", gap, path, "vol_state"), run, "code string, d date, lower double, upper double")


def _quantile(ordered: list[float], q: float) -> float:
    """Linear between the two values around the place."""
    at = q * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (at - low) * (ordered[high] - ordered[low])


def scaled_rails(rows: DataFrame, gap: str, path: str, q: float = 0.95, least: int = 63, cover: float = 0.95, least_calm: int = 20, most: float = 4.0, widest: float = 5.0) -> DataFrame:
    """``code, d, lower, upper``: rails in units of the moving volatility that hold ``cover`` of the calm days.

    No rail is nearer than the ``cover`` quantile of calm residuals so far. While the rails held less than that of the calm closes before, a calm day's
    width is inflated by the quantile of their residuals in units of their widths, at most ``most`` times. Each past is kept in order, so a day costs one
    insertion. ``rows`` have ``vol_state``.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        res, mid, calm = g[gap].to_numpy(float), g[path].to_numpy(float), (g["vol_state"] == "calm").to_numpy()
        sigma = ewma_sigma(res)
        units: list[float] = []
        quiet: list[float] = []
        scores: list[float] = []
        held = 0
        width = np.full(len(res), np.nan)
        for i, r in enumerate(np.abs(res)):
            seen, known = not np.isnan(r), sigma[i] > 0
            if seen and known:
                insort(units, r / sigma[i])
            if seen and calm[i]:
                insort(quiet, r)
            if len(units) < least or not known or np.isnan(mid[i]):
                continue
            raw = _quantile(units, q) * sigma[i]
            if len(quiet) >= least_calm:
                raw = max(raw, _quantile(quiet, cover))
            grown = calm[i] and len(scores) >= least_calm and held < cover * len(scores)
            width[i] = min(raw * min(most, max(1.0, _quantile(scores, cover))) if grown else raw, widest)
            if calm[i] and seen and raw >= 1e-8:
                insort(scores, r / raw)
                held += r <= width[i]
        out = pd.DataFrame({"code": g["code"], "d": g["d"], "lower": mid * np.exp(-width), "upper": mid * np.exp(width)})
        return out.astype(object).where(out.notna(), None)

    return by_code(rows.select("code", "d", gap, path, "vol_state"), run, "code string, d date, lower double, upper double")
