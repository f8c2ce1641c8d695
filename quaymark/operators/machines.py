"""State machines over one code's rows: each state depends on the one before.

They run as grouped maps by code. A code's rows are one row a day, so a group
is bounded by the days of a listing, not by the number of codes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quaymark import schemas


def by_code(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``run`` to each code's rows in date order."""
    return rows.groupBy("code").applyInPandas(lambda g: run(g.sort_values("d", ignore_index=True)), schema)


def ewma_sigma(r: np.ndarray, decay: float = 0.94) -> np.ndarray:
    """Volatility known before each bar: seeded by the first non-zero squared return, lagged one bar.

    A missing return keeps the last known square in use.
    """
    out = np.full(len(r), np.nan)
    var = last = np.nan
    for i, x in enumerate(r):
        if np.isnan(var):
            if not np.isnan(last) and last > 0:
                var = last
        else:
            var = decay * var + (1 - decay) * last
        out[i] = np.sqrt(var)
        if not np.isnan(x):
            last = x * x
    return out


def ewma_rails(rows: DataFrame, gap: str, path: str, q: float = 0.95, least: int = 63) -> DataFrame:
    """``code, d, sigma, lower, upper``: rails at the quantile so far of |gap / sigma|, times sigma.

    Today's score enters the history before the quantile is taken.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        res = g[gap].to_numpy(float)
        sigma = ewma_sigma(res)
        z = np.abs(res / np.where(sigma > 0, sigma, np.nan))
        width = pd.Series(z).expanding(min_periods=least).quantile(q).to_numpy() * sigma
        width[np.isnan(z)] = np.nan
        mid = g[path].to_numpy(float)
        out = pd.DataFrame({"code": g["code"], "d": g["d"], "sigma": sigma, "lower": mid * np.exp(-width), "upper": mid * np.exp(width)})
        return out.astype(object).where(out.notna(), None)

    return by_code(rows, run, "code string, d date, sigma double, lower double, upper double")


def kalman_trend(rows: DataFrame, warm: int = 504) -> DataFrame:
    """``code, d, path, drift, forecast`` of a local linear trend on log closes.

    Noise comes from the moments of the first ``warm`` increments. Every bar
    predicts; only observed ones update.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = np.log(g["close"].where(g["close"] > 0).to_numpy(float))
        step = np.diff(y[~np.isnan(y)])[:warm]
        r, q_level, q_slope = 1e-4, 1e-5, 1e-8
        if len(step) >= 20:
            c = step - step.mean()
            r = max(-float((c[1:] * c[:-1]).mean()), 1e-10)
            q_level = max(float(step.var()) - 2 * r, 1e-10)
            q_slope = max(float(np.diff(step).var()) - 2 * q_level - 6 * r, 1e-12)
        level = slope = np.nan
        p00, p01, p11 = 1.0, 0.0, 1.0
        out = np.full((len(y), 3), np.nan)
        for i, obs in enumerate(y):
            if np.isnan(level):
                if np.isnan(obs):
                    continue
                level, slope = obs, 0.0
            else:
                level += slope
                p00, p01, p11 = p00 + 2 * p01 + p11 + q_level, p01 + p11, p11 + q_slope
                if not np.isnan(obs):
                    s, e = p00 + r, obs - level
                    k0, k1 = p00 / s, p01 / s
                    level, slope = level + k0 * e, slope + k1 * e
                    p11 -= k1 * p01
                    p01 *= 1 - k0
                    p00 *= 1 - k0
            out[i] = np.exp(level), np.expm1(252 * slope), np.exp(level + slope)
        return pd.DataFrame({"code": g["code"], "d": g["d"], "path": out[:, 0], "drift": out[:, 1], "forecast": out[:, 2]})

    return by_code(rows, run, "code string, d date, path double, drift double, forecast double")


def rule_trades(
    close: np.ndarray, buy: np.ndarray, sell: np.ndarray, trend: np.ndarray, trail: float = 0.10, cost: float = 0.0005
) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """Trades, daily weight and equity of the one-position rule machine.

    A buy fills at the next close. The peak counts from the fill bar; a trend
    day suppresses sells from then on until the exit; the trailing stop works
    strictly after the fill bar; an exit is recorded only if another bar
    follows. Weight lags the target by a bar; a change of the target pays
    ``cost`` on its own bar, a bar before the weight follows.
    """
    n = len(close)
    target = np.zeros(n + 1)
    trades: list[dict] = []
    fill, signal, peak, in_trend = -1, -1, -np.inf, False
    for i in range(n):
        if fill < 0:
            if buy[i]:
                fill, signal, peak, in_trend = i + 1, i, -np.inf, False
                target[i + 1] = 1
            continue
        in_trend = in_trend or bool(trend[i])
        if i >= fill:
            peak = max(peak, close[i])
        reason = ""
        if i >= fill and sell[i] and not in_trend:
            reason = "sell"
        elif i > fill and close[i] <= peak * (1 - trail):
            reason = "trail"
        if reason and i + 1 < n:
            trades.append({"signal": signal, "entry": fill, "exit": i + 1, "reason": reason})
            fill = -1
        else:
            target[i + 1] = 1
    held = target[:n]
    weight = np.concatenate(([0.0], held[:-1]))[:n]
    move = np.concatenate(([0.0], close[1:] / close[:-1] - 1))
    turn = np.abs(np.diff(np.concatenate(([0.0], held))))
    if fill >= 0:
        trades.append({"signal": signal, "entry": fill if fill < n else -1, "exit": -1, "reason": "open" if fill < n else "pending"})
    return trades, weight, np.cumprod(1 + weight * move - turn * cost)


def run_rules(rows: DataFrame, buy: str, sell: str, trend: str, trail: float = 0.10, cost: float = 0.0005) -> DataFrame:
    """Trades of the rule machine for each code, see ``schemas.TRADES``."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        close = g["close"].to_numpy(float)
        trades, _, _ = rule_trades(close, g[buy].to_numpy(bool), g[sell].to_numpy(bool), g[trend].to_numpy(bool), trail, cost)
        out = []
        for no, t in enumerate(trades, 1):
            e, x = t["entry"], t["exit"]
            out.append(
                (g["code"][0], no, g["d"][t["signal"]], g["d"][e] if e >= 0 else None, g["d"][x] if x >= 0 else None,
                 close[e] if e >= 0 else None, close[x] if x >= 0 else None, t["reason"], x - e if x >= 0 else None,
                 close[x] / close[e] - 1 if x >= 0 else None)
            )
        return pd.DataFrame(out, columns=[c.split()[0] for c in schemas.TRADES.split(", ")]).astype(object)

    return by_code(rows, run, schemas.TRADES)


def rule_equity(rows: DataFrame, buy: str, sell: str, trend: str, trail: float = 0.10, cost: float = 0.0005) -> DataFrame:
    """``code, d, weight, equity`` of the rule machine."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        _, weight, equity = rule_trades(
            g["close"].to_numpy(float), g[buy].to_numpy(bool), g[sell].to_numpy(bool), g[trend].to_numpy(bool), trail, cost
        )
        return pd.DataFrame({"code": g["code"], "d": g["d"], "weight": weight, "equity": equity})

    return by_code(rows, run, schemas.EQUITY)


def stop_target_trades(rows: DataFrame, signal: str, stop: str, target: str, hold: int = 40) -> DataFrame:
    """Trades without overlap: next open in; out at the stop by the low, at a close over the target, or after ``hold``."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        o, low, c = (g[x].to_numpy(float) for x in ("open", "low", "close"))
        s, t, on = g[stop].to_numpy(float), g[target].to_numpy(float), g[signal].to_numpy(bool)
        out, i, n = [], 0, len(g)
        while i < n - 1:
            if not on[i] or np.isnan(s[i]):
                i += 1
                continue
            e, x, px, reason = i + 1, n - 1, c[n - 1], "end"
            for j in range(e, n):
                if low[j] <= s[i]:
                    x, px, reason = j, min(s[i], o[j]), "stop"
                elif c[j] >= t[i]:
                    x, px, reason = j, c[j], "target"
                elif j - e + 1 >= hold:
                    x, px, reason = j, c[j], "hold"
                else:
                    continue
                break
            out.append((g["code"][0], len(out) + 1, g["d"][i], g["d"][e], g["d"][x], o[e], px, reason, x - e, px / o[e] - 1))
            i = x + 1
        return pd.DataFrame(out, columns=[k.split()[0] for k in schemas.TRADES.split(", ")]).astype(object)

    return by_code(rows, run, schemas.TRADES)


def hysteresis(raw: np.ndarray, enter: int, leave: int) -> np.ndarray:
    """Labels that change only after ``enter`` equal raw labels (``leave`` for a move to range)."""
    out, now, want, run = [], "range", "range", 0
    for label in raw:
        run = run + 1 if label == want else 1
        want = label
        if want != now and run >= (leave if want == "range" else enter):
            now = want
        out.append(now)
    return np.array(out, object)


def hysteresis_labels(rows: DataFrame, label: str, enter: int = 2, leave: int = 3) -> DataFrame:
    """``code, d, label``: raw labels confirmed by hysteresis."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"code": g["code"], "d": g["d"], "label": hysteresis(g[label].fillna("range").to_numpy(), enter, leave)})

    return by_code(rows, run, schemas.LABELS)


def squash_short(labels: list[str], least: int) -> list[str]:
    """Segments shorter than ``least`` take the previous label, else the next, else range; two passes in order."""
    out = list(labels)
    for _ in range(2):
        i = 0
        while i < len(out):
            j = i
            while j < len(out) and out[j] == out[i]:
                j += 1
            if j - i < least:
                new = out[i - 1] if i > 0 else out[j] if j < len(out) else "range"
                out[i:j] = [new] * (j - i)
            i = j
    return out


def squash_labels(rows: DataFrame, label: str, least: int = 10) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"code": g["code"], "d": g["d"], "label": squash_short(g[label].fillna("range").tolist(), least)})

    return by_code(rows, run, schemas.LABELS)


def guarded(close: np.ndarray, mean: np.ndarray, labels: list[str], guard: int = 2) -> list[str]:
    """Up labels with the guard: see ``sticky_guard``."""
    out, below, wait, peak = [], 0, 0, np.nan
    for x, m, now in zip(close, mean, labels, strict=True):
        known = np.isfinite(x) and np.isfinite(m)
        if now != "up":
            below, wait, peak = 0, 0, np.nan
        elif wait:
            now, below, peak = "range", 0, np.nan
            wait -= bool(known and x >= m)
        else:
            peak = np.fmax(peak, x) if np.isfinite(x) else peak
            below = below + 1 if known and x < m else 0
            deep = np.isfinite(x) and peak > 0 and x / peak - 1 <= -0.18
            if below >= 3 or (below and deep):
                now, below, wait, peak = "range", 0, guard, np.nan
        out.append(now)
    return out


def sticky_guard(rows: DataFrame, label: str, guard: int = 2) -> DataFrame:
    """An up label falls to range after three closes below the mean, or one with an 18 % drawdown from the run's peak.

    From then on up labels stay range until ``guard`` closes at or above the
    mean have passed, the last of these included; any other label ends the guard.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        labels = guarded(g["close"].to_numpy(float), g["ma20"].to_numpy(float), g[label].fillna("range").tolist(), guard)
        return pd.DataFrame({"code": g["code"], "d": g["d"], "label": labels})

    return by_code(rows, run, schemas.LABELS)
