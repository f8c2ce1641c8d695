"""What the rules would say at tomorrow's close: a grid of moves, and the price where a signal begins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.operators.features import NEAR, PANELS, RAIL_LEAST, RAIL_Q, TOUCH, trailing_fit
from quaymark.operators.machines import by_code

#: Moves of the scenario grid in thousandths, and the search's first steps and bisections.
MOVES = range(-100, 101)
SEARCH = np.linspace(-0.15, 0.20, 16)
HALVINGS = 12


class Tomorrow:
    """One code's bars, and the state of the half-year and quarter panels at a close that follows them."""

    def __init__(self, close: np.ndarray) -> None:
        self.close = close
        self.panels = {}
        for name in ("fig9", "fig10"):
            n, least = PANELS[name]
            ln = np.log(close)
            gaps = np.abs(ln - trailing_fit(ln, n, least)[0])
            self.panels[name] = (n, least, ln[-(n - 1) :], gaps[~np.isnan(gaps)])
        self.near_lo, self.near_hi = self._near(*self._rails("fig9", None)[:2], close[-1])

    def _rails(self, name: str, after: float | None) -> tuple[float, float]:
        """Lower and upper rail today, or at a close ``after``."""
        n, least, last, gaps = self.panels[name]
        y = np.log(self.close[-n:]) if after is None else np.append(last, np.log(after))
        fitted = trailing_fit(y, n, least)[0][-1]
        held = gaps if after is None else np.append(gaps, abs(y[-1] - fitted))
        held = held[~np.isnan(held)]
        if np.isnan(fitted) or len(held) < RAIL_LEAST:
            return np.nan, np.nan
        delta = np.quantile(held, RAIL_Q)
        return np.exp(fitted - delta), np.exp(fitted + delta)

    @staticmethod
    def _near(lower: float, upper: float, close: float) -> tuple[bool, bool]:
        return bool(close <= lower * (1 + NEAR)), bool(close >= upper * (1 - NEAR))

    def signals(self, after: float) -> tuple[bool, bool]:
        """Whether a close of ``after`` is a buy, or a sell: it newly nears a rail, and the means and moves agree."""
        c = np.append(self.close, after)
        lo, hi = self._near(*self._rails("fig9", after), after)
        ma5, ma20 = c[-5:].mean(), c[-20:].mean()
        gap5, gap20 = after / c[-6] - 1, after / c[-21] - 1
        over = after >= self._rails("fig10", after)[1] * (1 - TOUCH)
        buy = lo and not self.near_lo and after < ma20 and ma5 < ma20 and gap5 <= 0 and gap20 <= 0 and not over
        sell = hi and not self.near_hi and after > ma20 and ma5 > ma20 and gap5 >= 0 and gap20 >= 0
        return bool(buy), bool(sell)


def next_closes(bars: DataFrame) -> DataFrame:
    """``code, move, close, buy, sell`` for moves of -10 % to 10 % in tenths of a percent after the last bar; move counts tenths."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) < 21:
            return pd.DataFrame({"code": [], "move": [], "close": [], "buy": [], "sell": []})
        at = Tomorrow(g["close"].to_numpy(float))
        closes = [at.close[-1] * (1 + m / 1000) for m in MOVES]
        found = [at.signals(c) for c in closes]
        return pd.DataFrame({"code": g["code"][0], "move": list(MOVES), "close": closes, "buy": [b for b, _ in found], "sell": [s for _, s in found]})

    return by_code(bars.select("code", "d", "close"), run, "code string, move long, close double, buy boolean, sell boolean")


def move_ranges(grid: DataFrame, signal: str) -> DataFrame:
    """Runs of neighbouring moves with the signal: ``code, first, last``."""
    order = Window.partitionBy("code").orderBy("move")
    on = grid.where(F.col(signal)).withColumn("run", F.col("move") - F.row_number().over(order))
    return on.groupBy("code", "run").agg(F.min("move").alias("first"), F.max("move").alias("last")).drop("run")


def _edge(test: Callable[[float], bool], close: float) -> float | None:
    """The close nearest to today's where ``test`` turns true, by a grid and then by halving."""
    on = [test(close * (1 + r)) for r in SEARCH]
    best = None
    for i in np.argsort(np.abs(SEARCH), kind="stable"):
        if on[i]:
            toward = i - 1 if SEARCH[i] > 0 else i + 1
            if not 0 <= toward < len(on) or on[toward]:
                return float(close * (1 + SEARCH[i]))
            out, best = SEARCH[toward], SEARCH[i]
            for _ in range(HALVINGS):
                mid = (out + best) / 2
                out, best = (out, mid) if test(close * (1 + mid)) else (mid, best)
            return float(close * (1 + best))
    return best


def trigger_prices(bars: DataFrame) -> DataFrame:
    """``code, close, buy_price, sell_price``: the next closes nearest to the last one that would be signals, NULL for none."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        close = g["close"].to_numpy(float)
        found = [None, None]
        if len(g) >= 21:
            at = Tomorrow(close)
            found = [_edge(lambda c, k=k: at.signals(c)[k], close[-1]) for k in (0, 1)]
        return pd.DataFrame([(g["code"][0], close[-1], *found)], columns=["code", "close", "buy_price", "sell_price"]).astype(object)

    return by_code(bars.select("code", "d", "close"), run, "code string, close double, buy_price double, sell_price double")
