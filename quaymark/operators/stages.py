"""Rules for each stage of a regime: a sweep of buy and exit rules, a choice drawn towards the pool's rates, and one book over time.

Rules are data. The sweep's unit of work is (code, stage); prior and choice are
aggregations over its rows; the book is a fold over each code's bars.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators.machines import by_code
from quaymark.operators.runs import with_run
from quaymark.operators.signals import flag

NONE, COST, STRENGTH = "none", 0.001, 5.0


@dataclass(frozen=True)
class Exit:
    """``signal`` names a flag that ends a trade; ``trail`` a fall from the highest high; else gain, loss and days limit it."""

    signal: str | None = None
    trail: float | None = None
    gain: float | None = None
    loss: float | None = None
    days: int | None = None


# The rules of each stage, with their thresholds.
BUYS = {
    "up": ["green_cross_red", "green_cross", "green_cross_lively", "cross", "green", "enter"],
    "down": ["near_low_20", "deep_5", "deep_7", "floor"],
    "range": ["near_low_green", "near_low_25", "green", "cross"],
}
EXITS = {
    "up": {"red_ma10": Exit("red10"), "red_ma20": Exit("red20"), "break_ma20": Exit("break20"), "death": Exit("death"),
           "trail15": Exit(trail=0.15), "trail20": Exit(trail=0.20), "trail25": Exit(trail=0.25), "leave_up": Exit("leave")},
    "down": {"tp10_sl6_h10": Exit(gain=0.10, loss=-0.06, days=10), "tp12_sl8_h10": Exit(gain=0.12, loss=-0.08, days=10), "tp15_sl8_h15": Exit(gain=0.15, loss=-0.08, days=15),
             "tp8_sl5_h8": Exit(gain=0.08, loss=-0.05, days=8), "trail10": Exit(trail=0.10), "trail15": Exit(trail=0.15), "break_ma20": Exit("break20"), "red_ma10": Exit("red10")},
    "range": {"tp8_sl5_h10": Exit(gain=0.08, loss=-0.05, days=10), "tp6_sl4_h8": Exit(gain=0.06, loss=-0.04, days=8), "tp4_sl3_h5": Exit(gain=0.04, loss=-0.03, days=5),
              "trail10": Exit(trail=0.10), "trail15": Exit(trail=0.15), "red_ma10": Exit("red10"), "break_ma20": Exit("break20")},
}


def rules() -> list[tuple[str, str, str]]:
    """(stage, buy, exit) of the sweep, in order: leaving the up stage ends only trades that began with it."""
    return [(s, b, e) for s, buys in BUYS.items() for b in buys for e in EXITS[s] if b == "enter" or e != "leave_up"]


def _buy(name: str) -> Column:
    green, red, place = F.col("green") & F.col("bull"), F.col("red"), F.col("place")
    return flag(
        {
            "green_cross_red": green | F.col("golden") | (red & F.col("over20")), "green_cross": green | F.col("golden"),
            "green_cross_lively": (green | F.col("golden")) & (F.col("lively") >= 0.5), "cross": F.col("golden"), "green": green, "enter": F.lit(True),
            "near_low_20": red & (place <= 0.2), "deep_5": red & (F.col("ret1") <= -0.05), "deep_7": red & (F.col("ret1") <= -0.07),
            "floor": red & (F.col("ret1") <= -0.07) & F.col("at_low"), "near_low_green": (red & (place <= 0.25)) | green, "near_low_25": red & (place <= 0.25),
        }[name]
    )


SIGNALS = ("red10", "red20", "break20", "death")
NAMES = sorted({b for buys in BUYS.values() for b in buys})


def stage_rows(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """Bars with ``label``, a flag ``buy_<name>`` for each buy rule, and the exits' flags; what is unknown does not hold."""
    rows = bars.join(labels, ["code", "d"]).withColumns({f"m{n}": w.mean("close", n) for n in (5, 10)} | {f"m{n}": w.mean("close", n, n // 2) for n in (20, 60)})
    before = w.by_code()
    c, o = F.col("close"), F.col("open")
    low, high = (F.when(F.count(x).over(w.last_rows(20)) >= 5, f(x).over(w.last_rows(20))) for x, f in (("low", F.min), ("high", F.max)))
    rows = rows.withColumns({"ret1": w.lag_ratio("close", 1), "_m5": F.lag("m5").over(before), "_m20": F.lag("m20").over(before), "place": (c - low) / F.nullif(high - low, F.lit(0.0))})
    move = F.when(F.count("ret1").over(w.last_rows(5)) >= 3, F.avg(F.abs("ret1")).over(w.last_rows(5)))
    rows = rows.withColumn("_move", move)
    span = w.last_rows(120)
    least, most = (F.when(F.count("_move").over(span) >= 40, f("_move").over(span)) for f in (F.min, F.max))
    rows = rows.withColumn("lively", (F.col("_move") - least) / F.nullif(most - least, F.lit(0.0)))
    rows = rows.withColumns(
        {
            "green": flag(c > o), "red": flag(c < o), "bull": flag(F.col("m20") > F.col("m60")), "over10": flag(c > F.col("m10")), "over20": flag(c > F.col("m20")),
            "golden": flag((F.col("m5") > F.col("m20")) & (F.col("_m5") <= F.col("_m20"))), "death": flag((F.col("m5") < F.col("m20")) & (F.col("_m5") >= F.col("_m20"))),
            "at_low": flag(F.abs(c - F.col("low")) <= 1e-4),
        }
    )
    rows = rows.withColumns({"red10": F.col("red") & ~F.col("over10"), "red20": F.col("red") & ~F.col("over20"), "break20": ~F.col("over20")})
    return with_run(rows.withColumns({f"buy_{b}": _buy(b) for b in NAMES}), "label").select("code", "d", "close", "high", "label", "run_no", *SIGNALS, *[f"buy_{b}" for b in NAMES])


class Bars:
    """One code's bars, or a stretch of them, as arrays."""

    def __init__(self, g: pd.DataFrame) -> None:
        self.close, self.high, self.label = g["close"].to_numpy(float), g["high"].to_numpy(float), g["label"].to_numpy(object)
        self.flags = {s: g[s].to_numpy(bool) for s in SIGNALS}
        self.buys = {b: g[f"buy_{b}"].to_numpy(bool) for b in NAMES}
        self.left = self.label != "up"

    def out(self, entry: int, rule: Exit, stage: str) -> tuple[int, float] | None:
        """Bar and price at which a trade entered at ``entry`` ends, or None. Trades of the up stage also end with it, unless gain and loss limit them."""
        after = slice(entry + 1, None)
        close = self.close[after]
        if rule.gain is not None:
            won, lost = self.high[after] / self.close[entry] - 1 >= rule.gain, close / self.close[entry] - 1 <= rule.loss
            at = won | lost | (np.arange(1, len(close) + 1) >= rule.days)
            if not at.any():
                return None
            j = int(at.argmax())
            return entry + 1 + j, self.close[entry] * (1 + rule.gain) if won[j] else close[j]
        if rule.trail is not None:
            at = close <= np.maximum.accumulate(self.high[entry:])[1:] * (1 - rule.trail)
        else:
            at = self.left[after] if rule.signal == "leave" else self.flags[rule.signal][after]
        at = at | self.left[after] if stage == "up" else at
        return (entry + 1 + int(at.argmax()), close[int(at.argmax())]) if at.any() else None


def stage_trades(bars: Bars, stage: str, buy: str, exit_: str) -> list[float]:
    """Returns of the trades within one stretch of a stage, one after another; the last ends with the stretch."""
    on = np.zeros(len(bars.close), bool) if buy == "enter" else bars.buys[buy]
    if buy == "enter":
        on[0] = True
    entries, out, free = np.flatnonzero(on), [], 0
    for i in entries:
        if i < free:
            continue
        last, price = bars.out(int(i), EXITS[stage][exit_], stage) or (len(bars.close) - 1, bars.close[-1])
        out.append(price / bars.close[i] - 1)
        free = last + 1
    return out


SWEEP = "code string, stage string, buy string, exit string, n_trades long, wins long, mean_ret double, mean_net double, compound double, edge double"


def sweep(rows: DataFrame, cost: float = COST) -> DataFrame:
    """Every rule of every stage on each code's stretches of that stage: ``SWEEP``. Stretches of one bar are left out; rules without a trade have 0."""
    order = {r: i for i, r in enumerate(rules())}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("d", ignore_index=True)
        code, stage = g["code"].iloc[0], g["label"].iloc[0]
        stretches = [Bars(s) for _, s in g.groupby("run_no") if len(s) > 1]
        held = float(np.prod([s.close[-1] / s.close[0] for s in stretches])) - 1
        out = []
        for _, buy, exit_ in (r for r in order if r[0] == stage):
            r = np.array([x for s in stretches for x in stage_trades(s, stage, buy, exit_)])
            mean, compound = float(r.mean()) if len(r) else 0.0, float(np.prod(1 + r)) - 1
            out.append((code, stage, buy, exit_, len(r), int((r > 0).sum()), mean, mean - 2 * cost if len(r) else 0.0, compound, compound - held))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SWEEP.split(", ")])

    return rows.groupBy("code", "label").applyInPandas(run, SWEEP)


def pool_prior(found: DataFrame, score: str = "compound") -> DataFrame:
    """``stage, buy, exit, prior, n_codes, mean_n``: mean score of each rule over the codes on which it traded."""
    return found.where("n_trades > 0").groupBy("stage", "buy", "exit").agg(F.avg(score).alias("prior"), F.countDistinct("code").alias("n_codes"), F.avg("n_trades").alias("mean_n"))


def choose(found: DataFrame, prior: DataFrame, score: str = "compound", strength: float = STRENGTH, least: int = 1) -> DataFrame:
    """``code, stage, buy, exit, own, prior, posterior, n_trades``: the rule of the highest score drawn towards the pool's.

    posterior = (n * own + strength * prior) / (n + strength); ties go to the first rule. Where it is negative, or no rule made ``least`` trades, there is no trade (``none``, 0).
    A rule that the pool does not know has the mean prior of its stage.
    """
    place = F.array_position(F.array(*[F.lit("|".join(r)) for r in rules()]), F.concat_ws("|", "stage", "buy", "exit"))
    usual = prior.groupBy("stage").agg(F.avg("prior").alias("usual"))
    rows = found.where(F.col("n_trades") >= least).join(prior.select("stage", "buy", "exit", "prior"), ["stage", "buy", "exit"], "left").join(usual, "stage", "left")
    rows = rows.withColumn("prior", F.coalesce("prior", "usual", F.lit(0.0)))
    rows = rows.withColumn("posterior", (F.col("n_trades") * F.col(score) + strength * F.col("prior")) / (F.col("n_trades") + strength))
    best = rows.groupBy("code", "stage").agg(F.min(F.struct(-F.round("posterior", 12), place, F.struct("buy", "exit", F.col(score).alias("own"), "prior", "posterior", "n_trades").alias("r"))).alias("b"))
    best = best.select("code", "stage", "b.r.*").where("posterior >= 0")
    every = found.select("code").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, BUYS))))
    zero = {"own": 0.0, "prior": 0.0, "posterior": 0.0, "n_trades": 0}
    return every.join(best, ["code", "stage"], "left").fillna(NONE, ["buy", "exit"]).fillna(zero)


TRADES = "code string, stage string, entry_d date, exit_d date, entry_px double, exit_px double, ret double, open boolean"


def book(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``TRADES`` of one capital for each code: in by the rule of the day's stage, out by that of the stage it entered in; an open trade ends at the last close, marked.

    ``chosen``: code, stage, buy, exit. A bar that ends a trade begins none.
    """
    picks = chosen.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("stage", F.struct("buy", "exit")))).alias("picks"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        bars, d, code = Bars(g), g["d"].tolist(), g["code"].iloc[0]
        picked = {s: (p["buy"], p["exit"]) for s, p in dict(g["picks"].iloc[0]).items()} if g["picks"].iloc[0] is not None else {}
        entered = bars.label != np.append(np.array([None], object), bars.label[:-1])
        on = np.zeros(len(d), bool)
        for stage, (buy, _) in picked.items():
            if buy != NONE:
                on |= (bars.label == stage) & (entered if buy == "enter" else bars.buys[buy])
        out, free = [], 0
        for i in map(int, np.flatnonzero(on)):
            if i < free:
                continue
            stage = bars.label[i]
            found = bars.out(i, EXITS[stage][picked[stage][1]], stage)
            last, price = found or (len(d) - 1, bars.close[-1])
            out.append((code, stage, d[i], d[last], bars.close[i], price, price / bars.close[i] - 1, found is None))
            free = last + 1
        return pd.DataFrame(out, columns=[c.split()[0] for c in TRADES.split(", ")])

    return by_code(rows.join(picks, "code", "left"), run, TRADES)


def book_summary(trades: DataFrame) -> DataFrame:
    """Per code: closed trades, their win rate, and the capital's growth with the open trade at its last close."""
    return trades.groupBy("code").agg(
        F.sum((~F.col("open")).cast("long")).alias("n_closed"), F.avg(F.when(~F.col("open"), (F.col("ret") > 0).cast("double"))).alias("win"),
        (F.exp(F.sum(F.log(F.col("ret") + 1))) - 1).alias("compound"), F.max(F.when(F.col("open"), F.col("ret"))).alias("open_ret"),
    )


def ranked(prior: DataFrame) -> DataFrame:
    """The pool's rules of each stage by their prior."""
    order = Window.partitionBy("stage").orderBy(F.desc(F.round("prior", 12)), "buy", "exit")
    return prior.withColumn("place", F.row_number().over(order))
