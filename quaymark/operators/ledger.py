"""Position machines beside the rule machine, the ledger of its trades, and the tests a ledger must pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark import schemas
from quaymark.functions import windows as w
from quaymark.operators.machines import by_code
from quaymark.operators.signals import flag

# The criteria of the failure tests.
DROP, FAIL_SHARE, LEAST_NAMES = -0.05, 0.5, 5
LEAST_TRADES, FAIL_WINS = 30, 11
MULTIPLE = 1.5
#: Near-the-rail days before a position counts as ridden, and positions of its peak.
RIDE, FAIL_PEAK, SOFT_PEAK, SOFT_POS = 4, 0.5, 0.4, 0.3


def leave_signals(rows: DataFrame) -> DataFrame:
    """Add the signals of the leave machine: ``lv_buy, lv_ridden, lv_again, lv_soft`` from near flags, aux_buy and position."""
    near_lo, near_hi = flag(F.col("fig9_near_lo")), flag(F.col("fig9_near_hi"))
    soft = flag(F.col("aux_buy") & (F.col("fig9_pos") <= SOFT_POS)) & ~near_lo
    rows = rows.withColumns({"_lo": near_lo, "_hi": near_hi, "_soft": soft})
    ridden = F.sum(F.col("_hi").cast("int")).over(w.rows_before(RIDE)) == RIDE
    out = rows.withColumns({"lv_buy": w.rising("_lo") & F.col("aux_buy"), "lv_ridden": ~F.col("_hi") & flag(ridden), "lv_again": w.rising("_lo"), "lv_soft": w.rising("_soft")})
    return out.drop("_lo", "_hi", "_soft")


def leave_trades(rows: DataFrame) -> DataFrame:
    """Trades that ride the upper rail: next close in; out at the close after the rail was left, or the lower rail
    touched again, or the buy picture back, if the position had come far enough up before."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        close, pos = g["close"].to_numpy(float), g["fig9_pos"].to_numpy(float)
        buy, ridden, again, soft = (g[c].to_numpy(bool) for c in ("lv_buy", "lv_ridden", "lv_again", "lv_soft"))
        out, signal, peak, n = [], -1, -np.inf, len(g)

        def add(last: int, reason: str) -> None:
            e, closed = signal + 1, reason != "open"
            out.append((g["code"][0], len(out) + 1, g["d"][signal], g["d"][e], g["d"][last] if closed else None, close[e], close[last] if closed else None,
                        reason, last - e if closed else None, close[last] / close[e] - 1 if closed else None))

        for i in range(n - 1):
            if signal < 0:
                if buy[i]:
                    signal, peak = i, pos[i] if not np.isnan(pos[i]) else -np.inf
                continue
            peak = np.fmax(peak, pos[i])
            reason = "left" if ridden[i] else "again" if again[i] and peak >= FAIL_PEAK else "soft" if soft[i] and peak >= SOFT_PEAK else ""
            if reason:
                add(i + 1, reason)
                signal = -1
        if signal >= 0:
            add(n - 1, "open")
        return pd.DataFrame(out, columns=[c.split()[0] for c in schemas.TRADES.split(", ")]).astype(object)

    return by_code(rows, run, schemas.TRADES)


def quiet_exits(rows: DataFrame) -> DataFrame:
    """Add ``qx_s1, qx_reclaim, qx_break``: an upper rail touched, the long path regained, both long growths negative."""
    return rows.withColumns(
        {
            "qx_s1": flag(F.col("fig9_touch_hi") | F.col("fig10_touch_hi")), "qx_reclaim": flag(F.col("fig7_gap") >= 0),
            "qx_break": flag((F.col("fig7_g") < 0) & (F.col("fig8_g") < 0)),
        }
    )


def quiet_trades(rows: DataFrame, hold: int = 40) -> DataFrame:
    """Trades of quiet discounts without overlap: next close in; out by the low at an average range below it, by the exits, or after ``hold`` bars."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        close, low, atr = (g[c].to_numpy(float) for c in ("close", "low", "atr"))
        on = g["qd_entry"].to_numpy(bool)
        exits = [(name, g[column].to_numpy(bool)) for name, column in (("s1_upper", "qx_s1"), ("fig7_reclaim", "qx_reclaim"), ("trend_break", "qx_break"))]
        out, free, n = [], 0, len(g)
        for i in np.flatnonzero(on[: n - 1]):
            if i < free:
                continue
            e = i + 1
            stop = close[e] - (atr[e] if not np.isnan(atr[e]) else 0.1 * close[e])
            last, px, reason = n - 1, close[n - 1], "eod"
            for j in range(e + 1, n):
                found = "stop" if low[j] <= stop else next((name for name, at in exits if at[j]), "max_hold" if j - e >= hold else "")
                if found:
                    last, px, reason = j, stop if found == "stop" else close[j], found
                    break
            out.append((g["code"][0], len(out) + 1, g["d"][i], g["d"][e], g["d"][last], close[e], px, reason, last - e, px / close[e] - 1))
            free = last + 1
        return pd.DataFrame(out, columns=[c.split()[0] for c in schemas.TRADES.split(", ")]).astype(object)

    return by_code(rows, run, schemas.TRADES)


def segment(day: Column, pseudo: str, forward: str) -> Column:
    return F.when(day < F.lit(pseudo).cast("date"), "in_sample").when(day < F.lit(forward).cast("date"), "pseudo_forward").otherwise("forward")


def ledger(trades: DataFrame, bars: DataFrame, pseudo: str, forward: str, cost: float = 0.0005) -> DataFrame:
    """Trades with their segment, return after costs on both sides, worst drawdown within, and the open ones' unrealised return.

    Each trade meets the bars between its entry and exit by code: a listing's days bound the join.
    """
    path = bars.select("code", F.col("d").alias("day"), "close")
    inside = (F.col("day") >= F.col("entry_d")) & (F.col("day") <= F.coalesce("exit_d", F.lit("9999-12-31").cast("date")))
    held = trades.select("code", "trade_no", "entry_d", "exit_d").join(path, "code").where(inside)
    order = Window.partitionBy("code", "trade_no").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    fallen = held.withColumn("dd", F.col("close") / F.max("close").over(order) - 1)
    worst = fallen.groupBy("code", "trade_no").agg(F.min("dd").alias("mdd"), F.max_by("close", "day").alias("last_px"))
    closed = F.col("exit_px").isNotNull() & (F.col("entry_px") > 0) & (F.col("exit_px") > 0)
    return trades.join(worst, ["code", "trade_no"], "left").select(
        "code", "trade_no", "signal_d", "entry_d", "exit_d", "reason", segment(F.col("signal_d"), pseudo, forward).alias("segment"), F.col("ret").alias("ret_gross"),
        F.when(closed, F.col("exit_px") * (1 - cost) / (F.col("entry_px") * (1 + cost)) - 1).alias("ret_net"), "mdd",
        F.when(F.col("exit_px").isNull() & (F.col("entry_px") > 0), F.col("last_px") / F.col("entry_px") - 1).alias("unrealised"),
    )


def drawdowns(equity: DataFrame, bars: DataFrame, since: str) -> DataFrame:
    """Per code, from a day on: worst drawdowns of the strategy and of holding, and of the strategy before: ``strat_mdd, bh_mdd, sample_mdd``."""
    rows = equity.select("code", "d", "equity").join(bars.select("code", "d", "close"), ["code", "d"])
    rows = rows.withColumn("later", F.col("d") >= F.lit(since).cast("date"))
    order = Window.partitionBy("code", "later").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"e": F.col("equity") / F.max("equity").over(order) - 1, "b": F.col("close") / F.max("close").over(order) - 1})
    later = F.col("later")
    return rows.groupBy("code").agg(F.min(F.when(later, F.col("e"))).alias("strat_mdd"), F.min(F.when(later, F.col("b"))).alias("bh_mdd"), F.min(F.when(~later, F.col("e"))).alias("sample_mdd"))


def failure_tests(falls: DataFrame, trades: DataFrame, waiting: bool = False) -> DataFrame:
    """Rows of ``test, n, value, status`` (pass, fail or open): K1 share of names that fell less than holding, K2 wins of
    closed trades, K3 names past their fuse (open while a name has no drawdown to compare), and the overall status."""
    fell = F.col("bh_mdd") <= DROP
    less = fell & flag(F.col("strat_mdd") > F.col("bh_mdd"))
    fuse = (F.col("sample_mdd") < 0) & (F.abs("strat_mdd") > MULTIPLE * F.abs("sample_mdd")) & (F.col("strat_mdd") < F.col("bh_mdd"))
    unknown = F.col("strat_mdd").isNull() | F.coalesce(F.col("sample_mdd") >= 0, F.lit(True))
    names = falls.agg(
        F.sum(flag(fell).cast("long")).alias("n1"), (F.sum(flag(less).cast("long")) / F.nullif(F.sum(flag(fell).cast("long")), F.lit(0))).alias("share"),
        F.sum(flag(fuse).cast("long")).alias("fused"), F.count("*").alias("names"), F.sum(unknown.cast("long")).alias("unknown"),
    )
    r = F.col("ret_net")
    done = trades.where(r.isNotNull()).agg(F.count("*").alias("n2"), F.avg((r > 0).cast("double")).alias("wins"), F.percentile("ret_net", 0.5).alias("median"))
    k1 = F.when(F.col("n1") < LEAST_NAMES, "open").when(F.col("share") < FAIL_SHARE, "fail").otherwise("pass")
    bad2 = (F.col("wins") <= FAIL_WINS / LEAST_TRADES) | ~(F.col("median") > 0)
    k2 = F.when(F.col("n2") < LEAST_TRADES, "open").when(bad2, "fail").otherwise("pass")
    k3 = F.when(F.col("fused") > 0, "fail").when((F.col("names") == 0) | (F.col("unknown") > 0), "open").otherwise("pass")
    whole = (
        F.when(k3 == "fail", "fail").when(F.lit(waiting), "open").when((k1 == "fail") | (k2 == "fail"), "fail").when((k1 == "pass") & (k2 == "pass"), "pass").otherwise("open")
    )

    def row(test: str, n: Column, value: Column, status: Column) -> Column:
        return F.struct(F.lit(test).alias("test"), n.cast("long").alias("n"), value.cast("double").alias("value"), status.alias("status"))

    rows = [row("k1", F.col("n1"), F.col("share"), k1), row("k2", F.col("n2"), F.col("wins"), k2), row("k3", F.col("names"), F.col("fused"), k3), row("overall", F.lit(None), F.lit(None), whole)]
    return names.join(F.broadcast(done)).select(F.inline(F.array(*rows)))


def buy_quotes(rows: DataFrame) -> DataFrame:
    """Per code, at its last bar: the close that touches the lower rail and why it is or is not a buy.

    ``rows``: code, d, fig9_lower, ae_buy, deep_buy, fast, aux_buy, fig9_near_lo, fig9_gap.
    """
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d")))
    last = rows.withColumn("back", back).where("back = 1")
    buy = flag(F.col("ae_buy") | F.col("deep_buy"))
    deep = flag(F.exp("fig9_gap") - 1 <= -0.08)
    why = (
        F.when(F.col("fig9_lower").isNull(), "no_rail").when(flag(F.col("fast")) & buy, "fast_blocked").when(flag(F.col("fast")), "fast_active").when(buy, "buy_today")
        .when(deep & ~flag(F.col("fig9_near_lo")), "touch_is_enough").when(~flag(F.col("aux_buy")), "picture_not_ready")
        .when(flag(F.col("fig9_near_lo")), "inside_already").otherwise("price_only")
    )
    return last.select("code", (F.col("fig9_lower") * 1.01).alias("price"), why.alias("why"))


def policies(rows: DataFrame, cutoff: str) -> DataFrame:
    """Per code: compounds of holding, of holding in up states (by the day before) and cash before ``cutoff``, the best
    of them (ties in this order), and what it gave since. ``rows``: code, d, close, label."""
    moved = rows.withColumns({"r": F.log(F.col("close") / F.lag("close").over(w.by_code())), "up": flag(F.lag("label").over(w.by_code()) == "up"), "late": F.col("d") >= F.lit(cutoff).cast("date")})
    # The first late bar's move belongs to no side: each side compounds from its own first bar.
    first = F.row_number().over(Window.partitionBy("code", "late").orderBy("d")) == 1
    r = F.when(F.col("first"), 0.0).otherwise(F.coalesce("r", F.lit(0.0)))
    sums = moved.withColumn("first", first).withColumn("r", r).groupBy("code").agg(
        F.sum(F.when(~F.col("late"), F.lit(1))).alias("n"),
        *[(F.exp(F.sum(F.when(side & on, F.col("r")).otherwise(0.0))) - 1).alias(name) for name, side, on in (
            ("train_bh", ~F.col("late"), F.lit(True)), ("train_up", ~F.col("late"), F.col("up")), ("oos_bh", F.col("late"), F.lit(True)), ("oos_up", F.col("late"), F.col("up")))],
    )
    bh = (F.col("train_bh") >= F.col("train_up")) & (F.col("train_bh") >= 0)
    policy = F.when(F.coalesce("n", F.lit(0)) < 2, "hold_up").when(bh, "bh").when(F.col("train_up") >= 0, "hold_up").otherwise("cash")
    found = sums.withColumn("policy", policy)
    oos = F.when(F.col("policy") == "bh", F.col("oos_bh")).when(F.col("policy") == "hold_up", F.col("oos_up")).otherwise(0.0)
    return found.select("code", "train_bh", "train_up", "policy", oos.alias("oos"))

