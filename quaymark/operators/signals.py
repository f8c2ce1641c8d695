"""Buy and sell rules over feature rows, and tests of their signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w

# Thresholds of the rules.
STOP_SHARE = 0.94
REWARD_RISK = 2.0
YOUNG_YEARS = 1.9
BREADTH_CONCENTRATED, BREADTH_ORDINARY = 0.08, 0.05


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def aux_signals(rows: DataFrame) -> DataFrame:
    """Add ``aux_buy`` and ``aux_sell``: price against its averages, recent gaps, no opposite touch."""
    gap5 = w.lag_ratio("close", 5)
    gap20 = w.lag_ratio("close", 20)
    buy = (F.col("close") < F.col("ma20")) & (F.col("ma5") < F.col("ma20")) & (gap5 <= 0) & (gap20 <= 0) & ~F.col("fig10_touch_hi")
    sell = (F.col("close") > F.col("ma20")) & (F.col("ma5") > F.col("ma20")) & (gap5 >= 0) & (gap20 >= 0)
    return rows.withColumns({"aux_buy": flag(buy), "aux_sell": flag(sell)})


def entry_masks(rows: DataFrame) -> DataFrame:
    """Add the mask variants raw, edge, aux, aux_edge, aux_extrema and leave on the half-year rail."""
    near = rows.withColumn("near", flag(F.col("fig9_near_lo")))
    found = near.withColumns({"edge": w.rising("near"), "left_lo": w.falling("near")})
    return found.withColumns(
        {
            "m_raw": F.col("near"),
            "m_edge": F.col("edge"),
            "m_aux": F.col("near") & F.col("aux_buy"),
            "m_aux_edge": F.col("edge") & F.col("aux_buy"),
            "m_aux_extrema": F.col("near") & F.col("aux_buy") & w.is_low("close", 10),
            "m_leave": F.col("left_lo") & flag(F.col("close") > F.lag("close").over(w.by_code())),
        }
    )


def checklist(rows: DataFrame) -> DataFrame:
    """Add b1, b2, b3, b5, their stop, target and reward to risk, and ``verdict``."""
    young = w.bar_no() < F.lit(int(YOUNG_YEARS * 252))
    b1 = flag(F.col("fig9_near_lo") | F.col("fig10_near_lo"))
    b2 = flag((F.col("fig8_g") > 0) | (~young & (F.col("fig7_g") > 0)))
    b3 = flag(F.col("fig10_touch_lo") | (F.col("fig11_g") > F.col("fig10_g")))
    stop = F.coalesce(F.col("close") - F.col("atr"), F.col("close") * STOP_SHARE)
    target = F.col("fig10_path")
    valid = (F.col("close") > 0) & (stop > 0) & (stop < F.col("close")) & (target > F.col("close"))
    rr = F.when(valid, (target - F.col("close")) / (F.col("close") - stop))
    s1 = flag(F.col("fig9_touch_hi") & F.col("fig10_touch_hi"))
    out = rows.withColumns({"b1": b1, "b2": b2, "b3": b3, "s1": s1, "stop": stop, "rr": rr})
    out = out.withColumn("b5", flag(F.col("rr") >= REWARD_RISK))
    verdict = (
        F.when(F.col("s1"), "trim_or_sell")
        .when(F.col("b1") & F.col("b2") & F.col("b3") & F.col("b5"), "strong_aux_buy")
        .when(F.col("b1") & F.col("b2") & F.col("b3"), "aux_buy_watch")
        .when(F.col("b1") & ~F.col("b2"), "avoid_falling_knife")
        .when(F.col("b1") & F.col("b2"), "observe_no_entry")
        .otherwise("neutral")
    )
    return out.withColumn("verdict", verdict)


def rule_masks(rows: DataFrame) -> DataFrame:
    """Add the daily rule masks: ae_buy, ae_sell, deep_buy, fast, long_sell and keep_trend."""
    near_lo, near_hi = flag(F.col("fig9_near_lo")), flag(F.col("fig9_near_hi"))
    rows = rows.withColumns({"_lo": near_lo, "_hi": near_hi, "_fast": flag(w.lag_ratio("close", 40) >= 0.20)})
    pos_gain = F.col("fig9_pos") - F.lag("fig9_pos", 10).over(w.by_code())
    trend = (
        (F.col("fig7_g") > 0) & (F.col("fig8_g") > 0) & (pos_gain >= 0.30) & (F.col("fig9_pos") >= 0.80)
        & ~F.col("fig9_touch_hi") & (F.col("fig10_g") > F.col("fig9_g"))
    )
    return rows.withColumns(
        {
            "ae_buy": w.rising("_lo") & F.col("aux_buy"),
            "ae_sell": w.rising("_hi") & F.col("aux_sell"),
            "deep_buy": flag((F.exp("fig9_gap") - 1 <= -0.08) & F.col("_lo")),
            "fast": w.any_in("_fast", 60),
            "long_sell": flag(F.col("fig8_touch_hi")),
            "keep_trend": flag(trend),
        }
    ).drop("_lo", "_hi", "_fast")


def classify(bars: DataFrame) -> DataFrame:
    """Per code: bars, yearly volatility, growth, worst drawdown, crossings of the mean, and ``kind``."""
    rows = bars.withColumns({"bar": w.bar_no(), "r": F.log("close") - F.lag(F.log("close")).over(w.by_code()), "ma60": w.mean("close", 60)})
    rows = rows.withColumns({"dd": w.drawdown("close"), "above": F.when(F.col("ma60").isNotNull(), F.col("close") > F.col("ma60"))})
    crossed = F.col("above") != F.lag("above").over(w.by_code())
    rows = rows.withColumn("crossed", F.coalesce(crossed.cast("int"), F.lit(0)))
    facts = rows.groupBy("code").agg(
        F.count("*").alias("n"),
        (F.stddev_samp("r") * F.sqrt(F.lit(250.0))).alias("vol"),
        (F.pow(F.max_by("close", "bar") / F.min_by("close", "bar"), 250 / F.nullif(F.max("bar") - 1, F.lit(0))) - 1).alias("cagr"),
        F.min("dd").alias("mdd"),
        (F.sum("crossed") * 250 / F.count("*")).alias("crossings"),
    )
    kind = (
        F.when(F.col("n") < 250, "short")
        .when((F.col("vol") >= 0.30) & (F.col("cagr") >= 0.10), "high_vol")
        .when((F.col("mdd") <= -0.40) | (F.col("cagr") < 0.05), "cycle")
        .when((F.col("vol") < 0.18) & (F.col("crossings") >= 9), "smooth")
        .otherwise("trend")
    )
    return facts.withColumn("kind", kind)


def cooldown(rows: DataFrame, signal: str, bars_apart: int) -> DataFrame:
    """Keep a signal only if ``bars_apart`` or more bars passed since the last kept one.

    A fold over the code's signal bars, in Spark: ``code, d, bar`` of those kept.
    """
    numbered = rows.withColumn("bar", w.bar_no()).where(flag(F.col(signal))).select("code", "d", "bar")
    held = numbered.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("bar", "d"))).alias("all"))
    start = F.slice("all", 1, 0)

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        free = last.isNull() | (x["bar"] - last["bar"] >= bars_apart)
        return F.when(free, F.array_append(kept, x)).otherwise(kept)

    return held.select("code", F.explode(F.aggregate("all", start, step)).alias("k")).select("code", "k.d", "k.bar")


def forward_returns(rows: DataFrame, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Add returns from the next open and, for 20 bars, the lowest low ahead; NULL when immature."""
    entry = F.lead("open", 1).over(w.by_code())
    out = rows.withColumns({f"fwd_{h}": F.lead("close", h).over(w.by_code()) / entry - 1 for h in horizons})
    ahead = w.next_rows(1, 20)
    return out.withColumn("mae_20", F.when(F.count("low").over(ahead) == 20, F.min("low").over(ahead) / entry - 1))


def signal_trades(rows: DataFrame, signal: str, stop: float = 0.9, last_day: int = 19) -> DataFrame:
    """Each signal as its own trade: next close in; out one bar after a stop or the last day.

    ``code, signal_d, entry_px, exit_d, exit_px, reason, ret``; open trades
    have no exit. Every signal meets only its own next ``last_day`` bars, an
    equi-join by code bounded by bar numbers.
    """
    numbered = rows.withColumn("bar", w.bar_no())
    entries = numbered.withColumns(
        {"entry_bar": F.col("bar") + 1, "entry_px": F.lead("close").over(w.by_code())}
    ).where(flag(F.col(signal)) & (F.col("entry_px") > 0)).select("code", F.col("d").alias("signal_d"), "entry_bar", "entry_px")
    path = numbered.select("code", F.col("bar").alias("at"), F.col("close").alias("c"), F.lead("d").over(w.by_code()).alias("next_d"),
                           F.lead("close").over(w.by_code()).alias("next_c"))
    days = F.explode(F.sequence(F.lit(1), F.lit(last_day))).alias("days")
    watched = entries.select("*", days).withColumn("at", F.col("entry_bar") + F.col("days")).join(path, ["code", "at"], "left")
    hit = F.when(F.col("c") <= stop * F.col("entry_px"), F.lit("stop")).when(F.col("days") == last_day, F.when(F.col("c").isNotNull(), F.lit("expiry")))
    first = F.min(F.when(hit.isNotNull(), F.struct("days", hit.alias("reason"), "next_d", "next_c"))).alias("x")
    found = watched.groupBy("code", "signal_d", "entry_bar", "entry_px").agg(first)
    return found.select(
        "code", "signal_d", "entry_px", F.col("x.next_d").alias("exit_d"), F.col("x.next_c").alias("exit_px"),
        F.when(F.col("x.next_c").isNotNull(), F.col("x.reason")).otherwise("open").alias("reason"),
        (F.col("x.next_c") / F.col("entry_px") - 1).alias("ret"),
    )


def breadth(rows: DataFrame, signal: str, least_bars: int = 250) -> DataFrame:
    """Per day: codes old enough, those with the signal, their share, and its tier."""
    numbered = rows.withColumn("bar", w.bar_no()).where(F.col("bar") >= least_bars)
    daily = numbered.groupBy("d").agg(F.count("*").alias("pool"), F.sum(flag(F.col(signal)).cast("long")).alias("buys"))
    share = F.col("buys") / F.col("pool")
    tier = (
        F.when(F.col("buys") == 0, "none").when(share >= BREADTH_CONCENTRATED, "concentrated")
        .when(share >= BREADTH_ORDINARY, "ordinary").otherwise("lone")
    )
    return daily.withColumns({"share": share, "tier": tier})


def basket(rows: DataFrame, signal: str, hold: int = 20) -> DataFrame:
    """Daily mean return of all open holds: ``d, n_open, ret, equity, dd``; days without holds return 0."""
    numbered = rows.withColumns({"bar": w.bar_no(), "day_ret": w.lag_ratio("close", 1), "first_ret": F.col("close") / F.col("open") - 1})
    entries = numbered.where(flag(F.col(signal))).select("code", (F.col("bar") + 1).alias("entry"))
    spans = entries.select("code", "entry", F.explode(F.sequence(F.col("entry"), F.col("entry") + hold - 1)).alias("bar"))
    held = spans.join(numbered.select("code", "bar", "d", "day_ret", "first_ret"), ["code", "bar"])
    ret = F.when(F.col("bar") == F.col("entry"), F.col("first_ret")).otherwise(F.col("day_ret"))
    daily = held.groupBy("d").agg(F.count("*").alias("n_open"), F.avg(ret).alias("ret"))
    calendar = rows.select("d").distinct()
    filled = calendar.join(daily, "d", "left").select("d", F.coalesce("n_open", F.lit(0)).alias("n_open"), F.coalesce("ret", F.lit(0.0)).alias("ret"))
    so_far = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row a day, of all codes
    grown = filled.withColumn("equity", F.exp(F.sum(F.log1p("ret")).over(so_far)))
    return grown.withColumn("dd", F.col("equity") / F.max("equity").over(so_far) - 1)


def summary(rows: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, median, hit rate and 10 % quantile of a return."""
    return rows.where(F.col(name).isNotNull()).groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(name).alias("mean"), F.percentile(name, 0.5).alias("median"),
        F.avg((F.col(name) > 0).cast("double")).alias("hit"), F.percentile(name, 0.1).alias("p10"),
    )


def excess_t(rows: DataFrame, name: str) -> DataFrame:
    """t statistic of the mean of daily means; NULL under three days."""
    daily = rows.where(F.col(name).isNotNull()).groupBy("d").agg(F.avg(name).alias("m"))
    t = F.avg("m") / F.nullif(F.stddev_samp("m"), F.lit(0.0)) * F.sqrt(F.count("*"))
    return daily.agg(F.count("*").alias("days"), F.avg("m").alias("mean"), F.when(F.count("*") >= 3, t).alias("t"))


def early_down(rows: DataFrame, regime: Column | None = None) -> DataFrame:
    """Add soft_bear, peak8, classic_bear, early and ``alert`` (none, watch in a down regime, alert); ``rows`` have ma20 and ma60."""
    zero = F.lit(0.0)
    p20, p60 = F.coalesce(w.lag_ratio("close", 20), zero), F.coalesce(w.lag_ratio("close", 60), zero)
    dd20 = F.coalesce(F.col("close") / w.highest("close", 20) - 1, zero)
    below = flag(F.col("close") < F.col("ma20"))
    out = rows.withColumns({"soft_bear": below & (p60 <= -0.06) & (p20 <= 0), "peak8": below & (p60 <= -0.06) & (dd20 <= -0.08)})
    out = out.withColumns({"early": F.col("soft_bear") | F.col("peak8"), "classic_bear": F.col("soft_bear") & flag(F.col("ma20") < F.col("ma60"))})
    down = flag(regime == "down") if regime is not None else F.lit(False)
    return out.withColumn("alert", F.when(~F.col("early"), "none").when(down, "watch").otherwise("alert"))


def recovery_up(rows: DataFrame, label: str, alert: str, days: int = 60, pit: int = 5, rebound: float = 0.10, streak: int = 3, gain: float = 0.03) -> DataFrame:
    """Add ``fired`` and ``recovery``: a range that climbs out of a pit, and how long that holds.

    It fires in a range (``label``) without an ``alert`` at that bar, after ``streak`` closes above the short mean, if the last ``days``
    bars hold ``pit`` closes in a row below the long mean or a ``rebound`` from their low, and the 20-bar return is ``gain`` or the
    rebound is there. It holds from a firing until a bar that is no range, has an alert or closes at or below the short mean.
    """
    above = flag(F.col("close") > F.col("ma20"))
    rows = rows.withColumns({"_over": above, "_pit": flag(F.col("close") < F.col("ma60"))})
    risen = F.col("close") / w.lowest("close", days) - 1 >= rebound
    whole = F.count("close").over(w.last_rows(days)) == days
    run = F.sum(F.col("_over").cast("int")).over(w.last_rows(streak)) == streak
    open_ = flag(F.col(label) == "range") & ~flag(F.col(alert) == "alert") & F.col("_over")
    fired = whole & run & (w.run_in_window("_pit", days, pit) | risen) & ((w.lag_ratio("close", 20) >= gain) | risen)
    rows = rows.withColumns({"_open": open_, "fired": open_ & flag(fired)})
    rows = rows.withColumn("_stretch", F.sum((~F.col("_open")).cast("int")).over(w.so_far()))
    so_far = Window.partitionBy("code", "_stretch").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("recovery", F.col("_open") & F.max("fired").over(so_far))
    return held.drop("_over", "_pit", "_open", "_stretch")


def extreme_drop(signals: DataFrame, returns: DataFrame, limit: float = -0.07) -> DataFrame:
    """Signals with ``side`` and ``source`` after the override: a fall of 7 % without a model down is one.

    Both by ``as_of, code``; signals have ``switch_side`` (NULL for none).
    """
    both = signals.join(returns, ["as_of", "code"], "left")
    drop = flag(F.col("day_ret") <= limit) & ~flag(F.col("switch_side") == "down")
    return both.withColumns(
        {"side": F.when(drop, "down").otherwise(F.col("switch_side")),
         "source": F.when(drop, "extreme_drop").when(F.col("switch_side").isNotNull(), "model").otherwise("none")}
    )


def pick_per_group(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first row of each group by ``order``."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def beat_anchor(bars: DataFrame, anchor: str, days: int = 60, top: int = 3, keep: float = 0.0, allowed: DataFrame | None = None) -> DataFrame:
    """Per day, the ``top`` codes whose momentum beats the anchor's share what the anchor does not ``keep`` equally; without any the anchor has all.

    ``allowed`` (code, d), if given, limits the codes of each day; the anchor needs no leave.
    """
    rows = bars.withColumn("mom", w.lag_ratio("close", days)).where(F.col("mom").isNotNull()).select("code", "d", "mom")
    base = rows.where(F.col("code") == anchor).select("d", F.col("mom").alias("anchor_mom"))
    others = rows.where(F.col("code") != anchor)
    if allowed is not None:
        others = others.join(allowed.select("code", "d"), ["code", "d"], "left_semi")
    better = others.join(base, "d").where("mom > anchor_mom")
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("mom"), "code"))
    chosen = better.withColumn("rank", rank).where(F.col("rank") <= top)
    chosen = chosen.withColumn("weight", (1 - keep) / F.count("*").over(Window.partitionBy("d"))).select("d", "code", "weight")
    turned = base.join(chosen.select("d", F.lit(True).alias("some")).distinct(), "d", "left")
    own = turned.select("d", F.lit(anchor).alias("code"), F.when(F.col("some"), F.lit(float(keep))).otherwise(1.0).alias("weight"))
    return chosen.unionByName(own.where("weight > 0"))


def tail_veto(rows: DataFrame, q05: str, match: str | None = None, share: float = 0.25) -> DataFrame:
    """Rows that pass a day's floor of ``q05``: its ``share`` quantile among the codes that have one; with ``match`` among, and only for, those with a match of 1 or more."""
    known = rows.where(F.col(q05 if match is None else match).isNotNull())
    day = Window.partitionBy("d")
    passed = known.withColumn("floor", F.percentile(q05, F.lit(share)).over(day)).where(F.col(q05) >= F.col("floor"))
    return passed if match is None else passed.where(F.col(match) >= 1)


def extrema_candidates(rows: DataFrame, back: int = 10, knife: str = "gap_touch") -> DataFrame:
    """Add ``buy`` and ``sell``: below (above) falling (rising) short means with both returns under (over) what risk asks, at the least (greatest) close of ``back`` bars.

    ``knife`` asks for more: a 20-day gap of 2 % (``gap``), a rail touched or for a buy a long discount of 5 % (``touch``), or both. ``rows``: close,
    ma5, ma20, gap_5, gap_20, fig7_gap and the touches of fig9 and fig10.
    """
    c, g5, g20 = F.col("close"), F.col("gap_5"), F.col("gap_20")
    top, low = F.col("fig9_touch_hi") | F.col("fig10_touch_hi"), F.col("fig9_touch_lo") | F.col("fig10_touch_lo")
    buy = (c < F.col("ma20")) & (F.col("ma5") < F.col("ma20")) & (g5 <= 0) & (g20 <= 0) & ~top & w.is_low("close", back)
    sell = (c > F.col("ma20")) & (F.col("ma5") > F.col("ma20")) & (g5 >= 0) & (g20 >= 0) & w.is_high("close", back)
    if knife not in ("none", "gap", "touch", "gap_touch"):
        raise ValueError(f"no knife {knife}")
    if "gap" in knife:
        buy, sell = buy & (g20 <= -0.02), sell & (g20 >= 0.02)
    if "touch" in knife:
        buy, sell = buy & (flag(low) | flag(F.col("fig7_gap") <= -0.05)), sell & top
    return rows.withColumns({"buy": flag(buy), "sell": flag(sell)})


def alternating_trades(rows: DataFrame, buy: str, sell: str) -> DataFrame:
    """Trades of a long position that ``buy`` opens and ``sell`` closes, each at the next close; ``code, trade_no, signal_d, entry_d, leave_d, exit_d, entry_px, exit_px, ret, bars_held``.

    Signals while the position is as they want it are passed over: of each run of one kind the first counts, from the
    first buy on. The last bar gives no signal; an open trade is marked at it and has no leave or exit day.
    """
    order = Window.partitionBy("code").orderBy("d")
    ends = {"bar": F.row_number().over(order), "next_d": F.lead("d").over(order), "next_c": F.lead("close").over(order)}
    last = Window.partitionBy("code")
    rows = rows.withColumns(ends).withColumns({"last_c": F.max_by("close", "bar").over(last), "last_bar": F.max("bar").over(last)})
    kind = F.when(F.col(buy), "buy").when(F.col(sell), "sell")
    marks = rows.withColumn("kind", kind).where(F.col("kind").isNotNull() & F.col("next_d").isNotNull())
    marks = marks.withColumn("was", F.coalesce(F.lag("kind").over(order), F.lit("sell"))).where("kind <> was")
    after = {f"x_{c}": F.lead(c).over(order) for c in ("d", "next_d", "next_c", "bar")}
    trades = marks.withColumns(after).where("kind = 'buy'")
    px = F.coalesce("x_next_c", "last_c")
    return trades.select(
        "code", F.row_number().over(order).alias("trade_no"), F.col("d").alias("signal_d"), F.col("next_d").alias("entry_d"), F.col("x_d").alias("leave_d"), F.col("x_next_d").alias("exit_d"),
        F.col("next_c").alias("entry_px"), px.alias("exit_px"), (px / F.col("next_c") - 1).alias("ret"), (F.coalesce(F.col("x_bar") + 1, "last_bar") - F.col("bar") - 1).alias("bars_held"),
    )


def event_equity(rows: DataFrame, action: str, hold: int = 5, cost: float = 0.0010) -> DataFrame:
    """``d, n, ret, equity, fall`` of equal weights over all positions open on a day.

    A row with ``action`` buy or sell opens one at the next open, held to the close ``hold`` bars after the signal; a sell counts the negative of
    its path. The first day, from open to close, bears the ``cost``. Signals without ``hold`` bars after them are left out. A
    bar belongs to at most ``hold`` positions of its code, so the join by bar adds no more rows than that.
    """
    numbered = rows.withColumns({"bar": w.bar_no(), "day_ret": F.col("close") / F.lag("close").over(w.by_code()) - 1, "open_ret": F.col("close") / F.col("open") - 1})
    size = numbered.withColumn("_n", F.count("*").over(Window.partitionBy("code")))
    taken = size.where(F.col(action).isin("buy", "sell") & (F.col("bar") + hold <= F.col("_n")))
    taken = taken.select("code", F.col("bar").alias("at"), F.when(F.col(action) == "buy", 1.0).otherwise(-1.0).alias("sign"), F.explode(F.sequence(F.lit(1), F.lit(hold))).alias("k"))
    held = taken.withColumn("bar", F.col("at") + F.col("k")).join(numbered.select("code", "bar", "d", "day_ret", "open_ret"), ["code", "bar"])
    part = F.when(F.col("k") == 1, F.col("sign") * F.col("open_ret") - cost).otherwise(F.col("sign") * F.col("day_ret"))
    days = held.groupBy("d").agg(F.count("*").alias("n"), F.avg(part).alias("ret"))
    so_far = Window.orderBy("d")  # one row a day
    curve = days.withColumn("equity", F.exp(F.sum(F.log(F.col("ret") + 1)).over(so_far)))
    return curve.withColumn("fall", F.col("equity") / F.greatest(F.max("equity").over(so_far), F.lit(1.0)) - 1)


def after_anchor(bars: DataFrame, anchor: str, windows: tuple[int, ...] = (20, 60)) -> DataFrame:
    """Per code and window: ``ret, upside, drawdown`` over the bars after the last market day up to ``anchor``, and the return's share of rank.

    A window counts market days (days of any code); one that ends beyond the last day, or in which a code has no bar, is NULL, and so are codes without a bar on the anchor day.
    """
    days = bars.select("d").distinct().withColumn("day", F.row_number().over(Window.orderBy("d")))  # one row a day
    start = days.where(F.col("d") <= F.lit(anchor).cast("date")).agg(F.max("day").alias("start"))
    end = days.agg(F.max("day").alias("end"))
    rows = bars.join(days, "d").join(F.broadcast(start)).join(F.broadcast(end))  # both of one row
    base = rows.where("day = start AND close > 0").select("code", F.col("close").alias("base"))
    spans = F.explode(F.array(*map(F.lit, windows))).alias("days")
    codes = rows.select("code").distinct().join(base, "code", "left").select("code", "base", spans)
    ahead = rows.select("code", "day", "close", "start", "end", spans).where((F.col("day") > F.col("start")) & (F.col("day") <= F.col("start") + F.col("days")) & (F.col("start") + F.col("days") <= F.col("end")))
    facts = ahead.groupBy("code", "days").agg(F.max_by("close", "day").alias("last"), F.max("close").alias("most"), F.min("close").alias("least"))
    found = codes.join(facts, ["code", "days"], "left").select("code", "days", *[(F.col(c) / F.col("base") - 1).alias(n) for c, n in (("last", "ret"), ("most", "upside"), ("least", "drawdown"))])
    ranked = found.where("ret IS NOT NULL")
    return found.where("ret IS NULL").withColumn("rank", F.lit(None).cast("double")).unionByName(ranked.withColumn("rank", w.average_rank(["days"], "ret")))
