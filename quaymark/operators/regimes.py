"""Trend regimes of daily bars, and their evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators.machines import by_code
from quaymark.operators.runs import with_run


def regime_features(bars: DataFrame) -> DataFrame:
    """Averages, priors, 60-bar band and range position, the volatility percentile and the directional moves."""
    r = F.log("close") - F.lag(F.log("close")).over(w.by_code())
    rows = bars.withColumns(
        {
            "r": r, "m20": w.mean("close", 20), "m60": w.mean("close", 60),
            "p20": w.lag_ratio("close", 20), "p60": w.lag_ratio("close", 60),
            "band": F.when(w.bar_no() >= 60, w.highest("close", 60) / w.lowest("close", 60) - 1),
        }
    )
    span = w.highest("close", 20) - w.lowest("close", 20)
    rows = rows.withColumn("pos20", F.when(span > 0, (F.col("close") - w.lowest("close", 20)) / span))
    rows = rows.withColumn("rv20", w.realized_vol("r", 20))
    return directional(rows.withColumn("vol_pct", w.trailing_percentile("rv20", 120, 60)))


def directional(bars: DataFrame, n: int = 14, least: int = 7) -> DataFrame:
    """Add ``plus_di, minus_di, adx``: means over ``n`` bars of the upward and downward moves in units of the true range, and of how far they differ."""
    rise = F.col("high") - F.lag("high").over(w.by_code())
    fall = F.lag("low").over(w.by_code()) - F.col("low")
    rows = bars.withColumns({"_tr": w.true_range(), "_rise": rise, "_fall": fall})
    moves = {"_up": F.when((F.col("_rise") > F.col("_fall")) & (F.col("_rise") > 0), F.col("_rise")).otherwise(0.0), "_down": F.when((F.col("_fall") > F.col("_rise")) & (F.col("_fall") > 0), F.col("_fall")).otherwise(0.0)}
    rows = rows.withColumns(moves)
    span = F.nullif(w.mean("_tr", n, least), F.lit(0.0))
    rows = rows.withColumns({"plus_di": 100 * w.mean("_up", n, least) / span, "minus_di": 100 * w.mean("_down", n, least) / span})
    p, m = F.col("plus_di"), F.col("minus_di")
    rows = rows.withColumn("_dx", F.coalesce(100 * F.abs(p - m) / F.nullif(p + m, F.lit(0.0)), F.lit(0.0)))
    return rows.withColumn("adx", w.mean("_dx", n, least)).drop("_tr", "_rise", "_fall", "_up", "_down", "_dx")


def _either(up: Column, down: Column) -> Column:
    """up or down where only one of them holds, else range; unknown does not hold."""
    up, down = F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))
    return F.when(up & ~down, "up").when(down & ~up, "down").otherwise("range")


def raw_regime(rows: DataFrame, kind: str = "stack") -> DataFrame:
    """Add ``raw``: up, down or range from the stack of the means and the returns over 20 and 60 bars.

    ``stack`` takes a trend in order with one of the returns, or a turn by a strong short return; ``soft`` asks for the close beyond both
    means; ``strict`` for clearer returns, a turn only near the means and on a bar that isn't falling; ``cross`` is range while
    the means are close, unless the returns are strong; ``band`` goes by the longer return alone; ``adx`` by the directional moves,
    where they are weak by the stack. Without both means it is range (``band`` and ``adx`` need none).
    """
    zero = F.lit(0.0)
    c, m20, m60 = F.col("close"), F.col("m20"), F.col("m60")
    p20, p60 = F.coalesce("p20", zero), F.coalesce("p60", zero)
    bull, bear, over, under = m20 > m60, m20 < m60, c > m20, c < m20
    if kind == "stack":
        turn_up = over & (p20 >= 0.06) & (bull | (p60 <= -0.08) | (p60 >= 0.08))
        up = (bull & over & ((p60 >= 0.03) | (p20 >= 0.03))) | turn_up
        label = _either(m60.isNotNull() & up, m60.isNotNull() & bear & under & ((p60 <= -0.03) | (p20 <= -0.03)))
    elif kind == "soft":
        label = _either(bull & over & (c >= m60) & ((p60 >= 0.02) | (p20 >= 0.02)), bear & under & (c <= m60) & ((p60 <= -0.02) | (p20 <= -0.02)))
    elif kind == "strict":
        rising = F.coalesce(c >= F.lag("close").over(w.by_code()), F.lit(True))
        washed = (p60 <= -0.08) & (m20 / m60 - 1 > -0.05) & rising
        up = (bull & over & (p60 >= 0.06) & (p20 >= 0)) | (over & (p20 >= 0.06) & (bull | washed | (p60 >= 0.08))) | (bull & over & (p60 >= 0.18) & (p20 >= -0.08))
        label = F.when(F.coalesce(m60.isNotNull() & up, F.lit(False)), "up").when(bear & under & (p60 <= -0.06) & (p20 <= 0), "down").otherwise("range")
    elif kind == "cross":
        strong_up, strong_down = over & ((p20 >= 0.04) | (p60 >= 0.06)), under & ((p20 <= -0.04) | (p60 <= -0.06))
        hug = F.abs(m20 - m60) / c < 0.025
        label = (
            F.when(m60.isNull() | (hug & ~strong_up & ~strong_down), "range")
            .when((bull & over & (c >= m60)) | strong_up, "up")
            .when((bear & under & (c <= m60)) | strong_down, "down")
            .otherwise("range")
        )
    elif kind == "band":
        above = F.coalesce(over, F.lit(False))
        flat = F.coalesce((F.col("band") < 0.22) & (F.abs(p60) < 0.10), F.lit(False))
        label = F.when(flat, "range").when((p60 >= 0.05) & above, "up").when((p60 <= -0.05) & ~above, "down").otherwise("range")
    elif kind == "adx":
        plus, minus = F.coalesce("plus_di", zero), F.coalesce("minus_di", zero)
        weak = _either(bull & (c >= m20) & ((p20 >= 0.02) | (p60 >= 0.03)), bear & (c <= m20) & ((p20 <= -0.02) | (p60 <= -0.03)))
        label = F.when(F.coalesce("adx", zero) < 18, weak).otherwise(_either(plus > minus, minus > plus))
    else:
        raise ValueError(f"no rule {kind}")
    return rows.withColumn("raw", label)


def low_vol_range(rows: DataFrame, label: str) -> DataFrame:
    """Add ``calmed``: range if ten of the last fifteen bars are quiet, unless the priors are large."""
    rows = rows.withColumn("_quiet", F.coalesce(F.col("vol_pct") < 0.35, F.lit(False)))
    quiet = F.sum(F.col("_quiet").cast("int")).over(w.last_rows(15)) >= 10
    large = F.coalesce((F.abs("p60") >= 0.12) | (F.abs("p20") >= 0.08), F.lit(False))
    return rows.withColumn("calmed", F.when(quiet & ~large, "range").otherwise(F.col(label))).drop("_quiet")


def vote(rows: DataFrame, labels: dict[str, float], least: float = 0.45) -> DataFrame:
    """Add ``voted``: the label of the largest weight; ties up, down, range; range if its share is under ``least``."""
    total = sum(labels.values())

    def weight(name: str) -> Column:
        parts = [F.when(F.col(c) == name, v).otherwise(0.0) for c, v in labels.items()]
        return F.round(sum(parts[1:], parts[0]) / total, 6)

    order = [F.struct(weight(name).alias("v"), F.lit(-i).alias("tie"), F.lit(name).alias("label")) for i, name in enumerate(("up", "down", "range"))]
    best = F.greatest(*order)
    return rows.withColumn("voted", F.when(best["v"] >= least, best["label"]).otherwise("range"))


def hold_up(rows: DataFrame, label: str, cost: float = 0.0005) -> DataFrame:
    """Each up run as a hold: in at its first close, out at the first close after it.

    ``code, run_no, entry_d, exit_d, ret``; a run at the end exits at its last close.
    """
    runs = with_run(rows, label).withColumn("next_close", F.coalesce(F.lead("close").over(w.by_code()), F.col("close"))).withColumn(
        "next_d", F.coalesce(F.lead("d").over(w.by_code()), F.col("d"))
    )
    up = runs.where(F.col(label) == "up")
    return up.groupBy("code", "run_no").agg(
        F.min("d").alias("entry_d"), F.max("next_d").alias("exit_d"),
        (F.max_by("next_close", "d") / F.min_by("close", "d") * (1 - 2 * cost) - 1).alias("ret"),
    )


def label_metrics(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per class: support, recall, precision and F1."""
    counts = rows.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    by_truth = counts.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    by_pred = counts.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("called"))
    both = by_truth.join(by_pred, "label", "left")
    recall, precision = F.col("hit") / F.col("support"), F.col("hit") / F.col("called")
    f1 = 2 * F.col("hit") / (F.col("support") + F.coalesce("called", F.lit(0)))
    return both.select("label", "support", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))


def kappa(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: accuracy, balanced accuracy and Cohen's kappa."""
    counts = rows.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(1))  # a few cells of the confusion table
    cells = counts.withColumns(
        {"nt": F.sum("n").over(Window.partitionBy("t")), "np": F.sum("n").over(Window.partitionBy("p")), "all": F.sum("n").over(whole)}
    )
    same = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    facts = cells.agg(
        (F.sum(same) / F.max("all")).alias("accuracy"),
        (F.sum(same / F.col("nt")) / F.countDistinct("t")).alias("balanced"),
        F.sum(F.when(F.col("t") == F.col("p"), F.col("nt") * F.col("np") / (F.col("all") * F.col("all")))).alias("chance"),
    )
    value = (F.col("accuracy") - F.coalesce("chance", F.lit(0.0))) / F.nullif(1 - F.coalesce("chance", F.lit(0.0)), F.lit(0.0))
    return facts.select("accuracy", "balanced", value.alias("kappa"))


def segment_overlap(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """For each true segment, the best overlap over union with a predicted one of the same label.

    Both: code, label, start_no, end_no. The join is by code and label and
    bounded by the overlap of bar numbers.
    """
    a = truth.select("code", "label", "start_no", "end_no")
    b = pred.select("code", "label", F.col("start_no").alias("s"), F.col("end_no").alias("e"))
    met = a.join(b, ["code", "label"], "left").where(F.col("s").isNull() | ((F.col("s") <= F.col("end_no")) & (F.col("e") >= F.col("start_no"))))
    inter = F.least("end_no", "e") - F.greatest("start_no", "s") + 1
    union = (F.col("end_no") - F.col("start_no") + 1) + (F.col("e") - F.col("s") + 1) - inter
    best = met.groupBy("code", "label", "start_no", "end_no").agg(F.max(inter / union).alias("iou"))
    return a.join(best, ["code", "label", "start_no", "end_no"], "left").select("code", "label", "start_no", "end_no", F.coalesce("iou", F.lit(0.0)).alias("iou"))


def budget(rows: DataFrame) -> DataFrame:
    """Add ``tier`` and ``budget`` of a benchmark: two of weak structure, high volatility, 10 % drawdown are stress."""
    weak = F.coalesce((F.col("close") < F.col("ma60")) & (F.col("ma20") < F.col("ma60")), F.lit(False))
    rough = F.coalesce(F.col("rv20") > 1.25 * F.col("rv_median"), F.lit(False))
    deep = F.coalesce(F.col("dd60") <= -0.10, F.lit(False))
    n = weak.cast("int") + rough.cast("int") + deep.cast("int")
    tier = F.when(n >= 2, "stress").when(weak | deep, "defensive").when(rough, "cautious").otherwise("normal")
    share = F.when(n >= 2, F.when(deep, 0.50).otherwise(0.65)).when(weak | deep, 0.82).when(rough, 0.92).otherwise(1.0)
    return rows.withColumns({"tier": tier, "budget": share})


#: Tiers from best to worst, their budgets, and that of stress in a deep fall.
TIERS, SHARES, DEEP = ("normal", "cautious", "defensive", "stress"), (1.0, 0.92, 0.82, 0.65), 0.50


def confirmed_tiers(tiers: list[str], worse: int = 3, better: int = 1, better_low: int = 2, hold: int = 3) -> list[str]:
    """A worse tier counts after ``worse`` days in a row below the one held, a better one after ``better``, from the two lowest after ``better_low``; stress holds for ``hold`` days."""
    rank = {t: i for i, t in enumerate(TIERS)}
    held, down, up, kept, out = tiers[0] if tiers else "", 0, 0, 0, []
    for tier in tiers:
        step = rank[tier] - rank[held]
        down, up = (down + 1 if step > 0 else 0), (up + 1 if step < 0 and not kept else 0)
        if down >= worse:
            held, down = tier, 0
            kept = hold if tier == "stress" else kept
        elif up and up >= (better_low if rank[held] >= 2 else better):
            held, up = tier, 0
        kept = max(kept - 1, 0)
        out.append(held)
    return out


def confirmed_budget(rows: DataFrame) -> DataFrame:
    """``code, d, tier, confirmed, budget``: ``budget`` with its tiers confirmed over days."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        held = confirmed_tiers(g["tier"].tolist())
        share = [DEEP if t == "stress" and deep else SHARES[TIERS.index(t)] for t, deep in zip(held, g["deep"], strict=True)]
        return g.assign(confirmed=held, budget=share)[["code", "d", "tier", "confirmed", "budget"]]

    tiers = budget(rows).select("code", "d", "tier", F.coalesce(F.col("dd60") <= -0.10, F.lit(False)).alias("deep"))
    return by_code(tiers, run, "code string, d date, tier string, confirmed string, budget double")
