"""Fair paths, rails and states of daily bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.functions import windows as w
from quaymark.operators.runs import run_length

#: Panels by name: trailing bars and least bars of a fit.
PANELS = {"fig7": (504, 63), "fig8": (252, 63), "fig9": (126, 63), "fig10": (63, 63), "fig11": (21, 21)}
RAIL_Q = 0.95
RAIL_LEAST = 63
NEAR = 0.01
#: A close this near a rail touches it: the rail may be that very close, but for rounding.
TOUCH = 1e-9


def with_logs(bars: DataFrame) -> DataFrame:
    """Add ``ln_c`` (NULL unless close > 0), ``bar`` and the log return ``r``."""
    ln = F.when(F.col("close") > 0, F.log("close"))
    rows = bars.withColumn("ln_c", ln).withColumn("bar", w.bar_no())
    return rows.withColumn("r", F.col("ln_c") - F.lag("ln_c").over(w.by_code()))


def fair_path(rows: DataFrame, panels: list[str] | None = None) -> DataFrame:
    """Add ``<panel>_path`` and ``<panel>_g`` for each panel, in one pass over the code's rows."""
    columns: dict[str, Column] = {}
    for name in panels or list(PANELS):
        n, least = PANELS[name]
        columns[f"{name}_path"], columns[f"{name}_g"] = w.ols_path("ln_c", "bar", n, least)
    return rows.withColumns(columns)


def rails(rows: DataFrame, panels: list[str] | None = None, q: float = RAIL_Q, lookback: int | None = None) -> DataFrame:
    """Add ``_gap, _lower, _upper`` around each path: the quantile of |ln(close / path)|.

    Over the last ``lookback`` rows, as a window; or over all values so far,
    as a grouped map: a growing window would sort the whole past at each row,
    while the sorted past of a code takes one more value at a time.
    """
    names = panels or list(PANELS)
    gaps = rows.withColumns({f"{p}_gap": F.col("ln_c") - F.log(f"{p}_path") for p in names})
    if lookback is None:
        deltas = _growing_quantiles(gaps, {f"{p}_gap": f"{p}_delta" for p in names}, q)
    else:
        over = w.last_rows(lookback)
        sizes = gaps.withColumns({f"_{p}": F.abs(f"{p}_gap") for p in names})
        deltas = sizes.withColumns({f"{p}_delta": w.expanding_quantile(f"_{p}", q, RAIL_LEAST, over) for p in names})
        deltas = deltas.drop(*[f"_{p}" for p in names])
    out = deltas.withColumns(
        {f"{p}_lower": F.col(f"{p}_path") * F.exp(-F.col(f"{p}_delta")) for p in names}
        | {f"{p}_upper": F.col(f"{p}_path") * F.exp(F.col(f"{p}_delta")) for p in names}
    )
    return out.drop(*[f"{p}_delta" for p in names])


def _growing_quantiles(rows: DataFrame, columns: dict[str, str], q: float) -> DataFrame:
    """Add the quantile so far of the absolute values of some columns, by code in date order."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, T.DoubleType()) for name in columns.values()]])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("d", ignore_index=True)
        return g.assign(**{new: g[old].abs().expanding(min_periods=RAIL_LEAST).quantile(q) for old, new in columns.items()})

    return rows.groupBy("code").applyInPandas(run, schema)


def _sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sum of each row and the n - 1 before it."""
    total = np.concatenate(([0.0], np.cumsum(x)))
    return total[1:] - total[np.maximum(np.arange(1, len(x) + 1) - n, 0)]


def trailing_fit(y: np.ndarray, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Fitted value at each row and slope of the linear fit of the last n rows, from running sums."""
    known = ~np.isnan(y)
    x = np.arange(len(y)) - (len(y) - 1) / 2
    mid = y[known].mean() if known.any() else 0.0
    v, z = np.where(known, x, 0.0), np.where(known, y - mid, 0.0)
    k, sx, sy, sxy, sxx = (_sums(c, n) for c in (known.astype(float), v, z, v * z, v * v))
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (k * sxy - sx * sy) / (k * sxx - sx * sx)
        fitted = mid + (sy - slope * sx) / k + slope * x
    short = k < least
    return np.where(short, np.nan, fitted), np.where(short, np.nan, slope)


def paths_and_rails(rows: DataFrame, names: list[str], q: float = RAIL_Q) -> DataFrame:
    """Add ``_path, _g, _gap, _lower, _upper`` of each panel in one grouped map by code.

    Equal to ``fair_path`` and ``rails``, whose window frames are read anew
    for each row; here each row costs the same however long the panel is.
    """
    parts = ("path", "g", "gap", "lower", "upper")
    fields = [T.StructField(f"{p}_{part}", T.DoubleType()) for p in names for part in parts]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("d", ignore_index=True)
        ln = g["ln_c"].to_numpy(float)
        new = {}
        for p in names:
            fitted, slope = trailing_fit(ln, *PANELS[p])
            gap = ln - fitted
            delta = pd.Series(np.abs(gap)).expanding(min_periods=RAIL_LEAST).quantile(q).to_numpy()
            path = np.exp(fitted)
            values = (path, np.exp(252 * slope) - 1, gap, path * np.exp(-delta), path * np.exp(delta))
            new |= {f"{p}_{part}": v for part, v in zip(parts, values, strict=True)}
        return g.assign(**new)

    return rows.groupBy("code").applyInPandas(run, T.StructType([*rows.schema.fields, *fields]))


def multi_scale(bars: DataFrame, panels: list[str] | None = None, q: float = RAIL_Q) -> DataFrame:
    """Bars with path, growth, rails, gap, touches and side of each panel."""
    names = panels or list(PANELS)
    rows = paths_and_rails(with_logs(bars), names, q)
    flags: dict[str, Column] = {}
    for p in names:
        close = F.col("close")
        flags[f"{p}_touch_lo"] = F.coalesce(close <= F.col(f"{p}_lower") * (1 + TOUCH), F.lit(False))
        flags[f"{p}_touch_hi"] = F.coalesce(close >= F.col(f"{p}_upper") * (1 - TOUCH), F.lit(False))
        flags[f"{p}_near_lo"] = F.coalesce(close <= F.col(f"{p}_lower") * (1 + NEAR), F.lit(False))
        flags[f"{p}_near_hi"] = F.coalesce(close >= F.col(f"{p}_upper") * (1 - NEAR), F.lit(False))
        flags[f"{p}_above"] = F.coalesce(close > F.col(f"{p}_path"), F.lit(False))
        low, high = F.log(f"{p}_lower"), F.log(f"{p}_upper")
        flags[f"{p}_pos"] = F.when(high > low, (F.col("ln_c") - low) / (high - low))
    return rows.withColumns(flags)


def enriched(rows: DataFrame, panel: str = "fig10") -> DataFrame:
    """Add ``path_rising`` (over 20 bars) and ``touched_before`` (the day before)."""
    return rows.withColumns(
        {
            "path_rising": F.coalesce(F.col(f"{panel}_path") > F.lag(f"{panel}_path", 20).over(w.by_code()), F.lit(False)),
            "touched_before": F.coalesce(F.lag(f"{panel}_touch_lo").over(w.by_code()), F.lit(False)),
        }
    )


def signed_percentile(rows: DataFrame, gap: str, name: str, least: int = RAIL_LEAST) -> DataFrame:
    """Add the share of past absolute gaps at most today's, with today's sign."""
    held = F.collect_list(F.abs(gap)).over(w.so_far())
    share = F.size(F.filter(held, lambda x: x <= F.abs(gap))) / F.size(held)
    return rows.withColumn(name, F.when((F.size(held) >= least) & F.col(gap).isNotNull(), share * F.signum(gap)))


def moving_averages(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"ma{n}": w.mean("close", n) for n in (5, 10, 20, 60)})


def atr(rows: DataFrame, n: int = 20) -> DataFrame:
    ranged = rows.withColumn("tr", w.true_range())
    return ranged.withColumn("atr", w.mean("tr", n))


def vol_regime(bars: DataFrame, days: int = 5, history: int = 252, least: int = 60) -> DataFrame:
    """Add ``rv``, its trailing percentile ``rv_pct`` and ``vol_state``."""
    rows = with_logs(bars) if "r" not in bars.columns else bars
    rows = rows.withColumn("rv", w.realized_vol("r", days))
    rows = rows.withColumn("rv_pct", w.trailing_percentile("rv", history, least))
    p = F.col("rv_pct")
    state = F.when(p <= 0.30, "calm").when(p < 0.70, "normal").when(p < 0.90, "cluster").when(p.isNotNull(), "extreme")
    return rows.withColumn("vol_state", state)


def fair_need(rows: DataFrame, anchor: DataFrame, erp: float = 0.05, days: int = 20) -> DataFrame:
    """Add the return a code's risk asks for and what it gave: ``need, period_need, need_gap``.

    ``anchor``: d, anchor_rv, one row a day, so the join adds no rows.
    """
    need = erp * F.col("rv") / F.col("anchor_rv")
    period = F.pow(1 + need, days / 252) - 1
    realized = F.col("close") / F.lag("close", days).over(w.by_code()) - 1
    joined = rows.join(anchor, "d", "left").withColumn("need", F.when(F.col("anchor_rv") > 0, need))
    period = F.pow(1 + F.col("need"), days / 252) - 1
    return joined.withColumn("period_need", period).withColumn("need_gap", realized - F.col("period_need"))


def coverage(rows: DataFrame, panel: str = "fig9") -> DataFrame:
    """Share of closes inside the rails, overall, by year and by volatility state, with the pass gate.

    ``rows`` need rails and ``vol_state``. Clustered states have no upper limit.
    """
    inside = F.col("close").between(F.col(f"{panel}_lower") * (1 - TOUCH), F.col(f"{panel}_upper") * (1 + TOUCH)).cast("double")
    known = rows.where(F.col(f"{panel}_lower").isNotNull()).select(
        F.year("d").cast("string").alias("year"), F.col("vol_state").alias("state"), inside.alias("inside")
    )
    sets = known.groupingSets([[], ["year"], ["state"]], "year", "state").agg(
        F.grouping("year").alias("no_year"), F.grouping("state").alias("no_state"),
        F.count("*").alias("n"), F.avg("inside").alias("coverage"),
    )
    kind = F.when(F.col("no_year") == 0, "year").when(F.col("no_state") == 0, "state").otherwise("all")
    value = F.coalesce(F.when(F.col("no_year") == 0, F.col("year")).when(F.col("no_state") == 0, F.col("state")), F.lit("-"))
    free = (kind == "state") & value.isin("cluster", "extreme")
    ok = (F.col("coverage") >= 0.90) & (free | (F.col("coverage") <= 0.98))
    return sets.select(kind.alias("kind"), value.alias("value"), "n", "coverage", ok.alias("ok"))


def full_fit(bars: DataFrame) -> DataFrame:
    """Per code: log-linear growth over all bars and growth from end to end, a year."""
    rows = with_logs(bars).where("ln_c is not null")
    return rows.groupBy("code").agg(
        (F.exp(252 * F.regr_slope(F.col("ln_c"), F.col("bar"))) - 1).alias("ols_growth"),
        (F.exp(252 * (F.max_by("ln_c", "bar") - F.min_by("ln_c", "bar")) / F.nullif(F.max("bar") - F.min("bar"), F.lit(0))) - 1).alias("cagr"),
        F.count("*").alias("n"),
    )


def quiet_discount(rows: DataFrame, anchor: DataFrame | None = None, gap: float = -0.12, calm: float = 0.30) -> DataFrame:
    """Add ``qd_entry``, a level: far below the two-year path or at its lower rail, both long growths positive, five-day volatility low
    among 120 days, a 20-day return no better than its risk asks for, and no upper rail touched.

    ``rows`` have four panels and log returns; ``anchor`` (d, anchor_rv) defaults to each day's mean 20-day volatility.
    """
    rows = rows.withColumns({"rv5": w.realized_vol("r", 5), "rv": w.realized_vol("r", 20)})
    rows = fair_need(rows.withColumn("vol5_pct", w.trailing_percentile("rv5", 120, 60)), daily_anchor(rows) if anchor is None else anchor)
    low, hot = F.coalesce(F.col("fig7_gap") <= gap, F.lit(False)) | F.col("fig7_touch_lo"), F.col("fig9_touch_hi") | F.col("fig10_touch_hi")
    on = low & (F.col("fig7_g") > 0) & (F.col("fig8_g") > 0) & (F.col("vol5_pct") <= calm) & (F.col("need_gap") <= 0) & ~hot
    return rows.withColumn("qd_entry", F.coalesce(on, F.lit(False)))


def six_states(rows: DataFrame) -> DataFrame:
    """Add ``state``: warm_up, overheat, knife, down, up, repair or chop, first that holds.

    A knife is at least ten closes in a row below the quarter path.
    """
    below = rows.withColumn("_below", F.coalesce(F.col("close") < F.col("fig10_path"), F.lit(False)))
    counted = run_length(below, "_below", "below_run")
    g9, g10 = F.col("fig9_g"), F.col("fig10_g")
    state = (
        F.when(F.col("fig9_lower").isNull() | F.col("fig10_lower").isNull(), "warm_up")
        .when(F.col("fig9_touch_hi") & F.col("fig10_touch_hi"), "overheat")
        .when((F.col("below_run") >= 10) & (g10 < 0), "knife")
        .when((g9 < 0) & (g10 < 0), "down")
        .when((g9 > 0) & (g10 > 0), "up")
        .when((g9 < 0) & (g10 > 0), "repair")
        .otherwise("chop")
    )
    return counted.withColumn("state", state).drop("_below")


def benchmark_features(bars: DataFrame) -> DataFrame:
    """Weekday-filled closes with averages, 20-bar volatility and its shifted median, and drawdown."""
    rows = with_logs(bars).withColumns({"ma20": w.mean("close", 20), "ma60": w.mean("close", 60)})
    rows = rows.withColumn("rv20", w.realized_vol("r", 20))
    past = w.rows_before(120)
    return rows.withColumns(
        {
            "rv_median": F.when(F.count("rv20").over(past) >= 60, F.percentile("rv20", 0.5).over(past)),
            "dd60": F.col("close") / F.max("close").over(w.last_rows(60)) - 1,
        }
    )


def daily_anchor(rows: DataFrame) -> DataFrame:
    """The mean realized volatility of each day, as an anchor: ``d, anchor_rv``."""
    return rows.groupBy("d").agg(F.avg("rv").alias("anchor_rv"))


def cross_section(rows: DataFrame, name: str) -> DataFrame:
    """Add ``<name>_mean`` over the codes present that day and ``<name>_excess``."""
    mean = F.avg(name).over(Window.partitionBy("d"))
    return rows.withColumn(f"{name}_mean", mean).withColumn(f"{name}_excess", F.col(name) - F.col(f"{name}_mean"))
