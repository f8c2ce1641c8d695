"""Swings of closes as labels: in hindsight from all bars, and as they become known.

Turning points come from a fold over each code's smoothed closes; legs between
them, their merging and the labels of the bars are windows and joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators.machines import by_code

HIGH, LOW = "H", "L"


def smoothed(rows: DataFrame, n: int = 8) -> DataFrame:
    """Add ``i`` (from 0), ``smooth`` (mean of the last ``n`` closes) and ``turn``: H or L where it is no lower, or no higher, than its neighbours."""
    rows = rows.withColumns({"i": w.bar_no() - 1, "smooth": F.avg("close").over(w.last_rows(n))})
    before, after = F.lag("smooth").over(w.by_code()), F.lead("smooth").over(w.by_code())
    s = F.col("smooth")
    return rows.withColumn("turn", F.when((s >= before) & (s >= after), HIGH).when((s <= before) & (s <= after), LOW))


def further(kind: str, now: float, held: float) -> bool:
    return now >= held if kind == HIGH else now <= held


def turning_points(turns: list[tuple[int, str, float]], first: float, prom: float, apart: int) -> list[tuple[int, str]]:
    """Alternating highs and lows: the next kind counts once it lies ``prom`` and ``apart`` bars from the one held; until then the held one may move on."""
    found, kind, at, level = [], None, 0, first
    for i, k, s in turns:
        if kind is not None and k != kind:
            if abs(s - level) / max(level, 1e-8) < prom or i - at < apart:
                continue
            found.append((at, kind))
        elif kind is not None and not further(k, s, level):
            continue
        kind, at, level = k, i, s
    return [*found, (at, kind or LOW)]


def swing_points(rows: DataFrame, prom: float = 0.18, apart: int = 25) -> DataFrame:
    """``code, i, kind``: the turning points of each code, with its first and last bar."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        near = g[g["turn"].notna()]
        points = turning_points(list(zip(near["i"], near["turn"], near["smooth"], strict=True)), float(g["smooth"].iloc[0]), prom, apart)
        other = {HIGH: LOW, LOW: HIGH}
        if points[0][0] > 0:
            points.insert(0, (0, other[points[0][1]]))
        if points[-1][0] < len(g) - 1:
            points.append((len(g) - 1, other[points[-1][1]]))
        return pd.DataFrame([(g["code"].iloc[0], int(i), k) for i, k in points], columns=["code", "i", "kind"])

    return by_code(smoothed(rows).select("code", "d", "i", "smooth", "turn"), run, "code string, i long, kind string")


def swing_labels(rows: DataFrame, prom: float = 0.18, apart: int = 25, up: float = 0.22, down: float = -0.22, shortest: int = 30, least: int = 60) -> DataFrame:
    """``code, d, label``: up for legs from a low to a high that gain ``up``, down for the reverse, else range.

    Legs of one label join; a joined leg of fewer than ``shortest`` bars takes the label before it. Codes of fewer than ``least`` bars are range.
    Each label rests on later bars, so it serves evaluation only.
    """
    numbered = rows.select("code", "d", "close").withColumns({"i": w.bar_no() - 1, "_n": F.count("*").over(Window.partitionBy("code"))})
    points = swing_points(rows, prom, apart).join(numbered.select("code", "i", "close"), ["code", "i"])
    order = Window.partitionBy("code").orderBy("i")
    legs = points.select("code", "i", "kind", "close", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("i", "kind", "close")]).where("next_i IS NOT NULL")
    gain = F.col("next_close") / F.col("close") - 1
    rises, falls = (F.col("kind") == LOW) & (F.col("next_kind") == HIGH), (F.col("kind") == HIGH) & (F.col("next_kind") == LOW)
    legs = legs.withColumn("label", F.when(rises & (gain >= up), "up").when(falls & (gain <= down), "down").otherwise("range"))
    legs = legs.withColumn("_new", F.coalesce(F.col("label") != F.lag("label").over(order), F.lit(True)))
    runs = legs.withColumn("run", F.sum(F.col("_new").cast("int")).over(order)).groupBy("code", "run").agg(
        F.min("i").alias("i"), F.max("next_i").alias("end"), F.first("label").alias("label")
    )
    kept = (F.col("end") - F.col("i") + 1 >= shortest) | (F.col("run") == 1)
    runs = runs.withColumn("label", F.last(F.when(kept, F.col("label")), ignorenulls=True).over(order)).select("code", "i", F.col("label").alias("_from"))
    # A bar has the label of the last leg that begins by it.
    marked = numbered.join(runs, ["code", "i"], "left")
    label = F.when(F.col("_n") < least, "range").otherwise(F.coalesce(F.last("_from", ignorenulls=True).over(w.so_far()), F.lit("range")))
    return marked.select("code", "d", label.alias("label"))


CONFIRMED = "code string, first_bar long, last_bar long, label string, known long"


def confirmed_legs(rows: DataFrame, wait: int = 15, up: float = 0.12, down: float = -0.12, shortest: int = 10, least: int = 40, final: bool = True) -> DataFrame:
    """``code, first_bar, last_bar, label, known``: legs between turning points that were confirmed, and the bar at which each became known.

    A turning point is confirmed ``wait`` bars after it, if no further one of its kind came in
    between. A leg of fewer than ``shortest`` bars is range. With ``final`` the last candidate counts at the last bar, whatever its age
    (``known`` is NULL); without it the legs of a part of the bars are those of all bars that were known by its end.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        close, smooth, turn = g["close"].to_numpy(float), g["smooth"].to_numpy(float), g["turn"].tolist()
        legs, done, held = [], None, None  # done: the last confirmed (bar, kind); held: the candidate

        def confirm(now: int | None) -> None:
            nonlocal done, held
            at, kind = held
            held = None
            if done is None:
                done = (at, kind)
            elif done[1] == kind:
                if further(kind, smooth[at], close[done[0]]):
                    done = (at, kind)
            else:
                gain = close[at] / max(close[done[0]], 1e-8) - 1
                label = "up" if kind == HIGH and gain >= up else "down" if kind == LOW and gain <= down else "range"
                legs.append((done[0], at, label if at - done[0] + 1 >= shortest else "range", now))
                done = (at, kind)

        for now in range(1, len(g) if len(g) >= least else 0):
            j, kind = now - 1, turn[now - 1]
            if j and isinstance(kind, str):
                if held is None:
                    held = (j, kind)
                elif held[1] == kind and further(kind, smooth[j], smooth[held[0]]):
                    held = (j, kind)
            if held is not None and now - held[0] >= wait:
                confirm(now)
        if final and held is not None:
            confirm(None)
        code = g["code"].iloc[0]
        return pd.DataFrame([(code, *x) for x in legs], columns=["code", "first_bar", "last_bar", "label", "known"]).astype({"known": "Int64"})

    return by_code(smoothed(rows).select("code", "d", "close", "smooth", "turn"), run, CONFIRMED)


def confirmed_labels(rows: DataFrame, **how: float) -> DataFrame:
    """``code, d, label`` from ``confirmed_legs``; bars under no confirmed leg are range, a shared bar has the later leg's label."""
    legs = confirmed_legs(rows, **how).withColumnRenamed("code", "c").drop("known")
    numbered = rows.select("code", "d").withColumn("i", w.bar_no() - 1)
    met = numbered.join(legs, (F.col("code") == F.col("c")) & F.col("i").between(F.col("first_bar"), F.col("last_bar")), "left")
    return met.groupBy("code", "d").agg(F.coalesce(F.max_by("label", "first_bar"), F.lit("range")).alias("label"))
