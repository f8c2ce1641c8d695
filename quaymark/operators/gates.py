"""Gates of a probability: isotonic calibration where there is enough support, and a threshold whose false share is bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS, POSITIVE, TOP = 500, 50, 30
TARGET, CONFIRM, DRAWS = 0.20, 50, 200


def pooled(x: np.ndarray, last: np.ndarray, total: np.ndarray, n: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Adjacent violators pooled: blocks (first x, last x, sum, weight) whose means rise.

    Blocks that were pooled before may be pooled again with others, with the result of pooling all at once.
    """
    out: list[list[float]] = []
    for a, b, s, w in zip(x.tolist(), last.tolist(), total.tolist(), n.tolist(), strict=True):
        out.append([a, b, s, w])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, b, s, w = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = b, out[-1][2] + s, out[-1][3] + w
    return [tuple(x) for x in out]


BLOCKS = "grp string, x double, last double, total double, n double"


def _pool_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pools what is adjacent within each batch of rows sorted by group and x."""
    for batch in batches:
        rows = []
        for grp, g in batch.groupby("grp", sort=False):
            rows += [(grp, *b) for b in pooled(*(g[c].to_numpy(float) for c in ("x", "last", "total", "n")))]
        yield pd.DataFrame(rows, columns=["grp", "x", "last", "total", "n"])


def isotonic(rows: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """Per group a rising step function of ``score`` fitted to ``label``: ``group, xs, ys``, the points between which it is linear.

    Equal scores are averaged first. Stretches of the score are pooled where they lie, in a range partitioning; only
    the blocks that remain, of rising means, meet by group.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    at = known.groupBy(F.col(group).cast("string").alias("grp"), F.col(score).cast("double").alias("x")).agg(F.sum(F.col(label).cast("double")).alias("total"), F.count("*").cast("double").alias("n"))
    at = at.select("grp", "x", F.col("x").alias("last"), "total", "n")
    blocks = at.repartitionByRange("grp", "x").sortWithinPartitions("grp", "x").mapInPandas(_pool_sorted, BLOCKS)

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("x")
        found = pooled(*(g[c].to_numpy(float) for c in ("x", "last", "total", "n")))
        points = [(x, s / n) for a, b, s, n in found for x in ([a] if a == b else [a, b])]
        return pd.DataFrame({"grp": [g["grp"].iloc[0]], "xs": [[p[0] for p in points]], "ys": [[p[1] for p in points]]})

    return blocks.groupBy("grp").applyInPandas(whole, "grp string, xs array<double>, ys array<double>").withColumnRenamed("grp", group)


def stepped(score: str, xs: str = "xs", ys: str = "ys") -> Column:
    """The function of ``isotonic`` at ``score``: linear between its points, level beyond them."""
    s, n = F.col(score), F.size(xs)
    below = F.size(F.filter(xs, lambda x: x <= s))  # points at or below
    i, j = F.greatest(below, F.lit(1)), F.least(below + 1, n)
    x0, x1, y0, y1 = F.element_at(xs, i), F.element_at(xs, j), F.element_at(ys, i), F.element_at(ys, j)
    inside = (below > 0) & (below < n) & (x1 > x0)
    return F.when(inside, y0 + (y1 - y0) * (s - x0) / F.nullif(x1 - x0, F.lit(0.0))).otherwise(y0)


def supported(rows: DataFrame, group: str, score: str, label: str, least: int = ROWS, positive: int = POSITIVE, top: int = TOP) -> DataFrame:
    """``group, ok``: enough rows and positives, not all of one class, and ``top`` rows in each of the two highest tenths of the score."""
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    cuts = known.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"), F.percentile(score, F.array(F.lit(0.8), F.lit(0.9))).alias("q")
    )
    tops = known.join(cuts, group).groupBy(group).agg(
        F.max("n").alias("n"), F.max("pos").alias("pos"), F.sum((F.col(score) >= F.col("q")[1]).cast("long")).alias("high"),
        F.sum(((F.col(score) >= F.col("q")[0]) & (F.col(score) < F.col("q")[1])).cast("long")).alias("mid"),
    )
    ok = (F.col("n") >= least) & (F.col("pos") >= positive) & (F.col("pos") < F.col("n")) & (F.col("high") >= top) & (F.col("mid") >= top)
    return tops.select(group, ok.alias("ok"))


def calibrated(train: DataFrame, rows: DataFrame, group: str, score: str, label: str, **how: int) -> DataFrame:
    """``rows`` with ``calibrated`` and ``isotonic``: the score through its group's step function, as it is where ``train`` has too little support.

    ``train`` has the rows that each group may learn from.
    """
    enough = supported(train, group, score, label, **how).where("ok").select(group)
    models = isotonic(train.join(enough, group, "left_semi"), group, score, label)
    joined = rows.join(models, group, "left")
    used = F.col("xs").isNotNull()
    return joined.withColumns({"calibrated": F.when(used, stepped(score)).otherwise(F.col(score)), "isotonic": used}).drop("xs", "ys")


def draws(blocks: DataFrame, block: str, times: int = DRAWS, seed: int = 42) -> DataFrame:
    """``draw, block``: the blocks that each of ``times`` draws with replacement holds, as often as there are blocks, by a hash of seed, draw and turn."""
    numbered = blocks.select(block).distinct().withColumn("i", F.row_number().over(Window.orderBy(block)) - 1)  # months, not rows
    n = blocks.select(block).distinct().count()
    turns = blocks.sparkSession.range(times).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("turn"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "turn").cast("binary")), 1, 8), 16, 10).cast("long")
    picked = turns.select("draw", (h % max(n, 1)).cast("int").alias("i")).distinct()
    return picked.join(numbered, "i").select("draw", block)


def false_shares(rows: DataFrame, score: str, label: str, block: str, times: int = DRAWS, seed: int = 42, least: int = CONFIRM) -> DataFrame:
    """``thr, n, share, upper`` of each threshold (scores to six places): rows at or above it, the share of false ones, and the
    95 % quantile of that share over drawn sets of blocks; thresholds of fewer than ``least`` rows are left out.

    Counts by score and block are taken once; a draw adds up those of its blocks, from the highest score down.
    """
    known = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.round(F.col(score).cast("double"), 6).alias("thr"), F.col(block), (~F.col(label).cast("boolean")).cast("long").alias("f"))
    counts = known.groupBy("thr", block).agg(F.count("*").alias("c"), F.sum("f").alias("f"))
    down = Window.orderBy(F.desc("thr"))
    whole = counts.groupBy("thr").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).withColumns({"n": F.sum("c").over(down), "fp": F.sum("f").over(down)})  # one row a threshold
    whole = whole.where(F.col("n") >= least).select("thr", "n", (F.col("fp") / F.col("n")).alias("share"))
    picked = draws(known, block, times, seed)
    each = counts.join(picked, block).groupBy("draw", "thr").agg(F.sum("c").alias("c"), F.sum("f").alias("f"))
    none = F.lit(0).cast("long")
    grid = whole.select("thr", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))).alias("draw"))
    at = Window.partitionBy("draw").orderBy(F.desc("thr"))
    filled = each.unionByName(grid.select("draw", "thr", none.alias("c"), none.alias("f"))).groupBy("draw", "thr").agg(F.sum("c").alias("c"), F.sum("f").alias("f"))
    summed = filled.withColumns({"n": F.sum("c").over(at), "fp": F.sum("f").over(at)}).where("n > 0")
    upper = summed.groupBy("thr").agg(F.percentile(F.col("fp") / F.col("n"), F.lit(0.95)).alias("upper"))
    return whole.join(upper, "thr").select("thr", "n", "share", "upper")


def false_threshold(rows: DataFrame, score: str, label: str, block: str, target: float = TARGET, **how: int) -> DataFrame:
    """One row ``q_confirm, n, reason``: the highest threshold whose upper share of false ones is ``target`` at most; NULL and a reason without one."""
    found = false_shares(rows, score, label, block, **how).agg(
        F.max(F.when(F.col("upper") <= target, F.struct("thr", "n"))).alias("b"), F.count("*").alias("k")
    )
    return found.select(F.col("b.thr").alias("q_confirm"), F.coalesce("b.n", F.lit(0)).alias("n"), F.when(F.col("b").isNull(), "no_threshold").alias("reason"))
