"""Choice of a labelling method: walk-forward folds as rows, scores by aggregation, the choice by order.

A candidate is a label column; all candidates see past bars only, so one pass over
the bars serves every fold. The unit of work is (code, fold, candidate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w

PRIOR, STRENGTH = 0.5, 5.0
#: What the score of a method weighs.
HOLD, AGREE, UP_SHARE, SWITCH = 0.45, 0.25, 0.15, 0.015


def fold_table(rows: DataFrame, folds: int = 4, train: int = 160, size: int = 60) -> DataFrame:
    """``code, fold, start, stop``: the last ``folds`` stretches of bars [start, stop) after ``train`` ones.

    A code with few bars has one fold, its last three tenths; the bars before a fold's start are its training part.
    """
    n = F.col("n")
    short = n < train + 20
    cut = F.greatest(F.lit(30), F.floor(n * 0.7)).cast("long")
    step = F.greatest(F.lit(20), F.least(F.lit(size), F.floor((n - train) / max(1, folds)))).cast("long")
    starts = F.sequence(F.lit(train).cast("long"), F.greatest(n - 1, F.lit(train)), step)
    many = F.filter(F.transform(F.slice(starts, -F.least(F.lit(folds), F.size(starts)), folds), lambda s: F.struct(s.alias("start"), F.least(n, s + step).alias("stop"))), lambda f: f["stop"] - f["start"] >= 10)
    one = F.filter(F.array(F.struct(cut.alias("start"), n.alias("stop"))), lambda f: f["start"] < f["stop"])
    counted = rows.groupBy("code").agg(F.count("*").alias("n"))
    return counted.select("code", F.posexplode(F.when(short, one).otherwise(many)).alias("fold", "f")).select("code", "fold", "f.start", "f.stop")


def by_candidate(rows: DataFrame, candidates: list[str]) -> DataFrame:
    """``code, d, i, close, candidate, label``: label columns as rows, ``i`` the bar from 0."""
    each = F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).alias("label")) for c in candidates])
    return rows.withColumn("i", w.bar_no() - 1).select("code", "d", "i", "close", F.explode(each).alias("x")).select("code", "d", "i", "close", "x.*")


def in_folds(labelled: DataFrame, folds: DataFrame) -> DataFrame:
    """The labelled rows of each fold; a fold's rows are few, so its table is joined by code and the bars' range."""
    f = folds.withColumnRenamed("code", "c")
    return labelled.join(f, (F.col("code") == F.col("c")) & (F.col("i") >= F.col("start")) & (F.col("i") < F.col("stop"))).drop("c", "start", "stop")


def hold_metrics(rows: DataFrame, cost: float = 0.001) -> DataFrame:
    """Per code, fold and candidate: in at the first close labelled up, out at the first that isn't, ``cost`` a side.

    Open positions are valued at what selling would bring. ``n_closed, wins, mean_ret, compound, edge`` (over holding all along), ``worst`` drawdown, ``exposure, switches``.
    """
    bars = Window.partitionBy("code", "fold", "candidate").orderBy("i")
    so_far = bars.rowsBetween(Window.unboundedPreceding, 0)
    up = F.coalesce(F.col("label") == "up", F.lit(False))
    was = F.coalesce(F.lag("up").over(bars), F.lit(False))
    rows = rows.withColumn("up", up).withColumn("was", was)
    rows = rows.withColumn("entry", F.last(F.when(F.col("up") & ~F.col("was"), F.col("close")), ignorenulls=True).over(so_far))
    sold = F.col("close") * (1 - cost) / (F.col("entry") * (1 + cost))
    rows = rows.withColumns({"sold": sold, "net": F.when(~F.col("up") & F.col("was"), sold - 1)})
    rows = rows.withColumn("wealth", F.exp(F.coalesce(F.sum(F.log(F.col("net") + 1)).over(so_far), F.lit(0.0))))
    rows = rows.withColumn("equity", F.when(F.col("up"), F.col("wealth") * F.col("sold")).otherwise(F.col("wealth")))
    rows = rows.withColumns({"fall": F.col("equity") / F.max("equity").over(so_far) - 1, "turned": F.coalesce(F.col("label") != F.lag("label").over(bars), F.lit(False))})
    compound, held = F.max_by("equity", "i") - 1, F.max_by("close", "i") / F.min_by("close", "i") - 1
    return rows.groupBy("code", "fold", "candidate").agg(
        F.count("net").alias("n_closed"), F.sum((F.coalesce(F.col("net"), F.lit(0.0)) > 0).cast("long")).alias("wins"), F.coalesce(F.avg("net"), F.lit(0.0)).alias("mean_ret"),
        compound.alias("compound"), (compound - held).alias("edge"), F.min("fall").alias("worst"),
        F.avg(F.col("up").cast("double")).alias("exposure"), F.sum(F.col("turned").cast("long")).alias("switches"),
    )


def pooled(metrics: DataFrame, prior: float = PRIOR, strength: float = STRENGTH) -> DataFrame:
    """Per code and candidate over folds: the win rate drawn towards ``prior``, the mean return weighted by closed trades, the worst fall."""
    weight = F.greatest(F.col("n_closed"), F.lit(1))
    return metrics.groupBy("code", "candidate").agg(
        F.sum("n_closed").alias("n_closed"), F.sum("wins").alias("wins"), ((F.sum("wins") + prior * strength) / (F.sum("n_closed") + strength)).alias("posterior"),
        (F.sum(F.col("mean_ret") * weight) / F.sum(weight)).alias("mean_ret"), F.avg("edge").alias("edge"), F.min("worst").alias("worst"), F.avg("exposure").alias("exposure"),
    )


def best_candidate(pool: DataFrame, order: list[str], least: int = 2, floor: float = -0.25) -> DataFrame:
    """``code, winner``: of candidates with ``least`` closed trades, no mean loss and no fall below ``floor`` the one of the
    highest posterior, then mean return, edge, number of trades and place in ``order``; codes without one are left out."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("candidate"))
    fit = pool.where((F.col("n_closed") >= least) & (F.col("mean_ret") >= 0) & (F.col("worst") >= floor))
    rank = F.struct(*[-F.round(F.col(c).cast("double"), 12) for c in ("posterior", "mean_ret", "edge", "n_closed")], place, "candidate")
    return fit.groupBy("code").agg(F.min(rank).alias("b")).select("code", F.col("b.candidate").alias("winner"))


def nested_choice(metrics: DataFrame, baselines: DataFrame, order: list[str], slack: float = 0.02, **how: float) -> DataFrame:
    """``code, baseline, candidate, chosen, accepted, reason, posterior``: chosen on all folds but the last, which decides whether it replaces the baseline.

    On the last fold it must close a trade and be no worse in mean return and edge, and in its fall by ``slack`` at most. Codes of one fold keep the baseline.
    """
    folds = Window.partitionBy("code")
    rows = metrics.withColumns({"last": F.max("fold").over(folds), "first": F.min("fold").over(folds)})
    pool = pooled(rows.where("fold < last"))
    found = baselines.join(best_candidate(pool, order, **how), "code", "left").join(rows.groupBy("code").agg((F.max("fold") > F.min("fold")).alias("nested")), "code", "left")
    found = found.withColumn("candidate", F.coalesce("winner", "baseline"))
    final = rows.where("fold = last").select("code", "candidate", "n_closed", "mean_ret", "edge", "worst")
    base = final.select("code", F.col("candidate").alias("baseline"), *[F.col(c).alias(f"b_{c}") for c in ("mean_ret", "edge", "worst")])
    joined = found.join(final, ["code", "candidate"], "left").join(base, ["code", "baseline"], "left").join(pool.select("code", "candidate", "posterior"), ["code", "candidate"], "left")
    same = F.col("candidate") == F.col("baseline")
    better = (F.col("n_closed") > 0) & (F.col("mean_ret") >= F.col("b_mean_ret")) & (F.col("edge") >= F.col("b_edge")) & (F.col("worst") >= F.col("b_worst") - slack)
    several = F.coalesce("nested", F.lit(False))
    accepted = several & (same | F.coalesce(better, F.lit(False)))
    reason = F.when(~several, "one_fold").when(same, "baseline").when(better.isNull(), "no_figures").when(better, "passed").otherwise("failed")
    return joined.select("code", "baseline", "candidate", F.when(accepted, F.col("candidate")).otherwise(F.col("baseline")).alias("chosen"), accepted.alias("accepted"), reason.alias("reason"), "posterior")


def _share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def training_scores(labelled: DataFrame, truth: DataFrame) -> DataFrame:
    """Per code and candidate: compound of its up runs, agreement with ``truth`` (code, d, label), shares, switches, score and whether it is vetoed.

    Vetoed are methods that call nearly all bars range, or hardly any direction where the truth has some.
    """
    whole = labelled.withColumn("fold", F.lit(0)).join(truth.select("code", "d", F.col("label").alias("truth")), ["code", "d"], "left")
    holds = hold_metrics(whole.drop("truth"), 0.0).select("code", "candidate", "compound", "switches")
    directed = F.col("label").isin("up", "down")
    shares = whole.groupBy("code", "candidate").agg(
        _share(F.col("label") == F.col("truth")).alias("agree"), _share(F.col("label") == "up").alias("up_share"), _share(F.col("label") == "range").alias("range_share"),
        _share(directed).alias("directed"), _share(F.col("truth") == "range").alias("truth_range"), _share(F.col("truth").isin("up", "down")).alias("truth_directed"),
    )
    rows = shares.join(holds, ["code", "candidate"])
    score = HOLD * F.col("compound") + AGREE * F.col("agree") + UP_SHARE * F.col("up_share") - SWITCH * F.col("switches")
    flat = (F.col("range_share") >= 0.85) | ((F.col("range_share") >= 0.75) & (F.col("range_share") > F.col("truth_range") + 0.35) & (F.col("truth_range") >= 0.30))
    idle = (F.col("truth_directed") >= 0.20) & (F.col("directed") < F.col("truth_directed") * 0.25) & (F.col("range_share") >= 0.65)
    return rows.withColumns({"score": score, "vetoed": flat | idle})


def legacy_choice(scores: DataFrame, order: list[str], fallback: str) -> DataFrame:
    """``code, baseline``: the best score of those not vetoed, of all if every one is; ``fallback`` where the truth has hardly a leg."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("candidate"))
    rank = F.struct(F.col("vetoed").cast("int"), -F.round("score", 12), place, "candidate")
    best = scores.groupBy("code").agg(F.min(rank).alias("b"), F.max("truth_range").alias("flat"), F.max("truth_directed").alias("moved"))
    return best.select("code", F.when((F.col("flat") >= 0.90) | (F.col("moved") < 0.05), F.lit(fallback)).otherwise(F.col("b.candidate")).alias("baseline"))
