"""Forward labels, eligibility, and tests of predicted probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w


def sigma20(rows: DataFrame) -> DataFrame:
    """Add ``r`` and ``sigma``: the sample deviation of 20 log returns, at least 18 of them there."""
    rows = rows.withColumn("r", F.log("close") - F.lag(F.log("close")).over(w.by_code()))
    return rows.withColumn("sigma", w.full(F.stddev_samp("r").over(w.last_rows(20)), "r", 18, w.last_rows(20)))


def trend_label(rows: DataFrame, horizon: int = 10) -> DataFrame:
    """Add ``label_up``: a large, efficient rise over the next bars; NULL while it can't be known."""
    rows = sigma20(rows) if "sigma" not in rows.columns else rows
    ahead = w.next_rows(1, horizon)
    total = F.log(F.lead("close", horizon).over(w.by_code()) / F.col("close"))
    length = F.sum(F.abs("r")).over(ahead)
    worst = F.log(F.min("close").over(ahead) / F.col("close"))
    unit = F.col("sigma") * F.sqrt(F.lit(float(horizon)))
    good = (total >= 0.35 * unit) & (F.abs(total) / F.nullif(length, F.lit(0.0)) >= 0.28) & (worst >= -unit)
    return rows.withColumn("label_up", F.when(total.isNotNull() & F.col("sigma").isNotNull(), F.coalesce(good, F.lit(False))))


def reversal_label(rows: DataFrame, back: int = 10, horizon: int = 10) -> DataFrame:
    """Add prior, jump, post and ``label_rev``: jump against the prior move, confirmed after; NULL when immature."""
    rows = sigma20(rows) if "sigma" not in rows.columns else rows
    before = F.lag("close", 1).over(w.by_code())
    prior = F.log(before / F.lag("close", back + 1).over(w.by_code()))
    jump = F.log(F.col("close") / before)
    post = F.log(F.lead("close", horizon).over(w.by_code()) / F.col("close"))
    out = rows.withColumns({"prior": prior, "jump": jump, "post": post})
    strong = (F.abs("prior") >= 0.35 * F.col("sigma") * back**0.5) & (F.abs("post") >= 0.35 * F.col("sigma") * horizon**0.5)
    turned = (F.signum("prior") * F.signum("post") < 0) & (F.signum("jump") == F.signum("post"))
    known = F.col("prior").isNotNull() & F.col("post").isNotNull() & F.col("sigma").isNotNull()
    return out.withColumn("label_rev", F.when(known, F.coalesce(strong & turned, F.lit(False)))).withColumn(
        "bias", F.when(F.col("prior") < 0, "buy").when(F.col("prior") > 0, "sell")
    )


def eligible(rows: DataFrame, members: DataFrame, history: int = 252, recent: int = 18) -> DataFrame:
    """Add ``eligible``: listed that day, enough closes so far and in the last twenty bars.

    ``members``: code, list_date, end_date; a small dimension by code.
    """
    joined = rows.join(members, "code", "left")
    listed = (F.col("list_date") <= F.col("d")) & (F.col("end_date").isNull() | (F.col("d") <= F.col("end_date")))
    enough = (F.count("close").over(w.so_far()) >= history) & (F.count("close").over(w.last_rows(20)) >= recent)
    return joined.withColumn("eligible", F.coalesce(listed & enough, F.lit(False))).drop("list_date", "end_date")


def calibration(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: n, Brier score and expected calibration error; the last bin is closed."""
    known = rows.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(F.col(p).alias("p"), F.col(y).cast("double").alias("y"))
    binned = known.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("se")
    )
    return binned.agg(
        F.sum("n").alias("n"), (F.sum("se") / F.sum("n")).alias("brier"),
        (F.sum(F.abs(F.col("mp") - F.col("my")) * F.col("n")) / F.sum("n")).alias("ece"),
    )


def uniformity(rows: DataFrame, u: str) -> DataFrame:
    """Per code: mean, deviation, Kolmogorov-Smirnov and Cramér-von Mises statistics of PIT values."""
    order, by = Window.partitionBy("code").orderBy(u), Window.partitionBy("code")
    known = rows.where(F.col(u).isNotNull()).select("code", F.col(u).alias("u"), F.row_number().over(order).alias("i"), F.count("*").over(by).alias("n"))
    above, below = F.col("i") / F.col("n") - F.col("u"), F.col("u") - (F.col("i") - 1) / F.col("n")
    return known.groupBy("code").agg(
        F.max("n").alias("n"), F.avg("u").alias("mean"), F.stddev_samp("u").alias("sd"), F.max(F.greatest(above, below)).alias("ks"),
        (1 / (12 * F.max("n")) + F.sum(F.pow(F.col("u") - (2 * F.col("i") - 1) / (2 * F.col("n")), 2))).alias("cvm"),
    )


def quantile_coverage(rows: DataFrame, u: str, levels: tuple[float, ...] = (0.05, 0.10, 0.90, 0.95)) -> DataFrame:
    """Per code: share of PIT values at most each level, and in both 10 % tails."""
    shares = [F.avg((F.col(u) <= q).cast("double")).alias(f"le_{int(q * 100):02d}") for q in levels]
    tails = F.avg(((F.col(u) <= 0.10) | (F.col(u) >= 0.90)).cast("double")).alias("tails")
    return rows.where(F.col(u).isNotNull()).groupBy("code").agg(*shares, tails)


def threshold_grid(rows: DataFrame, score: str, y: str, levels: list[float]) -> DataFrame:
    """Alerts, precision, recall and F1 for each threshold of a literal grid, in one aggregation."""
    exploded = rows.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(
        F.col(score).alias("s"), F.col(y).cast("int").alias("y"), F.explode(F.array(*[F.lit(q) for q in levels])).alias("q")
    )
    hit = (F.col("s") >= F.col("q")).cast("int")
    facts = exploded.groupBy("q").agg(F.sum(hit).alias("alerts"), F.sum(hit * F.col("y")).alias("tp"), F.sum("y").alias("pos"))
    return facts.select(
        "q", "alerts", (F.col("tp") / F.nullif("alerts", F.lit(0))).alias("precision"), (F.col("tp") / F.nullif("pos", F.lit(0))).alias("recall"),
        (2 * F.col("tp") / F.nullif(F.col("alerts") + F.col("pos"), F.lit(0))).alias("f1"),
    )


def ladder(rows: DataFrame, p: str, q_observe: float, q_confirm: float, q_reject: float, months: str) -> DataFrame:
    """Add ``level``: confirm (from six months on) over observe over reject; none without a probability."""
    x = F.col(p)
    level = (
        F.when(x.isNull(), "NONE").when((x >= q_confirm) & (F.col(months) >= 6), "CONFIRM").when(x >= q_observe, "OBSERVE")
        .when(x <= q_reject, "REJECT").otherwise("NONE")
    )
    return rows.withColumn("level", level)


def hill(rows: DataFrame, tail: float = 0.925) -> DataFrame:
    """Per code: Hill index of the losses beyond their ``tail`` quantile."""
    losses = rows.where(F.col("r") < 0).select("code", (-F.col("r")).alias("x"))
    limit = losses.groupBy("code").agg(F.percentile("x", tail).alias("u"))
    beyond = losses.join(limit, "code").where(F.col("x") > F.col("u"))
    return beyond.groupBy("code").agg(F.count("*").alias("n"), (1 / F.avg(F.log(F.col("x") / F.col("u")))).alias("alpha"))


def event_matches(events: DataFrame, alerts: DataFrame, lead: int = 3, horizon: int = 10) -> DataFrame:
    """``code, bar, onset, delay, kind`` for each alert (code, bar, score) against events (code, bar).

    Events in order use up all alerts within lead bars before and horizon bars
    after, so an alert belongs to the earliest event that reaches it; of an
    event's alerts the nearest (then earliest, then highest) is the match and
    the others are duplicates. Each alert meets the lead + horizon + 1 bars
    whose events reach it: an equi-join. Scores take no part in it: alerts
    computed twice may differ in the last bit of a sum.
    """
    reach = alerts.select("code", "bar", F.explode(F.sequence(F.col("bar") - horizon, F.col("bar") + lead)).alias("onset"))
    onsets = events.select("code", F.col("bar").alias("onset")).distinct()
    first = reach.join(onsets, ["code", "onset"]).groupBy("code", "bar").agg(F.min("onset").alias("onset"))
    found = alerts.join(first, ["code", "bar"], "left")
    order = Window.partitionBy("code", "onset").orderBy(F.abs(F.col("bar") - F.col("onset")), "bar", F.desc("score"))
    ranked = found.withColumn("n", F.when(F.col("onset").isNotNull(), F.row_number().over(order)))
    best = F.col("n") == 1
    kind = F.when(F.col("onset").isNull(), "false_alarm").when(best, "match").otherwise("duplicate")
    return ranked.select(
        "code", "bar", F.when(best, F.col("onset")).alias("onset"), F.when(best, F.col("bar") - F.col("onset")).alias("delay"), kind.alias("kind")
    )
