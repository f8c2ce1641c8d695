"""Boards of the whole pool: risk prices, tickets, holdings, flags and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators.signals import flag

# The risk price of an empty pool, and the least volatility that divides.
RISK_PRICE = 0.3
LEAST_VOL = 1e-6
HORIZONS = (5, 20, 60)
#: Names of a holdings table's columns, first that is there.
CODE_NAMES = ("code", "instrument", "symbol")
VALUE_NAMES = ("market_value", "market_val")
SHARE_NAMES = ("shares", "volume")
PRICE_NAMES = ("market_price", "close_price", "last_price", "close")
COST_NAMES = ("cost", "cost_price", "avg_cost")


def harmonic_mean(rows: DataFrame, by: list[str], name: str, weight: str) -> DataFrame:
    """Weighted mean of ``name`` in the space of 1 / x: the keys, ``n``, ``covered`` weight and ``mean``."""
    known = rows.where((F.col(name) != 0) & F.col(weight).isNotNull())
    return known.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(weight).alias("covered"), (F.sum(weight) / F.nullif(F.sum(F.col(weight) / F.col(name)), F.lit(0.0))).alias("mean")
    )


def shrunk_rate(hits: Column, n: Column, prior: Column, strength: float = 5.0) -> Column:
    """Posterior rate of a beta prior with the weight of ``strength`` trials."""
    return (hits + strength * prior) / (n + strength)


def price_of_risk(rows: DataFrame, ret: str, vol: str) -> DataFrame:
    """One row: median and quartiles of return over volatility, ``lam, lam_p25, lam_p75, n``; RISK_PRICE for none."""
    known = rows.where(F.col(ret).isNotNull() & (F.abs(vol) >= LEAST_VOL)).select((F.col(ret) / F.col(vol)).alias("x"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = known.agg(q.alias("q"), F.count("*").alias("n"))
    return found.select(*[F.coalesce(F.col("q")[i], F.lit(RISK_PRICE)).alias(c) for i, c in ((1, "lam"), (0, "lam_p25"), (2, "lam_p75"))], "n")


def risk_metrics(bars: DataFrame) -> DataFrame:
    """Per code, at its last bar: yearly volatility ``rv<n>`` and compounded yearly return ``r_<n>a`` of the last n bars."""
    rows = bars.withColumn("r", F.log("close") - F.lag(F.log("close")).over(w.by_code()))
    columns = {f"rv{n}": w.realized_vol("r", n) for n in HORIZONS}
    columns |= {f"r_{n}a": F.pow(F.col("close") / F.lag("close", n).over(w.by_code()), 252 / n) - 1 for n in HORIZONS}
    last = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d")))
    return rows.withColumns(columns).withColumn("back", last).where("back = 1").select("code", *columns)


def pool_board(bars: DataFrame, defensive: list[str], anchor: str) -> DataFrame:
    """Per code: sleeve, metrics, the return its volatility asks for at the pool's risk price, the gap, and the volatility against the anchor's."""
    board = risk_metrics(bars).withColumn("sleeve", F.when(F.col("code").isin(defensive), "bond").otherwise("equity"))
    for n in HORIZONS:  # the risk prices and the anchor are one row each
        lam = price_of_risk(board.where("sleeve = 'equity'"), f"r_{n}a", f"rv{n}").select(F.col("lam").alias(f"lam_{n}"))
        board = board.join(F.broadcast(lam)).withColumn(f"req_{n}", F.col(f"lam_{n}") * F.col(f"rv{n}"))
        board = board.withColumn(f"gap_{n}", F.col(f"r_{n}a") - F.col(f"req_{n}"))
    base = risk_metrics(bars.where(F.col("code") == anchor)).agg(F.max("rv60").alias("anchor_rv"))
    return board.join(F.broadcast(base)).withColumn("vol_vs_bond", F.when(F.abs("anchor_rv") >= LEAST_VOL, F.col("rv60") / F.col("anchor_rv")))


def ticket_stats(rows: DataFrame, by: list[str], ret: str, need: float) -> DataFrame:
    """Per key: share and mean of gains, mean of losses, 5 % quantile, gains over losses, and the share of at least ``need``."""
    r = F.col(ret)
    known = rows.where(r.isNotNull())
    risk = F.avg(F.greatest(-r, F.lit(0.0)))
    return known.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((r > 0).cast("double")).alias("p_up"), F.avg(F.when(r > 0, r)).alias("e_up"), F.avg(F.when(r < 0, r)).alias("e_down"),
        F.percentile(ret, 0.05).alias("q05"), (F.avg(F.greatest(r, F.lit(0.0))) / F.nullif(risk, F.lit(0.0))).alias("match"),
        F.avg((r >= need).cast("double")).alias("p_ge_need"),
    )


def ticket_card(universe: DataFrame, tickets: DataFrame, labels: DataFrame, floor: DataFrame) -> DataFrame:
    """Every code of the universe with its ticket (code, q05, match), last label and gates; codes without a ticket fail the floor, one row of ``floor``."""
    joined = universe.select("code").join(tickets.select("code", "q05", "match"), "code", "left").join(labels.select("code", "label"), "code", "left")
    joined = joined.join(F.broadcast(floor))
    passed = flag(F.col("q05") >= F.col("floor"))
    up = flag(F.col("label") == "up")
    return joined.select(
        "code", "label", "q05", "match", F.col("q05").isNotNull().alias("reliable"), passed.alias("pass_floor"), up.alias("in_up"), (passed & up).alias("pass_both")
    )


def overall(checks: DataFrame) -> DataFrame:
    """One row of ``status, n_bad`` from checks (name, n_bad, hard): STOP if a hard one is bad, else WARN if any is, else TODAY."""
    facts = checks.agg(
        F.max((F.col("hard") & (F.col("n_bad") > 0)).cast("int")).alias("stop"), F.max((F.col("n_bad") > 0).cast("int")).alias("warn"), F.sum("n_bad").alias("n_bad")
    )
    return facts.select(F.when(F.col("stop") == 1, "STOP").when(F.col("warn") == 1, "WARN").otherwise("TODAY").alias("status"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def receipt_checks(pool: DataFrame, bars: DataFrame, tickets: DataFrame, triggers: DataFrame, as_of: Column) -> DataFrame:
    """Checks of a day's products as rows ``name, n_bad, hard``: codes without bars, a bar on the day, a ticket or a trigger."""
    codes = pool.select("code").distinct()
    here = bars.groupBy("code").agg(F.max("d").alias("last_d"))

    def missing(name: str, other: DataFrame, hard: bool) -> DataFrame:
        return codes.join(other.select("code").distinct(), "code", "left_anti").agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("name"), "n_bad", F.lit(hard).alias("hard"))

    found = missing("pool", here, True).unionByName(missing("last_bar", here.where(F.col("last_d") >= as_of), True))
    return found.unionByName(missing("ticket", tickets, False)).unionByName(missing("trigger", triggers, False))


def _first(rows: DataFrame, names: tuple[str, ...]) -> Column:
    found = [F.try_to_number(F.col(n), F.lit("999999999999999.99999999")).cast("double") if dict(rows.dtypes)[n] == "string" else F.col(n).cast("double") for n in names if n in rows.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def holdings(rows: DataFrame, closes: DataFrame) -> DataFrame:
    """Holdings with ``value, weight, weight_total``: by market value, else shares by price, by close (code, close), or by cost.

    Code columns go by candidate names, codes are cleaned; CASH counts in the
    total but is no holding. Rows of one code are added up.
    """
    code = F.coalesce(*[F.col(n) for n in CODE_NAMES if n in rows.columns])
    named = rows.select(
        F.upper(F.trim(code)).alias("code"), _first(rows, VALUE_NAMES).alias("mv"), _first(rows, SHARE_NAMES).alias("shares"),
        _first(rows, PRICE_NAMES).alias("price"), _first(rows, COST_NAMES).alias("cost"),
    ).where("code <> ''")
    priced = named.join(closes.select("code", F.col("close").alias("last_close")), "code", "left")
    value = F.coalesce("mv", F.col("shares") * F.col("price"), F.col("shares") * F.col("last_close"), F.col("shares") * F.col("cost"))
    valued = priced.groupBy("code").agg(F.sum(value).alias("value"))
    totals = valued.agg(F.sum("value").alias("total"), F.sum(F.when(F.col("code") != "CASH", F.col("value"))).alias("stock"))
    return valued.where("code <> 'CASH'").join(F.broadcast(totals)).select(
        "code", "value", (F.col("value") / F.nullif("stock", F.lit(0.0))).alias("weight"), (F.col("value") / F.nullif("total", F.lit(0.0))).alias("weight_total")
    )


def weights_on(rows: DataFrame, day: Column, names: list[str]) -> DataFrame:
    """Weights of one day (code, d, weight candidates): ``code, weight``, not a number counting as 0."""
    found = F.coalesce(*[F.col(n).try_cast("double") for n in names if n in rows.columns], F.lit(0.0))
    return rows.where(F.col("d") == day).groupBy(F.upper(F.trim("code")).alias("code")).agg(F.sum(found).alias("weight"))


def trend_board(bars: DataFrame) -> DataFrame:
    """Per code, at its last bar: distance to the mean, stack of means, returns, volatilities, drawdown and ``flags``."""
    rows = bars.withColumns({"r": F.log("close") - F.lag(F.log("close")).over(w.by_code()), **{f"ma{n}": w.mean("close", n) for n in (5, 10, 20)}})
    rows = rows.withColumns(
        {
            "dist": (F.col("close") / F.col("ma20") - 1) * 100, "ret_5": w.lag_ratio("close", 5), "ret_20": w.lag_ratio("close", 20),
            "rv20": w.realized_vol("r", 20), "vol_ratio": w.realized_vol("r", 5) / F.nullif(w.realized_vol("r", 20), F.lit(0.0)),
            "dd20": F.col("close") / w.highest("close", 20) - 1, "_under": flag(F.col("close") < F.col("ma20")), "bar": w.bar_no(),
        }
    )
    rows = rows.withColumn("vol_pct", w.trailing_percentile("rv20", 120, 60))
    above = F.max(F.when(~F.col("_under"), F.col("bar"))).over(w.so_far())
    rows = rows.withColumn("days_below", F.col("bar") - F.coalesce(above, F.lit(0)))
    stack = F.when((F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")), "bull").when((F.col("ma5") < F.col("ma10")) & (F.col("ma10") < F.col("ma20")), "bear").otherwise("mixed")
    last = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d")))
    rows = rows.withColumns({"stack": stack, "back": last}).where("back = 1")
    flags = F.concat_ws(
        "|", F.when(F.col("dist") < 0, "below_ma20"), F.when(F.col("dist") < -5, "deep_below_ma20"), F.when(F.col("days_below") >= 5, "below_ma20_5d+"),
        F.when(F.col("vol_pct") >= 0.8, "high_vol"), F.when(F.col("stack") == "bear", "bear_stack"), F.when(F.col("dd20") <= -0.05, "dd5_20d"),
        F.when(F.col("ret_5") < F.col("ret_20"), "mom_fade"), F.when(F.col("vol_ratio") > 1.2, "vol_accel"),
    )
    return rows.select("code", "dist", "stack", "ret_5", "ret_20", "vol_ratio", "vol_pct", "dd20", "days_below", flags.alias("flags"))


def overlay_modes(members: DataFrame, seeds: DataFrame, default: str = "default") -> DataFrame:
    """``code, cluster, mode``: a cluster takes the mode of its exemplars (code, mode), NULL where they disagree."""
    painted = members.join(seeds, "code").groupBy("cluster").agg(F.countDistinct("mode").alias("n"), F.min("mode").alias("mode"))
    joined = members.join(painted, "cluster", "left")
    return joined.select("code", "cluster", F.when(F.col("n") > 1, F.lit(None)).otherwise(F.coalesce("mode", F.lit(default))).alias("mode"))


def mode_conflicts(members: DataFrame, seeds: DataFrame) -> DataFrame:
    """Clusters whose exemplars disagree: ``cluster, modes``."""
    found = members.join(seeds, "code").groupBy("cluster").agg(F.array_sort(F.collect_set("mode")).alias("m"))
    return found.where(F.size("m") > 1).select("cluster", F.concat_ws("|", "m").alias("modes"))


def state_overlay(rows: DataFrame, states: list[str]) -> DataFrame:
    """Per code and state: yearly Sharpe ratio held throughout, out of the market in the state (by the day before), and half out; the best of them.

    ``rows``: code, d, close, state, without warm-up.
    """
    before = F.lag("state").over(w.by_code())
    moved = rows.withColumns({"r": F.coalesce(w.lag_ratio("close", 1), F.lit(0.0)), "before": before})

    def sharpe(share: float) -> Column:
        r = F.col("r") * F.when(F.col("before") == F.col("target"), share).otherwise(1.0)
        return F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(252.0))

    each = moved.withColumn("target", F.explode(F.array(*map(F.lit, states))))
    found = each.groupBy("code", "target").agg(
        F.avg((F.col("state") == F.col("target")).cast("double")).alias("share"), sharpe(1.0).alias("held"), sharpe(0.0).alias("empty"), sharpe(0.5).alias("half")
    )
    edge = 1e-12
    best = F.when((F.col("empty") > F.col("held") + edge) & ~flag(F.col("half") > F.greatest("empty", "held") + edge), "empty")
    return found.withColumn("best", best.when(F.col("half") > F.col("held") + edge, "half").otherwise("full"))
