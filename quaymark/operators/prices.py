"""Split adjustment and price-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w

# The ratios a split is snapped to, and the tolerances.
RATIOS = (0.1, 0.2, 0.25, 1 / 3, 0.5, 2.0, 3.0, 4.0, 5.0, 10.0)
SNAP = 0.05
CLIFF = 0.25
JUMP = 0.08
RECENT = 20


def snap(ratio: Column) -> Column:
    """The nearest split ratio (by relative distance) within 5 %, else NULL; ties to the smaller."""
    best = F.least(*[F.struct(F.abs(ratio / r - 1).alias("off"), F.lit(r).alias("r")) for r in RATIOS])
    return F.when(ratio.isNotNull() & (best["off"] <= SNAP), best["r"])


def split_steps(bars: DataFrame, threshold: float = CLIFF) -> DataFrame:
    """Add ``prev_close, ratio, step, snapped, factor`` to bars.

    A cliff between adjacent valid closes (holes are skipped) gives a step:
    open over previous close snapped to a split ratio, else the close ratio
    snapped, else the close ratio. factor is the product of all later steps;
    each step depends on raw neighbours only, so one window in each direction
    does what a walk from the newest bar would.
    """
    valid = F.coalesce((F.col("close") > 0) & (F.col("close") < float("inf")), F.lit(False))
    good = F.when(valid, F.col("close"))
    before = F.last(good, ignorenulls=True).over(w.rows_before(1 << 30))
    rows = bars.withColumn("prev_close", F.when(valid, before)).withColumn("ratio", F.col("close") / F.col("prev_close"))
    cliff = F.abs(F.col("ratio") - 1) > threshold
    opened = snap(F.when(F.col("open") > 0, F.col("open") / F.col("prev_close")))
    snapped = F.coalesce(opened, snap(F.col("ratio")))
    rows = rows.withColumn("snapped", F.when(cliff, snapped)).withColumn(
        "step", F.when(cliff, F.coalesce("snapped", "ratio")).otherwise(1.0)
    )
    later = F.sum(F.log("step")).over(w.by_code().rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("factor", F.exp(F.coalesce(later, F.lit(0.0))))


def adjust(bars: DataFrame, threshold: float = CLIFF) -> DataFrame:
    """Bars with prices scaled to the latest level; unchanged where no split is found."""
    rows = split_steps(bars, threshold)
    scaled = {c: F.col(c) * F.col("factor") for c in ("open", "high", "low", "close") if c in bars.columns}
    return rows.withColumns(scaled).select(bars.columns)


def with_next_close(bars: DataFrame) -> DataFrame:
    """Adjusted bars and ``next_close`` at the next row's own factor."""
    return adjust(bars).withColumn("next_close", F.lead("close").over(w.by_code()))


def split_records(bars: DataFrame, threshold: float = CLIFF) -> DataFrame:
    """One row for each step: ``code, d, prev_close, close, ratio, step, is_snapped, factor``."""
    return split_steps(bars, threshold).where("step <> 1").select(
        "code", "d", "prev_close", "close", "ratio", "step", F.col("snapped").isNotNull().alias("is_snapped"), "factor"
    )


def ex_dividend(bars: DataFrame, low: float = -0.12, high: float = -0.005) -> DataFrame:
    """Add ``ex_div``: the open gaps down by a dividend's size and the day recovers part of it."""
    gap = F.col("open") / F.lag("close").over(w.by_code()) - 1
    return bars.withColumn("ex_div", F.coalesce(gap.between(low, high) & (F.col("close") > F.col("open")), F.lit(False)))


def jump_flags(bars: DataFrame, jump: float = JUMP, recent: int = RECENT) -> DataFrame:
    """Per code: ``n_splits, n_jumps, recent_jump, flags``; jumps are large moves that are no splits."""
    rows = split_steps(bars).withColumn("r", F.log("ratio")).withColumn("is_split", F.col("step") != 1)
    rows = rows.withColumn("is_jump", F.coalesce(~F.col("is_split") & (F.abs("r") > jump), F.lit(False)))
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d")))
    found = rows.withColumn("back", back).groupBy("code").agg(
        F.sum(F.col("is_split").cast("long")).alias("n_splits"),
        F.sum(F.col("is_jump").cast("long")).alias("n_jumps"),
        F.max((F.col("is_jump") & (F.col("back") <= recent)).cast("long")).alias("recent_jump"),
    )
    flags = F.concat_ws(
        "|", F.when(F.col("n_splits") > 0, "corp_split"), F.when(F.col("recent_jump") > 0, "recent_jump"),
        F.when(F.col("n_jumps") > 0, "jump_day_hist"),
    )
    return found.withColumn("flags", flags)


def plain_returns(bars: DataFrame) -> DataFrame:
    """Log returns of the days that are no splits: ``code, d, r``."""
    return split_steps(bars).where("step = 1 and ratio is not null").select("code", "d", F.log("ratio").alias("r"))


def quote_factor(raw: str, prev: str, pre_close: str, pct: str) -> Column:
    """struct(factor, reason) that brings a raw quote to the adjusted level; 1 without a positive previous and raw close."""
    def usable(name: str) -> Column:
        return F.coalesce((F.col(name) > 0) & (F.col(name) < float("inf")), F.lit(False))

    cliff = F.abs(F.col(raw) / F.col(prev) - 1) > CLIFF
    by_pct = F.col(prev) * (1 + F.col(pct) / 100) / F.col(raw)

    def out(factor: Column, reason: str | Column) -> Column:
        return F.struct(factor.alias("factor"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    one = F.lit(1.0)
    return (
        F.when(~usable(prev) | ~usable(raw), out(one, "no_qlib_prev"))
        .when(usable(pre_close), out(F.col(prev) / F.col(pre_close), "pre_close"))
        .when(F.col(pct).between(-100, 1e300) & (by_pct > 0), out(by_pct, "pct_chg"))
        .otherwise(out(one, F.when(cliff, "cliff_unaligned").otherwise("same_scale")))
    )


def apply_snapshot(bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """Bars with each quote's day replaced or appended (``code, d`` is the key; quotes win)."""
    columns = bars.columns
    both = bars.withColumn("_seq", F.lit(0)).unionByName(quotes.select(columns).withColumn("_seq", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("code", "d").orderBy(F.desc("_seq")))
    return both.withColumn("_n", last).where("_n = 1").select(columns)


def snapshot_problems(quotes: DataFrame, expected: DataFrame) -> DataFrame:
    """Checks of a snapshot as rows ``check, ok, value``."""
    facts = quotes.agg(
        F.countDistinct("d").alias("days"),
        F.sum((~((F.col("low") > 0) & (F.col("open") > 0) & (F.col("high") > 0) & (F.col("close") > 0))).cast("long")).alias("bad"),
        F.countDistinct("code").alias("codes"),
    )
    wanted = expected.agg(F.countDistinct("code").alias("wanted"))
    row = facts.join(F.broadcast(wanted))
    share = F.col("codes") / F.col("wanted")

    def check(name: str, ok: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), value.cast("double").alias("value"))

    bad = F.coalesce(F.col("bad"), F.lit(0))
    checks = F.array(check("single_date", F.col("days") == 1, F.col("days")), check("positive_prices", bad == 0, bad), check("coverage", share >= 0.95, share))
    return row.select(F.inline(checks))


def overlap_check(old: DataFrame, new: DataFrame, least: int = 5, tolerance: float = 1e-4) -> DataFrame:
    """Per code of both: ``n_common, max_rel_diff, ok``."""
    both = old.select("code", "d", F.col("close").alias("a")).join(new.select("code", "d", F.col("close").alias("b")), ["code", "d"])
    found = both.groupBy("code").agg(F.count("*").alias("n_common"), F.max(F.abs(F.col("b") / F.col("a") - 1)).alias("max_rel_diff"))
    return found.withColumn("ok", (F.col("n_common") >= least) & (F.col("max_rel_diff") <= tolerance))


def date_gap(last_seen: DataFrame, bars: DataFrame) -> DataFrame:
    """Per code of ``last_seen`` (code, d): ``n_new`` later bars and ``gap`` (same, plus_one, gap or empty)."""
    held = bars.groupBy("code").agg(F.count("*").alias("n_bars"))
    later = bars.alias("b").join(last_seen.alias("l"), "code").where("b.d > l.d").groupBy("code").agg(F.count("*").alias("n_new"))
    rows = last_seen.select("code").join(held, "code", "left").join(later, "code", "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    kind = F.when(F.col("n_bars").isNull(), "empty").when(F.col("n_new") == 0, "same").when(F.col("n_new") == 1, "plus_one").otherwise("gap")
    return rows.select("code", "n_new", kind.alias("gap"))


def stale(bars: DataFrame, as_of: str) -> DataFrame:
    """Codes whose last bar is before ``as_of``."""
    return bars.groupBy("code").agg(F.max("d").alias("last_d")).where(F.col("last_d") < F.lit(as_of).cast("date"))
