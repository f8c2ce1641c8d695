"""Columns over the rows of one code in date order."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_code() -> WindowSpec:
    return Window.partitionBy("code").orderBy("d")


def so_far() -> WindowSpec:
    return by_code().rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return by_code().rowsBetween(1 - n, 0)


def rows_before(n: int) -> WindowSpec:
    return by_code().rowsBetween(-n, -1)


def next_rows(first: int, last: int) -> WindowSpec:
    return by_code().rowsBetween(first, last)


def bar_no() -> Column:
    return F.row_number().over(by_code())


def full(value: Column, over: str, n: int, w: WindowSpec) -> Column:
    """``value`` where ``over`` has at least n values in the window, else NULL."""
    return F.when(F.count(over).over(w) >= n, value)


def mean(name: str, n: int, least: int | None = None) -> Column:
    """Moving average; NULL before ``least`` (default n) values."""
    w = last_rows(n)
    return full(F.avg(name).over(w), name, n if least is None else least, w)


def lag_ratio(name: str, n: int) -> Column:
    return F.col(name) / F.lag(name, n).over(by_code()) - 1


def highest(name: str, n: int) -> Column:
    return F.max(name).over(last_rows(n))


def lowest(name: str, n: int) -> Column:
    return F.min(name).over(last_rows(n))


def true_range() -> Column:
    """The first bar has no previous close and uses high - low: greatest() skips NULL."""
    before = F.lag("close").over(by_code())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def realized_vol(log_return: str, n: int, year: int = 252) -> Column:
    w = last_rows(n)
    return full(F.stddev_pop(log_return).over(w), log_return, n, w) * F.sqrt(F.lit(float(year)))


def trailing_percentile(name: str, n: int, least: int) -> Column:
    """Share of the last n values that are at most the current one, itself included."""
    w = last_rows(n)
    held = F.collect_list(name).over(w)
    share = F.size(F.filter(held, lambda x: x <= F.col(name))) / F.size(held)
    return F.when((F.size(held) >= least) & F.col(name).isNotNull(), share)


def ols_path(log_price: str, position: str, n: int, least: int) -> tuple[Column, Column]:
    """Fitted price and yearly growth of the trailing log-linear fit over n rows."""
    w = last_rows(n)
    y, x = F.col(log_price), F.col(position)
    slope = F.regr_slope(y, x).over(w)
    fitted = F.exp(F.regr_intercept(y, x).over(w) + slope * x)
    return full(fitted, log_price, least, w), full(F.exp(252 * slope) - 1, log_price, least, w)


def expanding_quantile(name: str, q: float, least: int, w: WindowSpec | None = None) -> Column:
    """Linear-interpolated quantile of all values so far, or of those in ``w``."""
    w = so_far() if w is None else w
    return F.when(F.count(name).over(w) >= least, F.percentile(name, q).over(w))


def rising(flag: str) -> Column:
    return F.col(flag) & ~F.coalesce(F.lag(flag).over(by_code()), F.lit(False))


def falling(flag: str) -> Column:
    return ~F.col(flag) & F.coalesce(F.lag(flag).over(by_code()), F.lit(False))


def any_in(flag: str, n: int) -> Column:
    return F.max(F.col(flag).cast("int")).over(last_rows(n)) == 1


def run_in_window(flag: str, n: int, least: int) -> Column:
    """Whether ``least`` or more true values in a row lie within the last n rows."""
    held = F.collect_list(F.col(flag).cast("int")).over(last_rows(n))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x == 1, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(held, start, step, lambda acc: acc["best"] >= least)


def is_low(name: str, back: int) -> Column:
    """The least of the last back + 1 values, once there are as many."""
    return (bar_no() > back) & (F.col(name) == F.min(name).over(last_rows(back + 1)))


def is_high(name: str, back: int) -> Column:
    return (bar_no() > back) & (F.col(name) == F.max(name).over(last_rows(back + 1)))


def compounded(name: str) -> Column:
    """Running product of 1 + return; NULL once a return is -1 or less."""
    ok = F.min(F.col(name)).over(so_far()) > -1
    return F.when(ok, F.exp(F.sum(F.log1p(name)).over(so_far())))


def drawdown(equity: str) -> Column:
    return F.col(equity) / F.max(equity).over(so_far()) - 1


def average_rank(group: list[str], name: str) -> Column:
    """Percentile rank within a group, equal values at their mean rank."""
    by = Window.partitionBy(*group)
    ties = F.count("*").over(Window.partitionBy(*group, name))
    return (F.rank().over(by.orderBy(name)) + (ties - 1) / 2) / F.count(name).over(by)
