"""One form for results of both engines, and the registry's decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def tidy(df: DataFrame, spec: str) -> DataFrame:
    """Columns of ``spec`` (name:kind ...): d dates as text, i whole numbers and flags, f numbers, m large sums, e exact sums, s text."""
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        c = F.col(name)
        if kind == "d":
            c = c.cast("date").cast("string")
        elif kind == "i":
            c = c.cast("long")
        elif kind == "f":
            c = F.round(c.cast("double"), 4) + F.lit(0.0)
        elif kind == "m":
            c = F.round(c.cast("double"), 1) + F.lit(0.0)
        elif kind == "e":
            c = c.cast("double")
        out.append(c.alias(name))
    return df.select(*out)


def tidy_sql(body: str, spec: str) -> str:
    """The same for ``body``, a WITH list whose last table is ``final``."""
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        out.append(
            {
                "d": f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}",
                "i": f"CAST({name} AS BIGINT) AS {name}",
                "f": f"ROUND(CAST({name} AS DOUBLE), 4) + 0.0 AS {name}",
                "m": f"ROUND(CAST({name} AS DOUBLE), 1) + 0.0 AS {name}",
                "e": f"CAST({name} AS DOUBLE) AS {name}",
                "s": f"{name} AS {name}",
            }[kind]
        )
    return f"WITH RECURSIVE {body} SELECT {', '.join(out)} FROM final"


def query(spec: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` is the WITH list that gives the same rows."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(f(spark, sf_dir), spec)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = tidy_sql(sql, spec)
        return f

    return add


def bars_sql(key: str = "region") -> str:
    column, prefix, scale = {"region": ("n_regionkey", "C", 0.05), "nation": ("n_nationkey", "N", 0.02)}[key]
    return f"""
    daily AS (SELECT '{prefix}' || {column} AS code, CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice) AS p,
              sum(l_quantity) AS volume, count(*) AS n
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
    moved AS (SELECT *, {scale} * (p / avg(p) OVER (PARTITION BY code) - 1) AS mv FROM daily),
    priced AS (SELECT *, 100 * exp(sum(mv) OVER (PARTITION BY code ORDER BY d)) AS close FROM moved),
    opened AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY code ORDER BY d), close) AS open FROM priced),
    bars AS (SELECT code, d, open, greatest(open, close) * (1 + 0.002 * least(n, 5)) AS high,
             least(open, close) * (1 - 0.002 * least(n, 5)) AS low, close, volume FROM opened)"""


def panels_sql(names: list[str], q: float = 0.95) -> str:
    """Tables up to ``feat``: bars with path, growth, gap, rails, touches, near and position of the panels."""
    sizes = {"fig7": (504, 63), "fig8": (252, 63), "fig9": (126, 63), "fig10": (63, 63), "fig11": (21, 21)}
    fit, gap, rail, flag = [], [], [], []
    for p in names:
        n, least = sizes[p]
        o = f"OVER (PARTITION BY code ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        fit.append(f"CASE WHEN count(ln_c) {o} >= {least} THEN exp(regr_intercept(ln_c, bar) {o} + regr_slope(ln_c, bar) {o} * bar) END AS {p}_path")
        fit.append(f"CASE WHEN count(ln_c) {o} >= {least} THEN exp(252 * regr_slope(ln_c, bar) {o}) - 1 END AS {p}_g")
        gap.append(f"ln_c - ln({p}_path) AS {p}_gap")
        so = "OVER (PARTITION BY code ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        rail.append(f"CASE WHEN count({p}_gap) {so} >= 63 THEN quantile_cont(abs({p}_gap), {q}) {so} END AS {p}_delta")
        low, high = f"{p}_path * exp(-{p}_delta)", f"{p}_path * exp({p}_delta)"
        flag += [
            f"{low} AS {p}_lower", f"{high} AS {p}_upper", f"coalesce(close <= {low} * (1 + 1e-9), false) AS {p}_touch_lo",
            f"coalesce(close >= {high} * (1 - 1e-9), false) AS {p}_touch_hi", f"coalesce(close <= {low} * 1.01, false) AS {p}_near_lo",
            f"coalesce(close >= {high} * 0.99, false) AS {p}_near_hi", f"coalesce(close > {p}_path, false) AS {p}_above",
            f"CASE WHEN {p}_delta > 0 THEN (ln_c - ln({low})) / (ln({high}) - ln({low})) END AS {p}_pos",
        ]
    return f"""
    logs AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS ln_c, row_number() OVER (PARTITION BY code ORDER BY d) AS bar FROM bars),
    logr AS (SELECT *, ln_c - lag(ln_c) OVER (PARTITION BY code ORDER BY d) AS r FROM logs),
    fits AS (SELECT *, {', '.join(fit)} FROM logr),
    gaps AS (SELECT *, {', '.join(gap)} FROM fits),
    deltas AS (SELECT *, {', '.join(rail)} FROM gaps),
    feat AS (SELECT *, {', '.join(flag)} FROM deltas)"""


def mean_sql(name: str, n: int, least: int | None = None) -> str:
    o = f"OVER (PARTITION BY code ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({name}) {o} >= {n if least is None else least} THEN avg({name}) {o} END"


BY = "OVER (PARTITION BY code ORDER BY d)"


def over(n: int) -> str:
    return f"OVER (PARTITION BY code ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ratio_sql(name: str, n: int) -> str:
    return f"({name} / lag({name}, {n}) {BY} - 1)"


def fold_sql(name: str, source: str, columns: str, first: dict[str, str], step: dict[str, str]) -> str:
    """Table ``name``: rows of ``source`` with state columns, each from the row before (``s``) and its own values (``x``)."""
    begin = ", ".join(f"{v} AS {k}" for k, v in first.items())
    after = ", ".join(f"{v} AS {k}" for k, v in step.items())
    return f"""{name}_n AS MATERIALIZED (SELECT code, d, {columns}, row_number() OVER (PARTITION BY code ORDER BY d) AS i, count(*) OVER (PARTITION BY code) AS n_rows FROM {source}),
    {name} AS (SELECT x.*, {begin} FROM {name}_n x WHERE i = 1 UNION ALL SELECT x.*, {after} FROM {name} s JOIN {name}_n x ON x.code = s.code AND x.i = s.i + 1)"""
