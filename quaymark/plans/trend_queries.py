"""Queries over the filtered trend: regimes with parameters frozen at a cutoff, with and without the volatility gate, and confirmed ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators import states, trend_state
from quaymark.plans.shape import fold_sql, query
from quaymark.plans.signal_queries import REG, _regimes
from quaymark.plans.state_queries import STACKED

CUTOFF = "1998-12-31"
A, B, C = "(s.a + 2 * s.b + s.c + 0.02)", "(s.b + s.c)", "(s.c + 0.001)"
K, M, MISS = f"({A} / ({A} + 1))", f"({B} / ({A} + 1))", "(x.y - s.x0 - s.g)"
SLOPE = fold_sql(
    "kf", "ly", "close, y",
    {"x0": "x.y", "g": "CAST(0 AS DOUBLE)", "a": "110.02 / 111.02", "b": "10.0 / 111.02", "c": "10.001 - 100.0 / 111.02"},
    {"x0": f"s.x0 + s.g + {K} * {MISS}", "g": f"s.g + {M} * {MISS}", "a": f"{A} / ({A} + 1)", "b": f"{B} / ({A} + 1)", "c": f"{C} - {B} * {B} / ({A} + 1)"},
)
# The observation's variance from the last closes up to the cutoff; z is the slope in units of its deviation.
TREND = f"""ly AS (SELECT code, d, close, ln(close) AS y FROM bars), {SLOPE},
    tn AS (SELECT code, y, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS back FROM ly WHERE d <= DATE '{CUTOFF}'),
    dy AS (SELECT code, y - lead(y) OVER (PARTITION BY code ORDER BY back) AS m FROM tn WHERE back <= 756), dm AS (SELECT code, m, quantile_cont(m, 0.5) OVER (PARTITION BY code) AS md FROM dy WHERE m IS NOT NULL),
    ov AS (SELECT code, pow(greatest(1.4826 * quantile_cont(abs(m - md), 0.5), 0.5 * stddev_samp(m), 1e-4), 2) AS r FROM dm GROUP BY code),
    kz AS (SELECT kf.code, d, kf.g AS slope, kf.g / sqrt(greatest(c * r, 1e-12)) AS z FROM kf JOIN ov ON ov.code = kf.code)"""
PENDING = "CASE WHEN x.cand = s.label THEN 0 WHEN x.cand = s.wait THEN s.n + 1 ELSE 1 END"
CONFIRM = fold_sql(
    "kc", "kd", "slope, z, cand", {"label": "'range'", "wait": "CASE WHEN x.cand = 'range' THEN '' ELSE x.cand END", "n": "CASE WHEN x.cand = 'range' THEN 0 ELSE 1 END"},
    {"label": f"CASE WHEN {PENDING} >= 3 THEN x.cand ELSE s.label END", "wait": f"CASE WHEN x.cand = s.label OR {PENDING} >= 3 THEN '' ELSE x.cand END", "n": f"CASE WHEN {PENDING} >= 3 THEN 0 ELSE {PENDING} END"},
)
#: The normal quantiles of 0.72, 0.60 and 0.50.
Z72, Z60, Z50 = 0.5828415072712162, 0.2533471031357997, 0.0


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regimes(spark, sf_dir)
    return rows.join(states.labels_by(rows, "stacked").withColumnRenamed("label", "stacked"), ["code", "d"])


def _slopes(rows: DataFrame, gated: bool) -> DataFrame:
    return trend_state.apply(rows, trend_state.fit(rows, F.lit(CUTOFF).cast("date"), gated), "stacked")


@query(
    "code:s d:d slope:f z:f candidate:s label:s",
    f"""{REG}, {TREND}, kd AS (SELECT code, d, slope, z, CASE WHEN z <= -{Z72} THEN 'down' WHEN z >= {Z72} THEN 'up' ELSE 'range' END AS cand FROM kz),
    {CONFIRM}, final AS (SELECT code, d, slope, z, cand AS candidate, label FROM kc)""",
)
def slope_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(_rows(spark, sf_dir), False)


@query("code:s d:d p_up:f p_rough:f candidate:s label:s fallback:i")
def gated_slope_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slopes(_rows(spark, sf_dir), True)


@query(
    "code:s d:d stacked:s confirmed:s",
    f"""{REG}, {STACKED}, {TREND}, cu AS (SELECT rw.code, rw.d, stk.label AS stacked, z, m20 > m60 AS bull, sum(CASE WHEN stk.label = 'up' THEN 0 ELSE 1 END) OVER (PARTITION BY rw.code ORDER BY rw.d) AS run
      FROM rw JOIN stk ON stk.code = rw.code AND stk.d = rw.d JOIN kz ON kz.code = rw.code AND kz.d = rw.d),
    cm AS (SELECT *, last_value(CASE WHEN stacked = 'up' THEN CASE WHEN z < {Z50} THEN false WHEN z >= {Z60} AND coalesce(bull, false) THEN true END END IGNORE NULLS) OVER (PARTITION BY code, run ORDER BY d) AS held FROM cu),
    final AS (SELECT code, d, stacked, CASE WHEN stacked <> 'up' THEN stacked WHEN coalesce(held, false) THEN 'up' ELSE 'range' END AS confirmed FROM cm)""",
)
def slope_confirmed_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return trend_state.confirm_up(rows.join(_slopes(rows, False).select("code", "d", "p_up"), ["code", "d"]), "stacked", "p_up")
