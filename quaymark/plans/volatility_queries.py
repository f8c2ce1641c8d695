"""Queries over conditional volatility: fits at the last bar of each year, simulated paths, barriers, value at risk, tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators import tails, volatility
from quaymark.plans.chance_queries import _returns
from quaymark.plans.shape import query


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.coalesce(F.year(F.lead("d").over(w.by_code())) != F.year("d"), F.lit(True))
    return volatility.fit_rows(_returns(spark, sf_dir), "r", last)


@query("code:s d:d model:s sigma:f persistence:f nu:f arch_p:f reliable:i")
def volatility_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = volatility.fit(_judged(spark, sf_dir))
    return fits.withColumn("persistence", F.col("alpha") + F.col("gamma") / 2 + F.col("beta"))


@query("code:s d:d n:i barrier:f p_up:f p_down:f p_none:f q05:f q50:f q95:f p_spike:f")
def barrier_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = volatility.fit(_judged(spark, sf_dir))
    return volatility.outlook(volatility.paths(fits, 10), fits)


@query("code:s d:d var:f cvar:f")
def value_at_risk_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.risk(volatility.fit(_judged(spark, sf_dir)))


@query("code:s d:d n:i barrier:f p_up:f p_down:f p_none:f q05:f q50:f q95:f")
def hidden_barrier_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volatility.outlook(volatility.hidden_paths(volatility.fit_hidden(_judged(spark, sf_dir)), 10))


@query("code:s d:d n:i alpha_left:f shape_left:f scale_left:f kappa:f var:f cvar:f shadow_mean:f shrink:f leg:s")
def tail_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.coalesce(F.year(F.lead("d").over(w.by_code())) != F.year("d"), F.lit(True))
    return tails.board(volatility.fit_rows(_returns(spark, sf_dir), "r", last, tails.LOOKBACK), ("C0",))
