"""Queries over boards, tickets, holdings, ledgers and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators import boards
from quaymark.plans.shape import BY, bars_sql, mean_sql, over, query, ratio_sql
from quaymark.plans.signal_queries import REG, _regimes
from quaymark.sources.bars import derive_bars, table

BARS = bars_sql()
NATION = bars_sql("nation")


@query(
    "flag:s n:i covered:e mean:f",
    """final AS (SELECT l_returnflag AS flag, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS covered, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity / l_extendedprice) AS mean FROM lineitem GROUP BY 1)""",
)
def harmonic_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice", F.col("l_quantity").cast("decimal(18,2)").cast("double").alias("w"))
    return boards.harmonic_mean(rows, ["flag"], "l_extendedprice", "w")


@query(
    "nation:i n:i rate:f shrunk:f",
    """c AS (SELECT c_nationkey AS nation, count(*) AS n, sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS hits FROM customer GROUP BY 1),
    final AS (SELECT nation, n, hits / n AS rate, (hits + 5 * 0.5) / (n + 5) AS shrunk FROM c)""",
)
def shrunk_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.sum((F.col("c_acctbal") > 5000).cast("int")).alias("hits"))
    return counts.select("nation", "n", (F.col("hits") / F.col("n")).alias("rate"), boards.shrunk_rate(F.col("hits"), F.col("n"), F.lit(0.5)).alias("shrunk"))


METRICS = f"""{NATION}, lr AS (SELECT *, ln(close) - lag(ln(close)) {BY} AS r, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS back FROM bars),
    mt AS (SELECT *, {', '.join(f"CASE WHEN count(r) {over(n)} >= {n} THEN stddev_pop(r) {over(n)} * sqrt(252) END AS rv{n}, pow(close / lag(close, {n}) {BY}, 252 / {n}) - 1 AS r_{n}a" for n in (5, 20, 60))} FROM lr),
    me AS (SELECT *, CASE WHEN code IN ('N0', 'N1') THEN 'bond' ELSE 'equity' END AS sleeve FROM mt WHERE back = 1)"""


@query(
    "lam:f lam_p25:f lam_p75:f n:i",
    f"""{METRICS}, x AS (SELECT r_60a / rv60 AS x FROM me WHERE sleeve = 'equity' AND r_60a IS NOT NULL AND rv60 >= 1e-6),
    final AS (SELECT coalesce(quantile_cont(x, 0.5), 0.3) AS lam, coalesce(quantile_cont(x, 0.25), 0.3) AS lam_p25, coalesce(quantile_cont(x, 0.75), 0.3) AS lam_p75, count(*) AS n FROM x)""",
)
def risk_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = boards.risk_metrics(derive_bars(spark, sf_dir, "nation"))
    return boards.price_of_risk(metrics.where(~F.col("code").isin("N0", "N1")), "r_60a", "rv60")


LAM = ", ".join(f"(SELECT coalesce(quantile_cont(r_{n}a / rv{n}, 0.5), 0.3) FROM me WHERE sleeve = 'equity' AND r_{n}a IS NOT NULL AND rv{n} >= 1e-6) AS lam_{n}" for n in (5, 20, 60))


@query(
    "code:s sleeve:s rv60:f r_60a:f req_5:f gap_5:f req_20:f gap_20:f req_60:f gap_60:f vol_vs_bond:f",
    f"""{METRICS}, lm AS (SELECT {LAM}),
    final AS (SELECT code, sleeve, rv60, r_60a, {', '.join(f"lam_{n} * rv{n} AS req_{n}, r_{n}a - lam_{n} * rv{n} AS gap_{n}" for n in (5, 20, 60))}, rv60 / (SELECT rv60 FROM me WHERE code = 'N0') AS vol_vs_bond FROM me, lm)""",
)
def pool_risk_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.pool_board(derive_bars(spark, sf_dir, "nation"), ["N0", "N1"], "N0")


TICKETS = f"""{NATION}, fr AS (SELECT code, d, lead(close, 20) {BY} / close - 1 AS r FROM bars),
    tk AS (SELECT code, count(*) AS n, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS p_up, avg(CASE WHEN r > 0 THEN r END) AS e_up, avg(CASE WHEN r < 0 THEN r END) AS e_down, quantile_cont(r, 0.05) AS q05,
      avg(greatest(r, 0)) / nullif(avg(greatest(-r, 0)), 0) AS match, avg(CASE WHEN r >= 0.02 THEN 1.0 ELSE 0 END) AS p_ge_need FROM fr WHERE r IS NOT NULL GROUP BY code)"""


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive_bars(spark, sf_dir, "nation").withColumn("r", F.lead("close", 20).over(w.by_code()) / F.col("close") - 1)
    return boards.ticket_stats(rows, ["code"], "r", 0.02)


@query("code:s n:i p_up:f e_up:f e_down:f q05:f match:f p_ge_need:f", f"{TICKETS}, final AS (SELECT * FROM tk)")
def return_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tickets(spark, sf_dir)


@query(
    "code:s label:s q05:f match:f reliable:i pass_floor:i in_up:i pass_both:i",
    f"""{TICKETS}, sub AS (SELECT * FROM tk WHERE code <> 'N5'), fl AS (SELECT quantile_cont(q05, 0.25) AS floor FROM sub),
    lb AS (SELECT code, CASE WHEN close > ma THEN 'up' WHEN close < ma THEN 'down' ELSE 'range' END AS label FROM (SELECT *, {mean_sql('close', 20)} AS ma, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS back FROM bars) WHERE back = 1),
    un AS (SELECT 'N' || n_nationkey AS code FROM nation),
    g AS (SELECT un.code, label, q05, match, coalesce(q05 >= floor, false) AS p, coalesce(label = 'up', false) AS u FROM un LEFT JOIN sub USING (code) LEFT JOIN lb USING (code), fl),
    final AS (SELECT code, label, q05, match, q05 IS NOT NULL AS reliable, p AS pass_floor, u AS in_up, p AND u AS pass_both FROM g)""",
)
def ticket_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derive_bars(spark, sf_dir, "nation").withColumn("ma", w.mean("close", 20))
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d")))
    label = F.when(F.col("close") > F.col("ma"), "up").when(F.col("close") < F.col("ma"), "down").otherwise("range")
    labels = bars.withColumns({"back": back, "label": label}).where("back = 1")
    tickets = _tickets(spark, sf_dir).where("code <> 'N5'")
    floor = tickets.agg(F.percentile("q05", 0.25).alias("floor"))
    universe = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"))
    return boards.ticket_card(universe, tickets, labels, floor)


CHECKS = f"""{NATION}, pool AS (SELECT 'N' || n_nationkey AS code FROM nation UNION ALL SELECT 'N99'), hr AS (SELECT code, max(d) AS last_d FROM bars GROUP BY code),
    rc AS (SELECT 'pool' AS name, count(*) FILTER (WHERE code NOT IN (SELECT code FROM hr)) AS n_bad, true AS hard FROM pool
      UNION ALL SELECT 'last_bar', count(*) FILTER (WHERE code NOT IN (SELECT code FROM hr WHERE last_d >= DATE '2001-11-01')), true FROM pool
      UNION ALL SELECT 'ticket', count(*) FILTER (WHERE code NOT IN (SELECT code FROM bars WHERE code <> 'N4')), false FROM pool
      UNION ALL SELECT 'trigger', count(*) FILTER (WHERE code NOT IN (SELECT code FROM bars WHERE code NOT IN ('N4', 'N7'))), false FROM pool)"""


def _receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derive_bars(spark, sf_dir, "nation")
    pool = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code")).unionByName(spark.createDataFrame([("N99",)], "code string"))
    return boards.receipt_checks(pool, bars, bars.where("code <> 'N4'"), bars.where("code not in ('N4', 'N7')"), F.lit("2001-11-01").cast("date"))


@query("name:s n_bad:i hard:i", f"{CHECKS}, final AS (SELECT * FROM rc)")
def receipt_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir)


@query(
    "status:s n_bad:i",
    f"""{CHECKS}, final AS (SELECT CASE WHEN sum(CASE WHEN hard AND n_bad > 0 THEN 1 ELSE 0 END) > 0 THEN 'STOP' WHEN sum(n_bad) > 0 THEN 'WARN' ELSE 'TODAY' END AS status, sum(n_bad) AS n_bad FROM rc)""",
)
def receipt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.overall(_receipts(spark, sf_dir))


@query(
    "code:s value:f weight:f weight_total:f",
    f"""{NATION}, lc AS (SELECT code, arg_max(close, d) AS last_close FROM bars GROUP BY code),
    h AS (SELECT 'N' || n_nationkey AS code, CASE WHEN n_nationkey % 4 = 0 THEN 1000.0 + n_nationkey END AS mv, 10.0 + n_nationkey AS shares, CASE WHEN n_nationkey % 4 = 1 THEN 3.5 END AS price, 2.0 AS cost FROM nation WHERE n_nationkey < 12
      UNION ALL SELECT 'CASH', 500.0, NULL, NULL, NULL UNION ALL SELECT 'N77', NULL, 8.0, NULL, 2.0),
    v AS (SELECT h.code, sum(coalesce(mv, shares * price, shares * last_close, shares * cost)) AS value FROM h LEFT JOIN lc USING (code) GROUP BY h.code),
    final AS (SELECT code, value, value / (SELECT sum(value) FROM v WHERE code <> 'CASH') AS weight, value / (SELECT sum(value) FROM v) AS weight_total FROM v WHERE code <> 'CASH')""",
)
def valued_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").where("n_nationkey < 12").select(
        F.concat(F.lit(" n"), key).alias("instrument"), F.when(key % 4 == 0, 1000.0 + key).alias("market_value"), (10.0 + key).alias("shares"),
        F.when(key % 4 == 1, 3.5).alias("close_price"), F.lit("2.0").alias("cost"),
    )
    more = spark.createDataFrame([("cash", 500.0, None, None, None), ("N77", None, 8.0, None, "2.0")], "instrument string, market_value double, shares double, close_price double, cost string")
    closes = derive_bars(spark, sf_dir, "nation").groupBy("code").agg(F.max_by("close", "d").alias("close"))
    return boards.holdings(rows.unionByName(more), closes)


@query(
    "code:s weight:f",
    "final AS (SELECT 'C' || c_custkey % 20 AS code, sum(CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey % 13 END) AS weight FROM customer WHERE c_nationkey = 3 GROUP BY 1)",
)
def weights_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), key % 20).alias("code"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("c_nationkey").cast("int")).alias("d"),
        F.when(key % 7 == 0, "n/a").otherwise((key % 13).cast("string")).alias("target_weight"),
    )
    return boards.weights_on(rows, F.lit("2000-01-04").cast("date"), ["final_weight", "target_weight"])


TREND = f"""{NATION}, t0 AS (SELECT *, ln(close) - lag(ln(close)) {BY} AS r, {mean_sql('close', 5)} AS ma5, {mean_sql('close', 10)} AS ma10, {mean_sql('close', 20)} AS ma20, row_number() {BY} AS bar FROM bars),
    t1 AS (SELECT *, (close / ma20 - 1) * 100 AS dist, {ratio_sql('close', 5)} AS ret_5, {ratio_sql('close', 20)} AS ret_20, CASE WHEN count(r) {over(20)} >= 20 THEN stddev_pop(r) {over(20)} * sqrt(252) END AS rv20,
      CASE WHEN count(r) {over(5)} >= 5 THEN stddev_pop(r) {over(5)} * sqrt(252) END AS rv5, close / max(close) {over(20)} - 1 AS dd20, coalesce(close < ma20, false) AS und FROM t0),
    t2 AS (SELECT *, rv5 / nullif(rv20, 0) AS vol_ratio, list(rv20) FILTER (WHERE rv20 IS NOT NULL) {over(120)} AS h, bar - coalesce(max(CASE WHEN NOT und THEN bar END) {BY}, 0) AS days_below, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS back FROM t1),
    t3 AS (SELECT *, CASE WHEN len(h) >= 60 AND rv20 IS NOT NULL THEN len(list_filter(h, lambda v: v <= rv20)) / len(h) END AS vol_pct,
      CASE WHEN ma5 > ma10 AND ma10 > ma20 THEN 'bull' WHEN ma5 < ma10 AND ma10 < ma20 THEN 'bear' ELSE 'mixed' END AS stack FROM t2 WHERE back = 1)"""


@query(
    "code:s dist:f stack:s ret_5:f ret_20:f vol_ratio:f vol_pct:f dd20:f days_below:i flags:s",
    f"""{TREND}, final AS (SELECT *, concat_ws('|', CASE WHEN dist < 0 THEN 'below_ma20' END, CASE WHEN dist < -5 THEN 'deep_below_ma20' END, CASE WHEN days_below >= 5 THEN 'below_ma20_5d+' END, CASE WHEN vol_pct >= 0.8 THEN 'high_vol' END,
      CASE WHEN stack = 'bear' THEN 'bear_stack' END, CASE WHEN dd20 <= -0.05 THEN 'dd5_20d' END, CASE WHEN ret_5 < ret_20 THEN 'mom_fade' END, CASE WHEN vol_ratio > 1.2 THEN 'vol_accel' END) AS flags FROM t3)""",
)
def trend_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.trend_board(derive_bars(spark, sf_dir, "nation"))


MODES = """mb AS (SELECT 'N' || n_nationkey AS code, CAST(n_regionkey AS INT) AS cluster FROM nation),
    sd AS (SELECT 'N' || n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'hold' ELSE 'cut' END AS mode FROM nation WHERE n_nationkey IN (0, 1, 2, 5, 8, 12)),
    pt AS (SELECT cluster, count(DISTINCT mode) AS n, min(mode) AS mode, list_sort(list(DISTINCT mode)) AS m FROM mb JOIN sd USING (code) GROUP BY 1)"""


def _seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation")
    code = F.concat(F.lit("N"), "n_nationkey").alias("code")
    seeds = nations.where("n_nationkey in (0, 1, 2, 5, 8, 12)").select(code, F.when(F.col("n_nationkey") % 2 == 0, "hold").otherwise("cut").alias("mode"))
    return nations.select(code, F.col("n_regionkey").alias("cluster")), seeds


@query("code:s cluster:i mode:s", f"{MODES}, final AS (SELECT code, mb.cluster, CASE WHEN n > 1 THEN NULL ELSE coalesce(mode, 'default') END AS mode FROM mb LEFT JOIN pt ON mb.cluster = pt.cluster)")
def cluster_overlay_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.overlay_modes(*_seeds(spark, sf_dir))


@query("cluster:i modes:s", f"{MODES}, final AS (SELECT cluster, array_to_string(m, '|') AS modes FROM pt WHERE n > 1)")
def overlay_mode_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.mode_conflicts(*_seeds(spark, sf_dir))


@query(
    "code:s target:s share:f held:f empty:f half:f best:s",
    f"""{REG}, x AS (SELECT code, d, raw AS state, coalesce({ratio_sql('close', 1)}, 0) AS r, lag(raw) {BY} AS bf FROM rw),
    e AS (SELECT x.*, t.target FROM x, (VALUES ('up'), ('down'), ('range')) t(target)),
    s AS (SELECT code, target, avg(CASE WHEN state = target THEN 1.0 ELSE 0 END) AS share, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS held,
      avg(CASE WHEN bf = target THEN 0 ELSE r END) / nullif(stddev_samp(CASE WHEN bf = target THEN 0 ELSE r END), 0) * sqrt(252) AS empty,
      avg(CASE WHEN bf = target THEN 0.5 * r ELSE r END) / nullif(stddev_samp(CASE WHEN bf = target THEN 0.5 * r ELSE r END), 0) * sqrt(252) AS half FROM e GROUP BY 1, 2),
    final AS (SELECT code, target, share, held, empty, half, CASE WHEN half > greatest(held, empty) + 1e-12 THEN 'half' WHEN empty > held + 1e-12 THEN 'empty' WHEN half > held + 1e-12 THEN 'half' ELSE 'full' END AS best FROM s)""",
)
def state_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boards.state_overlay(_regimes(spark, sf_dir).select("code", "d", "close", F.col("raw").alias("state")), ["up", "down", "range"])
