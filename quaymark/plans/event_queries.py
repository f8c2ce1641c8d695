"""Queries over blended weights with a veto, extrema trades, event positions and what follows an anchor day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators import features, signals
from quaymark.plans.shape import BY, bars_sql, mean_sql, over, query, ratio_sql
from quaymark.plans.signal_queries import REG, _regimes
from quaymark.plans.source_queries import QUIET
from quaymark.sources.bars import derive_bars

NATION = bars_sql("nation")
VETOED = f"""rr AS (SELECT code, d, close, close / lag(close) {BY} - 1 AS r FROM bars), qv AS (SELECT *, CASE WHEN count(r) {over(60)} >= 60 THEN quantile_cont(r, 0.05) {over(60)} END AS q05 FROM rr),
    vf AS (SELECT code, d, q05, quantile_cont(q05, 0.25) OVER (PARTITION BY d) AS floor FROM qv WHERE q05 IS NOT NULL), vt AS (SELECT * FROM vf WHERE q05 >= floor)"""


def _vetoed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive_bars(spark, sf_dir, "nation").withColumn("r", F.col("close") / F.lag("close").over(w.by_code()) - 1)
    last = w.last_rows(60)
    return signals.tail_veto(rows.withColumn("q05", F.when(F.count("r").over(last) >= 60, F.percentile("r", F.lit(0.05)).over(last))), "q05")


@query("code:s d:d q05:f floor:f", f"{NATION}, {VETOED}, final AS (SELECT * FROM vt)")
def tail_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vetoed(spark, sf_dir)


@query(
    "d:d code:s weight:f",
    f"""{NATION}, {VETOED}, m AS (SELECT code, d, {ratio_sql('close', 60)} AS mom FROM bars), k AS (SELECT * FROM m WHERE mom IS NOT NULL), a AS (SELECT d, mom AS am FROM k WHERE code = 'N0'),
    b AS (SELECT k.* FROM k JOIN a ON a.d = k.d JOIN vt ON vt.code = k.code AND vt.d = k.d WHERE k.code <> 'N0' AND mom > am), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY mom DESC, code) AS rn FROM b),
    c AS (SELECT d, code, 0.6 / count(*) OVER (PARTITION BY d) AS weight FROM r WHERE rn <= 3),
    final AS (SELECT * FROM c UNION ALL SELECT a.d, 'N0', CASE WHEN a.d IN (SELECT d FROM c) THEN 0.4 ELSE 1.0 END FROM a)""",
)
def blended_anchor_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.beat_anchor(derive_bars(spark, sf_dir, "nation"), "N0", keep=0.4, allowed=_vetoed(spark, sf_dir))


@query(
    "code:s trade_no:i signal_d:d entry_d:d leave_d:d exit_d:d entry_px:f exit_px:f ret:f bars_held:i",
    f"""{QUIET}, a5 AS (SELECT d, avg(rv5) AS arv FROM v GROUP BY d), x0 AS (SELECT qd.*, {mean_sql('close', 5)} AS s5, {mean_sql('close', 20)} AS s20, {ratio_sql('close', 5)} AS got5, row_number() {BY} AS bar,
      min(close) {over(11)} AS lo, max(close) {over(11)} AS hi, got - (pow(1 + need, 20.0 / 252) - 1) AS g20 FROM qd),
    x1 AS (SELECT x0.*, got5 - (pow(1 + CASE WHEN arv > 0 THEN 0.05 * rv5 / arv END, 5.0 / 252) - 1) AS g5 FROM x0 LEFT JOIN a5 ON a5.d = x0.d),
    x2 AS (SELECT code, d, close, bar, coalesce(close < s20 AND s5 < s20 AND g5 <= 0 AND g20 <= 0 AND NOT (fig9_touch_hi OR fig10_touch_hi) AND bar > 10 AND close = lo AND g20 <= -0.005, false) AS b,
      coalesce(close > s20 AND s5 > s20 AND g5 >= 0 AND g20 >= 0 AND bar > 10 AND close = hi AND g20 >= 0.005, false) AS s FROM x1),
    x3 AS (SELECT *, lead(d) {BY} AS nd, lead(close) {BY} AS nc, last_value(close) OVER w AS lc, max(bar) OVER w AS lb, CASE WHEN b THEN 'buy' WHEN s THEN 'sell' END AS kind FROM x2 WINDOW w AS (PARTITION BY code ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    x4 AS (SELECT *, coalesce(lag(kind) {BY}, 'sell') AS was FROM x3 WHERE kind IS NOT NULL AND nd IS NOT NULL), x5 AS (SELECT *, lead(d) {BY} AS xd, lead(nd) {BY} AS xnd, lead(nc) {BY} AS xnc, lead(bar) {BY} AS xb FROM x4 WHERE kind <> was),
    final AS (SELECT code, row_number() {BY} AS trade_no, d AS signal_d, nd AS entry_d, xd AS leave_d, xnd AS exit_d, nc AS entry_px, coalesce(xnc, lc) AS exit_px, coalesce(xnc, lc) / nc - 1 AS ret, coalesce(xb + 1, lb) - bar - 1 AS bars_held FROM x5 WHERE kind = 'buy')""",
)
def extrema_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived bars move less than listed funds, so the second knife cuts at half a percent here, by a filter of its own."""
    rows = features.moving_averages(features.quiet_discount(features.multi_scale(derive_bars(spark, sf_dir), ["fig7", "fig8", "fig9", "fig10"])))
    rows = rows.withColumn("gap_20", F.col("need_gap")).drop("need", "period_need", "need_gap", "anchor_rv").withColumn("rv", F.col("rv5"))
    rows = features.fair_need(rows, features.daily_anchor(rows), days=5).withColumn("gap_5", F.col("need_gap"))
    found = signals.extrema_candidates(rows, knife="none").withColumns({"buy": F.col("buy") & (F.col("gap_20") <= -0.005), "sell": F.col("sell") & (F.col("gap_20") >= 0.005)})
    return signals.alternating_trades(found, "buy", "sell")


@query(
    "d:d n:i ret:f equity:f fall:f",
    f"""{REG}, e0 AS (SELECT rw.code, rw.d, rw.close, rw.open, raw, row_number() {BY} AS bar, count(*) OVER (PARTITION BY code) AS nb, close / lag(close) {BY} - 1 AS dr, close / open - 1 AS orr, lag(raw) {BY} AS was FROM rw),
    e1 AS (SELECT *, CASE WHEN raw = 'up' AND was <> 'up' THEN 'buy' WHEN raw = 'down' AND was <> 'down' THEN 'sell' END AS act FROM e0),
    e2 AS (SELECT code, bar AS sb, CASE WHEN act = 'buy' THEN 1.0 ELSE -1.0 END AS sign, unnest(range(1, 6)) AS k FROM e1 WHERE act IS NOT NULL AND bar + 5 <= nb),
    e3 AS (SELECT e1.d, CASE WHEN k = 1 THEN sign * orr - 0.001 ELSE sign * dr END AS part FROM e2 JOIN e1 ON e1.code = e2.code AND e1.bar = sb + k), e4 AS (SELECT d, count(*) AS n, avg(part) AS ret FROM e3 GROUP BY d),
    e5 AS (SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY d)) AS equity FROM e4), final AS (SELECT *, equity / greatest(max(equity) OVER (ORDER BY d), 1) - 1 AS fall FROM e5)""",
)
def event_position_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of five bars at turns of the raw label to up and to down."""
    was = F.lag("raw").over(w.by_code())
    act = F.when((F.col("raw") == "up") & (was != "up"), "buy").when((F.col("raw") == "down") & (was != "down"), "sell")
    return signals.event_equity(_regimes(spark, sf_dir).withColumn("action", act), "action")


@query(
    "code:s days:i ret:f upside:f drawdown:f rank:f",
    f"""{NATION}, dd AS (SELECT d, row_number() OVER (ORDER BY d) AS day FROM (SELECT DISTINCT d FROM bars)), st AS (SELECT max(day) FILTER (WHERE d <= DATE '2000-06-30') AS s, max(day) AS e FROM dd),
    bb AS (SELECT code, day, close, s, e FROM bars JOIN dd ON dd.d = bars.d, st), cs AS (SELECT c.code, days, b.close AS base FROM (SELECT DISTINCT code FROM bars) c CROSS JOIN (VALUES (20), (60)) t(days) LEFT JOIN bb b ON b.code = c.code AND b.day = b.s),
    ah AS (SELECT code, days, max_by(close, day) AS la, max(close) AS mo, min(close) AS le FROM bb, (VALUES (20), (60)) t(days) WHERE day > s AND day <= s + days AND s + days <= e GROUP BY 1, 2),
    fd AS (SELECT cs.code, cs.days, la / base - 1 AS ret, mo / base - 1 AS upside, le / base - 1 AS drawdown FROM cs LEFT JOIN ah ON ah.code = cs.code AND ah.days = cs.days),
    final AS (SELECT *, CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY days, ret IS NULL ORDER BY ret) + (count(*) OVER (PARTITION BY days, ret) - 1) / 2.0) / count(ret) OVER (PARTITION BY days) END AS rank FROM fd)""",
)
def anchor_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.after_anchor(derive_bars(spark, sf_dir, "nation"), "2000-06-30")
