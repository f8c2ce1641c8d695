"""Queries over the position machines and the ledger of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators import features, ledger, machines, scenario
from quaymark.plans.shape import BY, fold_sql, mean_sql, query
from quaymark.plans.signal_queries import EDGE, MACHINE, REG, RULES, _regimes, _rules, _signal_rows
from quaymark.plans.source_queries import QUIET
from quaymark.sources.bars import derive_bars

TRADES = "code:s trade_no:i signal_d:d entry_d:d exit_d:d entry_px:f exit_px:f reason:s bars_held:i ret:f"
MASK = ["code", "d", "close", "ae_buy", "ae_sell", "keep_trend"]

PEAK = "greatest(s.mp, coalesce(x.fig9_pos, s.mp))"
WHY = f"CASE WHEN s.sg IS NULL OR x.i >= x.n_rows THEN NULL WHEN x.lv_ridden THEN 'left' WHEN x.lv_again AND {PEAK} >= 0.5 THEN 'again' WHEN x.lv_soft AND {PEAK} >= 0.4 THEN 'soft' END"
LEAVE = f"""{EDGE}, sz AS (SELECT *, coalesce(aux_buy AND fig9_pos <= 0.3, false) AND NOT fig9_near_lo AS soft,
      NOT fig9_near_hi AND coalesce(sum(CASE WHEN fig9_near_hi THEN 1 ELSE 0 END) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) = 4, false) AS lv_ridden FROM masks),
    lv AS (SELECT *, edge AND aux_buy AS lv_buy, edge AS lv_again, soft AND NOT coalesce(lag(soft) {BY}, false) AS lv_soft FROM sz),
    {fold_sql("lf", "lv", "close, fig9_pos, lv_buy, lv_ridden, lv_again, lv_soft",
        {"sg": "CASE WHEN x.lv_buy THEN 1 END", "mp": "CASE WHEN x.lv_buy THEN coalesce(x.fig9_pos, -1e300) END", "xs": "CAST(NULL AS BIGINT)", "why": "CAST(NULL AS VARCHAR)"},
        {"sg": f"CASE WHEN s.sg IS NULL THEN CASE WHEN x.lv_buy AND x.i < x.n_rows THEN x.i END WHEN ({WHY}) IS NOT NULL THEN NULL ELSE s.sg END",
         "mp": f"CASE WHEN s.sg IS NULL THEN CASE WHEN x.lv_buy THEN coalesce(x.fig9_pos, -1e300) END ELSE {PEAK} END", "xs": f"CASE WHEN ({WHY}) IS NOT NULL THEN s.sg END", "why": WHY})},
    tr AS (SELECT code, xs AS si, i + 1 AS xi, why AS reason FROM lf WHERE why IS NOT NULL UNION ALL SELECT code, sg, NULL, 'open' FROM lf WHERE i = n_rows AND sg IS NOT NULL),
    final AS (SELECT t.code, row_number() OVER (PARTITION BY t.code ORDER BY si) AS trade_no, a.d AS signal_d, e.d AS entry_d, z.d AS exit_d, e.close AS entry_px, z.close AS exit_px, reason, xi - si - 1 AS bars_held, z.close / e.close - 1 AS ret
      FROM tr t JOIN lf_n a ON a.code = t.code AND a.i = si JOIN lf_n e ON e.code = t.code AND e.i = si + 1 LEFT JOIN lf_n z ON z.code = t.code AND z.i = xi)"""


@query(TRADES, LEAVE)
def leave_rail_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.leave_signals(_signal_rows(spark, sf_dir, ["fig9", "fig10"]))
    return ledger.leave_trades(rows.select("code", "d", "close", "fig9_pos", "lv_buy", "lv_ridden", "lv_again", "lv_soft"))


@query(
    TRADES,
    f"""{QUIET},
    tg AS (SELECT *, greatest(high - low, abs(high - lag(close) {BY}), abs(low - lag(close) {BY})) AS tr FROM qd),
    px AS MATERIALIZED (SELECT *, row_number() {BY} AS i, count(*) OVER (PARTITION BY code) AS n_rows, {mean_sql('tr', 20)} AS atr FROM tg),
    sg AS (SELECT a.code, a.i, b.close AS epx, b.close - coalesce(b.atr, 0.1 * b.close) AS stop FROM px a JOIN px b ON b.code = a.code AND b.i = a.i + 1 WHERE a.qd_entry),
    hit AS (SELECT s.code, s.i, b.i AS x, CASE WHEN b.low <= stop THEN 'stop' WHEN coalesce(b.fig9_touch_hi OR b.fig10_touch_hi, false) THEN 's1_upper' WHEN coalesce(b.fig7_gap >= 0, false) THEN 'fig7_reclaim'
      WHEN coalesce(b.fig7_g < 0 AND b.fig8_g < 0, false) THEN 'trend_break' WHEN b.i - s.i - 1 >= 40 THEN 'max_hold' END AS why, stop, b.close AS c FROM sg s JOIN px b ON s.code = b.code AND b.i BETWEEN s.i + 2 AND s.i + 41),
    on_ AS (SELECT code, i, min(x) AS x, arg_min(why, x) AS reason, arg_min(CASE WHEN why = 'stop' THEN stop ELSE c END, x) AS exit_px FROM hit WHERE why IS NOT NULL GROUP BY 1, 2),
    one AS MATERIALIZED (SELECT s.code, s.i, coalesce(o.x, z.i) AS x, coalesce(reason, 'eod') AS reason, coalesce(exit_px, z.close) AS exit_px FROM sg s LEFT JOIN on_ o USING (code, i) JOIN px z ON z.code = s.code AND z.i = z.n_rows),
    ch AS (SELECT o.*, 1 AS trade_no FROM one o WHERE i = (SELECT min(i) FROM one z WHERE z.code = o.code)
      UNION ALL SELECT o.*, c.trade_no + 1 FROM ch c JOIN one o ON o.code = c.code AND o.i = (SELECT min(z.i) FROM one z WHERE z.code = c.code AND z.i > c.x)),
    final AS (SELECT ch.code, trade_no, a.d AS signal_d, e.d AS entry_d, z.d AS exit_d, e.close AS entry_px, exit_px, reason, ch.x - ch.i - 1 AS bars_held, exit_px / e.close - 1 AS ret
      FROM ch JOIN px a ON a.code = ch.code AND a.i = ch.i JOIN px e ON e.code = ch.code AND e.i = ch.i + 1 JOIN px z ON z.code = ch.code AND z.i = ch.x)""",
)
def quiet_discount_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.multi_scale(derive_bars(spark, sf_dir), ["fig7", "fig8", "fig9", "fig10"])
    rows = ledger.quiet_exits(features.atr(features.quiet_discount(rows)))
    return ledger.quiet_trades(rows.select("code", "d", "close", "low", "atr", "qd_entry", "qx_s1", "qx_reclaim", "qx_break"))


LEDGER = f"""{RULES}, {MACHINE},
    t0 AS (SELECT code, xs AS si, xe AS ei, i + 1 AS xi, why AS reason FROM mc WHERE why IS NOT NULL
      UNION ALL SELECT code, sg, CASE WHEN fi <= n_rows THEN fi END, NULL, CASE WHEN fi <= n_rows THEN 'open' ELSE 'pending' END FROM mc WHERE i = n_rows AND fi IS NOT NULL),
    t1 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY si) AS trade_no FROM t0),
    pth AS (SELECT t.code, trade_no, b.i, b.close / max(b.close) OVER (PARTITION BY t.code, trade_no ORDER BY b.i) - 1 AS dd, b.close FROM t1 t JOIN mc_n b ON b.code = t.code AND b.i BETWEEN ei AND coalesce(xi, b.n_rows)),
    wst AS (SELECT code, trade_no, min(dd) AS mdd, arg_max(close, i) AS last_px FROM pth GROUP BY 1, 2),
    lg AS (SELECT t.code, t.trade_no, a.d AS signal_d, e.d AS entry_d, z.d AS exit_d, reason, CASE WHEN a.d < DATE '1998-01-01' THEN 'in_sample' WHEN a.d < DATE '2000-01-01' THEN 'pseudo_forward' ELSE 'forward' END AS segment,
      z.close / e.close - 1 AS ret_gross, z.close * (1 - 0.0005) / (e.close * (1 + 0.0005)) - 1 AS ret_net, mdd, CASE WHEN xi IS NULL THEN last_px / e.close - 1 END AS unrealised
      FROM t1 t JOIN mc_n a ON a.code = t.code AND a.i = si LEFT JOIN mc_n e ON e.code = t.code AND e.i = ei LEFT JOIN mc_n z ON z.code = t.code AND z.i = xi LEFT JOIN wst ON wst.code = t.code AND wst.trade_no = t.trade_no)"""


def _ledger(rules: DataFrame) -> DataFrame:
    trades = machines.run_rules(rules.select(*MASK), "ae_buy", "ae_sell", "keep_trend")
    return ledger.ledger(trades, rules, "1998-01-01", "2000-01-01")


@query("code:s trade_no:i signal_d:d entry_d:d exit_d:d reason:s segment:s ret_gross:f ret_net:f mdd:f unrealised:f", f"{LEDGER}, final AS (SELECT * FROM lg)")
def trade_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(_rules(spark, sf_dir))


@query(
    "test:s n:i value:f status:s",
    f"""{LEDGER}, hd AS (SELECT code, d, i, close, coalesce(lag(CASE WHEN fi IS NOT NULL THEN 1.0 ELSE 0 END) OVER (PARTITION BY code ORDER BY i), 0) AS held FROM mc),
    mv AS (SELECT *, coalesce(lag(held) OVER o, 0) AS weight, coalesce(close / lag(close) OVER o - 1, 0) AS r, abs(held - coalesce(lag(held) OVER o, 0)) AS turn FROM hd WINDOW o AS (PARTITION BY code ORDER BY i)),
    eq AS (SELECT code, d, close, d >= DATE '1998-01-01' AS later, exp(sum(ln(1 + weight * r - turn * 0.0005)) OVER (PARTITION BY code ORDER BY i)) AS equity FROM mv),
    fl AS (SELECT *, equity / max(equity) OVER o - 1 AS e, close / max(close) OVER o - 1 AS b FROM eq WINDOW o AS (PARTITION BY code, later ORDER BY d)),
    dn AS (SELECT code, min(CASE WHEN later THEN e END) AS sm, min(CASE WHEN later THEN b END) AS bm, min(CASE WHEN NOT later THEN e END) AS pm FROM fl GROUP BY code),
    k AS (SELECT sum(CASE WHEN bm <= -0.05 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN bm <= -0.05 AND sm > bm THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN bm <= -0.05 THEN 1 ELSE 0 END), 0) AS share,
      sum(CASE WHEN pm < 0 AND abs(sm) > 1.5 * abs(pm) AND sm < bm THEN 1 ELSE 0 END) AS fused, count(*) AS names,
      sum(CASE WHEN sm IS NULL OR coalesce(pm >= 0, true) THEN 1 ELSE 0 END) AS unknown FROM dn),
    c AS (SELECT count(*) AS n2, avg(CASE WHEN ret_net > 0 THEN 1.0 ELSE 0 END) AS wins, quantile_cont(ret_net, 0.5) AS median FROM lg WHERE ret_net IS NOT NULL),
    st AS (SELECT *, CASE WHEN n1 < 5 THEN 'open' WHEN share < 0.5 THEN 'fail' ELSE 'pass' END AS k1, CASE WHEN n2 < 30 THEN 'open' WHEN wins <= 11.0 / 30 OR NOT median > 0 THEN 'fail' ELSE 'pass' END AS k2, CASE WHEN fused > 0 THEN 'fail' WHEN names = 0 OR unknown > 0 THEN 'open' ELSE 'pass' END AS k3 FROM k, c),
    final AS (SELECT 'k1' AS test, n1 AS n, CAST(share AS DOUBLE) AS value, k1 AS status FROM st UNION ALL SELECT 'k2', n2, wins, k2 FROM st UNION ALL SELECT 'k3', names, fused, k3 FROM st
      UNION ALL SELECT 'overall', NULL, NULL, CASE WHEN k3 = 'fail' THEN 'fail' WHEN k1 = 'fail' OR k2 = 'fail' THEN 'fail' WHEN k1 = 'pass' AND k2 = 'pass' THEN 'pass' ELSE 'open' END FROM st)""",
)
def ledger_failure_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark, sf_dir)
    equity = machines.rule_equity(rules.select(*MASK), "ae_buy", "ae_sell", "keep_trend")
    return ledger.failure_tests(ledger.drawdowns(equity, rules, "1998-01-01"), _ledger(rules))


@query(
    "code:s price:f why:s",
    f"""{RULES}, b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS back FROM rl),
    final AS (SELECT code, fig9_lower * 1.01 AS price, CASE WHEN fig9_lower IS NULL THEN 'no_rail' WHEN fast AND (ae_buy OR deep_buy) THEN 'fast_blocked' WHEN fast THEN 'fast_active' WHEN ae_buy OR deep_buy THEN 'buy_today'
      WHEN exp(fig9_gap) - 1 <= -0.08 AND NOT fig9_near_lo THEN 'touch_is_enough' WHEN NOT aux_buy THEN 'picture_not_ready' WHEN fig9_near_lo THEN 'inside_already' ELSE 'price_only' END AS why FROM b WHERE back = 1)""",
)
def buy_price_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.buy_quotes(_rules(spark, sf_dir))


@query(
    "code:s train_bh:f train_up:f policy:s oos:f",
    f"""{REG}, m AS (SELECT code, d, ln(close / lag(close) {BY}) AS r, coalesce(lag(raw) {BY} = 'up', false) AS up, d >= DATE '1999-01-01' AS late FROM rw),
    m2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY code, late ORDER BY d) = 1 THEN 0 ELSE coalesce(r, 0) END AS x FROM m),
    s AS (SELECT code, count(*) FILTER (WHERE NOT late) AS n, exp(sum(CASE WHEN NOT late THEN x ELSE 0 END)) - 1 AS train_bh, exp(sum(CASE WHEN NOT late AND up THEN x ELSE 0 END)) - 1 AS train_up,
      exp(sum(CASE WHEN late THEN x ELSE 0 END)) - 1 AS ob, exp(sum(CASE WHEN late AND up THEN x ELSE 0 END)) - 1 AS ou FROM m2 GROUP BY code),
    p AS (SELECT *, CASE WHEN n < 2 THEN 'hold_up' WHEN train_bh >= train_up AND train_bh >= 0 THEN 'bh' WHEN train_up >= 0 THEN 'hold_up' ELSE 'cash' END AS policy FROM s),
    final AS (SELECT code, train_bh, train_up, policy, CASE WHEN policy = 'bh' THEN ob WHEN policy = 'hold_up' THEN ou ELSE 0 END AS oos FROM p)""",
)
def trained_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.policies(_regimes(spark, sf_dir).select("code", "d", "close", F.col("raw").alias("label")), "1999-01-01")


@query("code:s move:i close:f buy:i sell:i")
def next_close_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario.next_closes(derive_bars(spark, sf_dir, "nation"))


@query("code:s close:f buy_price:f sell_price:f")
def next_trigger_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenario.trigger_prices(derive_bars(spark, sf_dir, "nation"))
