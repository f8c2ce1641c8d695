"""Queries over daily bars: windows, prices, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators import features, prices, runs
from quaymark.plans.shape import BY, bars_sql, mean_sql, over, panels_sql, query, ratio_sql
from quaymark.sources.bars import business_days, derive_bars, on_calendar

BARS = bars_sql()
NATION = bars_sql("nation")
SO_FAR = "OVER (PARTITION BY code ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("code:s d:d open:f high:f low:f close:f volume:f", f"{BARS}, final AS (SELECT * FROM bars)")
def bars_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_bars(spark, sf_dir)


@query("code:s d:d open:f high:f low:f close:f volume:f", f"{NATION}, final AS (SELECT * FROM bars)")
def bars_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_bars(spark, sf_dir, "nation")


@query(
    "code:s d:d close:f fig9_path:f fig9_lower:f fig9_gap:f ma5:f ma20:f",
    f"""{BARS}, {panels_sql(['fig9'])},
    avgs AS (SELECT *, {mean_sql('close', 5)} AS ma5, {mean_sql('close', 20)} AS ma20 FROM feat),
    edges AS (SELECT *, lag(fig9_near_lo) {BY} AS before FROM avgs),
    final AS (SELECT * FROM edges WHERE fig9_near_lo AND NOT coalesce(before, false))""",
)
def fair_path_fig9_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First days near the lower rail of the half-year fair path."""
    rows = features.multi_scale(derive_bars(spark, sf_dir), ["fig9"])
    rows = rows.withColumns({"ma5": w.mean("close", 5), "ma20": w.mean("close", 20), "edge": w.rising("fig9_near_lo")})
    return rows.where("edge")


@query(
    "code:s d:d ma5:f ma10:f ma20:f ma60:f ma60_early:f",
    f"""{BARS}, final AS (SELECT code, d, {', '.join(f'{mean_sql("close", n)} AS ma{n}' for n in (5, 10, 20, 60))},
    {mean_sql('close', 60, 30)} AS ma60_early FROM bars)""",
)
def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.moving_averages(derive_bars(spark, sf_dir)).withColumn("ma60_early", w.mean("close", 60, 30))


@query(
    "code:s d:d p20:f p60:f hi60:f lo60:f pos20:f dd:f",
    f"""{BARS}, final AS (SELECT code, d, {ratio_sql('close', 20)} AS p20, {ratio_sql('close', 60)} AS p60,
    max(close) {over(60)} AS hi60, min(close) {over(60)} AS lo60,
    (close - min(close) {over(20)}) / nullif(max(close) {over(20)} - min(close) {over(20)}, 0) AS pos20,
    close / max(close) {SO_FAR} - 1 AS dd FROM bars)""",
)
def priors_and_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive_bars(spark, sf_dir)
    span = w.highest("close", 20) - w.lowest("close", 20)
    return rows.withColumns(
        {
            "p20": w.lag_ratio("close", 20), "p60": w.lag_ratio("close", 60), "hi60": w.highest("close", 60),
            "lo60": w.lowest("close", 60), "pos20": (F.col("close") - w.lowest("close", 20)) / F.nullif(span, F.lit(0.0)),
            "dd": w.drawdown("close"),
        }
    )


@query(
    "code:s d:d tr:f atr:f",
    f"""{BARS}, tr AS (SELECT *, greatest(high - low, abs(high - lag(close) {BY}), abs(low - lag(close) {BY})) AS tr FROM bars),
    final AS (SELECT code, d, tr, {mean_sql('tr', 20)} AS atr FROM tr)""",
)
def average_true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.atr(derive_bars(spark, sf_dir))


VOL = f"""{BARS}, logs AS (SELECT *, ln(close) - lag(ln(close)) {BY} AS r FROM bars),
    vol AS (SELECT *, CASE WHEN count(r) {over(5)} >= 5 THEN stddev_pop(r) {over(5)} * sqrt(252) END AS rv FROM logs),
    held AS (SELECT *, list(rv) FILTER (WHERE rv IS NOT NULL) {over(252)} AS h FROM vol),
    pct AS (SELECT *, CASE WHEN len(h) >= 60 AND rv IS NOT NULL THEN len(list_filter(h, lambda v: v <= rv)) / len(h) END AS rv_pct FROM held),
    states AS (SELECT *, CASE WHEN rv_pct <= 0.3 THEN 'calm' WHEN rv_pct < 0.7 THEN 'normal' WHEN rv_pct < 0.9 THEN 'cluster'
               WHEN rv_pct IS NOT NULL THEN 'extreme' END AS vol_state FROM pct)"""


@query("code:s d:d rv:f rv_pct:f vol_state:s", f"{VOL}, final AS (SELECT * FROM states)")
def volatility_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.vol_regime(derive_bars(spark, sf_dir))


PANEL_SPEC = "code:s d:d " + " ".join(f"{p}_{c}" for p in ("fig9", "fig10") for c in ("path:f", "g:f", "gap:f", "lower:f", "upper:f", "touch_lo:i", "touch_hi:i", "above:i", "pos:f"))


@query(PANEL_SPEC, f"{BARS}, {panels_sql(['fig9', 'fig10'])}, final AS (SELECT * FROM feat)")
def multi_scale_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.multi_scale(derive_bars(spark, sf_dir), ["fig9", "fig10"])


@query(
    "code:s d:d fig7_path:f fig7_g:f fig8_path:f fig8_g:f fig11_path:f fig11_g:f",
    f"{BARS}, {panels_sql(['fig7', 'fig8', 'fig11'])}, final AS (SELECT * FROM feat)",
)
def long_and_short_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.fair_path(features.with_logs(derive_bars(spark, sf_dir)), ["fig7", "fig8", "fig11"])


@query(
    "code:s d:d fig9_lower:f fig9_upper:f",
    f"""{BARS}, {panels_sql(['fig9'])}, trail AS (SELECT *, CASE WHEN count(fig9_gap) {over(252)} >= 63
    THEN quantile_cont(abs(fig9_gap), 0.9) {over(252)} END AS delta FROM gaps),
    final AS (SELECT code, d, fig9_path * exp(-delta) AS fig9_lower, fig9_path * exp(delta) AS fig9_upper FROM trail)""",
)
def trailing_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.fair_path(features.with_logs(derive_bars(spark, sf_dir)), ["fig9"])
    return features.rails(rows, ["fig9"], 0.9, lookback=252)


@query(
    "code:s d:d signed:f",
    f"""{BARS}, {panels_sql(['fig10'])}, held AS (SELECT *, list(abs(fig10_gap)) FILTER (WHERE fig10_gap IS NOT NULL) {SO_FAR} AS h FROM gaps),
    final AS (SELECT code, d, CASE WHEN len(h) >= 63 AND fig10_gap IS NOT NULL
    THEN len(list_filter(h, lambda v: v <= abs(fig10_gap))) / len(h) * sign(fig10_gap) END AS signed FROM held)""",
)
def signed_gap_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.rails(features.fair_path(features.with_logs(derive_bars(spark, sf_dir)), ["fig10"]), ["fig10"])
    return features.signed_percentile(rows, "fig10_gap", "signed")


@query(
    "kind:s value:s n:i coverage:f ok:i",
    f"""{BARS}, {panels_sql(['fig9'])},
    vol AS (SELECT *, CASE WHEN count(r) {over(5)} >= 5 THEN stddev_pop(r) {over(5)} * sqrt(252) END AS rv FROM feat),
    held AS (SELECT *, list(rv) FILTER (WHERE rv IS NOT NULL) {over(252)} AS h FROM vol),
    pct AS (SELECT *, CASE WHEN len(h) >= 60 AND rv IS NOT NULL THEN len(list_filter(h, lambda v: v <= rv)) / len(h) END AS rv_pct FROM held),
    known AS (SELECT CAST(year(d) AS VARCHAR) AS y, CASE WHEN rv_pct <= 0.3 THEN 'calm' WHEN rv_pct < 0.7 THEN 'normal'
              WHEN rv_pct < 0.9 THEN 'cluster' WHEN rv_pct IS NOT NULL THEN 'extreme' END AS st,
              CASE WHEN close BETWEEN fig9_lower * (1 - 1e-9) AND fig9_upper * (1 + 1e-9) THEN 1.0 ELSE 0.0 END AS i FROM pct WHERE fig9_lower IS NOT NULL),
    cov AS (SELECT 'all' AS kind, '-' AS value, count(*) AS n, avg(i) AS coverage FROM known
            UNION ALL SELECT 'year', coalesce(y, '-'), count(*), avg(i) FROM known GROUP BY y
            UNION ALL SELECT 'state', coalesce(st, '-'), count(*), avg(i) FROM known GROUP BY st),
    final AS (SELECT *, coverage >= 0.9 AND ((kind = 'state' AND value IN ('cluster', 'extreme')) OR coverage <= 0.98) AS ok FROM cov)""",
)
def rail_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.multi_scale(derive_bars(spark, sf_dir), ["fig9"])
    return features.coverage(features.vol_regime(rows), "fig9")


STATE_SQL = f"""{BARS}, {panels_sql(['fig9', 'fig10'])},
    below AS (SELECT *, coalesce(close < fig10_path, false) AS b FROM feat),
    isl AS (SELECT *, sum(CASE WHEN b THEN 0 ELSE 1 END) {SO_FAR} AS isl FROM below),
    cnt AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY code, isl ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS below_run FROM isl),
    st AS (SELECT *, CASE WHEN fig9_lower IS NULL OR fig10_lower IS NULL THEN 'warm_up' WHEN fig9_touch_hi AND fig10_touch_hi THEN 'overheat'
           WHEN below_run >= 10 AND fig10_g < 0 THEN 'knife' WHEN fig9_g < 0 AND fig10_g < 0 THEN 'down'
           WHEN fig9_g > 0 AND fig10_g > 0 THEN 'up' WHEN fig9_g < 0 AND fig10_g > 0 THEN 'repair' ELSE 'chop' END AS state FROM cnt)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.six_states(features.multi_scale(derive_bars(spark, sf_dir), ["fig9", "fig10"]))


@query("code:s d:d below_run:i state:s", f"{STATE_SQL}, final AS (SELECT * FROM st)")
def six_state_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


@query(
    "code:s run_no:i label:s start_d:d end_d:d n:i ret:f",
    f"""{STATE_SQL}, ch AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) {BY} OR row_number() {BY} = 1 THEN 1 ELSE 0 END AS ch FROM st),
    rn AS (SELECT *, sum(ch) {SO_FAR} AS run_no FROM ch),
    final AS (SELECT code, run_no, min(state) AS label, min(d) AS start_d, max(d) AS end_d, count(*) AS n,
              max_by(close, d) / min_by(close, d) - 1 AS ret FROM rn GROUP BY code, run_no)""",
)
def state_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.segments(_states(spark, sf_dir), "state")


@query(
    "code:s d:d state:s",
    f"{STATE_SQL}, lg AS (SELECT *, lag(state) {BY} AS state_before FROM st), final AS (SELECT * FROM lg WHERE state IS DISTINCT FROM state_before)",
)
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.first_of_run(_states(spark, sf_dir), "state")


@query(
    "code:s event_no:i onset:d end_d:d n:i",
    f"""{BARS}, {panels_sql(['fig10'])}, tr AS (SELECT code, d, bar FROM feat WHERE fig10_touch_lo),
    nw AS (SELECT *, CASE WHEN coalesce(bar - lag(bar) {BY} > 5, true) THEN 1 ELSE 0 END AS nw FROM tr),
    ev AS (SELECT *, sum(nw) {SO_FAR} AS event_no FROM nw),
    final AS (SELECT code, event_no, min(d) AS onset, max(d) AS end_d, count(*) AS n FROM ev GROUP BY code, event_no)""",
)
def touch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.cluster_events(features.multi_scale(derive_bars(spark, sf_dir), ["fig10"]), "fig10_touch_lo")


@query(
    "code:s d:d low10:i high10:i any5:i run_in:i",
    f"""{BARS}, a AS (SELECT *, row_number() {BY} AS bar, {mean_sql('close', 20)} AS ma20 FROM bars),
    f AS (SELECT *, coalesce(close > ma20, false) AS ab, coalesce(close < low * 1.001, false) AS lo FROM a),
    h AS (SELECT *, list(CASE WHEN ab THEN 1 ELSE 0 END) {over(20)} AS h FROM f),
    final AS (SELECT code, d, bar > 10 AND close = min(close) {over(11)} AS low10, bar > 10 AND close = max(close) {over(11)} AS high10,
              max(CASE WHEN ab THEN 1 ELSE 0 END) {over(5)} AS any5,
              contains(array_to_string(h, ''), '11111') AS run_in FROM h)""",
)
def extrema_and_recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive_bars(spark, sf_dir).withColumn("ma20", w.mean("close", 20))
    rows = rows.withColumn("ab", F.coalesce(F.col("close") > F.col("ma20"), F.lit(False)))
    return rows.withColumns({"low10": w.is_low("close", 10), "high10": w.is_high("close", 10), "any5": w.any_in("ab", 5), "run_in": w.run_in_window("ab", 20, 5)})


@query(
    "code:s d:d rv20:f med:f q20:f",
    f"""{BARS}, l AS (SELECT *, ln(close) - lag(ln(close)) {BY} AS r FROM bars),
    v AS (SELECT *, CASE WHEN count(r) {over(20)} >= 20 THEN stddev_pop(r) {over(20)} * sqrt(252) END AS rv20 FROM l),
    final AS (SELECT code, d, rv20,
      CASE WHEN count(rv20) OVER p120 >= 60 THEN quantile_cont(rv20, 0.5) OVER p120 END AS med,
      CASE WHEN count(rv20) OVER p20 = 20 THEN quantile_cont(rv20, 0.2) OVER p20 END AS q20 FROM v
      WINDOW p120 AS (PARTITION BY code ORDER BY d ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING),
             p20 AS (PARTITION BY code ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
)
def lagged_volatility_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.benchmark_features(derive_bars(spark, sf_dir))
    past = w.rows_before(20)
    return rows.withColumns({"med": F.col("rv_median"), "q20": F.when(F.count("rv20").over(past) == 20, F.percentile("rv20", 0.2).over(past))})


@query(
    "code:s d:d ret_mean:f ret_excess:f pct:f",
    f"""{NATION}, r AS (SELECT *, {ratio_sql('close', 1)} AS ret FROM bars), k AS (SELECT * FROM r WHERE ret IS NOT NULL),
    final AS (SELECT code, d, avg(ret) OVER (PARTITION BY d) AS ret_mean, ret - avg(ret) OVER (PARTITION BY d) AS ret_excess,
      (rank() OVER (PARTITION BY d ORDER BY ret) + (count(*) OVER (PARTITION BY d, ret) - 1) / 2) / count(*) OVER (PARTITION BY d) AS pct FROM k)""",
)
def cross_section_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive_bars(spark, sf_dir, "nation").withColumn("ret", w.lag_ratio("close", 1)).where("ret is not null")
    return features.cross_section(rows, "ret").withColumn("pct", w.average_rank(["d"], "ret"))


@query(
    "code:s d:d equity:f dd:f",
    f"""{BARS}, r AS (SELECT *, coalesce({ratio_sql('close', 1)}, 0.0) AS ret FROM bars),
    e AS (SELECT *, exp(sum(ln(1 + ret)) {SO_FAR}) AS equity FROM r),
    final AS (SELECT code, d, equity, equity / max(equity) {SO_FAR} - 1 AS dd FROM e)""",
)
def equity_and_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive_bars(spark, sf_dir).withColumn("ret", F.coalesce(w.lag_ratio("close", 1), F.lit(0.0)))
    rows = rows.withColumn("equity", w.compounded("ret"))
    return rows.withColumn("dd", w.drawdown("equity"))


@query(
    "code:s d:d close:f n:i",
    f"{BARS}, b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS n FROM bars), final AS (SELECT * FROM b WHERE n <= 5)",
)
def last_five_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d")))
    return derive_bars(spark, sf_dir).withColumn("n", n).where("n <= 5")


@query(
    "code:s d:d close:f volume:f",
    f"""{NATION}, own AS (SELECT code, min(d) AS a, max(d) AS b FROM bars GROUP BY code),
    span AS (SELECT min(d) AS a, max(d) AS b FROM bars),
    days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
    grid AS (SELECT code, d FROM own JOIN days ON d BETWEEN own.a AND own.b WHERE isodow(d) <= 5),
    j AS (SELECT g.code, g.d, x.close AS c, x.volume FROM grid g LEFT JOIN bars x ON g.code = x.code AND g.d = x.d),
    final AS (SELECT code, d, last_value(c IGNORE NULLS) {SO_FAR} AS close, volume FROM j)""",
)
def calendar_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derive_bars(spark, sf_dir, "nation")
    return on_calendar(bars, business_days(bars))


# Prices with planted splits: every close of the later half of a code is scaled down.
RAW_SQL = f"""{BARS}, m AS (SELECT *, row_number() {BY} AS bar, hash_no FROM bars JOIN (SELECT code AS c, CAST(substr(code, 2) AS INT) AS hash_no FROM (SELECT DISTINCT code FROM bars)) ON code = c),
    raw AS (SELECT code, d, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume FROM (
      SELECT *, CASE WHEN bar > 400 + 50 * hash_no THEN 0.2 WHEN bar > 300 THEN 1.0 / 3 ELSE 1.0 END AS f FROM m))"""
STEP_SQL = f"""{RAW_SQL}, pv AS (SELECT *, last_value(CASE WHEN close > 0 THEN close END IGNORE NULLS) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_close FROM raw),
    rt AS (SELECT *, close / prev_close AS ratio, open / prev_close AS oratio FROM pv),
    ratios(r) AS (VALUES (0.1), (0.2), (0.25), (1.0 / 3), (0.5), (2.0), (3.0), (4.0), (5.0), (10.0)),
    sn AS (SELECT code, d, min_by(CAST(r AS DOUBLE), abs(oratio / r - 1)) FILTER (WHERE abs(oratio / r - 1) <= 0.05) AS so,
           min_by(CAST(r AS DOUBLE), abs(ratio / r - 1)) FILTER (WHERE abs(ratio / r - 1) <= 0.05) AS sc FROM rt, ratios WHERE abs(ratio - 1) > 0.25 GROUP BY code, d),
    st AS (SELECT rt.*, coalesce(so, sc) AS snapped, CASE WHEN abs(ratio - 1) > 0.25 THEN coalesce(so, sc, ratio) ELSE 1.0 END AS step FROM rt LEFT JOIN sn USING (code, d)),
    fc AS (SELECT *, exp(coalesce(sum(ln(step)) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS factor FROM st)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derive_bars(spark, sf_dir).withColumn("bar", w.bar_no())
    no = F.substring("code", 2, 9).cast("int")
    f = F.when(F.col("bar") > 400 + 50 * no, 0.2).when(F.col("bar") > 300, 1.0 / 3).otherwise(1.0)
    return rows.withColumns({c: F.col(c) * f for c in ("open", "high", "low", "close")}).drop("bar")


@query(
    "code:s d:d open:f high:f low:f close:f volume:f",
    f"{STEP_SQL}, final AS (SELECT code, d, open * factor AS open, high * factor AS high, low * factor AS low, close * factor AS close, volume FROM fc)",
)
def split_adjusted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.adjust(_raw(spark, sf_dir))


@query(
    "code:s d:d ratio:f step:f is_snapped:i factor:f",
    f"{STEP_SQL}, final AS (SELECT *, snapped IS NOT NULL AS is_snapped FROM fc WHERE step <> 1)",
)
def split_jump_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.split_records(_raw(spark, sf_dir))


@query(
    "code:s n_splits:i n_jumps:i recent_jump:i flags:s",
    f"""{STEP_SQL}, j AS (SELECT *, step <> 1 AS sp, coalesce(step = 1 AND abs(ln(ratio)) > 0.08, false) AS ju,
      row_number() OVER (PARTITION BY code ORDER BY d DESC) AS back FROM fc),
    g AS (SELECT code, sum(CASE WHEN sp THEN 1 ELSE 0 END) AS n_splits, sum(CASE WHEN ju THEN 1 ELSE 0 END) AS n_jumps,
      max(CASE WHEN ju AND back <= 20 THEN 1 ELSE 0 END) AS recent_jump FROM j GROUP BY code),
    final AS (SELECT *, concat_ws('|', CASE WHEN n_splits > 0 THEN 'corp_split' END, CASE WHEN recent_jump > 0 THEN 'recent_jump' END,
      CASE WHEN n_jumps > 0 THEN 'jump_day_hist' END) AS flags FROM g)""",
)
def price_jump_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.jump_flags(_raw(spark, sf_dir))


@query("code:s n:i mean_r:f sd_r:f", f"{STEP_SQL}, final AS (SELECT code, count(*) AS n, avg(ln(ratio)) AS mean_r, stddev_samp(ln(ratio)) AS sd_r FROM fc WHERE step = 1 AND ratio IS NOT NULL GROUP BY code)")
def returns_without_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prices.plain_returns(_raw(spark, sf_dir))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r"))


@query(
    "code:s n:i ols_growth:f cagr:f",
    f"""{BARS}, l AS (SELECT code, ln(close) AS y, row_number() {BY} AS x FROM bars),
    final AS (SELECT code, count(*) AS n, exp(252 * regr_slope(y, x)) - 1 AS ols_growth,
      exp(252 * (max_by(y, x) - min_by(y, x)) / nullif(max(x) - min(x), 0)) - 1 AS cagr FROM l GROUP BY code)""",
)
def whole_period_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.full_fit(derive_bars(spark, sf_dir))


@query(
    "code:s d:d need:f period_need:f need_gap:f",
    f"""{VOL}, anchor AS (SELECT d, avg(rv) AS anchor_rv FROM states GROUP BY d),
    nd AS (SELECT s.*, CASE WHEN anchor_rv > 0 THEN 0.05 * rv / anchor_rv END AS need, {ratio_sql('close', 20)} AS got FROM states s LEFT JOIN anchor USING (d)),
    final AS (SELECT code, d, need, pow(1 + need, 20.0 / 252) - 1 AS period_need, got - (pow(1 + need, 20.0 / 252) - 1) AS need_gap FROM nd)""",
)
def fair_need_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.vol_regime(derive_bars(spark, sf_dir))
    return features.fair_need(rows, features.daily_anchor(rows))


@query("code:s d:d open:f close:f ex_div:i", f"{BARS}, g AS (SELECT *, open / lag(close) {BY} - 1 AS gap FROM bars), final AS (SELECT *, coalesce(gap BETWEEN -0.12 AND -0.005 AND close > open, false) AS ex_div FROM g)")
def ex_dividend_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.ex_dividend(derive_bars(spark, sf_dir))
