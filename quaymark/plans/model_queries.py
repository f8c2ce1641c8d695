"""Queries over labels, probabilities, tails, clusters and recursive filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.functions.lineage import cut_lineage
from quaymark.operators import cluster, features, labels, machines, pool, regimes
from quaymark.plans.shape import BY, bars_sql, fold_sql, mean_sql, over, panels_sql, query, ratio_sql
from quaymark.sources.bars import derive_bars

BARS = bars_sql()
NATION = bars_sql("nation")

SIG = f"""{BARS}, l AS (SELECT *, ln(close) - lag(ln(close)) {BY} AS r FROM bars),
    sg AS (SELECT *, CASE WHEN count(r) {over(20)} >= 18 THEN stddev_samp(r) {over(20)} END AS sigma FROM l)"""
TREND = f"""{SIG}, fw AS (SELECT *, ln(lead(close, 10) {BY} / close) AS tot, sum(abs(r)) OVER a AS len, ln(min(close) OVER a / close) AS worst FROM sg
      WINDOW a AS (PARTITION BY code ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
    tl AS (SELECT *, CASE WHEN tot IS NOT NULL AND sigma IS NOT NULL THEN coalesce(tot >= 0.35 * sigma * sqrt(10) AND abs(tot) / nullif(len, 0) >= 0.28
      AND worst >= -sigma * sqrt(10), false) END AS label_up FROM fw)"""


@query("code:s d:d sigma:f label_up:i", f"{TREND}, final AS (SELECT * FROM tl)")
def trend_up_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.trend_label(derive_bars(spark, sf_dir))


@query(
    "code:s d:d prior:f jump:f post:f label_rev:i bias:s",
    f"""{SIG}, m AS (SELECT *, ln(lag(close) {BY} / lag(close, 11) {BY}) AS prior, ln(close / lag(close) {BY}) AS jump, ln(lead(close, 10) {BY} / close) AS post FROM sg),
    final AS (SELECT *, CASE WHEN prior IS NOT NULL AND post IS NOT NULL AND sigma IS NOT NULL THEN coalesce(abs(prior) >= 0.35 * sigma * sqrt(10) AND abs(post) >= 0.35 * sigma * sqrt(10)
      AND sign(prior) * sign(post) < 0 AND sign(jump) = sign(post), false) END AS label_rev, CASE WHEN prior < 0 THEN 'buy' WHEN prior > 0 THEN 'sell' END AS bias FROM m)""",
)
def reversal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.reversal_label(derive_bars(spark, sf_dir))


@query(
    "code:s d:d eligible:i",
    f"""{NATION}, mem AS (SELECT 'N' || n_nationkey AS code, DATE '1995-01-01' + CAST(90 * n_regionkey AS INT) AS list_date, CASE WHEN n_nationkey % 3 = 0 THEN DATE '2000-06-30' END AS end_date FROM nation),
    final AS (SELECT b.code, b.d, coalesce(list_date <= d AND (end_date IS NULL OR d <= end_date) AND count(close) OVER (PARTITION BY b.code ORDER BY d) >= 252
      AND count(close) OVER (PARTITION BY b.code ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 18, false) AS eligible FROM bars b LEFT JOIN mem ON b.code = mem.code)""",
)
def point_in_time_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    members = nations.select(
        F.concat(F.lit("N"), "n_nationkey").alias("code"),
        F.date_add(F.lit("1995-01-01").cast("date"), (90 * F.col("n_regionkey")).cast("int")).alias("list_date"),
        F.when(F.col("n_nationkey") % 3 == 0, F.lit("2000-06-30").cast("date")).alias("end_date"),
    )
    return labels.eligible(derive_bars(spark, sf_dir, "nation"), members)


PROB = f"""{TREND}, pr AS (SELECT *, (close - min(close) {over(60)}) / nullif(max(close) {over(60)} - min(close) {over(60)}, 0) AS p FROM tl)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels.trend_label(derive_bars(spark, sf_dir))
    span = w.highest("close", 60) - w.lowest("close", 60)
    return rows.withColumn("p", (F.col("close") - w.lowest("close", 60)) / F.nullif(span, F.lit(0.0)))


@query(
    "n:i brier:f ece:f",
    f"""{PROB}, k AS (SELECT p, CAST(label_up AS DOUBLE) AS y FROM pr WHERE p IS NOT NULL AND label_up IS NOT NULL),
    b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum((p - y) * (p - y)) AS se FROM k GROUP BY 1),
    final AS (SELECT sum(n) AS n, sum(se) / sum(n) AS brier, sum(abs(mp - my) * n) / sum(n) AS ece FROM b)""",
)
def probability_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.calibration(_scored(spark, sf_dir), "p", "label_up")


@query(
    "code:s n:i mean:f sd:f ks:f cvm:f",
    f"""{PROB}, k AS (SELECT code, p AS u, row_number() OVER (PARTITION BY code ORDER BY p) AS i, count(*) OVER (PARTITION BY code) AS n FROM pr WHERE p IS NOT NULL),
    final AS (SELECT code, max(n) AS n, avg(u) AS mean, stddev_samp(u) AS sd, max(greatest(i / n - u, u - (i - 1) / n)) AS ks,
      1.0 / (12 * max(n)) + sum(pow(u - (2 * i - 1) / (2 * n), 2)) AS cvm FROM k GROUP BY code)""",
)
def pit_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.uniformity(_scored(spark, sf_dir), "p")


@query(
    "code:s le_05:f le_10:f le_90:f le_95:f tails:f",
    f"""{PROB}, final AS (SELECT code, avg(CASE WHEN p <= 0.05 THEN 1.0 ELSE 0 END) AS le_05, avg(CASE WHEN p <= 0.1 THEN 1.0 ELSE 0 END) AS le_10,
      avg(CASE WHEN p <= 0.9 THEN 1.0 ELSE 0 END) AS le_90, avg(CASE WHEN p <= 0.95 THEN 1.0 ELSE 0 END) AS le_95,
      avg(CASE WHEN p <= 0.1 OR p >= 0.9 THEN 1.0 ELSE 0 END) AS tails FROM pr WHERE p IS NOT NULL GROUP BY code)""",
)
def pit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.quantile_coverage(_scored(spark, sf_dir), "p")


GRID = [0.5, 0.6, 0.7, 0.8, 0.9]


@query(
    "q:f alerts:i precision:f recall:f f1:f",
    f"""{PROB}, g(q) AS (VALUES {', '.join(f'({q}::DOUBLE)' for q in GRID)}),
    a AS (SELECT q, sum(CASE WHEN p >= q THEN 1 ELSE 0 END) AS alerts, sum(CASE WHEN p >= q AND label_up THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label_up THEN 1 ELSE 0 END) AS pos
      FROM pr, g WHERE p IS NOT NULL AND label_up IS NOT NULL GROUP BY q),
    final AS (SELECT q, alerts, tp / nullif(alerts, 0) AS precision, tp / nullif(pos, 0) AS recall, 2 * tp / nullif(alerts + pos, 0) AS f1 FROM a)""",
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.threshold_grid(_scored(spark, sf_dir), "p", "label_up", GRID)


@query(
    "code:s d:d level:s",
    f"""{PROB}, m AS (SELECT *, 12 * (year(d) - 1995) + month(d) - 1 AS months FROM pr),
    final AS (SELECT code, d, CASE WHEN p IS NULL THEN 'NONE' WHEN p >= 0.9 AND months >= 6 THEN 'CONFIRM' WHEN p >= 0.7 THEN 'OBSERVE' WHEN p <= 0.1 THEN 'REJECT' ELSE 'NONE' END AS level FROM m)""",
)
def signal_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("months", 12 * (F.year("d") - 1995) + F.month("d") - 1)
    return labels.ladder(rows, "p", 0.7, 0.9, 0.1, "months")


@query(
    "code:s n:i alpha:f",
    f"""{SIG}, ls AS (SELECT code, -r AS x FROM sg WHERE r < 0), u AS (SELECT code, quantile_cont(x, 0.925) AS u FROM ls GROUP BY code),
    final AS (SELECT code, count(*) AS n, 1 / avg(ln(x / u)) AS alpha FROM ls JOIN u USING (code) WHERE x > u GROUP BY code)""",
)
def hill_tail_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.hill(labels.sigma20(derive_bars(spark, sf_dir)))


CORR = f"""{NATION}, rt AS (SELECT code, d, {ratio_sql('close', 1)} AS r FROM bars), rr AS (SELECT * FROM rt WHERE r IS NOT NULL),
    pc AS (SELECT a.code AS code_a, b.code AS code_b, count(*) AS n_overlap, corr(a.r, b.r) AS c FROM rr a JOIN rr b ON a.d = b.d AND a.code < b.code GROUP BY 1, 2),
    pairs AS (SELECT code_a, code_b, n_overlap, CASE WHEN n_overlap >= 120 AND c IS NOT NULL AND NOT isnan(c) THEN greatest(least(c, 1.0), -1.0) ELSE 0.05 END AS corr FROM pc)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.pair_correlation(cluster.returns(derive_bars(spark, sf_dir, "nation")))


@query("code_a:s code_b:s n_overlap:i corr:f", f"{CORR}, final AS (SELECT * FROM pairs)")
def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query("code:s cluster:i")
def ward_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.ward_clusters(_pairs(spark, sf_dir), 1.0)


MEM = "mem AS (SELECT DISTINCT code, CAST(n_regionkey AS INT) AS cluster FROM bars JOIN nation ON code = 'N' || n_nationkey)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_regionkey").alias("cluster"))
    return derive_bars(spark, sf_dir, "nation").select("code").distinct().join(nations, "code")


@query(
    "cluster:i medoid:s mean_corr:f",
    f"""{CORR}, {MEM}, bo AS (SELECT code_a AS a, code_b AS b, corr FROM pairs UNION ALL SELECT code_b, code_a, corr FROM pairs),
    m AS (SELECT x.cluster, a AS code, round(avg(corr), 9) AS m FROM bo JOIN mem x ON a = x.code JOIN mem y ON b = y.code AND x.cluster = y.cluster GROUP BY 1, 2),
    al AS (SELECT * FROM m UNION ALL SELECT cluster, code, 1.0 FROM mem WHERE code NOT IN (SELECT code FROM m)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY m DESC, code) AS n FROM al),
    final AS (SELECT cluster, code AS medoid, m AS mean_corr FROM rk WHERE n = 1)""",
)
def cluster_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.medoids(_pairs(spark, sf_dir), _members(spark, sf_dir))


@query(
    "code:s sharpe:f momentum:f score:f",
    f"""{NATION}, b AS (SELECT *, {ratio_sql('close', 1)} AS r, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS back FROM bars), k AS (SELECT * FROM b WHERE back <= 252),
    f AS (SELECT code, avg(r) / nullif(stddev_pop(r), 0) * sqrt(252) AS sharpe, max(CASE WHEN back = 22 THEN close END) / max(CASE WHEN back = 252 THEN close END) - 1 AS momentum FROM k GROUP BY code),
    final AS (SELECT *, 0.5 * (rank() OVER (ORDER BY sharpe NULLS FIRST) + (count(*) OVER (PARTITION BY sharpe) - 1) / 2) / count(sharpe) OVER ()
      + 0.5 * (rank() OVER (ORDER BY momentum NULLS FIRST) + (count(*) OVER (PARTITION BY momentum) - 1) / 2) / count(momentum) OVER () AS score FROM f)""",
)
def return_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.return_score(derive_bars(spark, sf_dir, "nation"))


@query("code:s rank:i")
def clone_trimmed_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derive_bars(spark, sf_dir, "nation")
    return cluster.trim_clones(_pairs(spark, sf_dir), cluster.return_score(bars).select("code", F.coalesce("score", F.lit(0.0)).alias("score")), 0.1)


@query(
    "code:s change:s",
    f"""{NATION}, y AS (SELECT code, year(d) AS y, max_by(close, d) / min_by(close, d) - 1 AS r FROM bars GROUP BY 1, 2),
    t AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY r DESC, code) AS n FROM y), o AS (SELECT code FROM t WHERE y = 1998 AND n <= 5), nw AS (SELECT code FROM t WHERE y = 1999 AND n <= 5),
    final AS (SELECT coalesce(o.code, nw.code) AS code, CASE WHEN o.code IS NULL THEN 'added' WHEN nw.code IS NULL THEN 'removed' ELSE 'kept' END AS change FROM o FULL JOIN nw ON o.code = nw.code)""",
)
def pool_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derive_bars(spark, sf_dir, "nation")
    yearly = bars.groupBy("code", F.year("d").alias("y")).agg((F.max_by("close", "d") / F.min_by("close", "d") - 1).alias("r"))
    n = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("r"), "code"))
    top = yearly.withColumn("n", n).where("n <= 5")
    return cluster.compare_pools(top.where("y = 1998"), top.where("y = 1999"))


VAR_NOW = "CASE WHEN s.v IS NULL THEN CASE WHEN s.last > 0 THEN s.last END ELSE 0.94 * s.v + 0.06 * s.last END"
EWMA = fold_sql(
    "ew", "feat", "fig9_gap AS g, fig9_path AS mid", {"v": "CAST(NULL AS DOUBLE)", "last": "x.g * x.g"},
    {"v": VAR_NOW, "last": "coalesce(x.g * x.g, s.last)"},
)


@query(
    "code:s d:d sigma:f lower:f upper:f",
    f"""{BARS}, {panels_sql(['fig9'])}, {EWMA}, z AS (SELECT *, sqrt(v) AS sigma, abs(g / CASE WHEN v > 0 THEN sqrt(v) END) AS z FROM ew),
    q AS (SELECT *, CASE WHEN z IS NOT NULL AND count(z) OVER o >= 63 THEN quantile_cont(z, 0.95) OVER o * sigma END AS wd FROM z WINDOW o AS (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING)),
    final AS (SELECT code, d, sigma, mid * exp(-wd) AS lower, mid * exp(wd) AS upper FROM q)""",
)
def ewma_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.rails(features.fair_path(features.with_logs(derive_bars(spark, sf_dir)), ["fig9"]), ["fig9"])
    return machines.ewma_rails(rows.select("code", "d", "fig9_gap", "fig9_path"), "fig9_gap", "fig9_path")


# Predicted level and covariance, then the update by the observed log close.
P00, P01, P11, LEVEL = "(s.p00 + 2 * s.p01 + s.p11 + x.q1)", "(s.p01 + s.p11)", "(s.p11 + x.q2)", "(s.level + s.slope)"
K0, K1, MISS = f"({P00} / ({P00} + x.rn))", f"({P01} / ({P00} + x.rn))", f"(x.y - {LEVEL})"
KALMAN = fold_sql(
    "kf", "kn", "y, rn, q1, q2", {"level": "x.y", "slope": "CAST(0 AS DOUBLE)", "p00": "CAST(1 AS DOUBLE)", "p01": "CAST(0 AS DOUBLE)", "p11": "CAST(1 AS DOUBLE)"},
    {"level": f"{LEVEL} + {K0} * {MISS}", "slope": f"s.slope + {K1} * {MISS}", "p00": f"{P00} * (1 - {K0})", "p01": f"{P01} * (1 - {K0})", "p11": f"{P11} - {K1} * {P01}"},
)


@query(
    "code:s d:d path:f drift:f forecast:f",
    f"""{BARS}, ky AS (SELECT code, d, ln(close) AS y, ln(close) - lag(ln(close)) {BY} AS u, row_number() {BY} AS b FROM bars),
    ks AS (SELECT *, u - avg(u) OVER (PARTITION BY code) AS c, u - lag(u) {BY} AS du FROM ky WHERE b BETWEEN 2 AND 505),
    kc AS (SELECT *, c * lag(c) {BY} AS cc FROM ks),
    kv AS (SELECT code, count(*) AS n, greatest(-avg(cc), 1e-10) AS rn, var_pop(u) AS vu, var_pop(du) AS vd FROM kc GROUP BY code),
    kq AS (SELECT *, greatest(vu - 2 * rn, 1e-10) AS q1 FROM kv),
    kn AS (SELECT y.code, y.d, y.y, CASE WHEN n >= 20 THEN rn ELSE 1e-4 END AS rn, CASE WHEN n >= 20 THEN q1 ELSE 1e-5 END AS q1,
      CASE WHEN n >= 20 THEN greatest(vd - 2 * q1 - 6 * rn, 1e-12) ELSE 1e-8 END AS q2 FROM ky y JOIN kq USING (code)),
    {KALMAN}, final AS (SELECT code, d, exp(level) AS path, exp(252 * slope) - 1 AS drift, exp(level + slope) AS forecast FROM kf)""",
)
def kalman_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machines.kalman_trend(derive_bars(spark, sf_dir).select("code", "d", "close"))


@query(
    "code:s bar:i onset:i delay:i kind:s",
    f"""{PROB}, nb AS (SELECT *, row_number() {BY} AS bar FROM pr), lu AS (SELECT code, bar, bar - lag(bar) OVER (PARTITION BY code ORDER BY bar) AS gap FROM nb WHERE label_up),
    ev AS (SELECT code, bar AS onset FROM lu WHERE gap IS NULL OR gap > 5), al AS (SELECT code, bar, p AS score FROM nb WHERE p >= 0.9),
    nr AS (SELECT al.code, al.bar, al.score, min(onset) AS onset FROM al LEFT JOIN ev ON al.code = ev.code AND al.bar BETWEEN onset - 3 AND onset + 10 GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY code, onset ORDER BY abs(bar - onset), bar, -score) AS n FROM nr),
    final AS (SELECT code, bar, CASE WHEN n = 1 THEN onset END AS onset, CASE WHEN n = 1 THEN bar - onset END AS delay, CASE WHEN onset IS NULL THEN 'false_alarm' WHEN n = 1 THEN 'match' ELSE 'duplicate' END AS kind FROM rk)""",
)
def alert_event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once: sums of prices come out of another run with other last bits, and both sides must see the same rows.
    rows = cut_lineage(_scored(spark, sf_dir).withColumn("bar", w.bar_no()).select("code", "d", "bar", "label_up", "p"))
    events = rows.where("label_up").withColumn("gap", F.col("bar") - F.lag("bar").over(w.by_code())).where("gap is null or gap > 5").select(F.col("code").alias("code"), F.col("bar").alias("bar"))
    alerts = rows.where("p >= 0.9").select(F.col("code").alias("code"), F.col("bar").alias("bar"), F.col("p").alias("score"))
    return labels.event_matches(events, alerts)


TIERS = f"""{BARS}, l AS (SELECT *, ln(close) - lag(ln(close)) {BY} AS r, {mean_sql('close', 20)} AS ma20, {mean_sql('close', 60)} AS ma60, close / max(close) {over(60)} - 1 AS dd60 FROM bars),
    v AS (SELECT *, CASE WHEN count(r) {over(20)} >= 20 THEN stddev_pop(r) {over(20)} * sqrt(252) END AS rv20 FROM l),
    m AS (SELECT *, CASE WHEN count(rv20) OVER p >= 60 THEN quantile_cont(rv20, 0.5) OVER p END AS med FROM v WINDOW p AS (PARTITION BY code ORDER BY d ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, CASE WHEN close < ma60 AND ma20 < ma60 THEN 1 ELSE 0 END AS wk, CASE WHEN rv20 > 1.25 * med THEN 1 ELSE 0 END AS ro, CASE WHEN dd60 <= -0.1 THEN 1 ELSE 0 END AS dp FROM m),
    bt AS (SELECT code, d, dp, CASE WHEN wk + ro + dp >= 2 THEN 'stress' WHEN wk = 1 OR dp = 1 THEN 'defensive' WHEN ro = 1 THEN 'cautious' ELSE 'normal' END AS tier,
      CASE WHEN wk + ro + dp >= 2 THEN CASE WHEN dp = 1 THEN 0.5 ELSE 0.65 END WHEN wk = 1 OR dp = 1 THEN 0.82 WHEN ro = 1 THEN 0.92 ELSE 1.0 END AS budget FROM f)"""


@query("code:s d:d tier:s budget:f", f"{TIERS}, final AS (SELECT * FROM bt)")
def benchmark_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.budget(features.benchmark_features(derive_bars(spark, sf_dir)))


RANK = "list_position(['normal', 'cautious', 'defensive', 'stress'], {})"
STEP = f"({RANK.format('x.tier')} - {RANK.format('s.confirmed')})"
DOWN, UP = f"(CASE WHEN {STEP} > 0 THEN s.dn + 1 ELSE 0 END)", f"(CASE WHEN {STEP} < 0 AND s.kept = 0 THEN s.ups + 1 ELSE 0 END)"
FELL, ROSE = f"({DOWN} >= 3)", f"({UP} >= CASE WHEN {RANK.format('s.confirmed')} >= 3 THEN 2 ELSE 1 END)"
TIER_FOLD = fold_sql(
    "tf", "bt", "tier, dp", {"confirmed": "x.tier", "dn": "0", "ups": "0", "kept": "0"},
    {"confirmed": f"CASE WHEN {FELL} OR {ROSE} THEN x.tier ELSE s.confirmed END", "dn": f"CASE WHEN {FELL} THEN 0 ELSE {DOWN} END", "ups": f"CASE WHEN {ROSE} THEN 0 ELSE {UP} END",
     "kept": f"greatest(CASE WHEN {FELL} AND x.tier = 'stress' THEN 3 ELSE s.kept END - 1, 0)"},
)


@query(
    "code:s d:d tier:s confirmed:s budget:f",
    f"""{TIERS}, {TIER_FOLD}, final AS (SELECT code, d, tier, confirmed, CASE WHEN confirmed = 'stress' AND dp = 1 THEN 0.5 ELSE [1.0, 0.92, 0.82, 0.65][{RANK.format('confirmed')}] END AS budget FROM tf)""",
)
def confirmed_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.confirmed_budget(features.benchmark_features(derive_bars(spark, sf_dir)))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.pair_correlation(cluster.returns(derive_bars(spark, sf_dir, "nation")))


@query("code_a:s code_b:s height:f")
def cluster_merge_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.merge_heights(_pairs(spark, sf_dir))


@query("cluster:i place:i related:i height:f")
def related_cluster_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters without one of the three best codes, and the nearest that have one."""
    pairs = _pairs(spark, sf_dir)
    scores = cluster.return_score(derive_bars(spark, sf_dir, "nation"))
    picked = scores.orderBy(F.desc("score"), "code").limit(3).select("code", F.col("momentum").alias("ret"))
    return cluster.related_clusters(cluster.merge_heights(pairs), cluster.ward_clusters(pairs), picked)


@query("code:s cluster:i seat:i how:s")
def multi_rep_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of eight codes from clusters of nation bars; one code is forced."""
    bars = cut_lineage(derive_bars(spark, sf_dir, "nation"))
    pairs = cut_lineage(cluster.pair_correlation(cluster.returns(bars)))
    enough = bars.groupBy("code").agg((F.count("*") >= 250).alias("enough"))
    scores = cluster.return_score(bars).select("code", F.coalesce("score", F.lit(0.0)).alias("score"))
    members = cluster.ward_clusters(pairs, 0.97).join(scores, "code").join(enough, "code")
    return pool.select_pool(members, pairs, 8, spark.createDataFrame([("N0",)], "code string"))
