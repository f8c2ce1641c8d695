"""Queries over forecasts of returns: baseline scores, moving variance, intervals, expanding fits, hidden states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.functions.lineage import cut_lineage
from quaymark.operators import chance, gates
from quaymark.plans.model_queries import PROB, _scored
from quaymark.plans.shape import BY, bars_sql, fold_sql, query
from quaymark.sources.bars import derive_bars, table
from quaymark.sources.sinks import merge_latest

BARS = bars_sql()
PAST = "OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_bars(spark, sf_dir).withColumn("r", F.log("close") - F.lag(F.log("close")).over(w.by_code()))


@query(
    "code:s d:d mu:f sd:f nll:f pit:f",
    f"""{BARS}, l AS (SELECT *, ln(close) - lag(ln(close)) {BY} AS r FROM bars),
    b AS (SELECT *, CASE WHEN count(r) {PAST} >= 40 THEN avg(r) {PAST} END AS mu, CASE WHEN count(r) {PAST} >= 40 THEN stddev_samp(r) {PAST} END AS sd FROM l),
    z AS (SELECT *, (r - mu) / nullif(sd, 0) AS z, 1 / (1 + 0.3275911 * abs((r - mu) / nullif(sd, 0)) / sqrt(2)) AS t FROM b),
    e AS (SELECT *, 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2) AS u FROM z),
    final AS (SELECT code, d, mu, sd, ln(sd) + 0.5 * ln(2 * pi()) + 0.5 * z * z AS nll, CASE WHEN z >= 0 THEN 0.5 * (1 + u) WHEN z IS NOT NULL THEN 0.5 * (1 - u) END AS pit FROM e)""",
)
def baseline_return_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chance.baseline_scores(_returns(spark, sf_dir), "r")


MOVING = fold_sql(
    "mw", "kr", "r, k, s20, a", {"now": "CAST(NULL AS DOUBLE)"},
    {"now": "CASE WHEN x.k = 20 THEN x.s20 WHEN x.k > 20 THEN 0.94 * s.now + 0.06 * x.r * x.r END"},
)


@query(
    "code:s d:d deviation:f method:s",
    f"""{BARS}, l AS (SELECT code, d, ln(close) - lag(ln(close)) {BY} AS r FROM bars),
    kr AS (SELECT code, d, r, row_number() {BY} AS k, avg(r * r) OVER (PARTITION BY code ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s20, avg(abs(r)) {BY} AS a FROM l WHERE r IS NOT NULL),
    {MOVING}, final AS (SELECT code, d, sqrt(least(greatest(CASE WHEN k >= 60 THEN now WHEN k >= 20 THEN s20 ELSE pow(1.2533 * a, 2) END, 2.5e-5), 2e-2)) AS deviation,
      CASE WHEN k >= 60 THEN 'ewma' WHEN k >= 20 THEN 'rv20' ELSE 'mad' END AS method FROM mw)""",
)
def moving_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chance.moving_variance(_returns(spark, sf_dir), "r").select("code", "d", F.sqrt("var").alias("deviation"), "method")


@query("code:s n:i mean:f low:f high:f")
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _returns(spark, sf_dir).withColumn("month", F.date_format("d", "yyyy-MM"))
    return chance.bootstrap_mean(rows, "code", "month", "r").select("code", "n", (F.col("mean") * 1e4).alias("mean"), (F.col("low") * 1e4).alias("low"), (F.col("high") * 1e4).alias("high"))


@query("rule:s side:s win:s n:i mean:f passed:i winner:s")
def rule_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules on the side of the last moves, over two windows, by whether the next five bars went their way."""
    rows = derive_bars(spark, sf_dir).withColumns({f"p{n}": w.lag_ratio("close", n) for n in (5, 20)} | {"ahead": F.lead("close", 5).over(w.by_code()) / F.col("close") - 1, "month": F.date_format("d", "yyyy-MM")})
    rules = F.array(*[F.struct(F.lit(f"{kind}{n}").alias("rule"), (F.col(f"p{n}") * sign).alias("lean")) for n in (5, 20) for kind, sign in (("with", 1), ("against", -1))])
    each = rows.where("ahead is not null and ahead <> 0").select("month", "ahead", F.explode(rules).alias("x")).where("x.lean is not null and x.lean <> 0")
    side = F.when(F.col("x.lean") > 0, "buy").otherwise("sell")
    win = F.explode(F.array(F.lit("all"), F.when(F.col("month") >= "1999-01", F.lit("late"))))
    found = each.select("month", F.col("x.rule").alias("rule"), side.alias("side"), win.alias("win"), (F.sign("x.lean") == F.sign("ahead")).alias("hit"))
    return chance.promotion_race(found.where("win is not null"))


@query("month:s n:i mean_p:f mean_y:f")
def crossfit_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumns({"month": F.date_format("d", "yyyy-MM"), "p5": w.lag_ratio("close", 5) * 20}).withColumnRenamed("p", "place")
    found = chance.crossfit(rows.where("label_up is not null"), ["place", "p5"], "label_up", "month")
    return found.where("p is not null").groupBy("month").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("label_up").cast("double")).alias("mean_y"))


@query("code:s d:d month:s state:s switch:s")
def monthly_hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chance.monthly_states(_returns(spark, sf_dir).where("d >= '1999-06-01'"), "r")


@query(
    "key:i status:s total:f",
    """b AS (SELECT o_custkey AS key, o_orderstatus AS status, o_totalprice AS total, o_orderkey AS seq FROM orders),
    final AS (SELECT key, status, total FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM b) WHERE n = 1)""",
)
def merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of one table, the latest row of a key wins."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderkey").alias("seq"))
    return merge_latest([rows.where("seq % 3 = 0"), rows.where("seq % 3 <> 0")], ["key"], "seq")



def _crossfitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of an expanding fit with month and label, written once."""
    rows = _scored(spark, sf_dir).withColumns({"month": F.date_format("d", "yyyy-MM"), "p5": w.lag_ratio("close", 5) * 20}).withColumnRenamed("p", "place")
    found = chance.crossfit(rows.where("label_up is not null"), ["place", "p5"], "label_up", "month")
    return cut_lineage(found.where("p is not null").select("code", "d", "month", "p", "label_up"))


@query("year:s n:i mean_p:f mean_cal:f mean_y:f isotonic:i")
def calibrated_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's probabilities through the step function of all years before it."""
    rows = _crossfitted(spark, sf_dir).withColumn("year", F.substring("month", 1, 4))
    years = rows.select(F.col("year").alias("target")).distinct()
    train = rows.join(years, F.col("year") < F.col("target")).withColumn("year", F.col("target")).drop("target")
    found = gates.calibrated(train, rows, "year", "p", "label_up")
    return found.groupBy("year").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("calibrated").alias("mean_cal"), F.avg(F.col("label_up").cast("double")).alias("mean_y"), F.max("isotonic").alias("isotonic"))


DRAWN = f"""sc AS (SELECT round(p, 6) AS thr, strftime(d, '%Y-%m') AS month, CASE WHEN label_up THEN 0 ELSE 1 END AS f FROM pr WHERE p IS NOT NULL AND label_up IS NOT NULL),
    ct AS MATERIALIZED (SELECT thr, month, count(*) AS c, sum(f) AS f FROM sc GROUP BY 1, 2),
    wh0 AS (SELECT thr, sum(c) AS c, sum(f) AS f FROM ct GROUP BY 1), wh1 AS (SELECT thr, sum(c) OVER (ORDER BY thr DESC) AS n, sum(f) OVER (ORDER BY thr DESC) AS fp FROM wh0),
    wh AS MATERIALIZED (SELECT thr, n, fp / n AS share FROM wh1 WHERE n >= 50),
    mo AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT month FROM ct)),
    dr AS (SELECT DISTINCT draw, month FROM (SELECT draw, turn, ('0x' || substr(md5('42:' || draw || ':' || turn), 1, 8))::BIGINT AS h FROM range(200) a(draw), (SELECT unnest(range((SELECT max(k) FROM mo))) AS turn)) JOIN mo ON i = h % k),
    ea AS (SELECT draw, thr, sum(c) AS c, sum(f) AS f FROM (SELECT draw, thr, c, f FROM ct JOIN dr ON dr.month = ct.month UNION ALL SELECT draw, thr, 0, 0 FROM wh, range(200) b(draw)) GROUP BY 1, 2),
    su AS (SELECT draw, thr, sum(c) OVER o AS n, sum(f) OVER o AS fp FROM ea WINDOW o AS (PARTITION BY draw ORDER BY thr DESC)),
    up AS (SELECT thr, quantile_cont(fp / n, 0.95) AS upper FROM su WHERE n > 0 GROUP BY thr), fs AS (SELECT wh.thr, n, share, upper FROM wh JOIN up ON up.thr = wh.thr)"""


@query("thr:e n:i share:f upper:f", f"{PROB}, {DRAWN}, final AS (SELECT * FROM fs)")
def false_share_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.false_shares(_scored(spark, sf_dir).withColumn("month", F.date_format("d", "yyyy-MM")), "p", "label_up", "month")


@query(
    "q_confirm:e n:i reason:s",
    f"""{PROB}, {DRAWN}, final AS (SELECT max(thr) FILTER (WHERE upper <= 0.6) AS q_confirm, coalesce(arg_max(n, thr) FILTER (WHERE upper <= 0.6), 0) AS n,
      CASE WHEN count(*) FILTER (WHERE upper <= 0.6) = 0 THEN 'no_threshold' END AS reason FROM fs)""",
)
def confirm_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.false_threshold(_scored(spark, sf_dir).withColumn("month", F.date_format("d", "yyyy-MM")), "p", "label_up", "month", 0.6)
