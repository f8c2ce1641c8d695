"""Queries over sources, quotes, snapshots and single rules of prices and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions import windows as w
from quaymark.operators import cluster, features, ledger, prices, regimes, signals
from quaymark.plans.shape import BY, bars_sql, over, panels_sql, query
from quaymark.plans.signal_queries import REG, _regimes
from quaymark.sources import bars as source
from quaymark.sources.bars import derive_bars, table
from quaymark.sources.sinks import semi_text

BARS = bars_sql()
NATION = bars_sql("nation")


@query(
    "code:s d:d price:f qty:f",
    """final AS (SELECT upper(trim(' ' || lower(l_returnflag) || ' ')) AS code, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS price, l_quantity AS qty FROM lineitem
    WHERE l_returnflag IN ('R', 'A') AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-12-22' AND DATE '1997-01-31')""",
)
def loaded_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, dates and warm-up days of a table in the form of bars; codes are compared as they are cleaned."""
    raw = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(" "), F.lower("l_returnflag"), F.lit(" ")).alias("code"), F.col("l_shipdate").cast("date").alias("d"),
        *[F.col("l_extendedprice").alias(c) for c in ("open", "high", "low", "close")], F.col("l_quantity").alias("volume"),
    )
    found = source.select_bars(raw, ["r", "A"], "1997-01-01", "1997-01-31", lookback_days=10)
    return found.select("code", "d", F.col("close").alias("price"), F.col("volume").alias("qty"))


@query("code:s n:i", f"{NATION}, final AS (SELECT code, count(*) AS n FROM bars WHERE code NOT IN (SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY code)")
def bars_without_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.concat(F.lit("N"), "n_nationkey").alias("code"))
    return source.without(derive_bars(spark, sf_dir, "nation"), excluded).groupBy("code").agg(F.count("*").alias("n"))


@query(
    "code:s list_date:d end_date:d",
    """l AS (SELECT 'N' || n_nationkey AS code, DATE '1992-01-01' + CAST(n_regionkey AS INT) AS list_date, CASE WHEN n_nationkey % 2 = 0 THEN DATE '1999-01-01' END AS end_date FROM nation),
    final AS (SELECT * FROM l)""",
)
def instrument_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a tab-separated list, some repeated: the first of a code counts."""
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit(" n"), "n_nationkey").alias("code"), F.date_add(F.lit("1992-01-01").cast("date"), F.col("n_regionkey").cast("int")).cast("string").alias("a"),
        F.when(F.col("n_nationkey") % 2 == 0, "1999-01-01").otherwise("").alias("b"), F.col("n_nationkey").alias("key"),
    )
    lines = nations.select(F.concat_ws("\t", "code", "a", "b").alias("value"), (2 * F.col("key")).alias("line")).unionByName(
        nations.where("key % 3 = 0").select(F.concat_ws("\t", "code", F.lit("2005-05-05"), F.lit("")).alias("value"), (2 * F.col("key") + 1).alias("line"))
    )
    return source.parsed_instruments(lines)


@query("key:i name:s", "final AS (SELECT c_custkey AS key, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, c_name) AS name FROM customer)")
def first_present_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("short name"))
    return people.select(F.col("c_custkey").alias("key"), source.first_present(people, ["absent", "short name", "c_name"]).alias("name"))


@query("value:s", "final AS (SELECT p_brand || chr(9) || p_partkey AS value FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey <= 5))")
def kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    lines = parts.select(F.concat_ws("\t", "p_brand", F.col("p_partkey").cast("string")).alias("value"))
    return semi_text(lines, parts.where("p_partkey <= 5").select(F.upper("p_brand").alias("code")))


QUOTES = f"""{BARS}, q0 AS (SELECT code, d, close AS raw, lag(close) {BY} AS prev0, row_number() {BY} AS i FROM bars),
    q AS (SELECT code, d, CASE WHEN i % 11 = 0 THEN 0 WHEN i % 13 = 0 THEN raw * 2 ELSE raw END AS raw, CASE WHEN i % 7 = 0 THEN -1 ELSE prev0 END AS prev,
      CASE WHEN i % 3 = 0 THEN prev0 / 2 WHEN i % 3 = 1 THEN 0 END AS pre_close, CASE WHEN i % 2 = 0 THEN 1.5 END AS pct FROM q0)"""


@query(
    "code:s d:d factor:f reason:s",
    f"""{QUOTES}, final AS (SELECT code, d, CASE WHEN coalesce(prev <= 0, true) OR raw <= 0 THEN 1 WHEN pre_close > 0 THEN prev / pre_close WHEN pct IS NOT NULL THEN prev * (1 + pct / 100) / raw ELSE 1 END AS factor,
      CASE WHEN coalesce(prev <= 0, true) OR raw <= 0 THEN 'no_qlib_prev' WHEN pre_close > 0 THEN 'pre_close' WHEN pct IS NOT NULL THEN 'pct_chg' WHEN abs(raw / prev - 1) > 0.25 THEN 'cliff_unaligned' ELSE 'same_scale' END AS reason FROM q)""",
)
def quote_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, raw = F.col("i"), F.col("close")
    rows = derive_bars(spark, sf_dir).withColumns({"i": w.bar_no(), "prev0": F.lag("close").over(w.by_code())})
    rows = rows.withColumns(
        {
            "raw": F.when(i % 11 == 0, 0.0).when(i % 13 == 0, raw * 2).otherwise(raw), "prev": F.when(i % 7 == 0, -1.0).otherwise(F.col("prev0")),
            "pre_close": F.when(i % 3 == 0, F.col("prev0") / 2).when(i % 3 == 1, 0.0), "pct": F.when(i % 2 == 0, 1.5),
        }
    )
    return rows.select("code", "d", prices.quote_factor("raw", "prev", "pre_close", "pct").alias("q")).select("code", "d", "q.*")


LAST = f"""{NATION}, ld AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY d DESC) AS back FROM bars)"""


@query(
    "check_name:s ok:i value:f",
    f"""{LAST}, s AS (SELECT * FROM ld WHERE back = 1 AND code <> 'N3'),
    f AS (SELECT count(DISTINCT d) AS days, sum(CASE WHEN low > 0 AND open > 0 AND high > 0 AND close > 0 THEN 0 ELSE 1 END) AS bad, count(DISTINCT code) / (SELECT count(DISTINCT code) FROM bars) AS share FROM s),
    final AS (SELECT 'single_date' AS check_name, days = 1 AS ok, CAST(days AS DOUBLE) AS value FROM f UNION ALL SELECT 'positive_prices', bad = 0, bad FROM f UNION ALL SELECT 'coverage', share >= 0.95, share FROM f)""",
)
def snapshot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derive_bars(spark, sf_dir, "nation")
    newest = signals.pick_per_group(bars, "code", F.desc("d")).where("code <> 'N3'")
    return prices.snapshot_problems(newest, bars).withColumnRenamed("check", "check_name")


@query(
    "code:s n_common:i max_rel_diff:f ok:i",
    f"""{NATION}, nw AS (SELECT code, d, CASE WHEN code = 'N1' THEN close * 1.01 ELSE close END AS c2 FROM bars WHERE year(d) = 1999 AND (code <> 'N2' OR month(d) = 13)),
    final AS (SELECT b.code, count(*) AS n_common, max(abs(c2 / close - 1)) AS max_rel_diff, count(*) >= 5 AND max(abs(c2 / close - 1)) <= 1e-4 AS ok FROM bars b JOIN nw USING (code, d) GROUP BY b.code)""",
)
def overlap_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = derive_bars(spark, sf_dir, "nation")
    moved = bars.withColumn("close", F.when(F.col("code") == "N1", F.col("close") * 1.01).otherwise(F.col("close")))
    return prices.overlap_check(bars, moved.where("year(d) = 1999 and code <> 'N2'"))


@query("code:s last_d:d", f"{NATION}, final AS (SELECT code, max(d) AS last_d FROM bars GROUP BY code HAVING max(d) < DATE '2001-11-01')")
def stale_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.stale(derive_bars(spark, sf_dir, "nation"), "2001-11-01")


@query("code:s d:d close:f next_close:f", f"{BARS}, final AS (SELECT code, d, close, lead(close) {BY} AS next_close FROM bars)")
def next_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.with_next_close(derive_bars(spark, sf_dir))


@query(
    "code:s d:d path_rising:i touched_before:i",
    f"{BARS}, {panels_sql(['fig10'])}, final AS (SELECT code, d, coalesce(fig10_path > lag(fig10_path, 20) {BY}, false) AS path_rising, coalesce(lag(fig10_touch_lo) {BY}, false) AS touched_before FROM feat)",
)
def enriched_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.enriched(features.multi_scale(derive_bars(spark, sf_dir), ["fig10"]))


QUIET = f"""{BARS}, {panels_sql(['fig7', 'fig8', 'fig9', 'fig10'])}, v AS (SELECT *, CASE WHEN count(r) {over(5)} >= 5 THEN stddev_pop(r) {over(5)} * sqrt(252) END AS rv5, CASE WHEN count(r) {over(20)} >= 20 THEN stddev_pop(r) {over(20)} * sqrt(252) END AS rv FROM feat),
    an AS (SELECT d, avg(rv) AS anchor_rv FROM v GROUP BY d),
    h AS (SELECT v.*, list(rv5) FILTER (WHERE rv5 IS NOT NULL) {over(120).replace('code ORDER BY d', 'v.code ORDER BY v.d')} AS hist, CASE WHEN anchor_rv > 0 THEN 0.05 * rv / anchor_rv END AS need, close / lag(close, 20) {BY.replace('code ORDER BY d', 'v.code ORDER BY v.d')} - 1 AS got FROM v LEFT JOIN an ON an.d = v.d),
    qd AS (SELECT *, coalesce((coalesce(fig7_gap <= -0.12, false) OR fig7_touch_lo) AND fig7_g > 0 AND fig8_g > 0 AND CASE WHEN len(hist) >= 60 AND rv5 IS NOT NULL THEN len(list_filter(hist, lambda x: x <= rv5)) / len(hist) END <= 0.30
      AND got - (pow(1 + need, 20.0 / 252) - 1) <= 0 AND NOT (fig9_touch_hi OR fig10_touch_hi), false) AS qd_entry FROM h)"""


@query("code:s d:d vol5_pct:f need_gap:f qd_entry:i qx_s1:i qx_reclaim:i qx_break:i",
    f"""{QUIET}, final AS (SELECT code, d, CASE WHEN len(hist) >= 60 AND rv5 IS NOT NULL THEN len(list_filter(hist, lambda x: x <= rv5)) / len(hist) END AS vol5_pct, got - (pow(1 + need, 20.0 / 252) - 1) AS need_gap, qd_entry,
      fig9_touch_hi OR fig10_touch_hi AS qx_s1, coalesce(fig7_gap >= 0, false) AS qx_reclaim, coalesce(fig7_g < 0 AND fig8_g < 0, false) AS qx_break FROM qd)""")  # fmt: skip
def quiet_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.quiet_exits(features.quiet_discount(features.multi_scale(derive_bars(spark, sf_dir), ["fig7", "fig8", "fig9", "fig10"])))


@query(
    "code:s label:s start_no:i end_no:i iou:f",
    f"""{REG}, ch AS (SELECT code, d, raw, row_number() {BY} AS bar, CASE WHEN raw IS DISTINCT FROM lag(raw) {BY} THEN 1 ELSE 0 END AS ch FROM rw),
    rn AS (SELECT *, sum(ch) OVER (PARTITION BY code ORDER BY bar) AS run FROM ch),
    sg AS (SELECT code, run AS key, min(raw) AS label, min(bar) AS first, max(bar) AS last FROM rn GROUP BY code, run),
    a AS (SELECT * FROM sg WHERE label <> 'range'), b AS (SELECT code, label, first + 5 AS first, last + 5 AS last FROM sg WHERE label <> 'range'),
    j AS (SELECT a.code, a.label, a.first, a.last, greatest(0, least(a.last, b.last) - greatest(a.first, b.first) + 1) AS ov, a.last - a.first + 1 + b.last - b.first + 1 AS tot FROM a JOIN b USING (code, label)),
    final AS (SELECT a.code, a.label, a.first AS start_no, a.last AS end_no, coalesce(m, 0) AS iou FROM a LEFT JOIN (SELECT code, first, max(ov / (tot - ov)) AS m FROM j WHERE ov > 0 GROUP BY 1, 2) x USING (code, first))""",
)
def segment_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a label against the same runs five bars later."""
    rows = _regimes(spark, sf_dir).withColumns({"bar": w.bar_no(), "ch": F.coalesce(F.col("raw") != F.lag("raw").over(w.by_code()), F.lit(True)).cast("int")})
    runs = rows.withColumn("key", F.sum("ch").over(w.so_far())).groupBy("code", "key").agg(F.min("raw").alias("label"), F.min("bar").alias("start_no"), F.max("bar").alias("end_no"))
    own = runs.where("label <> 'range'")
    return regimes.segment_overlap(own, own.withColumns({"start_no": F.col("start_no") + 5, "end_no": F.col("end_no") + 5}))


@query(
    "name:s domain:s",
    """final AS (SELECT DISTINCT p_type AS name, CASE WHEN regexp_matches(lower(p_type), 'bond|treasury|credit') THEN 'bond' WHEN regexp_matches(lower(p_type), 'gold|oil|commodit') THEN 'commodity'
    WHEN regexp_matches(lower(p_type), 'cash|money') THEN 'cash' ELSE 'equity' END AS domain FROM (SELECT p_type FROM part UNION ALL SELECT 'Treasury ' || p_brand FROM part UNION ALL SELECT 'Gold ' || p_brand FROM part UNION ALL SELECT 'MONEY ' || p_brand FROM part))""",
)
def name_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.col("p_type").alias("name"))
    for word in ("Treasury", "Gold", "MONEY"):
        names = names.unionByName(parts.select(F.concat_ws(" ", F.lit(word), "p_brand").alias("name")))
    return names.distinct().select("name", cluster.domain(F.col("name")).alias("domain"))


@query(
    "code:s kind:s",
    """f AS (SELECT 'N' || n_nationkey AS code, CASE WHEN n_regionkey < 3 THEN 'fund' ELSE 'note' END AS kind, DATE '1995-01-01' + CAST(n_nationkey * 30 AS INT) AS ld, n_nationkey AS k FROM nation),
    final AS (SELECT code, kind FROM f WHERE k IN (3, 24) OR (kind = 'fund' AND ld <= DATE '1996-06-01' AND k % 5 <> 1))""",
)
def fund_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    code = F.concat(F.lit("N"), "n_nationkey").alias("code")
    funds = nations.select(F.concat(F.lit(" n"), "n_nationkey").alias("code"), F.when(F.col("n_regionkey") < 3, "fund").otherwise("note").alias("kind"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("n_nationkey") * 30).cast("int")).alias("list_date"))
    return source.fund_universe(funds, ["fund"], "1996-06-01", nations.where("n_nationkey % 5 = 1").select(code), nations.where("n_nationkey in (3, 24)").select(code))
