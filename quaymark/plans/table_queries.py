"""Queries over the star schema and events: joins, aggregations, sets, top-k, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.plans.shape import query
from quaymark.sources.bars import table
from quaymark.sources.sinks import backfill, upsert
from quaymark.streaming.bars import bars as event_bars


def _money(name: str) -> Column:
    """Prices in cents, so that sums are exact in any order."""
    return F.col(name).cast("decimal(18,2)")


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


@query(
    "flag:s status:s n:i qty:e price:f disc:f",
    """final AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty, avg(l_extendedprice) AS price, avg(l_discount) AS disc
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-01' GROUP BY 1, 2)""",
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-01").cast("timestamp"))
    return rows.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(
        F.count("*").alias("n"), F.sum(_money("l_quantity")).alias("qty"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc")
    )


@query(
    "nation:s orders:i total:e",
    """final AS (SELECT n_name AS nation, count(o_orderkey) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM nation
    JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1)""",
)
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = people.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(done, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy(F.col("n_name").alias("nation")).agg(F.count("o_orderkey").alias("orders"), F.sum(_money("o_totalprice")).alias("total"))


@query("segment:s n:i", "final AS (SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT') GROUP BY 1)")
def customers_without_urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    idle = table(spark, sf_dir, "customer").join(urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return idle.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("brand:s n:i", "final AS (SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1)")
def returned_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(back, "p_partkey", "left_semi").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))


@query(
    "nation:s rank:i customer:i total:e",
    """t AS (SELECT c_nationkey, c_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY total DESC, c_custkey) AS rank FROM t),
    final AS (SELECT n_name AS nation, rank, c_custkey AS customer, total FROM r JOIN nation ON c_nationkey = n_nationkey WHERE rank <= 3)""",
)
def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(_money("o_totalprice")).alias("total"))
    named = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(spent, "c_custkey")
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("total"), "c_custkey"))
    best = named.withColumn("rank", rank).where("rank <= 3")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return best.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), "rank", F.col("c_custkey").alias("customer"), "total")


@query("part:i price:f", "final AS (SELECT p_partkey AS part, p_retailprice AS price FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20)")
def dearest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(20).select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("price"))


@query(
    "user:i kind:s first_value:f last_value:f n:i mean:e p90:f w_mean:e",
    """v AS (SELECT *, CAST(value AS DECIMAL(18,2)) AS cents, CAST(event_id % 7 + 1 AS DECIMAL(9,0)) AS w FROM events),
    final AS (SELECT user_id AS user, event_type AS kind, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value, count(*) AS n,
    CAST(sum(cents) AS DOUBLE) / count(cents) AS mean, quantile_cont(value, 0.9) AS p90, CAST(sum(cents * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS w_mean FROM v GROUP BY 1, 2)""",
)
def event_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = (F.col("event_id") % 7 + 1).cast("decimal(9,0)")
    exact, total = F.sum(_money("value")).cast("double"), F.sum(weight).cast("double")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).agg(
        F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"), F.count("*").alias("n"),
        (exact / F.count("value")).alias("mean"), F.percentile("value", 0.9).alias("p90"), (F.sum(_money("value") * weight).cast("double") / total).alias("w_mean"),
    )


@query(
    "code:s start:d open:f high:f low:f close:f volume:i",
    """final AS (SELECT event_type AS code, date_trunc('day', ts) AS start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume
    FROM (SELECT event_type, ts, max(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1, 2)""",
)
def daily_event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code"), "ts").agg(F.max("value").alias("price"))
    return event_bars(rows)


@query(
    "event_id:i user:i ts:d before_kind:s gap_s:f",
    """b AS (SELECT event_id, user_id, ts, lag(event_type) OVER w AS before_kind, lag(ts) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    final AS (SELECT event_id, user_id AS user, ts, before_kind, epoch(ts) - epoch(before) AS gap_s FROM b)""",
)
def previous_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("user"), "ts", "event_type", "user_id")
    return rows.withColumns(
        {"before_kind": F.lag("event_type").over(order), "gap_s": _micros(F.col("ts")) / 1e6 - _micros(F.lag("ts").over(order)) / 1e6}
    )


@query(
    "user:i session_no:i start:d n:i total:e",
    """b AS (SELECT *, CASE WHEN coalesce(epoch(ts) - epoch(lag(ts) OVER w) > 86400, true) THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no FROM b),
    final AS (SELECT user_id AS user, session_no, min(ts) AS start, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM s GROUP BY 1, 2)""",
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("user"), "ts", "value")
    gap = _micros(F.col("ts")) / 1e6 - _micros(F.lag("ts").over(order)) / 1e6
    marked = rows.withColumn("nw", F.coalesce(gap > 86400, F.lit(True)).cast("int"))
    numbered = marked.withColumn("session_no", F.sum("nw").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user", "session_no").agg(F.min("ts").alias("start"), F.count("*").alias("n"), F.sum(_money("value")).alias("total"))


@query(
    "order_id:i ship:d event_id:i",
    """o AS (SELECT o_orderkey AS order_id, o_custkey % 150 AS usr, TIMESTAMP '2024-01-01' + CAST(o_orderkey % 2592000 AS INT) * INTERVAL 1 SECOND AS order_at FROM orders),
    e AS (SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM events) WHERE n = 1),
    final AS (SELECT order_id, order_at AS ship, event_id FROM o ASOF LEFT JOIN e ON o.usr = e.user_id AND o.order_at >= e.ts)""",
)
def last_event_before_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: union both sides by user and carry the last event forward."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("o_orderkey") % 2592000)
    left = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("user"), at.alias("at"), F.col("o_orderkey").alias("order_id"),
                                                 F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("side"))
    right = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("at"), F.lit(None).cast("long").alias("order_id"), "event_id", F.lit(0).alias("side"))
    order = Window.partitionBy("user").orderBy("at", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = left.unionByName(right).withColumn("seen", F.last("event_id", ignorenulls=True).over(order))
    return carried.where("side = 1").select("order_id", F.col("at").alias("ship"), F.col("seen").alias("event_id"))


@query(
    "key:i status:s total:m",
    """old AS (SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS total FROM orders WHERE o_orderkey % 3 <> 0),
    nw AS (SELECT o_orderkey AS key, 'X' AS status, o_totalprice * 2 AS total FROM orders WHERE o_orderkey % 2 = 0),
    final AS (SELECT * FROM nw UNION ALL SELECT * FROM old WHERE key NOT IN (SELECT key FROM nw))""",
)
def upserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    return upsert(rows.where("key % 3 <> 0"), rows.where("key % 2 = 0").withColumns({"status": F.lit("X"), "total": F.col("total") * 2}), ["key"])


@query(
    "key:i a:f b:f",
    """old AS (SELECT o_orderkey AS key, o_totalprice AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS b FROM orders WHERE o_orderkey % 3 <> 0),
    nw AS (SELECT o_orderkey AS key, 1.0 AS a, 2.0 AS b FROM orders WHERE o_orderkey % 5 <> 0),
    final AS (SELECT coalesce(o.key, n.key) AS key, coalesce(o.a, n.a) AS a, coalesce(o.b, n.b) AS b FROM old o FULL JOIN nw n ON o.key = n.key)""",
)
def backfilled_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("a"))
    old = rows.where("key % 3 <> 0").withColumn("b", F.when(F.col("key") % 2 == 0, F.col("a")))
    found = rows.where("key % 5 <> 0").select("key", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    return backfill(old, found, ["key"], ["a", "b"])


@query(
    "side:s key:i",
    """a AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'O'),
    final AS (SELECT 'both' AS side, key FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', key FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
      UNION ALL SELECT 'second', key FROM (SELECT * FROM b EXCEPT SELECT * FROM a))""",
)
def customer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    a, b = (rows.where(F.col("o_orderstatus") == s).select("key").distinct() for s in ("F", "O"))
    parts = {"both": a.intersect(b), "first": a.subtract(b), "second": b.subtract(a)}
    named = [df.select(F.lit(name).alias("side"), "key") for name, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query(
    "year:s priority:s n:i total:e",
    """final AS (SELECT CASE WHEN grouping(year(o_orderdate)) = 1 THEN 'all' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year,
    CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS priority, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
    FROM orders GROUP BY GROUPING SETS ((), (year(o_orderdate)), (o_orderpriority)))""",
)
def order_totals_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("string").alias("y"), F.col("o_orderpriority").alias("p"), "o_totalprice")
    sets = rows.groupingSets([[], ["y"], ["p"]], "y", "p").agg(F.count("*").alias("n"), F.sum(_money("o_totalprice")).alias("total"), F.grouping("y").alias("gy"), F.grouping("p").alias("gp"))
    return sets.select(F.when(F.col("gy") == 1, "all").otherwise(F.col("y")).alias("year"), F.when(F.col("gp") == 1, "all").otherwise(F.col("p")).alias("priority"), "n", "total")


@query(
    "priority:s f:e o:e p:e",
    """final AS (SELECT o_orderpriority AS priority, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS o,
    sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS p FROM orders GROUP BY 1)""",
)
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum(_money("o_totalprice")))
    return pivoted.toDF("priority", "f", "o", "p")


@query(
    "brand:s types:s n:i",
    """final AS (SELECT p_brand AS brand, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS types, count(*) AS n FROM part GROUP BY 1)""",
)
def types_of_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.concat_ws("|", F.array_sort(F.collect_set("p_type"))).alias("types"), F.count("*").alias("n"))
