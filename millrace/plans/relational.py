"""Queries of joins, aggregates, windows, sets and top-k over the star schema, and of windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import metrics
from millrace.sources.tables import table
from millrace.streaming import telemetry


def join_inner(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = orders.join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return named.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def join_left_anti(spark: SparkSession, folder: str) -> DataFrame:
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, folder, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def join_semi(spark: SparkSession, folder: str) -> DataFrame:
    returned = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    return table(spark, folder, "part").join(returned, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


def join_full(spark: SparkSession, folder: str) -> DataFrame:
    sold = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n_lines"))
    bought = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    return sold.join(bought, "k", "full").select("k", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


def join_theta(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers and the customers of their nation with a greater balance: an equality, then a comparison."""
    s, c = table(spark, folder, "supplier"), table(spark, folder, "customer")
    pairs = s.join(c, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("c_acctbal") > F.col("s_acctbal")))
    return pairs.groupBy("s_suppkey").agg(F.count("*").alias("n_richer"), F.round(F.max("c_acctbal"), 2).alias("richest"))


def agg_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def agg_cube(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").cube("o_orderstatus", "o_orderpriority")
    return rows.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


def agg_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"))


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = table(spark, folder, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


def window_rank(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(spark, folder, "orders").withColumn("rank", F.row_number().over(w))
    return rows.where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


def window_frame(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("running"))


def topk_per_group(spark: SparkSession, folder: str) -> DataFrame:
    """The five best-selling parts of each brand."""
    sold = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    joined = sold.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("quantity"), "p_partkey")
    return joined.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("p_brand", "p_partkey", F.round("quantity", 2).alias("quantity"), "rank")


def set_union(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, folder, "supplier").select("s_nationkey")).distinct()


def set_intersect(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, folder, "lineitem").select("l_partkey"))


def set_except(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, folder, "orders").select("o_custkey").distinct())


def telemetry_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.tumbling(table(spark, folder, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def telemetry_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.sliding(table(spark, folder, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def telemetry_session(spark: SparkSession, folder: str) -> DataFrame:
    rows = telemetry.sessions(table(spark, folder, "events"))
    return rows.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


def latency_percentile_rank(spark: SparkSession, folder: str) -> DataFrame:
    parts = [metrics.ranked_percentile(table(spark, folder, "events"), "event_type", "value", p).withColumn("percent", F.lit(p)) for p in (50, 95)]
    return parts[0].unionByName(parts[1])


QUERIES = [
    join_inner, join_left_anti, join_semi, join_full, join_theta, agg_rollup, agg_cube, agg_distinct, pricing_summary, window_rank, window_frame, topk_per_group,
    set_union, set_intersect, set_except, telemetry_tumbling, telemetry_sliding, telemetry_session, latency_percentile_rank,
]

SQL = {
    "join_inner": "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "join_semi": "SELECT p_partkey, p_brand FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')",
    "join_full": """SELECT k, coalesce(n_lines, 0) AS n_lines, coalesce(n_orders, 0) AS n_orders FROM (SELECT l_suppkey AS k, count(*) AS n_lines FROM lineitem GROUP BY 1)
        FULL JOIN (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) USING (k)""",
    "join_theta": "SELECT s_suppkey, count(*) AS n_richer, round(max(c_acctbal), 2) AS richest FROM supplier JOIN customer ON s_nationkey = c_nationkey AND c_acctbal > s_acctbal GROUP BY s_suppkey",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS INTEGER) AS level, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "window_rank": "SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "window_frame": "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING), 2) AS running FROM lineitem",
    "topk_per_group": """SELECT p_brand, p_partkey, round(quantity, 2) AS quantity, CAST(rank AS INTEGER) AS rank FROM (SELECT p_brand, p_partkey, quantity, row_number() OVER (PARTITION BY p_brand ORDER BY quantity DESC, p_partkey) AS rank
        FROM (SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey) WHERE rank <= 5""",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT l_partkey FROM lineitem",
    "set_except": "SELECT p_partkey AS k FROM part EXCEPT ALL SELECT DISTINCT o_custkey FROM orders",
    "telemetry_tumbling": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "telemetry_sliding": "SELECT CAST(date_trunc('day', ts) - d * INTERVAL 1 DAY AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) AS o(d) GROUP BY 1, 2",
    "telemetry_session": """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 DAY THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
        SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM b GROUP BY user_id, g""",
    "latency_percentile_rank": """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, value, percent FROM o, (VALUES (50), (95)) AS p(percent) WHERE i = greatest(CAST(floor(n * percent / 100.0) AS BIGINT) - 1, 0)""",
}
